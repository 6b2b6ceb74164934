"""Long repeated byte strings across a corpus, found with suffix arrays in shards.

Which shard a string of `length` bytes belongs to depends on its bytes alone: on the smallest hash
of the `width` bytes long grams in it. Strings that start side by side mostly share that gram, so a
text falls into a run of starts per gram, about one per (length - width) / 2 bytes, and equal
strings always lie in runs of one gram. Per gram, runs with equal bytes count as one, with their
number; if several different runs are left, one of each goes to the gram's shard. There a suffix
array is built by induced sorting, and permuted common prefixes tell which starts have a string
that also starts elsewhere.

A gram so frequent that its different runs would not fit a shard is not cut off: those runs are
dealt anew by the smallest of wider grams, until runs fit or the gram is the string itself. Runs
inside a shared passage become equal on the way and count as one, and only those at its ends,
which differ, go on.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonframe.llm.hashing import gram_hashes
from seasonframe.llm.suffix_array import permuted_common_prefixes, suffix_array
from seasonframe.storage import cut

SHARD_BYTES, GROUP_BYTES = 2 << 20, 1 << 20
PIECE = 1 << 20
BREAK = 0xFF  # in no UTF-8 text
RUN = "gram long, same long, k1 long, k2 long, first int, last int, n int"
_KEY = ["k1", "k2"]


def widths(length: int) -> list[int]:
    """Grams for dealing, from the first to the whole string, each closer to it by half."""
    out = [max(1, length * 8 // 25)]
    while out[-1] < length:
        out.append(length - (length - out[-1]) // 2)
        out[-1] = min(max(out[-1], out[-2] + 1), length)
    return out


def _smallest(values: np.ndarray, window: int) -> np.ndarray:
    """Smallest of every `window` values in a row, from minima of blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // window) * window, np.uint64(2**64 - 1))
    padded[:n] = values
    blocks = padded.reshape(-1, window)
    from_left = np.minimum.accumulate(blocks, axis=1).ravel()
    from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_right[:n - window + 1], from_left[window - 1:n])


def _runs(data: bytes, length: int, width: int, from_: int = 0, to: int | None = None):
    """(gram, digest, first, last, n) of the runs of starts in [from_, to]; n is 2 where the gram
    occurs twice in a run, which may then repeat itself, else 1."""
    window = length - width + 1
    end = len(data) - length if to is None else to
    for at in range(from_, end + 1, PIECE):
        stop = min(at + PIECE, end + 1)
        hashes = gram_hashes(np.frombuffer(data, np.uint8, stop - at + length - 1, at), width)
        least = _smallest(hashes, window)
        edges = np.flatnonzero(least[1:] != least[:-1]) + 1
        firsts = [0, *edges.tolist()]
        lasts = [*(edges - 1).tolist(), len(least) - 1]
        for gram, a, b in zip(least[firsts].view(np.int64).tolist(), firsts, lasts):
            twice = np.count_nonzero(hashes[a:b + window] == least[a]) > 1
            digest = xxhash.xxh3_64_intdigest(data[at + a:at + b + length])
            yield gram, digest - (1 << 63), at + a, at + b, 2 if twice else 1


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_RUNS = pa.schema([("gram", pa.int64()), ("same", pa.int64()), ("k1", pa.int64()),
                   ("k2", pa.int64()), ("first", pa.int32()), ("last", pa.int32()),
                   ("n", pa.int32())])
_STARTS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int32()),
                     ("last", pa.int32())])


def _flushed(rows, schema: pa.Schema, weight=lambda row: 1, most: int = 50_000):
    """Rows in batches of so much weight."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += weight(row)
        if total >= most:
            yield _table(held, schema)
            held, total = [], 0
    yield _table(held, schema)


def _first_copies(batches):
    """Rows but for those whose text came before in the same partition; how often is lost, so a
    text that did come again is returned twice."""
    seen: dict[tuple[int, int], int] = {}
    for batch in batches:
        keep = []
        for i, key in enumerate(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist())):
            seen[key] = seen.get(key, 0) + 1
            if seen[key] <= 2:
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def _all_runs(length: int, width: int):
    """Texts to the runs of all their starts. Copies go in the same function: one of its own in
    front would take a second Python worker for every task, and workers stay for later stages."""
    def rows(batch):
        for k1, k2, data in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "data"))):
            for gram, same, a, b, n in _runs(data, length, width):
                yield gram, same, k1, k2, a, b, n

    def run(batches):
        for batch in _first_copies(batches):
            yield from _flushed(rows(batch), _RUNS)
    return run


def _narrower_runs(length: int, width: int):
    """Runs (k1, k2, first, last, n) with their text to runs of a wider gram."""
    def rows(batch):
        for k1, k2, first, last, n, data in zip(*(batch.column(c).to_pylist() for c in (
                "k1", "k2", "first", "last", "n", "data"))):
            for gram, same, a, b, own in _runs(data, length, width, first, last):
                yield gram, same, k1, k2, a, b, max(n, own)

    def run(batches):
        for batch in batches:
            yield from _flushed(rows(batch), _RUNS)
    return run


def shard_starts(segments: list[tuple[int, int, int, bytes]], length: int) -> list[tuple]:
    """(k1, k2, first, last): starts in the segments (k1, k2, start, bytes) whose string of
    `length` bytes also starts elsewhere in them. Segments of one text that overlap are joined, so
    that no place meets itself."""
    joined: list[list] = []
    for k1, k2, start, data in sorted(segments, key=lambda s: s[:3]):
        if joined and joined[-1][:2] == [k1, k2] and start <= joined[-1][2] + len(joined[-1][3]):
            known = joined[-1][2] + len(joined[-1][3])
            joined[-1][3] += data[max(0, known - start):]
        else:
            joined.append([k1, k2, start, bytearray(data)])
    whole = bytes([BREAK]).join(s[3] for s in joined)
    text = np.frombuffer(whole, np.uint8)
    if len(text) <= length:
        return []
    before, shared = permuted_common_prefixes(text, suffix_array(text))
    found = np.flatnonzero(shared >= length)
    again = np.zeros(len(text) + 1, bool)
    again[found] = again[before[found]] = True
    out, at = [], 0
    for k1, k2, start, data in joined:
        inside = again[at:at + max(0, len(data) - length + 1)]  # others go on behind the segment
        mine = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        out += ((k1, k2, start + a, start + b - 1) for a, b in zip(mine[::2], mine[1::2]))
        at += len(data) + 1
    return out


def _shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        columns = (table.column(c).to_pylist() for c in ("k1", "k2", "start", "data"))
        return pa.Table.from_batches([_table(shard_starts(list(zip(*columns)), length), _STARTS)])
    return run


_SEGMENTS = pa.schema([("shard", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                       ("start", pa.int32()), ("data", pa.binary())])


def _segments(batches):
    """Texts with their runs (shard, first, end) to one segment per shard and stretch of runs."""
    def rows(batch):
        for k1, k2, data, runs in zip(*(batch.column(c).to_pylist() for c in (
                "k1", "k2", "data", "runs"))):
            stretch: dict[int, tuple[int, int]] = {}
            for r in sorted(runs, key=lambda r: r["first"]):
                start, end = stretch.get(r["shard"], (r["first"], r["first"]))
                if r["first"] > end:
                    yield r["shard"], k1, k2, start, data[start:end]
                    start = r["first"]
                stretch[r["shard"]] = start, max(end, r["end"])
            for shard, (start, end) in stretch.items():
                yield shard, k1, k2, start, data[start:end]

    for batch in batches:
        yield from _flushed(rows(batch), _SEGMENTS, lambda row: len(row[4]), 8 << 20)


_SPANS = "k1 long, k2 long, spans array<struct<start:int,end:int>>, rest binary"
_SPANS_ARROW = pa.schema([
    ("k1", pa.int64()), ("k2", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ("rest", pa.binary())])


def cover(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Spans, end exclusive, covered by the strings that start in the runs; touching ones are one."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def _rest(length: int):
    """Texts with their runs of repeated starts to the spans covered and the bytes left."""
    def rows(batch):
        for k1, k2, data, runs in zip(*(batch.column(c).to_pylist() for c in (
                "k1", "k2", "data", "runs"))):
            spans = cover([(r["first"], r["last"]) for r in runs], length)
            edges = [0, *(x for span in spans for x in span), len(data)]
            left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            yield k1, k2, [{"start": a, "end": b} for a, b in spans], left

    def run(batches):
        for batch in batches:
            yield from _flushed(rows(batch), _SPANS_ARROW, lambda row: len(row[3]) + 64, 8 << 20)
    return run


def _repeated(runs: DataFrame) -> DataFrame:
    """Written runs whose gram occurs twice or more."""
    runs = cut(runs)
    grams = runs.groupBy("gram").agg(F.sum("n").alias("total")).where("total > 1").select("gram")
    return cut(runs.join(grams, "gram", "left_semi"))


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text, F.lit(2)).alias("k2")]


def repeated_starts(documents: DataFrame, length: int = 400, text: str = "text",
                    shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES
                    ) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, first, last): runs of starts, in UTF-8 bytes, of strings of `length` bytes that
    also start elsewhere; and (k1, k2, data): the texts they are in, each once.

    k1 and k2 are the text_key. Runs may overlap or come more than once. Shorter, empty and null
    texts have none. Equal texts are one text whose strings all start again.
    """
    texts = documents.where(F.octet_length(text) >= length).select(
        *text_key(F.col(text)), F.col(text).cast("binary").alias("data"))
    steps = widths(length)
    first = _repeated(texts.mapInArrow(_all_runs(length, steps[0]), RUN))
    once = texts.mapInArrow(_first_copies, texts.schema)
    held = first.select(*_KEY).distinct()
    kept = cut(once.join(held, _KEY, "left_semi").groupBy(*_KEY).agg(F.first("data").alias("data")))
    starts, sharded, runs = [], [], first
    for step, width in enumerate(steps):
        last = step == len(steps) - 1
        runs_of = runs.groupBy("gram", "same").agg(
            F.sum("n").alias("n"), F.min(F.struct(*_KEY, "first", "last")).alias("one"),
            F.count("*").alias("places"))
        each = cut(runs_of)
        # runs with equal bytes in two places: every string in them starts again
        starts.append(runs.join(each.where("places > 1").select("gram", "same"), ["gram", "same"],
                                "left_semi").select(*_KEY, "first", "last"))
        size = (F.col("one.last") - F.col("one.first") + length).cast("long")
        grams = each.groupBy("gram").agg(F.count("*").alias("different"), F.sum(size).alias("bytes"),
                                         F.max(F.col("n") > F.col("places")).alias("itself"))
        open_ = each.join(grams.where("different > 1 OR itself"), "gram")
        one = ["one.k1", "one.k2", "one.first", "one.last"]
        if last:  # a run of equal strings: each starts again, and two stand for all
            starts.append(each.where("n > places").select(*one))
            end = F.least("one.last", F.col("one.first") + 1)
            sharded.append(open_.select("gram", *one[:3], end.alias("last"),
                                        F.lit(length + 1).cast("long").alias("size")))
            break
        fits = F.col("bytes") <= group_bytes
        sharded.append(open_.where(fits).select("gram", *one, size.alias("size")))
        hot = open_.where(~fits).select(*one, F.least("n", F.lit(2)).cast("int").alias("n"))
        runs = _repeated(hot.join(kept, _KEY).mapInArrow(
            _narrower_runs(length, steps[step + 1]), RUN))
        if runs.isEmpty():
            break
    cold = cut(reduce(DataFrame.unionByName, sharded))
    total = cold.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    wanted = cold.groupBy(*_KEY).agg(F.collect_list(F.struct(
        F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("shard"), "first",
        (F.col("last") + length).alias("end"))).alias("runs"))
    segments = kept.join(wanted, _KEY).mapInArrow(
        _segments, "shard long, k1 long, k2 long, start int, data binary")
    # by number, as adaptive execution would put small shards, which take long, into one task
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = segments.repartition(tasks, "shard").groupBy("shard").applyInArrow(
        _shard(length), "k1 long, k2 long, first int, last int")
    return cut(reduce(DataFrame.unionByName, [*starts, found]).distinct()), kept


def repeat_spans(documents: DataFrame, length: int = 400, text: str = "text", **options
                 ) -> DataFrame:
    """(k1, k2, spans, rest) for every text with bytes covered by repeated strings: array of
    (start, end) in bytes, end exclusive, ascending and apart; and the bytes that are left."""
    starts, kept = repeated_starts(documents, length, text, **options)
    runs = starts.groupBy(*_KEY).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return kept.join(runs, _KEY).mapInArrow(_rest(length), _SPANS)


def without_repeats(documents: DataFrame, length: int = 400, text: str = "text",
                    into: str = "rest", **options) -> DataFrame:
    """Documents with `into`: the bytes of the text that are left (null for a null text). A column
    of that name is replaced; all others stay, whatever their names."""
    rest = repeat_spans(documents, length, text, **options).select(
        F.col("k1").alias("_repeats_k1"), F.col("k2").alias("_repeats_k2"),
        F.col("rest").alias("_repeats_rest"))
    k1, k2 = text_key(F.col(text))
    keyed = documents.select(F.struct("*").alias("row"), k1, k2, F.col(text).alias("own"))
    columns = [F.col(f"row.`{c}`").alias(c) for c in documents.columns if c != into]
    return keyed.join(rest, (F.col("k1") == F.col("_repeats_k1")) &
                      (F.col("k2") == F.col("_repeats_k2")), "left").select(
        *columns, F.coalesce("_repeats_rest", F.col("own").cast("binary")).alias(into))


def repeats_report(documents: DataFrame, length: int = 400, **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that are left when
    every byte covered by a string of `length` bytes that also starts anywhere else is removed.

    Strings are judged on the input; matches never cross texts. Null texts are empty. Rows are
    judged by their text alone, so a null or repeated doc_id is a row like any other.
    """
    text = F.coalesce("text", F.lit("")).cast("string")
    rows = documents.select("doc_id", *text_key(F.col("text")), F.octet_length(text).cast("long")
                            .alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    found = repeat_spans(documents, length, **options).select(
        *_KEY, F.size("spans").cast("long").alias("spans"), F.octet_length("rest").alias("left"),
        F.sha2("rest", 256).alias("sha"))
    return rows.join(found, _KEY, "left").select(
        "doc_id", "n_bytes", F.coalesce(F.col("n_bytes") - F.col("left"), F.lit(0)).cast("long")
        .alias("n_removed"), F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"))
