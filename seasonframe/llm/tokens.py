"""Token ids of whole texts with a public tokenizer, cut into pieces of bounded length."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
TOKENIZER = "word_bpe_49k.json"
END = b"\0\0\0\0"
REMEMBERED = 600_000
GROUP = 1 << 20
LONG = 64  # characters from which a run is not remembered
MANY = 5000

#: Characters whose lower case and kind no Unicode version changes (`<` may begin a
#: special token), and the runs that the tokenizer's own pattern splits them into.
_PLAIN = re.compile(r"[ \t-\r!-;=-~À-ÖØ-öø-ÿ]*")
_RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")


class RunIds:
    """Ids (little-endian 32-bit) of runs of letters or punctuation, remembered up to a bound.

    The tokenizer splits at white space, lower-cases letter by letter, and splits what is left into
    runs that it tokenizes each on its own; a run between blanks is that run again, and it ends with
    the one token that closes a word. So new runs are tokenized many at a time. Blank-separated
    chunks with other characters go through the tokenizer as they are.
    """

    def __init__(self, model):
        self.model, self.ids = model, {}
        vocabulary = model.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")

    @staticmethod
    def split(text: str) -> list[str]:
        """The runs of a text; chunks that are not plain stay whole."""
        if _PLAIN.fullmatch(text):
            return _RUNS.findall(text.lower())
        out = []
        for chunk in text.replace("\n", " ").split(" "):
            out += _RUNS.findall(chunk.lower()) if _PLAIN.fullmatch(chunk) else [chunk]
        return out

    def learn(self, runs: set[str]) -> None:
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        new, known = runs.difference(self.ids), self.ids
        plain = [run for run in new if _PLAIN.fullmatch(run)]
        for first in range(0, len(plain), MANY):
            part = plain[first:first + MANY]
            ids = self.encode(" ".join(part))
            ends = 4 * (np.flatnonzero(self.closes[ids]) + 1)
            if len(ends) == len(part):
                data, at = ids.tobytes(), 0
                for run, end in zip(part, ends.tolist()):
                    known[run] = data[at:end]
                    at = end
        for run in new:
            if run not in known:
                known[run] = self.encode(run).tobytes()


@functools.lru_cache
def _run_ids(tokenizer: str) -> RunIds:
    import public_tokenizers
    from tokenizers import Tokenizer

    return RunIds(Tokenizer.from_file(public_tokenizers.path(tokenizer)))


def tokens_of(texts: Iterable[str | None], tokenizer: str = TOKENIZER) -> Iterator[bytes]:
    """Per text, ids of the whole text and a final id 0, 4 bytes each, little-endian; null is
    empty. Texts are taken about GROUP characters at a time."""
    memory, held, size = _run_ids(tokenizer), [], 0

    def flush():
        memory.learn(every := set().union(*held))
        find = memory.ids.__getitem__
        for runs in held:
            yield b"".join(map(find, runs)) + END
        for run in every:
            if len(run) > LONG:
                del memory.ids[run]

    for text in texts:
        held.append(memory.split(text or ""))
        size += len(text or "")
        if size > GROUP:
            yield from flush()
            held, size = [], 0
    yield from flush()


def token_bytes(text: str | None, tokenizer: str = TOKENIZER) -> bytes:
    return next(tokens_of([text], tokenizer))


def pieces(ids: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, bytes]]:
    """(piece, start, ids) of at most `length` tokens each; only the last may be shorter."""
    for k, at in enumerate(range(0, len(ids), 4 * length)):
        yield k, at // 4, ids[at:at + 4 * length]


def piece_table(documents: DataFrame, length: int = LENGTH, with_ids: bool = False,
                tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): one row per piece of every document."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][:len(names)]

    def table(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            texts = (text.as_py() for text in batch.column("text"))
            for doc_id, whole in zip(batch.column("doc_id"), tokens_of(texts, tokenizer)):
                for k, start, ids in pieces(whole, length):
                    rows.append((doc_id.as_py(), k, start, len(ids) // 4, zlib.crc32(ids), ids)
                                [:len(names)])
                    held += len(ids)
                if held > 64 << 20:
                    yield table(rows)
                    rows, held = [], 0
            yield table(rows)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, schema + ", ids binary" * with_ids)
