"""Personal data: regular expressions propose, checksums confirm, context adjusts the score.

DataFrame functions only. A pattern's matches are enclosed in a mark by regexp_replace and the text
is split there, which gives every match with its place; pieces are put together in blocks, so
that texts with very many matches stay cheap. The patterns are possessive
forms of the contract's: they start only where a run starts, never go back, and so stay linear and
need no stack on very long runs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, STAND_IN = "\ue000", "\ue001"
CONTEXT = 48
BLOCK = 256  # pieces put together at a time; even, so that a block starts outside a match
SPAN = "struct<start:int,end:int,value:string,before:string>"
#: Pieces that hold CONTEXT characters for sure: every second one is a match and so not empty.
REACH = 2 * CONTEXT + 2


@dataclass(frozen=True)
class Kind:
    """A pattern, the characters without which it cannot match, a prior and context words."""
    name: str
    pattern: str
    needs: str
    prior: float
    context: str
    base: bool = True


#: Kinds in the order of the result, those that must stay first.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++"
         r"(?:\.[A-Za-z0-9-]++)++", "@", 0.8, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6,
         "ip|addr|host|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", "", 0.2, "card|visa|credit|payment|karte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}"
         r"(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 0.2, "iban|account|konto|cuenta|compte",
         False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
         "-", 0.3, "ssn|social security|taxpayer", False),
    Kind("tel", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", "", 0.3,
         "phone|tel|call|mobile|fax", False),
)
CHECKSUM, NEARBY, ACCEPT = 0.6, 0.2, 0.5
_WITH_CHECKSUM = ("card", "iban")


def _matches(text: Column, kind: Kind) -> Column:
    """Array of (start, end, value, text before, text after), left to right; places in code points.

    Both texts run over neighbouring matches, so that one context word serves a whole list.
    """
    def step(state: Column, piece: Column) -> Column:
        to = state["at"] + F.length(piece)
        span = F.struct(state["at"].alias("start"), to.alias("end"), piece.alias("value"),
                        state["before"].alias("before"))
        return F.struct(
            to.alias("at"), (~state["inside"]).alias("inside"),
            F.right(F.concat(state["before"], F.right(piece, F.lit(CONTEXT))), F.lit(CONTEXT))
            .alias("before"),
            F.when(state["inside"], F.array_append(state["out"], span)).otherwise(state["out"])
            .alias("out"))

    def step_back(state: Column, piece: Column) -> Column:
        return F.struct(
            (~state["inside"]).alias("inside"),
            F.left(F.concat(F.left(piece, F.lit(CONTEXT)), state["after"]), F.lit(CONTEXT))
            .alias("after"),
            F.when(state["inside"], F.array_append(state["out"], state["after"]))
            .otherwise(state["out"]).alias("out"))

    def total(values: Column, begin: Column, count: Column) -> Column:
        return F.aggregate(F.slice(values, begin, count), F.lit(0), lambda at, n: at + n)

    def sums(values: Column) -> Column:
        """Of every BLOCK values in a row."""
        return F.transform(numbers(values), lambda k: total(values, k * BLOCK + 1, F.lit(BLOCK)))

    def numbers(values: Column) -> Column:
        return F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))

    def block(pieces: Column, k: Column, blocks: Column, many: Column) -> Column:
        # where it begins: all groups of BLOCK blocks before its own, then blocks of its own
        group = F.floor(k / BLOCK).cast("int")
        first = total(many, F.lit(1), group) + total(blocks, group * BLOCK + 1, k % BLOCK)
        ahead = F.slice(pieces, F.greatest(k * BLOCK - REACH, F.lit(0)) + 1,
                        F.least(k * BLOCK, F.lit(REACH)))
        behind = F.slice(pieces, (k + 1) * BLOCK + 1, F.lit(REACH))
        ends = lambda part, cut: F.array_join(
            F.transform(part, lambda piece: cut(piece, F.lit(CONTEXT))), "")
        start = F.struct(first.alias("at"), F.lit(False).alias("inside"),
                         F.right(ends(ahead, F.right), F.lit(CONTEXT)).alias("before"),
                         none.alias("out"))
        mine = F.slice(pieces, k * BLOCK + 1, F.lit(BLOCK))
        last = F.struct((F.size(mine) % 2 == 0).alias("inside"),
                        F.left(ends(behind, F.left), F.lit(CONTEXT)).alias("after"),
                        F.array().cast("array<string>").alias("out"))
        spans = F.aggregate(mine, start, step, lambda state: state["out"])
        after = F.aggregate(F.reverse(mine), last, step_back, lambda state: F.reverse(state["out"]))
        return F.zip_with(spans, after, lambda s, x: s.withField("after", x))

    def once(value: Column, use) -> Column:
        """use(value), with the value evaluated once."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def all_blocks(pieces: Column) -> Column:
        lengths = F.transform(pieces, lambda piece: F.length(piece))
        return once(lengths, lambda each: once(sums(each), lambda blocks: once(
            sums(blocks), lambda many: F.flatten(F.transform(
                numbers(pieces), lambda k: block(pieces, k, blocks, many))))))

    none = F.array().cast(f"array<{SPAN}>")
    empty = F.array().cast(f"array<{SPAN[:-1]},after:string>>")
    pieces = F.split(F.regexp_replace(text, kind.pattern, f"{MARK}$0{MARK}"), MARK, -1)
    found = once(pieces, all_blocks)
    return F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(empty) if kind.needs else found


def _mod97(value: Column) -> Column:
    compact = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))

    def step(total: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (total * 100 + code - 55) % 97).otherwise(
            (total * 10 + code - 48) % 97)
    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step) == 1


def _valid(kind: Kind, value: Column) -> Column:
    if kind.name == "ip":
        return value.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)(?:\.|$)){4}$")
    if kind.name == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind.name == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return _mod97(value) if kind.name == "iban" else F.lit(True)


def find_pii(rows: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Rows with `into`: array of (kind, start, end, score), by kind in the order of KINDS, then
    start; places in code points, end exclusive. Other columns stay as they are.

    Per kind, matches are leftmost and do not overlap; those that fail their check (parts of an
    address, digits and Luhn of a card, digits of a phone, mod-97 of an account number) are
    dropped. The score is the kind's prior, more for a checksum that holds and for a context word
    within CONTEXT characters before or after, other matches included; a span needs ACCEPT. Base kinds reach that without context. Null or empty
    text: an empty array.
    """
    clean = F.translate(F.coalesce(F.col(text), F.lit("")), MARK, STAND_IN)

    def scored(kind: Kind) -> Column:
        near = rf"\b(?:{kind.context})"
        fixed = kind.prior + (CHECKSUM if kind.name in _WITH_CHECKSUM else 0)
        spans = F.filter(_matches(clean, kind), lambda s: _valid(kind, s["value"]))
        spans = F.transform(spans, lambda s: F.struct(
            F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.when(F.lower(s["before"]).rlike(near) | F.lower(s["after"]).rlike(near),
                   F.lit(round(min(1.0, fixed + NEARBY), 3))).otherwise(F.lit(round(fixed, 3)))
            .alias("score")))
        return F.filter(spans, lambda s: s["score"] >= ACCEPT)

    return rows.withColumn(into, F.concat(*(scored(k) for k in KINDS)))


def digest(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(documents: DataFrame) -> DataFrame:
    """Per row of documents: counts of the base kinds, digest of base spans, all spans, scores."""
    base = [k.name for k in KINDS if k.base]
    spans = find_pii(documents.select("doc_id", "text")).select("doc_id", "pii")
    is_base = lambda s: reduce(Column.__or__, (s["kind"] == k for k in base))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(digest(F.filter("pii", is_base)), 256).alias("base_sha256"),
        digest(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"))
