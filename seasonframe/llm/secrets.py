"""Secrets: an Aho-Corasick pass finds keywords, anchored patterns look only there, and checksums
embedded in tokens confirm them."""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
import string
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase


def _crc32_token(found: re.Match) -> bool:
    """The last six characters are the base-62 CRC-32 of those after the prefix."""
    body, check = found.group(1)[:-6], found.group(1)[-6:]
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        digits = _BASE62[digit] + digits
    return digits.rjust(6, "0") == check


def _signed_token(found: re.Match) -> bool:
    """The first part decodes to a JSON header that names an algorithm."""
    head = found.group().split(".")[0]
    try:
        header = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except ValueError:
        return False
    return isinstance(header, dict) and "alg" in header


@dataclass(frozen=True)
class Rule:
    """A pattern tried where one of its keywords (lower case) starts.

    Where it fails, it also fails at every later start inside `run` from there, so those are not
    tried: else keywords that fill a run would each read it to its end.
    """
    kind: str
    keywords: tuple[str, ...]
    pattern: str
    accept: Callable[[re.Match], bool]
    run: str | None = None


#: Kinds in the order of the result; `hex` has no keyword and stands between these.
RULES = (
    Rule("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
         r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
         r"([A-Za-z0-9+/_.=-]+)", lambda m: len(m.group(2)) >= 8),
    Rule("access", ("akia",), r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16),
    Rule("crc_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
         r"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])", _crc32_token),
    Rule("signed_token", ("eyj",), r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}",
         _signed_token, r"[A-Za-z0-9_-]*"),
    Rule("private_key", ("-----begin ",),
         r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}-----END ", lambda m: True),
)
HEX = re.compile(r"[0-9a-f]{32,}")
BASE = ("assign", "access", "hex")
ORDER = {k: i for i, k in enumerate((*BASE, *(r.kind for r in RULES if r.kind not in BASE)))}


@functools.lru_cache
def _search():
    automaton = ahocorasick.Automaton()
    for k, rule in enumerate(RULES):
        for word in rule.keywords:
            automaton.add_word(word, (k, len(word)))
    automaton.make_automaton()
    return automaton, [(re.compile(r.pattern, re.ASCII), r.run and re.compile(r.run)) for r in RULES]


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; per kind leftmost, not overlapping.

    Matches that fail their check are dropped, and the search goes on behind them. `hex` has no
    keyword to look for: its runs are found by one more linear pass over the text.
    """
    if not text:
        return []
    automaton, patterns = _search()
    hits = {(k, end + 1 - size) for end, (k, size) in automaton.iter(text.translate(_LOWER))}
    spans, ends = [], [0] * len(RULES)
    for k, at in sorted(hits):
        if at < ends[k]:
            continue
        pattern, run = patterns[k]
        found = pattern.match(text, at)
        if found:
            ends[k] = found.end()
            if RULES[k].accept(found):
                spans.append((RULES[k].kind, at, found.end()))
        elif run:
            ends[k] = run.match(text, at).end()
    spans += (("hex", m.start(), m.end()) for m in HEX.finditer(text))
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]]))


def digest(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str, spans) -> str:
    """The text with every span, overlapping ones joined, replaced by [SECRET]."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += (text[at:start], "[SECRET]")
        at = max(at, end)
    return "".join(out) + text[at:]


def find_secrets(rows: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """Rows with `into`: array of (kind, start, end) in code points. Null or empty text: none."""
    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": k, "start": a, "end": b} for k, a, b in scan(t)])
    return rows.withColumn(into, spans(F.col(text)))


def redact_secrets(rows: DataFrame, text: str = "text", into: str = "redacted") -> DataFrame:
    """Rows with `into`: the text with every secret in it replaced; null stays null."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t, scan(t)) if t else t)
    return rows.withColumn(into, clean(F.col(text)))


def secret_report(documents: DataFrame) -> DataFrame:
    """Per row: counts of the base kinds, SHA-256 of the base spans, all spans."""
    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def report(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            spans = scan(text)
            base = [s for s in spans if s[0] in BASE]
            out.append((*(sum(s[0] == k for s in base) for k in BASE),
                        hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)))
        return pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return documents.select("doc_id", report("text").alias("r")).select("doc_id", "r.*")
