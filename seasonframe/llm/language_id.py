"""Language identification: the family first, then one-versus-one linear SVMs within it.

A text becomes a normalised vector of hashed letter n-grams. A multinomial logistic regression
chooses the language family; within a family every pair of languages has a linear support vector
machine, and the language with most duels won (then the largest summed margin) is the answer.
Models are fitted with pyspark.ml on a bounded sample; prediction is one pass over whole texts.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonframe.storage import cut

BUCKETS = 1 << 12
PIECE = 1 << 18
SAMPLE = 2000
UNKNOWN = "und"

#: Families of languages by their codes; a code not listed is its own family.
FAMILIES = {
    "germanic": "de en nl sv da no nb nn is af lb yi fy fo",
    "romance": "fr es it pt ro ca gl oc la rm",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk ky uz tt tk ug",
    "semitic": "ar he mt am",
    "indic": "hi bn ur mr gu pa ne si or as sa",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv su mg",
}


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), lang)


@functools.lru_cache
def _letters() -> np.ndarray:
    """For every code point: 0 if it is no letter, else its lower-case letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _gram_buckets(points: np.ndarray) -> list[np.ndarray]:
    """Buckets of all n-grams of one to three symbols, where words are set apart by one blank."""
    x = _letters()[points].astype(np.uint64)
    x = np.concatenate([[0], x, [0]]).astype(np.uint64)
    x = x[(x != 0) | np.concatenate([[True], x[:-1] != 0])]
    out, total = [], np.zeros(len(x), np.uint64)
    for n in range(3):
        total = total[:len(x) - n] * np.uint64(0x9E3779B97F4A7C15) + x[n:] + np.uint64(1)
        spread = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((spread >> np.uint64(52)).astype(np.int64))
    return out


def features(text: str | None) -> np.ndarray | None:
    """Unit vector of square-rooted n-gram counts; None for null or a text with no letter."""
    if not text:
        return None
    counts, letters = np.zeros(BUCKETS), False
    for at in range(0, len(text), PIECE):  # bounded memory for very long texts
        points = np.frombuffer(text[max(0, at - 2):at + PIECE].encode("utf-32-le", "surrogatepass"),
                               np.uint32)
        letters = letters or bool(_letters()[points].any())
        for buckets in _gram_buckets(points):
            counts += np.bincount(buckets, minlength=BUCKETS)
    if not letters:
        return None
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


@dataclass(frozen=True)
class Model:
    """Weights of the family classifier and of the duels, as plain arrays."""
    families: tuple[tuple[str, ...], ...]
    family_weights: np.ndarray
    family_bias: np.ndarray
    duels: dict

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        logits = self.family_weights @ x + self.family_bias
        odds = np.exp(logits - logits.max())
        k = int(np.argmax(odds))
        langs, score = self.families[k], float(odds[k] / odds.sum())
        if len(langs) == 1:
            return langs[0], score
        wins, margins = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for (a, b), (w, bias) in self.duels.items():
            if a in margins and b in margins:
                margin = float(w @ x + bias)
                wins[a if margin < 0 else b] += 1
                margins[a] -= margin
                margins[b] += margin
        best = max(langs, key=lambda c: (wins[c], margins[c], c))
        closest = margins[best] / (len(langs) - 1)
        return best, score / (1 + float(np.exp(-np.clip(4 * closest, -30, 30))))


def _vector(text: str | None) -> SparseVector | None:
    x = features(text)
    if x is None:
        return None
    at = np.flatnonzero(x)
    return SparseVector(BUCKETS, at, x[at])


def train_model(labelled: DataFrame, text: str = "text", lang: str = "lang",
                sample: int = SAMPLE) -> Model | None:
    """Fit on about `sample` texts of each language (the bound that is documented: those whose
    seeded text hash is lowest, whatever their place or other columns). Rows with null language or
    without letters teach nothing; with no labelled row at all there is no model (None)."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    share = F.create_map(*itertools.chain.from_iterable(
        (F.lit(c), F.lit(min(1.0, sample / n))) for c, n in sorted(counts.items())))
    place = F.pmod(F.xxhash64(F.lit(17), "text"), F.lit(1 << 30)) / F.lit(1 << 30)
    to_vector = F.udf(_vector, VectorUDT())
    picked = cut(rows.where(place < share[F.col("lang")]).select(
        "lang", to_vector("text").alias("features"))).where("features IS NOT NULL")
    langs = sorted(r["lang"] for r in picked.select("lang").distinct().collect())
    if not langs:
        return None
    members: dict[str, list[str]] = {}
    for c in langs:
        members.setdefault(family_of(c), []).append(c)
    families = tuple(tuple(v) for v in members.values())

    def coded(groups) -> Column:
        return F.create_map(*itertools.chain.from_iterable(
            (F.lit(c), F.lit(float(k))) for k, g in enumerate(groups) for c in g))[F.col("lang")]

    weights, bias = np.zeros((1, BUCKETS)), np.zeros(1)
    if len(families) > 1:
        fitted = LogisticRegression(maxIter=60, regParam=1e-4, family="multinomial",
                                    standardization=False).fit(
            picked.withColumn("label", coded(families)))
        weights, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    duels = {}
    for family in families:
        for a, b in itertools.combinations(family, 2):
            fitted = LinearSVC(maxIter=60, regParam=1e-4, standardization=False).fit(
                picked.where(F.col("lang").isin(a, b)).withColumn("label", coded(([a], [b]))))
            duels[a, b] = (fitted.coefficients.toArray(), fitted.intercept)
    return Model(families, weights, bias, duels)


def predict_language(rows: DataFrame, model: Model | None, text: str = "text",
                     into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Rows with the language and a score from 0 to 1 appended, from the text alone. The other
    columns stay; those already named as `into` are replaced.

    `und` with score 0 for null texts, texts with no letter, and where there is no model.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few arrays of BUCKETS numbers
    schema = T.StructType([*(f for f in rows.schema if f.name not in into),
                           T.StructField(into[0], T.StringType()),
                           T.StructField(into[1], T.DoubleType())])
    kept = [f.name for f in schema][:-2]

    def run(batches):
        for batch in batches:
            out = []
            for value in batch.column(text):
                x = features(value.as_py()) if shared.value else None
                out.append((UNKNOWN, 0.0) if x is None else shared.value.predict(x))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([o[0] for o in out], pa.string()),
                 pa.array([o[1] for o in out], pa.float64())], [*kept, *into])
    return rows.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_report(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; the model has seen no held-out document."""
    model = train_model(documents.where(~held_out()).select("text", "lang"))
    rows = documents.select("doc_id", held_out().alias("held_out"), "text")
    return predict_language(rows, model).select("doc_id", "held_out", "lang_pred", "score")
