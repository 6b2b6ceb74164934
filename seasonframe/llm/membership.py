"""A Bloom filter of fixed size, so that rows surely not among some keys need no shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 24  # 2 MB, whatever the number of keys
_PROBES = 2


def _places(key) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(FILTER_BITS)) for i in range(_PROBES)]


def may_be_among(keys: DataFrame, column: str):
    """A function from a key column to a condition that holds for every key in `column` of keys
    and for few others. More keys than the filter is made for let more others through."""
    filled = keys.select(F.explode(F.array(*_places(column))).alias("bit")).groupBy(
        F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits"))
    table = np.zeros(FILTER_BITS >> 6, np.int64)
    for r in filled.collect():  # a row a word of the filter at most
        table[r["word"]] = r["bits"]
    shared = keys.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    @F.pandas_udf("boolean")
    def held(*places: pd.Series) -> pd.Series:
        keep = np.ones(len(places[0]), bool)
        for place in places:
            at = place.to_numpy().astype(np.uint64)
            keep &= (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return pd.Series(keep)
    return lambda key: held(*_places(key))
