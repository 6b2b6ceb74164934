"""Crop and region code lookups as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CROP_IDS, CROP_NAMES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _literal_map(table: dict) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))


def crop_id(name: Column | str) -> Column:
    """Numeric crop id of a crop name in any case; 0 when unknown."""
    return F.coalesce(F.try_element_at(_literal_map(CROP_IDS), F.lower(_col(name))), F.lit(0))


def crop_name(number: Column | str) -> Column:
    """Canonical crop name of an id; 'NA' when unknown."""
    return F.coalesce(
        F.try_element_at(_literal_map(CROP_NAMES), _col(number).cast("int")), F.lit("NA")
    )


def country_of(region: Column | str) -> Column:
    return F.substring(_col(region), 1, 2)


def parent_region(region: Column | str, levels: int = 1) -> Column:
    """Code of the enclosing region: the code without its last `levels` characters."""
    return F.left(_col(region), F.length(_col(region)) - levels)
