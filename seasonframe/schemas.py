"""Fixed values of the data model: source columns, crop codes, file layout."""

from __future__ import annotations

from pyspark.sql import types as T

# Crop names accepted in the data, with their numeric ids.
CROP_IDS = {
    "grain maize": 2,
    "sugar beet": 6,
    "sugarbeet": 6,
    "sugarbeets": 6,
    "sugar beets": 6,
    "total potatoes": 7,
    "potatoes": 7,
    "potato": 7,
    "winter wheat": 90,
    "soft wheat": 90,
    "sunflower": 93,
    "spring barley": 95,
}

# Canonical crop name per id.
CROP_NAMES = {
    2: "grain maize",
    6: "sugarbeet",
    7: "potatoes",
    90: "soft wheat",
    93: "sunflower",
    95: "spring barley",
}

# Countries and region levels of the data set.
COUNTRIES = ("BG", "DE", "ES", "FR", "HU", "IT", "NL", "PL", "RO")
LEVELS = ("NUTS0", "NUTS1", "NUTS2", "NUTS3")

# Columns per source. "*" is the type of columns a file may carry beyond these.
_WEATHER = "IDREGION string, DATE string, TMAX double, TMIN double, TAVG double, VPRES double, " \
    "WSPD double, PREC double, ET0 double, RAD double, RELH double, IDCOVER int"
SOURCE_COLUMNS = {
    "WOFOST": "CROP_ID int, IDREGION string, DATE string, POT_YB double, WLIM_YB double, "
              "WLIM_YS double, DVS double, WLAI double, RSM double, TWC double, TWR double",
    "METEO": _WEATHER,
    "METEO_DAILY": _WEATHER,
    "REMOTE_SENSING": "IDREGION string, DATE string, FAPAR double, IDCOVER int",
    "SOIL": "IDREGION string, SM_FC double, SM_WP double",
    "CENTROIDS": "IDREGION string, CENTROID_X double, CENTROID_Y double",
    "AREA_FRACTIONS": "IDREGION string, FYEAR int, CROP_ID int, FRACTION double",
    "YIELD": "Crop string, IDREGION string, FYEAR int, YIELD double",
    "YIELD_PRED_MCYFS": "IDREGION string, CROP string, PREDICTION_DATE string, FYEAR int, "
                        "YIELD_PRED double",
}
OTHER_COLUMNS = {"CENTROIDS": "double", "YIELD": "double"}


def source_schema(source: str, header: list[str]) -> T.StructType:
    """Schema of a file of `source` with the given header, matched by column name.

    Columns the source does not define are read as strings, except the distance columns of
    CENTROIDS and the year columns of a wide YIELD file, which are numbers.
    """
    known = {name.lower(): kind for name, kind in _column_types(source)}
    other = OTHER_COLUMNS.get(source, "string")
    return T.StructType([
        T.StructField(name, _TYPES[known.get(name.lower(), _fallback(name, other))])
        for name in header
    ])


def source_columns(source: str) -> tuple[str, ...]:
    return tuple(name for name, _ in _column_types(source))


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType()}


def _column_types(source: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in SOURCE_COLUMNS[source].split(", ")]


def _fallback(name: str, other: str) -> str:
    return "string" if name.startswith("_c") else other
