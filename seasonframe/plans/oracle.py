"""The same queries as plain SQL over the star-schema views, for cross-checking.

`VIEWS` are named building blocks; a query pulls in the ones it mentions, as common table
expressions. They restate the semantics independently: naive joins, lags and unnested windows.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def even(x: str, digits: int = 2) -> str:
    """Half-even rounding of a double through a 9-digit decimal."""
    return f"CAST(round_even(CAST({x} AS DECIMAL(28,9)), {digits}) AS DOUBLE)"


def grid(x: str, steps: int) -> str:
    return f"CAST(floor(({x}) * {steps}) / {steps} AS DOUBLE)"


def _date_text(day: str) -> str:
    return (f"CASE WHEN n_nationkey % 2 = 0 THEN strftime({day}, '%Y%m%d') "
            f"ELSE strftime({day}, '%d/%m/%Y') END")


def _parsed(text: str) -> str:
    return (f"CAST(CASE WHEN length({text}) = 8 THEN try_strptime({text}, '%Y%m%d') "
            f"ELSE try_strptime({text}, '%d/%m/%Y') END AS DATE)")


def _dekad(day: str) -> str:
    return f"CAST((month({day}) - 1) * 3 + least(ceil(day({day}) / 10.0), 3) AS INTEGER)"


def _int(x: str) -> str:
    return f"CAST({x} AS INTEGER)"


# --- domain tables --------------------------------------------------------------------------

VIEWS["v_regions"] = """
    SELECT n_nationkey, 'R' || n_regionkey || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS IDREGION
    FROM nation"""
VIEWS["v_shipments"] = """
    SELECT IDREGION, n_nationkey, CAST(l_shipdate AS DATE) AS d,
           CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
           CAST(round(l_discount * 100) AS BIGINT) AS disc, l_linenumber
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN v_regions ON s_nationkey = n_nationkey"""
VIEWS["v_weather"] = f"""
    SELECT IDREGION, {_date_text('d')} AS DATE, d,
           CAST(max(qty) AS DOUBLE) AS TMAX, CAST(min(qty) AS DOUBLE) AS TMIN,
           {grid('avg(qty)', 8)} AS TAVG, {grid('avg(qty) / 4', 16)} AS PREC,
           {grid('avg(disc)', 8)} AS ET0, {grid('avg(cents) / 800', 1)} AS RAD
    FROM v_shipments GROUP BY IDREGION, n_nationkey, d"""
VIEWS["v_growth_cells"] = f"""
    SELECT CASE WHEN l_linenumber <= 5 THEN 7 ELSE 6 END AS CROP_ID, IDREGION, n_nationkey,
           {_int('year(d)')} AS y, {_dekad('d')} AS dek, sum(qty) AS qty, count(*) AS n,
           avg(qty) AS aq, avg(disc) AS ad, max(qty) AS hi, min(qty) AS lo
    FROM v_shipments GROUP BY ALL"""
VIEWS["v_growth_all"] = f"""
    SELECT CROP_ID, IDREGION, y AS FYEAR, dek AS DEKAD,
           {_date_text("make_date(y, (dek - 1) // 3 + 1, (dek - 1) % 3 * 10 + 1)")} AS DATE,
           CAST(sum(hi) OVER w AS DOUBLE) AS POT_YB, CAST(sum(n) OVER w AS DOUBLE) AS WLIM_YB,
           CAST(sum(lo) OVER w AS DOUBLE) / 4 AS WLIM_YS,
           CAST(least(201, floor(CAST(sum(qty) OVER w * 250 AS DOUBLE) /
                CAST(sum(qty) OVER (PARTITION BY CROP_ID, IDREGION, y) AS DOUBLE))) AS DOUBLE) AS DVS,
           {grid('aq', 8)} AS WLAI, {grid('ad', 16)} AS RSM,
           CAST(hi AS DOUBLE) AS TWC, CAST(lo AS DOUBLE) AS TWR
    FROM v_growth_cells WINDOW w AS (PARTITION BY CROP_ID, IDREGION, y ORDER BY dek)"""
VIEWS["v_growth"] = "SELECT * EXCLUDE (CROP_ID) FROM v_growth_all WHERE CROP_ID = 7"
VIEWS["v_parent_greenness"] = f"""
    SELECT IDREGION, strftime(d, '%Y%m%d') AS DATE, d, {grid('avg(disc) / 16', 256)} AS FAPAR
    FROM (SELECT left(IDREGION, 2) AS IDREGION, disc,
                 CAST(date_trunc('month', d) AS DATE)
                   + CAST(least(floor((day(d) - 1) / 10.0), 2) * 10 AS INTEGER) AS d
          FROM v_shipments) GROUP BY IDREGION, d"""
VIEWS["v_greenness"] = """
    SELECT r.IDREGION, g.DATE, g.d, g.FAPAR FROM v_parent_greenness g
    JOIN v_regions r ON left(r.IDREGION, 2) = g.IDREGION"""
VIEWS["v_sales"] = """
    SELECT IDREGION, n_nationkey, CAST(o_orderdate AS DATE) AS d,
           CAST(round(o_totalprice * 100) AS BIGINT) AS cents
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN v_regions ON c_nationkey = n_nationkey"""
_YIELD = grid("avg(cents) / 400000", 128)
VIEWS["v_raw_yields"] = f"""
    SELECT CASE WHEN n_nationkey % 7 = 3 THEN 'Soybean' WHEN n_nationkey % 2 = 0 THEN 'Potatoes'
                ELSE 'Total potatoes' END AS Crop,
           IDREGION, {_int('year(d)')} AS FYEAR, {_YIELD} AS YIELD
    FROM v_sales GROUP BY IDREGION, n_nationkey, year(d)"""
VIEWS["v_yields"] = "SELECT IDREGION, FYEAR, YIELD FROM v_raw_yields"
VIEWS["v_national_yields"] = f"""
    SELECT left(IDREGION, 2) AS IDREGION, {_int('year(d)')} AS FYEAR, {_YIELD} AS YIELD
    FROM v_sales GROUP BY left(IDREGION, 2), year(d)"""
for _n in (4, 3):
    VIEWS[f"v_areas{_n}"] = f"""
    SELECT IDREGION, FYEAR, {grid(f'CAST(cents AS DOUBLE) / CAST(sum(cents) OVER (PARTITION BY left(IDREGION, {_n - 1}), FYEAR) AS DOUBLE)', 1024)} AS FRACTION
    FROM (SELECT left(IDREGION, {_n}) AS IDREGION, {_int('year(d)')} AS FYEAR, sum(cents) AS cents
          FROM v_sales GROUP BY ALL)"""
VIEWS["v_forecasts"] = f"""
    SELECT IDREGION, {_int('year(d)')} AS FYEAR, strftime(d, '%d/%m/%Y') AS PRED_DATE,
           YIELD_PRED, {_dekad('d')} AS PRED_DEKAD
    FROM (SELECT left(IDREGION, 2) AS IDREGION,
                 CAST(date_trunc('month', d) AS DATE) + 10 AS d, {_YIELD} AS YIELD_PRED
          FROM v_sales GROUP BY ALL)"""
VIEWS["v_soil"] = f"""
    SELECT IDREGION, {grid('max(cents) / 1000000', 128)} AS SM_FC,
           {grid('avg(cents) / 4000000', 128)} AS SM_WP
    FROM (SELECT c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer)
    JOIN v_regions ON c_nationkey = n_nationkey GROUP BY IDREGION"""
VIEWS["v_centroids"] = f"""
    SELECT IDREGION, {grid('avg(cents) / 10000', 1024)} AS CENTROID_X,
           {grid('avg(s_suppkey)', 1024)} AS CENTROID_Y
    FROM (SELECT s_nationkey, s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS cents FROM supplier)
    JOIN v_regions ON s_nationkey = n_nationkey GROUP BY IDREGION"""

# --- dates, codes, cleaning -----------------------------------------------------------------

VIEWS["v_raw_dates"] = """
    SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN '12345678'
        WHEN o_orderkey % 19 = 0 THEN '123-12-24'
        WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y%m%d')
        ELSE strftime(o_orderdate, '%d/%m/%Y') END AS DATE FROM orders"""
ORACLE["date_parts"] = f"""
    SELECT o_orderkey, DATE, {_int('year(p)')} AS FYEAR, {_int('month(p)')} AS MONTH,
           {_int('day(p)')} AS DAY, {_dekad('p')} AS DEKAD
    FROM (SELECT *, {_parsed('DATE')} AS p FROM v_raw_dates)"""
ORACLE["year_dekad"] = f"""
    SELECT IDREGION, {_int('year(p)')} AS FYEAR, {_dekad('p')} AS DEKAD, TMAX, TMIN, TAVG, PREC,
           ET0, RAD, 1 AS IDCOVER FROM (SELECT *, {_parsed('DATE')} AS p FROM v_weather)"""
ORACLE["crop_lookup"] = """
    SELECT Crop, IDREGION, FYEAR,
           CASE lower(Crop) WHEN 'potatoes' THEN 7 WHEN 'total potatoes' THEN 7 ELSE 0 END AS CROP_ID,
           CASE lower(Crop) WHEN 'potatoes' THEN 'potatoes' WHEN 'total potatoes' THEN 'potatoes'
                ELSE 'NA' END AS CROP_NAME FROM v_raw_yields"""
ORACLE["region_codes"] = """
    SELECT IDREGION, substring(IDREGION, 1, 2) AS COUNTRY,
           left(IDREGION, length(IDREGION) - 1) AS PARENT,
           left(IDREGION, length(IDREGION) - 2) AS GRAND, count(*) AS ORDERS
    FROM v_sales GROUP BY IDREGION"""
ORACLE["water_balance"] = f"""
    SELECT * EXCLUDE (d), {even('PREC - ET0')} AS CWB FROM v_weather"""
ORACLE["soil_capacity"] = f"SELECT IDREGION, {even('SM_FC - SM_WP')} AS SM_WHC FROM v_soil"
ORACLE["rounded_centroids"] = f"""
    SELECT IDREGION, {even('CENTROID_X')} AS CENTROID_X, {even('CENTROID_Y')} AS CENTROID_Y
    FROM v_centroids"""
ORACLE["crop_filter"] = "SELECT * EXCLUDE (FYEAR, DEKAD) FROM v_growth"
_CLEAN = "SELECT IDREGION, FYEAR, YIELD FROM v_raw_yields WHERE Crop <> 'Soybean' AND YIELD > 0"
ORACLE["clean_yield_long"] = _CLEAN
ORACLE["clean_yield_wide"] = _CLEAN
ORACLE["unpivoted_years"] = """
    SELECT k.Crop, k.IDREGION, CAST(y.FYEAR AS INTEGER) AS FYEAR, r.YIELD
    FROM (SELECT DISTINCT Crop, IDREGION FROM v_raw_yields) k
    CROSS JOIN (SELECT DISTINCT FYEAR FROM v_raw_yields) y
    LEFT JOIN v_raw_yields r
      ON r.Crop = k.Crop AND r.IDREGION = k.IDREGION AND r.FYEAR = y.FYEAR"""
ORACLE["empty_columns_dropped"] = "SELECT * FROM v_soil"
ORACLE["clean_forecast"] = "SELECT * FROM v_forecasts"
ORACLE["clean_area"] = "SELECT * FROM v_areas4"
ORACLE["parent_to_children"] = "SELECT IDREGION, DATE, FAPAR, 1 AS IDCOVER FROM v_greenness"

# --- season ---------------------------------------------------------------------------------

VIEWS["v_steps"] = """
    SELECT *, lag(DVS) OVER (PARTITION BY IDREGION, FYEAR ORDER BY DEKAD) AS P FROM v_growth"""
for _name, _zero in (("", "(P >= 200 AND DVS = 0)"), ("_crossing", "DVS = 0")):
    VIEWS[f"v_ends{_name}"] = f"""
    SELECT IDREGION, FYEAR, min(DEKAD) AS SEASON_END_DEKAD FROM v_steps
    WHERE (DVS >= 200 AND (P IS NULL OR DVS - P = 0)) OR {_zero} OR DEKAD = 36
    GROUP BY IDREGION, FYEAR"""
    VIEWS[f"v_season{_name}"] = f"""
    SELECT IDREGION, FYEAR, coalesce(lag(SEASON_END) OVER (PARTITION BY IDREGION ORDER BY FYEAR), 0)
             AS PREV_SEASON_END, SEASON_END,
           min(FYEAR) OVER (PARTITION BY IDREGION) AS FIRST_YEAR,
           max(FYEAR) OVER (PARTITION BY IDREGION) AS LAST_YEAR
    FROM (SELECT *, greatest(SEASON_END_DEKAD,
            lead(SEASON_END_DEKAD) OVER (PARTITION BY IDREGION ORDER BY FYEAR)) AS SEASON_END
          FROM v_ends{_name})"""


def _global_bounds(ends: str) -> str:
    return f"""
    SELECT IDREGION, FYEAR, CASE WHEN FYEAR = (SELECT min(FYEAR) FROM {ends}) THEN 0
             ELSE lag(SEASON_END) OVER (PARTITION BY IDREGION ORDER BY FYEAR) END AS PREV_SEASON_END,
           SEASON_END, (SELECT min(FYEAR) FROM {ends}) AS FIRST_YEAR,
           (SELECT max(FYEAR) FROM {ends}) AS LAST_YEAR
    FROM (SELECT *, CASE WHEN SEASON_END_DEKAD > N THEN SEASON_END_DEKAD ELSE N END AS SEASON_END
          FROM (SELECT *, CASE WHEN FYEAR = (SELECT max(FYEAR) FROM {ends}) THEN SEASON_END_DEKAD
                  ELSE lead(SEASON_END_DEKAD) OVER (PARTITION BY IDREGION ORDER BY FYEAR) END AS N
                FROM {ends}))"""


VIEWS["v_short_ends"] = """
    SELECT * FROM v_ends WHERE NOT (CAST(right(IDREGION, 1) AS INTEGER) % 2 = 1 AND FYEAR = 2001)"""
VIEWS["v_season_whole"] = _global_bounds("v_ends")
ORACLE["season_ends"] = "SELECT * FROM v_ends"
ORACLE["season_ends_crossing"] = "SELECT * FROM v_ends_crossing"
ORACLE["season_bounds"] = "SELECT * FROM v_season"
ORACLE["season_bounds_global"] = _global_bounds("v_short_ends")
ORACLE["season_bounds_global_whole"] = "SELECT * FROM v_season_whole"


def _aligned(source: str, season: str, columns: str, crosses: bool = False,
             whole: bool = False) -> str:
    """Rows of `source` (with FYEAR, DEKAD) on the campaign calendar; keeps SEASON_END."""
    part = "" if whole else "PARTITION BY IDREGION"
    return f"""
    SELECT * EXCLUDE (LO, HI), CAST(CASE
             WHEN CAMPAIGN_YEAR = LO THEN DEKAD + 36 - SEASON_END
             WHEN DEKAD > SEASON_END THEN DEKAD - SEASON_END
             ELSE DEKAD + 36 - PREV_SEASON_END END AS INTEGER) AS CAMPAIGN_DEKAD
    FROM (SELECT g.IDREGION, g.FYEAR, g.DEKAD, {columns}, SEASON_END, PREV_SEASON_END, LO, HI,
                 CAST(CASE WHEN g.DEKAD > SEASON_END THEN g.FYEAR + 1 ELSE g.FYEAR END AS INTEGER)
                   AS CAMPAIGN_YEAR
          FROM {source} g JOIN (SELECT *, min(FYEAR) OVER ({part}) AS LO,
                                       max(FYEAR) OVER ({part}) AS HI FROM {season}) s
            ON g.IDREGION = s.IDREGION AND g.FYEAR = s.FYEAR)
    WHERE CAMPAIGN_YEAR <= HI {'AND CAMPAIGN_YEAR > LO' if crosses else ''}"""


_INDICATORS = "POT_YB WLIM_YB WLIM_YS DVS WLAI RSM TWC TWR".split()
_GROWTH_COLUMNS = ", ".join(_INDICATORS)
_DROP_SEASON = "* EXCLUDE (SEASON_END, PREV_SEASON_END)"
VIEWS["v_growth_on_season"] = _aligned("v_growth", "v_season", _GROWTH_COLUMNS)
VIEWS["v_growth_ready"] = f"""
    SELECT IDREGION, FYEAR, DEKAD, CAMPAIGN_YEAR, CAMPAIGN_DEKAD, """ + ", ".join(
    f"CASE WHEN DEKAD < SEASON_END THEN {c} ELSE 0 END AS {c}" for c in _INDICATORS
) + " FROM v_growth_on_season"
_WEATHER = "TMAX TMIN TAVG PREC ET0 RAD CWB".split()
VIEWS["v_weather_days"] = f"""
    SELECT *, {_int('year(d)')} AS FYEAR, {_dekad('d')} AS DEKAD, {even('PREC - ET0')} AS CWB
    FROM v_weather"""
VIEWS["v_weather_on_season"] = _aligned("v_weather_days", "v_season", ", ".join(_WEATHER))
VIEWS["v_weather_ready"] = f"SELECT {_DROP_SEASON} FROM v_weather_on_season"
VIEWS["v_greenness_days"] = f"""
    SELECT *, {_int('year(d)')} AS FYEAR, {_dekad('d')} AS DEKAD FROM v_greenness"""
VIEWS["v_greenness_on_season"] = _aligned("v_greenness_days", "v_season", "FAPAR")
VIEWS["v_greenness_ready"] = f"SELECT {_DROP_SEASON} FROM v_greenness_on_season"
ORACLE["growth_aligned"] = f"SELECT {_DROP_SEASON} FROM v_growth_on_season"
ORACLE["growth_aligned_crossing"] = (
    f"SELECT {_DROP_SEASON} FROM ("
    + _aligned("v_growth", "v_season_crossing", _GROWTH_COLUMNS, crosses=True) + ")")
ORACLE["growth_aligned_global"] = (
    f"SELECT {_DROP_SEASON} FROM ("
    + _aligned("v_growth", "v_season_whole", _GROWTH_COLUMNS, whole=True) + ")")
ORACLE["growth_prepared"] = "SELECT * FROM v_growth_ready"
ORACLE["weather_prepared"] = "SELECT * FROM v_weather_ready"
ORACLE["remote_sensing_prepared"] = "SELECT * FROM v_greenness_ready"
ORACLE["weather_dekadal"] = f"""
    SELECT IDREGION, FYEAR, DEKAD, CAMPAIGN_YEAR, CAMPAIGN_DEKAD, max(TMAX) AS TMAX,
           min(TMIN) AS TMIN, {even('avg(TAVG)')} AS TAVG, {even('sum(PREC)')} AS PREC,
           {even('sum(ET0)')} AS ET0, {even('avg(RAD)')} AS RAD, {even('sum(CWB)')} AS CWB
    FROM v_weather_ready GROUP BY ALL"""
ORACLE["weather_dekadal_view"] = f"""
    SELECT IDREGION, CAMPAIGN_YEAR, CAMPAIGN_DEKAD, max(TMAX) AS TMAX, min(TMIN) AS TMIN,
           {even('sum(PREC)')} AS PREC, count(*) AS DAYS FROM v_weather_ready GROUP BY ALL"""

# --- calendar -------------------------------------------------------------------------------


def _calendar(source: str, early: int | None = None) -> str:
    extra = f", CALENDAR_END_SEASON + {early} AS CALENDAR_EARLY_SEASON" if early is not None else ""
    return f"""
    SELECT * EXCLUDE (S), CALENDAR_END_SEASON + S + {early or 0} AS CAMPAIGN_EARLY_SEASON {extra}
    FROM (SELECT IDREGION, CAMPAIGN_YEAR,
                 min(CAMPAIGN_DEKAD) FILTER (WHERE DVS > 0) AS START_DVS,
                 min(CAMPAIGN_DEKAD) FILTER (WHERE DVS >= 100) AS START_DVS1,
                 min(CAMPAIGN_DEKAD) FILTER (WHERE DVS >= 200) AS START_DVS2,
                 min(DEKAD) FILTER (WHERE DVS >= 200) + 1 AS CALENDAR_END_SEASON,
                 max(CAMPAIGN_DEKAD - DEKAD) FILTER (WHERE DVS >= 200) AS S
          FROM {source} GROUP BY IDREGION, CAMPAIGN_YEAR)
    WHERE START_DVS IS NOT NULL AND START_DVS1 IS NOT NULL AND START_DVS2 IS NOT NULL"""


_STAGES = ["START_DVS", "START_DVS1", "START_DVS2", "CAMPAIGN_EARLY_SEASON"]


def _country(calendar: str) -> str:
    return "SELECT left(IDREGION, 2) AS COUNTRY, " + ", ".join(
        f"{even(f'avg({s})', 0)} AS {s}" for s in _STAGES
    ) + f" FROM {calendar} GROUP BY left(IDREGION, 2)"


VIEWS["v_calendar"] = _calendar("v_growth_ready")
VIEWS["v_country"] = _country("v_calendar")
VIEWS["v_calendar_early12"] = _calendar("v_growth_ready", -12)
ORACLE["calendar_summary"] = "SELECT * FROM v_calendar"
ORACLE["calendar_summary_early"] = _calendar("v_growth_ready", -6)
ORACLE["country_calendar"] = "SELECT * FROM v_country"


def _ends_by(stop: str, start: str) -> str:
    """Inside start..stop, or start..early season when that comes first."""
    return (f"(CASE WHEN CAMPAIGN_EARLY_SEASON > {stop} "
            f"THEN CAMPAIGN_DEKAD >= {start} AND CAMPAIGN_DEKAD <= {stop} "
            f"ELSE CAMPAIGN_DEKAD >= {start} AND CAMPAIGN_DEKAD <= CAMPAIGN_EARLY_SEASON END)")


_SPANS = {
    "p0": ("START_DVS - 11", "START_DVS"),
    "p1": ("START_DVS - 1", "START_DVS + 1"),
    "p2": ("START_DVS", "START_DVS1"),
    "p3": ("START_DVS1 - 1", "START_DVS1 + 1"),
    "p4": ("START_DVS1", "START_DVS2"),
    "p5": ("START_DVS2 - 1", "START_DVS2 + 1"),
}
_IN = {p: _ends_by(f"({b})", f"({a})") for p, (a, b) in _SPANS.items()}
VIEWS["v_weather_phases"] = """
    SELECT w.*, c.* FROM v_weather_ready w JOIN v_country c ON left(w.IDREGION, 2) = c.COUNTRY"""
VIEWS["v_growth_phases"] = """
    SELECT w.*, c.* FROM v_growth_ready w JOIN v_country c ON left(w.IDREGION, 2) = c.COUNTRY"""
VIEWS["v_greenness_phases"] = """
    SELECT w.*, c.* FROM v_greenness_ready w JOIN v_country c ON left(w.IDREGION, 2) = c.COUNTRY"""
ORACLE["period_days"] = "SELECT IDREGION, CAMPAIGN_YEAR, " + ", ".join(
    f"count(*) FILTER (WHERE {c}) AS {p}" for p, c in _IN.items()
) + " FROM v_weather_phases GROUP BY IDREGION, CAMPAIGN_YEAR"
_TEXT = ["pre-planting window", "planting window", "vegetative phase", "flowering phase",
         "yield formation phase", "harvest window"]


def _report(calendar: str, early: bool) -> str:
    means = ", ".join(f"{even(f'avg({s})', 0)} AS {s}" for s in _STAGES)
    rows = " UNION ALL ".join(
        f"SELECT '{p}' AS PERIOD, '{t}' AS DESCRIPTION, "
        + (f"greatest(1.0::DOUBLE, {a})" if p == "p0" else a) + " AS START, "
        + (f"least({b}, CAMPAIGN_EARLY_SEASON)" if early else b) + " AS STOP FROM m"
        for (p, (a, b)), t in zip(_SPANS.items(), _TEXT))
    return f"SELECT * FROM (WITH m AS (SELECT {means} FROM {calendar}) {rows}) WHERE STOP > START"


ORACLE["calendar_report"] = _report("v_calendar", False)
ORACLE["calendar_report_early"] = _report("v_calendar_early12", True)

# --- summaries ------------------------------------------------------------------------------


def _summary(source: str, lows, highs, means) -> str:
    cols = [f'min({c}) AS "min({c})"' for c in lows] + [f'max({c}) AS "max({c})"' for c in highs] \
        + [f'{even(f"avg({c})")} AS "avg({c})"' for c in means]
    return f"SELECT IDREGION, {', '.join(cols)} FROM {source} GROUP BY IDREGION"


ORACLE["growth_summary"] = _summary(
    "v_growth_ready", ["RSM"], "WLIM_YB WLIM_YS DVS WLAI RSM TWC TWR".split(),
    "WLAI RSM TWC TWR".split())
_ALL = "TMAX TMIN TAVG PREC ET0 CWB RAD".split()
ORACLE["weather_summary"] = _summary("v_weather_ready", _ALL, _ALL, _ALL)
ORACLE["remote_sensing_summary"] = _summary(
    "v_greenness_ready", ["FAPAR"], ["FAPAR"], ["FAPAR"])
ORACLE["yield_summary"] = _summary("v_yields", ["YIELD"], ["YIELD"], ["YIELD"])
ORACLE["year_range"] = "SELECT min(FYEAR) AS MIN_YEAR, max(FYEAR) AS MAX_YEAR FROM v_season"
ORACLE["distinct_regions"] = "SELECT DISTINCT IDREGION, CAMPAIGN_YEAR FROM v_growth_ready"

# --- features -------------------------------------------------------------------------------

_GROWTH_SPEC = (
    {"p2": ["WLIM_YB", "TWC", "WLAI"], "p4": ["WLIM_YB", "WLIM_YS", "TWC", "WLAI"]},
    {"p2": ["RSM"], "p4": ["RSM"]},
    {"p1": ["RSM"], "p2": ["RSM"], "p3": ["RSM"], "p4": ["RSM"]},
)
_WEATHER_SPEC = (
    {},
    {"p0": ["TAVG", "PREC", "CWB"], "p1": ["TAVG", "PREC"], "p2": ["TAVG", "CWB"],
     "p3": ["PREC"], "p4": ["CWB"], "p5": ["PREC"]},
    {"p1": ["TMIN", "PREC"], "p3": ["PREC", "TMAX"], "p5": ["PREC"]},
)
_GREEN_SPEC = ({}, {"p2": ["FAPAR"], "p4": ["FAPAR"]}, {})


def _each(part):
    return [(p, x) for p, xs in part.items() for x in xs]


def _aggregate_columns(spec, fill: bool) -> list[str]:
    maxima, averages, _ = spec
    wrap = "coalesce({}, 0.0::DOUBLE)" if fill else "{}"
    high = "max({}) FILTER (WHERE {})"
    mean = "avg({}) FILTER (WHERE {})"
    return [f"{wrap.format(even(high.format(x, _IN[p])))} AS max{x}{p}"
            for p, x in _each(maxima)] \
        + [f"{wrap.format(even(mean.format(x, _IN[p])))} AS avg{x}{p}"
           for p, x in _each(averages)]


def _stats(source: str, spec, where: str = "true") -> str:
    cols = []
    for p, x in _each(spec[2]):
        cols += [f"{even(f'avg({x}) FILTER (WHERE {_IN[p]})')} AS avg{x}{p}",
                 f"{even(f'stddev_samp({x}) FILTER (WHERE {_IN[p]})')} AS std{x}{p}"]
    return f"SELECT COUNTRY, {', '.join(cols)} FROM {source} WHERE {where} GROUP BY COUNTRY"


def _count_columns(spec) -> list[str]:
    cols = []
    for p, x in _each(spec[2]):
        for i in (1, 2):
            cols += [
                f"count(*) FILTER (WHERE {_IN[p]} AND {x} > s.avg{x}{p} + {i} * s.std{x}{p}) "
                f"AS {x}{p}gt{i}STD",
                f"count(*) FILTER (WHERE {_IN[p]} AND {x} < s.avg{x}{p} - {i} * s.std{x}{p}) "
                f"AS {x}{p}lt{i}STD"]
    return cols


def _features(source: str, spec, stats: str | None, keys="IDREGION, CAMPAIGN_YEAR",
              counts_only: bool = False) -> str:
    cols = [] if counts_only else _aggregate_columns(spec, fill=bool(stats))
    if not stats:
        return f"SELECT {keys}, {', '.join(cols)} FROM {source} GROUP BY {keys}"
    cols += _count_columns(spec)
    return (f"SELECT {keys}, {', '.join(cols)} FROM (SELECT * FROM {source}) t "
            f"JOIN {stats} s USING (COUNTRY) GROUP BY {keys}")


VIEWS["v_weather_stats"] = _stats("v_weather_phases", _WEATHER_SPEC)
ORACLE["growth_period_aggregates"] = _features("v_growth_phases", _GROWTH_SPEC, None)
ORACLE["weather_longterm_stats"] = "SELECT * FROM v_weather_stats"
ORACLE["weather_extreme_counts"] = _features(
    "v_weather_phases", _WEATHER_SPEC, "v_weather_stats", counts_only=True)
VIEWS["v_weather_features"] = _features("v_weather_phases", _WEATHER_SPEC, "v_weather_stats")
ORACLE["weather_features"] = "SELECT * FROM v_weather_features"
VIEWS["v_greenness_features"] = _features("v_greenness_phases", _GREEN_SPEC, None)
ORACLE["remote_sensing_features"] = "SELECT * FROM v_greenness_features"

# test years: every third of the sorted years, or the last floor(0.3 n)
VIEWS["v_spaced_years"] = """
    SELECT FYEAR FROM (SELECT FYEAR, row_number() OVER (ORDER BY FYEAR) AS r
                       FROM (SELECT DISTINCT FYEAR FROM v_yields)) WHERE r % 3 = 0"""
VIEWS["v_last_years"] = """
    SELECT FYEAR FROM (SELECT FYEAR, row_number() OVER (ORDER BY FYEAR) AS r, count(*) OVER () AS n
                       FROM (SELECT DISTINCT FYEAR FROM v_yields)) WHERE r > n - floor(n * 0.3::DOUBLE)"""


def _split(source: str, year: str = "FYEAR", years: str = "v_spaced_years") -> str:
    return (f"SELECT *, CASE WHEN {year} IN (SELECT FYEAR FROM {years}) THEN 'test' "
            f"ELSE 'train' END AS SPLIT FROM {source}")


VIEWS["v_split_yields"] = _split("v_yields")
VIEWS["v_split_growth"] = _split("v_growth_ready", "CAMPAIGN_YEAR")
VIEWS["v_train_growth"] = "SELECT * FROM v_split_growth WHERE SPLIT = 'train'"
VIEWS["v_train_calendar"] = _calendar("v_train_growth")
VIEWS["v_train_country"] = _country("v_train_calendar")
VIEWS["v_split_growth_phases"] = """
    SELECT w.*, c.* FROM v_split_growth w JOIN v_train_country c ON left(w.IDREGION, 2) = c.COUNTRY"""
VIEWS["v_train_growth_stats"] = _stats("v_split_growth_phases", _GROWTH_SPEC, "SPLIT = 'train'")
ORACLE["split_growth_features"] = (
    "SELECT CAMPAIGN_YEAR AS FYEAR, * EXCLUDE (CAMPAIGN_YEAR) FROM ("
    + _features("v_split_growth_phases", _GROWTH_SPEC, "v_train_growth_stats",
                "IDREGION, CAMPAIGN_YEAR, SPLIT") + ")")
ORACLE["recent_campaigns"] = """
    SELECT IDREGION, CAMPAIGN_YEAR, SPLIT, count(*) AS N FROM v_split_growth
    WHERE SPLIT = 'test' OR CAMPAIGN_YEAR >= (
        SELECT min(FYEAR) FROM v_split_yields WHERE SPLIT = 'train' AND FYEAR >= 1997)
    GROUP BY ALL"""
_USAGE = [c.rsplit(" AS ", 1)[1] for c in _aggregate_columns(_WEATHER_SPEC, True)] + [
    c.rsplit(" AS ", 1)[1] for c in _count_columns(_WEATHER_SPEC)]
ORACLE["feature_column_usage"] = "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {c} <> 0) AS {c}_nonzero, "
    f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_null" for c in _USAGE
) + " FROM v_weather_features"
ORACLE["zero_features_dropped"] = _split(
    "(SELECT CAMPAIGN_YEAR AS FYEAR, * EXCLUDE (CAMPAIGN_YEAR) FROM v_greenness_features)")

# the flagship: last years are the test years
for _s in ("growth", "weather", "greenness"):
    VIEWS[f"v_late_{_s}"] = _split(f"v_{_s}_ready", "CAMPAIGN_YEAR", "v_last_years")
VIEWS["v_late_train_growth"] = "SELECT * FROM v_late_growth WHERE SPLIT = 'train'"
VIEWS["v_late_calendar"] = _calendar("v_late_train_growth")
VIEWS["v_late_country"] = _country("v_late_calendar")
for _s, _spec in (("growth", _GROWTH_SPEC), ("weather", _WEATHER_SPEC), ("greenness", _GREEN_SPEC)):
    VIEWS[f"v_late_{_s}_phases"] = f"""
    SELECT w.*, c.* FROM v_late_{_s} w JOIN v_late_country c ON left(w.IDREGION, 2) = c.COUNTRY
    WHERE {'' if _s == 'greenness' else "SPLIT = 'test' OR"} CAMPAIGN_YEAR >= (
        SELECT min(FYEAR) FROM v_yields WHERE FYEAR NOT IN (SELECT FYEAR FROM v_last_years))"""
    if _spec[2]:
        VIEWS[f"v_late_{_s}_stats"] = _stats(f"v_late_{_s}_phases", _spec, "SPLIT = 'train'")
    VIEWS[f"v_late_{_s}_features"] = (
        "SELECT CAMPAIGN_YEAR AS FYEAR, * EXCLUDE (CAMPAIGN_YEAR) FROM ("
        + _features(f"v_late_{_s}_phases", _spec, f"v_late_{_s}_stats" if _spec[2] else None,
                    "IDREGION, CAMPAIGN_YEAR, SPLIT") + ")")
VIEWS["v_late_yields"] = _split("v_yields", "FYEAR", "v_last_years")

# --- trend ----------------------------------------------------------------------------------


def _lags(window: int, source: str = "v_yields") -> str:
    steps = range(window, 0, -1)
    over = "OVER (PARTITION BY IDREGION ORDER BY FYEAR)"
    cols = [f'lag(FYEAR, {i}) {over} AS "YEAR-{i}"' for i in steps] + [
        f'lag(YIELD, {i}) {over} AS "YIELD-{i}"' for i in steps]
    return (f"SELECT * FROM (SELECT IDREGION, FYEAR, {', '.join(cols)} FROM {source}) "
            f'WHERE "YIELD-{window}" IS NOT NULL')


def _points(window: int, source: str = "v_yields") -> str:
    """Each row's previous `window` points: (IDREGION, FYEAR, i, x, y), i = 1 the latest."""
    return " UNION ALL ".join(
        f'SELECT IDREGION, FYEAR, {i} AS i, "YEAR-{i}" AS x, "YIELD-{i}" AS y '
        f"FROM ({_lags(window, source)})" for i in range(1, window + 1))


def _line(window: int, source: str = "v_yields") -> str:
    fit = "regr_intercept(y, x - 2000) + regr_slope(y, x - 2000) * (FYEAR - 2000)"
    return (f"SELECT IDREGION, FYEAR, {even(fit)} AS YIELD_TREND "
            f"FROM ({_points(window, source)}) GROUP BY IDREGION, FYEAR")


def _left_out(window: int, source: str = "v_yields") -> str:
    fit = "regr_intercept(b.y, b.x - 2000) + regr_slope(b.y, b.x - 2000) * (a.x - 2000)"
    return (f"SELECT a.IDREGION, a.FYEAR, a.i AS ITERATION, a.x AS YEAR, a.y AS YTRUE, "
            f"{even(fit)} AS YPRED FROM ({_points(window, source)}) a "
            f"JOIN ({_points(window, source)}) b ON a.IDREGION = b.IDREGION AND a.FYEAR = b.FYEAR "
            f"AND a.i <> b.i GROUP BY a.IDREGION, a.FYEAR, a.i, a.x, a.y")


def _errors(window: int, source: str = "v_yields") -> str:
    return (f"SELECT IDREGION, FYEAR, {even('sqrt(avg((YTRUE - YPRED) ** 2))')} AS RMSE "
            f"FROM ({_left_out(window, source)}) GROUP BY IDREGION, FYEAR")


def _optimal(source: str = "v_yields", windows=(3, 4, 5)) -> str:
    scored = " UNION ALL ".join(
        f"SELECT t.IDREGION, t.FYEAR, {w} AS OPT_TW, {i} AS o, YIELD_TREND, RMSE "
        f"FROM ({_line(w, source)}) t JOIN ({_errors(w, source)}) e "
        f"ON t.IDREGION = e.IDREGION AND t.FYEAR = e.FYEAR" for i, w in enumerate(windows))
    return (f"SELECT IDREGION, FYEAR, OPT_TW, YIELD_TREND FROM ({scored}) QUALIFY "
            f"row_number() OVER (PARTITION BY IDREGION, FYEAR ORDER BY RMSE, o) = 1")


def _fixed(window: int, source: str = "v_yields") -> str:
    return (f"SELECT a.*, YIELD_TREND FROM ({_lags(window, source)}) a "
            f"JOIN ({_line(window, source)}) b "
            f"ON a.IDREGION = b.IDREGION AND a.FYEAR = b.FYEAR")


VIEWS["v_optimal"] = _optimal()
ORACLE["previous_yields"] = _lags(3)
VIEWS["v_fixed3"] = _fixed(3)
ORACLE["fixed_window_trend"] = "SELECT * FROM v_fixed3"
ORACLE["fixed_window_point"] = f"""
    SELECT f.* EXCLUDE (YIELD_TREND), YIELD_TREND AS PREDICTED, YIELD AS ACTUAL
    FROM ({_fixed(4)}) f JOIN v_yields y ON f.IDREGION = y.IDREGION AND f.FYEAR = y.FYEAR
    WHERE f.IDREGION = 'R101' AND f.FYEAR = 2000"""
ORACLE["leave_one_out"] = _left_out(4)
ORACLE["leave_one_out_error"] = f"""
    SELECT t.IDREGION, t.FYEAR, YIELD_TREND AS YIELD_TREND4, RMSE AS CV_RMSE4
    FROM ({_line(4)}) t JOIN ({_errors(4)}) e ON t.IDREGION = e.IDREGION AND t.FYEAR = e.FYEAR"""
ORACLE["optimal_window"] = "SELECT * FROM v_optimal"
ORACLE["optimal_window_point"] = """
    SELECT o.IDREGION, o.FYEAR, OPT_TW, YIELD_TREND AS PREDICTED, YIELD AS ACTUAL
    FROM v_optimal o JOIN v_yields y ON o.IDREGION = y.IDREGION AND o.FYEAR = y.FYEAR
    WHERE o.IDREGION = 'R101' AND o.FYEAR = 2001"""


def _optimal_features(source: str = "v_yields") -> str:
    return (f"SELECT a.*, YIELD_TREND FROM ({_lags(3, source)}) a JOIN ({_optimal(source)}) b "
            f"ON a.IDREGION = b.IDREGION AND a.FYEAR = b.FYEAR")


ORACLE["optimal_trend_features"] = _optimal_features()
VIEWS["v_spaced_train"] = "SELECT * FROM v_split_yields WHERE SPLIT = 'train'"
VIEWS["v_late_train"] = "SELECT * FROM v_late_yields WHERE SPLIT = 'train'"
_NO_YEARS = '* EXCLUDE ("YEAR-1", "YEAR-2", "YEAR-3")'


def _split_trend(train: str, whole: str, years: str) -> str:
    return (f"SELECT {_NO_YEARS}, 'train' AS SPLIT FROM ({train}) UNION ALL "
            f"SELECT {_NO_YEARS}, 'test' AS SPLIT FROM ({whole}) "
            f"WHERE FYEAR IN (SELECT FYEAR FROM {years})")


ORACLE["split_trend_features"] = _split_trend(_fixed(3, "v_spaced_train"), _fixed(3),
                                              "v_spaced_years")
ORACLE["split_trend_features_optimal"] = _split_trend(
    _optimal_features("v_late_train"), _optimal_features(), "v_last_years")
ORACLE["trend_rounds"] = """
    SELECT IDREGION, CAST(row_number() OVER w - 1 AS INTEGER) AS ROUND, FYEAR AS TEST_YEAR,
           lead(FYEAR, 4) OVER w AS START_YEAR, lead(FYEAR, 1) OVER w AS END_YEAR
    FROM (SELECT DISTINCT IDREGION, FYEAR FROM v_yields)
    WINDOW w AS (PARTITION BY IDREGION ORDER BY FYEAR DESC)
    QUALIFY lead(FYEAR, 4) OVER w IS NOT NULL"""
VIEWS["v_late_trend"] = _split_trend(_fixed(3, "v_late_train"), "SELECT * FROM v_fixed3",
                                     "v_last_years")
_KEYS3 = "(IDREGION, FYEAR, SPLIT)"
ORACLE["season_features"] = f"""
    SELECT g.IDREGION, g.FYEAR, g.SPLIT, {even('SM_FC - SM_WP')} AS SM_WHC,
           {even('CENTROID_X')} AS CENTROID_X, {even('CENTROID_Y')} AS CENTROID_Y,
           * EXCLUDE (IDREGION, FYEAR, SPLIT, SM_FC, SM_WP, CENTROID_X, CENTROID_Y)
    FROM v_late_growth_features g JOIN v_late_weather_features USING {_KEYS3}
    JOIN v_late_greenness_features USING {_KEYS3} JOIN v_late_trend USING {_KEYS3}
    JOIN v_late_yields USING {_KEYS3} JOIN v_soil USING (IDREGION)
    JOIN v_centroids USING (IDREGION)"""

# --- splits ---------------------------------------------------------------------------------

ORACLE["test_years_last"] = "SELECT FYEAR FROM v_last_years"
ORACLE["test_years_spaced"] = "SELECT FYEAR FROM v_spaced_years"
ORACLE["split_yields"] = "SELECT * FROM v_split_yields"
ORACLE["split_test_side"] = """
    SELECT IDREGION, FYEAR, YIELD FROM v_yields SEMI JOIN v_spaced_years USING (FYEAR)"""
ORACLE["sliding_folds"] = """
    WITH y AS (SELECT FYEAR, row_number() OVER (ORDER BY FYEAR) - 1 AS p, count(*) OVER () AS n
               FROM (SELECT DISTINCT FYEAR FROM v_yields))
    SELECT CAST(f AS INTEGER) AS FOLD, CASE WHEN p < f + n - 4 THEN 'train' ELSE 'test' END AS ROLE,
           FYEAR
    FROM y, range(4) t(f) WHERE p >= f AND p <= f + n - 4"""
ORACLE["contiguous_folds"] = """
    SELECT *, CAST(ntile(5) OVER (ORDER BY IDREGION, FYEAR) - 1 AS INTEGER) AS FOLD FROM v_yields"""

VIEWS["v_lagged_crops"] = """
    SELECT Crop AS CROP, left(IDREGION, 2) AS COUNTRY, IDREGION, FYEAR, YIELD,
           lag(YIELD) OVER w AS x1, lag(YIELD, 2) OVER w AS x2
    FROM v_raw_yields WINDOW w AS (PARTITION BY IDREGION ORDER BY FYEAR)"""
VIEWS["v_crop_folds"] = """
    SELECT *, ntile(5) OVER (PARTITION BY CROP, COUNTRY ORDER BY IDREGION, FYEAR) - 1 AS fold
    FROM v_lagged_crops WHERE x1 IS NOT NULL AND x2 IS NOT NULL"""
VIEWS["v_crop_sums"] = """
    SELECT k.CROP, k.COUNTRY, j, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(YIELD) AS my,
           CASE WHEN stddev_pop(x1) < 1e-12 THEN 1 ELSE stddev_pop(x1) END AS s1,
           CASE WHEN stddev_pop(x2) < 1e-12 THEN 1 ELSE stddev_pop(x2) END AS s2,
           var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS c12,
           covar_pop(x1, YIELD) AS c1, covar_pop(x2, YIELD) AS c2
    FROM (SELECT DISTINCT CROP, COUNTRY, fold AS j FROM v_crop_folds
          UNION SELECT DISTINCT CROP, COUNTRY, -1 FROM v_crop_folds) k
    JOIN v_crop_folds f ON f.CROP = k.CROP AND f.COUNTRY = k.COUNTRY AND fold <> j
    GROUP BY k.CROP, k.COUNTRY, j"""
VIEWS["v_crop_lines"] = """
    SELECT *, my - w1 * m1 - w2 * m2 AS w0
    FROM (SELECT *, (a22 * n * c1 / s1 - a12 * n * c2 / s2) / (a11 * a22 - a12 * a12) / s1 AS w1,
                 (a11 * n * c2 / s2 - a12 * n * c1 / s1) / (a11 * a22 - a12 * a12) / s2 AS w2
          FROM (SELECT *, n * v1 / s1 / s1 + alpha AS a11, n * v2 / s2 / s2 + alpha AS a22,
                       n * c12 / s1 / s2 AS a12
                FROM v_crop_sums, (VALUES (0.001::DOUBLE), (0.01), (0.1), (1), (10)) t(alpha)))"""
VIEWS["v_crop_best"] = """
    SELECT CROP, COUNTRY, arg_min(alpha, (error, alpha)) AS alpha
    FROM (SELECT CROP, COUNTRY, alpha, avg(error) AS error
          FROM (SELECT l.CROP, l.COUNTRY, j, alpha, avg((YIELD - w0 - w1 * x1 - w2 * x2) ** 2) AS error
                FROM v_crop_lines l JOIN v_crop_folds f
                  ON f.CROP = l.CROP AND f.COUNTRY = l.COUNTRY AND fold = j GROUP BY ALL)
          GROUP BY ALL)
    GROUP BY CROP, COUNTRY"""
ORACLE["experiment_ridge"] = """
    SELECT f.CROP, f.COUNTRY, IDREGION, FYEAR, l.alpha AS ALPHA, YIELD,
           round(w0 + w1 * x1 + w2 * x2, 6) AS YIELD_PRED
    FROM v_crop_folds f JOIN v_crop_best b ON b.CROP = f.CROP AND b.COUNTRY = f.COUNTRY
    JOIN v_crop_lines l ON l.CROP = f.CROP AND l.COUNTRY = f.COUNTRY AND l.alpha = b.alpha AND j = -1"""

# --- predictions, scores, roll-up -----------------------------------------------------------

VIEWS["v_predictions"] = f"""
    SELECT IDREGION, FYEAR, SPLIT, YIELD, ALG, YIELD_PRED
    FROM (SELECT f.IDREGION, f.FYEAR, SPLIT, YIELD, YIELD_TREND AS line, "YIELD-1" AS last
          FROM v_fixed3 f JOIN v_split_yields y ON f.IDREGION = y.IDREGION AND f.FYEAR = y.FYEAR)
    UNPIVOT (YIELD_PRED FOR ALG IN (line, last))"""
ORACLE["prediction_rows"] = "SELECT * FROM v_predictions"
VIEWS["v_wide_predictions"] = """
    SELECT IDREGION, FYEAR, YIELD,
           max(YIELD_PRED) FILTER (WHERE ALG = 'line') AS YIELD_PRED_line,
           max(YIELD_PRED) FILTER (WHERE ALG = 'last') AS YIELD_PRED_last
    FROM v_predictions GROUP BY ALL"""
ORACLE["prediction_columns"] = "SELECT * FROM v_wide_predictions"
_E = "(YIELD - YIELD_PRED)"
_SCORE = {
    "NMAE": f"100 * avg(abs({_E})) / avg(YIELD)",
    "MAPE": f"100 * avg(abs({_E} / YIELD))",
    "NRMSE": f"100 * sqrt(avg({_E} ** 2)) / avg(YIELD)",
    "R2": f"1 - sum({_E} ** 2) / (var_pop(YIELD) * count(*))",
    "NSE": f"1 - sum({_E} ** 2) / (var_pop(YIELD) * count(*))",
    "EXP_VAR": f"1 - var_pop({_E}) / var_pop(YIELD)",
    "NMdAE": f"100 * median(abs({_E})) / avg(YIELD)",
}


def _scores(source: str, by: str, metrics=tuple(_SCORE)[:4], prefix: str = "") -> str:
    return f"SELECT {by}, " + ", ".join(
        f"{even(_SCORE[m])} AS {prefix}{m}" for m in metrics) + f" FROM {source} GROUP BY {by}"


ORACLE["prediction_scores"] = _scores("v_predictions", "ALG, SPLIT", tuple(_SCORE))
VIEWS["v_scores"] = _scores("v_predictions", "ALG, SPLIT")
ORACLE["prediction_score_table"] = "SELECT ALG, " + ", ".join(
    f"max({m}) FILTER (WHERE SPLIT = '{s}') AS {s}_{m}"
    for m in tuple(_SCORE)[:4] for s in ("train", "test")) + " FROM v_scores GROUP BY ALG"
ORACLE["median_order_value"] = """
    SELECT IDREGION, CAST(median(cents) AS DOUBLE) AS MEDIAN FROM v_sales GROUP BY IDREGION"""
ORACLE["null_stats"] = "SELECT " + ", ".join(
    f"{even(e)} AS {n}" for n, e in (
        ("MIN", "min(YIELD)"), ("MAX", "max(YIELD)"), ("MEAN", "avg(YIELD)"),
        ("MEDIAN", "median(YIELD)"))) + " FROM v_spaced_train"
ORACLE["null_average"] = f"""
    SELECT IDREGION, FYEAR, SPLIT, 'average' AS ALG,
           (SELECT {even('avg(YIELD)')} FROM v_spaced_train) AS YIELD_PRED, YIELD
    FROM v_split_yields"""
ORACLE["null_trend"] = """
    SELECT f.IDREGION, f.FYEAR, SPLIT, 'trend' AS ALG, YIELD_TREND AS YIELD_PRED, YIELD
    FROM v_fixed3 f JOIN v_split_yields y ON f.IDREGION = y.IDREGION AND f.FYEAR = y.FYEAR"""
ORACLE["restored_trend"] = """
    SELECT IDREGION, FYEAR, YIELD, YIELD_PRED_line, YIELD_PRED_line AS YIELD_TREND,
           round(YIELD_PRED_last, 6) AS YIELD_PRED_last,
           round(YIELD_PRED_last - YIELD_PRED_line, 6) AS YIELD_RES_PRED_last
    FROM v_wide_predictions"""
VIEWS["v_gappy"] = """
    SELECT IDREGION, FYEAR, ALG, CASE WHEN FYEAR = 1999 OR IDREGION = 'R207' THEN NULL
           ELSE YIELD_PRED END AS YIELD_PRED FROM v_predictions"""


def _filled(areas: str, predictions: str) -> str:
    return f"""
    SELECT IDREGION, FYEAR, ALG, CASE WHEN m IS NULL THEN 0.0::DOUBLE ELSE FRACTION END AS FRACTION,
           coalesce(YIELD_PRED, m, 0.0::DOUBLE) AS YIELD_PRED,
           left(IDREGION, length(IDREGION) - 1) AS IDREG_PARENT
    FROM (SELECT IDREGION, FYEAR, FRACTION, ALG, YIELD_PRED,
                 avg(YIELD_PRED) OVER (PARTITION BY ALG, IDREGION) AS m
          FROM {areas} JOIN {predictions} USING (IDREGION, FYEAR))"""


def _rolled(filled: str) -> str:
    return f"""
    SELECT IDREG_PARENT AS IDREGION, FYEAR, ALG,
           coalesce(sum(YIELD_PRED * nullif(f, 'nan'::DOUBLE)), 0.0::DOUBLE) AS YIELD_PRED
    FROM (SELECT *, FRACTION / nullif(sum(FRACTION) OVER (
             PARTITION BY ALG, IDREG_PARENT, FYEAR), 0) AS f FROM {filled})
    GROUP BY ALL"""


VIEWS["v_filled4"] = _filled("v_areas4", "v_gappy")
VIEWS["v_level3"] = _rolled("v_filled4")
VIEWS["v_filled3"] = _filled("v_areas3", "v_level3")
VIEWS["v_level2"] = _rolled("v_filled3")
ORACLE["missing_filled"] = """
    SELECT IDREGION, FYEAR, ALG, FRACTION, round(YIELD_PRED, 6) AS YIELD_PRED FROM v_filled4"""
ORACLE["fractions_renormalised"] = """
    SELECT IDREGION, IDREG_PARENT, FYEAR, ALG, round(FRACTION / nullif(sum(FRACTION) OVER (
        PARTITION BY ALG, IDREG_PARENT, FYEAR), 0), 9) AS FRACTION FROM v_filled4"""
ORACLE["national_rollup"] = """
    SELECT IDREGION, FYEAR, ALG, round(YIELD_PRED, 6) AS YIELD_PRED FROM v_level2"""
VIEWS["v_calendar_early6"] = _calendar("v_growth_ready", -6)
ORACLE["season_mean"] = f"""
    SELECT CAMPAIGN_YEAR AS FYEAR, {even('avg(CALENDAR_END_SEASON)', 0)} AS END_SEASON,
           {even('avg(CALENDAR_EARLY_SEASON)', 0)} AS EARLY_SEASON
    FROM v_calendar_early6 GROUP BY CAMPAIGN_YEAR"""
VIEWS["v_targets"] = f"""
    SELECT left(IDREGION, 2) AS IDREGION, CAMPAIGN_YEAR AS FYEAR,
           {even('avg(CALENDAR_END_SEASON)', 0)} AS TARGET_DEKAD
    FROM v_calendar GROUP BY ALL"""
VIEWS["v_asof"] = f"""
    SELECT IDREGION, FYEAR, TARGET_DEKAD, PRED_DEKAD, YIELD_PRED AS YIELD_PRED_MCYFS
    FROM v_targets JOIN v_forecasts USING (IDREGION, FYEAR)
    QUALIFY row_number() OVER (PARTITION BY IDREGION, FYEAR ORDER BY
        PRED_DEKAD < TARGET_DEKAD,
        CASE WHEN PRED_DEKAD < TARGET_DEKAD THEN -PRED_DEKAD ELSE PRED_DEKAD END,
        {_parsed('PRED_DATE')}) = 1"""
ORACLE["forecast_asof"] = "SELECT * FROM v_asof"
VIEWS["v_national"] = """
    SELECT IDREGION, FYEAR, ALG, p.YIELD_PRED, YIELD_PRED_MCYFS, YIELD
    FROM v_level2 p JOIN v_asof USING (IDREGION, FYEAR)
    JOIN v_national_yields USING (IDREGION, FYEAR) WHERE YIELD_PRED_MCYFS > 0 AND YIELD > 0"""
ORACLE["national_comparison"] = """
    SELECT * REPLACE (round(YIELD_PRED, 6) AS YIELD_PRED) FROM v_national"""
VIEWS["v_national_both"] = """
    SELECT IDREGION, FYEAR, ALG, YIELD_PRED, YIELD FROM v_national UNION ALL
    SELECT DISTINCT IDREGION, FYEAR, 'MCYFS_Predictions', YIELD_PRED_MCYFS, YIELD FROM v_national"""
ORACLE["national_scores"] = _scores("v_national_both", "IDREGION, ALG", prefix="test_")
# the same over predictions without gaps made for the test
VIEWS["v_filled4_whole"] = _filled("v_areas4", "v_predictions")
VIEWS["v_level3_whole"] = _rolled("v_filled4_whole")
VIEWS["v_filled3_whole"] = _filled("v_areas3", "v_level3_whole")
VIEWS["v_level2_whole"] = _rolled("v_filled3_whole")
ORACLE["national_rollup_whole"] = """
    SELECT IDREGION, FYEAR, ALG, round(YIELD_PRED, 6) AS YIELD_PRED FROM v_level2_whole"""
VIEWS["v_national_whole"] = """
    SELECT IDREGION, FYEAR, ALG, p.YIELD_PRED, YIELD_PRED_MCYFS, YIELD
    FROM v_level2_whole p JOIN v_asof USING (IDREGION, FYEAR)
    JOIN v_national_yields USING (IDREGION, FYEAR) WHERE YIELD_PRED_MCYFS > 0 AND YIELD > 0"""
ORACLE["national_comparison_whole"] = """
    SELECT * REPLACE (round(YIELD_PRED, 6) AS YIELD_PRED) FROM v_national_whole"""
VIEWS["v_national_both_whole"] = """
    SELECT IDREGION, FYEAR, ALG, YIELD_PRED, YIELD FROM v_national_whole UNION ALL
    SELECT DISTINCT IDREGION, FYEAR, 'MCYFS_Predictions', YIELD_PRED_MCYFS, YIELD
    FROM v_national_whole"""
ORACLE["national_scores_whole"] = _scores(
    "v_national_both_whole", "IDREGION, ALG", prefix="test_")

# --- models ---------------------------------------------------------------------------------

VIEWS["v_model"] = f"""
    SELECT f.IDREGION, f.FYEAR, avgTAVGp2, avgPRECp3, YIELD, SPLIT
    FROM (SELECT IDREGION, CAMPAIGN_YEAR AS FYEAR,
            {even('avg(TAVG) FILTER (WHERE ' + _IN['p2'] + ')')} AS avgTAVGp2,
            {even('avg(PREC) FILTER (WHERE ' + _IN['p3'] + ')')} AS avgPRECp3
          FROM v_weather_phases GROUP BY ALL) f
    JOIN v_split_yields y ON f.IDREGION = y.IDREGION AND f.FYEAR = y.FYEAR
    WHERE avgTAVGp2 IS NOT NULL AND avgPRECp3 IS NOT NULL"""
ORACLE["scaled_features"] = """
    SELECT IDREGION, FYEAR, round((avgTAVGp2 - m1) / s1, 6) AS avgTAVGp2,
           round((avgPRECp3 - m2) / s2, 6) AS avgPRECp3
    FROM v_model, (SELECT avg(avgTAVGp2) AS m1, stddev_pop(avgTAVGp2) AS s1, avg(avgPRECp3) AS m2,
                          stddev_pop(avgPRECp3) AS s2 FROM v_model WHERE SPLIT = 'train')"""
ORACLE["ridge_predictions"] = """
    WITH s AS (SELECT count(*) AS n, avg(avgTAVGp2) AS m1, stddev_pop(avgTAVGp2) AS s1,
                      avg(avgPRECp3) AS m2, stddev_pop(avgPRECp3) AS s2,
                      corr(avgTAVGp2, avgPRECp3) AS r, avg(YIELD) AS my,
                      covar_pop(avgTAVGp2, YIELD) / stddev_pop(avgTAVGp2) AS c1,
                      covar_pop(avgPRECp3, YIELD) / stddev_pop(avgPRECp3) AS c2
               FROM v_model WHERE SPLIT = 'train'),
    b AS (SELECT *, 1 + 5.0 / n AS k FROM s)
    SELECT IDREGION, FYEAR, SPLIT, round(my
        + (k * c1 - r * c2) / (k * k - r * r) * (avgTAVGp2 - m1) / s1
        + (k * c2 - r * c1) / (k * k - r * r) * (avgPRECp3 - m2) / s2, 6) AS YIELD_PRED
    FROM v_model, b"""


def _knn(k: int) -> str:
    return (f"CASE WHEN bool_or(d = 0 AND r <= {k}) THEN avg(y) FILTER (WHERE d = 0 AND r <= {k}) "
            f"ELSE sum(y / nullif(d, 0)) FILTER (WHERE r <= {k}) "
            f"/ sum(1 / nullif(d, 0)) FILTER (WHERE r <= {k}) END")


ORACLE["knn_test_predictions"] = f"""
    SELECT IDREGION, FYEAR, round({_knn(3)}, 6) AS K3, round({_knn(5)}, 6) AS K5
    FROM (SELECT *, row_number() OVER (PARTITION BY IDREGION, FYEAR ORDER BY d) AS r
          FROM (SELECT q.IDREGION, q.FYEAR, t.YIELD AS y, sqrt(
                  (q.avgTAVGp2 - t.avgTAVGp2) ** 2 + (q.avgPRECp3 - t.avgPRECp3) ** 2) AS d
                FROM v_model q, v_model t WHERE q.SPLIT = 'test' AND t.SPLIT = 'train'))
    GROUP BY IDREGION, FYEAR"""

VIEWS["v_weather_table"] = """
    SELECT IDREGION, f.CAMPAIGN_YEAR AS FYEAR, SPLIT, YIELD,
           CAST(COLUMNS(f.* EXCLUDE (IDREGION, CAMPAIGN_YEAR)) AS DOUBLE)
    FROM v_weather_features f JOIN v_split_yields y USING (IDREGION)
    WHERE f.CAMPAIGN_YEAR = y.FYEAR"""
VIEWS["v_weather_scaled"] = """
    SELECT IDREGION, FYEAR, SPLIT, YIELD, FEATURE,
           (x - avg(x) FILTER (WHERE SPLIT = 'train') OVER f)
           / coalesce(nullif(stddev_pop(x) FILTER (WHERE SPLIT = 'train') OVER f, 0), 1) AS z
    FROM v_weather_table UNPIVOT INCLUDE NULLS (
        x FOR FEATURE IN (COLUMNS(* EXCLUDE (IDREGION, FYEAR, SPLIT, YIELD))))
    WINDOW f AS (PARTITION BY FEATURE)"""
ORACLE["scaled_features_whole"] = """
    SELECT IDREGION, FYEAR, FEATURE, round(z, 6) AS VALUE FROM v_weather_scaled"""
ORACLE["knn_predictions_whole"] = f"""
    SELECT IDREGION, FYEAR, {", ".join(f"round({_knn(k)}, 6) AS K{k}" for k in (3, 5, 7, 9))}
    FROM (SELECT *, row_number() OVER (PARTITION BY IDREGION, FYEAR ORDER BY d) AS r
          FROM (SELECT q.IDREGION, q.FYEAR, t.IDREGION, t.FYEAR, any_value(t.YIELD) AS y,
                       sqrt(sum((coalesce(q.z, 0) - coalesce(t.z, 0)) ** 2)) AS d
                FROM v_weather_scaled q JOIN v_weather_scaled t USING (FEATURE)
                WHERE q.SPLIT = 'test' AND t.SPLIT = 'train' GROUP BY ALL)
                AS pairs(IDREGION, FYEAR, other_region, other_year, y, d))
    GROUP BY IDREGION, FYEAR"""

# ridge and lasso on the two previous yields; fold -1 trains on all rows
VIEWS["v_lagged"] = """
    SELECT *, ntile(5) OVER (ORDER BY IDREGION, FYEAR) - 1 AS fold
    FROM (SELECT IDREGION, FYEAR, YIELD, lag(YIELD) OVER w AS x1, lag(YIELD, 2) OVER w AS x2
          FROM v_yields WINDOW w AS (PARTITION BY IDREGION ORDER BY FYEAR))
    WHERE x1 IS NOT NULL AND x2 IS NOT NULL"""
VIEWS["v_lagged_sums"] = """
    SELECT j, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(YIELD) AS my,
           stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, corr(x1, x2) AS r,
           covar_pop(x1, YIELD) / stddev_pop(x1) AS c1, covar_pop(x2, YIELD) / stddev_pop(x2) AS c2
    FROM v_lagged, generate_series(-1, 4) f(j) WHERE fold <> j GROUP BY j"""
VIEWS["v_lagged_errors"] = """
    SELECT alpha, j, avg(e * e) AS squared, avg(abs(e)) AS absolute, var_pop(YIELD) AS variance
    FROM (SELECT l.j, alpha, YIELD, YIELD - my
              - (k * c1 - r * c2) / (k * k - r * r) * (x1 - m1) / s1
              - (k * c2 - r * c1) / (k * k - r * r) * (x2 - m2) / s2 AS e
          FROM (SELECT *, 1 + alpha / n AS k FROM v_lagged_sums,
                    (VALUES (0.001::DOUBLE), (0.01), (0.1), (1), (10)) t(alpha)) l
          JOIN v_lagged ON fold = l.j)
    GROUP BY alpha, j"""
ORACLE["cv_objectives"] = """
    SELECT alpha AS ALPHA, OBJECTIVE, round(ERROR, 6) AS ERROR
    FROM (SELECT alpha, avg(squared) AS MSE, avg(sqrt(squared)) AS RMSE, avg(absolute) AS MAE,
                 avg(squared / variance) AS R2 FROM v_lagged_errors GROUP BY alpha)
    UNPIVOT (ERROR FOR OBJECTIVE IN (MSE, RMSE, MAE, R2))"""
ORACLE["lasso_path"] = """
    WITH s AS (SELECT *, share * greatest(abs(c1), abs(c2)) AS a FROM v_lagged_sums,
               (VALUES (1.0::DOUBLE), (0.9), (0.5), (0.1), (0.01), (0)) t(share) WHERE j = -1),
    -- every pattern of signs, with the coefficients it would have
    b AS (SELECT s.*, p, q,
                 CASE WHEN p = 0 THEN 0 WHEN q = 0 THEN c1 - a * p
                      ELSE (c1 - a * p - r * (c2 - a * q)) / (1 - r * r) END AS b1,
                 CASE WHEN q = 0 THEN 0 WHEN p = 0 THEN c2 - a * q
                      ELSE (c2 - a * q - r * (c1 - a * p)) / (1 - r * r) END AS b2
          FROM s, generate_series(-1, 1) u(p), generate_series(-1, 1) v(q)),
    best AS (SELECT share, arg_min({'b1': b1, 'b2': b2}, (b1 * b1 + 2 * r * b1 * b2 + b2 * b2) / 2
                    - c1 * b1 - c2 * b2 + a * (abs(b1) + abs(b2))) AS b FROM b GROUP BY share)
    SELECT share AS SHARE, 'YIELD-1' AS FEATURE, round(b.b1, 6) AS COEFFICIENT FROM best UNION ALL
    SELECT share, 'YIELD-2', round(b.b2, 6) FROM best"""
VIEWS["v_weather_bins"] = """
    SELECT FEATURE, CASE WHEN hx > lx THEN least(floor((x - lx) / (hx - lx) * 10), 9) ELSE 0 END AS a,
           CASE WHEN hy > ly THEN least(floor((YIELD - ly) / (hy - ly) * 10), 9) ELSE 0 END AS b
    FROM (SELECT *, min(x) OVER f AS lx, max(x) OVER f AS hx, min(YIELD) OVER () AS ly,
                 max(YIELD) OVER () AS hy
          FROM (FROM v_weather_table WHERE SPLIT = 'train') UNPIVOT INCLUDE NULLS (
              x FOR FEATURE IN (COLUMNS(* EXCLUDE (IDREGION, FYEAR, SPLIT, YIELD))))
          WINDOW f AS (PARTITION BY FEATURE))
    WHERE x IS NOT NULL"""
ORACLE["mutual_information"] = """
    SELECT FEATURE, round(sum(n / total * ln(n * total / (of_a * of_b))), 9) AS MI,
           CAST(any_value(total) AS BIGINT) AS N
    FROM (SELECT FEATURE, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY FEATURE) AS DOUBLE) AS total,
                 CAST(sum(n) OVER (PARTITION BY FEATURE, a) AS DOUBLE) AS of_a,
                 CAST(sum(n) OVER (PARTITION BY FEATURE, b) AS DOUBLE) AS of_b
          FROM (SELECT FEATURE, a, b, count(*) AS n FROM v_weather_bins GROUP BY ALL))
    GROUP BY FEATURE"""

# --- sources and sinks ----------------------------------------------------------------------

ORACLE["source_csv"] = """
    SELECT * EXCLUDE (d), 1 AS IDCOVER, 'NUTS2' AS LEVEL, 'RX' AS COUNTRY FROM v_weather"""
ORACLE["source_csv_reordered"] = """
    SELECT * EXCLUDE (d), 1 AS IDCOVER, 'NUTS2' AS LEVEL, left(IDREGION, 2) AS COUNTRY FROM v_weather"""
ORACLE["source_wide_years"] = """
    SELECT Crop, IDREGION, FYEAR, YIELD FROM v_raw_yields WHERE YIELD IS NOT NULL"""
ORACLE["source_levels"] = """
    SELECT *, 7 AS CROP_ID, 'NUTS2' AS LEVEL FROM v_areas4 UNION ALL
    SELECT *, 7 AS CROP_ID, 'NUTS1' AS LEVEL FROM v_areas3"""
ORACLE["saved_features"] = "SELECT * FROM v_model"
ORACLE["saved_predictions"] = "SELECT * FROM v_wide_predictions"


def _mentions(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def full_sql(name: str) -> str:
    """The query with every view it needs, in dependency order, as common table expressions."""
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for view in _mentions(sql):
            if view not in ordered:
                visit(VIEWS[view])
                ordered.append(view)

    body = ORACLE[name].strip()
    visit(body)
    if not ordered:
        return body
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in ordered)
    if body.startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
