from conftest import rows
from fixtures import daily_weather, dekadal_weather, growth
from pyspark.sql import functions as F

from seasonframe.functions import with_year_dekad
from seasonframe.operators import season

BOUNDS = ["IDREGION", "FYEAR", "PREV_SEASON_END", "SEASON_END"]
ENDS = [("AT21", 2003, 22), ("AT21", 2004, 28), ("SI03", 2004, 18)]


def crop(spark):
    return growth(spark).drop("CROP_ID")


def ends_of(spark, data):
    return spark.createDataFrame(data, "IDREGION string, FYEAR int, SEASON_END_DEKAD int")


def dvs_rows(spark, data):
    return spark.createDataFrame(data, "IDREGION string, FYEAR int, DEKAD int, DVS double")


def test_ends_and_bounds(spark):
    assert rows(season.season_end(crop(spark))) == ENDS
    assert rows(season.crop_season(crop(spark)), *BOUNDS) == [
        ("AT21", 2003, 0, 28), ("AT21", 2004, 28, 28), ("SI03", 2004, 0, 18)]


def test_ties_in_a_dekad_follow_the_date_whatever_the_row_order(spark):
    shuffled = crop(spark).repartition(5, "DVS").orderBy(F.desc("DATE"))
    assert rows(season.season_end(shuffled)) == ENDS


def test_duplicated_rows_match_a_plain_lag(spark):
    """Many equal rows: the reduced plan must equal a lag over all rows ordered by DVS in a date."""
    copies = crop(spark).crossJoin(spark.range(3)).drop("id")
    got = rows(season.season_end(copies))
    copies.selectExpr(
        "IDREGION", "year(to_date(DATE, 'yyyyMMdd')) y", "DATE", "CAST(DVS AS DOUBLE) v",
        "(month(to_date(DATE, 'yyyyMMdd')) - 1) * 3 "
        "+ least(ceil(day(to_date(DATE, 'yyyyMMdd')) / 10), 3) d").createOrReplaceTempView("copies")
    want = spark.sql("""
        SELECT IDREGION, y, CAST(min(d) AS INT) FROM (
            SELECT *, lag(v) OVER (PARTITION BY IDREGION, y ORDER BY DATE, v) p FROM copies)
        WHERE (v >= 200 AND (p IS NULL OR v = p)) OR (p >= 200 AND v = 0) OR d = 36
        GROUP BY IDREGION, y""")
    assert got == rows(want)
    assert got[0] == ("AT21", 2003, 21)  # equal ripe copies within the last date of July


def test_end_rules(spark):
    data = [("A", 1, d, v) for d, v in [(1, 0.), (10, 200.), (12, 0.), (20, 5.)]]       # reset
    data += [("B", 1, d, v) for d, v in [(1, 100.), (36, 150.)]]                         # year end
    data += [("C", 1, d, v) for d, v in [(1, 10.), (20, 150.)]]                          # none
    data += [("D", 1, d, v) for d, v in [(3, 201.), (4, 201.)]]                          # at once
    df = dvs_rows(spark, data)
    assert rows(season.season_end(df)) == [("A", 1, 12), ("B", 1, 36), ("D", 1, 3)]
    assert rows(season.season_end(df, crosses=True)) == [("A", 1, 1), ("B", 1, 36), ("D", 1, 3)]


def test_bounds_per_region_and_global(spark):
    ends = ends_of(spark, [("A", 2000, 30), ("A", 2001, 28), ("A", 2002, 29), ("B", 2001, 31)])
    assert rows(season.season_bounds(ends), *BOUNDS) == [
        ("A", 2000, 0, 30), ("A", 2001, 30, 29), ("A", 2002, 29, 29), ("B", 2001, 0, 31)]
    got = {(r[0], r[1]): (r[2], r[3]) for r in season.season_bounds(
        ends, global_bounds=True).select(*BOUNDS).collect()}
    # region B neither starts nor stops with the table: no bounds
    assert got == {("A", 2000): (0, 30), ("A", 2001): (30, 29), ("A", 2002): (29, 29),
                   ("B", 2001): (None, None)}


def test_alignment_of_growth(spark):
    bounds = season.crop_season(crop(spark))
    out = season.prepare_growth(crop(spark).withColumn("X", F.lit(1.0)), bounds)
    assert out.columns == ["IDREGION", "FYEAR", "DEKAD", "CAMPAIGN_YEAR", "CAMPAIGN_DEKAD",
                           "POT_YB", "DVS", "X"]
    assert out.count() == 20
    shift = "CASE WHEN IDREGION = 'AT21' THEN 8 ELSE 18 END"
    assert out.filter(f"CAMPAIGN_YEAR <> FYEAR OR CAMPAIGN_DEKAD <> DEKAD + {shift}").count() == 0
    assert rows(out.filter("X = 0"), "IDREGION", "FYEAR", "DEKAD") == [
        ("AT21", 2004, 28), ("SI03", 2004, 18)]


def test_alignment_moves_rows_to_the_next_campaign(spark):
    bounds = spark.createDataFrame(
        [("A", "2000", 0, 28), ("A", "2001", 28, 30)],
        "IDREGION string, FYEAR string, PREV_SEASON_END int, SEASON_END int")
    df = spark.createDataFrame(
        [("A", y, d, 1.0) for y in (2000, 2001) for d in (5, 28, 29, 36)],
        "IDREGION string, FYEAR int, DEKAD int, X double")
    keys = ("FYEAR", "DEKAD", "CAMPAIGN_YEAR", "CAMPAIGN_DEKAD")
    out = season.align_to_season(df, bounds)
    assert rows(out, *keys) == [
        (2000, 5, 2000, 13), (2000, 28, 2000, 36), (2000, 29, 2001, 1), (2000, 36, 2001, 8),
        (2001, 5, 2001, 13), (2001, 28, 2001, 36), (2001, 29, 2001, 37)]
    crossing = season.align_to_season(df, bounds, crosses=True)
    assert rows(crossing, *keys) == [r for r in rows(out, *keys) if r[2] == 2001]
    assert out.count() <= df.count()


def test_water_balance(spark):
    out = season.prepare_weather(dekadal_weather(spark), season.crop_season(crop(spark)))
    for year in (2003, 2004):
        got = [r[0] for r in out.filter(F.col("FYEAR") == year).orderBy("DEKAD", "ET0")
               .select("CWB").collect()]
        assert sorted(got) == sorted([3.1, -0.3, -1.3, 0.0, 3.75])


def test_daily_to_dekadal(spark):
    aligned = season.prepare_weather(daily_weather(spark), season.crop_season(crop(spark)))
    out = season.daily_to_dekadal(aligned)
    assert out.count() == 6
    for year in (2003, 2004):
        by_dekad = {r["CAMPAIGN_DEKAD"]: r for r in out.filter(F.col("FYEAR") == year).collect()}
        got = {d: (r.TMAX, r.TMIN, r.TAVG, r.PREC, r.ET0, r.RAD, r.CWB) for d, r in by_dekad.items()}
        assert got == {9: (6.5, -6.0, 0.5, 13.0, 2.0, 4000.0, 11.0),
                       10: (12.5, 1.5, 5.5, 0.5, 2.5, 7500.0, -2.0),
                       11: (2.5, -9.5, -3.0, 2.0, 0.25, 6000.0, 1.75)}


def test_remote_sensing_through_children(spark):
    from seasonframe.operators.clean import expand_to_children

    days = ["0104", "0118", "0302", "0416", "0530"]
    parents = spark.createDataFrame(
        [("HU31", f"{y}{d}", 0.25) for y in (2003, 2004) for d in days],
        "IDREGION string, DATE string, FAPAR double")
    children = spark.createDataFrame([("HU312",), ("HU313",)], "IDREGION string")
    bounds = spark.createDataFrame(
        [(r, y, p, e) for r, last in (("HU311", 28), ("HU312", 31))
         for y, p, e in (("2003", 0, 24), ("2004", 24, last))],
        "IDREGION string, FYEAR string, PREV_SEASON_END int, SEASON_END int")
    out = season.prepare_remote_sensing(expand_to_children(parents, children), bounds)
    assert {r[0] for r in rows(out)} == {"HU312"}
    assert out.count() == 10
    assert out.filter("CAMPAIGN_DEKAD <> DEKAD + 12").count() == 0


def test_partitioning_does_not_matter(spark):
    bounds = season.crop_season(crop(spark))
    once = season.daily_to_dekadal(season.prepare_weather(daily_weather(spark), bounds))
    again = season.daily_to_dekadal(season.prepare_weather(
        daily_weather(spark).repartition(7, "DATE"), bounds.repartition(3)))
    assert rows(once) == rows(again)


def test_growth_without_dates(spark):
    """Within a dekad rows then count as ordered by DVS."""
    ready = with_year_dekad(crop(spark)).repartition(3, "DVS")
    assert rows(season.season_end(ready)) == ENDS
