import pytest
from conftest import rows

from seasonframe import RunConfig
from seasonframe.plans import pipeline
from seasonframe.plans.experiments import experiment_grid
from seasonframe.sources import readers, writers


def put(folder, name, text):
    (folder / name).write_text(text)


@pytest.fixture
def folder(tmp_path):
    put(tmp_path, "SOIL_NUTS2_NL.csv", "IDREGION,SM_WP,NOTE,SM_FC\nNL11,0.1,x,0.35\n")
    put(tmp_path, "SOIL_NUTS2_FR.csv", "IDREGION,SM_WP,NOTE,SM_FC\nFR10,0.2,y,0.4\n")
    put(tmp_path, "CENTROIDS_NUTS2_NL.csv", "IDREGION,CENTROID_X,CENTROID_Y,COAST\nNL11,1,2,3.5\n")
    put(tmp_path, "YIELD_NUTS2_NL.csv",
        "Crop,IDREGION,1994,1995,\nTotal potatoes,NL11,38.0,,\nTotal potatoes,NL12,49,bad,\n")
    put(tmp_path, "METEO_DAILY_NUTS2_NL.csv",
        "IDREGION,DATE,TMAX,TMIN,TAVG,PREC,ET0,RAD\nNL11,19790101,8.5,-1,5,1,0.2,10000\n")
    put(tmp_path, "REMOTE_SENSING_NUTS2_NL.csv", "IDREGION,DATE,FAPAR\nNL11,19790101,0.4\n")
    for level, region in (("NUTS2", "NL11"), ("NUTS1", "NL1")):
        put(tmp_path, f"AREA_FRACTIONS_{level}_NL.csv",
            f"IDREGION,FYEAR,CROP_ID,FRACTION\n{region},1999,7,0.5\n")
    return tmp_path


def test_columns_match_by_name(spark, folder):
    df = readers.read_source(spark, str(folder), "SOIL", "NUTS2", "NL")
    assert dict(df.dtypes) == {"IDREGION": "string", "SM_WP": "double", "NOTE": "string",
                               "SM_FC": "double"}
    assert rows(df, "SM_FC", "SM_WP") == [(0.35, 0.1)]


def test_extra_numbers(spark, folder):
    df = readers.read_source(spark, str(folder), "CENTROIDS", "NUTS2", "NL")
    assert rows(df) == [("NL11", 1.0, 2.0, 3.5)]


def test_wide_yield_file(spark, folder):
    from seasonframe.operators.clean import clean_yield

    df = readers.read_source(spark, str(folder), "YIELD", "NUTS2", "NL")
    assert rows(clean_yield(df, 7)) == [("NL11", 1994, 38.0), ("NL12", 1994, 49.0)]


def test_several_countries_with_origin(spark, folder):
    df = readers.read_source(spark, str(folder), "SOIL", "NUTS2", "*", with_origin=True)
    assert rows(df, "IDREGION", "LEVEL", "COUNTRY") == [
        ("FR10", "NUTS2", "FR"), ("NL11", "NUTS2", "NL")]


def test_files_are_read_under_their_own_headers(spark, tmp_path):
    put(tmp_path, "SOIL_NUTS2_AA.csv", "IDREGION,SM_WP,SM_FC\nAA11,0.1,0.3\n")
    put(tmp_path, "SOIL_NUTS2_BB.csv", "IDREGION,SM_FC,SM_WP\nBB11,0.4,0.2\n")
    put(tmp_path, "YIELD_NUTS2_AA.csv", "Crop,IDREGION,1994,1995\nPotatoes,AA11,40,41\n")
    put(tmp_path, "YIELD_NUTS2_BB.csv", "Crop,IDREGION,1995,1996\nPotatoes,BB11,50,51\n")
    soil = readers.read_source(spark, str(tmp_path), "SOIL", "NUTS2", "*")
    assert rows(soil, "IDREGION", "SM_WP", "SM_FC") == [("AA11", 0.1, 0.3), ("BB11", 0.2, 0.4)]
    wide = readers.read_source(spark, str(tmp_path), "YIELD", "NUTS2", "*", with_origin=True)
    got = {r["IDREGION"]: (r["1994"], r["1995"], r["1996"], r["COUNTRY"]) for r in wide.collect()}
    assert {k: tuple(v and str(float(v)) if i < 3 else v for i, v in enumerate(r))
            for k, r in got.items()} == {
        "AA11": ("40.0", "41.0", None, "AA"), "BB11": (None, "50.0", "51.0", "BB")}


def jobs_of(spark, group, action):
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        return action(), len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_headers_of_many_files_take_one_job(spark, tmp_path):
    """Blank lines first, a mark of the byte order, a trailing separator, repeated names, an empty
    file, and a file of many lines, in a folder with a blank and a percent sign in its name."""
    folder = tmp_path / "a b%20c"
    folder.mkdir()
    for i in range(12):
        put(folder, f"SOIL_NUTS2_A{i:X}.csv", "\nIDREGION,SM_WP,SM_FC,\n" if i % 2 else
            "\ufeffSM_FC,IDREGION,SM_WP\n" + f"0.3,A{i},0.1\n" * (40_000 if i == 4 else 1))
    put(folder, "SOIL_NUTS2_BB.csv", "")
    put(folder, "SOIL_NUTS2_CC.csv", "IDREGION,note,Note,SM_FC\nCC,x,y,0.4\n")
    found, jobs = jobs_of(spark, "headers", lambda: readers._by_header(
        spark, "SOIL", f"{folder}/SOIL_NUTS2_*.csv", "csv"))
    assert {h: len(files) for h, files in found.items()} == {
        ("IDREGION", "SM_WP", "SM_FC", "_c3"): 6, ("SM_FC", "IDREGION", "SM_WP"): 6,
        ("IDREGION", "note1", "Note2", "SM_FC"): 1}
    assert jobs == 1
    df = readers.read_source(spark, str(folder), "SOIL", "NUTS2", "*", with_origin=True)
    assert df.filter("COUNTRY = 'A4'").count() == 40_000
    assert rows(df.filter("COUNTRY <> 'A4'"), "COUNTRY", "SM_FC") == [
        *((f"A{c}", 0.3) for c in "0268A"), ("CC", 0.4)]
    assert spark.conf.get("spark.sql.files.openCostInBytes") != str(1 << 40)


def test_files_without_a_line_are_an_empty_table(spark, tmp_path):
    put(tmp_path, "SOIL_NUTS2_AA.csv", "")
    df = readers.read_source(spark, str(tmp_path), "SOIL", "NUTS2", "*")
    assert df.columns == ["IDREGION", "SM_FC", "SM_WP"] and df.count() == 0


def test_part_files_of_a_folder_may_differ(spark, tmp_path):
    folder = tmp_path / "SOIL_NUTS2_AA.csv"
    folder.mkdir()
    put(folder, "part-0.csv", "IDREGION,SM_WP,SM_FC\nA1,0.1,0.3\n")
    put(folder, "part-1.csv", "SM_FC,IDREGION\n0.4,A2\n")
    df = readers.read_source(spark, str(tmp_path), "SOIL", "NUTS2", "AA")
    assert rows(df.filter("SM_WP IS NULL"), "IDREGION", "SM_FC") == [("A2", 0.4)]
    assert df.count() == 2


def test_sources_as_a_list():
    cfg = RunConfig(data_sources=["SOIL", "REMOTE_SENSING"], use_remote_sensing=True,
                    nuts_level="NUTS3")
    assert cfg.sources["SOIL"] == "NUTS3" and cfg.sources["REMOTE_SENSING"] == "NUTS2"


def test_levels(spark, folder):
    df = readers.read_levels(spark, str(folder), "AREA_FRACTIONS", ["NUTS2", "NUTS1"], "NL")
    assert rows(df, "IDREGION", "LEVEL") == [("NL1", "NUTS1"), ("NL11", "NUTS2")]


def test_load_all(spark, folder):
    cfg = RunConfig(data_path=str(folder), nuts_level="NUTS2")
    got = readers.load_all(spark, cfg, ["METEO_DAILY", "SOIL", "REMOTE_SENSING"])
    assert set(got) == {"METEO", "SOIL", "REMOTE_SENSING"}
    both = readers.load_all(spark, cfg, {"AREA_FRACTIONS": ["NUTS2", "NUTS1"]})
    assert both["AREA_FRACTIONS"].count() == 2
    parquet = readers.load_all(spark, cfg, {"SOIL": "NUTS2"})["SOIL"]
    parquet.write.parquet(f"{folder}/SOIL_NUTS2_NL.parquet")
    again = readers.read_source(spark, str(folder), "SOIL", "NUTS2", "NL", fmt="parquet")
    assert rows(again) == rows(parquet)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_features_and_predictions_round_trip(spark, tmp_path, fmt):
    cfg = RunConfig(crop_name="sugar beets", use_yield_trend=True, early_season_prediction=True)
    df = spark.createDataFrame([("NL11", 1999, 1.5, "train"), ("NL11", 2000, 2.5, "test")],
                               "IDREGION string, FYEAR int, `YIELD-1` double, SPLIT string")
    where = writers.save_features(df, str(tmp_path), cfg, fmt)
    assert where.endswith("/ft_sugar_beets_NL_trend_early15")
    back = writers.load_features(spark, str(tmp_path), cfg, fmt)
    assert rows(back, "IDREGION", "FYEAR", "`YIELD-1`", "SPLIT") == rows(df)
    where = writers.save_predictions(df.drop("SPLIT"), str(tmp_path), cfg, fmt=fmt)
    assert where.endswith("/pred_sugar_beets_NL_NUTS2_trend_early15")
    assert rows(writers.load_predictions(spark, str(tmp_path), cfg, fmt=fmt)) == rows(
        df.drop("SPLIT"))
    assert "_NUTS0_" in writers.save_national_predictions(df, str(tmp_path), cfg, fmt)


def test_csv_keeps_the_types_of_every_column(spark, tmp_path):
    cfg = RunConfig(use_yield_trend=False)
    df = spark.createDataFrame([("NL11", 1999, 3, "x", 1.5, "train"), ("NL11", 2000, None, "y", None, "test")],
                               "IDREGION string, FYEAR int, n bigint, note string, v double, SPLIT string")
    writers.save_features(df, str(tmp_path), cfg, "csv")
    back = writers.load_features(spark, str(tmp_path), cfg, "csv")
    assert dict(back.dtypes) == dict(df.dtypes)
    assert sorted(map(repr, back.select(df.columns).collect())) == sorted(map(repr, df.collect()))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_run_from_saved_predictions(spark, tmp_path, fmt):
    """No source is read and nothing is trained or written."""
    cfg = RunConfig(use_saved_predictions=True, data_path="/nowhere", output_path=str(tmp_path),
                    file_format=fmt, metrics=("MAPE",))
    df = spark.createDataFrame([("NL11", 1999, 9.0, 20.0, 10.0), ("NL12", 1999, 22.0, 20.0, 20.0)],
                               "IDREGION string, FYEAR int, YIELD_PRED_a double, "
                               "YIELD_PRED_b double, YIELD double")
    writers.save_predictions(df, str(tmp_path), cfg, fmt=fmt)
    result = pipeline.run(spark, cfg)
    assert rows(result.test) == rows(df)
    assert {r["ALG"]: round(r["test_MAPE"], 6) for r in result.scores.collect()} == {
        "a": 10.0, "b": 50.0}
    assert result.frequency.isEmpty() and result.national is None


def test_config_checks():
    for bad in ({"crop_name": "rice"}, {"nuts_level": "NUTS9"}, {"trend_windows": (2,)},
                {"country_code": "XYZ"}, {"early_season_end_dekad": 40},
                {"test_fraction": 1.5}, {"file_format": "xml"}):
        with pytest.raises(ValueError):
            RunConfig(**bad)


def test_config_options():
    cfg = RunConfig.from_options({
        "crop_id": 6, "use_yield_trend": "Y", "compare_with_mcyfs": "n",
        "season_crosses_calendar_year": "Y", "trend_windows": [5, 7], "use_centroids": "Y"})
    assert (cfg.crop_name, cfg.use_yield_trend, cfg.compare_with_forecast,
            cfg.season_crosses_year) == ("sugarbeet", True, False, True)
    assert cfg.sources["CENTROIDS"] == "NUTS2" and cfg.sources["REMOTE_SENSING"] == "NUTS2"
    assert "REMOTE_SENSING" not in cfg.updated(use_remote_sensing=False).sources
    assert cfg.early_offset is None
    assert cfg.updated(early_season_prediction=True, early_season_end_dekad=-6).early_offset == -6
    with pytest.raises(ValueError):
        RunConfig.from_options({"nothing": 1})
    with pytest.raises(ValueError):
        RunConfig.from_options({"use_yield_trend": "maybe"})


def test_experiment_grid(spark):
    grid = experiment_grid(spark)
    assert grid.filter("early_season_end_dekad IS NULL").isEmpty()
    assert grid.count() == 4 * 3 * 4
    assert grid.filter("crop_name = 'potatoes' AND country_code = 'FR' AND nuts_level = 'NUTS3' "
                       "AND experiment = 'trend-early' AND use_yield_trend = 'Y' "
                       "AND early_season_end_dekad = 18").count() == 1
