"""The registry: every query has SQL unless it is a model, and a sample of both agree."""

from pathlib import Path
from types import SimpleNamespace

import duckdb
import pytest

import __spark_entry__ as entry
from seasonframe.operators.models import DEFAULT_ESTIMATORS
from seasonframe.plans import queries
from seasonframe.plans.oracle import ORACLE
from seasonframe.plans.queries import QUERIES
from tools.check_oracle import compare

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"boosted_predictions", "lasso_selected", "model_scores", "ridge_detrended"}

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql_but_the_models():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [
    "date_parts", "season_bounds", "season_bounds_global", "growth_prepared", "weather_dekadal",
    "calendar_summary", "weather_features", "split_growth_features", "optimal_window",
    "contiguous_folds", "prediction_scores", "national_scores", "season_features", "forecast_asof",
    "cv_objectives", "lasso_path", "mutual_information",
])
def test_spark_and_sql_agree(spark, con, name):
    text, ok = compare(spark, con, name, SF)
    assert ok, text


@pytest.mark.parametrize("name", ["season_bounds_global_whole", "national_rollup_whole",
                                  "national_comparison_whole", "national_scores_whole"])
def test_whole_tables_agree_with_sql(spark, con, name):
    text, ok = compare(spark, con, name, SF)
    assert ok, text


def test_all_sql_runs(con):
    for name, sql in entry.oracle_sql().items():
        assert con.sql(sql).columns, name


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_model_scores_runs_the_default_grids_and_folds(spark, monkeypatch):
    seen = []
    rows = spark.range(1).selectExpr("1.0D AS x", "'train' AS SPLIT", "1.0D AS YIELD")
    monkeypatch.setattr(queries.Tables, "season_features", lambda self, trended: rows)
    monkeypatch.setattr(queries.features, "drop_zero_features", lambda table: table)
    monkeypatch.setattr(queries.pipeline, "train_and_predict",
                        lambda table, cfg: seen.append(cfg) or SimpleNamespace(scores=table))
    QUERIES["model_scores"](spark, SF)
    assert (seen[0].estimators or DEFAULT_ESTIMATORS) == DEFAULT_ESTIMATORS
    assert seen[0].cv_folds == 5


@pytest.mark.parametrize("last, k", [(2001, 1), (2015, 5)])
def test_ridge_detrended_tunes_on_five_folds_where_years_allow(spark, monkeypatch, last, k):
    data = [(f"R{r}", y, 10.0 * r + y % 7) for r in range(4) for y in range(1995, last + 1)]
    yields = spark.createDataFrame(data, "IDREGION string, FYEAR int, YIELD double")
    monkeypatch.setattr(queries.Tables, "yields", yields)
    monkeypatch.setattr(queries.Tables, "prepare", lambda self, *names: None)
    seen, tuned = [], queries.models.detrend
    monkeypatch.setattr(queries.models, "detrend",
                        lambda *a, **b: seen.append(b.get("k", 5)) or tuned(*a, **b))
    assert QUERIES["ridge_detrended"](spark, SF).count() == 4 * (last - 1997)
    assert seen == [k]
