import pytest

from coppice.plans.presets import FINAL_SPECS, SEARCH_RANGES
from coppice.session import new_path, shared_dir, stage
from coppice.sources import normalise_names, read_delimited, write_curves, write_predictions


def test_read_delimited_handles_missing_dots_and_row_numbers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(',site,rank.x,v\n1,"a, b",NA,2.5\n2,NA,3,NA\n')
    df = read_delimited(spark, str(path))
    assert df.columns == ["X", "site", "rank_x", "v"]
    assert [tuple(r) for r in df.orderBy("X").collect()] == [(1, "a, b", None, 2.5), (2, None, 3, None)]
    typed = read_delimited(spark, str(path), "X int, site string, `rank.x` double, v double")
    assert dict(typed.dtypes)["rank_x"] == "double"


def test_clashing_names_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, a_b int")
    with pytest.raises(ValueError, match="clash"):
        normalise_names(df)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_predictions_are_stored_by_model(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 3.0)], "model int, observed double, predicted double")
    path = str(tmp_path / fmt)
    write_predictions(df, path, fmt)
    assert sorted(p.name for p in (tmp_path / fmt).glob("model=*")) == ["model=1", "model=2"]
    if fmt == "parquet":
        back = spark.read.parquet(path)
    else:
        back = read_delimited(spark, path)
    assert sorted((r.model, r.observed, r.predicted) for r in back.collect()) == [(1, 1.0, None), (2, 2.0, 3.0)]


def test_curves_are_stored_by_variable(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0)], "variable string, value double, yhat double")
    write_curves(df, str(tmp_path / "c"))
    assert len(list((tmp_path / "c").glob("variable=*"))) == 2


def test_staged_tables_live_in_the_shared_folder(spark):
    df = stage(spark.range(10), "x")
    assert df.count() == 10
    assert all(shared_dir(spark) in f for f in df.inputFiles())
    assert new_path(spark, "x") != new_path(spark, "x")
    wide = stage(spark.range(100_000).coalesce(1), "x", spread=True)
    assert wide.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert stage(spark.range(100).coalesce(1), "x", spread=True).rdd.getNumPartitions() == 1


class FakeSession:
    def __init__(self, master, folder=None):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_shared_folder_comes_from_the_session():
    assert shared_dir(FakeSession("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    local = FakeSession("local[2]")
    assert shared_dir(local) == shared_dir(local) != ""
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(FakeSession("yarn"))


def test_staging_keeps_pushdown(spark):
    df = stage(spark.range(10).selectExpr("id", "id * 2 as twice"), "x")
    plan = df.where("id > 3").select("twice")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,3)" in plan


def test_presets_cover_twelve_models():
    assert len(FINAL_SPECS) == len(SEARCH_RANGES) == 12
    assert set(FINAL_SPECS) == set(SEARCH_RANGES)
