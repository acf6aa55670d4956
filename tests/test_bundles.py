"""Encoder as a pipeline stage, ensembles stored as one bundle, groups by text and null keys."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from coppice.operators.encode import CategoryEncoder, LevelEncoder, LevelEncoderModel
from coppice.operators.forest import ForestSpec, fit_per_group, fit_replicates, group_names, prepare, raw_workflow
from coppice.plans.studies import run_transfer
from coppice.sources import load_bundle, save_bundle

SPEC = ForestSpec(trees=4, mtry=2, min_node=4, bags=2, max_depth=4, max_bins=32)


def _raw(spark):
    return spark.createDataFrame([("b", "x", 1), ("a", None, 2), ("new", "y", 3)], "d string, e string, n int")


def test_encoder_stage_equals_the_encoder(spark, tmp_path):
    train = spark.createDataFrame([("a", "x", 0), ("b", "y", 0), ("a", None, 1)], "d string, e string, n int")
    model = LevelEncoder(inputCols=["d", "e"]).fit(train)
    plain = CategoryEncoder.fit(train, ["d", "e"])
    assert model.transform(_raw(spark)).collect() == plain.transform(_raw(spark)).collect()
    path = str(tmp_path / "levels")
    model.write().overwrite().save(path)
    again = LevelEncoderModel.load(path)
    assert again.uid == model.uid and again.getInputCols() == ["d", "e"]
    rows = {r.n: (r.d, r.e) for r in again.transform(_raw(spark)).collect()}
    assert rows == {1: (1.0, 0.0), 2: (0.0, None), 3: (2.0, 1.0)}


def test_workflow_is_stored_and_scores_raw_rows(spark, planted, tmp_path):
    fitted = raw_workflow("y", ["a", "b", "d"], ["d"], SPEC).fit(planted)
    path = str(tmp_path / "workflow")
    fitted.write().overwrite().save(path)
    rows = planted.limit(50).withColumn("d", F.when(F.col("id") % 5 == 0, "unseen").otherwise(F.col("d")))
    wanted = {r.id: r.prediction for r in fitted.transform(rows).collect()}
    got = {r.id: r.prediction for r in PipelineModel.load(path).transform(rows).collect()}
    assert got == wanted and len(got) == 50
    gaps = rows.withColumn("a", F.when(F.col("id") % 2 == 0, F.col("a")))
    assert PipelineModel.load(path).transform(gaps).count() == gaps.where("a is not null").count()


def _jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    out = work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, found


def test_bundle_scores_raw_rows_as_the_forests_do(spark, planted, tmp_path):
    table = prepare(planted, "y", ["a", "b", "d"], ["id"], ["d"])
    forests = fit_replicates(table, SPEC, [3, 1], 2)
    raw = planted.withColumn("d", F.when(F.col("id") % 7 == 0, "unseen").otherwise(F.col("d")))
    jobs = {}
    for n in (1, 2):
        path = str(tmp_path / f"bundle{n}")
        _, saved = _jobs(spark, f"save{n}", lambda: save_bundle(table, forests[:n], path))
        bundle, loaded = _jobs(spark, f"load{n}", lambda: load_bundle(spark, path))
        jobs[n] = (saved, loaded)
    assert jobs[1] == jobs[2]  # however many replicates there are
    assert bundle.ids == ["id"] and bundle.label == "y" and bundle.trees.replicates == [1, 3]
    got = {(r.model, r.id): (r.predicted, r.d) for r in bundle.score(raw, ["id", "d"]).collect()}
    wanted = run_transfer(table, forests, raw, ["id", "d"])[0].collect()
    assert len(got) == len(wanted) and all(got[r.model, r.id] == (pytest.approx(r.predicted), r.d) for r in wanted)


def test_groups_by_text_and_null_keys(spark, planted):
    rows = planted.withColumn("g", F.when(F.col("id") % 3 == 0, "b").when(F.col("id") % 3 == 1, "a"))
    fits = fit_per_group(rows, "g", "y", ["a", "b"], ["id"], SPEC, parallelism=3)
    assert list(fits) == [None, "a", "b"] and [f.replicate for _, f in fits.values()] == [1, 2, 3]
    assert all(t.df.count() == 1000 for t, _ in fits.values())
    assert {(r.iteration, r.g) for r in group_names(fits, "g").collect()} == {(1, None), (2, "a"), (3, "b")}
    with pytest.raises(ValueError, match="more than 2 values"):
        fit_per_group(rows, "g", "y", ["a"], ["id"], SPEC, max_groups=2)


def test_wide_keys_are_numbered(spark, planted):
    rows = planted.withColumn("g", F.col("id") % 2 + 2**40)
    fits = fit_per_group(rows, "g", "y", ["a"], ["id"], SPEC, parallelism=2)
    assert list(fits) == [2**40, 2**40 + 1] and [f.replicate for _, f in fits.values()] == [1, 2]
