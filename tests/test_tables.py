"""Building model tables on a hand-made study."""

import pytest

from coppice.plans.tables import (
    SurveyColumns,
    difference_rows,
    exposed_surveys,
    model_rows,
    one_event_per_survey,
    site_means,
    unexposed_surveys,
)

COLS = SurveyColumns(
    site="site", survey="survey", width="w", relative_width="rw", quality="qc", region="prov",
    share="share", size="size", event_year="fire_year",
)


@pytest.fixture(scope="module")
def surveys(spark):
    return spark.createDataFrame(
        [
            ("s1", "s1_2000", 2.0, "N", "K", 10.0),
            ("s1", "s1_2010", 4.0, "N", "K", 20.0),
            ("s2", "s2_2000", 5.0, "N", "K", None),
            ("s3", "s3_2000", None, "N", "K", 30.0),
            ("s4", "s4_2000", 1.0, "Y", "K", 40.0),
            ("s5", "s5_2000", 1.0, "N", "C", 50.0),
        ],
        "site string, survey string, w double, qc string, prov string, fines double",
    )


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(
        [
            ("s1", "s1_2010", 4.0, "N", "K", 60.0, 30.0, 9.0, 2002),
            ("s1", "s1_2010", 4.0, "N", "K", 60.0, 5.0, 2.0, 2005),
            ("s1", "s1_2010", 4.0, "N", "K", 60.0, 0.5, 0.1, 2001),
            ("s2", "s2_2000", 5.0, "N", "K", 70.0, 0.9, 1.0, 1999),
        ],
        "site string, survey string, w double, qc string, prov string, fines double, share double, "
        "size double, fire_year int",
    )


def test_exposed_and_unexposed_cohorts(surveys, events):
    means = site_means(surveys, COLS)
    exposed = exposed_surveys(events, means, 1.0, cols=COLS)
    assert exposed.count() == 2
    assert {round(r.rw, 6) for r in exposed.collect()} == {round(4 / 3, 6)}
    plain = unexposed_surveys(surveys, exposed, means, COLS)
    assert {r.survey for r in plain.collect()} == {"s1_2000", "s2_2000", "s3_2000", "s5_2000"}
    rows = model_rows(plain, ["survey", "fines", "rw"], ["K"], {"survey": "other"}, COLS)
    assert [r.survey for r in rows.collect()] == ["s1_2000"]
    assert rows.columns == ["survey", "fines", "rw"]


def test_one_event_per_survey_by_size_or_year(surveys, events):
    exposed = exposed_surveys(events, site_means(surveys, COLS), 1.0, cols=COLS)
    pick = lambda **kw: one_event_per_survey(exposed, ["fire_year"], cols=COLS, **kw).first().fire_year
    assert pick() == 2005
    assert pick(descending=True) == 2002
    assert pick(order_by="fire_year") == 2002


def test_difference_rows(spark):
    predictions = spark.createDataFrame(
        [(m, 10.0, 12.0 + m, "s1", 2010) for m in (1, 2)] + [(1, 1.0, 2.0, "s9", 2010)],
        "model int, observed double, predicted double, site_id string, year int",
    )
    linkage = spark.createDataFrame([("s1", 2010, "s1_2010", "N")], "site string, survey_year int, survey string, qc string")
    exposures = spark.createDataFrame([("s1_2010", 1.0), ("s1_2010", 2.0)], "survey string, size double")
    out = difference_rows(
        predictions, linkage, exposures, ["model", "difference", "size"],
        {"site_id": "site", "year": "survey_year"}, survey="survey", drop=["qc"],
    )
    assert sorted(tuple(r) for r in out.collect()) == [(1, 3.0, 1.0), (1, 3.0, 2.0), (2, 4.0, 1.0), (2, 4.0, 2.0)]


def test_difference_study_keeps_each_group_and_its_key(spark):
    from pyspark.sql import functions as F

    from coppice.operators.forest import ForestSpec
    from coppice.plans.studies import difference_curves, run_difference_study

    rows = spark.range(240).select(
        "id", F.when(F.col("id") % 3 == 0, 5).otherwise(3).alias("model"),
        (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("difference"),
    )
    study = run_difference_study(rows, ["a"], ["id"], ForestSpec(trees=4, bags=2, max_depth=3))
    assert study.table.df.count() == 240
    assert {k: t.df.count() for k, (t, _) in study.groups.items()} == {3: 160, 5: 80}
    assert {f.replicate for f in study.forests} == {3, 5}
    curves = difference_curves(study, ["a"], 4)
    assert {r.model_run for r in curves.select("model_run").distinct().collect()} == {3, 5}
