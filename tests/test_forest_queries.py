"""What the registered forest queries cover."""

import os

import pytest

from workload import forests

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_curves_of_all_features_and_replicates(spark):
    curves = forests.dependence(spark, FOLDER).select("variable", "model_run").distinct().collect()
    assert {(r.variable, r.model_run) for r in curves} == {(f, k) for f in forests.FEATURES for k in (1, 2)}
