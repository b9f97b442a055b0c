"""Plans that stay short, and models that measure nothing they don't use."""

from tessitura.operators import features
from tessitura.operators.exact import exact_covariances
from tessitura.queries import QUERIES


def test_dummy_predictions_measure_no_vectors(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(features, "composition_vector", None)
    found = QUERIES["dummy_predictions"](spark, sf_dir)
    assert {r.model for r in found.collect()} == {"dummy"}


def test_plan_of_covariances_does_not_grow_with_the_columns(spark):
    def size(k):
        wide = spark.range(5).selectExpr("id % 2 AS g", *[f"CAST(id * {i + 1} AS DOUBLE) AS x{i}" for i in range(k)])
        plan = exact_covariances(wide, [f"x{i}" for i in range(k)], ["g"])._jdf.queryExecution().analyzed()
        return plan.toString().count("struct(")

    assert size(12) == size(3)
