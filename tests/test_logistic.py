"""Logistic regression of all groups in one fit, against the library's fit one by one."""

import math

import pytest
from pyspark.sql import functions as F

from holdfast.operators.logistic import coefficients, fit_logistic, score_logistic
from holdfast.operators.model import fit_ml
from holdfast.sources import sinks

FEATURES = ["f1", "f2"]


def rows(spark, n=400, seeds=(1, 2)):
    """Noisy classes; `f2` is missing now and then, class 1 is rare and holds copies."""
    out = []
    for s in seeds:
        for i in range(n):
            x, u = math.sin(i * 7.31 + s), math.cos(i * 3.17 * s)
            y = int(x + 0.9 * math.sin(i * 1.93 + 2 * s) > 0.8)
            out.append((s, i, y, 100 + 25 * x, None if i % 13 == 0 else u + y, 3 if y else 1))
    return spark.createDataFrame(out, "seed int, id long, y int, f1 double, f2 double, copies int")


@pytest.mark.parametrize("penalty", [0.0, 0.05])
def test_equals_library_fits(spark, penalty):
    train = rows(spark)
    params = fit_logistic(train, FEATURES, 4, [penalty]).collect()
    assert len(params) == 4 and all(p["gradient"] <= 1e-9 for p in params)
    for p in params:
        part = train.filter(F.col("seed") == p["seed"])
        if p["strategy"] == "oversampled":
            part = part.withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_c")
        model = fit_ml("logistic", part, 1, FEATURES, regParam=penalty, maxIter=200, tol=1e-12).stages[-1]
        ours = [p[f"b_{f}"] / p[f"s_{f}"] for f in FEATURES]
        assert ours == pytest.approx(list(model.coefficients), abs=1e-4)
        constant = p["b_const"] - sum(b * p[f"m_{f}"] for b, f in zip(ours, FEATURES))
        assert constant == pytest.approx(model.intercept, abs=1e-3)


def test_penalties_share_one_fit(spark):
    train = rows(spark, 200, (1,)).drop("copies")
    both = {r["penalty"]: r for r in fit_logistic(train, FEATURES, 1, [0.01, 1.0]).collect()}
    for p in (0.01, 1.0):
        alone = fit_logistic(train, FEATURES, 1, [p]).first()
        assert [alone[f"b_{n}"] for n in ("const", *FEATURES)] == pytest.approx([both[p][f"b_{n}"] for n in ("const", *FEATURES)])
    assert abs(both[1.0]["b_f1"]) < abs(both[0.01]["b_f1"])
    long = coefficients(fit_logistic(train, FEATURES, 1, [0.01]), FEATURES)
    assert {r["feature"] for r in long.collect()} == {"const", "f1", "f2"}


def test_constant_missing_and_infinite_features(spark):
    train = rows(spark, 200, (1,)).drop("copies").withColumns(
        {"same": F.lit(7.0), "none": F.lit(None).cast("double"), "f1": F.when(F.col("id") == 5, float("inf")).otherwise(F.col("f1"))}
    )
    cols = [*FEATURES, "same", "none"]
    p = fit_logistic(train, cols, 1, [0.0]).first()
    assert p["b_same"] == pytest.approx(0) and p["b_none"] == pytest.approx(0) and p["gradient"] <= 1e-9
    scored = score_logistic(train, fit_logistic(train, cols, 1, [0.0]), cols, "e", 1)
    assert scored.filter("score IS NULL OR isnan(score)").count() == 0


def test_separated_classes_and_a_single_class(spark):
    data = [(1, i, int(i >= 10), float(i)) for i in range(20)] + [(2, i, 1, float(i)) for i in range(5)]
    train = spark.createDataFrame(data, "seed int, id long, y int, f1 double")
    params = fit_logistic(train, ["f1"], 2, [0.001])
    by = {r["seed"]: r for r in params.collect()}
    assert by[1]["gradient"] <= 1e-9 and by[2]["b_f1"] is None and by[2]["rounds"] == 0
    out = score_logistic(train, params, ["f1"], "e", 2)
    assert out.filter("y <> y_pred").count() == 0
    assert out.filter("seed = 2 AND score IS NOT NULL").count() == 0
    free = fit_logistic(train.filter("seed = 1"), ["f1"], 1, [0.0]).first()
    assert math.isfinite(free["b_f1"]) and free["b_f1"] > by[1]["b_f1"]


def test_empty_training_and_bound(spark):
    train = rows(spark, 50)
    assert fit_logistic(train.filter("id < 0"), FEATURES, 4).count() == 0
    with pytest.raises(ValueError):
        fit_logistic(train, FEATURES, 3)


def test_parameters_come_back(spark, tmp_path):
    params = fit_logistic(rows(spark, 100), FEATURES, 4)
    meta = {"experiment": "e", "model": "logistic", "config": "c", "preprocessing": "p"}
    sinks.save_parameters(params, meta, str(tmp_path))
    back = sinks.load_parameters(spark, str(tmp_path), "e", "logistic", params.schema)
    assert sorted(back.collect()) == sorted(params.collect())
