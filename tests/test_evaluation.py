import math
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from holdfast.operators import fairness as J
from holdfast.operators import metrics as G
from holdfast.operators import model as M
from holdfast.operators import stability as H
from holdfast.operators import stats as I
from holdfast.plans.evaluation import gnb_metrics, gnb_predictions

PRED = "experiment string, model string, strategy string, seed int, id bigint, y int, score double, y_pred int"


def pred(spark, ys, scores, labels=None, seed=1, strategy="unbalanced"):
    labels = labels or [int(s > 0) for s in scores]
    return spark.createDataFrame(
        [("e", "m", strategy, seed, i, y, float(s), p) for i, (y, s, p) in enumerate(zip(ys, scores, labels))], PRED
    )


def values(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def test_auc_ties_and_one_class(spark):
    assert values(G.evaluate(pred(spark, [1, 1, 0, 0], [0.9, 0.5, 0.5, 0.1])))["roc_auc"] == 0.875
    only = values(G.evaluate(pred(spark, [1, 1], [0.9, 0.5])))
    assert only["roc_auc"] is None
    none = values(G.evaluate(pred(spark, [0, 0], [-1, -2])))
    assert none["f1"] == 0.0 and none["precision"] == 0.0 and none["accuracy"] == 1.0
    assert values(G.evaluate(pred(spark, [1, 0, 1, 0], [3, 3, 3, 3])))["roc_auc"] == 0.5


def test_auc_over_many_buckets_equals_pair_counting(spark):
    ys = [int(i * 7919 % 11 < 4) for i in range(300)]
    scores = [((i * 104729) % 997 - 500) * (10.0 ** ((i % 5) * 2 - 2)) for i in range(300)]
    pos = [s for s, y in zip(scores, ys) if y]
    neg = [s for s, y in zip(scores, ys) if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    got = values(G.evaluate(pred(spark, ys, scores)))["roc_auc"]
    assert got == pytest.approx(want, abs=1e-12)
    flipped = values(G.evaluate(pred(spark, ys, [-s for s in scores])))["roc_auc"]
    assert flipped == pytest.approx(1 - want, abs=1e-12)


def test_roc_points_end_at_one(spark):
    points = G.roc_points(pred(spark, [1, 0, 1, 0, 0], [2.5, 2.5, 1.0, -3.2, -7.0])).orderBy(F.desc("score")).collect()
    assert [(r["fpr"], r["tpr"]) for r in points] == [(pytest.approx(1 / 3), 0.5), (pytest.approx(1 / 3), 1.0), (pytest.approx(2 / 3), 1.0), (1.0, 1.0)]


def test_naive_bayes_by_hand(spark):
    train = spark.createDataFrame(
        [(1, "s", i, y, x, 5.0) for i, (y, x) in enumerate([(0, 1.0), (0, 3.0), (1, 6.0), (1, 10.0), (1, 8.0)])],
        "seed int, strategy string, id bigint, y int, a double, k double",
    )
    test = spark.createDataFrame([(1, 9, 1, 5.0, 5.0), (1, 10, 0, None, 5.0)], "seed int, id bigint, y int, a double, k double")
    out = {r["id"]: r for r in M.score_gnb(test, M.fit_gnb(train, ["a", "k"]), ["a", "k"], "e").collect()}
    v0, v1 = 1.0, 8 / 3
    want = math.log(3 / 2) + (-0.5 * math.log(2 * math.pi * v1) - (5 - 8) ** 2 / (2 * v1)) - (-0.5 * math.log(2 * math.pi * v0) - (5 - 2) ** 2 / (2 * v0))
    assert out[9]["score"] == pytest.approx(want) and out[9]["y_pred"] == 1
    assert out[10]["score"] == pytest.approx(math.log(3 / 2))


def test_training_without_a_class(spark):
    train = spark.createDataFrame([(1, "s", 1, 0, 2.0), (1, "s", 2, 0, 3.0)], "seed int, strategy string, id bigint, y int, a double")
    test = spark.createDataFrame([(1, 9, 1, 5.0)], "seed int, id bigint, y int, a double")
    row = M.score_gnb(test, M.fit_gnb(train, ["a"]), ["a"], "e").first()
    assert row["score"] is None and row["y_pred"] == 0


def test_scoring_rows_of_five_features_is_compiled(spark, capsys):
    """The JVM leaves methods of more than 8000 bytes to its interpreter, tens of times slower a row."""
    names = [f"f{i}" for i in range(5)]
    rows = [(1, "s", i, i % 2, *[float((i * (j + 3)) % 7) for j in range(5)]) for i in range(40)]
    train = spark.createDataFrame(rows, f"seed int, strategy string, id bigint, y int, {', '.join(f'{n} double' for n in names)}")
    params = M.fit_gnb(train, names, groups=1)
    capsys.readouterr()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the whole code is known before the run
    try:
        G.evaluate(M.score_gnb(train.drop("strategy"), params, names, "e", groups=1)).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_label_swap_keeps_accuracy(cohort):
    right = gnb_metrics(cohort, ["f1", "f2"], "e", [1, 2])
    swapped = gnb_metrics(cohort.withColumn("y", 1 - F.col("y")), ["f1", "f2"], "e", [1, 2])
    acc = lambda df: {(r["strategy"], r["seed"]): round(r["value"], 9) for r in df.filter("metric = 'accuracy'").collect()}
    assert acc(right) == acc(swapped)


def test_majority_and_library_models(spark, cohort):
    p = gnb_predictions(cohort, ["f1", "f2"], "e", [1])
    test = p.filter("strategy = 'unbalanced'").select("seed", "id").join(cohort, "id")
    train = cohort.join(test.select("id"), "id", "left_anti").withColumn("seed", F.lit(1)).withColumn("strategy", F.lit("unbalanced"))
    base = M.score_majority(test, M.fit_majority(train), "e")
    lib = M.evaluate_ml(["logistic", "forest"], train, test, [1], ["unbalanced"], ["f1", "f2"], "e")
    metrics = G.evaluate(base.unionByName(lib)).cache()
    assert metrics.filter("value < 0 or value > 1").count() == 0
    diffs = M.compare_models(metrics, "majority")
    assert {r["model"] for r in diffs.collect()} == {"logistic", "forest"} and diffs.count() == 10


def metric_rows(spark, a, b):
    rows = [("e", "m", s, i, "x", v) for s, vs in (("A", a), ("B", b)) for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "experiment string, model string, strategy string, seed int, metric string, value double")


def test_t_edge_cases(spark):
    one = H.paired(metric_rows(spark, [0.0] * 10, [1.0] + [0.0] * 9), "A", "B")
    t = I.paired_t(one).first()
    assert t["statistic"] == pytest.approx(1.0) and round(t["p_value"], 4) == 0.3434
    same = H.paired(metric_rows(spark, [0.1, 0.2, 0.3], [0.4, 0.5, 0.6]), "A", "B")
    assert I.paired_t(same).first()["p_value"] is None
    none = I.wilcoxon(H.paired(metric_rows(spark, [0.1, 0.2], [0.1, 0.2]), "A", "B")).first()
    assert none["n"] == 0 and none["p_value"] is None
    assert H.summarize(metric_rows(spark, [0.5], [0.5])).first()["sd"] is None


def test_consistency_and_corrected_t(spark):
    pairs = H.paired(metric_rows(spark, [0.1, 0.2, 0.3, 0.4], [0.2, 0.2, 0.2, 0.6]), "A", "B")
    c = H.consistency(pairs).first()
    assert (c["wins"], c["ties"], c["losses"], c["agree_share"]) == (2, 1, 1, 0.5)
    sizes = spark.createDataFrame([("e", 80.0, 20.0)], "experiment string, n_train double, n_test double")
    plain, fixed = I.paired_t(pairs).first(), I.corrected_t(pairs, sizes).first()
    assert fixed["statistic"] == pytest.approx(plain["statistic"] / math.sqrt(1 + 4 * 0.25))
    assert fixed["p_value"] > plain["p_value"]
    assert I.verdict(I.paired_t(pairs), pairs).first()["verdict"] == "no supported difference"


def test_flips_and_left_out_seeds(spark):
    p = [pred(spark, [1, 0], s, seed=i) for i, s in enumerate([[1, -1], [1, 1], [-1, 1]])]
    flips = {r["id"]: r["flip_rate"] for r in H.flip_rate(p[0].unionByName(p[1]).unionByName(p[2])).collect()}
    assert flips == {0: pytest.approx(1 / 3), 1: pytest.approx(1 / 3)}
    left = H.leave_one_seed(metric_rows(spark, [0.0, 0.3, 0.6], []), H.BY).first()
    assert (round(left["min_mean"], 6), round(left["max_mean"], 6)) == (0.15, 0.45)


def test_fairness_by_hand(spark):
    rows = [("A", 1, 1), ("A", 1, 1), ("A", 1, 0), ("A", 0, 0), ("B", 1, 1), ("B", 1, 1), ("B", 0, 1), ("B", 0, 0)]
    df = spark.createDataFrame(
        [("e", "m", "s", 1, i, y, 0.0, p, g) for i, (g, y, p) in enumerate(rows)], PRED + ", g string"
    )
    fair = {(r["grp"], r["measure"]): r["value"] for r in J.fairness(J.subgroups(df, ["g"])).collect()}
    assert fair[("A", "spd")] == -0.25
    assert fair[("A", "eod")] == pytest.approx(-1 / 3)
    assert fair[("A", "di")] == pytest.approx(2 / 3)
    named = {(r["grp"], r["measure"]): r["value"] for r in J.fairness(J.subgroups(df, ["g"], reference={"g": "B"})).collect()}
    assert named[("A", "spd")] == -0.25 and named[("B", "spd")] == 0.0
    silent = df.withColumn("y_pred", F.when(F.col("g") == "B", 0).otherwise(F.col("y_pred")))
    zero = {(r["grp"], r["measure"]): r["value"] for r in J.fairness(J.subgroups(silent, ["g"])).collect()}
    assert zero[("A", "di")] is None
    caution = J.subgroup_caution(J.subgroups(df, ["g"]), min_n=5).collect()
    assert all(r["small_group"] and 0 <= r["rate_low"] <= r["rate"] <= r["rate_high"] <= 1 for r in caution)


def test_null_attribute_is_a_group(spark):
    df = pred(spark, [1, 0], [1, 1]).withColumn("g", F.lit(None).cast("string"))
    sub = J.subgroups(df, ["g"]).first()
    assert sub["grp"] == "missing" and sub["rest_n"] == 0


def test_a_level_named_missing_is_not_null(spark):
    rows = [("e", "m", "s", 1, i, i % 2, 1, g) for i, g in enumerate([None, None, "missing", "=missing", "=missing", "=missing", "a"])]
    df = spark.createDataFrame(rows, "experiment string, model string, strategy string, seed int, id long, y int, y_pred int, g string")
    got = {r["grp"]: r["n"] for r in J.subgroups(df, ["g"]).collect()}
    assert got == {"missing": 2, "=missing": 1, "==missing": 3, "a": 1}


def test_all_models_of_a_cell_are_fitted_on_rows_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    rows = spark.range(400).select(F.lit(1).alias("seed"), F.lit("unbalanced").alias("strategy"), "id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 17).cast("double").alias("f1"))
    train = rows.withColumn("f1", counted("f1"))
    out = M.evaluate_ml(["logistic", "boosted"], train, rows, [1], ["unbalanced"], ["f1"], "e")
    assert made.value == 400
    assert {(r["model"], r["n"]) for r in out.groupBy("model").agg(F.count("*").alias("n")).collect()} == {("logistic", 400), ("boosted", 400)}


@pytest.mark.parametrize("memory, most", [(1, 1), (2 * 40 * M.FIT_BYTES, 2), (None, 4)])
def test_no_more_models_are_fitted_at_a_time_than_memory_holds(spark, monkeypatch, memory, most):
    rows = [(seed, s, i, i % 2, float(i * (3 + seed) % 7)) for seed in (1, 2) for s in ("a", "b") for i in range(40)]
    train = spark.createDataFrame(rows, "seed int, strategy string, id bigint, y int, f1 double")
    test = train.filter("strategy = 'a'").drop("strategy")
    lock, now, seen = threading.Lock(), [], []

    def fit(kind, *args):
        with lock:
            now.append(kind)
            seen.append(len(now))
        time.sleep(1)
        out = fit_ml(kind, *args)
        now.remove(kind)
        return out

    fit_ml = M.fit_ml
    monkeypatch.setattr(M, "fit_ml", fit)
    if memory:
        monkeypatch.setattr(M, "storage_bytes", lambda spark: memory)
    out = M.evaluate_ml(["logistic"], train, test, [1, 2], ["a", "b"], ["f1"], "e")
    assert len(seen) == 4 and max(seen) == most
    assert out.count() == 4 * 40
