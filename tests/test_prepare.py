import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdfast.operators import prepare as P
from holdfast.operators import provenance as L
from holdfast.operators import transform as D
from holdfast.session import new_path
from holdfast.sources import sinks
from holdfast.sources.cohort import CohortError, CohortSpec, experiment_grid, load_cohort, seed_table


def test_cohort_checks(spark, make):
    spec = CohortSpec(
        T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType())]),
        "k",
        "case s when 'p' then 1 when 'n' then 0 end",
    )
    def stored(rows):
        path = new_path(spark, "cohort")
        make(rows, "k bigint, s string").write.parquet(path)
        return path

    assert load_cohort(spark, stored([(1, "p"), (2, "n")]), spec).count() == 2
    for rows in ([(1, "p"), (1, "n")], [(None, "p")], [(1, "?")]):
        with pytest.raises(CohortError):
            load_cohort(spark, stored(rows), spec)


def test_clean(make):
    df = make([(1, " A ", "5"), (2, "a", "5"), (3, "n/a", "x")], "id bigint, s string, n string")
    out = P.clean(df, {"s": P.Rule(lower=True, sentinels=("n/a",)), "n": P.Rule(cast="int")}, "id").collect()
    assert {tuple(r) for r in out} == {(1, "a", 5), (3, None, None)}


def test_attrition_with_a_null_criterion(make):
    df = make([(1, 5), (2, None), (3, 50), (4, 7)], "id bigint, age int")
    kept, table = P.apply_criteria(df, [("adult", "age > 5"), ("not old", "age < 40")])
    assert [r["id"] for r in kept.collect()] == [4]
    assert [(r["n_excluded"], r["n_left"]) for r in table.orderBy("step").collect()] == [(2, 2), (1, 1)]


def test_pii_and_release(make):
    df = make([("d1", "mail a.b@c.org"), ("d1", "call 555-123-4567"), ("d2", "nothing")], "dataset string, t string")
    hits = {r["pattern"]: r["n_hits"] for r in P.pii_scan(df, ["t"]).collect()}
    assert hits["email"] == 1 and hits["phone"] == 1 and hits["id_number"] == 0
    ok = make([("d1", True), ("d2", False)], "dataset string, approved boolean")
    out = P.release_view(df, ok, ["t"])
    assert out.columns == ["t"] and out.count() == 2


def test_constant_feature_and_unseen_level(make):
    train = make([(1, 1, 2.0, None, "a"), (1, 0, 2.0, 4.0, "b"), (1, 0, 2.0, 6.0, "b")], "seed int, y int, c double, m double, g string")
    test = make([(1, 1, 3.0, None, "zz"), (1, 0, 2.0, 7.0, "b")], "seed int, y int, c double, m double, g string")
    fill = D.fit_impute(train, ["c", "m"])
    filled = D.apply_params(train, fill, ["c", "m"]).drop("c_missing", "m_missing")
    out = D.apply_params(test, fill.unionByName(D.fit_scale(filled, ["c", "m"])), ["c", "m"]).collect()
    assert [(r["c"], r["m_missing"]) for r in out] == [(0.0, 1), (0.0, 0)]
    assert out[0]["m"] == 0.0
    codes = D.apply_encode(test, D.fit_encode(train, ["g"], "ordinal"), ["g"]).collect()
    assert [r["g_code"] for r in codes] == [-1.0, 1.0]
    hot = D.one_hot(test, D.fit_encode(train, ["g"], "onehot"), "g", ["a", "b"]).collect()
    assert [(r["g_a"], r["g_b"], r["g_other"]) for r in hot] == [(0, 0, 1), (0, 1, 0)]


def test_mode_tie_and_selection(make):
    train = make([(1, 0, 3.0, 1.0), (1, 0, 2.0, 1.0), (1, 1, 3.0, 9.0), (1, 1, 2.0, 8.0)], "seed int, y int, a double, b double")
    assert D.fit_impute(train, ["a"], "mode").first()["value"] == 2.0
    for score in ("pearson", "anova", "variance"):
        assert [r["feature"] for r in D.fit_select(train, ["a", "b"], 1, score).collect()] == ["b"]


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    first = L.fingerprint(df).first()
    assert L.fingerprint(df.repartition(7)).first() == first
    assert L.fingerprint(df.unionByName(df.limit(1))).first() != first
    assert L.fingerprint(df.withColumn("s", F.coalesce("s", F.lit("")))).first() != first
    assert L.fingerprint(df.filter("false")).first()["n_rows"] == 0


def test_rerun_diff_counts_multiplicity(make):
    a = make([(1, "x"), (1, "x"), (2, None)], "k int, v string")
    b = make([(1, "x"), (2, None), (3, "z")], "k int, v string")
    assert {tuple(r) for r in L.rerun_diff(a, b).collect()} == {(1, "x", "only_a", 1), (3, "z", "only_b", 1)}


def test_evidence_precedence(make):
    df = make(
        [("q", "r1", 0.9, True, False, 9), ("q", "r2", 0.8, True, True, 1), ("q", "r3", 0.7, True, True, 2), ("q", "r4", 0.6, False, True, 99)],
        "metric string, result_id string, value double, corrected boolean, leakage_safe boolean, version int",
    )
    assert L.resolve_evidence(df, ["metric"]).first()["result_id"] == "r3"


def test_sinks(spark, cohort):
    from holdfast.operators.metrics import evaluate
    from holdfast.plans.evaluation import gnb_predictions

    pred = gnb_predictions(cohort, ["f1"], "e", [1, 2])
    back = sinks.write_predictions(pred, new_path(spark, "p"))
    assert back.count() == 160
    metrics = evaluate(back)
    path = new_path(spark, "m")
    rows = sinks.manifest_rows(metrics, "script", "frac=0.2", "fp")
    assert sinks.append_manifest(rows, path).count() == 2
    again = sinks.append_manifest(rows, path)
    assert again.count() == 4 and again.select("result_id").distinct().count() == 2
    with pytest.raises(ValueError):
        sinks.write_results(metrics, "posters", path)
    stored = sinks.store(cohort, "c")
    assert stored.count() == 200 and len(stored.inputFiles()) >= 2


def test_seeds_and_grid(spark):
    path = new_path(spark, "seeds")
    seed_table(spark, [3, 5]).coalesce(1).write.option("header", True).csv(path)
    seeds = seed_table(spark, path)
    assert sorted(r["seed"] for r in seeds.collect()) == [3, 5]
    grid = experiment_grid(seeds, ["a", "b"], ["m"], [{"x": "1"}, {"x": "2"}])
    assert grid.count() == 8 and grid.select("cell").distinct().count() == 8


@pytest.mark.parametrize("groups", [None, 4])
def test_mode_is_chosen_among_one_value_of_each_count(make, groups):
    rows = [(1, 2.0), (1, 2.0), (1, 1.0), (1, 1.0), (1, 9.0), (1, None), (2, -1.0), (2, 5.0), (3, None), (4, float("nan")), (4, float("nan")), (4, 0.0)]
    mode = D.fit_impute(make(rows, "seed int, a double"), ["a"], "mode", groups=groups)
    got = {r["seed"]: r["value"] for r in mode.collect()}
    assert got[1] == 1.0 and got[2] == -1.0 and 3 not in got and got[4] != got[4]
    plan = mode._jdf.queryExecution().executedPlan().toString()
    assert any("_n#" in line.split("functions=")[0] for line in plan.splitlines() if "HashAggregate(keys=" in line)
