import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.functions.expr import draw_key, erf, normal_p, student_t_p
from holdfast.operators import primitives as P


def keyed(spark, n, groups=3):
    return spark.range(n).select(
        "id", (F.col("id") % groups).cast("int").alias("g"), draw_key(F.lit(1), "t", F.col("id")).alias("key")
    )


def plain(rows, k):
    out = set()
    for g in {r["g"] for r in rows}:
        mine = sorted((r["key"], r["id"]) for r in rows if r["g"] == g)
        out |= {i for _, i in mine[: k[g]]}
    return out


@pytest.mark.parametrize("want", [(1, 500, 999), (0, 1000, 5000)])
def test_take_k_is_the_plain_order(spark, want):
    df = keyed(spark, 3000)
    quota = spark.createDataFrame([(g, 1000, want[g]) for g in range(3)], "g int, n bigint, k bigint")
    got = {r["id"] for r in P.take_k(df, ["g"], quota, groups=3).collect()}
    assert got == plain(df.collect(), want)


def test_within_threshold_with_ties_and_nulls(spark):
    rows = [(k, t, tk, tt) for k in ("a", "b", None) for t in (1, 2, None) for tk in ("a", "b", None) for tt in (1, 2, None)]
    df = spark.createDataFrame(rows, "key string, tie bigint, thr_key string, thr_tie bigint")
    plain = F.expr("CASE WHEN thr_key IS NULL THEN false ELSE key < thr_key OR (key = thr_key AND tie <= thr_tie) END")
    got = df.select(P.within_threshold(F.col("key"), F.col("tie")).alias("got"), plain.alias("want")).collect()
    assert len(got) == 81 and all(r["got"] == r["want"] for r in got)


def test_take_k_without_a_group_bound_and_through_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_ROWS", 1)
    df = keyed(spark, 600)
    quota = spark.createDataFrame([(g, 200, 50) for g in range(3)], "g int, n bigint, k bigint")
    got = {r["id"] for r in P.take_k(df, ["g"], quota).collect()}
    assert got == plain(df.collect(), (50, 50, 50))


def test_repeated_keys_fall_back_to_the_histogram(spark):
    # One key held by every row: no bracket can hold the rank, ids decide.
    df = spark.range(500).select("id", F.lit(0).alias("g"), F.md5(F.lit("same")).alias("key"))
    quota = spark.createDataFrame([(0, 500, 100)], "g int, n bigint, k bigint")
    assert {r["id"] for r in P.take_k(df, ["g"], quota, groups=1).collect()} == set(range(100))


def test_prefix_sum_over_buckets(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id", F.floor(F.col("id") / 64).alias("b"), F.lit(1).alias("v"))
    out = P.prefix_sum(df, ["g"], "b", [F.col("id")], {"v": "cum"}).collect()
    assert all(r["cum"] == r["id"] // 2 + 1 for r in out)


@pytest.mark.parametrize("hot", [5, 10**6])
def test_lookup_with_a_hot_key(spark, hot):
    # Key 0 holds a third of all rows; key 99 is not in the dimension.
    big = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") == 1, 99).otherwise(F.col("id") % 7 + 1).alias("k"))
    dim = big.filter("k <> 99").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10)
    out = P.lookup(big, dim, "k", "n", hot=hot).collect()
    assert len(out) == 300
    assert all(r["v"] == (None if r["k"] == 99 else r["k"] * 10) for r in out)


@pytest.mark.parametrize("most", [1_000_000, 1_500])
def test_percentiles_are_exact_on_skewed_values(spark, monkeypatch, most):
    monkeypatch.setattr(P, "RANGE_ROWS", most)
    rng = np.random.default_rng(0)
    x = np.concatenate([np.full(4000, 7.0), rng.normal(0, 100, 6001), [1e12, -1e12]])
    y = rng.exponential(1.0, x.size)
    df = spark.createDataFrame([(i % 2, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "g int, x double, y double")
    ps = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["feature"], r["p"]): r["value"] for r in P.exact_percentiles(df, ["g"], ["x", "y"], ps, groups=2).collect()}
    assert len(got) == 20
    for g in (0, 1):
        for name, v in (("x", x), ("y", y)):
            for p in ps:
                assert got[(g, name, p)] == pytest.approx(np.percentile(v[g::2], 100 * p), rel=1e-12)


@pytest.mark.parametrize("most", [1_000_000, 300])
def test_repeated_keys_and_ties_are_counted(spark, monkeypatch, most):
    # Group 0: one key for all rows; group 1: two keys, every id eight times.
    monkeypatch.setattr(P, "RANGE_ROWS", most)
    data = [(0, "a" * 32, i) for i in range(4000)] + [(1, "0f"[i % 2] * 32, i // 16) for i in range(4000)]
    df = spark.createDataFrame(data, "g int, key string, id long")
    for k in (1, 1999, 2001, 4000):
        quota = spark.createDataFrame([(g, 4000, k) for g in (0, 1)], "g int, n long, k long")
        got = {r["g"]: (r["thr_key"], r["thr_tie"]) for r in P.kth_key(df, ["g"], quota, F.col("key"), "id", 2).collect()}
        for g in (0, 1):
            assert got[g] == sorted(x[1:] for x in data if x[0] == g)[k - 1]


@pytest.mark.parametrize("limit", [100_000, 50])
def test_level_tables_of_any_size(spark, monkeypatch, limit):
    # A third of the rows hold one known level, a third one unknown level, the rest are rare.
    monkeypatch.setattr(P, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(P, "HOT_LEVELS", 5)
    rare = F.concat(F.lit("r"), F.col("id").cast("string"))
    big = spark.range(3000).select(
        "id",
        (F.col("id") % 2).cast("int").alias("seed"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "new").otherwise(rare).alias("level"),
    )
    known = big.filter("level <> 'new' AND id % 5 <> 4").select("seed", "level").distinct().withColumn("v", F.length("level") + F.col("seed"))
    want = {(r["seed"], r["level"]): r["v"] for r in known.collect()}
    out = P.join_levels(big, known, ["seed"], "level", "v")
    rows = out.collect()
    assert len(rows) == 3000 and out.columns == ["id", "seed", "level", "v"]
    assert all(r["v"] == want.get((r["seed"], r["level"])) for r in rows)


def test_two_hundred_thousand_levels(spark):
    big = spark.range(300_000).select("id", F.lit(1).alias("seed"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("level"))
    known = big.select("seed", "level").distinct().withColumn("v", F.crc32("level"))
    out = P.join_levels(big, known, ["seed"], "level", "v")
    assert out.filter("v IS NULL OR v <> crc32(level)").count() == 0 and out.count() == 300_000


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 100)
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), "id", F.lit(1).cast("bigint").alias("one"))
    ranged = P.range_buckets(rows, ["g"], [F.col("id")], "bucket")
    sizes = [r["count"] for r in ranged.groupBy("bucket").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 400
    out = P.prefix_sum(rows, ["g"], None, [F.col("id")], {"one": "run"})
    assert out.filter("run <> id div 2 + 1").count() == 0 and out.count() == 3000


def test_p_values(spark):
    row = spark.range(1).select(
        student_t_p(F.lit((9 / 14) ** 0.5), F.lit(9)).alias("t9"),
        student_t_p(F.lit(1.0), F.lit(1)).alias("t1"),
        student_t_p(F.lit(2.0), F.lit(2)).alias("t2"),
        normal_p(F.sqrt(F.lit(2 / 3))).alias("z"),
        normal_p(F.lit(1.0)).alias("z1"),
        normal_p(F.lit(40.0)).alias("far"),
        erf(F.lit(0.5)).alias("e"),
    ).first()
    assert round(row["t9"], 6) == 0.443332
    assert row["t1"] == pytest.approx(0.5)
    assert row["t2"] == pytest.approx(0.183503, abs=1e-6)
    assert round(row["z"], 6) == 0.414216 and round(row["z1"], 6) == 0.317311
    assert row["far"] == pytest.approx(0.0, abs=1e-12) and row["e"] == pytest.approx(0.5204998778)
