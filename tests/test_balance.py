import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import audit as A
from holdfast.operators.balance import balance, balance_report, unbalanced_and_even
from holdfast.operators.split import holdout


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1, i, int(i >= 5), float(i)) for i in range(7)], "seed int, id bigint, y int, f double")


def counts(df):
    return {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}


def test_even_copies(small):
    out = balance(small, "even")
    assert counts(out) == {0: 5, 1: 5}
    copies = sorted(r["count"] for r in out.filter("y = 1").groupBy("id").count().collect())
    assert copies == [2, 3]
    assert out.filter("copy_no = 0").count() == 7


def test_replacement_reaches_the_largest_class(small):
    out = balance(small, "replace", 2)
    assert counts(out) == {0: 5, 1: 5}
    assert out.filter("copy_no = 0").count() == 7
    assert out.groupBy("id", "copy_no").count().filter("count > 1").count() == 0


def test_weights_do_not_add_rows(small):
    out = balance(small, "weight", 2)
    assert {(r["y"], r["weight"]) for r in out.collect()} == {(0, 1.0), (1, 2.5)}


def test_synthetic_rows_lie_between_rows_of_their_class(spark):
    rng = np.random.default_rng(1)
    for n, small in ((60, 12), (3000, 900)):
        x = rng.normal(size=(n, 3))
        rows = [(1, i, int(i < small), *map(float, x[i])) for i in range(n)]
        train = spark.createDataFrame(rows, "seed int, id bigint, y int, a double, b double, c double")
        out = balance(train, "interpolated", 2, ["a", "b", "c"])
        assert counts(out) == {0: n - small, 1: n - small}
        made = out.filter("synthetic").collect()
        assert len(made) == n - 2 * small
        for r in made[:300]:
            base, point = x[r["id"]], np.array([r["a"], r["b"], r["c"]])
            d = x[:small] - base
            size = (d * d).sum(1)
            step = np.clip((d @ (point - base)) / np.where(size > 0, size, 1), 0, 1)
            assert np.abs(base + step[:, None] * d - point).max(1).min() < 1e-9


def test_synthetic_keeps_nulls_and_survives_equal_vectors(spark):
    rows = [(1, i, int(i < 40), 1.0 if i % 2 else None, 2.0) for i in range(130)]
    train = spark.createDataFrame(rows, "seed int, id bigint, y int, a double, b double")
    out = balance(train, "synthetic", 2, ["a", "b"])
    assert counts(out) == {0: 90, 1: 90} and out.filter("a <> 1.0 or b <> 2.0 or b is null").count() == 0
    made = out.filter("synthetic")
    assert 0 < made.filter("a is null").count() < made.count()
    assert made.filter("a is not null and id % 2 = 0").count() == 0


def test_only_training_ids_are_balanced(cohort):
    splits = holdout(cohort, [1, 2])
    train = splits.filter("split = 'train'").drop("split")
    sets = unbalanced_and_even(train, 4)
    assert A.audit_balance(sets, splits).count() == 0
    report = balance_report(splits, sets, ["unbalanced", "oversampled"]).collect()
    assert all(r["n_after"] == r["n_before"] for r in report if r["side"] == "test" or r["strategy"] == "unbalanced")
    assert {r["n_after"] for r in report if r["side"] == "train" and r["strategy"] == "oversampled"} == {112}


def test_both_strategies_in_one_pass_equal_the_single_ones(cohort):
    train = holdout(cohort, [1, 2]).filter("split = 'train'").drop("split")
    cols = ["seed", "strategy", "id", "y", "copy_no"]
    both = unbalanced_and_even(train, 4).select(*cols)
    single = balance(train, "none").select(*cols).unionByName(balance(train, "even", 4).select(*cols))
    assert both.exceptAll(single).count() == 0 and single.exceptAll(both).count() == 0


def nearest(x, ids, i, k):
    d = np.zeros(len(x))
    for f in range(x.shape[1]):
        d += (x[:, f] - x[i, f]) * (x[:, f] - x[i, f])
    order = [j for j in np.lexsort((ids, d)) if j != i]
    return order[:k]


@pytest.mark.parametrize("kind", ["normal", "grid", "copies"])
def test_synthetic_rows_lie_towards_a_nearest_neighbour(spark, kind):
    rng = np.random.default_rng(5)
    n, small = 5_200, 2_000
    x = rng.normal(size=(n, 3))
    if kind == "grid":
        x = np.round(x * 2) + 0.0
    if kind == "copies":
        x[:700] = x[0]
    rows = [(1, i, int(i < small), *map(float, x[i])) for i in range(n)]
    train = spark.createDataFrame(rows, "seed int, id bigint, y int, a double, b double, c double")
    out = balance(train, "synthetic", 2, ["a", "b", "c"])
    assert counts(out) == {0: n - small, 1: n - small}
    ids = np.arange(small)
    for r in out.filter("synthetic").collect():
        base, point = x[r["id"]], np.array([r["a"], r["b"], r["c"]])
        d = x[nearest(x[:small], ids, r["id"], 5)] - base
        size = (d * d).sum(1)
        step = np.clip((d @ (point - base)) / np.where(size > 0, size, 1), 0, 1)
        assert np.abs(base + step[:, None] * d - point).max(1).min() < 1e-9


@pytest.mark.parametrize("cell_rows", [20, 300])
def test_nearest_nodes_over_many_cells_equal_brute_force(spark, cell_rows):
    from holdfast.operators.neighbours import nearest_nodes, nodes_of

    rng = np.random.default_rng(6)
    groups = {0: rng.normal(size=(900, 2)), 1: np.round(rng.normal(size=(700, 2)), 1), 2: np.ones((5, 2)), 3: rng.normal(size=(1, 2)), 4: np.c_[rng.random(600), np.zeros(600)] ** 8}
    rows = [(g, i * 3 + g, *map(float, v)) for g, x in groups.items() for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "g int, id bigint, a double, b double")
    nodes = nodes_of(frame, ["g"], ["a", "b"], 4)
    got = {}
    for r in nearest_nodes(nodes, ["g"], 4, 5, cell_rows).collect():
        got.setdefault((r["g"], r["node"]), []).append((r["d"], r["id"]))
    for r in nodes.collect():
        x = groups[r["g"]]
        d = (x[:, 0] - r["v"][0]) ** 2 + (x[:, 1] - r["v"][1]) ** 2
        want = sorted((float(d[i]), i * 3 + r["g"]) for i in range(len(x)))[:4]
        assert sorted(got[r["g"], r["node"]]) == want


@pytest.mark.parametrize("cell_rows", [20, 300])
def test_lists_hold_the_nearest_rows_of_every_set(spark, cell_rows):
    """Overlapping, disjoint and tiny sets, copies, repeated ids and an id without a value."""
    from holdfast.operators.neighbours import nearest_lists, nodes_of

    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(500, 2)), 1)
    x[:40] = x[0]
    sets = {s: np.nonzero(rng.random(500) < 0.8)[0] for s in range(4)} | {4: np.arange(0, 500, 9), 5: np.array([3, 77])}
    rows = [(1, s, int(i), *map(float, x[i])) for s, members in sets.items() for i in members] + [(1, 0, None, 0.5, 9.0), (1, 0, int(sets[0][0]), *map(float, x[sets[0][0]]))]
    frame = spark.createDataFrame(rows, "y int, seed int, id bigint, a double, b double")
    lists = nearest_lists(nodes_of(frame, ["y"], ["a", "b"], 4, within="seed"), ["y"], 4, 2, cell_rows).collect()
    nodes = {r["node"]: r for r in nodes_of(frame, ["y"], ["a", "b"], 4, within="seed").collect()}
    assert len(lists) == len(nodes)
    for r in lists:
        v = nodes[r["node"]]["v"]
        for s in nodes[r["node"]]["inside"]:
            here = [row for row in rows if row[1] == s and row[2] is not None]
            want = sorted(((a - v[0]) ** 2 + (b - v[1]) ** 2, i) for _, _, i, a, b in here)[:4]
            assert [(n["d"], n["id"]) for n in r["near"] if s in n["of"]][:4] == want


def test_seeds_share_the_search_and_no_row_carries_its_group(spark, monkeypatch):
    from holdfast.operators import neighbours as N

    rng = np.random.default_rng(8)
    x = rng.normal(size=(3_000, 2))
    rows = [(s, i, int(i < 1_000), *map(float, x[i])) for s in range(8) for i in range(len(x))]
    train = spark.createDataFrame(rows, "seed int, id bigint, y int, a double, b double")
    settle, tables = N.settle, []

    def kept(df, bound=None):
        out = settle(df, bound)
        tables.append((df.columns, out.count()))
        return out

    monkeypatch.setattr(N, "settle", kept)
    assert balance(train, "synthetic", 16, ["a", "b"]).filter("synthetic").count() == 8 * 1_000
    for columns, n in tables:
        assert "node" not in columns or (n <= 2_000 and not {"to", "rings", "cells"} & set(columns)), (columns, n)


def test_lists_name_neighbours_by_number_and_copies_hold_few_ids(spark):
    from holdfast.operators.neighbours import nearest_lists, nodes_of

    rng = np.random.default_rng(9)
    x = [(1.0, 2.0)] * 400 + [(float(a), float(b)) for a, b in rng.normal(size=(50, 2))]
    rows = [(1, s, i, *x[i]) for s in range(5) for i in range(450) if rng.random() < 0.8] + [(1, 0, None, 1.0, 2.0), (1, 0, 3, 1.0, 2.0)]
    frame = spark.createDataFrame(rows, "y int, seed int, id bigint, a double, b double")
    nodes = nodes_of(frame, ["y"], ["a", "b"], 4, within="seed")
    held = {r["nr"]: r for r in nodes.collect()}
    hot = max(held.values(), key=lambda r: len(r["ids"]))
    least = {(s, i) for s in range(5) for i in sorted(r[2] for r in rows if r[1] == s and r[2] is not None and r[2] < 400)[:4]}
    assert {i for _, i in least} == set(hot["ids"]) and len(held) == 51
    for r in nearest_lists(nodes, ["y"], 4, 2).collect():
        assert all(n["id"] in held[n["other"]]["ids"] for n in r["near"])


def test_rows_of_a_hot_content_are_dealt_out_and_lists_are_not_stored(spark, monkeypatch):
    from holdfast.operators import balance as B
    from holdfast.operators import neighbours as N

    rng = np.random.default_rng(10)
    x = np.round(rng.normal(size=(900, 2)), 2)
    x[:100] = x[0]
    rows = [(s, i, int(i < 300), *map(float, x[i])) for s in (1, 2) for i in range(len(x)) if (i + s) % 5]
    train = spark.createDataFrame(rows, "seed int, id bigint, y int, a double, b double")
    want = sorted(map(str, balance(train, "synthetic", 4, ["a", "b"]).collect()))
    settle, stored = N.settle, []
    monkeypatch.setattr(N, "settle", lambda df, bound=None: (stored.append(df.columns), settle(df, bound))[1])
    monkeypatch.setattr(B, "HOT_COPIES", 50)
    assert sorted(map(str, balance(train, "synthetic", 4, ["a", "b"]).collect())) == want
    assert stored and not any("near" in columns for columns in stored)
