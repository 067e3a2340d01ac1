import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.operators import similarity as X


def plain_sets(texts, words=5):
    out = []
    for t in texts:
        w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
        out.append(frozenset(" ".join(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))) if w else None)
    return out


def near_texts(seed):
    rng = np.random.default_rng(seed)
    texts = [None, "", "--", "one two", "One, TWO", "one two three", "a b c d e", "a b c d e f"]
    for g in range(12):
        base = [f"w{int(x)}" for x in rng.integers(0, 60 if g % 2 else 5000, int(rng.integers(5, 120)))]
        for _ in range(int(rng.integers(1, 9))):
            new = list(base)
            for _ in range(int(rng.integers(0, 5))):
                new[int(rng.integers(0, len(new)))] = f"x{int(rng.integers(0, 3))}"
            texts.append(" ".join(new))
    frame = "the same frame of words that every one of these texts begins with, long enough to be a hot prefix "
    texts += [frame + " ".join(f"y{(i // 3) * 7 + j}" for j in range(2 + i % 3)) for i in range(40)]
    return texts + texts[8:20]


@pytest.mark.parametrize("t", [0.5, 0.8, 0.9])
@pytest.mark.parametrize("hot", [3, 2_000])
def test_all_similar_pairs_are_found(spark, monkeypatch, t, hot):
    monkeypatch.setattr(X, "HOT", hot)
    texts = near_texts(1)
    sets = plain_sets(texts)
    rows = spark.createDataFrame([(i, s, "x") for i, s in enumerate(texts)], "id int, text string, content string")
    members, contents = X.contents_of(rows, "text")
    of = {r["id"]: r["content"] for r in members.collect()}
    assert set(of) == {i for i, s in enumerate(sets) if s}
    assert len(set(of.values())) == len({s for s in sets if s})
    got = {frozenset((r["a"], r["b"])): r["similarity"] for r in X.similar_contents(contents, t).collect()}
    want = {}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and a != b and len(a & b) >= round(t * 1000) * len(a | b) / 1000 - 1e-9:
                want[frozenset((of[i], of[j]))] = len(a & b) / len(a | b)
    assert want and got == pytest.approx(want)


def test_texts_that_share_a_third_are_no_near_copies(spark):
    """What band signatures alone report by chance is told apart here."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        w = [f"w{int(x)}" for x in rng.integers(0, 10**6, 60)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:34] + [f"v{int(x)}" for x in rng.integers(0, 10**6, 26)]))]
    cohort = spark.createDataFrame(rows, "id int, text string")
    splits = cohort.select(F.lit(1).alias("seed"), "id", F.when(F.col("id") % 2 == 0, "test").otherwise("train").alias("split"))
    assert X.audit_jaccard(splits, cohort, "text").isEmpty()
    assert X.audit_jaccard(splits, cohort, "text", 0.3).count() == 60


def test_audit_counts_copies_without_pairing_them(spark):
    w = [f"w{i}" for i in range(100)]
    near = " ".join(w[:50] + ["other"] + w[51:])
    rows = [(i, " ".join(w)) for i in range(300)] + [(1000 + i, near) for i in range(50)] + [(2000, None), (2001, "alone in the world of texts")]
    cohort = spark.createDataFrame(rows, "id int, text string")
    splits = cohort.select(F.lit(1).alias("seed"), "id", F.when((F.col("id") % 3 == 0) | (F.col("id") >= 1000), "test").otherwise("train").alias("split"))
    got = sorted((r["n_test"], r["n_train"], r["n_near_train"], round(r["similarity"], 4)) for r in X.audit_jaccard(splits, cohort, "text").collect())
    assert got == [(50, 0, 200, round(91 / 101, 4)), (100, 200, 0, 1.0)]
    assert X.audit_jaccard(splits.limit(0), cohort.limit(0), "text").isEmpty()


def test_known_contents_are_not_made_again(spark, monkeypatch):
    texts = near_texts(3)
    cohort = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    splits = cohort.select(F.lit(1).alias("seed"), "id", F.when(F.col("id") % 2 == 0, "test").otherwise("train").alias("split"))
    want = sorted(map(tuple, X.audit_jaccard(splits, cohort, "text").collect()))
    known = X.contents_of(cohort, "text")
    monkeypatch.setattr(X, "contents_of", None)
    assert want and sorted(map(tuple, X.audit_jaccard(splits, cohort, "text", known=known).collect())) == want


@pytest.mark.parametrize("buckets", [1, 64, 1 << 22])
def test_any_order_of_shingles_gives_the_same_pairs(spark, monkeypatch, buckets):
    monkeypatch.setattr(X, "BUCKETS", buckets)
    monkeypatch.setattr(X, "NAMED", 3 if buckets == 64 else 1_000_000)
    rows = spark.createDataFrame(list(enumerate(near_texts(4))), "id int, text string").repartition(5)
    members, contents = X.contents_of(rows, "text")
    of = {r["id"]: r["content"] for r in members.collect()}
    assert contents.count() == len(set(of.values()))
    sets = {of[i]: s for i, s in enumerate(plain_sets(near_texts(4))) if s}
    want = {frozenset((a, b)) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9}
    got = [frozenset((r["a"], r["b"])) for r in X.similar_contents(contents).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_whole_sets_are_stored_once_and_stay_in_their_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 10**6, 80))) for i in range(200)]
    cohort = spark.createDataFrame(rows + [(200 + i, t) for i, t in rows[:20]], "id int, text string")
    settle, stored = X.settle, []

    def kept(df, bound=None):
        out = settle(df, bound)
        stored.append((df.columns, out.count()))
        return out

    monkeypatch.setattr(X, "settle", kept)
    contents = X.contents_of(cohort, "text")[1]
    assert X.similar_contents(contents).isEmpty()
    assert [n for columns, n in stored if "tokens" in columns] == [220]
    assert "Exchange hashpartitioning" not in contents._jdf.queryExecution().executedPlan().toString()
    assert X.prefixes(contents, 0.8).isEmpty()


def test_sets_that_share_a_line_are_not_compared(spark, monkeypatch):
    """A line of thirty words in texts of a hundred others is no reason to bring whole sets together."""
    rng = np.random.default_rng(6)
    line = " ".join(f"v{i}" for i in range(30))
    rows = [(i, f"{line} " + " ".join(f"w{int(x)}" for x in rng.integers(0, 10**6, 100))) for i in range(60)]
    rows.append((60, rows[0][1] + " more"))
    settle, pairs = X.settle, []

    def kept(df, bound=None):
        out = settle(df, bound)
        if df.columns == ["a", "b"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(X, "settle", kept)
    monkeypatch.setattr(X, "BUCKETS", 1)  # the line is not told from other words
    contents = X.contents_of(spark.createDataFrame(rows, "id int, text string"), "text")[1]
    assert X.similar_contents(contents).count() == 1 and pairs == [1]
