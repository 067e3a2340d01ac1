"""Pipeline stages on odd rows, repeated ids and empty tables."""

from collections import Counter

import corpus_pipeline as p
import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, size int, taken string, _id int, _row map<string,int>"
SAME = "one and the same text that several of the rows below hold word for word"
OTHER = "quite another text about rivers and fields that nobody else has written down yet"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Labels and benchmark items with nulls, as files."""
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None), (900, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu"), (None, None), (3, "")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (5, SAME, "en", "a"), (3, SAME, "en", "a"), (3, SAME, "en", "a"), (3, SAME, "de", "b"), (7, SAME, None, "a"), (7, OTHER, "en", None),
        (None, SAME, "en", "a"), (None, "only a row without an id says this and nothing more than this", "en", "b"),
        (None, "only a row without an id says this and nothing more than this", "en", "b"), (8, None, "en", "b"), (9, "", None, None), (10, " \t", "en", "b"),
        (11, LONG, "en", "c"), (12, "so alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu it is", "en", "c"), (None, None, None, None),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), k, k, "t", 1, {"k": k}) for k, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("name", [name for name, _ in p.STAGES])
def test_stage_of_odd_and_empty_tables(spark, docs, tables, name):
    stage = dict(p.STAGES)[name]
    got, empty = stage(spark, docs, tables), stage(spark, docs.where("false"), tables)
    assert got.count() > 0 and empty.count() == 0
    if name != "sharding":
        assert got.columns == empty.columns == docs.columns


def test_one_of_each_group_stays(spark, docs, tables):
    got = sorted(((r.doc_id, r.text, r.lang) for r in p.drop_near_copies(spark, docs, tables).collect()), key=repr)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = [(3, SAME, "de"), (7, OTHER, "en"), (None, "only a row without an id says this and nothing more than this", "en"), (8, None, "en"), (11, LONG, "en"), (12, texts[12], "en")]
    assert got == sorted(want, key=repr)


def test_leaks_go_and_the_rest_stays(spark, docs, tables):
    got = [r.doc_id for r in p.drop_leaks(spark, docs, tables).collect()]
    assert 12 not in got and len(got) == docs.count() - 1


def test_mix_writes_whole_documents(spark, docs, tables):
    got = p.mix_sources(spark, docs, tables).collect()
    given = {repr(r) for r in docs.collect()}
    assert {repr(r) for r in got} <= given
    by = lambda rows, f: {s: sum(f(r) for r in rows if r.source == s) for s in {r.source for r in rows}}
    size, taken = by(docs.collect(), lambda r: len((r.text or "").split())), by(got, lambda r: len((r.text or "").split()))
    # a source is never taken more than twice, nor any document
    assert all(taken[s] <= 2 * size[s] for s in taken)
    assert max(Counter(map(repr, got)).values()) <= 2 * max(Counter(map(repr, docs.collect())).values())
