"""The registered queries on the given tables."""

import os

import brute
import pytest
from compare import compare, duck

from holdfast.llm.oracle import ORACLES
from holdfast.llm.mixing import mix_strata
from holdfast.llm.queries import QUERIES, quality_weights


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLES[name]) == ""


def test_op10_equals_brute_force(spark, sf_dir, documents):
    got = [tuple(r) for r in QUERIES["op10_repeated_passages"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(brute.passages(documents))


def test_op1_equals_brute_force(spark, sf_dir, documents):
    prints = [brute.simhash(t) for _, t in documents]
    root = brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for (i, _), r in zip(documents, root):
        low[r] = min(low.get(r, i), i)
    got = [tuple(r)[:3] for r in QUERIES["op1_simhash_groups"](spark, sf_dir).collect()]
    assert sorted(got) == sorted((i, f"{p:016x}", low[r]) for (i, _), p, r in zip(documents, prints, root))


def test_op9_slots(spark, sf_dir, documents):
    got = QUERIES["op9_jump_shards"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in documents)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got)


def test_op6_finds_whole_items(spark, sf_dir, documents):
    """Every document that holds an item word for word is found."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    want = {(i, b.item_id) for i, t in documents for b in items if b.text and b.text in (t or "")}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_benchmark_leaks"](spark, sf_dir).collect()}
    assert want <= got


def test_op7_reads_articles(spark, sf_dir):
    got = QUERIES["op7_page_text"](spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r.text and "©" not in r.text for r in got)


def test_pipeline_stages(spark, sf_dir, documents):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in p.STAGES:
        docs = p.keep(stage(spark, docs, sf_dir), name)
        left[name] = docs
        if name != "sharding":
            assert docs.columns == columns
    toxic = {r.doc_id for r in QUERIES["op4_toxicity"](spark, sf_dir).where("predicted = 1").collect()}
    kept = {r.doc_id: r.text for r in left["toxicity"].collect()}
    assert set(kept) == {i for i, _ in documents} - toxic
    rows = sorted(kept.items())
    prints = [brute.simhash(t) for _, t in rows]
    root = brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert sorted(r.doc_id for r in left["near_dedup"].collect()) == sorted({rows[k][0] for k in root})
    shards = left["sharding"].collect()
    mixed = left["mixing"].collect()
    assert len(shards) == len(mixed) and {r.doc_id for r in mixed} <= {r.doc_id for r in left["decontamination"].collect()}
    # each source lies within half a document of its target, and documents are whole
    given = {r.doc_id: r for r in left["decontamination"].collect()}
    assert all(r == given[r.doc_id] for r in mixed)
    goal = mix_strata(left["decontamination"], quality_weights(spark, sf_dir), id="doc_id", stratum="source").collect()
    size, target = {r.id: r.size for r in goal}, {given[r.id].source: r.target for r in goal}
    for source, want in target.items():
        edge = max(size[i] for i, r in given.items() if r.source == source)
        assert abs(sum(size[r.doc_id] for r in mixed if r.source == source) - want) <= edge / 2 + 1


def test_run_on_the_smallest_tables(spark):
    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("no test data")
    import corpus_pipeline

    assert corpus_pipeline.run(spark, small).count() > 0
