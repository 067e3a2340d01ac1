"""What a Python worker holds, and how many a task needs."""

import pyarrow as pa

from holdfast.llm.common import judged
from holdfast.llm.sharding import shard_rows


def test_texts_reach_workers_in_bounded_batches(spark):
    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "if(id = 7, null, repeat('toxic or not ', 800)) as text")
    held = judged(rows, "text", lambda texts: [sum(len(t or "") for t in texts)] * len(texts), "bigint", pa.int64())
    got = held.selectExpr("count(1) as n", "max(value) as most", "sum(length(row.text)) as size").first()
    assert (got.n, got.size) == (3000, 2999 * 13 * 800)
    assert got.most <= (4 << 20) + 13 * 800


def test_a_batch_size_of_the_session_holds(spark):
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    named = spark.conf.get(size, None)
    spark.conf.set(size, "1m")
    try:
        judged(spark.range(1).selectExpr("'a' as text"), "text", lambda texts: [0] * len(texts), "bigint", pa.int64()).collect()
        assert spark.conf.get(size) == "1m"
    finally:
        spark.conf.unset(size)
        if named is not None:
            spark.conf.set(size, named)


def test_a_shard_is_worked_out_once_a_row(make):
    rows = make([(k if k % 3 else None, f"text {k}") for k in range(30)], "id int, text string")
    plan = shard_rows(rows, 8)._jdf.queryExecution().executedPlan().toString()
    # once where shards are counted, once where rows are numbered
    assert plan.count("ArrowEvalPython") == 2, plan
