"""Shards of cohort rows by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.llm.common import ship

# Parts of a shard that are numbered apart; shards x PARTS rows are broadcast.
PARTS = 1024


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys into 0 .. shards-1, all keys at once."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key = np.asarray(keys).astype(np.uint64)
    place = np.zeros(len(key), dtype=np.int64)
    nxt = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            place[live] = nxt[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            span = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            nxt[live] = ((place[live] + 1).astype(np.float64) * span).astype(np.int64)
            live = live[nxt[live] < shards]
    return place


def shard_rows(cohort: DataFrame, shards: int = 8, id: str = "id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row per cohort row.

    The law is `key`: the id and the shard count alone decide the shard, so that one shard
    more takes rows only into itself (`grown_shard`). `slot` numbers the rows of a shard from
    0 without gaps, in an order that the hashed id, the id and the text decide. A null id is
    a key of its own; null and empty texts have size 1 and CRC 0; rows that repeat an id share
    its shard and have slots of their own. An empty cohort gives no rows. Other columns are
    not read, whatever their names.

    No text is shuffled. Each shard is numbered in PARTS parts, whose counts are added up in
    a table of shards x PARTS rows at most.
    """
    ship(cohort.sparkSession)

    @F.pandas_udf("shard int, grown_shard int")
    def place(key: pd.Series) -> pd.DataFrame:
        keys = key.to_numpy()
        return pd.DataFrame({"shard": jump(keys, shards).astype(np.int32), "grown_shard": jump(keys, shards + 1).astype(np.int32)})

    rows = cohort.select(
        F.col(id).alias("id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(id)).alias("_key"),
    ).withColumn("_at", place("_key")).select(
        "id", "size", "text_crc32", F.coalesce("_at.shard", F.lit(0)).alias("shard"), "_at.grown_shard",
        F.pmod(F.xxhash64(F.lit(7), "_key", "text_crc32", "size"), F.lit(PARTS)).cast("int").alias("_part"),
    )
    counts = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(
        "shard", "_part",
        (F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
    )
    own = Window.partitionBy("shard", "_part").orderBy("id", "text_crc32", "size")
    return (
        rows.withColumn("_rank", F.row_number().over(own))
        .join(F.broadcast(before), ["shard", "_part"])
        .select(
            "id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("_before") + F.col("_rank") - 1).alias("slot"), "grown_shard",
        )
    )
