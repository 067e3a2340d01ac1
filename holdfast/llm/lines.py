"""Lines that many texts of a cohort share, found through sharded minimal perfect hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from holdfast.llm.common import keep, partitions, ship
from holdfast.llm.mphash import DIGEST, MOST, DigestIndex

BLANK = " \t\n\x0b\x0c\r"
BLOCK_LINES = 500_000  # digests that a block of texts or a shard of the index is planned for
NO_ID = -(1 << 63)
HELD = np.dtype([("lo", "<u8"), ("hi", "<u8"), ("n", "<u4"), ("last", "<i8")])
ASKED = np.dtype([("lo", "<u8"), ("hi", "<u8"), ("last", "<i8")])


def line_digest(line: str, shortest: int) -> bytes | None:
    """128 bits of the line without white space at its ends, A to Z in lower case; None if it is too short."""
    key = line.strip(BLANK)
    if len(key) < shortest:
        return None
    return blake2b(key.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest()


def line_digests(rows: DataFrame, shortest: int) -> DataFrame:
    """(node, ord, salt, digests): the distinct line digests of each row that has any, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            found = [b"".join({line_digest(s, shortest) for s in t.split("\n")} - {None}) for t in batch.column(2).to_pylist()]
            salt = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            whole = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), salt, pa.array(found, pa.binary())], names=["node", "ord", "salt", "digests"])
            yield whole.filter(pa.array([bool(f) for f in found]))

    return rows.select("node", "ord", "text").mapInArrow(run, "node long, ord long, salt long, digests binary")


def _merged(keys: np.ndarray, n: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Distinct digests in order, with summed counts and largest holders."""
    order = np.lexsort((keys["hi"], keys["lo"]))
    keys, n, last = keys[order], n[order], last[order]
    out = np.zeros(0, HELD)
    if len(keys):
        first = np.flatnonzero(np.r_[True, (keys["lo"][1:] != keys["lo"][:-1]) | (keys["hi"][1:] != keys["hi"][:-1])])
        out = np.zeros(len(first), HELD)
        out["lo"], out["hi"] = keys["lo"][first], keys["hi"][first]
        out["n"] = np.minimum(np.add.reduceat(n.astype(np.int64), first), 0xFFFFFFFF)
        out["last"] = np.maximum.reduceat(last, first)
    return out


def _digests(held: np.ndarray) -> np.ndarray:
    keys = np.zeros(len(held), DIGEST)
    keys["lo"], keys["hi"] = held["lo"], held["hi"]
    return keys


def _held(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["data"]), HELD)


def sent_lines(lines: DataFrame, blocks: int, shards: int) -> DataFrame:
    """(shard, block, data): what each block of texts holds, one record a digest, by shard.

    A line that every text holds is one record a block, however many texts there are.
    """

    def send(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(part["digests"]), DIGEST)
        last = np.repeat(part["ord"].to_numpy(dtype=np.int64), [len(d) // 16 for d in part["digests"]])
        held = _merged(keys, np.ones(len(keys), np.int64), last)
        shard = ((held["lo"] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        edge = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if len(held) else np.zeros(0, np.int64)
        cut = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
        return pd.DataFrame({"shard": [int(shard[a]) for a, _ in cut], "block": int(key[0]), "data": [held[a:b].tobytes() for a, b in cut]}, columns=["shard", "block", "data"])

    return _blocked(lines, blocks).groupBy("block").applyInPandas(send, "shard int, block int, data binary")


def _blocked(lines: DataFrame, blocks: int) -> DataFrame:
    return lines.select(F.pmod(F.xxhash64("node", "salt"), F.lit(blocks)).cast("int").alias("block"), "node", "ord", "digests")


INDEX = "shard int, sizes binary, words binary, prints binary, counts binary, lasts binary"
ARRAYS = {"sizes": "<i8", "words": "<u8", "prints": "<u4", "counts": "u1", "lasts": "<i8"}


def line_index(sent: DataFrame) -> DataFrame:
    """One row a shard: the minimal perfect hash over its digests and the arrays behind it."""

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        held = _held(part)
        held = _merged(_digests(held), held["n"], held["last"])
        index = DigestIndex.build(_digests(held), held["n"], held["last"])
        return pd.DataFrame({"shard": [int(key[0])], **{name: [getattr(index, name).tobytes()] for name in ARRAYS}})

    return sent.groupBy("shard").applyInPandas(build, INDEX)


def shared_lines(sent: DataFrame, index: DataFrame, least: int) -> DataFrame:
    """(block, data): the digests of a block that `least` texts or more hold, with the largest holder."""

    def probe(key: tuple, asked: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        known = DigestIndex(**{name: np.frombuffer(arrays[name].iat[0], kind) for name, kind in ARRAYS.items()})
        blocks, replies = [], []
        for block, data in zip(asked["block"], asked["data"]):
            keys = _digests(np.frombuffer(data, HELD))
            counts, lasts = known.probe(keys)
            hit = counts >= least
            if hit.any():
                reply = np.zeros(int(hit.sum()), ASKED)
                reply["lo"], reply["hi"], reply["last"] = keys["lo"][hit], keys["hi"][hit], lasts[hit]
                blocks.append(block)
                replies.append(reply.tobytes())
        return pd.DataFrame({"block": blocks, "data": replies}, columns=["block", "data"])

    return sent.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(probe, "block int, data binary")


def dropped_lines(lines: DataFrame, shared: DataFrame, blocks: int) -> DataFrame:
    """(node, ord, drops): the digests a row loses, for rows that lose any."""

    def finish(key: tuple, rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        found = np.frombuffer(b"".join(replies["data"]), ASKED)
        packed = _digests(found).tobytes()
        last = {packed[16 * i : 16 * i + 16]: v for i, v in enumerate(found["last"].tolist())}
        drops = []
        for ident, digests in zip(rows["ord"].tolist(), rows["digests"]):
            cut = (digests[i : i + 16] for i in range(0, len(digests), 16))
            drops.append(b"".join(d for d in cut if last.get(d, ident) != ident) if last else b"")
        some = [i for i, d in enumerate(drops) if d]
        return pd.DataFrame({"node": rows["node"].to_numpy()[some], "ord": rows["ord"].to_numpy()[some], "drops": [drops[i] for i in some]})

    cogroup = _blocked(lines, blocks).groupBy("block").cogroup(shared.groupBy("block"))
    found = cogroup.applyInPandas(finish, "node long, ord long, drops binary")
    # rows that are equal in id and text lose the same lines
    return found.groupBy("node", "ord").agg(F.first("drops").alias("drops"))


def without_shared_lines(cohort: DataFrame, least: int = 3, shortest: int = 20, id: str = "id", text: str = "text") -> DataFrame:
    """(id, text, n_lines, n_dropped): each text without the lines that other texts repeat.

    Texts are split at line feeds (null and empty: one empty line). A line's key is the line
    without white space (space, tab to carriage return) at its ends, A to Z in lower case.
    Keys of `shortest` characters or more that `least` rows or more hold (2 to 255) lose all
    their lines except in the rows of the largest id among the holders. Other lines stay, in order.

    Every row is a text of its own, also where ids or whole rows repeat; all rows of the
    largest id keep the line. Ids are whole numbers; a null id is smaller than any other.
    Texts of any length are read whole; an empty cohort gives an empty result. Other columns
    are not read.

    Lines travel as 128-bit digests, packed. Blocks of texts send each of their digests once
    to the shard it belongs to; a shard keeps them as a minimal perfect hash with arrays of
    fingerprints, counts and largest holders in the shared folder; blocks probe those arrays, and
    only texts that lose lines get word of it. No line is joined, and texts move once.
    """
    if not 2 <= least <= MOST:
        raise ValueError(f"2 to {MOST} rows")
    spark = cohort.sparkSession
    ship(spark)
    rows = cohort.select(F.col(id).alias("id"), F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("ord"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.xxhash64("ord", "text"))
    lines = keep(line_digests(rows, shortest), "lines")
    size = lines.agg(F.sum(F.octet_length("digests").cast("long"))).first()[0] or 0
    blocks = max(2 * partitions(spark), math.ceil(size / 16 / BLOCK_LINES))
    sent = keep(sent_lines(lines, blocks, blocks), "sent")
    index = keep(line_index(sent), "line_index")
    drops = dropped_lines(lines, shared_lines(sent, index, least), blocks)
    told = rows.join(drops.withColumnsRenamed({"node": "_node", "ord": "_ord"}), (F.col("node") == F.col("_node")) & (F.col("ord") == F.col("_ord")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            kept, count, gone = [], [], []
            for t, d in zip(texts, drops):
                parts = t.count("\n") + 1
                if d:
                    out = {d[i : i + 16] for i in range(0, len(d), 16)}
                    stay = [s for s in t.split("\n") if line_digest(s, shortest) not in out]
                    kept.append("\n".join(stay))
                    gone.append(parts - len(stay))
                else:
                    kept.append(t)
                    gone.append(0)
                count.append(parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(count, pa.int64()), pa.array(gone, pa.int64())], names=["id", "text", "n_lines", "n_dropped"])

    schema = StructType([rows.schema["id"], *DataType.fromDDL("text string, n_lines long, n_dropped long").fields])
    return told.select("id", "text", "drops").mapInArrow(run, schema)
