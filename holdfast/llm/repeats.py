"""Repeated passages across a cohort: how blocks of texts and ranges of keys exchange work.

Texts lie in blocks of bounded size. Each block names the pieces of its texts by keys that
depend on content alone; key ranges find the keys that occur more than once; the blocks send
the pieces behind such keys to the key ranges, which judge them; each block applies the
judgement to its texts. Only keys, shared pieces and marks travel, packed by (block, range),
and a piece that a block holds many times travels once, so a frequent one floods nobody.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import LAST_ID, block_count, block_of, keep, ship, text_bytes

BLOCK_BYTES = 4_000_000
RANGE_BYTES = 4_000_000  # text bytes whose keys one range is planned for
CHUNK = 1_000_000
HOT = 30_000  # owners from which on a key's pieces are dealt out by their own content
LOW = np.uint64(0xFF)  # low bits of a key: in a block, how many owners it has (255 at most)
MARK = np.dtype([("anchor", "<u8"), ("mark", "<u4")])


@dataclass
class Block:
    """Texts of a block in order of (id, text); `whole` marks copies of a text with a smaller id."""

    ids: np.ndarray
    texts: list[bytes]
    whole: np.ndarray

    def chunks(self):
        """Runs of texts that are no whole copies, of about CHUNK bytes: their positions."""
        run, size = [], 0
        for i in np.flatnonzero(~self.whole).tolist():
            if run and size + len(self.texts[i]) > CHUNK:
                yield run
                run, size = [], 0
            run.append(i)
            size += len(self.texts[i])
        if run:
            yield run


class Method(Protocol):
    """What an operator adds. Every result depends on the block's texts alone."""

    record: np.dtype  # of a piece: `key` deals it out, `anchor` is the shared key behind it

    def keys(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All keys, evenly spread and with LOW bits of 0, and their owners; two owners share a key."""

    def pieces(self, block: Block, shared: np.ndarray) -> np.ndarray:
        """The distinct pieces behind shared keys, sorted by key, as records.

        The lowest bit of a shared key says that it has HOT owners or more.
        """

    def judge(self, pieces: np.ndarray) -> np.ndarray:
        """A 32-bit mark of each piece, from all pieces of a key range."""

    def finish(self, block: Block, shared: np.ndarray, marks: np.ndarray) -> pd.DataFrame:
        """The result rows of a block, in order of its texts; a mark for each of its pieces."""


def _block(rows: pd.DataFrame, copies: pd.DataFrame) -> Block:
    texts = [t.encode("utf-8", "surrogatepass") for t in rows["text"]]
    order = sorted(range(len(texts)), key=lambda i: (rows["ord"].iat[i], texts[i]))
    ids = rows["ord"].to_numpy(dtype=np.int64)[order]
    again = set(zip(copies["ord"], copies["digest"]))
    digests = rows["digest"].to_numpy()[order]
    return Block(ids, [texts[i] for i in order], np.fromiter(((a, b) in again for a, b in zip(ids, digests)), bool, len(ids)))


def _ranges(keys: np.ndarray, count: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of sorted keys; ranges divide the key space evenly."""
    cut = np.searchsorted(keys >> np.uint64(32), np.array([-(-(r << 32) // count) for r in range(count)], dtype=np.uint64))
    edge = np.r_[cut, len(keys)]
    return [(r, int(edge[r]), int(edge[r + 1])) for r in np.flatnonzero(np.diff(edge)).tolist()]


def _counted(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Distinct keys, sorted, with the number of their owners in the low bits."""
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    if not len(keys):
        return keys
    new = np.r_[True, keys[1:] != keys[:-1]]
    first = np.flatnonzero(new)
    owners = np.add.reduceat((new | np.r_[True, owner[1:] != owner[:-1]]).astype(np.int64), first)
    return keys[first] | np.minimum(owners, 255).astype(np.uint64)


def _numbers(blobs: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=kind)


def find_repeats(cohort: DataFrame, make: Callable[[], Method], result: str, id: str, text: str) -> DataFrame:
    """Result rows (ord, whole, ...) of every cohort row; a null id counts as LAST_ID, a null text as empty.

    Equal texts are settled first: of each only the rows with the smallest id take part, the
    others are copies as a whole.
    """
    spark = cohort.sparkSession
    ship(spark)
    size = text_bytes(cohort, text)
    blocks, ranges = block_count(spark, size, BLOCK_BYTES), block_count(spark, size, RANGE_BYTES)
    rows = cohort.select(
        F.coalesce(F.col(id).cast("long"), F.lit(LAST_ID)).alias("ord"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    ).select("ord", "text", F.md5(F.col("text").cast("binary")).alias("digest"), block_of(F.col("ord"), F.col("text"), blocks).alias("block"))
    heads = keep(rows.groupBy("digest").agg(F.min("ord").alias("low"), F.max("ord").alias("high")).where("low < high").select(F.col("digest").alias("_d"), "low"), "heads")
    copies = rows.select("ord", "digest", "block").join(heads, F.col("digest") == F.col("_d")).where("ord > low").select("block", "ord", "digest")
    empty = copies.select(F.col("block").alias("block"), F.lit(0).alias("kind"), F.col("ord").alias("ord"), F.col("digest").alias("digest"), F.lit(None).cast("binary").alias("data"), F.lit(0).alias("range"))

    def said(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> tuple[Block, np.ndarray, np.ndarray]:
        block = _block(left, right[right["kind"] == 0])
        shared = right[right["kind"] == 1].sort_values("range")
        marks = right[right["kind"] == 2].sort_values("range")
        return block, _numbers(shared["data"], np.uint64), _numbers(marks["data"], MARK)

    def name(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block, _, _ = said(key, left, right)
        keys = _counted(*make().keys(block))
        cut = _ranges(keys, ranges)
        return pd.DataFrame({"range": [r for r, _, _ in cut], "block": int(key[0]), "data": [keys[a:b].tobytes() for _, a, b in cut]}, columns=["range", "block", "data"])

    def share(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        keys = _numbers(part["data"], np.uint64)
        of = np.repeat(np.arange(len(part)), [len(b) // 8 for b in part["data"]])
        plain = keys & ~LOW
        order = np.argsort(plain, kind="stable")
        first = np.flatnonzero(np.r_[True, plain[order][1:] != plain[order][:-1]])
        owners = np.empty(len(keys), dtype=np.uint64)
        owners[order] = np.repeat(np.add.reduceat(keys[order] & LOW, first), np.diff(np.r_[first, len(keys)]))
        hit = owners > 1
        keys, of = (plain | (owners >= HOT))[hit], of[hit]
        edge = np.searchsorted(of, np.arange(len(part) + 1))
        some = [i for i in range(len(part)) if edge[i] < edge[i + 1]]
        return pd.DataFrame({
            "block": [part["block"].iat[i] for i in some], "kind": 1, "ord": 0, "digest": "",
            "data": [keys[edge[i] : edge[i + 1]].tobytes() for i in some], "range": int(key[0]),
        }, columns=REPLY)

    def send(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block, shared, _ = said(key, left, right)
        pieces = make().pieces(block, shared) if len(shared) else np.zeros(0, make().record)
        cut = _ranges(np.ascontiguousarray(pieces["key"]), ranges)
        return pd.DataFrame({"range": [r for r, _, _ in cut], "block": int(key[0]), "data": [pieces[a:b].tobytes() for _, a, b in cut]}, columns=["range", "block", "data"])

    def weigh(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        method = make()
        part = part.sort_values("block")
        counts = np.array([len(b) for b in part["data"]]) // method.record.itemsize
        pieces = _numbers(part["data"], method.record)
        marks = np.empty(len(pieces), dtype=MARK)
        marks["anchor"], marks["mark"] = pieces["anchor"], method.judge(pieces)
        edge = np.r_[0, np.cumsum(counts)]
        return pd.DataFrame({
            "block": part["block"].to_numpy(), "kind": 2, "ord": 0, "digest": "",
            "data": [marks[edge[i] : edge[i + 1]].tobytes() for i in range(len(part))], "range": int(key[0]),
        }, columns=REPLY)

    def end(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block, _, marks = said(key, left, right)
        return make().finish(block, np.unique(marks["anchor"]), marks["mark"])

    def meet(replies: DataFrame, step, schema: str) -> DataFrame:
        replies = replies.select(*[F.col(c).alias(c) for c in REPLY])
        return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(step, schema)

    sent, reply = "range int, block int, data binary", "block int, kind int, ord long, digest string, data binary, range int"
    shared = empty.union(meet(empty, name, sent).groupBy("range").applyInPandas(share, reply))
    judged = empty.union(meet(shared, send, sent).groupBy("range").applyInPandas(weigh, reply))
    return meet(judged, end, result)


REPLY = ["block", "kind", "ord", "digest", "data", "range"]
