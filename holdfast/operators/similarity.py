"""Exact set-similarity join of texts by their word shingles, with prefix and length bounds.

Texts with one set of shingles are one content, so copies are never paired. Shingles are
put in one order, rare ones first. Two sets with a Jaccard similarity of t share a shingle
among the first size - ceil(t * size) + 1 of each, so only those are joined; shingles that
one content alone has fill the front of the prefix without ever being joined.

Any one order gives the same pairs, so shingles are counted by buckets of their digests: a table of
fixed size says how often a bucket comes, and whole sets never leave the rows they are stored in
but for the few that are verified.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.primitives import settle

HOT = 2_000  # contents that share a prefix shingle from which on they meet block by block
BUCKETS = 1 << 22  # counters of shingles, a power of two; they decide how rare ones are told, never which pairs are found
PART = 1 << 16  # counters added up in one place
NAMED = 1_000_000  # row numbers that are looked up map-side at most; beyond it sets meet them in a join
BATCH_BYTES = 4 << 20  # of the sets that Spark hands a Python worker at a time


def shingles(text: Column, words: int = 5) -> Column:
    """The distinct 64-bit digests of a text's word shingles, sorted; null for a text without words.

    Words are runs of letters and digits of any script, regardless of case; a shorter text
    is one shingle.
    """
    plain = F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))
    bind = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # evaluated once, not once per element

    def cut(parts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(parts) - (words - 1), F.lit(1)))
        return F.array_sort(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(parts, i, words), " ")))))

    return F.when(F.length(plain) > 0, bind(F.split(plain, " "), cut))


def contents_of(cohort: DataFrame, text: str, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """`(id, content)` of rows with words and `(row, content, size, tokens)` of distinct sets.

    Sets are worked out and stored once, by row; a content's is the one of its first row.
    """
    rows = cohort.filter(F.col(text).rlike(r"[\p{L}\p{N}]")).select("id", shingles(F.col(text), words).alias("tokens"))
    rows = rows.withColumn("content", F.md5(F.array_join(F.transform("tokens", lambda v: v.cast("string")), ",")))
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    first = rows.groupBy("content").agg(F.min("row").alias("_first"))
    again = settle(rows.select("content", "row").join(first, "content").filter("row <> _first").select("row"))
    contents = rows.select("row", "content", F.size("tokens").alias("size"), "tokens")
    few = again.limit(NAMED + 1).count() <= NAMED
    left = contents.join(F.broadcast(again) if few else again, "row", "left_anti")
    return rows.select("id", "content"), left if few else settle(left)


def least_overlap(a: Column, b: Column, t: float) -> Column:
    """Shared shingles that two sets of these sizes need for a similarity of t."""
    per_mille = round(t * 1000)
    return F.ceil((a + b) * per_mille / F.lit(1000 + per_mille) - 1e-9)


def _small_batches(spark: SparkSession) -> None:
    """A batch of whole sets stays small; a size that the session names itself holds."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, str(BATCH_BYTES))


def bucket_counts(contents: DataFrame) -> np.ndarray:
    """How many shingles of all contents fall into each bucket of digests, 65535 at most."""
    buckets, part = BUCKETS, min(PART, BUCKETS)

    def count(batches):
        n = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            tokens = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            n += np.bincount(tokens & (buckets - 1), minlength=buckets)
        planes = np.minimum(n, 65535).astype("<u2").view(np.uint8).reshape(-1, part, 2)
        packed = [zlib.compress(np.ascontiguousarray(p.T).tobytes(), 1) if p.any() else None for p in planes]
        at = [i for i, p in enumerate(packed) if p is not None]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([packed[i] for i in at], pa.binary())], names=["part", "n"])

    def add(groups):
        n = np.zeros(part, dtype=np.int64)
        for held in groups["n"]:
            low, high = np.frombuffer(zlib.decompress(held), dtype=np.uint8).reshape(2, part).astype(np.int64)
            n += low + 256 * high
        groups = groups.head(1).copy()
        groups["n"] = [np.minimum(n, 65535).astype("<u2").tobytes()]
        return groups

    fields = "part int, n binary"
    out = np.zeros(buckets, dtype=np.uint16)
    for r in contents.select("tokens").mapInArrow(count, fields).groupBy("part").applyInPandas(add, fields).collect():
        out[r["part"] * part : (r["part"] + 1) * part] = np.frombuffer(r["n"], dtype="<u2")
    return out


def prefixes(contents: DataFrame, t: float) -> DataFrame:
    """`(token, row, size, pos)`: the shingles of each prefix that prefixes of other contents have too.

    `pos` is the shingle's place among all of the content's shingles, from 1: those of rare
    buckets first, then by digest. A shingle alone in its bucket is nobody else's.
    """
    _small_batches(contents.sparkSession)
    counts, per_mille = bucket_counts(contents), round(t * 1000)
    schema = pa.schema([("token", pa.int64()), ("row", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])

    def first(batches):
        for batch in batches:
            row, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            tokens = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            of, often = np.repeat(np.arange(len(row)), size), counts[tokens & (len(counts) - 1)]
            order = np.argsort((of << 16) | often, kind="stable")  # the tokens of a row are sorted already
            pos = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size) + 1
            need = np.ceil(size * per_mille / 1000 - 1e-9).astype(np.int64)
            kept = (pos <= (size - need + 1)[of]) & (often[order] > 1)
            order, of = order[kept], of[kept]
            columns = [tokens[order], row[of], size[of], pos[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def shared(batches):
        """Of rows sorted by token those whose neighbour has the same one."""
        last, alike = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            token = held.column("token").to_numpy()
            same = np.r_[alike, token[1:] == token[:-1]]
            yield from held.slice(0, len(token) - 1).filter(pa.array(same[:-1] | same[1:])).to_batches()
            last, alike = held.slice(len(token) - 1).to_batches()[0], bool(same[-1])
        if alike:
            yield last

    fields = "token bigint, row bigint, size int, pos int"
    marks = contents.select("row", "size", "tokens").mapInArrow(first, fields)
    return marks.repartition("token").sortWithinPartitions("token").mapInArrow(shared, fields)


def similar_contents(contents: DataFrame, t: float = 0.8) -> DataFrame:
    """`(a, b, similarity)`, settled: each pair of different contents with a Jaccard similarity of t or more, once.

    A shingle that many contents share in their prefixes is dealt into blocks of them, and
    block meets block, so no task sees all; pairs are verified on whole sets. `contents` is what
    `contents_of` gives.
    """
    if not 0 < t <= 1:
        raise ValueError("a similarity above 0, 1 at most")
    marks = settle(prefixes(contents, t))
    blocks = marks.groupBy("token").agg(F.ceil(F.count("*") / HOT).cast("int").alias("nb"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    dealt = marks.join(blocks, "token").withColumn("own", F.pmod(F.xxhash64("row"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    left = dealt.withColumn("j", other).select("token", F.col("own").alias("i"), "j", F.col("row").alias("a"), F.col("size").alias("a_size"), F.col("pos").alias("a_pos"))
    right = dealt.withColumn("i", other).select("token", "i", F.col("own").alias("j"), F.col("row").alias("b"), F.col("size").alias("b_size"), F.col("pos").alias("b_pos"))
    need = least_overlap(F.col("a_size"), F.col("b_size"), t)
    # the smaller set comes first; what can still be shared from here on bounds the overlap
    once = (F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a") < F.col("b")))
    long_enough = F.col("a_size") * 1000 >= F.col("b_size") * round(t * 1000)
    met = left.join(right, ["token", "i", "j"]).where(once & long_enough)
    # equal shingles before this place are at most as many as either place allows
    room = F.least("a_pos", "b_pos") + F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos"))
    # all that two prefixes share has been met; beyond the shorter reach of both, a set has as many left as it has behind its prefix
    behind = F.ceil(F.greatest("a_size", "b_size") * round(t * 1000) / F.lit(1000) - 1e-9) - 1
    often = met.where(room >= need).groupBy("a", "b", (need - behind).alias("_least")).agg(F.count("*").alias("_n"))
    pairs = settle(often.where(F.col("_n") >= F.col("_least")).select("a", "b"))
    asked = settle(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "row"))
    if asked.limit(NAMED + 1).count() <= NAMED:  # other sets stay where they are
        contents = contents.join(F.broadcast(asked), "row", "left_semi")
    sets = lambda name: contents.select(F.col("row").alias(name), F.col("content").alias(f"{name}_content"), F.col("size").alias(f"{name}_size"), F.col("tokens").alias(f"{name}_tokens"))
    both = pairs.join(sets("a"), "a").join(sets("b"), "b")
    both = both.select(F.col("a_content").alias("a"), F.col("b_content").alias("b"), "a_size", "b_size", F.size(F.array_intersect("a_tokens", "b_tokens")).alias("_both")).where(F.col("_both") >= need)
    return settle(both.select("a", "b", (F.col("_both").cast("double") / (F.col("a_size") + F.col("b_size") - F.col("_both"))).alias("similarity")))


def audit_jaccard(
    splits: DataFrame, cohort: DataFrame, text: str, t: float = 0.8, words: int = 5, known: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Test texts whose word shingles agree to a share of t or more with training texts.

    One row per (seed, content) with test rows: `n_test` and `n_train` rows of that very set
    of shingles, `n_near_train` training rows of other contents with a Jaccard similarity of t
    or more, and the largest such similarity (1 for equal sets). Contents without any give no row.
    `known` is what `contents_of` gave for this cohort, if it has been called.
    """
    members, contents = known or contents_of(cohort, text, words)
    pairs = similar_contents(contents, t)
    near = pairs.union(pairs.select("b", "a", "similarity"))
    linked = near.select("a").union(members.groupBy("content").agg(F.count("*").alias("n")).filter("n > 1").select("content")).distinct()
    rows = members.join(linked.withColumnRenamed("a", "content"), "content")
    sides = settle(
        splits.select("seed", "id", "split").join(rows, "id").groupBy("seed", "content").agg(
            F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test")
        )
    )
    there = sides.filter("n_train > 0").select("seed", F.col("content").alias("b"), F.col("n_train").alias("n"))
    counts = near.join(there, "b").groupBy("seed", F.col("a").alias("content")).agg(F.sum("n").alias("n_near_train"), F.max("similarity").alias("_best"))
    out = sides.filter("n_test > 0").join(counts, ["seed", "content"], "left").withColumn("n_near_train", F.coalesce("n_near_train", F.lit(0)).cast("bigint"))
    best = F.when(F.col("n_train") > 0, F.lit(1.0)).otherwise(F.col("_best"))
    return out.filter("n_train + n_near_train > 0").select("seed", "content", "n_test", "n_train", "n_near_train", best.alias("similarity"))
