"""Centroid clustering of feature vectors in exact integers, filtered by simplex projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from holdfast.llm.common import keep, ship

# Scaled components stay below this, so that a squared distance of up to 128 of them fits in a long.
LIMIT = 1 << 27
# A pivot joins the base only if it rises over it by this share of the largest pivot
# distance: flat simplexes would blow up rounding errors.
RISE = 0.1
# Rounding allowed in a squared altitude, as a share of the squared distances it comes from.
SLACK = 1e-7


def squared(q: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, rows x others."""
    out = np.empty((len(q), len(others)), dtype=np.int64)
    for j, c in enumerate(others):
        d = q - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def apexes(distances: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Coordinates over the base simplex from squared distances to its vertices.

    One row gives its place in the base (one number for each vertex but the first) and the
    least and largest altitude that rounding leaves open. `base` holds the vertices in the
    same coordinates: the first at the origin, each next one along one more axis.
    """
    d = distances.astype(np.float64)
    place = np.zeros((len(d), base.shape[1]))
    for i in range(1, len(base)):
        along = (d[:, 0] - d[:, i] + base[i] @ base[i]) / 2 - place[:, : i - 1] @ base[i, : i - 1]
        place[:, i - 1] = along / base[i, i - 1]
    height = d[:, 0] - (place * place).sum(axis=1)
    room = SLACK * (d.max(axis=1) + (base * base).sum(axis=1).max() + 1)
    return np.column_stack([place, np.sqrt(np.maximum(height - room, 0)), np.sqrt(np.maximum(height + room, 0))])


def base_simplex(candidates: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(pivots, their coordinates): the candidates that rise highest over those before them."""
    chosen, base = [0], np.zeros((1, 0))
    reach = float(np.sqrt(squared(candidates, candidates[:1]).max())) if len(candidates) else 0.0
    while len(chosen) < min(most, len(candidates)):
        seen = apexes(squared(candidates, candidates[chosen]), base)
        tallest = int(seen[:, -2].argmax())
        if seen[tallest, -2] <= RISE * reach:
            break
        base = np.vstack([np.column_stack([base, np.zeros(len(base))]), np.r_[seen[tallest, :-2], (seen[tallest, -2] + seen[tallest, -1]) / 2]])
        chosen.append(tallest)
    return candidates[chosen], base


def possible(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Which centres can be nearest, rows x centres, from apex coordinates alone.

    In the plane of the base two points are as far apart as their places; their altitudes
    add between the difference (same side) and the sum (opposite sides) to that.
    """
    flat = ((rows[:, None, :-2] - centres[None, :, :-2]) ** 2).sum(axis=2)
    low, high = rows[:, -2][:, None], rows[:, -1][:, None]
    gap = np.maximum(0, np.maximum(low - centres[:, -1], centres[:, -2] - high))
    least, most = flat + gap * gap, flat + (high + centres[:, -1]) ** 2
    bound = most.min(axis=1, keepdims=True)
    return least <= bound * (1 + 1e-6) + 1


def nearest(q: np.ndarray, rows: np.ndarray, centres: np.ndarray, tips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact squared distance of the nearest centre; ties go to the smaller number."""
    open_ = possible(rows, tips)
    best = np.full(len(q), np.iinfo(np.int64).max)
    home = np.zeros(len(q), dtype=np.int32)
    for j, c in enumerate(centres):
        at = np.flatnonzero(open_[:, j])
        d = q[at] - c
        found = np.einsum("ij,ij->i", d, d)
        better = found < best[at]
        best[at[better]], home[at[better]] = found[better], j
    return home, best


def cluster_rows(
    cohort: DataFrame, clusters: int = 8, rounds: int = 10, pivots: int = 6, scale: int = 1024, dims: int = 64, salt: str = "3", id: str = "id", features: str = "features"
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid): cohort rows around centroids.

    `features` is an array of numbers; each becomes floor(scale * x). Centroids start as the
    rows with the smallest sha256 of `salt:id` (a null id counts as empty text; equal digests
    in order of their numbers). A round gives each row to its nearest centroid by squared
    Euclidean distance (ties: smaller number) and moves each centroid that has rows to
    floor(sum / count) in every component; others stay. After the rounds rows are given out
    once more. `centroid` is that of the row's cluster, `distance` squared, the inertias its
    sum over the cluster and over all (null where a long can't hold it).

    Kept are rows with exactly `dims` components (128 at most), none null, NaN or infinite,
    and none of 2^27 / scale or more in amount, beyond which distances leave a long; other
    rows give none. Fewer rows than `clusters` give as many centroids. Rows that repeat an id
    or a vector are rows of their own. An empty cohort gives an empty result. Other columns
    are not read, whatever their names.

    Distances to the pivots are worked out once a row and stored as apex coordinates beside
    the integers; per round a row meets only the centroids that the bounds leave open. Rows
    never shuffle: a task sends `clusters` partial sums, and clusters x dims numbers reach
    the driver.
    """
    if not 1 <= dims <= 128:
        raise ValueError("1 to 128 components")
    spark = cohort.sparkSession
    ship(spark)
    limit = float(LIMIT // scale)
    values = F.transform(F.col(features), lambda v: v.cast("double"))
    fit = F.coalesce((F.size("v") == dims) & F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < limit)), F.lit(False))
    rows = cohort.select(F.col(id).alias("id"), values.alias("v")).where(fit)
    rows = rows.select("id", F.transform("v", lambda v: F.floor(v * scale).cast("int")).alias("q"))
    first = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    # a bounded number of rows: the starting centroids and the candidates for pivots
    lead = rows.select("q", first.alias("key")).orderBy("key", "q").limit(max(clusters, 4 * pivots)).collect()
    schema = StructType([rows.schema["id"], *DataType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid array<bigint>").fields])
    if not lead:
        return spark.createDataFrame([], schema)
    start = np.array([r["q"] for r in lead], dtype=np.int64)
    points, base = base_simplex(np.unique(start, axis=0), pivots)
    table = _placed(rows, points, base)
    centres = start[:clusters]
    for _ in range(rounds):
        centres = _moved(table, centres, apexes(squared(centres, points), base))
    homes = keep(_assigned(table, centres, apexes(squared(centres, points), base)), "homes")
    each = homes.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("t")).select("cluster", F.col("t").try_cast("bigint").alias("cluster_inertia"), "t")
    every = each.agg(F.sum("t").alias("t")).select(F.col("t").try_cast("bigint").alias("inertia"))
    named = spark.createDataFrame([(j, c.tolist()) for j, c in enumerate(centres)], "cluster int, centroid array<bigint>")
    # `clusters` rows at most
    of = named.join(each.select("cluster", "cluster_inertia"), "cluster").withColumn("inertia", every.scalar())
    return homes.join(F.broadcast(of), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def _placed(rows: DataFrame, points: np.ndarray, base: np.ndarray) -> DataFrame:
    """(id, q, apex) stored: integers as int32 and apex coordinates as doubles, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            tips = apexes(squared(q.astype(np.int64), points), base)
            packed = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (q.astype("<i4"), tips.astype("<f8"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *packed], names=["id", "q", "apex"])

    schema = StructType([rows.schema["id"], *DataType.fromDDL("q binary, apex binary").fields])
    return keep(rows.mapInArrow(run, schema), "placed")


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    q, tips = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=t).reshape(batch.num_rows, -1) for i, t in ((1, "<i4"), (2, "<f8")))
    return q.astype(np.int64), tips


def _moved(table: DataFrame, centres: np.ndarray, tips: np.ndarray) -> np.ndarray:
    k = len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, dtype=np.int64), np.zeros(centres.shape, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            q, rows = _unpacked(batch)
            home, _ = nearest(q, rows, centres, tips)
            count += np.bincount(home, minlength=k)
            for j in np.unique(home):
                sums[j] += q[home == j].sum(axis=0)
        names = ["cluster", "n", "sums"]
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(count), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=names)

    parts = table.mapInArrow(run, "cluster int, n long, sums array<bigint>").where("n > 0")
    long = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    total = long.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    moved = centres.copy()
    for r in total.collect():
        moved[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return moved


def _assigned(table: DataFrame, centres: np.ndarray, tips: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            home, distance = nearest(*_unpacked(batch), centres, tips)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(home), pa.array(distance)], names=["id", "cluster", "distance"])

    return table.mapInArrow(run, StructType([table.schema["id"], *DataType.fromDDL("cluster int, distance long").fields]))
