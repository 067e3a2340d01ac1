"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import math
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from holdfast.session import new_path

# White space that separates words: space, tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
# A null id sorts behind every other one.
LAST_ID = (1 << 63) - 1
BATCH_BYTES = 4 << 20  # of the rows that Spark hands a Python worker at a time


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: later steps start from files
    that survive a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that functions run there import it.

    Rows reach them in batches of BATCH_BYTES: a batch of whole texts is held by the JVM, on its
    way there and back, and by each Python worker. A row is never split; a size that the session
    names itself holds.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_holdfast_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="holdfast-"), "holdfast.zip")
    with zipfile.ZipFile(path, "w") as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, source.relative_to(package.parent))
    context.addPyFile(path)
    context._holdfast_shipped = True


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(cohort: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts; one pass over one column, one number to the driver."""
    row = cohort.agg(F.sum(F.octet_length(F.col(text).cast("string")).cast("long"))).first()
    return int(row[0] or 0)


def block_count(spark: SparkSession, size: int, target: int) -> int:
    """So many blocks that each holds about `target` bytes, and every task has some."""
    return max(2 * partitions(spark), math.ceil(size / target), 1)


def block_of(ident: Column, text: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(ident, text), F.lit(blocks)).cast("int")


def judged(rows: DataFrame, text: str, judge: Callable[[list], list], kind: str, arrow: pa.DataType) -> DataFrame:
    """(row, value): each row whole, as a struct, and what `judge` makes of its text.

    Rows pass through Arrow untouched, so that null ids, wide integers and columns of any
    name come out as they went in. The values of a batch are worked out together.
    """
    ship(rows.sparkSession)
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            value = pa.array(judge(row.field(at).to_pylist()), arrow)
            yield pa.RecordBatch.from_arrays([row, value], names=["row", "value"])

    return whole.mapInArrow(run, StructType([*whole.schema.fields, StructField("value", DataType.fromDDL(kind))]))
