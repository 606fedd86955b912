"""What the operators share: table access, lineage cuts, and Arrow batches cut to a bounded number of bytes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of text that one step of a Python operator holds; a longer single text is a step of its own.
STEP_BYTES = 6 << 20

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see, deleted when the application ends.

    Only a local master, whose one process is driver and executor, gets a temporary folder where none is set.
    """
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = getattr(sc, "_loom_dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc._loom_dir = top
    folder = sc._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/loom-{uuid.uuid4().hex}")
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return folder.toString()


def unused(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of df has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def sampled(docs: DataFrame, text_col: str, most: int) -> DataFrame:
    """`docs` with one row for each of the `most` different texts whose 64-bit hashes are least; all of them if they are fewer.

    The hashes of all rows are combined before they are shuffled, and only the texts under the last of the least ones
    are shuffled, so that copies of a text count once and the sample is bounded and the same at any partitioning.
    """
    name = unused(docs, "h")
    rows = docs.withColumn(name, F.xxhash64(text_col))
    least = rows.select(name).distinct().orderBy(name).limit(most).agg(F.max(name)).first()[0]
    return rows.filter(F.col(name) <= F.lit(least)).dropDuplicates([name]).drop(name)


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: later jobs neither repeat its work nor need its shuffles."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of one piece are at most `most` bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())).to_numpy()
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(ends.searchsorted(before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def small_steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """As `steps`, for operators whose arrays are many times as large as their texts; when all are done, the worker, which
    later tasks use again, gives the memory that it no longer needs back to the machine."""
    yield from steps(batches, text, most)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def maybe_among(rows: DataFrame, id_col: str, ids: DataFrame, words: int = 1 << 16, keep: bool = True) -> DataFrame:
    """The rows whose id may be in the first column of `ids`, without a shuffle of the rows; with keep=False the others.

    A bit map of 64 * `words` bits, the same size whatever the ids, drops most others; a join on the ids must follow.
    """
    bits = 64 * words
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    first = ids.columns[0]
    known = ids.select(place(F.col(first)).alias("p")).groupBy(F.expr("cast(p div 64 as int)").alias("w"))
    known = known.agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    every = rows.sparkSession.range(words).select(F.col("id").cast("int").alias("w")).join(known, "w", "left")
    packed = every.agg(F.expr("transform(sort_array(collect_list(struct(w, coalesce(b, 0L) as b))), x -> x.b)").alias("m")).select("m").scalar()
    at = place(F.col(id_col))
    return rows.filter(F.getbit(F.get(packed, F.expr(f"cast(pmod(xxhash64({id_col}), {bits}) div 64 as int)")), (at % 64).cast("int")) == (1 if keep else 0))
