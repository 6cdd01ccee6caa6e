"""Shared folder, written tables and small column helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII capitals and the white space that separates words in every contract of this subpackage.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of this process only where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="spark-tidemark-", dir="/tmp")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: While a table is written: shuffle files go with the query that made them, and Arrow batches stay small in bytes for long texts.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}

BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows an Arrow batch in this session, from now on: by default a task's whole texts would be one batch, held by the JVM and by Python.

    The size is read when a plan is run, so it is left set.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """WRITING holds within."""
    before = {key: spark.conf.get(key, None) for key in WRITING}
    try:
        for key, value in WRITING.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with cleaning(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*frames: DataFrame) -> None:
    """Remove tables of written() that nothing reads any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: A filter has so many bits a key, rounded up to a power of two, and 2 ** FILTER_BITS (16 MB) at most.
KEY_BITS, FILTER_BITS = 64, 27


def parted(keys: DataFrame) -> Callable[[DataFrame, Column], tuple[DataFrame, DataFrame]]:
    """For a written table of one column: a function that parts rows by a value of theirs into those whose value is surely not
    among the keys, and those whose value may be (every one that is, and about one other in KEY_BITS).

    The keys' hashes are bits of bitmaps that are broadcast, so rows are parted where they are; with more keys than the bits
    allow for, more of the others are in question. A join must decide on these.
    """
    bits = min(FILTER_BITS, max(15, (KEY_BITS * keys.count()).bit_length()))
    slot = lambda x: F.pmod(F.xxhash64(x), F.lit(2**bits))
    bucket, bitmap, hit = (f"__{name}_{uuid.uuid4().hex}" for name in ("bucket", "bitmap", "hit"))  # rows have names of any kind
    slots = keys.select(slot(F.col(keys.columns[0])).alias("slot")).distinct().select(F.bitmap_bucket_number("slot").alias(bucket), F.bitmap_bit_position("slot").alias("bit"))
    maps = written(slots.repartition(bucket).groupBy(bucket).agg(F.bitmap_construct_agg("bit").alias(bitmap)), "filter")

    def part(rows: DataFrame, value: Column) -> tuple[DataFrame, DataFrame]:
        at = F.bitmap_bit_position(slot(value))
        byte = F.conv(F.hex(F.substring(F.col(bitmap), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        met = rows.join(F.broadcast(maps), F.bitmap_bucket_number(slot(value)) == F.col(bucket), "left").withColumn(hit, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
        return met.where(~F.col(hit)).drop(bucket, bitmap, hit), met.where(F.col(hit)).drop(bucket, bitmap, hit)

    return part


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does just that to pure ASCII, at many times the speed of translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    return F.coalesce(F.filter(F.split(text, SPACE_CLASS), lambda w: w != ""), F.array().cast("array<string>"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for reference cycles within: work that makes many small lists and tuples, and no cycles, is searched again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def freed() -> None:
    """Give memory that a task held back to the system, not only to the allocators of its worker process, which goes on with other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def places_of_none(items: list) -> list[int]:
    out, at = [], -1
    try:
        while True:
            at = items.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out
