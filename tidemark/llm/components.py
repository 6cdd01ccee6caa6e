"""Connected components of a graph given as links, by alternating star operations on DataFrames.

Every round hangs each node's larger neighbours, then its smaller ones, on the smallest it sees. Links are written between
rounds, so an executor that is lost repeats one round; the driver only sees a count and a checksum of the links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import removed, written


def _smallest(links: DataFrame) -> DataFrame:
    """Both directions of each link (u, v) with least, the smallest of u and its neighbours."""
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.u", "x.v")
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    return both.join(least, F.col("u") == F.col("w")).select("u", "v", F.least("u", "m").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    return _smallest(links).where("v > u").select(F.col("least").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """links: a < b. b's smaller neighbours and b itself hang on the smallest of them."""
    least = links.groupBy(F.col("b").alias("w")).agg(F.min("a").alias("m"))
    hung = links.join(least, F.col("b") == F.col("w")).select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("x"))
    return hung.select("x.a", "x.b").where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (smallest node of its component) for each node of the links; null ends and loops are left out."""
    links = written(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "links")
    state = None
    while True:
        links, old = written(_small_star(_large_star(links)), "links"), links
        removed(old)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    tops = links.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(tops)
