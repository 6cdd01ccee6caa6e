"""Exact dedup by a tree merge of sorted digest runs. DataFrame functions only.

A run is a partition: every row starts in one of n runs (a power of two), sorted by digest, and every digest has a home run.
In round r of log2(n), runs whose numbers differ in bit r exchange: a digest moves to the run whose bit is that of its home,
so half of each run stays and half goes to its partner. The receiver merges the sorted streams that reach it, adds the counts
of equal digests and retains the wanted identifier, verified by SHA-256, byte length and a second, independent 64-bit hash.
After the last round each digest is one entry in its home run. Runs never shrink in number, so no task ever gets all entries,
and a digest that a third of all rows carry leaves each task as one entry.

In the end the texts are compared: the least and the greatest text of each merged digest must be the same. Should three hashes
of different texts ever agree, the job stops with an error rather than lose a text. A broadcast filter of bounded size tells
most rows without a copy, so that their texts stay where they are.

Defined results: null text counts as empty; empty texts equal each other; repeated rows count as members; a null
identifier never wins over a number and wins if its group has no other; an empty table gives an empty table; columns other
than the text and the identifier come along untouched in drop_copies, whatever their names, and are not read elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ascii_lower, cleaning, parted, partitions, removed, table, written

KEY = ["__sha", "__len", "__second"]


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def digests(docs: DataFrame, text: str = "text", ident: str = "doc_id", normalise=ascii_lower) -> DataFrame:
    norm = normalise(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(ident).alias("__id"), norm.alias("__norm")).select("__id", _sha(F.col("__norm")).alias("__sha"), F.octet_length("__norm").cast("long").alias("__len"), F.xxhash64("__norm").alias("__second"))


def _merged(rows: DataFrame, keep: str) -> DataFrame:
    """Equal digests of each run as one entry. Rows of a run are in one partition, so nothing is exchanged here."""
    best = {"min": F.min, "max": F.max}[keep]("__best").alias("__best")
    return rows.sortWithinPartitions("__run", *KEY).groupBy("__run", *KEY).agg(best, F.sum("__size").alias("__size"))


def merged_runs(entries: DataFrame, keep: str = "min", leaves: int | None = None) -> DataFrame:
    """One row per digest: KEY, __keep, __size. leaves: as many runs as shuffle partitions, rounded up to a power of two."""
    rounds = max(1, (max(2, leaves or partitions(entries.sparkSession)) - 1).bit_length())
    n = 2**rounds
    number = F.col("__id").isNotNull() if keep == "max" else F.col("__id").isNull()
    start = F.pmod(F.xxhash64("__id", "__second"), F.lit(n)).cast("int")
    runs = entries.select(start.alias("__run"), *KEY, F.struct(number.alias("n"), F.col("__id").alias("id")).alias("__best"), F.lit(1).cast("long").alias("__size"))
    home = F.conv(F.hex(F.substring("__sha", 1, 7)), 16, 10).cast("long")
    runs = _merged(runs.repartitionById(n, "__run"), keep)
    for r in range(rounds):
        bit = lambda x: F.pmod(F.shiftright(x, r), F.lit(2)).cast("int")  # noqa: B023, E731
        met = F.col("__run") + (bit(home) - bit(F.col("__run"))) * F.lit(2**r)
        runs = _merged(runs.withColumn("__run", met.cast("int")).repartitionById(n, "__run"), keep)
    return runs.select(*KEY, F.col("__best.id").alias("__keep"), "__size")


#: Parts that the rows of a digest are dealt to when texts are compared.
SALTS = 16


def verify(docs: DataFrame, copies: DataFrame, text: str = "text", ident: str = "doc_id", normalise=ascii_lower) -> None:
    """Compare the texts of merged digests: raises if a digest has different ones. Texts that may have copies move once, to their digest's
    copies; rows of a hot digest are dealt to SALTS parts, and each part sends two texts of it at most. copies: a written table."""
    norm, part = normalise(F.coalesce(F.col(text), F.lit(""))), F.pmod(F.xxhash64(ident), F.lit(SALTS)).alias("__part")
    hashed = docs.select(norm.alias("__norm"), part).select("__norm", "__part", F.xxhash64("__norm").alias("__second"))
    _, asked = parted(copies.select("__second"))(hashed, F.col("__second"))
    keyed = asked.select("__norm", "__part", _sha(F.col("__norm")).alias("__sha"), F.octet_length("__norm").cast("long").alias("__len"), "__second")
    parts = copies.select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("__part"))
    ends = keyed.join(parts.hint("merge"), [*KEY, "__part"], "left_semi").groupBy(*KEY).agg(F.min("__norm").alias("__least"), F.max("__norm").alias("__greatest"))
    with cleaning(docs.sparkSession):
        odd = ends.where("__least <> __greatest").select(F.hex("__sha")).first()
    if odd:
        raise ValueError(f"different texts share the digest {odd[0]}")


def exact_groups(docs: DataFrame, text: str = "text", ident: str = "doc_id", keep: str = "min", leaves: int | None = None) -> DataFrame:
    """One row per input row: ident, keep_id, group_size, text_sha256 (hex). Only copies go through the join back."""
    entries = written(digests(docs, text, ident), "digests")
    copies = written(merged_runs(entries, keep, leaves).where("__size > 1"), "merged")
    verify(docs, copies, text, ident)
    return entries.join(copies, KEY, "left").select(
        F.col("__id").alias(ident),
        F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", ident: str = "doc_id", keep: str = "min") -> DataFrame:
    """docs without the copies; of rows that repeat the kept identifier and text, one stays. Columns as they came.

    Rows that go are told by identifier and SHA-256. Only texts that may have copies move: once to be verified, and once to the
    join with the rows that go; again if whole rows repeat.
    """
    columns = docs.columns
    entries = written(digests(docs, text, ident), "digests")
    merged = written(merged_runs(entries, keep).where("__size > 1"), "merged")
    verify(docs, merged, text, ident)
    rows = written(entries.join(merged, KEY).groupBy(F.struct("__id", "__sha").alias("__key")).agg(F.first("__keep").alias("__keep"), F.count("*").alias("__n")), "copies")
    chosen = F.col("__key.__id").eqNullSafe(F.col("__keep"))
    rest, asked = parted(rows.where(~chosen | (F.col("__n") > 1)).select("__key.__id"))(docs, F.col(ident))
    keyed = asked.withColumn("__key", F.struct(F.col(ident).alias("__id"), _sha(ascii_lower(F.coalesce(F.col(text), F.lit("")))).alias("__sha")))
    left = keyed.join(rows.where(~chosen).select("__key"), "__key", "left_anti")
    again = rows.where(chosen & (F.col("__n") > 1)).select("__key")
    if not again.isEmpty():
        left = left.join(again, "__key", "left_anti").unionByName(left.join(again, "__key", "left_semi").dropDuplicates(["__key"]))
    removed(entries)
    return rest.select(*columns).unionByName(left.select(*columns))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_groups(table(spark, sf_dir, "documents"), keep="max")
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


OP8_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
