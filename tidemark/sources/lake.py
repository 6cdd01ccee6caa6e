"""Raw files and their manifest; sinks that replace, insert once, or only append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, bytes, sha256 and modified of every file; contents stay in the tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def latest_revisions(manifest: DataFrame, keys: Sequence[str] = ("provider", "dataset_key"), at: str = "downloaded_at") -> DataFrame:
    rest = [c for c in manifest.columns if c not in keys]
    return manifest.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, "sha256")).alias("r")).select(*keys, "r.*")


def new_contents(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content the manifest does not have; of equal new ones the first by path."""
    fresh = found.join(manifest.select("sha256"), "sha256", "left_anti")
    return fresh.groupBy("sha256").agg(F.min_by(F.struct("path", "bytes", "modified"), "path").alias("f")).select("sha256", "f.*")


def integrity(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path and problem: MISSING, HASH_MISMATCH, or UNLISTED."""
    both = manifest.select("path", F.col("sha256").alias("want")).join(found.select("path", F.col("sha256").alias("have")), "path", "full")
    problem = F.when(F.col("have").isNull(), "MISSING").when(F.col("want").isNull(), "UNLISTED").when(F.col("want") != F.col("have"), "HASH_MISMATCH")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def unprocessed(found: DataFrame, processed: DataFrame, parser_version: str) -> DataFrame:
    return found.join(processed.where(F.col("parser_version") == parser_version).select("sha256"), "sha256", "left_anti")


def expected_datasets(competitions: DataFrame, last_season: Column) -> DataFrame:
    """One row per competition and season from its first: competition, season, dataset_key. competitions: competition, code, first_season."""
    seasons = competitions.select("competition", "code", F.explode(F.sequence("first_season", last_season.cast("int"))).alias("season"))
    pair = F.concat(F.lpad((F.col("season") % 100).cast("string"), 2, "0"), F.lpad(((F.col("season") + 1) % 100).cast("string"), 2, "0"))
    return seasons.select("competition", "season", F.concat_ws("/", pair, "code").alias("dataset_key"))


def followups(index: DataFrame, wanted: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """Datasets that an index names: competition, season, dataset_key. index: code, season_code, season; wanted: competition, code.

    Those already there (processed: dataset_key) are left out.
    """
    found = index.join(F.broadcast(wanted), "code").select("competition", "season", F.concat_ws("/", "code", "season_code").alias("dataset_key")).distinct()
    return found if processed is None else found.join(processed.select("dataset_key"), "dataset_key", "left_anti")


COMPETITION = "competition string, name string, country string, tier int, type string, timezone string, season_style string, sources map<string,string>"


def competitions(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """The competition dimension from a JSON array; with source only those that it covers, with its code."""
    rows = spark.read.schema(COMPETITION).option("multiLine", True).json(path)
    return rows if source is None else rows.where(F.map_contains_key("sources", source)).withColumn("code", F.col("sources")[source])


def inbox_kind(files: DataFrame) -> DataFrame:
    """files with provider, kind and key, told by the file's name."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.rlike("(?i)odds"), "odds").when(name.rlike("(?i)(match|fixture)"), "matches").otherwise("unknown")
    return files.select("*", F.lit("local_csv").alias("provider"), kind.alias("kind"), F.regexp_replace(name, "\\.[^.]*$", "").alias("dataset_key"))


def replace_datasets(df: DataFrame, path: str, keys: Sequence[str] = ("source", "dataset_key")) -> None:
    """Overwrite only the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the rows whose keys are not there; a path without files counts as empty."""
    spark = df.sparkSession
    old = spark.read.schema(df.schema).option("ignoreMissingFiles", True).parquet(path) if _has_files(spark, path) else df.limit(0)
    df.join(old.select(*keys), list(keys), "left_anti").select(*df.columns).write.mode("append").parquet(path)


def _has_files(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def acquisition_report(outcomes: DataFrame) -> DataFrame:
    """Counts of each outcome per provider."""
    return outcomes.groupBy("provider").pivot("outcome", ["downloaded", "unchanged", "cached", "missing", "failed"]).count().fillna(0)
