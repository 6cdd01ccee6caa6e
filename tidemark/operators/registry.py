"""Experiments, holdout reads and promotions as ledgers that can be verified.

A record's hash covers its own fields and its parent's hash, so a change to any record breaks all that build on it. Records
are added in batches, parents before children; verification needs no order: it is one join of the ledger with itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ledger import canonical

FIELDS = ("family", "name", "parent_id", "version", "created_at", "n_candidates", "used_holdout", "body", "metrics")
LEDGER = "experiment_id string, family string, name string, parent_id string, version int, created_at timestamp_ntz, n_candidates bigint, used_holdout boolean, body string, metrics string, parent_hash string, content_hash string"
ROOT = "0" * 64


def _hash() -> Column:
    return F.sha2(F.concat(canonical(FIELDS), F.lit("#"), F.col("parent_hash")), 256)


def recorded(experiments: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rejected rows with the reason). experiments: family, name, parent_id (null for a first version),
    created_at, n_candidates, used_holdout, body, metrics (JSON). A version is one more than its parent's."""
    known = ledger.select(F.col("experiment_id").alias("__parent"), F.col("version").alias("__version"), F.col("content_hash").alias("__hash"))
    j = experiments.join(known, F.col("parent_id") == F.col("__parent"), "left")
    lost = F.col("parent_id").isNotNull() & F.col("__parent").isNull()
    rows = j.where(~lost).withColumns({"version": (F.coalesce("__version", F.lit(0)) + 1).cast("int"), "parent_hash": F.coalesce("__hash", F.lit(ROOT))}).withColumn("content_hash", _hash())
    rows = rows.withColumn("experiment_id", F.concat(F.lit("exp-"), F.substring("content_hash", 1, 16)))
    return rows.select(*(x.split()[0] for x in LEDGER.split(", "))), j.where(lost).select(*experiments.columns, F.lit("UNKNOWN_PARENT").alias("reason"))


def tampered(ledger: DataFrame) -> DataFrame:
    """experiment_id, reason of records that do not verify: content changed, renamed, parent lost or not the one it was built on."""
    parents = ledger.select(F.col("experiment_id").alias("__parent"), F.col("content_hash").alias("__hash"), F.col("version").alias("__version"))
    j = ledger.join(parents, F.col("parent_id") == F.col("__parent"), "left")
    first = F.col("parent_id").isNull()
    reason = (
        F.when(~_hash().eqNullSafe(F.col("content_hash")), "CONTENT")
        .when(~F.col("experiment_id").eqNullSafe(F.concat(F.lit("exp-"), F.substring("content_hash", 1, 16))), "IDENTIFIER")
        .when(~first & F.col("__parent").isNull(), "PARENT_LOST")
        .when(F.when(first, F.col("parent_hash") != ROOT).otherwise(F.col("__hash") != F.col("parent_hash")), "PARENT_CHANGED")
        .when(F.col("version") != F.when(first, 1).otherwise(F.col("__version") + 1), "VERSION")
    )
    return j.select("experiment_id", reason.alias("reason")).where("reason IS NOT NULL")


def holdout_reads(asked: DataFrame, ledger: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(reads to append, refused ones with the reason). asked: experiment_id, holdout_start, reason, read_at. A read needs a
    known experiment and a reason of some length in words."""
    known = ledger.select(F.col("experiment_id").alias("__known")).distinct()
    j = asked.join(known, F.col("experiment_id") == F.col("__known"), "left")
    why = F.when(F.char_length(F.trim(F.coalesce("reason", F.lit("")))) < least, "NO_REASON").when(F.col("__known").isNull(), "UNKNOWN_EXPERIMENT")
    judged = j.withColumn("refused", why).drop("__known")
    return judged.where("refused IS NULL").drop("refused"), judged.where("refused IS NOT NULL")


def holdout_counts(reads: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per holdout: reads, experiments that read it, and experiments that say they used it but never logged a read."""
    silent = ledger.where("used_holdout").join(reads.select("experiment_id").distinct(), "experiment_id", "left_anti").agg(F.count("*").alias("unlogged"))
    per = reads.groupBy("holdout_start").agg(F.count("*").alias("reads"), F.count_distinct("experiment_id").alias("experiments"), F.max("read_at").alias("last_read"))
    return per.withColumn("__j", F.lit(1)).join(silent.withColumn("__j", F.lit(1)), "__j").drop("__j")  # silent: one row


#: The stored gate that a scope needs.
SCOPES = {"probability": "may_forecast", "betting": "may_bet"}


def promotions(requests: DataFrame, gates: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(promotions to append, refused requests). requests: model, scope, at; gates: model, gate columns (names), may_forecast,
    may_bet, checked_at, as reports.gates() stored them. The latest gates up to the request count; without them it is refused."""
    gates = gates.select(F.col("model").alias("__model"), "checked_at", F.struct(*names, *SCOPES.values()).alias("g"))
    j = requests.join(gates, (F.col("model") == F.col("__model")) & (F.col("checked_at") <= F.col("at")), "left")
    last = j.groupBy("model", "scope", "at").agg(F.max_by("g", F.when(F.col("g").isNotNull(), F.col("checked_at"))).alias("g"), F.max("checked_at").alias("checked_at"))
    allowed = F.coalesce(*(F.when(F.col("scope") == scope, F.col(f"g.{flag}")) for scope, flag in SCOPES.items()), F.lit(False))
    failed = F.when(F.col("g").isNull(), F.array(F.lit("NOT_CHECKED"))).otherwise(F.array_compact(F.array(*(F.when(~F.col(f"g.{n}"), F.lit(n)) for n in names))))
    judged = last.select("model", "scope", "at", "checked_at", allowed.alias("__allowed"), failed.alias("failed"))
    return judged.where("__allowed").select("model", "scope", "at", "checked_at"), judged.where("NOT __allowed").select("model", "scope", "at", "failed")


def ungated(promoted: DataFrame, gates: DataFrame, names: Sequence[str]) -> DataFrame:
    """Promotions of a registry that its stored gates do not bear out."""
    return promotions(promoted.select("model", "scope", "at"), gates, names)[1]
