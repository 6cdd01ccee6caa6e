"""Append-only ledgers: versions, row digests, chained batch digests, verification, reconciliation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(columns: Sequence[str]) -> Column:
    """Text that equal rows share and no others: columns in the given order, each with its length; a null is N."""
    value = lambda c: F.col(c).cast("string")
    return F.concat_ws("|", *(F.coalesce(F.concat(F.char_length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("N")) for c in columns))


def with_digest(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.withColumn("row_hash", F.sha2(canonical(columns), 256))


def batch_digests(rows: DataFrame, batch: str, group: str = "__g", groups: int = 64) -> DataFrame:
    """batch, n, content_hash: digest over the sorted digests of groups of rows, so no task sees a whole large batch's
    rows at once; groups are by leading hex digits of the row digest."""
    g = F.pmod(F.conv(F.substring("row_hash", 1, 4), 16, 10).cast("int"), F.lit(groups))
    part = rows.withColumn(group, g).groupBy(batch, group).agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("row_hash"))), 256).alias("__h"), F.count("*").alias("__n"))
    return part.groupBy(batch).agg(F.sum("__n").alias("n"), F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(group, "__h"))), lambda x: x["__h"])), 256).alias("content_hash"))


def chained(batches: DataFrame, batch: str) -> DataFrame:
    """batches with prev_hash and chain_hash = sha256(prev_hash + content_hash); a batch is one row.

    The chain is serial by nature: its rows, one a batch, stream through one task in order, and only the last hash is held.
    """
    kind = batches.schema[batch].dataType.simpleString()

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = "0" * 64
        for pdf in parts:
            links = []
            for content in pdf["content_hash"]:
                links.append((last, hashlib.sha256((last + content).encode()).hexdigest()))
                last = links[-1][1]
            yield pdf.assign(prev_hash=[x for x, _ in links], chain_hash=[x for _, x in links])

    ordered = batches.select(batch, "n", "content_hash").repartition(1).sortWithinPartitions(batch)
    return ordered.mapInPandas(fold, f"`{batch}` {kind}, n bigint, content_hash string, prev_hash string, chain_hash string")


def broken(chain: DataFrame, rows: DataFrame, batch: str, columns: Sequence[str]) -> DataFrame:
    """Batches whose link, rows or digest do not verify."""
    now = batch_digests(with_digest(rows, columns), batch).select(batch, F.col("content_hash").alias("__now"), F.col("n").alias("__rows"))
    w = Window.orderBy(batch)
    linked = chain.withColumn("__link", F.coalesce(F.lag("chain_hash").over(w), F.lit("0" * 64)))
    check = linked.join(now, batch, "full")
    bad = ~(F.col("__link").eqNullSafe(F.col("prev_hash")) & F.col("__now").eqNullSafe(F.col("content_hash")) & (F.col("chain_hash") == F.sha2(F.concat("prev_hash", "content_hash"), 256)))
    return check.where(F.coalesce(bad, F.lit(True))).select(batch, F.col("__rows").alias("rows"))


def newest(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Rows of each key's highest version."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("__r")).select(*keys, "__r.*")


def changed(incoming: DataFrame, ledger: DataFrame, keys: Sequence[str], watched: Sequence[str], version: str = "version", ident: str = "row_id") -> DataFrame:
    """Incoming rows that are new or differ from the newest version in a watched column, with version and supersedes."""
    last = newest(ledger, keys, version).select(*keys, F.col(version).alias("__version"), F.col(ident).alias("__before"), *(F.col(c).alias(f"__old_{c}") for c in watched))
    same = F.lit(True)
    for c in watched:
        same = same & F.col(c).eqNullSafe(F.col(f"__old_{c}"))
    both = incoming.join(last, list(keys), "left")
    return both.where(F.col("__version").isNull() | ~same).select(*incoming.columns, (F.coalesce("__version", F.lit(0)) + 1).alias(version), F.col("__before").alias("supersedes"))


def reconcile(predictions: DataFrame, outcomes: DataFrame, results: DataFrame, closing: DataFrame, now: Column, key: str = "match_id", ident: str = "row_id") -> DataFrame:
    """Outcome rows of predictions that have none and whose result is visible: every version, superseded ones too.

    PUSH is a stake returned, VOID a postponed match; closing prices give the value against the close.
    """
    pending = predictions.join(outcomes.select(ident), ident, "left_anti")
    seen = results.where((F.col("available_at") <= now) | (F.col("status") == "POSTPONED")).select(key, "home_goals", "away_goals", F.col("status").alias("__status"))
    j = pending.join(seen, key).join(closing.select(key, "selection", "closing_odds"), [key, "selection"], "left")
    result = F.when(F.col("home_goals") > F.col("away_goals"), "H").when(F.col("home_goals") == F.col("away_goals"), "D").otherwise("A")
    outcome = F.when(F.col("__status") == "POSTPONED", "VOID").when(F.col("selection") == result, "WIN").otherwise("LOSS")
    profit = F.when(outcome == "WIN", F.col("units") * (F.col("odds") - 1)).when(outcome == "LOSS", -F.col("units")).otherwise(0.0)
    return j.select(ident, key, "selection", outcome.alias("outcome"), profit.alias("profit"), F.when(F.col("closing_odds") > 1, F.col("odds") / F.col("closing_odds") - 1).alias("clv"))
