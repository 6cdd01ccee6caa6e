"""Point-in-time operators: what was visible when.

A row is visible at t if its availability is not after t. Ties in availability are broken by explicit columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import canonical


def visible(df: DataFrame, as_of: Column, available: str = "available_at", since: Column | None = None, disputed: str | None = None) -> DataFrame:
    """Rows available at as_of, at or after since; without rows whose disputed flag is set, if named."""
    out = df.where(F.col(available) <= as_of)
    if since is not None:
        out = out.where(F.col(available) >= since)
    return out.where(~F.col(disputed).cast("boolean")) if disputed else out


def fixtures_at(df: DataFrame, as_of: Column, results: Sequence[str], available: str = "available_at", status: str = "status", finished: str = "FINISHED", scheduled: str = "SCHEDULED") -> DataFrame:
    """The schedule as it looked at as_of: result columns gone, status finished only where the result was visible."""
    seen = (F.col(status) == finished) & (F.col(available) <= as_of)
    return df.withColumn(status, F.when(seen, F.lit(finished)).otherwise(F.lit(scheduled))).drop(*results)


def latest(df: DataFrame, keys: Sequence[str], available: str, ties: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """The last row by availability of each key, by max_by: one partial aggregate, no window. Null keys are keys. count: a
    column with the number of rows of the key."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(available, *ties)
    extra = [F.count("*").alias(count)] if count else []
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"), *extra).select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest), *([count] if count else []))


def latest_at(df: DataFrame, limits: DataFrame, on: Sequence[str], keys: Sequence[str], available: str, limit: str, ties: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """The last row of each key that was available at its entity's own limit, and with count how many were. limits: on, limit."""
    seen = df.join(limits.select(*on, F.col(limit).alias("__limit")), list(on)).where(F.col(available) <= F.col("__limit"))
    return latest(seen.drop("__limit"), keys, available, ties, count)


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str], ties: Sequence[str] = (), bucket: str | None = None) -> DataFrame:
    """left with values (and right_ts) of the last row of right with the same keys at or before left_ts; null if none.

    Both sides meet in one shuffle: rows are ordered by time, right before left at equal times, and the last right value
    is carried on. With bucket (such as 'DAY') the order is kept per key and bucket of time, and what earlier buckets end with
    is carried over a summary of one row per key and bucket, so a key with very many rows is no single task.
    """
    carried = F.struct(F.col(right_ts).alias("__ts"), *values)
    tie = F.struct(*ties) if ties else F.lit(None).cast("struct<x:int>")
    l = left.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(left_ts).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"))  # noqa: E741
    r = right.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(right_ts).alias("__at"), F.lit(0).alias("__side"), carried.alias("__value"), tie.alias("__tie")).where(F.col("__at").isNotNull())
    both = r.unionByName(l, allowMissingColumns=True)
    by = [f"__k{i}" for i in range(len(keys))]
    inside = [*by, "__bucket"] if bucket else by
    if bucket:
        both = both.withColumn("__bucket", F.date_trunc(bucket, "__at"))
    order = Window.partitionBy(*inside).orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("__found", F.last("__value", ignorenulls=True).over(order)).where("__side = 1")
    if bucket:
        ends = both.where("__side = 0").groupBy(*inside).agg(F.max_by("__value", F.struct("__at", "__tie")).alias("__end"))
        marks = ends.unionByName(out.select(*inside).distinct(), allowMissingColumns=True).groupBy(*inside).agg(F.first("__end", ignorenulls=True).alias("__end"))
        before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        carry = marks.withColumn("__carry", F.last("__end", ignorenulls=True).over(before)).drop("__end")
        match = [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in inside]
        out = out.alias("l").join(carry.alias("c"), match, "left").withColumn("__found", F.coalesce("__found", "__carry"))
    return out.select("__left.*", F.col("__found.__ts").alias(right_ts if right_ts not in left.columns else f"{right_ts}_right"), *(F.col(f"__found.{v}").alias(v) for v in values))


def decision_times(entities: DataFrame, ticks: DataFrame, key: str, kickoff: str, seen: str, lead_hours: int = 1, date: str | None = None, zone: str = "UTC") -> DataFrame:
    """key, decision_at, policy: the last tick at or before the limit, else the limit itself.

    The limit is the kickoff less the lead. Where the kickoff is null and a date column is given, it is 12:00 local time of
    that date for ticks (LAST_TICK_BEFORE_NOON), and without ticks the local midnight that begins it (DATE_ONLY).
    """
    limit = F.col(kickoff) - F.make_interval(hours=F.lit(lead_hours))
    start = F.lit(None).cast("timestamp_ntz")
    if date is not None:
        local = lambda hour: F.convert_timezone(F.lit(zone), F.lit("UTC"), F.make_timestamp_ntz(F.year(date), F.month(date), F.day(date), F.lit(hour), F.lit(0), F.lit(0)))
        limit, start = F.coalesce(limit, local(12).cast(entities.schema[kickoff].dataType)), local(0).cast(entities.schema[kickoff].dataType)
    known = F.col(kickoff).isNotNull()
    asked = entities.select(key, limit.alias("__limit"), F.when(known, limit).otherwise(start).alias("__else"), known.alias("__known"))
    last = ticks.join(asked.select(key, "__limit"), key).where(F.col(seen) <= F.col("__limit")).groupBy(key).agg(F.max(seen).alias("__tick"))
    ticked = F.col("__tick").isNotNull()
    policy = F.when(F.col("__known"), F.when(ticked, "LAST_TICK").otherwise("LEAD")).otherwise(F.when(ticked, "LAST_TICK_BEFORE_NOON").otherwise("DATE_ONLY"))
    return asked.join(last, key, "left").select(key, F.coalesce("__tick", "__else").alias("decision_at"), policy.alias("policy"))


def outcomes(matches: DataFrame, asked: DataFrame, key: str = "match_id") -> DataFrame:
    """Results of asked matches, for evaluation only: finished ones, never part of what features read."""
    return matches.join(asked.select(key).distinct(), key, "left_semi").where("status = 'FINISHED'").select(key, "home_goals", "away_goals")


def closing_prices(prices: DataFrame, asked: DataFrame, by: Sequence[str], key: str = "match_id", seen: str = "seen_at", ties: Sequence[str] = ()) -> DataFrame:
    """Last closing prices of asked matches, for evaluation only."""
    closing = prices.join(asked.select(key).distinct(), key, "left_semi").where("snapshot = 'CLOSING'")
    return latest(closing, [key, *by], seen, list(ties))


def clip_holdout(df: DataFrame, date: str, holdout: str | None, asked: bool = False) -> DataFrame:
    """Rows before the holdout's first day, unless the holdout is asked for; without one configured nothing may be asked."""
    if holdout is None:
        raise ValueError("no holdout is configured")
    return df if asked else df.where(F.col(date) < F.lit(holdout).cast("date"))


#: Prime that sums of row digests are taken by (fixed value: 2^61 - 1).
PRIME = 2305843009213693951


def _limbs(columns: Sequence[str]) -> list[Column]:
    """Two 64-bit halves of a row's digest, as decimals that can be added up 10^18 times."""
    digest = F.md5(canonical(columns))
    return [F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(28,0)") for start in (1, 17)]


def _print(sums: Sequence[Column]) -> Column:
    """Sums modulo the prime as 32 hexadecimal digits."""
    return F.concat(*(F.lpad(F.lower(F.hex((s % F.lit(PRIME).cast("decimal(19,0)")).cast("long"))), 16, "0") for s in sums))


def fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """n and a fingerprint of the rows as a multiset: digests added up modulo a prime, so the order does not matter, but a
    row that comes twice, a null and a moved separator do."""
    low, high = _limbs(columns)
    return df.groupBy(*by).agg(F.count("*").alias("n"), _print([F.coalesce(F.sum(x), F.lit(0)) for x in (low, high)]).alias("fingerprint"))


def running_fingerprint(df: DataFrame, columns: Sequence[str], available: str, by: Sequence[str]) -> DataFrame:
    """n and fingerprint of all rows visible at each availability time of each group: sums by time, then running sums."""
    low, high = _limbs(columns)
    per_time = df.groupBy(*by, available).agg(F.count("*").alias("n"), *(F.sum(x).cast("decimal(28,0)").alias(name) for name, x in (("__low", low), ("__high", high))))
    before = Window.partitionBy(*by).orderBy(available).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_time.select(*by, available, F.sum("n").over(before).alias("n"), _print([F.sum(c).over(before) for c in ("__low", "__high")]).alias("fingerprint"))


def future_rows(df: DataFrame, as_of: Column, available: str) -> DataFrame:
    """Rows that must not be seen at as_of; empty if there is no leak."""
    return df.where(F.col(available) > as_of)


def cutoff_violations(df: DataFrame, cutoffs: Sequence[str], predicted: str, kickoff: str) -> DataFrame:
    """Rows where a cutoff lies after the prediction, or the prediction after kickoff."""
    bad = F.col(predicted) > F.col(kickoff)
    for c in cutoffs:
        bad = bad | (F.col(c) > F.col(predicted))
    return df.where(bad)


def upcoming(df: DataFrame, now: Column, kickoff: str, date: str, lead_hours: int = 1) -> DataFrame:
    """Exact kickoffs after now and the lead; date-only rows of later days."""
    return df.where(F.when(F.col(kickoff).isNotNull(), F.col(kickoff) > now + F.make_interval(hours=F.lit(lead_hours))).otherwise(F.col(date) > F.to_date(now)))


def overdue(df: DataFrame, now: Column, kickoff: str, date: str, available: str, hours: int = 6) -> DataFrame:
    """Rows that should have a visible result and have none."""
    late = F.when(F.col(kickoff).isNotNull(), F.col(kickoff) < now - F.make_interval(hours=F.lit(hours))).otherwise(F.col(date) < F.to_date(now))
    return df.where(late & ~F.coalesce(F.col(available) <= now, F.lit(False)))
