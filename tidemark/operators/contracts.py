"""Contracts of source rows: issues as an array of structs, good and rejected rows, price contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_GOALS, MIN_DATE, MIN_ODDS, MAX_ODDS = 40, "1860-01-01", 1.0001, 1001.0  # fixed values of the contract


def _issue(when: Column, severity: str, code: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))


def match_issues(today: Column) -> Column:
    """Issues of a match row: columns home, away (names), match_date, home_goals, away_goals, ht_home, ht_away, status."""
    home, away = F.trim(F.coalesce("home", F.lit(""))), F.trim(F.coalesce("away", F.lit("")))
    hg, ag, day = F.col("home_goals"), F.col("away_goals"), F.col("match_date")
    missing = (home == "") | (away == "")
    out_of_range = F.lit(False)
    for c in ("home_goals", "away_goals", "ht_home", "ht_away"):
        out_of_range = out_of_range | F.coalesce((F.col(c) < 0) | (F.col(c) > MAX_GOALS), F.lit(False))
    scored = hg.isNotNull()
    return F.array_compact(
        F.array(
            _issue(missing, "ERROR", "MISSING_TEAM"),
            _issue(~missing & (F.lower(home) == F.lower(away)), "ERROR", "SAME_TEAM"),
            _issue(day.isNull(), "ERROR", "BAD_DATE"),
            _issue((day < F.lit(MIN_DATE).cast("date")) | (day > F.date_add(today, 730)), "ERROR", "DATE_RANGE"),
            _issue(out_of_range, "ERROR", "GOALS_RANGE"),
            _issue(scored != ag.isNotNull(), "ERROR", "PARTIAL_SCORE"),
            _issue((F.col("status") == "FINISHED") & ~scored, "ERROR", "FINISHED_NO_SCORE"),
            _issue(scored & ((F.col("ht_home") > hg) | (F.col("ht_away") > ag)) & F.col("ht_home").isNotNull() & F.col("ht_away").isNotNull(), "ERROR", "HT_GT_FT"),
            _issue(scored & (day > F.date_add(today, 1)), "ERROR", "FUTURE_RESULT"),
            _issue((F.col("status") == "SCHEDULED") & (day < F.date_sub(today, 3)), "WARN", "STALE_FIXTURE"),
        )
    )


def price_issues() -> Column:
    odds = F.col("odds")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    return F.array_compact(
        F.array(
            _issue(odds.isNull() | F.isnan(odds) | ~odds.between(MIN_ODDS, MAX_ODDS), "ERROR", "ODDS_RANGE"),
            _issue(empty("book") | empty("market") | empty("selection"), "ERROR", "ODDS_KEYS"),
            _issue(F.col("seen_at").isNull(), "WARN", "ODDS_NO_TIMESTAMP"),
        )
    )


def is_error(issues: Column) -> Column:
    return F.exists(issues, lambda i: i["severity"] == "ERROR")


def enforce(rows: DataFrame, issues: Column, key: list[str], order: str) -> DataFrame:
    """rows with issues and accepted: of the valid rows of a key the first by order is accepted, later ones get
    DUPLICATE_KEY. A key's rows are those of one source key, a handful."""
    checked = rows.withColumn("issues", issues).withColumn("__ok", ~is_error(F.col("issues")))
    first = F.min(F.when(F.col("__ok"), F.col(order))).over(Window.partitionBy(*key))
    repeated = F.col("__first").isNotNull() & (F.col(order) > F.col("__first"))
    checked = checked.withColumn("__first", first)
    extra = F.struct(F.lit("ERROR").alias("severity"), F.lit("DUPLICATE_KEY").alias("code"))
    checked = checked.withColumn("issues", F.when(repeated, F.array_append("issues", extra)).otherwise(F.col("issues")))
    return checked.withColumn("accepted", ~is_error(F.col("issues"))).drop("__ok", "__first")


def orphans(prices: DataFrame, accepted: DataFrame, key: list[str]) -> DataFrame:
    """prices with ORPHAN_ODDS added to the issues of those whose match was not accepted."""
    found = prices.join(accepted.select(*key, F.lit(True).alias("__known")).distinct(), key, "left")
    extra = F.struct(F.lit("ERROR").alias("severity"), F.lit("ORPHAN_ODDS").alias("code"))
    return found.withColumn("issues", F.when(F.col("__known").isNull(), F.array_append("issues", extra)).otherwise(F.col("issues"))).drop("__known")
