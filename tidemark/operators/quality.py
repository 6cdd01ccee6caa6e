"""Coverage, anomalies, gaps, audits, composite scores and drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M


def coverage(matches: DataFrame, prices: DataFrame, by: Sequence[str] = ("league", "season"), key: str = "match_id") -> DataFrame:
    """Per group: counts by status, distinct teams, expected pairings, and shares of matches with prices by snapshot type.

    Prices shrink to one row of flags a match before the join.
    """
    flags = prices.groupBy(key).agg(F.max((F.col("snapshot") == "PRE_MATCH").cast("int")).alias("__pre"), F.max((F.col("snapshot") == "CLOSING").cast("int")).alias("__close"), F.count_distinct("book").alias("__books"))
    joined = matches.join(flags, key, "left")
    sides = matches.select(*by, F.explode(F.array("home_team", "away_team")).alias("__team")).groupBy(*by).agg(F.count_distinct("__team").alias("teams"))
    out = joined.groupBy(*by).agg(
        F.count("*").alias("matches"), F.count_if(F.col("status") == "FINISHED").alias("finished"), F.count_if(F.col("status") == "SCHEDULED").alias("scheduled"), F.count_if(F.col("disputed") == 1).alias("disputed"),
        F.avg(F.coalesce("__pre", F.lit(0))).alias("share_pre"), F.avg(F.coalesce("__close", F.lit(0))).alias("share_closing"), F.avg(F.coalesce("__books", F.lit(0))).alias("books"),
        F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"),
    )
    return out.join(sides, list(by)).withColumn("expected", F.col("teams") * (F.col("teams") - 1))


def anomalies(matches: DataFrame, by: Sequence[str] = ("league", "season")) -> DataFrame:
    """Per group: repeated ordered pairings, and teams whose number of matches is not 2(n - 1)."""
    pairs = matches.groupBy(*by, "home_team", "away_team").count().groupBy(*by).agg(F.count_if(F.col("count") > 1).alias("repeated_pairs"))
    per = matches.select(*by, F.explode(F.array("home_team", "away_team")).alias("__t")).groupBy(*by, "__t").agg(F.count("*").alias("__c"))
    teams = per.groupBy(*by).agg(F.count("*").alias("__n"), F.collect_list("__c").alias("__all"))
    odd = teams.select(*by, F.size(F.filter("__all", lambda c: c != 2 * (F.col("__n") - 1))).alias("wrong_counts"))
    return pairs.join(odd, list(by))


def missing_seasons(matches: DataFrame, league: str = "league", season: str = "season") -> DataFrame:
    """Seasons between a league's first and last without a match."""
    span = matches.groupBy(league).agg(F.min(season).alias("a"), F.max(season).alias("b"))
    wanted = span.select(league, F.explode(F.sequence("a", "b")).alias(season))
    return wanted.join(matches.select(league, season).distinct(), [league, season], "left_anti")


def composite(components: Mapping[str, tuple[Column, float]]) -> list[Column]:
    """score, weakest and measured of weighted components; weights of null components fall to the others."""
    some = F.filter(F.array(*(F.struct(c.cast("double").alias("v"), F.lit(n).alias("name"), F.lit(w).alias("w")) for n, (c, w) in components.items())), lambda x: x["v"].isNotNull())
    total = F.aggregate(some, F.lit(0.0), lambda a, x: a + x["w"])
    score = F.when(total > 0, F.aggregate(some, F.lit(0.0), lambda a, x: a + x["v"] * x["w"]) / total)
    return [score.alias("score"), F.array_min(some)["name"].alias("weakest"), F.size(some).alias("measured")]


def status(p: Column, n: Column, least: int, warn: float = 0.01, alert: float = 0.001) -> Column:
    return F.when(p.isNull() | (n < least), "INSUFFICIENT_SAMPLE").when(p < alert, "ALERT").when(p < warn, "WARN").otherwise("OK")


def result_drift(matches: DataFrame, by: Sequence[str], order: Sequence[str], recent: int = 380, reference: int = 1900, least: int = 150) -> DataFrame:
    """Per group and metric: the recent block against the block before it.

    Shares by a two-proportion z test, mean goals by Welch's test: Student's t with Satterthwaite's degrees of freedom.
    """
    w = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order))
    rows = matches.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= recent + reference)
    new = F.col("__r") <= recent
    goals = (F.col("home_goals") + F.col("away_goals")).cast("double")
    pick = lambda c, side: F.when(side, c)
    agg = []
    for name, side in (("cur", new), ("ref", ~new)):
        agg += [F.count(pick(F.lit(1), side)).alias(f"n_{name}"), F.sum(pick((F.col("home_goals") > F.col("away_goals")).cast("int"), side)).alias(f"home_{name}"), F.sum(pick((F.col("home_goals") == F.col("away_goals")).cast("int"), side)).alias(f"draw_{name}")]
        agg += [F.avg(pick(goals, side)).alias(f"goals_{name}"), F.var_samp(pick(goals, side)).alias(f"var_{name}")]
    g = rows.groupBy(*by).agg(*agg)

    def share(hit: str) -> tuple[Column, Column, Column]:
        k1, n1, k2, n2 = (F.col(c).cast("double") for c in (f"{hit}_ref", "n_ref", f"{hit}_cur", "n_cur"))
        pool = (k1 + k2) / (n1 + n2)
        se = F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
        return k1 / n1, k2 / n2, F.when(se == 0, 0.0).otherwise((k2 / n2 - k1 / n1) / se)

    each = [F.col(f"var_{side}") / F.col(f"n_{side}") for side in ("cur", "ref")]
    welch = (F.col("goals_cur") - F.col("goals_ref")) / F.sqrt(each[0] + each[1])
    degrees = (each[0] + each[1]) ** 2 / (each[0] ** 2 / (F.col("n_cur") - 1) + each[1] ** 2 / (F.col("n_ref") - 1))
    metric = lambda name, v: F.struct(F.lit(name).alias("metric"), v[0].alias("reference"), v[1].alias("current"), v[2].alias("statistic"))
    three = F.array(metric("home_win_rate", share("home")), metric("draw_rate", share("draw")), metric("goals_per_match", (F.col("goals_ref"), F.col("goals_cur"), welch)))
    out = g.select(*by, "n_ref", "n_cur", degrees.alias("__df"), F.explode(three).alias("m")).select(*by, "n_ref", "n_cur", "__df", "m.*")
    size = F.abs("statistic")
    p = F.when(F.col("n_ref") >= least, 2 * F.when(F.col("metric") == "goals_per_match", M.t_tail(size, F.col("__df"))).otherwise(M.normal_tail(size)))
    return out.withColumn("p_value", p).drop("__df").withColumn("status", status(F.col("p_value"), F.col("n_cur"), least))


def audit(matches: DataFrame, prices: DataFrame, key: str = "match_id") -> DataFrame:
    """check, violations: facts that were available too early or prices that contradict their match."""
    own = matches.agg(
        F.count_if(F.col("available_at") < F.col("kickoff")).alias("result_before_kickoff"), F.count_if((F.col("status") == "FINISHED") & F.col("available_at").isNull()).alias("finished_without_time"),
        F.count_if((F.col("status") == "SCHEDULED") & (F.col("home_team") == F.col("away_team"))).alias("team_against_itself"),
    )
    joined = prices.join(matches.select(key, "kickoff"), key, "left")
    other = joined.agg(
        F.count_if(F.col("kickoff").isNull()).alias("price_without_match"), F.count_if((F.col("snapshot") == "PRE_MATCH") & (F.col("seen_at") > F.col("kickoff"))).alias("price_after_kickoff"),
        F.count_if((F.col("snapshot") == "CLOSING") & (F.col("seen_at") < F.col("kickoff") - F.expr("INTERVAL 24 HOUR"))).alias("closing_a_day_early"),
    )
    long = lambda df: df.unpivot([], df.columns, "check", "violations")
    return long(own).unionByName(long(other))


def price_flags(prices: DataFrame, key: str = "match_id") -> DataFrame:
    """One row a match: which markets and snapshot types have prices, which books that are no aggregates, and whether all
    early 1X2 prices have exact times. Books are few, so their set is small."""
    has = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int"))
    market, snapshot = F.col("market"), F.col("snapshot")
    return prices.groupBy(key).agg(
        has((market == "1X2") & (snapshot == "PRE_MATCH")).alias("pre"), has(snapshot == "OPENING").alias("opening"), has((market == "1X2") & (snapshot == "CLOSING")).alias("closing"),
        has(market == "OU").alias("ou"), has(market == "AH").alias("ah"), F.min(F.when(snapshot == "PRE_MATCH", (F.col("timestamp_quality") == "EXACT").cast("int"))).alias("pre_exact"),
        F.collect_set(F.when(~F.col("is_aggregate"), F.col("book"))).alias("books"),
    )


#: Score of a time's quality (fixed values) and of a source that no table rates.
TIME_SCORES = {"EXACT": 1.0, "APPROXIMATE": 0.6, "DATE_ONLY": 0.3}
UNRATED = 0.1


def coverage_matrix(matches: DataFrame, prices: DataFrame, today: Column, reliability: Mapping[str, float], levels: Sequence[Sequence[str]] = (("league", "season"), ("league",), ()), key: str = "match_id") -> DataFrame:
    """All measures of coverage at all levels out of one pass: grouping sets over league and season; level says which.

    matches: status, timestamp_quality, home_team, away_team, match_date, sources (array), disputed, stats (map), has_events,
    has_managers. Teams, pairings, sources and books are small sets; nothing else is gathered. expected sums n(n - 1) over
    league and season, so it stands at that level only.
    """
    share = lambda c: F.avg(F.coalesce(c, F.lit(0)).cast("double"))
    joined = matches.join(price_flags(prices, key), key, "left")
    status_is = lambda s: F.count_if(F.col("status") == s)
    time_is = lambda s: F.avg((F.col("timestamp_quality") == s).cast("double"))
    stat = lambda name: share(F.map_contains_key(F.coalesce("stats", F.create_map().cast("map<string,double>")), name).cast("int"))
    rated = lambda column, scores: F.element_at(F.create_map(*(F.lit(x) for pair in scores.items() for x in pair)), column)
    best = F.array_max(F.transform("sources", lambda s: F.coalesce(rated(s, reliability), F.lit(UNRATED))))
    names = sorted({c for level in levels for c in level})
    out = joined.groupingSets([[F.col(c) for c in level] for level in levels], *names).agg(
        F.grouping_id(*names).alias("__level"), F.count("*").alias("matches"), status_is("FINISHED").alias("results"), status_is("SCHEDULED").alias("scheduled"), status_is("UNKNOWN").alias("past_without_result"),
        F.size(F.array_union(F.collect_set("home_team"), F.collect_set("away_team"))).alias("teams"), F.max("match_date").alias("last_date"),
        share(F.col("pre")).alias("prematch_1x2"), share(F.col("opening")).alias("opening"), share(F.col("closing")).alias("closing_1x2"), share(F.col("ou")).alias("ou"), share(F.col("ah")).alias("ah"),
        F.size(F.array_distinct(F.flatten(F.collect_set("books")))).alias("bookmakers"), share(F.col("has_events").cast("int")).alias("events"), stat("xg").alias("xg"), stat("cards").alias("cards"), stat("corners").alias("corners"), stat("shots").alias("shots"), share(F.col("has_managers").cast("int")).alias("managers"),
        time_is("EXACT").alias("exact_kickoff"), time_is("APPROXIMATE").alias("approximate_kickoff"), time_is("DATE_ONLY").alias("date_only"), F.avg((F.size("sources") >= 2).cast("double")).alias("multi_source"), F.count_if(F.col("disputed") == 1).alias("disputed"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))), ",").alias("sources"), F.avg(best).alias("source_reliability"), F.avg(rated(F.col("timestamp_quality"), TIME_SCORES)).alias("timestamp_score"),
        F.min(F.when(F.col("pre") == 1, F.col("pre_exact"))).alias("__exact_prices"), F.max("pre").alias("__priced"),
    )
    expected = F.when(F.col("__level") == 0, F.col("teams") * (F.col("teams") - 1))
    results = F.when(F.col("exact_kickoff") >= 0.95, "RESULTS_PIT_EXACT").otherwise("RESULTS_PIT_DAILY")
    odds = F.when(F.coalesce("__priced", F.lit(0)) == 0, "NO_ODDS").when(F.col("__exact_prices") == 1, "ODDS_PIT_EXACT").otherwise("ODDS_PIT_APPROXIMATE")
    state = F.when((F.col("scheduled") == 0) & (F.col("last_date") < today), "COMPLETE").otherwise("IN_PROGRESS")
    return out.withColumns({"expected": expected, "results_share": F.col("results") / F.greatest(expected, F.lit(1)), "state": state, "pit_capability": F.concat_ws("+", results, odds), "level": F.col("__level")}).drop("__level", "__exact_prices", "__priced", "last_date")


def season_score(row_counts: DataFrame) -> DataFrame:
    """Coverage rows of seasons (with repeated_pairs and wrong_counts) with the weighted quality score and its weakest part."""
    c, n = F.col, F.greatest(F.col("matches"), F.lit(1))
    one = lambda x: F.least(F.lit(1.0), x)
    complete = F.when(c("state") == "COMPLETE", one(c("results") / F.greatest(c("expected"), F.lit(1)))).otherwise(one(c("results") / F.greatest(c("results") + c("past_without_result"), F.lit(1))))
    parts = {
        "completeness": (complete, 1.0), "consistency": (F.greatest(F.lit(0.0), 1 - (c("repeated_pairs") + c("wrong_counts") + c("past_without_result")) / n), 1.0), "timestamp_quality": (c("timestamp_score"), 1.0), "source_reliability": (c("source_reliability"), 1.0),
        "corroboration": (c("multi_source"), 1.0), "agreement": (F.when(c("multi_source") > 0, 1 - c("disputed") / (c("multi_source") * n)), 1.0), "freshness": (F.greatest(F.lit(0.0), 1 - c("past_without_result") / 10.0), 1.0), "odds_coverage": (c("prematch_1x2"), 1.0),
    }
    return row_counts.select(*row_counts.columns, *composite(parts))


def gaps(coverage_rows: DataFrame, structure: DataFrame, league: str = "league", season: str = "season") -> DataFrame:
    """Per league: seasons present, missing and incomplete, seasons without prices or exact times, markets found nowhere.

    coverage_rows: coverage_matrix() at the level of seasons; structure: anomalies(). A row a league and season.
    """
    rows = coverage_rows.join(structure, [league, season], "left")
    incomplete = (F.col("state") == "COMPLETE") & ((F.col("results") < F.col("expected")) | (F.coalesce("repeated_pairs", F.lit(0)) > 0) | (F.coalesce("wrong_counts", F.lit(0)) > 0))
    listed = lambda when: F.array_sort(F.collect_list(F.when(when, F.col(season))))
    none = lambda c, name: F.when(F.max(c) == 0, F.lit(name))
    out = rows.groupBy(league).agg(
        F.min(season).alias("oldest"), F.max(season).alias("newest"), F.count("*").alias("present"), F.array_sort(F.collect_set(season)).alias("__have"), listed(incomplete).alias("incomplete"), listed(F.col("past_without_result") > 0).alias("without_results"),
        F.count_if(F.col("prematch_1x2") == 0).alias("without_prematch"), F.count_if(F.col("closing_1x2") == 0).alias("without_closing"), F.count_if(F.col("exact_kickoff") < 0.5).alias("without_exact_kickoff"), listed(F.col("xg") > 0).alias("with_xg"),
        F.array_compact(F.array(none("prematch_1x2", "1X2"), none("ou", "OU"), none("ah", "AH"))).alias("missing_markets"),
    )
    return out.withColumn("missing", F.array_except(F.sequence("oldest", "newest"), "__have")).drop("__have")


def timestamp_audit(matches: DataFrame, prices: DataFrame, now: Column, key: str = "match_id") -> DataFrame:
    """subject, item, n, violation: the checks that visibility rests on, and how good times are, by prices' snapshot type and by
    season (share of exact kickoffs at least one half, or not)."""
    m = matches.agg(
        F.count_if((F.col("status") == "FINISHED") & F.col("available_at").isNull()).alias("finished_without_availability"), F.count_if(F.col("available_at") <= F.col("kickoff")).alias("result_available_before_kickoff"), F.count_if(F.col("available_at") > now).alias("result_available_in_future"),
        *(F.count_if(F.col("timestamp_quality") == q).alias(f"quality:{q}") for q in TIME_SCORES),
    )
    early, closing = F.col("snapshot").isin("PRE_MATCH", "OPENING"), F.col("snapshot") == "CLOSING"
    p = prices.join(matches.select(key, "kickoff"), key, "left").agg(
        F.count_if(early & (F.col("seen_at") >= F.col("kickoff"))).alias("early_price_at_or_after_kickoff"), F.count_if(closing & (F.col("seen_at") < F.col("kickoff"))).alias("closing_price_before_kickoff"), F.count_if(F.col("seen_at").isNull()).alias("price_without_time"),
    )
    long = lambda df, subject: df.unpivot([], df.columns, "item", "n").select(F.lit(subject).alias("subject"), "item", "n", ~F.col("item").startswith("quality:") & (F.col("n") > 0))
    kinds = prices.groupBy(F.concat_ws(":", "snapshot", "timestamp_quality").alias("item")).agg(F.count("*").alias("n")).select(F.lit("price times").alias("subject"), "item", "n", F.lit(False))
    seasons = matches.groupBy("league", "season").agg(F.avg((F.col("timestamp_quality") == "EXACT").cast("double")).alias("x")).groupBy(F.when(F.col("x") >= 0.5, "exact").otherwise("date only").alias("item")).agg(F.count("*").alias("n")).select(F.lit("seasons").alias("subject"), "item", "n", F.lit(False))
    return long(m, "matches").union(long(p, "prices")).union(kinds).union(seasons).toDF("subject", "item", "n", "violation")
