"""A live run: what the models and the market say at one moment about the matches to come, with every input of the rules measured."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.metrics import ordered_logit
from ..sources.scratch import written
from . import calibration, evaluate, market, models, pit, quality, ratings, reports

SELECTIONS = ("H", "D", "A")
P = ["p_home", "p_draw", "p_away"]
#: Market names of goal_intervals() by selection.
MARKETS = {"home": "H", "draw": "D", "away": "A"}


def model_forecasts(fixtures: DataFrame, results: DataFrame, strengths: DataFrame, least_links: int = 300) -> DataFrame:
    """match_id, model and three probabilities by the goal model and, where enough results link ratings to outcomes, by Elo.
    fixtures: match_id, league, season, cutoff, home_team, away_team."""
    rates = models.expected_goals(fixtures, strengths)
    cells = S.cells(F.col("lambda_home"), F.col("lambda_away"), F.col("rho"))
    goals = rates.select("match_id", F.lit("goals").alias("model"), *(c.alias(p) for c, p in zip(S.one_x_two(cells), P)))
    fold = written(ratings.folded(results), "ratings")
    link = models.link_fits(ratings.history(fold), results, fixtures.select("league", "cutoff").distinct(), least=least_links).where("covariance IS NOT NULL")
    p = ordered_logit(models.rating_gap(), F.col("low"), F.col("log_gap"), F.col("slope"))
    elo = ratings.ratings_at(fixtures, fold).join(link, ["league", "cutoff"]).select("match_id", F.lit("elo").alias("model"), S.held(p).alias("p"))
    return goals.unionByName(elo.select("match_id", "model", *(F.col("p")[i].alias(c) for i, c in enumerate(P))))


def market_view(prices: DataFrame, now: Column) -> DataFrame:
    """One row a match from the prices visible now: best odds and mean margin-free probability by selection, books, age in hours."""
    seen = pit.latest(pit.visible(prices, now, "seen_at").select("match_id", "book", "supplier", "seen_at", "odds_h", "odds_d", "odds_a"), ["match_id", "book"], "seen_at", ["supplier"])
    odds = [F.col(c) for c in ("odds_h", "odds_d", "odds_a")]
    inverse = sum(1 / c for c in odds)
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.max("seen_at").cast("timestamp"))) / 3600
    return seen.groupBy("match_id").agg(F.array(*(F.max(c) for c in odds)).alias("odds"), F.array(*(F.median(1 / c / inverse) for c in odds)).alias("fair"), F.count("*").alias("books"), age.alias("age_hours"))


def standing(history: DataFrame, prices: DataFrame, kickoffs: DataFrame, model: str) -> dict:
    """What a model's past forecasts say about it: the calibrator for the next season, whether the market is shown to beat it,
    and whether its losses or hits have drifted. history: match_id, season, match_date, three probabilities, outcome."""
    own = history.withColumn("model", F.lit(model))
    fit = calibration.live(own, ["model"]).first()
    scored = evaluate.with_losses(own, P, "outcome").select("match_id", "match_date", "season", "outcome", *P, "log_loss")
    limits = kickoffs.select("match_id", (F.col("kickoff") - F.expr("INTERVAL 1 HOUR")).alias("limit"))
    quotes = pit.latest_at(prices.select("match_id", "book", "supplier", "seen_at", "odds_h", "odds_d", "odds_a"), limits, ["match_id"], ["match_id", "book"], "seen_at", "limit", ["supplier"])
    inverse = [1 / F.col(c) for c in ("odds_h", "odds_d", "odds_a")]
    fair = quotes.groupBy("match_id").agg(*(F.avg(x / sum(inverse)).alias(f"m{i}") for i, x in enumerate(inverse)))
    against = scored.join(fair, "match_id").withColumn("difference", F.col("log_loss") + F.ln(F.get(F.array("m0", "m1", "m2"), F.col("outcome")))).withColumn("model", F.lit(model))
    interval = evaluate.block_bootstrap(against, ["model"], F.date_trunc("week", F.col("match_date")), "difference").first()
    last = scored.agg(F.max("season")).first()[0]
    judged = scored.withColumns({"model": F.lit(model), "hit": (F.col("outcome") == 0).cast("int")})
    expected = judged.where(F.col("season") < last).groupBy("model").agg(F.avg("log_loss").alias("expected"))
    drift = reports.performance_drift(judged.where(F.col("season") == last), expected, ["model"], "log_loss", "p_home", "hit").first()
    return {
        "method": fit["method"] if fit else None, "calibrator": fit["calibrator"] if fit else None, "validated": bool(interval and interval["ci_low"] <= 0), "drift_alert": bool(drift and "ALERT" in (drift["loss_status"], drift["calibration_status"])),
    }


def candidates_at(matches: DataFrame, prices: DataFrame, at: str, days: int = 45, state: Mapping | None = None, least_links: int = 300) -> DataFrame:
    """One row per match to come and selection, with what decision.decide() asks: probability (calibrated if state has a
    calibrator), its lower bound, fair probability and best odds, measured quality, disagreement of the models, matches in the
    fit of both teams, flags. Nothing that became known after `at` is read. state: standing(), or None if nothing is known.
    """
    now, state = F.lit(at).cast("timestamp_ntz"), dict(state or {})
    results = pit.visible(matches.where("status = 'FINISHED'"), now, disputed="disputed")
    fixtures = pit.upcoming(matches, now, "kickoff", "match_date").where(F.col("kickoff") <= now + F.make_interval(days=F.lit(days)))
    fixtures = written(fixtures.select("match_id", "league", "season", "kickoff", "match_date", "home_team", "away_team", now.alias("cutoff")), "fixtures")
    strengths = written(models.goal_fits(results, matches.select("league").distinct().withColumn("cutoff", now)), "goal-fits")
    forecasts = written(model_forecasts(fixtures, results, strengths, least_links), "live-forecasts")
    apart = market.agreement(forecasts, ["match_id"], P).select("match_id", F.when(F.col("n_models") > 1, F.col("max_diff")).alias("disagreement"))
    known = strengths.where("team >= 0").select("league", "team", "matches")
    side = lambda name: known.select("league", F.col("team").alias(f"{name}_team"), F.col("matches").alias(f"{name}_matches"))
    fair = matches.where("status = 'FINISHED'").where(F.col("available_at") <= now).groupBy("league").agg((1 - F.avg(F.col("disputed").cast("double"))).alias("undisputed"))
    spread = models.goal_intervals(results, fixtures).where(F.col("market").isin(*MARKETS))
    low = spread.groupBy("match_id").agg(*(F.max(F.when(F.col("market") == name, F.col("low"))).alias(f"low_{s}") for name, s in MARKETS.items()))
    rows = fixtures.join(forecasts.where("model = 'goals'").select("match_id", F.array(*P).alias("raw")), "match_id").join(apart, "match_id", "left").join(side("home"), ["league", "home_team"], "left").join(side("away"), ["league", "away_team"], "left")
    rows = rows.join(fair, "league", "left").join(low, "match_id", "left").join(market_view(prices, now), "match_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("int") for c in ("home_matches", "away_matches")})
    calibrator = F.from_json(F.lit(state.get("calibrator") or calibration.IDENTITY), calibration.SCHEMA)
    shown = calibration.applied(F.col("raw"), calibrator)
    history = F.least(F.lit(1.0), F.least("home_matches", "away_matches") / 20.0)
    parts = {"history": (history, 1.0), "books": (F.least(F.lit(1.0), F.col("books") / 3.0), 1.0), "odds_freshness": (F.greatest(F.lit(0.0), 1 - F.col("age_hours") / 168.0), 1.0), "undisputed": (F.col("undisputed"), 1.0)}
    flags = F.array_compact(F.array(F.when(F.col("age_hours") > 72, "STALE_ODDS"), F.when(F.col("books") == 1, "SINGLE_BOOK")))
    rows = rows.withColumns({"p": shown, "quality": quality.composite(parts)[0], "flags": flags})
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("selection"), F.col("p")[i].alias("model_prob"), F.col("raw")[i].alias("raw_prob"), F.least(F.col(f"low_{s}"), F.col("p")[i]).alias("prob_low"), F.col("fair")[i].alias("fair_prob"), F.col("odds")[i].alias("odds")) for i, s in enumerate(SELECTIONS))))
    return rows.select(
        "match_id", "league", F.col("match_date").alias("day"), "home_team", "away_team", "quality", "disagreement", "home_matches", "away_matches", "flags",
        F.lit(state.get("method")).cast("string").alias("calibration"), F.lit(state.get("drift_alert")).cast("boolean").alias("drift_alert"), F.lit(state.get("validated")).cast("boolean").alias("validated"), each.alias("x"),
    ).select("*", "x.*").drop("x")
