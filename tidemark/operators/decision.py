"""Rule engine with reason codes, stake sizing with exposure caps, settlement."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import odds as O
from .evaluate import block_bootstrap


@dataclass(frozen=True)
class Thresholds:
    min_edge: float = 0.02
    min_ev: float = 0.03
    shrink: float = 0.5
    max_disagreement: float = 0.08
    min_quality: float = 0.60
    min_matches: int = 8
    min_odds: float = 1.30
    max_odds: float = 6.00


def decide(c: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Candidates with edge, ev, ev_conservative, ev_lower, status, reasons and warnings, all column expressions.

    Columns: model_prob, raw_prob, prob_low, fair_prob, odds, quality, disagreement, home_matches, away_matches, flags
    (array), calibration, drift_alert, validated. Null inputs of a rule leave it unanswered, as unknown.
    """
    col = F.col
    says = lambda cond, reason: F.when(F.coalesce(cond, F.lit(False)), reason if isinstance(reason, Column) else F.lit(reason))
    code = lambda f: F.split(f, ":")[0]
    none = F.array().cast("array<string>")
    no_model = col("model_prob").isNull() | F.isnan("model_prob")
    no_price = col("odds").isNull() | col("fair_prob").isNull()
    flags = F.coalesce("flags", none)
    lacking = F.array_compact(
        F.array(
            says(no_price, F.when(F.size(flags) > 0, code(F.get(flags, F.lit(0)))).otherwise("NO_MARKET_ODDS")),
            says(F.when(col("home_matches").isNotNull() & col("away_matches").isNotNull(), F.least("home_matches", "away_matches") < t.min_matches), "INSUFFICIENT_TEAM_HISTORY"),
            says(col("quality") < t.min_quality, "LOW_DATA_QUALITY"),
        )
    )
    out = c.withColumn("__lacking", F.when(no_model, F.array(F.lit("MODEL_UNAVAILABLE"))).otherwise(lacking))
    known = F.size("__lacking") == 0
    out = out.withColumns(
        {
            "edge": F.when(known, col("model_prob") - col("fair_prob")),
            "ev": F.when(known, O.expected_value(col("model_prob"), col("odds"))),
            "ev_raw": F.when(known, O.expected_value(col("raw_prob"), col("odds"))),
            "ev_conservative": F.when(known, O.expected_value(col("fair_prob") + t.shrink * (col("model_prob") - col("fair_prob")), col("odds"))),
            "ev_lower": F.when(known, O.expected_value(col("prob_low"), col("odds"))),
        }
    )
    ev, loss = col("ev"), col("ev") <= 0
    hard = F.concat(
        F.filter(flags, lambda f: code(f).isin("STALE_ODDS", "OUTLIER_BEST_PRICE")),
        F.array_compact(
            F.array(
                says(loss, "NEGATIVE_EV"), says(loss & (col("edge") > 0), "EDGE_CONSUMED_BY_MARGIN"), says(loss & (col("ev_raw") > 0), "EDGE_REMOVED_BY_CALIBRATION"), says(~col("odds").between(t.min_odds, t.max_odds), "ODDS_OUT_OF_RANGE"),
                says(col("disagreement") > t.max_disagreement, "MODEL_DISAGREEMENT"), says(col("drift_alert"), "DRIFT_ALERT"), says(~col("validated"), "MODEL_NOT_VALIDATED_VS_MARKET"),
            )
        ),
    )
    soft = F.concat(
        F.filter(flags, lambda f: code(f) == "SINGLE_BOOK"),
        F.array_compact(
            F.array(
                says(~loss & (ev < t.min_ev), "EV_BELOW_THRESHOLD"), says(~loss & (col("edge") < t.min_edge), "EDGE_BELOW_THRESHOLD"), says(~loss & (col("ev_conservative") <= 0), "EDGE_NOT_ROBUST_TO_UNCERTAINTY"),
                says(col("calibration").isNull(), "CALIBRATION_UNAVAILABLE"),
            )
        ),
    )
    out = out.withColumn("__hard", F.when(known, hard).otherwise(none)).withColumn("__soft", F.when(known, soft).otherwise(none))
    status = (
        F.when(~known, "INSUFFICIENT_DATA").when(F.size("__hard") > 0, "NO_BET").when(F.size("__soft") > 0, F.when(ev > 0, "WATCH").otherwise("NO_BET"))
        .when(col("ev_lower") > 0, "STRONG_CANDIDATE").otherwise("CANDIDATE")
    )
    out = out.withColumn("status", status).withColumn("reasons", F.when(known, F.concat("__hard", "__soft")).otherwise(F.col("__lacking")))
    weak = (F.col("status") == "CANDIDATE") & (col("ev_lower") <= 0)
    warnings = F.when(no_model, none).otherwise(F.array_compact(F.array(F.lit("LINEUP_UNKNOWN"), says(weak, "EV_LOWER_BOUND_NOT_POSITIVE"))))
    return out.withColumn("warnings", warnings).drop("__lacking", "__hard", "__soft")


@dataclass(frozen=True)
class Caps:
    single: float = 0.02
    day: float = 0.10
    match: float = 0.03
    team: float = 0.05
    league: float = 0.08
    correlated: float = 0.04


def capped(selections: DataFrame, caps: Caps = Caps(), key: str = "match_id") -> DataFrame:
    """selections with allowed and notes: stakes granted by falling conservative value, each within what the caps of its
    day, match, teams and league leave.

    Columns: day, league, home_team, away_team, stake, ev_conservative and key. Grants feed the caps, so a day's rows
    stream through one task in order; the state is the day's sums. A match lies within one day.
    """
    schema = T.StructType([*selections.schema.fields, T.StructField("allowed", T.DoubleType()), T.StructField("notes", T.ArrayType(T.StringType()))])

    ties = [c for c in (key, "selection", "stake") if c in selections.columns]

    def grant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        day, used = None, {}
        for pdf in batches:
            allowed, notes = [], []
            for r in pdf.itertuples(index=False):
                if r.day != day:
                    day, used = r.day, {}
                want, m = min(r.stake, caps.single), getattr(r, key)
                rules = [("day", ("d",), caps.day), ("match", ("m", m), caps.match), ("correlated", ("m", m), caps.correlated), ("home_team", ("t", r.home_team), caps.team), ("away_team", ("t", r.away_team), caps.team), ("league", ("l", r.league), caps.league)]
                left = {name: most - used.get(k, 0.0) for name, k, most in rules}
                got = max(0.0, min([want, *left.values()]))
                for k in {k for _, k, _ in rules}:
                    used[k] = used.get(k, 0.0) + got
                allowed.append(got)
                notes.append(sorted(f"{name}: {x:.4f} left of {most:.4f}" for (name, _, most), x in zip(rules, left.values(), strict=True) if x < want))
            yield pdf.assign(allowed=allowed, notes=notes)

    order = [F.coalesce(F.col("ev_conservative"), F.lit(0.0)).desc(), *ties]
    return selections.repartition("day").sortWithinPartitions("day", *order).mapInPandas(grant, schema)


# The texts of reason codes.
REASONS = {
    "NO_MARKET_ODDS": "no market odds available at decision time",
    "INCOMPLETE_MARKET": "market prices incomplete",
    "STALE_ODDS": "odds older than the staleness limit",
    "OUTLIER_BEST_PRICE": "best price far from consensus (possible stale/erroneous quote)",
    "SINGLE_BOOK": "only one bookmaker - no consensus",
    "NEGATIVE_EV": "expected value is not positive",
    "EV_BELOW_THRESHOLD": "expected value below threshold",
    "EDGE_BELOW_THRESHOLD": "edge vs fair market probability below threshold",
    "EDGE_CONSUMED_BY_MARGIN": "model beats the fair (margin-free) price but not the actual price: the apparent edge disappears after the bookmaker margin",
    "EDGE_REMOVED_BY_CALIBRATION": "the raw model showed value but the calibrated probability does not: the apparent edge disappears after calibration",
    "EDGE_NOT_ROBUST_TO_UNCERTAINTY": "EV is not positive at the conservative (market-shrunk) probability",
    "EV_LOWER_BOUND_NOT_POSITIVE": "EV at the lower uncertainty bound is not positive",
    "MODEL_DISAGREEMENT": "statistical models disagree beyond the limit",
    "LOW_DATA_QUALITY": "data quality below the minimum",
    "INSUFFICIENT_TEAM_HISTORY": "too few recent matches for at least one team",
    "ODDS_OUT_OF_RANGE": "odds outside the range where calibration is trusted",
    "CALIBRATION_UNAVAILABLE": "no validated calibration for this model yet",
    "LINEUP_UNKNOWN": "lineups not known at decision time (warning; conservative thresholds apply)",
    "MODEL_UNAVAILABLE": "model could not produce a prediction",
    "DRIFT_ALERT": "model/calibration drift alert active",
    "MODEL_NOT_VALIDATED_VS_MARKET": "the model has not shown out-of-sample information beyond the market (market-benchmark gate not passed), so apparent value is not trusted",
}


def reason_text(code: Column) -> Column:
    """What a reason code says; what follows a colon in it does not matter, and an unknown code is its own text."""
    texts = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    return F.coalesce(F.get(F.array(F.element_at(texts, F.substring_index(code, ":", 1))), F.lit(0)), code)


def settled(bets: DataFrame, won: Column, units: Column, odds: Column) -> DataFrame:
    return bets.withColumn("profit", O.settle(won, units, odds))


def summary(bets: DataFrame, by: list[str]) -> DataFrame:
    """Per group: selections, bets, wins, staked, profit, yield and the share of bets whose price beat the close."""
    placed = F.col("units") > 0
    staked, profit = F.sum(F.when(placed, F.col("units"))), F.sum(F.when(placed, F.col("profit")))
    return bets.groupBy(*by).agg(
        F.count("*").alias("selections"), F.count_if(placed).alias("bets"), F.count_if(placed & F.col("won")).alias("wins"), staked.alias("staked"), profit.alias("profit"), (profit / staked).alias("yield"),
        F.avg(F.when(placed, (F.col("clv") > 0).cast("double"))).alias("share_beating_close"),
    )


def summary_intervals(bets: DataFrame, by: list[str], block: Column, replicates: int = 1000) -> DataFrame:
    """Per group: yield and mean value against the close of placed bets, each with the 95 % interval of a block bootstrap."""
    placed = bets.where("units > 0")
    yields = block_bootstrap(placed, by, block, "profit", replicates, "yield", "units").select(*by, F.col("n").alias("bets"), F.col("mean").alias("yield"), F.col("ci_low").alias("yield_low"), F.col("ci_high").alias("yield_high"))
    closing = block_bootstrap(placed.where("clv IS NOT NULL"), by, block, "clv", replicates, "clv").select(*by, F.col("mean").alias("clv"), F.col("ci_low").alias("clv_low"), F.col("ci_high").alias("clv_high"))
    return yields.join(closing, by, "left")
