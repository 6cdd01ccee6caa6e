"""Reports over results, forecasts and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from .ledger import newest
from .quality import status


def inventory(matches: DataFrame, prices: DataFrame) -> DataFrame:
    """One row of global counts, and the season with the highest and lowest index of matches times (1 + books)."""
    teams = matches.select(F.explode(F.array("home_team", "away_team")).alias("t")).agg(F.count_distinct("t").alias("teams"))
    m = matches.agg(F.count("*").alias("matches"), F.count_distinct("league").alias("leagues"), F.count_distinct("league", "season").alias("seasons"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"))
    p = prices.agg(F.count("*").alias("prices"), F.count_distinct("book").alias("books"), F.count_distinct("match_id").alias("priced"))
    books = prices.join(matches.select("match_id", "season"), "match_id").groupBy("season").agg(F.count_distinct("book").alias("__books"))
    per = matches.groupBy("season").agg(F.count("*").alias("__m")).join(books, "season", "left").withColumn("n", F.col("__m") * (1 + F.coalesce("__books", F.lit(0))))
    per = per.agg(F.max_by("season", F.struct("n", "season")).alias("best_season"), F.min_by("season", F.struct("n", "season")).alias("worst_season"))
    out = m
    for other in (p, teams, per):  # rows of one
        out = out.withColumn("__j", F.lit(1)).join(other.withColumn("__j", F.lit(1)), "__j").drop("__j")
    return out


def families(experiments: DataFrame, family: str, candidates: str, alpha: float = 0.05) -> DataFrame:
    """Multiple testing: experiments and candidates tried per family, the corrected level, and false finds to expect."""
    n = F.sum(candidates)
    return experiments.groupBy(family).agg(F.count("*").alias("experiments"), n.alias("candidates"), (F.lit(alpha) / F.greatest(n, F.lit(1))).alias("corrected_alpha"), (n * alpha).alias("expected_false"))


def gates(scores: DataFrame, comparisons: DataFrame, reference: str, least: int = 1000, share: float = 0.6, calibration: DataFrame | None = None, market: str | None = None, audit: DataFrame | None = None, code_version: str | None = None, fingerprint: str | None = None, max_ece: float = 0.03, slopes: tuple[float, float] = (0.8, 1.25)) -> DataFrame:
    """Promotion gates per model: no leakage, enough forecasts, out of sample, calibrated, significantly better than the
    reference, steady over seasons, not beaten by the market, reproducible.

    audit: model, checked, violations: forecasts whose cutoffs were checked, and those that could know too much; out of sample
    are models all of whose scored forecasts were checked. calibration: model, ece, slope_low, slope_high (over the classes).
    What is not handed in fails its gate. A model may
    give probabilities if all gates but the market's pass, and bet if all do.
    """
    ref = scores.where(F.col("model") == reference).select("season", F.col("log_loss").alias("__ref"))
    per = scores.where(F.col("model") != reference).join(ref, "season", "left").groupBy("model").agg(F.sum("n").alias("n"), F.avg((F.col("log_loss") < F.col("__ref")).cast("double")).alias("share"))

    def against(other: str | None, name: str) -> DataFrame:
        a = comparisons.where(F.col("model_b") == other).select(F.col("model_a").alias("model"), F.col("ci_low").alias(f"{name}_low"), F.col("ci_high").alias(f"{name}_high"))
        b = comparisons.where(F.col("model_a") == other).select(F.col("model_b").alias("model"), (-F.col("ci_high")).alias(f"{name}_low"), (-F.col("ci_low")).alias(f"{name}_high"))
        return a.unionByName(b)

    g = per.join(against(reference, "ref"), "model", "left").join(against(market, "market"), "model", "left")
    measured = calibration if calibration is not None else per.select("model", *(F.lit(None).cast("double").alias(c) for c in ("ece", "slope_low", "slope_high")))
    g = g.join(measured.select("model", "ece", "slope_low", "slope_high"), "model", "left")
    checks = audit if audit is not None else per.select("model", F.lit(0).alias("checked"), F.lit(None).cast("bigint").alias("violations"))
    g = g.join(checks.select("model", F.col("checked").alias("__checked"), F.coalesce("violations", F.lit(0)).alias("__violations")), "model", "left")
    fine = lambda c: F.coalesce(c, F.lit(False))
    clean = code_version not in (None, "", "unknown") and not str(code_version).endswith("-dirty") and bool(fingerprint)
    named = {
        "no_leakage": fine((F.col("__checked") > 0) & (F.col("__violations") == 0)), "adequate_sample": fine(F.col("n") >= least), "out_of_sample": fine(F.col("__checked") >= F.col("n")), "calibration": fine((F.col("ece") <= max_ece) & (F.col("slope_low") >= slopes[0]) & (F.col("slope_high") <= slopes[1])),
        "beats_reference": fine(F.col("ref_high") < 0), "robustness": fine(F.col("share") >= share), "market_benchmark": fine(F.col("market_low") <= 0), "reproducibility": F.lit(clean),
    }
    every = lambda skip=(): F.array_min(F.array(*(c for name, c in named.items() if name not in skip)))
    return g.select("model", *(c.alias(name) for name, c in named.items()), every(("market_benchmark",)).alias("may_forecast"), every().alias("may_bet"))


def performance_drift(losses: DataFrame, expected: DataFrame, by: Sequence[str], loss: str, p: str, hit: str, least: int = 200) -> DataFrame:
    """Per group: mean loss against the expected one (one-sided), and hits against mean probability (two-sided), as z tests.

    expected: by, expected.
    """
    g = losses.groupBy(*by).agg(F.count("*").alias("n"), F.avg(loss).alias("mean_loss"), F.stddev_samp(loss).alias("__sd"), F.avg(F.col(hit).cast("double")).alias("observed"), F.avg(p).alias("predicted"), F.sum(F.col(p) * (1 - F.col(p))).alias("__v")).join(expected, list(by))
    z1 = (F.col("mean_loss") - F.col("expected")) / (F.col("__sd") / F.sqrt("n"))
    z2 = (F.col("observed") - F.col("predicted")) * F.col("n") / F.sqrt("__v")
    out = g.withColumn("z_loss", z1).withColumn("z_calibration", z2)
    return out.select(*by, "n", "mean_loss", "expected", "z_loss", status(M.normal_tail(F.col("z_loss")), F.col("n"), least).alias("loss_status"), "observed", "predicted", "z_calibration", status(2 * M.normal_tail(F.abs("z_calibration")), F.col("n"), least).alias("calibration_status"))


def ledger_status(latest: DataFrame, outcomes: DataFrame, ident: str = "row_id", start: float = 100.0) -> DataFrame:
    """One row: newest predictions, resolved ones, profit and the bankroll that it implies."""
    j = latest.join(outcomes.select(ident, "outcome", "profit"), ident, "left")
    return j.agg(F.count("*").alias("predictions"), F.count("outcome").alias("resolved"), F.count_if(F.col("outcome") == "WIN").alias("wins"), F.sum("profit").alias("profit"), (start + F.sum("profit")).alias("bankroll"))


def roles(events: DataFrame, key: str, order: str, role: str = "role") -> DataFrame:
    """Current role of each key of a registry: that of its last event; at most one champion, the last promoted, and the ones
    that it displaced are challengers again."""
    last = events.groupBy(key).agg(F.max_by(role, order).alias(role), F.max(order).alias("__at"))
    top = last.where(F.col(role) == "CHAMPION").agg(F.max("__at").alias("__top"))  # one row
    out = last.withColumn("__j", F.lit(1)).join(F.broadcast(top.withColumn("__j", F.lit(1))), "__j")
    return out.select(key, F.when((F.col(role) == "CHAMPION") & (F.col("__at") < F.col("__top")), "CHALLENGER").otherwise(F.col(role)).alias(role))


def health(runs: DataFrame, by: str, at: str, status: str, ties: Sequence[str] = ()) -> DataFrame:
    """Per provider or model: runs, failed runs, the last run's time and status."""
    return runs.groupBy(by).agg(F.count("*").alias("runs"), F.count_if(F.col(status) != "OK").alias("failed"), F.max(at).alias("last_at"), F.max_by(status, F.struct(at, *ties)).alias("last_status"))


def expected_losses(runs: DataFrame, at: str, summary: str, suffix: str = ":calibrated") -> DataFrame:
    """model, expected: losses of the latest run whose JSON summary (a map from name to loss) has calibrated ones."""
    each = runs.select(at, F.explode(F.from_json(summary, "map<string,double>")).alias("__name", "expected")).where(F.col("__name").endswith(suffix))
    model = F.expr(f"substring(__name, 1, length(__name) - {len(suffix)})")
    return each.groupBy(model.alias("model")).agg(F.max_by("expected", at).alias("expected"), F.max(at).alias("__at")).join(each.agg(F.max(at).alias("__at")), "__at").select("model", "expected")


def values(ledger: DataFrame, keys: Sequence[str], version: str = "version", status: str = "status") -> DataFrame:
    """Newest versions of a ledger's rows that are worth a look."""
    return newest(ledger, keys, version).where(~F.col(status).isin("NO_BET", "INSUFFICIENT_DATA"))


def listing(df: DataFrame, where: Column, order: Sequence[Column], limit: int) -> DataFrame:
    """The first rows that match: Spark keeps the limit per task, so nothing is sorted as a whole."""
    return df.where(where).orderBy(*order).limit(limit)


def write_report(tables: dict[str, DataFrame], path: str, kind: str = "json") -> None:
    """Each table of a report as files of its own; report tables are small, one file each."""
    for name, df in tables.items():
        out = df.coalesce(1).write.mode("overwrite")
        (out.csv(f"{path}/{name}", header=True) if kind == "csv" else out.json(f"{path}/{name}"))
