"""Forecast evaluation: losses, reliability, paired comparisons with block bootstrap intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..sources.scratch import written


def with_losses(forecasts: DataFrame, probabilities: Sequence[str], outcome: str) -> DataFrame:
    p, y = F.array(*probabilities), F.col(outcome)
    return forecasts.select("*", M.log_loss(p, y).alias("log_loss"), M.brier(p, y).alias("brier"), M.rps(p, y).alias("rps"))


def scores(losses: DataFrame, by: Sequence[str]) -> DataFrame:
    return losses.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("log_loss", "brier", "rps")))


def reliability(rows: DataFrame, by: Sequence[str], p: str, hit: Column, bins: int = 10, uniform: bool = False) -> DataFrame:
    """Per group and bin: lower, upper, n, mean_predicted, observed, ci_low, ci_high.

    Quantile edges (equal ones once) or uniform ones; a value on an edge belongs to the bin above, the last edge to the last bin.
    Edges are one row a group; groups are the caller's, such as models and classes.
    """
    shares = [i / bins for i in range(bins + 1)]
    edges = F.array(*map(F.lit, shares)) if uniform else F.array_sort(F.array_distinct(F.percentile(p, F.array(*map(F.lit, shares)))))
    per = rows.groupBy(*by).agg((F.first(edges) if uniform else edges).alias("__e"))
    per = per.withColumn("__e", F.when(F.size("__e") < 2, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.col("__e")))
    joined = rows.withColumn("__hit", hit.cast("int")).join(per, list(by))
    at = F.size(F.filter("__e", lambda e: e <= F.col(p))) - 1
    joined = joined.withColumn("bin", F.greatest(F.lit(0), F.least(at, F.size("__e") - 2)))
    out = joined.groupBy(*by, "bin").agg(F.first(F.get("__e", F.col("bin"))).alias("lower"), F.first(F.get("__e", F.col("bin") + 1)).alias("upper"), F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.sum("__hit").alias("__k"))
    ci = M.wilson(F.col("__k").cast("double"), F.col("n").cast("double"))
    return out.select(*by, "bin", "lower", "upper", "n", "mean_predicted", (F.col("__k") / F.col("n")).alias("observed"), ci["low"].alias("ci_low"), ci["high"].alias("ci_high"))


def calibration_error(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Expected calibration error of a reliability table."""
    return table.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("observed"))) / F.sum("n")).alias("ece"))


def paired(losses: DataFrame, key: str, model: str, loss: str, extra: Sequence[str] = ()) -> DataFrame:
    """Differences of loss between every two models on common keys, first model before the second by name.

    One group of a key holds its models' losses; pairs are made inside that group, whose size is the number of models.
    """
    sets = losses.groupBy(key, *extra).agg(F.array_sort(F.collect_list(F.struct(F.col(model).alias("m"), F.col(loss).alias("v")))).alias("__v"))
    pairs = F.flatten(F.transform("__v", lambda x, i: F.transform(F.slice(F.col("__v"), i + 2, F.size("__v")), lambda y: F.struct(x["m"].alias("model_a"), y["m"].alias("model_b"), (x["v"] - y["v"]).alias("difference")))))
    return sets.select(key, *extra, F.explode(pairs).alias("p")).select(key, *extra, "p.*")


def draw(seed: Column, number: Column, n: Column) -> Column:
    """A reproducible draw from 0 to n - 1 that both engines make alike."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", seed, number.cast("string"))), 1, 8), 16, 10).cast("long") % n


def block_bootstrap(rows: DataFrame, by: Sequence[str], block: Column, value: str, replicates: int = 200, seed: str = "boot", weight: str | None = None) -> DataFrame:
    """Per group: n, mean, 2.5 and 97.5 % quantiles of resampled means, and the share of means below zero. With a weight the
    means are sums of the value by sums of the weight.

    Rows shrink to a sum and count per block first; replicates draw block numbers by hash and look the sums up.
    """
    blocks = rows.groupBy(*by, block.alias("__block")).agg(F.sum(value).alias("__s"), (F.sum(weight) if weight else F.count("*")).alias("__c"), F.count("*").alias("__k"))
    blocks = blocks.withColumn("__b", F.row_number().over(Window.partitionBy(*by).orderBy("__block")) - 1)
    sizes = blocks.groupBy(*by).agg(F.count("*").alias("__n"), (F.sum("__s") / F.sum("__c")).alias("mean"), F.sum("__k").alias("n"))
    draws = sizes.select(*by, "__n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("__r")).select(*by, "__n", "__r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))).alias("__i"))
    draws = draws.withColumn("__b", draw(F.concat_ws("/", F.lit(seed), *by, F.col("__r").cast("string")), F.col("__i"), F.col("__n")).cast("int"))
    means = draws.join(blocks, [*by, "__b"]).groupBy(*by, "__r").agg((F.sum("__s") / F.sum("__c")).alias("__m"))
    found = means.groupBy(*by).agg(F.percentile("__m", F.lit(0.025)).alias("ci_low"), F.percentile("__m", F.lit(0.975)).alias("ci_high"), F.avg((F.col("__m") < 0).cast("double")).alias("p_a_better"))
    return sizes.drop("__n").join(found, list(by))


def verdict(low: Column, high: Column) -> Column:
    """What an interval of loss differences (first minus second) says."""
    return F.when(high < 0, "first beats second").when(low > 0, "second beats first").otherwise("no evidence of a difference")


def recalibration(rows: DataFrame, by: Sequence[str], p: str, hit: str, rounds: int = 8) -> DataFrame:
    """Slope and intercept of a logistic recalibration by Newton steps; each step is one aggregation over all rows."""
    z = F.log(F.greatest(F.least(F.col(p), F.lit(1 - 1e-6)), F.lit(1e-6)) / (1 - F.greatest(F.least(F.col(p), F.lit(1 - 1e-6)), F.lit(1e-6))))
    data = rows.select(*by, z.alias("__x"), F.col(hit).cast("double").alias("__y"))
    state = data.select(*by).distinct().select(*by, F.lit(0.0).alias("intercept"), F.lit(1.0).alias("slope"))
    for _ in range(rounds):
        state = written(state, "recalibration")  # one row a group; written so that steps don't pile up in one plan
        e = data.join(state, list(by)).withColumn("__m", 1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * F.col("__x")))))
        w, r = F.col("__m") * (1 - F.col("__m")), F.col("__y") - F.col("__m")
        s = e.groupBy(*by, "intercept", "slope").agg(F.sum(r).alias("g0"), F.sum(r * F.col("__x")).alias("g1"), F.sum(w).alias("h00"), F.sum(w * F.col("__x")).alias("h01"), F.sum(w * F.col("__x") ** 2).alias("h11"))
        det = F.col("h00") * F.col("h11") - F.col("h01") ** 2
        step = lambda a, b: F.when(F.abs(det) > 1e-12, a / det).otherwise(b)
        state = s.select(*by, (F.col("intercept") + step(F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1"), F.lit(0.0))).alias("intercept"), (F.col("slope") + step(F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0"), F.lit(0.0))).alias("slope"))
    return state


def drawdown(rows: DataFrame, by: Sequence[str], day: str, profit: str) -> DataFrame:
    """Largest fall of the running profit from its peak, by day."""
    days = rows.groupBy(*by, day).agg(F.sum(profit).alias("__p"))
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = days.withColumn("__cum", F.sum("__p").over(w)).withColumn("__top", F.max("__cum").over(w))
    return run.groupBy(*by).agg(F.max(F.col("__top") - F.col("__cum")).alias("max_drawdown"), F.sum("__p").alias("profit"), F.count("*").alias("days"))
