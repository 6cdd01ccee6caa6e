"""Queries on forecasts: losses, reliability, comparisons, agreement, drift of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, market
from ..sources.views import view
from .registry import Registry

R = Registry()
P = ("p_home", "p_draw", "p_away")
_LOSS = "l AS (SELECT *, -ln(CASE outcome WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END) ll, pow(p_home - (outcome=0)::INT, 2) + pow(p_draw - (outcome=1)::INT, 2) + pow(p_away - (outcome=2)::INT, 2) br, (pow(p_home - (outcome=0)::INT, 2) + pow(p_home + p_draw - (outcome<=1)::INT, 2)) / 2 rp FROM forecasts)"


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.with_losses(view(spark, sf_dir, "forecasts"), P, "outcome")


@R.add("eval_scores", f"SELECT * FROM (WITH {_LOSS} SELECT model, season, count(*) n, round(avg(ll), 6) log_loss, round(avg(br), 6) brier, round(avg(rp), 6) rps FROM l GROUP BY ALL) z", ("forecasts",))
def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean losses of each model and season."""
    out = evaluate.scores(losses(spark, sf_dir), ["model", "season"])
    return out.select("model", "season", "n", *(F.round(c, 6).alias(c) for c in ("log_loss", "brier", "rps")))


@R.add("eval_season_table", f"SELECT * FROM (WITH {_LOSS} SELECT season, round(avg(CASE WHEN model='alpha' THEN ll END), 6) alpha, round(avg(CASE WHEN model='beta' THEN ll END), 6) beta, round(avg(CASE WHEN model='gamma' THEN ll END), 6) gamma FROM l GROUP BY season) z", ("forecasts",))
def eval_season_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season by model table of log loss."""
    out = losses(spark, sf_dir).groupBy("season").pivot("model", ["alpha", "beta", "gamma"]).agg(F.avg("log_loss"))
    return out.select("season", *(F.round(m, 6).alias(m) for m in ("alpha", "beta", "gamma")))


@R.add(
    "eval_reliability",
    """SELECT * FROM (WITH e AS (SELECT model, list_sort(list_distinct(quantile_cont(p_home, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) e FROM forecasts GROUP BY model),
    b AS (SELECT f.model, e.e, p_home, (outcome = 0)::INT hit, greatest(0, least(len(list_filter(e.e, lambda x: x <= p_home)) - 1, len(e.e) - 2)) bin FROM forecasts f JOIN e ON f.model = e.model),
    g AS (SELECT model, bin, any_value(e[bin+1]) lower, any_value(e[bin+2]) upper, count(*) n, avg(p_home) mean_predicted, sum(hit)::DOUBLE k FROM b GROUP BY model, bin)
    SELECT model, bin::INT bin, round(lower, 6) lower, round(upper, 6) upper, n, round(mean_predicted, 6) mean_predicted, round(k/n, 6) observed,
      round(greatest(0, ((k/n + 1.96*1.96/(2*n)) - 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4.0*n*n))) / (1+1.96*1.96/n)), 6) ci_low, round(least(1, ((k/n + 1.96*1.96/(2*n)) + 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4.0*n*n))) / (1+1.96*1.96/n)), 6) ci_high FROM g) z""",
    ("forecasts",),
)
def eval_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of the home probability in quantile bins with Wilson intervals."""
    out = evaluate.reliability(view(spark, sf_dir, "forecasts"), ["model"], "p_home", F.col("outcome") == 0)
    return out.select("model", "bin", *(F.round(c, 6).alias(c) for c in ("lower", "upper")), "n", *(F.round(c, 6).alias(c) for c in ("mean_predicted", "observed", "ci_low", "ci_high")))


@R.add(
    "eval_bootstrap",
    f"""SELECT * FROM (WITH {_LOSS}, d AS (SELECT a.match_id, a.model model_a, b.model model_b, a.ll - b.ll d, date_trunc('week', a.match_date) wk FROM l a JOIN l b ON a.match_id = b.match_id AND a.model < b.model),
    k AS (SELECT model_a, model_b, wk, sum(d) s, count(*) c, row_number() OVER (PARTITION BY model_a, model_b ORDER BY wk) - 1 b FROM d GROUP BY model_a, model_b, wk),
    z AS (SELECT model_a, model_b, count(*) n FROM k GROUP BY ALL),
    r AS (SELECT model_a, model_b, n, r, unnest(range(1, n + 1)) i FROM (SELECT *, unnest(range(1, 1001)) r FROM z) q),
    x AS (SELECT r.model_a, r.model_b, r.r, sum(s) / sum(c) m FROM r JOIN k ON r.model_a = k.model_a AND r.model_b = k.model_b AND k.b = concat('0x', substr(md5(concat_ws('/', 'boot', r.model_a, r.model_b, r.r::VARCHAR, i::VARCHAR)), 1, 8))::BIGINT % r.n GROUP BY ALL)
    SELECT model_a, model_b, (SELECT count(*) FROM d WHERE d.model_a = x.model_a AND d.model_b = x.model_b) n, (SELECT round(avg(d), 6) FROM d WHERE d.model_a = x.model_a AND d.model_b = x.model_b) mean, round(quantile_cont(m, 0.025), 6) ci_low, round(quantile_cont(m, 0.975), 6) ci_high, round(avg((m < 0)::INT), 6) p_a_better,
      CASE WHEN quantile_cont(m, 0.975) < 0 THEN 'first beats second' WHEN quantile_cont(m, 0.025) > 0 THEN 'second beats first' ELSE 'no evidence of a difference' END verdict FROM x GROUP BY model_a, model_b) y""",
    ("forecasts",),
)
def eval_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired comparison of all models: mean difference of log loss with a weekly block bootstrap interval and its reading."""
    d = evaluate.paired(losses(spark, sf_dir), "match_id", "model", "log_loss", ["match_date"])
    out = evaluate.block_bootstrap(d, ["model_a", "model_b"], F.date_trunc("week", F.col("match_date")), "difference", replicates=1000)
    return out.select("model_a", "model_b", "n", *(F.round(c, 6).alias(c) for c in ("mean", "ci_low", "ci_high", "p_a_better")), evaluate.verdict(F.col("ci_low"), F.col("ci_high")).alias("verdict"))


@R.add(
    "eval_agreement",
    """SELECT * FROM (WITH s AS (SELECT match_id, count(*) n_models, greatest(max(p_home)-min(p_home), max(p_draw)-min(p_draw), max(p_away)-min(p_away)) d, stddev_pop(p_home) sd, avg(p_home) mh, avg(p_draw) md, avg(p_away) ma FROM forecasts GROUP BY match_id),
    j AS (SELECT f.match_id, avg(0.5*(p_home*ln(p_home/((p_home+mh)/2)) + p_draw*ln(p_draw/((p_draw+md)/2)) + p_away*ln(p_away/((p_away+ma)/2))) + 0.5*(mh*ln(mh/((p_home+mh)/2)) + md*ln(md/((p_draw+md)/2)) + ma*ln(ma/((p_away+ma)/2)))) js FROM forecasts f JOIN s ON f.match_id = s.match_id GROUP BY f.match_id)
    SELECT s.match_id, n_models, round(d, 6) max_diff, round(sd, 6) sd_home, round(js, 6) mean_js, CASE WHEN d <= 0.05 THEN 'HIGH' WHEN d <= 0.08 THEN 'MODERATE' ELSE 'LOW' END AS level FROM s JOIN j ON s.match_id = j.match_id) z""",
    ("forecasts",),
)
def eval_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the models of a match are apart."""
    out = market.agreement(view(spark, sf_dir, "forecasts"), ["match_id"], P)
    return out.select("match_id", "n_models", F.round("max_diff", 6).alias("max_diff"), F.round(F.col("sd")[0], 6).alias("sd_home"), F.round("mean_js", 6).alias("mean_js"), "level")


def _newton(rounds: int = 8) -> str:
    """One common table expression a Newton step."""
    steps = ["s0 AS (SELECT DISTINCT model, 0.0::DOUBLE i, 1.0::DOUBLE s FROM z)"]
    for k in range(rounds):
        sums = "sum(y - m) g0, sum((y - m) * x) g1, sum(m * (1 - m)) h00, sum(m * (1 - m) * x) h01, sum(m * (1 - m) * x * x) h11"
        steps.append(f"e{k} AS (SELECT model, i, s, {sums} FROM (SELECT z.model, i, s, x, y, 1 / (1 + exp(-(i + s * x))) m FROM z JOIN s{k} ON z.model = s{k}.model) q GROUP BY model, i, s)")
        steps.append(f"s{k + 1} AS (SELECT model, i + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) i, s + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) s FROM e{k})")
    return ", ".join(steps)


@R.add("eval_recalibration", f"SELECT * FROM (WITH z AS (SELECT model, ln(p_home / (1 - p_home)) x, (outcome = 0)::INT::DOUBLE y FROM forecasts), {_newton()} SELECT model, round(s, 5) slope, round(i, 5) intercept FROM s8) w", ("forecasts",))
def eval_recalibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and intercept of each model's home probability."""
    rows = view(spark, sf_dir, "forecasts").withColumn("hit", (F.col("outcome") == 0).cast("int"))
    out = evaluate.recalibration(rows, ["model"], "p_home", "hit")
    return out.select("model", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"))
