"""Queries that report: inventory, listings, gates, drift, ledger status, live candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import VERSION
from ..functions import odds as O
from ..functions import scores as S
from ..operators import decision, evaluate, ledger, live, market, merge, models, pit, registry, reports
from ..sources.lake import _has_files
from ..sources.scratch import new_path, written
from ..sources.views import view
from .decision_queries import DECIDE, candidates
from .evaluation_queries import losses
from .market_queries import SELECTIONS, last_quotes
from .model_queries import GRID, by_rates, fixtures_of, forecast_models
from .registry import Registry

R = Registry()
_LL = "l AS (SELECT *, -ln(CASE outcome WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END) ll FROM forecasts)"


@R.add("report_inventory", "SELECT count(*) matches, count(DISTINCT league) leagues, count(DISTINCT (league, season)) seasons, min(match_date) first_date, max(match_date) last_date, (SELECT count(*) FROM prices) prices, (SELECT count(DISTINCT book) FROM prices) books, (SELECT count(DISTINCT match_id) FROM prices) priced, (SELECT count(DISTINCT t) FROM (SELECT home_team t FROM matches UNION SELECT away_team FROM matches) q) teams, (SELECT arg_max(season, (n, season)) FROM (SELECT season, count(DISTINCT m2.match_id) * (1 + count(DISTINCT book)) n FROM matches m2 LEFT JOIN prices p2 ON m2.match_id = p2.match_id GROUP BY season) a) best_season, (SELECT arg_min(season, (n, season)) FROM (SELECT season, count(DISTINCT m3.match_id) * (1 + count(DISTINCT book)) n FROM matches m3 LEFT JOIN prices p3 ON m3.match_id = p3.match_id GROUP BY season) b) worst_season FROM matches", ("matches", "prices"))
def report_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global inventory."""
    return reports.inventory(view(spark, sf_dir, "matches"), view(spark, sf_dir, "prices"))


@R.add("report_listing", "SELECT match_id, league, season, match_date, status FROM matches WHERE league = 1 AND season >= 1996 AND status = 'FINISHED' ORDER BY match_date DESC, match_id DESC LIMIT 200", ("matches",))
def report_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 finished matches of a league."""
    cond = (F.col("league") == 1) & (F.col("season") >= 1996) & (F.col("status") == "FINISHED")
    return reports.listing(view(spark, sf_dir, "matches"), cond, [F.col("match_date").desc(), F.col("match_id").desc()], 200).select("match_id", "league", "season", "match_date", "status")


@R.add("report_match_detail", "SELECT m.match_id, m.status, (SELECT string_agg(DISTINCT book::VARCHAR, ',' ORDER BY book::VARCHAR) FROM prices p WHERE p.match_id = m.match_id) books, (SELECT count(*) FROM prices p WHERE p.match_id = m.match_id) n_prices, (SELECT string_agg(model, ',' ORDER BY model) FROM forecasts f WHERE f.match_id = m.match_id) models FROM matches m", ("matches", "prices", "forecasts"))
def report_match_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each match with its books and models."""
    text = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    p = view(spark, sf_dir, "prices").groupBy("match_id").agg(text(F.col("book").cast("string")).alias("books"), F.count("*").alias("n_prices"))
    f = view(spark, sf_dir, "forecasts").groupBy("match_id").agg(text(F.col("model")).alias("models"))
    return view(spark, sf_dir, "matches").select("match_id", "status").join(p, "match_id", "left").join(f, "match_id", "left").withColumn("n_prices", F.coalesce("n_prices", F.lit(0)))


@R.add("report_odds_history", "SELECT match_id, book, string_agg(odds_h::VARCHAR, ' ' ORDER BY seen_at, supplier) AS history FROM (SELECT match_id, book, seen_at, supplier, (odds_h * 100)::INT odds_h FROM prices) q GROUP BY match_id, book", ("prices",))
def report_odds_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prices of each match and book in order of availability, in cents."""
    p = view(spark, sf_dir, "prices").select("match_id", "book", F.struct("seen_at", "supplier", F.round(F.col("odds_h") * 100).cast("int").cast("string").alias("o")).alias("x"))
    return p.groupBy("match_id", "book").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["o"]), " ").alias("history"))


@R.add("report_families", "SELECT model AS family, count(*) experiments, sum(n)::BIGINT candidates, round(0.05 / sum(n), 10) corrected_alpha, round(sum(n) * 0.05, 4) expected_false FROM (SELECT model, season, count(*) n FROM forecasts GROUP BY ALL) q GROUP BY model", ("forecasts",))
def report_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiple-testing account of the forecasts, a season as one experiment."""
    e = view(spark, sf_dir, "forecasts").groupBy(F.col("model").alias("family"), "season").agg(F.count("*").alias("n"))
    out = reports.families(e, "family", "n")
    return out.select("family", "experiments", "candidates", F.round("corrected_alpha", 10).alias("corrected_alpha"), F.round("expected_false", 4).alias("expected_false"))


def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotion gates of every model against the first one. Leaks and overlaps are counted on the forecasts: each has the day's
    start as cutoff and prediction time, but one in a thousand of the last model claims a cutoff of the day after."""
    scored = losses(spark, sf_dir)
    d = evaluate.paired(scored, "match_id", "model", "log_loss", ["match_date"])
    boot = evaluate.block_bootstrap(d, ["model_a", "model_b"], F.date_trunc("week", F.col("match_date")), "difference", replicates=200)
    classes = [evaluate.recalibration(scored.withColumn("hit", (F.col("outcome") == k).cast("int")), ["model"], p, "hit") for k, p in enumerate(("p_home", "p_draw", "p_away"))]
    slopes = classes[0].unionByName(classes[1]).unionByName(classes[2]).groupBy("model").agg(F.min("slope").alias("slope_low"), F.max("slope").alias("slope_high"))
    ece = evaluate.calibration_error(evaluate.reliability(scored, ["model"], "p_home", F.col("outcome") == 0), ["model"])
    day = F.col("match_date").cast("timestamp_ntz")
    dated = scored.select("model", "match_id", "match_date").join(view(spark, sf_dir, "matches").select("match_id", "kickoff"), "match_id")
    dated = dated.withColumns({"predicted_at": day, "cutoff": F.when((F.col("model") == "gamma") & (F.col("match_id") % 1000 == 7), day + F.expr("INTERVAL 1 DAY")).otherwise(day)})
    audit = dated.groupBy("model").agg(F.count("*").alias("checked")).join(pit.cutoff_violations(dated, ["cutoff"], "predicted_at", "kickoff").groupBy("model").agg(F.count("*").alias("violations")), "model", "left")
    data = pit.fingerprint(view(spark, sf_dir, "matches"), ["match_id", "home_goals", "away_goals", "available_at"]).first()["fingerprint"]
    return reports.gates(evaluate.scores(scored, ["model", "season"]), boot, "alpha", calibration=ece.join(slopes, "model"), market="gamma", audit=audit, code_version=VERSION, fingerprint=data)


@R.add("report_gates")
def report_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotion gates of every model against the first one, with leaks counted on its forecasts."""
    return gate_report(spark, sf_dir)


_CHAIN = """e AS (SELECT model AS family, season, row_number() OVER (PARTITION BY model ORDER BY season) AS v, count(*) AS n, sum(match_id)::BIGINT::VARCHAR AS body FROM forecasts GROUP BY model, season),
  r(family, v, id, hash, parent_hash) AS (SELECT family, 0::BIGINT, NULL::VARCHAR, repeat('0', 64), NULL::VARCHAR FROM (SELECT DISTINCT family FROM e) UNION ALL
    SELECT q.family, q.v, concat('exp-', substr(q.h, 1, 16)), q.h, q.ph FROM (SELECT e.family, e.v, r.hash AS ph, sha256(concat(concat_ws('|', concat(length(e.family), ':', e.family), concat(length(e.season::VARCHAR), ':', e.season), coalesce(length(r.id) || ':' || r.id, 'N'), concat(length(e.v::VARCHAR), ':', e.v), '19:2024-01-01 00:00:00',
      concat(length(e.n::VARCHAR), ':', e.n), '5:false', concat(length(e.body), ':', e.body), '2:{}'), '#', r.hash)) AS h FROM r JOIN e ON e.family = r.family AND e.v = r.v + 1) q)"""


def experiment_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger in which every season of a model's forecasts is an experiment built on the one of the season before, added
    season by season."""
    per = view(spark, sf_dir, "forecasts").groupBy(F.col("model").alias("family"), "season").agg(F.count("*").alias("n_candidates"), F.sum("match_id").cast("string").alias("body"))
    per = written(per.withColumn("v", F.row_number().over(Window.partitionBy("family").orderBy("season"))), "experiments")
    ledger = spark.createDataFrame([], registry.LEDGER)
    for v in range(1, (per.agg(F.max("v")).first()[0] or 0) + 1):
        last = ledger.where(F.col("version") == v - 1).select("family", F.col("experiment_id").alias("parent_id"))
        new = per.where(F.col("v") == v).join(last, "family", "left").select(
            "family", F.col("season").cast("string").alias("name"), "parent_id", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"), "n_candidates", F.lit(False).alias("used_holdout"), "body", F.lit("{}").alias("metrics")
        )
        rows, _ = registry.recorded(new, ledger)
        ledger = written(ledger.unionByName(rows), "ledger")
    return ledger


@R.add("registry_ledger", f"SELECT * FROM (WITH RECURSIVE {_CHAIN} SELECT family, v::INT AS version, id AS experiment_id, parent_hash, hash AS content_hash FROM r WHERE v > 0) z", ("forecasts",))
def registry_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments chained by hashes of themselves and their parents."""
    return experiment_ledger(spark, sf_dir).select("family", "version", "experiment_id", "parent_hash", "content_hash")


@R.add("registry_tampered", "SELECT model AS family, 3::INT AS version, 'CONTENT' AS reason FROM forecasts GROUP BY model HAVING model <> 'alpha' AND count(DISTINCT season) >= 3 UNION ALL SELECT model, 2::INT, 'PARENT_LOST' FROM forecasts GROUP BY model HAVING model = 'alpha' AND count(DISTINCT season) >= 2", ("forecasts",))
def registry_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verification finds after metrics of third versions were changed and the first version of one family was removed."""
    whole = experiment_ledger(spark, sf_dir)
    hit = (F.col("version") == 3) & (F.col("family") != "alpha")
    changed = whole.where("NOT (family = 'alpha' AND version = 1)").withColumn("metrics", F.when(hit, '{"x": 1}').otherwise(F.col("metrics")))
    return registry.tampered(changed).join(whole.select("experiment_id", "family", "version"), "experiment_id").select("family", "version", "reason")


@R.add("report_roles", "SELECT model, CASE WHEN model = 'gamma' THEN 'CHAMPION' WHEN model = 'alpha' THEN 'RETIRED' ELSE 'CHALLENGER' END AS role FROM (SELECT model, count(*) n FROM forecasts GROUP BY model HAVING count(*) > 0) q", ("forecasts",))
def report_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of a registry: models are promoted in turn by the gates stored for them; the displaced ones are challengers again,
    the first one is retired, and the promotion of a model whose gates failed last is refused."""
    names = ["adequate_sample"]
    per = view(spark, sf_dir, "forecasts").groupBy("model").agg(F.count("*").alias("n"))
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    turn = F.when(F.col("model") == "alpha", "2024-01-01").when(F.col("model") == "beta", "2024-01-02").otherwise("2024-01-03").cast("timestamp_ntz")
    gates = per.select("model", (F.col("n") > 0).alias("adequate_sample"), (F.col("n") > 0).alias("may_forecast"), F.lit(False).alias("may_bet"), at("2023-12-31").alias("checked_at"))
    gates = gates.unionByName(gates.where("model = 'beta'").withColumns({"adequate_sample": F.lit(False), "may_forecast": F.lit(False), "checked_at": at("2024-02-01")}))
    asked = per.select("model", F.lit("probability").alias("scope"), turn.alias("at")).unionByName(per.where("model = 'beta'").select("model", F.lit("probability").alias("scope"), at("2024-02-02").alias("at")))
    promoted, _ = registry.promotions(asked, gates, names)
    events = promoted.select("model", "at", F.lit("CHAMPION").alias("role")).unionByName(per.select("model", at("2023-01-01").alias("at"), F.lit("CHALLENGER").alias("role"))).unionByName(per.where("model = 'alpha'").select("model", at("2024-03-01").alias("at"), F.lit("RETIRED").alias("role")))
    return reports.roles(events, "model", "at")


@R.add(
    "report_performance_drift",
    f"SELECT * FROM (WITH {_LL}, r AS (SELECT model, count(*) n, avg(ll) m, stddev_samp(ll) sd, avg((outcome = 0)::INT) o, avg(p_home) p, sum(p_home * (1 - p_home)) v FROM l WHERE season >= 1999 GROUP BY model), e AS (SELECT model, avg(ll) x FROM l WHERE season < 1999 GROUP BY model) SELECT r.model, n, round(m, 6) mean_loss, round(x, 6) expected, round((m - x) / (sd / sqrt(n)), 5) z_loss, round(o, 6) observed, round(p, 6) predicted, round((o - p) * n / sqrt(v), 5) z_calibration FROM r JOIN e ON r.model = e.model) z",
    ("forecasts",),
)
def report_performance_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent losses and hits of each model against what earlier seasons led to expect."""
    scored = losses(spark, sf_dir).withColumn("hit", (F.col("outcome") == 0).cast("int"))
    expected = scored.where("season < 1999").groupBy("model").agg(F.avg("log_loss").alias("expected"))
    out = reports.performance_drift(scored.where("season >= 1999"), expected, ["model"], "log_loss", "p_home", "hit")
    return out.select("model", "n", *(F.round(c, 6).alias(c) for c in ("mean_loss", "expected")), F.round("z_loss", 5).alias("z_loss"), *(F.round(c, 6).alias(c) for c in ("observed", "predicted")), F.round("z_calibration", 5).alias("z_calibration"))


@R.add("report_ledger_status", "SELECT count(*) predictions, count(CASE WHEN status = 'FINISHED' THEN 1 END) resolved, count(CASE WHEN status = 'FINISHED' AND home_goals > away_goals THEN 1 END) wins, round(sum(CASE WHEN status = 'FINISHED' THEN CASE WHEN home_goals > away_goals THEN odds_h - 1 ELSE -1 END END), 4) profit, round(100 + sum(CASE WHEN status = 'FINISHED' THEN CASE WHEN home_goals > away_goals THEN odds_h - 1 ELSE -1 END END), 4) bankroll FROM (SELECT match_id, arg_max(odds_h, (seen_at, supplier)) odds_h FROM prices WHERE book = 1 GROUP BY match_id) p JOIN matches m ON p.match_id = m.match_id", ("matches", "prices"))
def report_ledger_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of a ledger that holds a home bet at the first book's latest price of every match."""
    last = pit.latest(view(spark, sf_dir, "prices").where("book = 1").select("match_id", "seen_at", "supplier", "odds_h"), ["match_id"], "seen_at", ["supplier"])
    ledger = last.select(F.col("match_id").cast("string").alias("row_id"), "match_id", "odds_h")
    m = view(spark, sf_dir, "matches").where("status = 'FINISHED'")
    won = F.col("home_goals") > F.col("away_goals")
    outcomes = ledger.join(m.select("match_id", "home_goals", "away_goals"), "match_id").select("row_id", F.when(won, "WIN").otherwise("LOSS").alias("outcome"), F.when(won, F.col("odds_h") - 1).otherwise(-1.0).alias("profit"))
    out = reports.ledger_status(ledger, outcomes)
    return out.select("predictions", "resolved", "wins", F.round("profit", 4).alias("profit"), F.round("bankroll", 4).alias("bankroll"))


@R.add("report_drawdown", "SELECT * FROM (WITH d AS (SELECT league, match_date, sum(CASE WHEN home_goals > away_goals THEN 1 ELSE -1 END) p FROM matches WHERE status = 'FINISHED' GROUP BY ALL), c AS (SELECT league, p, sum(p) OVER (PARTITION BY league ORDER BY match_date ROWS UNBOUNDED PRECEDING) cum, match_date FROM d), t AS (SELECT *, max(cum) OVER (PARTITION BY league ORDER BY match_date ROWS UNBOUNDED PRECEDING) top FROM c) SELECT league, max(top - cum)::BIGINT max_drawdown, sum(p)::BIGINT profit, count(*) AS days FROM t GROUP BY league) z", ("matches",))
def report_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest fall of a running profit, by league."""
    bets = view(spark, sf_dir, "matches").where("status = 'FINISHED'").select("league", "match_date", F.when(F.col("home_goals") > F.col("away_goals"), 1).otherwise(-1).alias("profit"))
    return evaluate.drawdown(bets, ["league"], "match_date", "profit")


@R.add("report_top_scores", f"""SELECT * FROM (WITH {GRID}, k AS (SELECT match_id, concat(i, '-', j) score, row_number() OVER (PARTITION BY match_id ORDER BY round(p, 12) DESC, i, j) r FROM n) SELECT match_id, string_agg(score, ',' ORDER BY r) AS top FROM k WHERE r <= 6 GROUP BY match_id) z""", ("matches",))
def report_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six likeliest scores of every match; equal ones (to twelve digits) in the order of their goals."""
    cells = S.held(S.cells(F.col("lh"), F.col("la"), F.lit(-0.05)))
    return by_rates(spark, sf_dir, lambda r: r.select("lh", "la", cells.alias("m")).select("lh", "la", F.concat_ws(",", S.top_scores(F.col("m"))).alias("top"))).select("match_id", "top")


@R.add("market_model", "SELECT * FROM (WITH v AS (SELECT p.* FROM prices p JOIN matches m ON p.match_id = m.match_id WHERE seen_at <= kickoff - INTERVAL 1 HOUR QUALIFY row_number() OVER (PARTITION BY p.match_id, book ORDER BY seen_at DESC, supplier DESC) = 1), f AS (SELECT match_id, (1/odds_h)/(1/odds_h+1/odds_d+1/odds_a) h, (1/odds_d)/(1/odds_h+1/odds_d+1/odds_a) d, (1/odds_a)/(1/odds_h+1/odds_d+1/odds_a) a FROM v), g AS (SELECT match_id, count(*) n, median(h)/(median(h)+median(d)+median(a)) p, stddev_pop(h) sd FROM f GROUP BY match_id) SELECT match_id, round(p, 6) p_home, round(greatest(0, p - 1.645 * CASE WHEN n > 1 THEN sd ELSE 0 END), 6) low, round(least(1, p + 1.645 * CASE WHEN n > 1 THEN sd ELSE 0 END), 6) high FROM g) z", ("matches", "prices"))
def market_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market as a model: consensus probability with an interval from the books' dispersion."""
    keys = ["match_id", "as_of"]
    books = market.complete_books(last_quotes(spark, sf_dir), keys, "book", "selection", "odds", "seen_at", SELECTIONS, "multiplicative")
    c = market.consensus(books, keys, "book", SELECTIONS)
    i = market.combined_interval(F.col("consensus")[0], F.col("dispersion")[0], F.lit(None).cast("double"))
    return c.select("match_id", F.round(F.col("consensus")[0], 6).alias("p_home"), F.round(i["low"], 6).alias("low"), F.round(i["high"], 6).alias("high"))


@R.add("stats_by_priority", "SELECT match_id, CASE WHEN match_id % 2 = 0 THEN home_goals ELSE away_goals END AS shots, away_goals AS corners FROM matches WHERE status = 'FINISHED'", ("matches",))
def stats_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of statistics from two sources merged per match, the better source first per entry."""
    m = view(spark, sf_dir, "matches").where("status = 'FINISHED'")
    a = m.where("match_id % 2 = 0").select("match_id", F.lit("alpha").alias("source"), F.create_map(F.lit("shots"), F.col("home_goals")).alias("stats"))
    b = m.select("match_id", F.lit("beta").alias("source"), F.create_map(F.lit("shots"), F.col("away_goals"), F.lit("corners"), F.col("away_goals")).alias("stats"))
    out = merge.merged_stats(a.unionByName(b), ["match_id"], "stats", "source", ["alpha", "beta"])
    return out.select("match_id", F.col("stats")["shots"].alias("shots"), F.col("stats")["corners"].alias("corners"))


@R.add("duplicate_ordinals", "SELECT match_id, CASE WHEN n = 0 THEN k ELSE concat(k, '#', n) END AS key FROM (SELECT match_id, concat(league, ':', match_date, ':', home_team) k, row_number() OVER (PARTITION BY league, match_date, home_team ORDER BY match_id) - 1 n FROM matches) q", ("matches",))
def duplicate_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural keys made unique by ordinals."""
    m = view(spark, sf_dir, "matches").select("match_id", F.concat_ws(":", "league", "match_date", "home_team").alias("key"))
    return merge.duplicate_ordinals(m, "key", "match_id")


_CANDIDATE = "match_id long, league int, day date, selection string, status string, model_prob double, fair_prob double, odds double, stake double, allowed double"
_LEDGER = f"{_CANDIDATE}, predicted_at timestamp_ntz, version int, supersedes string, row_id string"


def live_run(m: DataFrame, prices: DataFrame, at: str, path: str, state: dict | None = None, least_links: int = 300) -> DataFrame:
    """Judge the upcoming fixtures as of a time and append to the ledger at path those that are new or changed; the rows appended."""
    spark, now = m.sparkSession, F.lit(at).cast("timestamp_ntz")
    rows = written(live.candidates_at(m, prices, at, state=state, least_links=least_links), "live-candidates")
    judged = decision.decide(rows)
    stake = F.when(F.col("status").isin("CANDIDATE", "STRONG_CANDIDATE"), O.stake(F.col("fair_prob") + 0.5 * (F.col("model_prob") - F.col("fair_prob")), F.col("odds"))).otherwise(0.0)
    out = decision.capped(judged.withColumn("stake", stake).drop("flags", "reasons", "warnings"))
    # Rounded, so that a fit or a sum made in another order is no change.
    watched = ["status", "model_prob", "fair_prob", "odds", "allowed"]
    found = out.withColumns({c: F.round(c, 9) for c in ("model_prob", "fair_prob", "stake", "allowed")}).to(spark.createDataFrame([], _CANDIDATE).schema)
    old = spark.read.schema(_LEDGER).parquet(path) if _has_files(spark, path) else spark.createDataFrame([], _LEDGER)
    new = ledger.changed(found.withColumn("predicted_at", now), old, ["match_id", "selection"], watched)
    new = written(new.withColumns({"version": F.col("version").cast("int"), "row_id": F.concat_ws(":", "match_id", "selection", "version")}).select(*old.columns), "live-run")
    new.write.mode("append").parquet(path)
    return new


NOW = "1998-07-02 12:00:00"


@R.add("live_candidates")
def live_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live run in the middle of the data: walk-forward of the goal model for its calibrator, standing against the market and
    drift; fits as of now, upcoming fixtures, prices visible now, decisions, capped stakes, appended to a new ledger."""
    m, prices = view(spark, sf_dir, "matches"), view(spark, sf_dir, "prices")
    now = F.lit(NOW).cast("timestamp_ntz")
    results = pit.visible(m.where("status = 'FINISHED'"), now, disputed="disputed")
    walked = written(forecast_models(results, written(fixtures_of(results), "fixtures"), {"goals": models.Goals()}, others=False), "walked")
    state = live.standing(walked, pit.visible(prices, now, "seen_at"), m, "goals")
    out = live_run(m, prices, NOW, new_path(spark, "live-ledger"), state)
    return out.select("match_id", "selection", "day", "status", F.round("model_prob", 4).alias("model_prob"), F.round("allowed", 6).alias("allowed"), "version", "supersedes")


@R.add("decision_by_status", f"SELECT * FROM (WITH {DECIDE} SELECT model, status, count(*) n FROM d GROUP BY ALL) z", ("matches", "prices", "forecasts"))
def decision_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by model and status."""
    return decision.decide(candidates(spark, sf_dir)).groupBy("model", "status").agg(F.count("*").alias("n"))
