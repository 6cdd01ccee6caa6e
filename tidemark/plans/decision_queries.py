"""Queries on contracts, merging, decisions and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import odds as O
from ..operators import contracts, decision, ledger, merge, pit
from ..sources.scratch import written
from ..sources.views import view
from .registry import Registry

R = Registry()
KEYS = ("league", "season", "home_team", "away_team")

_RAW = """raw AS (SELECT match_id, 'team ' || home_team AS home, CASE WHEN match_id % 41 = 0 THEN ' TEAM ' || home_team WHEN match_id % 43 = 0 THEN ' ' ELSE 'team ' || away_team END AS away, CASE WHEN match_id % 47 = 0 THEN NULL ELSE match_date END AS match_date,
  CASE WHEN status = 'FINISHED' THEN CASE WHEN match_id % 53 = 0 THEN 44 ELSE home_goals END END AS home_goals, CASE WHEN status = 'FINISHED' AND match_id % 59 <> 0 THEN away_goals END AS away_goals, CASE WHEN match_id % 2 = 0 THEN 1 END AS ht_home, CASE WHEN match_id % 2 = 0 THEN 0 END AS ht_away,
  CASE WHEN match_id % 61 = 0 THEN 'FINISHED' ELSE status END AS status, match_id - match_id % 2 AS source_key FROM matches)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = view(spark, sf_dir, "matches"), F.col("match_id")
    team = lambda c: F.concat(F.lit("team "), F.col(c).cast("string"))
    done = F.col("status") == "FINISHED"
    return m.select(
        k, team("home_team").alias("home"), F.when(k % 41 == 0, F.concat(F.lit(" TEAM "), F.col("home_team").cast("string"))).when(k % 43 == 0, " ").otherwise(team("away_team")).alias("away"), F.when(k % 47 != 0, F.col("match_date")).alias("match_date"),
        F.when(done, F.when(k % 53 == 0, 44).otherwise(F.col("home_goals"))).alias("home_goals"), F.when(done & (k % 59 != 0), F.col("away_goals")).alias("away_goals"), F.when(k % 2 == 0, 1).alias("ht_home"), F.when(k % 2 == 0, 0).alias("ht_away"),
        F.when(k % 61 == 0, "FINISHED").otherwise(F.col("status")).alias("status"), (k - k % 2).alias("source_key"),
    )


_CODES = """concat_ws(',', CASE WHEN trim(home) = '' OR trim(away) = '' THEN 'MISSING_TEAM' END, CASE WHEN trim(home) <> '' AND trim(away) <> '' AND lower(trim(home)) = lower(trim(away)) THEN 'SAME_TEAM' END, CASE WHEN match_date IS NULL THEN 'BAD_DATE' END,
  CASE WHEN home_goals > 40 OR away_goals > 40 THEN 'GOALS_RANGE' END, CASE WHEN (home_goals IS NULL) <> (away_goals IS NULL) THEN 'PARTIAL_SCORE' END, CASE WHEN status = 'FINISHED' AND home_goals IS NULL THEN 'FINISHED_NO_SCORE' END,
  CASE WHEN home_goals IS NOT NULL AND ht_home IS NOT NULL AND ht_away IS NOT NULL AND (ht_home > home_goals OR ht_away > away_goals) THEN 'HT_GT_FT' END)"""


@R.add("contract_issues", f"SELECT * FROM (WITH {_RAW}, c AS (SELECT match_id, source_key, {_CODES} codes FROM raw), f AS (SELECT *, min(CASE WHEN codes = '' THEN match_id END) OVER (PARTITION BY source_key) fst FROM c) SELECT match_id, CASE WHEN match_id > fst THEN concat_ws(',', nullif(codes, ''), 'DUPLICATE_KEY') ELSE codes END codes, codes = '' AND NOT coalesce(match_id > fst, false) accepted FROM f) z", ("matches",))
def contract_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract check of raw match rows: issue codes, and the accepted row of each source key."""
    out = contracts.enforce(_raw(spark, sf_dir), contracts.match_issues(F.lit("2002-01-01").cast("date")), ["source_key"], "match_id")
    return out.select("match_id", F.concat_ws(",", F.transform(F.filter("issues", lambda i: i["severity"] == "ERROR"), lambda i: i["code"])).alias("codes"), "accepted")


@R.add("contract_prices", "SELECT concat_ws(',', CASE WHEN odds_h > 3.2 THEN 'ODDS_RANGE' END, CASE WHEN book % 7 = 0 THEN 'ODDS_KEYS' END, CASE WHEN match_id % 13 = 0 THEN 'ODDS_NO_TIMESTAMP' END) codes, count(*) n FROM prices GROUP BY ALL", ("prices",))
def contract_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract check of raw prices by combination of codes."""
    p = view(spark, sf_dir, "prices")
    raw = p.select(F.when(F.col("odds_h") > 3.2, 0.5).otherwise(F.col("odds_h")).alias("odds"), F.when(F.col("book") % 7 != 0, F.col("book")).alias("book"), F.lit("1X2").alias("market"), F.lit("H").alias("selection"), F.when(F.col("match_id") % 13 != 0, F.col("seen_at")).alias("seen_at"))
    return raw.select(F.concat_ws(",", F.transform(contracts.price_issues(), lambda i: i["code"])).alias("codes")).groupBy("codes").agg(F.count("*").alias("n"))


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.cluster(view(spark, sf_dir, "records"), KEYS)


@R.add("merge_events")
def merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three sources merged into one row per event."""
    out = merge.merged(_clustered(spark, sf_dir), KEYS, ["alpha", "beta", "gamma"], ["beta", "alpha"])
    return out.withColumn("sources", F.concat_ws(",", "sources"))


@R.add("merge_conflicts")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every disagreement between the sources of an event."""
    records = written(_clustered(spark, sf_dir), "clustered")  # read three times
    return merge.conflicts(records, merge.merged(records, KEYS, ["alpha", "beta", "gamma"], ["beta", "alpha"]), KEYS)


@R.add("merge_by_key", "SELECT source_key, arg_min(source, CASE source WHEN 'alpha' THEN 0 WHEN 'beta' THEN 1 ELSE 2 END + CASE WHEN home_goals IS NULL THEN 10 ELSE 0 END) primary_source, count(*) n_records, CASE WHEN count(DISTINCT CASE WHEN home_goals IS NOT NULL THEN home_goals * 100 + away_goals END) > 1 THEN 1 ELSE 0 END disputed, any_value(CASE WHEN source = 'beta' THEN kickoff END) IS NOT NULL beta_kickoff FROM records GROUP BY source_key", ("records",))
def merge_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority merge of records that share a source key."""
    records = view(spark, sf_dir, "records").withColumn("cluster", F.lit(0))
    out = merge.merged(records.withColumn("k", F.col("source_key")), ["k"], ["alpha", "beta", "gamma"], ["beta", "alpha"])
    beta = records.groupBy(F.col("source_key").alias("k")).agg((F.max(F.when(F.col("source") == "beta", F.col("kickoff"))).isNotNull()).alias("beta_kickoff"))
    return out.join(beta, "k").select(F.col("k").alias("source_key"), "primary_source", "n_records", "disputed", "beta_kickoff")


@R.add("upsert_first", "SELECT home_team, away_team, min(match_id) match_id FROM matches GROUP BY ALL", ("matches",))
def upsert_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert-or-ignore: the first match of each ordered pair."""
    return merge.first_rows(view(spark, sf_dir, "matches"), ["home_team", "away_team"], [F.col("match_id")]).select("home_team", "away_team", "match_id")


_CAND = """cand AS (SELECT f.match_id, f.model, f.league, f.match_date, f.outcome, p_home AS model_prob, p_home + 0.01 AS raw_prob, p_home - 0.05 AS prob_low, q.odds_h AS odds, (1/q.odds_h)/(1/q.odds_h+1/q.odds_d+1/q.odds_a) AS fair_prob, CASE WHEN f.match_id % 10 = 0 THEN 0.5 ELSE 0.9 END AS quality, (f.match_id % 12) / 100.0::DOUBLE AS disagreement, (f.match_id % 40)::INT AS home_matches, 20 AS away_matches,
  CASE WHEN f.match_id % 11 = 0 THEN 'STALE_ODDS' WHEN f.match_id % 7 = 0 THEN 'SINGLE_BOOK' END AS flag, CASE WHEN f.match_id % 5 <> 0 THEN 'identity' END AS calibration, f.match_id % 29 = 0 AS drift_alert, f.match_id % 31 <> 0 AS validated FROM forecasts f LEFT JOIN prices q ON f.match_id = q.match_id AND q.book = 1 AND f.match_id % 23 <> 0)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts with the first book's price: one candidate a match and model."""
    f, k = view(spark, sf_dir, "forecasts"), F.col("match_id")
    q = view(spark, sf_dir, "prices").where((F.col("book") == 1) & (k % 23 != 0)).select("match_id", "odds_h", "odds_d", "odds_a")
    inverse = lambda c: 1 / F.col(c)
    j = f.join(q, "match_id", "left")
    return j.select(
        "match_id", "model", "league", "match_date", "outcome", F.col("p_home").alias("model_prob"), (F.col("p_home") + 0.01).alias("raw_prob"), (F.col("p_home") - 0.05).alias("prob_low"), F.col("odds_h").alias("odds"),
        (inverse("odds_h") / (inverse("odds_h") + inverse("odds_d") + inverse("odds_a"))).alias("fair_prob"), F.when(k % 10 == 0, 0.5).otherwise(0.9).alias("quality"), (k % 12 / 100.0).alias("disagreement"), (k % 40).cast("int").alias("home_matches"), F.lit(20).alias("away_matches"),
        F.array_compact(F.array(F.when(k % 11 == 0, "STALE_ODDS").when(k % 7 == 0, "SINGLE_BOOK"))).alias("flags"), F.when(k % 5 != 0, "identity").alias("calibration"), (k % 29 == 0).alias("drift_alert"), (k % 31 != 0).alias("validated"),
    )


DECIDE = f"""{_CAND}, v AS (SELECT *, model_prob*odds-1 ev, model_prob-fair_prob edge, raw_prob*odds-1 evr, (fair_prob+0.5*(model_prob-fair_prob))*odds-1 evc, prob_low*odds-1 evl, concat_ws(',', CASE WHEN odds IS NULL THEN coalesce(flag, 'NO_MARKET_ODDS') END, CASE WHEN least(home_matches, away_matches) < 8 THEN 'INSUFFICIENT_TEAM_HISTORY' END, CASE WHEN quality < 0.6 THEN 'LOW_DATA_QUALITY' END) lacking FROM cand),
  w AS (SELECT *, concat_ws(',', CASE WHEN flag = 'STALE_ODDS' THEN flag END, CASE WHEN ev <= 0 THEN 'NEGATIVE_EV' END, CASE WHEN ev <= 0 AND edge > 0 THEN 'EDGE_CONSUMED_BY_MARGIN' END, CASE WHEN ev <= 0 AND evr > 0 THEN 'EDGE_REMOVED_BY_CALIBRATION' END, CASE WHEN odds NOT BETWEEN 1.3 AND 6 THEN 'ODDS_OUT_OF_RANGE' END, CASE WHEN disagreement > 0.08 THEN 'MODEL_DISAGREEMENT' END, CASE WHEN drift_alert THEN 'DRIFT_ALERT' END, CASE WHEN NOT validated THEN 'MODEL_NOT_VALIDATED_VS_MARKET' END) hard,
    concat_ws(',', CASE WHEN flag = 'SINGLE_BOOK' THEN flag END, CASE WHEN ev > 0 AND ev < 0.03 THEN 'EV_BELOW_THRESHOLD' END, CASE WHEN ev > 0 AND edge < 0.02 THEN 'EDGE_BELOW_THRESHOLD' END, CASE WHEN ev > 0 AND evc <= 0 THEN 'EDGE_NOT_ROBUST_TO_UNCERTAINTY' END, CASE WHEN calibration IS NULL THEN 'CALIBRATION_UNAVAILABLE' END) soft FROM v),
  d AS (SELECT *, CASE WHEN lacking <> '' THEN 'INSUFFICIENT_DATA' WHEN hard <> '' THEN 'NO_BET' WHEN soft <> '' THEN CASE WHEN ev > 0 THEN 'WATCH' ELSE 'NO_BET' END WHEN evl > 0 THEN 'STRONG_CANDIDATE' ELSE 'CANDIDATE' END status FROM w)"""


@R.add("decision_rules", f"SELECT * FROM (WITH {DECIDE} SELECT match_id, model, status, CASE WHEN lacking <> '' THEN lacking ELSE concat_ws(',', nullif(hard, ''), nullif(soft, '')) END reasons, CASE WHEN lacking = '' THEN round(ev, 6) END ev, CASE WHEN lacking = '' THEN round(evc, 6) END ev_conservative FROM d) z", ("matches", "prices", "forecasts"))
def decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and ordered reasons of every candidate."""
    out = decision.decide(candidates(spark, sf_dir))
    return out.select("match_id", "model", "status", F.concat_ws(",", "reasons").alias("reasons"), F.round("ev", 6).alias("ev"), F.round("ev_conservative", 6).alias("ev_conservative"))


@R.add("decision_reasons", f"SELECT * FROM (WITH {DECIDE}, r AS (SELECT model, unnest(string_split(CASE WHEN lacking <> '' THEN lacking ELSE concat_ws(',', nullif(hard, ''), nullif(soft, '')) END, ',')) reason FROM d) SELECT model, reason, count(*) n FROM r WHERE reason <> '' GROUP BY ALL) z", ("matches", "prices", "forecasts"))
def decision_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each reason was given."""
    out = decision.decide(candidates(spark, sf_dir))
    return out.select("model", F.explode("reasons").alias("reason")).groupBy("model", "reason").agg(F.count("*").alias("n"))


def _bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decision.decide(candidates(spark, sf_dir))
    p = F.col("fair_prob") + 0.5 * (F.col("model_prob") - F.col("fair_prob"))
    taken = F.col("status").isin("WATCH", "CANDIDATE", "STRONG_CANDIDATE")
    out = out.withColumn("stake", F.when(taken, O.stake(p, F.col("odds"))).otherwise(0.0)).withColumn("units", F.col("stake") * 100)
    closing = F.col("odds") * (1 + (F.col("match_id") % 9 - 4) / 100)
    return decision.settled(out.withColumn("won", F.col("outcome") == 0).withColumn("clv", O.clv_price(F.col("odds"), closing)), F.col("won"), F.col("units"), F.col("odds"))


_BETS = """b AS (SELECT *, CASE WHEN status IN ('WATCH','CANDIDATE','STRONG_CANDIDATE') AND evc > 0 THEN least(0.25 * greatest(0, ((fair_prob+0.5*(model_prob-fair_prob))*(odds-1) - (1-(fair_prob+0.5*(model_prob-fair_prob))))/(odds-1)), 0.02) ELSE 0 END * 100 units, odds / (odds * (1 + (match_id % 9 - 4) / 100.0::DOUBLE)) - 1 clv FROM d)"""


@R.add(
    "bet_summary",
    f"""SELECT * FROM (WITH {DECIDE}, {_BETS}
    SELECT model, count(*) selections, count(CASE WHEN units > 0 THEN 1 END) bets, count(CASE WHEN units > 0 AND outcome = 0 THEN 1 END) wins, round(sum(CASE WHEN units > 0 THEN units END), 4) staked, round(sum(CASE WHEN units > 0 THEN CASE WHEN outcome = 0 THEN units * (odds - 1) ELSE -units END END), 4) profit, round(avg(CASE WHEN units > 0 THEN (clv > 0)::INT END), 4) share_beating_close FROM b GROUP BY model) z""",
    ("matches", "prices", "forecasts"),
)
def bet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bets, stakes, profit and share of prices that beat the close, by model."""
    out = decision.summary(_bets(spark, sf_dir), ["model"])
    return out.select("model", "selections", "bets", "wins", *(F.round(c, 4).alias(c) for c in ("staked", "profit", "share_beating_close")))


def _resampled(seed: str, value: str, weight: str) -> str:
    """Blocks, draws and means of one bootstrap."""
    return f"""k_{seed} AS (SELECT model, date_trunc('week', match_date) wk, sum({value}) s, sum({weight}) c, row_number() OVER (PARTITION BY model ORDER BY date_trunc('week', match_date)) - 1 b FROM p GROUP BY model, date_trunc('week', match_date)), z_{seed} AS (SELECT model, count(*) n, sum(s) / sum(c) mean FROM k_{seed} GROUP BY model),
    r_{seed} AS (SELECT model, n, r, unnest(range(1, n + 1)) i FROM (SELECT *, unnest(range(1, 1001)) r FROM z_{seed}) q), x_{seed} AS (SELECT r.model, r.r, sum(s) / sum(c) m FROM r_{seed} r JOIN k_{seed} k ON r.model = k.model AND k.b = concat('0x', substr(md5(concat_ws('/', '{seed}', r.model, r.r::VARCHAR, i::VARCHAR)), 1, 8))::BIGINT % r.n GROUP BY ALL),
    o_{seed} AS (SELECT x.model, any_value(z.mean) mean, quantile_cont(m, 0.025) lo, quantile_cont(m, 0.975) hi FROM x_{seed} x JOIN z_{seed} z ON x.model = z.model GROUP BY x.model)"""


@R.add(
    "bet_intervals",
    f"""SELECT * FROM (WITH {DECIDE}, {_BETS}, p AS (SELECT model, match_date, units, CASE WHEN outcome = 0 THEN units * (odds - 1) ELSE -units END profit, clv FROM b WHERE units > 0), {_resampled('yield', 'profit', 'units')}, {_resampled('clv', 'clv', '1')}
    SELECT y.model, (SELECT count(*) FROM p WHERE p.model = y.model) bets, round(y.mean, 5) AS yield, round(y.lo, 5) yield_low, round(y.hi, 5) yield_high, round(c.mean, 5) clv, round(c.lo, 5) clv_low, round(c.hi, 5) clv_high FROM o_yield y JOIN o_clv c ON y.model = c.model) z""",
    ("matches", "prices", "forecasts"),
)
def bet_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yield and value against the close of each model's bets, with weekly block bootstrap intervals."""
    out = decision.summary_intervals(_bets(spark, sf_dir), ["model"], F.date_trunc("week", F.col("match_date")))
    return out.select("model", "bets", *(F.round(c, 5).alias(c) for c in ("yield", "yield_low", "yield_high", "clv", "clv_low", "clv_high")))


def _capped_sql() -> str:
    """Stakes granted one by one within a day: a recursion whose state is a map of what each cap has given out."""
    caps = [("'d'", 0.10), ("concat('m', o.match_id)", 0.03), ("concat('m', o.match_id)", 0.04), ("concat('t', o.home_team)", 0.05), ("concat('t', o.away_team)", 0.05), ("concat('l', o.league)", 0.08)]
    used = lambda key: f"coalesce(list_extract(map_extract(used, {key}), 1), 0)"
    left = [f"{most}::DOUBLE - {used(key)}" for key, most in caps]
    keys = list(dict.fromkeys(key for key, _ in caps))
    notes = " + ".join(f"({x} < least(stake, 0.02::DOUBLE))::INT" for x in left)
    step = f"SELECT o.day, o.n, o.match_id, o.selection, o.stake, greatest(0, least(o.stake, 0.02::DOUBLE, {', '.join(left)})) got, {notes} notes, used, [{', '.join(keys)}] ks, [{', '.join(used(k) for k in keys)}] us FROM r JOIN o ON o.day = r.day AND o.n = r.n + 1"
    return f"""r(day, n, match_id, selection, stake, allowed, n_notes, used) AS (SELECT day, 0::BIGINT, 0::BIGINT, '', 0.0::DOUBLE, 0.0::DOUBLE, 0, MAP(['d'], [0.0::DOUBLE]) FROM (SELECT DISTINCT day FROM o) q
    UNION ALL SELECT day, n, match_id, selection, stake, got, notes, map_concat(used, MAP(ks, list_transform(us, lambda u: u + got))) FROM ({step.replace('(stake, 0.02', '(o.stake, 0.02')}) q)"""


@R.add(
    "exposure_caps",
    f"""SELECT * FROM (WITH RECURSIVE {DECIDE}, b AS (SELECT d.match_id, model AS selection, d.match_date AS day, d.league, m.home_team, m.away_team, evc, CASE WHEN d.status IN ('WATCH','CANDIDATE','STRONG_CANDIDATE') AND evc > 0 THEN least(0.25 * greatest(0, ((fair_prob+0.5*(model_prob-fair_prob))*(odds-1) - (1-(fair_prob+0.5*(model_prob-fair_prob))))/(odds-1)), 0.02) ELSE 0 END stake FROM d JOIN matches m ON d.match_id = m.match_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY round(evc, 9) DESC, match_id, selection, stake) n FROM b WHERE stake > 0), {_capped_sql()}
    SELECT match_id, selection, day, round(stake, 6) stake, round(allowed, 6) allowed FROM r WHERE n > 0) z""",
    ("matches", "prices", "forecasts"),
)
def exposure_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stakes granted within the caps of day, match, team and league."""
    m = view(spark, sf_dir, "matches").select("match_id", "home_team", "away_team")
    rows = _bets(spark, sf_dir).where("stake > 0").join(m, "match_id").select("match_id", F.col("model").alias("selection"), F.col("match_date").alias("day"), "league", "home_team", "away_team", "stake", F.round("ev_conservative", 9).alias("ev_conservative"))
    out = decision.capped(rows)
    return out.select("match_id", "selection", "day", F.round("stake", 6).alias("stake"), F.round("allowed", 6).alias("allowed"))


COLUMNS = ["match_id", "model", "season", "outcome"]


@R.add("ledger_digests", "SELECT season, model, count(*) n, min(sha256(concat_ws('|', concat(length(match_id::VARCHAR), ':', match_id), concat(length(model), ':', model), concat(length(season::VARCHAR), ':', season), concat(length(outcome::VARCHAR), ':', outcome)))) first_hash, max(sha256(concat_ws('|', concat(length(match_id::VARCHAR), ':', match_id), concat(length(model), ':', model), concat(length(season::VARCHAR), ':', season), concat(length(outcome::VARCHAR), ':', outcome)))) last_hash FROM forecasts GROUP BY season, model", ("forecasts",))
def ledger_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row digests of the forecast ledger, per season and model."""
    rows = ledger.with_digest(view(spark, sf_dir, "forecasts"), COLUMNS)
    return rows.groupBy("season", "model").agg(F.count("*").alias("n"), F.min("row_hash").alias("first_hash"), F.max("row_hash").alias("last_hash"))


@R.add(
    "ledger_chain",
    """SELECT * FROM (WITH RECURSIVE h AS (SELECT season, sha256(concat_ws('|', concat(length(match_id::VARCHAR), ':', match_id), concat(length(model), ':', model), concat(length(season::VARCHAR), ':', season), concat(length(outcome::VARCHAR), ':', outcome))) r FROM forecasts),
    g AS (SELECT season, concat('0x', substr(r, 1, 4))::INT % 64 g, sha256(string_agg(r, '' ORDER BY r)) h, count(*) n FROM h GROUP BY ALL),
    b AS (SELECT season, sum(n)::BIGINT n, sha256(string_agg(h, '' ORDER BY g)) content_hash, row_number() OVER (ORDER BY season) i FROM g GROUP BY season),
    c AS (SELECT i, season, n, content_hash, repeat('0', 64) prev_hash, sha256(repeat('0', 64) || content_hash) chain_hash FROM b WHERE i = 1 UNION ALL SELECT b.i, b.season, b.n, b.content_hash, c.chain_hash, sha256(c.chain_hash || b.content_hash) FROM b JOIN c ON b.i = c.i + 1)
    SELECT season, n, content_hash, prev_hash, chain_hash FROM c) z""",
    ("forecasts",),
)
def ledger_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain of batch digests over the seasons of the forecast ledger."""
    return ledger.chained(ledger.batch_digests(ledger.with_digest(view(spark, sf_dir, "forecasts"), COLUMNS), "season"), "season")


@R.add("ledger_tampered", "SELECT DISTINCT season, count(*) AS rows FROM forecasts GROUP BY season HAVING season % 3 = 0", ("forecasts",))
def ledger_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons that no longer verify after some of their outcomes were changed."""
    rows = view(spark, sf_dir, "forecasts")
    chain = ledger.chained(ledger.batch_digests(ledger.with_digest(rows, COLUMNS), "season"), "season")
    changed = rows.withColumn("outcome", F.when(F.col("season") % 3 == 0, (F.col("outcome") + 1) % 3).otherwise(F.col("outcome")))
    return ledger.broken(chain, changed, "season", COLUMNS)


@R.add("ledger_versions", "SELECT match_id, model, 2 AS version FROM forecasts WHERE match_id % 4 = 0 UNION ALL SELECT match_id, model, 1 FROM forecasts WHERE match_id % 6 = 5", ("forecasts",))
def ledger_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New versions: where the forecast changed, and where there was none."""
    rows = view(spark, sf_dir, "forecasts").select("match_id", "model", F.round("p_home", 6).alias("p_home"), F.concat_ws(":", "match_id", "model").alias("row_id"))
    old = rows.where("match_id % 6 <> 5").withColumn("version", F.lit(1))
    new = rows.withColumn("p_home", F.when(F.col("match_id") % 4 == 0, F.col("p_home") + 0.1).otherwise(F.col("p_home")))
    out = ledger.changed(new, old, ["match_id", "model"], ["p_home"])
    return out.where("match_id % 6 <> 5 OR version = 1").select("match_id", "model", "version")


@R.add(
    "reconcile_outcomes",
    """SELECT concat(match_id, ':', selection) row_id, match_id, selection, CASE WHEN selection = CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals = away_goals THEN 'D' ELSE 'A' END THEN 'WIN' ELSE 'LOSS' END outcome, round(CASE WHEN selection = CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals = away_goals THEN 'D' ELSE 'A' END THEN odds - 1 ELSE -1 END, 6) profit, round(odds / c - 1, 6) clv
    FROM (SELECT q.match_id, q.selection, q.odds, m.home_goals, m.away_goals, (SELECT max(odds) FROM quotes r WHERE r.match_id = q.match_id AND r.selection = q.selection AND r.book = 2) c FROM quotes q JOIN matches m ON q.match_id = m.match_id WHERE q.book = 1 AND m.status = 'FINISHED' AND m.available_at <= TIMESTAMP '1998-01-01' AND q.match_id % 5 <> 0) z""",
    ("matches", "quotes"),
)
def reconcile_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of open predictions whose results are visible, with the value against the closing price."""
    quotes, m = view(spark, sf_dir, "quotes"), view(spark, sf_dir, "matches")
    ident = F.concat_ws(":", "match_id", "selection")
    predictions = quotes.where("book = 1").select(ident.alias("row_id"), "match_id", "selection", "odds", F.lit(1.0).alias("units"))
    closing = quotes.where("book = 2").groupBy("match_id", "selection").agg(F.max("odds").alias("closing_odds"))
    done = predictions.where("match_id % 5 = 0").select("row_id")
    out = ledger.reconcile(predictions, done, m.where("status = 'FINISHED'"), closing, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
    return out.select("row_id", "match_id", "selection", "outcome", F.round("profit", 6).alias("profit"), F.round("clv", 6).alias("clv"))
