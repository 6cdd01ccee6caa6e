"""Queries on local sources, evaluation-only access, name resolution, listings and health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import decision, entity, evaluate, ledger, pit, reports
from ..sources import readers
from ..sources.scratch import new_path
from ..sources.views import view
from .decision_queries import DECIDE, candidates
from .registry import Registry

R = Registry()


@R.add("source_match_arrays", "SELECT match_id AS source_key, match_date, kickoff, home_team::VARCHAR home, away_team::VARCHAR away, CASE WHEN status = 'FINISHED' THEN home_goals END home_goals, CASE WHEN status = 'FINISHED' THEN away_goals END away_goals, concat('m', home_team, ',n', match_id % 3) managers, status, 'APPROXIMATE' AS time_quality FROM matches WHERE match_id % 13 <> 0", ("matches",))
def source_match_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are one JSON array of nested matches each; matches with a broken date are issues."""
    m, path = view(spark, sf_dir, "matches"), new_path(spark, "match-arrays")
    done, name = F.col("status") == "FINISHED", lambda c: F.struct(c.cast("string").alias("name"))
    doc = F.struct(
        "match_id", F.when(F.col("match_id") % 13 == 0, "soon").otherwise(F.col("match_date").cast("string")).alias("match_date"), F.lit("15:00:00.000").alias("kick_off"), F.when(done, F.col("home_goals")).alias("home_score"), F.when(done, F.col("away_goals")).alias("away_score"),
        F.struct(F.col("home_team").cast("string").alias("home_team_name"), F.array(name(F.concat(F.lit("m"), "home_team")), name(F.concat(F.lit("n"), F.col("match_id") % 3))).alias("managers")).alias("home_team"), F.struct(F.col("away_team").cast("string").alias("away_team_name")).alias("away_team"),
    )
    files = m.groupBy(F.pmod("match_id", F.lit(16)).alias("part"), "league").agg(F.to_json(F.collect_list(doc)).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    good, _ = readers.match_array_json(spark, path, "UTC")
    return good.select("source_key", "match_date", F.col("kickoff").cast("timestamp_ntz").alias("kickoff"), "home", "away", "home_goals", "away_goals", F.array_join("home_managers", ",").alias("managers"), "status", "time_quality")


@R.add("source_local_matches", "SELECT league::VARCHAR competition, match_date, home_team::VARCHAR home, away_team::VARCHAR away, CASE WHEN status = 'FINISHED' THEN home_goals END home_goals, CASE WHEN match_id % 3 = 0 THEN 'POSTPONED' WHEN status = 'FINISHED' THEN 'FINISHED' ELSE 'SCHEDULED' END AS status FROM matches WHERE match_id % 19 <> 0", ("matches",))
def source_local_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own matches, some with a status of their own, some without a date."""
    m, path = view(spark, sf_dir, "matches"), new_path(spark, "local-matches")
    goals = lambda c: F.when(F.col("status") == "FINISHED", F.col(c))
    m.select(
        F.col("league").alias("competition_id"), "season", F.when(F.col("match_id") % 19 == 0, "?").otherwise(F.col("match_date").cast("string")).alias("date"), F.lit("15:00").alias("time"), F.col("home_team").alias("home"), F.col("away_team").alias("away"),
        goals("home_goals").alias("home_goals"), goals("away_goals").alias("away_goals"), F.when(F.col("match_id") % 3 == 0, "postponed").alias("status"),
    ).write.csv(path, header=True)
    good, _ = readers.local_matches(spark, path)
    return good.select("competition", "match_date", "home", "away", "home_goals", "status")


@R.add("pit_outcomes", "SELECT match_id, home_goals, away_goals FROM matches WHERE status = 'FINISHED' AND match_id IN (SELECT match_id FROM prices WHERE snapshot = 'CLOSING')", ("matches", "prices"))
def pit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the matches that have a closing price, by the accessor that only evaluation uses."""
    return pit.outcomes(view(spark, sf_dir, "matches"), view(spark, sf_dir, "prices").where("snapshot = 'CLOSING'"))


@R.add("pit_closing_prices", "SELECT match_id, book, arg_max(odds_h, (seen_at, supplier)) odds_h FROM prices WHERE snapshot = 'CLOSING' AND match_id IN (SELECT match_id FROM matches WHERE status = 'FINISHED') GROUP BY ALL", ("matches", "prices"))
def pit_closing_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing prices of finished matches, by the accessor that only evaluation uses."""
    prices = view(spark, sf_dir, "prices").select("match_id", "book", "seen_at", "supplier", "snapshot", "odds_h")
    return pit.closing_prices(prices, view(spark, sf_dir, "matches").where("status = 'FINISHED'"), ["book"], ties=["supplier"]).select("match_id", "book", "odds_h")


@R.add("pit_holdout", "SELECT season, count(*) n FROM matches WHERE match_date < DATE '1997-07-01' GROUP BY season", ("matches",))
def pit_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches by season, without the holdout."""
    return pit.clip_holdout(view(spark, sf_dir, "matches"), "match_date", "1997-07-01").groupBy("season").agg(F.count("*").alias("n"))


@R.add(
    "pit_decision_times_date_only",
    """SELECT * FROM (WITH m AS (SELECT match_id, CASE WHEN match_id % 3 <> 0 THEN kickoff - INTERVAL 1 HOUR END lead, match_date::TIMESTAMP d FROM matches), t AS (SELECT m.match_id, max(seen_at) tick FROM m JOIN prices p ON m.match_id = p.match_id WHERE seen_at <= coalesce(lead, d + INTERVAL 12 HOUR) GROUP BY m.match_id)
    SELECT m.match_id, coalesce(tick, lead, d) decision_at, CASE WHEN lead IS NOT NULL THEN CASE WHEN tick IS NULL THEN 'LEAD' ELSE 'LAST_TICK' END WHEN tick IS NULL THEN 'DATE_ONLY' ELSE 'LAST_TICK_BEFORE_NOON' END AS policy FROM m LEFT JOIN t ON m.match_id = t.match_id) z""",
    ("matches", "prices"),
)
def pit_decision_times_date_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each match is decided, a third of them known by date alone."""
    m = view(spark, sf_dir, "matches").select("match_id", F.when(F.col("match_id") % 3 != 0, F.col("kickoff")).alias("kickoff"), "match_date")
    return pit.decision_times(m, view(spark, sf_dir, "prices"), "match_id", "kickoff", "seen_at", 1, "match_date")


@R.add("entity_candidates", """SELECT * FROM (WITH m AS (SELECT DISTINCT home_team, away_team, match_date FROM matches), f AS (SELECT home_team, away_team, match_date FROM m WHERE home_team % 100 < 3 AND away_team % 100 >= 3),
    h AS (SELECT f.home_team raw, f.away_team o, f.match_date d, r.home_team team, CASE r.match_date - f.match_date WHEN 0 THEN 0 WHEN -1 THEN 1 ELSE 2 END pref FROM f JOIN m r ON r.away_team = f.away_team AND abs(r.match_date - f.match_date) <= 1), b AS (SELECT raw, o, d, min(pref) p FROM h GROUP BY ALL),
    v AS (SELECT raw, team, count(*) votes FROM (SELECT DISTINCT h.raw, h.o, h.d, team FROM h JOIN b ON h.raw = b.raw AND h.o = b.o AND h.d = b.d AND pref = p) q GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY votes DESC, team::VARCHAR DESC) n FROM v)
    SELECT raw AS raw_team, string_agg(team::VARCHAR, ',' ORDER BY n) candidates, max(CASE WHEN n = 1 THEN votes END)::BIGINT votes FROM k WHERE n <= 5 GROUP BY raw) z""", ("matches",))
def entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five likeliest teams of each unknown name, with the votes of the first."""
    m = view(spark, sf_dir, "matches").select("home_team", "away_team", "match_date").distinct()
    fixtures = m.where("home_team % 100 < 3 AND away_team % 100 >= 3").select(F.concat(F.lit("n"), "home_team").alias("raw"), F.concat(F.lit("n"), "away_team").alias("opponent_raw"), F.lit("H").alias("side"), "match_date")
    resolved = m.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct().where("team % 100 >= 3").select(F.concat(F.lit("n"), "team").alias("raw"), "team")
    reference = m.select(F.col("away_team").alias("team"), F.col("home_team").alias("opponent"), F.lit("A").alias("side"), "match_date")
    out = entity.cooccurrence(fixtures, resolved, reference)
    return out.select(F.substring("raw", 2, 9).cast("int").alias("raw_team"), F.array_join("candidates", ",").alias("candidates"), "votes")


@R.add("json_key_probes", "SELECT event_type, count(*) n, count(CASE WHEN json_exists(props, '$.k') THEN 1 END) with_k, count(CASE WHEN json_exists(props, '$.z') THEN 1 END) with_z FROM events GROUP BY event_type")
def json_key_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of each type have a key in their properties."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(N.has_key(F.col("props"), "k")).alias("with_k"), F.count_if(N.has_key(F.col("props"), "z")).alias("with_z"))


_TEXTS = ", ".join(f"('{code}', '{text}')" for code, text in decision.REASONS.items())


@R.add("decision_reason_texts", f"SELECT * FROM (WITH {DECIDE}, t(code, reason_text) AS (VALUES {_TEXTS}), r AS (SELECT unnest(string_split(CASE WHEN lacking <> '' THEN lacking ELSE concat_ws(',', nullif(hard, ''), nullif(soft, '')) END, ',')) reason FROM d) SELECT reason_text, count(*) n FROM r JOIN t ON code = reason GROUP BY reason_text) z", ("matches", "prices", "forecasts"))
def decision_reason_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each reason was given, in words."""
    reasons = decision.decide(candidates(spark, sf_dir)).select(F.explode("reasons").alias("reason"))
    return reasons.groupBy(decision.reason_text(F.col("reason")).alias("reason_text")).agg(F.count("*").alias("n"))


@R.add("report_values", f"SELECT * FROM (WITH {DECIDE}, s AS (SELECT match_id, model, CASE WHEN match_id % 4 = 0 THEN 'WATCH' ELSE max(status) END AS status, CASE WHEN match_id % 4 = 0 THEN 2 ELSE 1 END AS version FROM d GROUP BY match_id, model) SELECT * FROM s WHERE status NOT IN ('NO_BET', 'INSUFFICIENT_DATA')) z", ("matches", "prices", "forecasts"))
def report_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest versions of decided candidates that are worth a look; every fourth match was decided again."""
    first = decision.decide(candidates(spark, sf_dir)).groupBy("match_id", "model").agg(F.max("status").alias("status")).withColumn("version", F.lit(1))
    again = first.where("match_id % 4 = 0").select("match_id", "model", F.lit("WATCH").alias("status"), F.lit(2).alias("version"))
    return reports.values(first.unionByName(again), ["match_id", "model"])


@R.add("report_predictions", "SELECT f.match_id, f.model, round(p_home, 6) p_home, CASE WHEN f.match_id % 2 = 0 THEN outcome END AS outcome FROM forecasts f ORDER BY match_date DESC, f.match_id DESC, f.model LIMIT 200", ("forecasts",))
def report_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 forecasts with their outcome, if there is one."""
    f = view(spark, sf_dir, "forecasts")
    new = reports.listing(f.select("match_id", "model", "match_date", "p_home"), F.lit(True), [F.col("match_date").desc(), F.col("match_id").desc(), F.col("model")], 200)
    done = f.where("match_id % 2 = 0").select("match_id", "outcome").distinct()
    return new.join(done, "match_id", "left").select("match_id", "model", F.round("p_home", 6).alias("p_home"), "outcome")


@R.add("report_health", "SELECT event_type, count(*) runs, count(CASE WHEN event_id % 9 = 0 THEN 1 END) failed, max(ts) last_at, CASE WHEN max_by(event_id, (ts, event_id)) % 9 = 0 THEN 'ERROR' ELSE 'OK' END AS last_status FROM events GROUP BY event_type")
def report_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, failures and the last status of each provider, here each type of event."""
    runs = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts", F.when(F.col("event_id") % 9 == 0, "ERROR").otherwise("OK").alias("status"))
    return reports.health(runs, "event_type", "ts", "status", ["event_id"])


@R.add("report_expected_losses", "SELECT model, round(avg(-ln(CASE outcome WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END)), 6) expected FROM forecasts WHERE season = (SELECT max(season) FROM forecasts) GROUP BY model", ("forecasts",))
def report_expected_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The losses that the latest run's JSON summary leads to expect; a run is a season."""
    scored = evaluate.with_losses(view(spark, sf_dir, "forecasts"), ["p_home", "p_draw", "p_away"], "outcome")
    per = scored.groupBy("season", "model").agg(F.avg("log_loss").alias("x"))
    entries = F.map_from_entries(F.flatten(F.collect_list(F.array(F.struct(F.concat("model", F.lit(":calibrated")), "x"), F.struct(F.concat("model", F.lit(":raw")), (F.col("x") + 1).alias("x"))))))
    runs = per.groupBy("season").agg(F.to_json(entries).alias("summary"))
    out = reports.expected_losses(runs, "season", "summary")
    return out.select("model", F.round("expected", 6).alias("expected"))


@R.add("ledger_newest", "SELECT model, count(*) n, sum(CASE WHEN match_id % 4 = 0 THEN 2 ELSE 1 END)::BIGINT versions FROM forecasts GROUP BY model", ("forecasts",))
def ledger_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest version of every forecast in a ledger."""
    f = view(spark, sf_dir, "forecasts").select("match_id", "model", F.lit(1).alias("version"), "p_home")
    both = f.unionByName(f.where("match_id % 4 = 0").withColumn("version", F.lit(2)))
    return ledger.newest(both, ["match_id", "model"], "version").groupBy("model").agg(F.count("*").alias("n"), F.sum("version").alias("versions"))
