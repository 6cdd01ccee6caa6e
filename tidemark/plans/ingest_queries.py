"""Queries on sources, entity names and streams. Files are written from the tables first, then read as a source would be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import entity, market
from ..sources import lake, readers
from ..sources.scratch import new_path, written
from ..sources.views import view
from ..streaming import ticks as streams
from .registry import Registry

R = Registry()


@R.add("source_results_csv", "SELECT league AS tier, match_date, season, home_team::VARCHAR home, away_team::VARCHAR away, home_goals, away_goals FROM matches WHERE status = 'FINISHED' AND match_id % 17 <> 0", ("matches",))
def source_results_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results files: written, then read with checks; rows with a broken number are issues."""
    m, path = view(spark, sf_dir, "matches").where("status = 'FINISHED'"), new_path(spark, "results-csv")
    bad = F.col("match_id") % 17 == 0
    m.select(F.col("match_date").alias("Date"), F.col("season").alias("Season"), F.col("home_team").alias("home"), F.col("away_team").alias("visitor"), F.when(bad, "x").otherwise(F.col("home_goals").cast("string")).alias("hgoal"), F.col("away_goals").alias("vgoal"), F.col("league").alias("tier")).write.csv(path, header=True)
    tiers = spark.range(5).select(F.col("id").cast("string").alias("tier"), F.col("id").cast("int").alias("competition"))
    good, _ = readers.results_csv(spark, path, tiers)
    return good.select(F.col("competition").alias("tier"), "match_date", "season", "home", "away", "home_goals", "away_goals")


#: Columns of wide files: by book its code, snapshot and market; books from the fourth on are missing from the headers of old seasons.
_WIDE = {1: ("B365", "", "1X2"), 2: ("PS", "C", "1X2"), 3: ("WH", "", "1X2"), 4: ("BW", "C", "1X2"), 5: ("B365", "", "OU"), 6: ("PS", "", "AH"), 7: ("B365", "C", "AH")}
_SIDES = {"1X2": {"H": "h", "D": "d", "A": "a"}, "OU": {">2.5": "h", "<2.5": "a"}, "AH": {"AHH": "h", "AHA": "a"}}
_NAMED = {"H": "H", "D": "D", "A": "A", ">2.5": "OVER", "<2.5": "UNDER", "AHH": "AH_HOME", "AHA": "AH_AWAY"}
_WIDE_ROWS = " UNION ALL ".join(
    f"SELECT season, match_id, '{readers.BOOKS[code]}' AS book, '{market}' AS market, '{'CLOSING' if closing else 'PRE_MATCH'}' AS snapshot, '{_NAMED[side]}' AS selection, {'-0.5' if market == 'AH' else '2.5' if market == 'OU' else 'NULL'}::DOUBLE AS line, odds_{of} AS odds FROM q WHERE book = {book} AND odds_{of} > 1"
    for book, (code, closing, market) in _WIDE.items() for side, of in _SIDES[market].items()
)


@R.add("source_wide_csv", f"SELECT * FROM (WITH q AS (SELECT m.season, p.match_id, p.book, max(odds_h) odds_h, max(odds_d) odds_d, max(odds_a) odds_a FROM prices p JOIN matches m ON p.match_id = m.match_id WHERE book < 4 OR season >= 1995 GROUP BY ALL) SELECT season, book, market, snapshot, selection, line, count(*) n, round(sum(odds), 2) odds, count(DISTINCT match_id) AS matches FROM ({_WIDE_ROWS}) w GROUP BY ALL) z", ("prices", "matches"))
def source_wide_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide price files of all seasons in one folder, old ones in another encoding and with fewer columns: totals by season,
    book, market, snapshot, selection and line."""
    path = new_path(spark, "wide-csv")
    p = view(spark, sf_dir, "prices").groupBy("match_id", "book").agg(*(F.max(f"odds_{s}").alias(s) for s in "hda"))
    columns = {f"{code}{closing}{side}": (book, of) for book, (code, closing, market) in _WIDE.items() for side, of in _SIDES[market].items()}
    wide = p.groupBy("match_id").agg(*(F.max(F.when(F.col("book") == book, F.col(of))).alias(c) for c, (book, of) in columns.items()))
    m = view(spark, sf_dir, "matches").join(wide, "match_id")
    shown = m.select("season", F.lit("I1").alias("Div"), F.date_format("match_date", "dd/MM/yyyy").alias("Date"), F.lit("15:00").alias("Time"), F.concat_ws("-", F.lit("Málaga"), "match_id").alias("HomeTeam"), F.col("away_team").alias("AwayTeam"), F.col("home_goals").alias("FTHG"), F.col("away_goals").alias("FTAG"), *(F.col(f"`{c}`") for c in columns), F.lit(-0.5).alias("AHh"), F.lit(-0.5).alias("AHCh"))
    old = F.col("season") < 1995
    shown.where(~old).drop("season").write.csv(f"{path}/new", header=True)
    shown.where(old).select("Div", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", *(F.col(f"`{c}`") for c, (book, _) in columns.items() if book < 4)).write.csv(f"{path}/old", header=True, encoding="iso-8859-1")
    matches, prices, _ = readers.wide_csv(spark, path, spark.range(1).select(F.lit("I1").alias("Div"), F.lit("ITA1").alias("competition")))
    out = prices.join(matches.where("home LIKE 'Málaga-%'").select("source_key", "season"), "source_key")
    return out.groupBy("season", "book", "market", "snapshot", "selection", "line").agg(F.count("*").alias("n"), F.round(F.sum("odds"), 2).alias("odds"), F.count_distinct("source_key").alias("matches"))


@R.add("source_nested_json", "SELECT league, count(*) n, count(CASE WHEN status = 'FINISHED' THEN 1 END) finished, (sum(CASE WHEN status = 'FINISHED' THEN home_goals END))::BIGINT goals, count(CASE WHEN status = 'FINISHED' AND match_id % 2 = 0 THEN 1 END) drift FROM matches GROUP BY league", ("matches",))
def source_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested files whose score is an object or a pair, and whose teams are text or objects."""
    m, path = view(spark, sf_dir, "matches"), new_path(spark, "nested-json")
    done, pair = F.col("status") == "FINISHED", F.col("match_id") % 2 == 0
    score = F.concat(F.lit("["), F.col("home_goals"), F.lit(","), F.col("away_goals"), F.lit("]"))
    text = F.concat(
        F.lit('{"round":"r","date":"'), F.col("match_date").cast("string"), F.lit('","time":"15:00","team1":'), F.when(pair, F.concat(F.lit('"t'), F.col("home_team"), F.lit('"'))).otherwise(F.concat(F.lit('{"name":"t'), F.col("home_team"), F.lit('"}'))),
        F.lit(',"team2":"t'), F.col("away_team"), F.lit('"'), F.when(done, F.concat(F.lit(',"score":'), F.when(pair, score).otherwise(F.concat(F.lit('{"ft":'), score, F.lit("}"))))).otherwise(""), F.lit("}"),
    )
    docs = m.select("league", F.pmod("match_id", F.lit(8)).alias("part"), text.alias("t")).groupBy("league", "part").agg(F.concat(F.lit('{"name":"L'), F.first("league"), F.lit('","matches":['), F.array_join(F.collect_list("t"), ","), F.lit("]}")).alias("value"))
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    good, issues = readers.nested_json(spark, path, "UTC", "2100-01-01")
    drift = issues.where("code = 'FORMAT_DRIFT'").groupBy("name").agg(F.count("*").alias("drift"))
    out = good.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "FINISHED").alias("finished"), F.sum("home_goals").alias("goals")).join(drift, "name")
    return out.select(F.substring("name", 2, 9).cast("int").alias("league"), "n", "finished", "goals", "drift")


@R.add("source_event_totals", "SELECT user_id, event_type AS team, count(*) shots, count(CASE WHEN event_id % 3 = 0 THEN 1 END) on_target, round(sum(value), 4) expected_goals FROM events WHERE event_id % 4 <> 0 GROUP BY ALL")
def source_event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots, shots on target and expected goals per group of events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select("user_id", F.when(F.col("event_id") % 4 != 0, "Shot").otherwise("Pass").alias("type"), F.col("event_type").alias("team"), F.when(F.col("event_id") % 3 == 0, "Goal").otherwise("Off T").alias("outcome"), F.col("value").alias("expected"))
    out = readers.shot_totals(rows, "user_id")
    return out.withColumn("expected_goals", F.round("expected_goals", 4))


@R.add("lake_audit", "SELECT 'UNLISTED' AS problem, count(DISTINCT league) AS n FROM matches WHERE league >= 3 UNION ALL SELECT 'HASH_MISMATCH', count(DISTINCT league) FROM matches WHERE league = 0", ("matches",))
def lake_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity of a lake of raw files against its manifest."""
    path = new_path(spark, "lake")
    view(spark, sf_dir, "matches").select("league", "match_id", "home_goals").repartition(5, "league").sortWithinPartitions("match_id").write.partitionBy("league").csv(path)
    found = lake.scan_files(spark, path, "*.csv")
    league = F.regexp_extract("path", "league=(\\d+)", 1).cast("int")
    listed = written(found.where(league < 3).select("path", F.when(league == 0, "0").otherwise(F.col("sha256")).alias("sha256")), "manifest")
    return lake.integrity(listed, found).groupBy("problem").agg(F.count("*").alias("n"))


@R.add("lake_coverage_gaps", "SELECT * FROM (WITH w AS (SELECT league, unnest(range(1993, 2001)) season FROM (SELECT DISTINCT league FROM matches) q) SELECT league AS competition, season::INT season, concat(lpad((season % 100)::VARCHAR, 2, '0'), lpad(((season + 1) % 100)::VARCHAR, 2, '0'), '/D', league) dataset_key FROM w WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.league = w.league AND m.season = w.season)) z", ("matches",))
def lake_coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets that the calendar expects and the lake lacks."""
    m = view(spark, sf_dir, "matches")
    comps = m.select(F.col("league").alias("competition")).distinct().select("competition", F.concat(F.lit("D"), F.col("competition").cast("string")).alias("code"), F.lit(1993).alias("first_season"))
    return lake.expected_datasets(comps, F.lit(2000)).join(m.select(F.col("league").alias("competition"), "season").distinct(), ["competition", "season"], "left_anti")


@R.add("entity_names", "SELECT s_suppkey, concat('supplier ', s_suppkey % 7, '-x') AS raw, 'supplier x' AS clean, 'supplier-x' AS slug FROM supplier")
def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names cleaned of accents, punctuation, stop words and numbers."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.concat(F.lit("supplier "), F.col("s_suppkey") % 7, F.lit("-x")).alias("raw"))
    noisy = F.concat(F.lit("F.C. & Súpplier the "), F.col("s_suppkey") % 7, F.lit("-X"))
    noisy = F.replace(noisy, F.lit("F.C."), F.lit("fc"))
    return s.select("s_suppkey", "raw", N.normal_name(noisy).alias("clean"), N.slug(noisy).alias("slug"))


@R.add("entity_static", "SELECT method, count(*) n FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'REGISTRY' WHEN 1 THEN 'NORMALIZED' WHEN 2 THEN 'AMBIGUOUS' ELSE 'NEW_ENTITY' END AS method FROM customer) q GROUP BY method")
def entity_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static resolution of raw names: equal, cleaned, subset of words, unknown."""
    word = lambda k: F.translate(F.conv(k.cast("string"), 10, 26), "0123456789", "QRSTUVWXYZ")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.lower(word(F.col("c_custkey"))).alias("w"))
    aliases = c.where("k % 4 <> 3").select(F.lit("X").alias("country"), F.concat(F.lit("name"), "w", F.lit(" city"), "w").alias("alias"), F.concat(F.lit("team"), "k").alias("team"))
    name = F.concat(F.lit("name"), "w")
    raw = F.when(F.col("k") % 4 == 0, F.concat(F.lit(" NAME"), F.upper("w"), F.lit(" CITY"), F.upper("w"))).when(F.col("k") % 4 == 1, F.concat(F.lit("F.C. "), name, F.lit("-City"), "w")).when(F.col("k") % 4 == 2, name).otherwise(F.concat(F.lit("other"), "w"))
    out = entity.resolve_static(c.select(F.lit("X").alias("country"), F.regexp_replace(raw, "F\\.C\\.", "FC").alias("raw")), aliases)
    return out.groupBy("method").agg(F.count("*").alias("n"))


@R.add("entity_cooccurrence", "SELECT team AS raw_team, team, count(*) votes, 'COOCCURRENCE' AS method FROM (SELECT DISTINCT home_team AS team, away_team, match_date FROM matches WHERE home_team % 100 < 3 AND away_team % 100 >= 3) q GROUP BY team", ("matches",))
def entity_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown names of a source identified by the fixtures they share with known teams."""
    m = view(spark, sf_dir, "matches").select("home_team", "away_team", "match_date").distinct()
    unknown = F.col("home_team") % 100 < 3
    fixtures = m.where(unknown & (F.col("away_team") % 100 >= 3)).select(F.concat(F.lit("n"), "home_team").alias("raw"), F.concat(F.lit("n"), "away_team").alias("opponent_raw"), F.lit("H").alias("side"), "match_date")
    resolved = m.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct().where("team % 100 >= 3").select(F.concat(F.lit("n"), "team").alias("raw"), "team")
    reference = m.select(F.col("away_team").alias("team"), F.col("home_team").alias("opponent"), F.lit("A").alias("side"), "match_date")
    out = entity.cooccurrence(fixtures, resolved, reference, share=0.5)
    return out.select(F.substring("raw", 2, 9).cast("int").alias("raw_team"), "team", "votes", "method")


@R.add("entity_injectivity", "SELECT season, min(team) AS first_team, count(*) n FROM (SELECT DISTINCT season, home_team AS team FROM matches WHERE home_team % 2 = 0) q GROUP BY season", ("matches",))
def entity_injectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams for which one source has two names in a season."""
    m = view(spark, sf_dir, "matches").select("season", F.col("home_team").alias("team")).distinct()
    two = m.select(F.lit("s").alias("source"), "season", F.explode(F.array(F.concat(F.lit("a"), "team"), F.concat(F.when(F.col("team") % 2 == 0, "b").otherwise("a"), F.col("team")))).alias("raw"), "team")
    return entity.not_injective(two).groupBy("season").agg(F.min("team").alias("first_team"), F.count("*").alias("n"))



@R.add("market_movement", "SELECT user_id, event_type, arg_min(value, (ts, event_id)) opening, arg_max(value, (ts, event_id)) AS \"current\", min(value) lowest, max(value) highest, median(value) median, count(*) n, round(arg_max(value, (ts, event_id)) / arg_min(value, (ts, event_id)) - 1, 6) moved FROM ticks GROUP BY ALL", ("ticks",))
def market_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening, current, lowest, highest and median of each series of ticks."""
    out = market.movement(view(spark, sf_dir, "ticks"), ["user_id", "event_type"], "ts", "value", ["event_id"])
    return out.select("user_id", "event_type", "opening", "current", "lowest", "highest", "median", "n", F.round("moved", 6).alias("moved"))


@R.add("movement_by_day", "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, min(value) low, max(value) high, count(*) n FROM ticks GROUP BY ALL", ("ticks",))
def movement_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming window operator as a batch: range of values per user and day."""
    out = streams.bucketed(view(spark, sf_dir, "ticks").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", "value", "1 day")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "low", "high", "n")


@R.add("activity_bursts", "SELECT * FROM (WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END s FROM ticks), k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) SELECT user_id, min(ts) AS start, count(*) n FROM k GROUP BY user_id, k) z", ("ticks",))
def activity_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming session operator as a batch: bursts of a user's activity."""
    out = streams.bursts(view(spark, sf_dir, "ticks").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", "6 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
