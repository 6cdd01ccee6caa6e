"""Coverage, gaps and audit in full, on matches and prices with sources, markets, statistics and qualities of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..sources.views import view
from .registry import Registry

R = Registry()
TODAY = "1998-12-01"
RELIABILITY = {"alpha": 0.9, "beta": 0.7}

#: The same text for both engines: what of matches and prices is known, derived from their keys.
FACTS = """SELECT match_id, league, season, home_team, away_team, match_date, kickoff, available_at, disputed, CASE WHEN status = 'SCHEDULED' AND match_id % 4 = 0 THEN 'UNKNOWN' ELSE status END AS status,
  CASE WHEN match_id % 10 < 7 THEN 'EXACT' WHEN match_id % 10 = 7 THEN 'APPROXIMATE' ELSE 'DATE_ONLY' END AS timestamp_quality, match_id % 4 <> 3 AS in_beta, match_id % 5 = 0 AS in_gamma, season % 3 = 0 AND match_id % 2 = 0 AS has_xg, match_id % 3 <> 0 AS has_shots, match_id % 7 = 0 AS has_managers FROM matches"""
OFFERS = """SELECT match_id, book, seen_at, CASE WHEN snapshot = 'PRE_MATCH' AND book = 3 THEN 'OPENING' ELSE snapshot END AS snapshot, CASE WHEN book = 5 THEN 'OU' WHEN book = 6 AND match_id % 5 < 4 THEN 'AH' ELSE '1X2' END AS market,
  CASE WHEN book % 2 = 1 THEN 'EXACT' ELSE 'APPROXIMATE' END AS timestamp_quality, book = 7 AS is_aggregate FROM prices"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.sql(FACTS.replace("FROM matches", "FROM {matches}"), matches=view(spark, sf_dir, "matches"))
    some = lambda c, name: F.when(F.col(c), F.lit(name))
    sources = F.array_compact(F.array(F.lit("alpha"), some("in_beta", "beta"), some("in_gamma", "gamma")))
    stats = F.map_from_entries(F.array_compact(F.array(*(F.when(F.col(c), F.struct(F.lit(k), F.lit(1.0))) for c, k in (("has_xg", "xg"), ("has_shots", "shots"), ("has_shots", "corners"), ("in_gamma", "cards"))))))
    return m.withColumns({"sources": sources, "stats": stats, "has_events": F.col("has_xg")})


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OFFERS.replace("FROM prices", "FROM {prices}"), prices=view(spark, sf_dir, "prices"))


_LEVELS = f"""o AS ({OFFERS}), k AS ({FACTS}),
  f AS (SELECT match_id, max((market='1X2' AND snapshot='PRE_MATCH')::INT) pre, max((snapshot='OPENING')::INT) opening, max((market='1X2' AND snapshot='CLOSING')::INT) closing, max((market='OU')::INT) ou, max((market='AH')::INT) ah, min(CASE WHEN snapshot='PRE_MATCH' THEN (timestamp_quality='EXACT')::INT END) pre_exact FROM o GROUP BY match_id),
  j AS (SELECT k.*, f.pre, f.opening, f.closing, f.ou, f.ah, f.pre_exact FROM k LEFT JOIN f ON k.match_id = f.match_id),
  g AS (SELECT league, season, grouping(league, season) AS level, count(*) AS matches, count(*) FILTER (status='FINISHED') AS results, count(*) FILTER (status='SCHEDULED') AS scheduled, count(*) FILTER (status='UNKNOWN') AS past_without_result,
    len(list_distinct(list_concat(list(home_team), list(away_team)))) AS teams, max(match_date) AS last_date, avg(coalesce(pre,0)) AS prematch_1x2, avg(coalesce(opening,0)) AS opening, avg(coalesce(closing,0)) AS closing_1x2, avg(coalesce(ou,0)) AS ou, avg(coalesce(ah,0)) AS ah,
    avg(has_xg::INT) AS xg, avg(in_gamma::INT) AS cards, avg(has_shots::INT) AS shots, avg(has_managers::INT) AS managers, avg((timestamp_quality='EXACT')::INT) AS exact_kickoff, avg((timestamp_quality='APPROXIMATE')::INT) AS approximate_kickoff, avg((timestamp_quality='DATE_ONLY')::INT) AS date_only,
    avg((in_beta OR in_gamma)::INT) AS multi_source, count(*) FILTER (disputed=1) AS disputed, concat('alpha', CASE WHEN bool_or(in_beta) THEN ',beta' ELSE '' END, CASE WHEN bool_or(in_gamma) THEN ',gamma' ELSE '' END) AS sources, avg(CAST(0.9 AS DOUBLE)) AS source_reliability,
    avg(CASE timestamp_quality WHEN 'EXACT' THEN CAST(1 AS DOUBLE) WHEN 'APPROXIMATE' THEN 0.6 ELSE 0.3 END) AS timestamp_score, min(CASE WHEN pre = 1 THEN pre_exact END) AS exact_prices, max(pre) AS priced
    FROM j GROUP BY GROUPING SETS ((league, season), (league), ())),
  b AS (SELECT league, season, grouping(league, season) AS level, count(DISTINCT book) FILTER (NOT is_aggregate) AS bookmakers FROM o JOIN k ON o.match_id = k.match_id GROUP BY GROUPING SETS ((league, season), (league), ())),
  c AS (SELECT g.*, coalesce(b.bookmakers, 0) AS bookmakers, CASE WHEN g.level = 0 THEN teams * (teams - 1) END AS expected, CASE WHEN scheduled = 0 AND last_date < DATE '{TODAY}' THEN 'COMPLETE' ELSE 'IN_PROGRESS' END AS state,
    concat(CASE WHEN exact_kickoff >= 0.95 THEN 'RESULTS_PIT_EXACT' ELSE 'RESULTS_PIT_DAILY' END, '+', CASE WHEN coalesce(priced, 0) = 0 THEN 'NO_ODDS' WHEN exact_prices = 1 THEN 'ODDS_PIT_EXACT' ELSE 'ODDS_PIT_APPROXIMATE' END) AS pit_capability
    FROM g LEFT JOIN b ON g.level = b.level AND g.league IS NOT DISTINCT FROM b.league AND g.season IS NOT DISTINCT FROM b.season)"""
_SHARES = "prematch_1x2 opening closing_1x2 ou ah xg cards shots managers exact_kickoff approximate_kickoff date_only multi_source source_reliability timestamp_score".split()
_COUNTS = "league season level state matches results scheduled past_without_result teams bookmakers expected disputed sources pit_capability".split()


@R.add("coverage_matrix", f"SELECT * FROM (WITH {_LEVELS} SELECT {', '.join(_COUNTS)}, {', '.join(f'round({c}, 6) AS {c}' for c in _SHARES)}, round(results::DOUBLE / greatest(expected, 1), 6) AS results_share FROM c) z", ("matches", "prices"))
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of coverage by season, league and in all."""
    out = quality.coverage_matrix(facts(spark, sf_dir), offers(spark, sf_dir), F.lit(TODAY).cast("date"), RELIABILITY)
    return out.select(*_COUNTS, *(F.round(c, 6).alias(c) for c in (*_SHARES, "results_share")))


_STRUCTURE = """p AS (SELECT league, season, count(CASE WHEN c > 1 THEN 1 END) repeated_pairs FROM (SELECT league, season, home_team, away_team, count(*) c FROM matches GROUP BY ALL) q GROUP BY ALL),
  t AS (SELECT league, season, team, count(*) c FROM (SELECT league, season, home_team team FROM matches UNION ALL SELECT league, season, away_team FROM matches) q GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY league, season) n FROM t),
  w AS (SELECT p.league, p.season, repeated_pairs, (SELECT count(*) FROM n WHERE n.league = p.league AND n.season = p.season AND c <> 2*(n-1)) wrong_counts FROM p)"""


@R.add(
    "coverage_gaps",
    f"""SELECT * FROM (WITH {_LEVELS}, {_STRUCTURE}, h AS (SELECT c.*, w.repeated_pairs, w.wrong_counts FROM c JOIN w ON c.league = w.league AND c.season = w.season WHERE c.level = 0 AND (c.league + c.season) % 4 <> 0),
    x AS (SELECT league, min(season) oldest, max(season) newest, count(*) present, list_sort(list(season)) have, string_agg(season::VARCHAR, ',' ORDER BY season) FILTER (state = 'COMPLETE' AND (results < expected OR repeated_pairs > 0 OR wrong_counts > 0)) incomplete, string_agg(season::VARCHAR, ',' ORDER BY season) FILTER (past_without_result > 0) without_results,
      count(*) FILTER (prematch_1x2 = 0) without_prematch, count(*) FILTER (closing_1x2 = 0) without_closing, count(*) FILTER (exact_kickoff < 0.5) without_exact_kickoff, string_agg(season::VARCHAR, ',' ORDER BY season) FILTER (xg > 0) with_xg,
      concat_ws(',', CASE WHEN max(prematch_1x2) = 0 THEN '1X2' END, CASE WHEN max(ou) = 0 THEN 'OU' END, CASE WHEN max(ah) = 0 THEN 'AH' END) missing_markets FROM h GROUP BY league)
    SELECT league, oldest, newest, present, coalesce(incomplete, '') incomplete, coalesce(without_results, '') without_results, without_prematch, without_closing, without_exact_kickoff, coalesce(with_xg, '') with_xg, missing_markets, array_to_string(list_filter(range(oldest, newest + 1), lambda s: NOT list_contains(have, s)), ',') missing FROM x) z""",
    ("matches", "prices"),
)
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each league lacks, from a source with holes."""
    m = facts(spark, sf_dir)
    rows = quality.coverage_matrix(m, offers(spark, sf_dir), F.lit(TODAY).cast("date"), RELIABILITY, [("league", "season")]).where("(league + season) % 4 <> 0")
    out = quality.gaps(rows, quality.anomalies(m))
    text = lambda c: F.array_join(c, ",").alias(c)
    return out.select("league", "oldest", "newest", "present", *(text(c) for c in ("incomplete", "without_results")), "without_prematch", "without_closing", "without_exact_kickoff", *(text(c) for c in ("with_xg", "missing_markets", "missing")))


@R.add(
    "coverage_scores",
    f"""SELECT * FROM (WITH {_LEVELS}, {_STRUCTURE}, h AS (SELECT c.*, w.repeated_pairs, w.wrong_counts FROM c JOIN w ON c.league = w.league AND c.season = w.season WHERE c.level = 0),
    v AS (SELECT league, season, CASE WHEN state = 'COMPLETE' THEN least(1.0, results::DOUBLE / greatest(expected, 1)) ELSE least(1.0, results::DOUBLE / greatest(results + past_without_result, 1)) END a, greatest(0.0, 1 - (repeated_pairs + wrong_counts + past_without_result)::DOUBLE / matches) b, timestamp_score c, source_reliability d, multi_source e,
      CASE WHEN multi_source > 0 THEN 1 - disputed / (multi_source * matches) END f, greatest(0.0, 1 - past_without_result / 10.0) g, prematch_1x2 h FROM h)
    SELECT league, season, round((a + b + c + d + e + coalesce(f, 0) + g + h) / CASE WHEN f IS NULL THEN 7 ELSE 8 END, 6) AS score, CASE WHEN f IS NULL THEN 7 ELSE 8 END::INT AS measured FROM v) z""",
    ("matches", "prices"),
)
def coverage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted quality of every season from its coverage and structure."""
    m = facts(spark, sf_dir)
    rows = quality.coverage_matrix(m, offers(spark, sf_dir), F.lit(TODAY).cast("date"), RELIABILITY, [("league", "season")]).join(quality.anomalies(m), ["league", "season"])
    return quality.season_score(rows).select("league", "season", F.round("score", 6).alias("score"), "measured")


@R.add(
    "timestamp_audit",
    f"""SELECT * FROM (WITH o AS ({OFFERS}), k AS ({FACTS}), j AS (SELECT o.*, k.kickoff FROM o LEFT JOIN k ON o.match_id = k.match_id)
    SELECT 'matches' AS subject, 'finished_without_availability' AS item, count(*) AS n, count(*) > 0 AS violation FROM k WHERE status = 'FINISHED' AND available_at IS NULL
    UNION ALL SELECT 'matches', 'result_available_before_kickoff', count(*), count(*) > 0 FROM k WHERE available_at <= kickoff UNION ALL SELECT 'matches', 'result_available_in_future', count(*), count(*) > 0 FROM k WHERE available_at > TIMESTAMP '{TODAY}'
    UNION ALL SELECT 'matches', concat('quality:', q), (SELECT count(*) FROM k WHERE timestamp_quality = q), false FROM (SELECT unnest(['EXACT', 'APPROXIMATE', 'DATE_ONLY']) q) z
    UNION ALL SELECT 'prices', 'early_price_at_or_after_kickoff', count(*), count(*) > 0 FROM j WHERE snapshot IN ('PRE_MATCH', 'OPENING') AND seen_at >= kickoff UNION ALL SELECT 'prices', 'closing_price_before_kickoff', count(*), count(*) > 0 FROM j WHERE snapshot = 'CLOSING' AND seen_at < kickoff
    UNION ALL SELECT 'prices', 'price_without_time', count(*), count(*) > 0 FROM j WHERE seen_at IS NULL UNION ALL SELECT 'price times', concat(snapshot, ':', timestamp_quality), count(*), false FROM o GROUP BY snapshot, timestamp_quality
    UNION ALL SELECT 'seasons', CASE WHEN x >= 0.5 THEN 'exact' ELSE 'date only' END i, count(*), false FROM (SELECT avg((timestamp_quality = 'EXACT')::INT) x FROM k GROUP BY league, season) q GROUP BY i) z""",
    ("matches", "prices"),
)
def timestamp_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the times that visibility rests on, and how good the times are."""
    return quality.timestamp_audit(facts(spark, sf_dir), offers(spark, sf_dir), F.lit(TODAY).cast("timestamp_ntz"))
