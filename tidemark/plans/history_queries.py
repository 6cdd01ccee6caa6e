"""Queries on visibility, form and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, pit, quality
from ..sources.views import view
from .registry import Registry

R = Registry()
AS_OF = "1996-06-30 12:00:00"


def _as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


@R.add("pit_visible_results", f"SELECT league, season, count(*) n, sum(home_goals)::BIGINT home_goals, sum(away_goals)::BIGINT away_goals FROM matches WHERE status = 'FINISHED' AND available_at <= TIMESTAMP '{AS_OF}' AND available_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1000 DAY AND disputed = 0 GROUP BY ALL", ("matches",))
def pit_visible_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results visible at a time, since 1,000 days before it, without disputed ones, by league and season."""
    done = view(spark, sf_dir, "matches").where("status = 'FINISHED'")
    seen = pit.visible(done, _as_of(), since=_as_of() - F.expr("INTERVAL 1000 DAY"), disputed="disputed")
    return seen.groupBy("league", "season").agg(F.count("*").alias("n"), F.sum("home_goals").alias("home_goals"), F.sum("away_goals").alias("away_goals"))


@R.add("pit_fixtures", f"SELECT match_id, league, kickoff, CASE WHEN status = 'FINISHED' AND available_at <= TIMESTAMP '{AS_OF}' THEN 'FINISHED' ELSE 'SCHEDULED' END status FROM matches", ("matches",))
def pit_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule as it looked at a time."""
    return pit.fixtures_at(view(spark, sf_dir, "matches"), _as_of(), ["home_goals", "away_goals"]).select("match_id", "league", "kickoff", "status")


@R.add("pit_latest_prices", "SELECT p.match_id, book, arg_max(odds_h, (seen_at, supplier)) odds_h, max(seen_at) seen_at, count(*) n FROM prices p JOIN matches m ON p.match_id = m.match_id WHERE seen_at <= m.kickoff - INTERVAL 3 HOUR GROUP BY ALL", ("matches", "prices"))
def pit_latest_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's latest price three hours before kickoff, and how many were visible."""
    limits = view(spark, sf_dir, "matches").select("match_id", (F.col("kickoff") - F.expr("INTERVAL 3 HOUR")).alias("as_of"))
    prices = view(spark, sf_dir, "prices").select("match_id", "book", "supplier", "seen_at", "odds_h")
    return pit.latest_at(prices, limits, ["match_id"], ["match_id", "book"], "seen_at", "as_of", ["supplier"], "n").select("match_id", "book", "odds_h", "seen_at", "n")


_ASOF = "SELECT l.event_id, l.user_id, l.ts, r.ts AS seen, r.value AS last_value FROM (SELECT * FROM ticks WHERE event_type = (SELECT min(event_type) FROM ticks)) l ASOF LEFT JOIN (SELECT user_id, ts, arg_max(value, event_id) AS value FROM ticks WHERE event_type = (SELECT max(event_type) FROM ticks) GROUP BY user_id, ts) r ON l.user_id = r.user_id AND l.ts >= r.ts"


def _asof(spark: SparkSession, sf_dir: str, bucket: str | None) -> DataFrame:
    ticks = view(spark, sf_dir, "ticks")
    low, high = ticks.agg(F.min("event_type"), F.max("event_type")).first()
    right = ticks.where(F.col("event_type") == high).select("user_id", F.col("ts").alias("seen"), F.col("value").alias("last_value"), "event_id")
    out = pit.asof_join(ticks.where(F.col("event_type") == low), right, ["user_id"], "ts", "seen", ["last_value"], ["event_id"], bucket)
    return out.select("event_id", "user_id", "ts", "seen", "last_value")


@R.add("pit_asof_join", _ASOF, ("ticks",))
def pit_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tick of one type with the user's last value of another type at or before it."""
    return _asof(spark, sf_dir, None)


@R.add("pit_asof_join_bucketed", _ASOF, ("ticks",))
def pit_asof_join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, ordered by user and day, with what earlier days end with carried over."""
    return _asof(spark, sf_dir, "DAY")


@R.add("pit_decision_times", "SELECT m.match_id, coalesce(max(CASE WHEN seen_at <= kickoff - INTERVAL 5 HOUR THEN seen_at END), any_value(kickoff) - INTERVAL 5 HOUR) decision_at, CASE WHEN max(CASE WHEN seen_at <= kickoff - INTERVAL 5 HOUR THEN seen_at END) IS NULL THEN 'LEAD' ELSE 'LAST_TICK' END AS policy FROM matches m LEFT JOIN prices p ON m.match_id = p.match_id GROUP BY m.match_id", ("matches", "prices"))
def pit_decision_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each match is decided: at its last price five hours before kickoff, or then."""
    return pit.decision_times(view(spark, sf_dir, "matches"), view(spark, sf_dir, "prices"), "match_id", "kickoff", "seen_at", 5)


_ROW = "md5(concat_ws('|', concat(length(match_id::VARCHAR), ':', match_id::VARCHAR), coalesce(length(home_goals::VARCHAR) || ':' || home_goals::VARCHAR, 'N'), coalesce(length(away_goals::VARCHAR) || ':' || away_goals::VARCHAR, 'N')))"
_LIMBS = [f"sum(concat('0x', substr({_ROW}, {start}, 16))::UBIGINT::HUGEINT)" for start in (1, 17)]
_PRINTED = "concat(" + ", ".join(f"lpad(lower(to_hex(({{{i}}} % {pit.PRIME})::BIGINT)), 16, '0')" for i in range(2)) + ")"


@R.add("pit_running_fingerprint", f"SELECT * FROM (WITH g AS (SELECT league, available_at, count(*) n, {_LIMBS[0]} a, {_LIMBS[1]} b FROM matches WHERE status = 'FINISHED' GROUP BY ALL), s AS (SELECT league, available_at, (sum(n) OVER w)::BIGINT n, sum(a) OVER w a, sum(b) OVER w b FROM g WINDOW w AS (PARTITION BY league ORDER BY available_at ROWS UNBOUNDED PRECEDING)) SELECT league, available_at, n, {_PRINTED.format('a', 'b')} AS fingerprint FROM s) z", ("matches",))
def pit_running_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of all results visible at every availability time of each league."""
    done = view(spark, sf_dir, "matches").where("status = 'FINISHED'")
    return pit.running_fingerprint(done, ["match_id", "home_goals", "away_goals"], "available_at", ["league"])


@R.add("dataset_fingerprint", f"SELECT count(*) n, {_PRINTED.format(*_LIMBS)} AS fingerprint FROM matches", ("matches",))
def dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-free fingerprint of the whole table."""
    return pit.fingerprint(view(spark, sf_dir, "matches"), ["match_id", "home_goals", "away_goals"])


@R.add(
    "team_form",
    """SELECT * FROM (WITH t AS (SELECT match_id, league, season, match_date, 'home' side, home_team team, home_goals gf, away_goals ga, status FROM matches UNION ALL SELECT match_id, league, season, match_date, 'away', away_team, away_goals, home_goals, status FROM matches),
    p AS (SELECT *, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END pts FROM t WHERE status = 'FINISHED'),
    j AS (SELECT t.match_id, t.side, p.*, row_number() OVER (PARTITION BY t.match_id, t.side ORDER BY p.match_date DESC, p.match_id DESC) r, t.match_date d, t.season s FROM t JOIN p ON t.team = p.team AND t.league = p.league AND p.match_date < t.match_date),
    a AS (SELECT match_id, side, avg(CASE WHEN r <= 5 THEN pts END) p5, avg(CASE WHEN r <= 10 THEN gf END) f10, avg(CASE WHEN r <= 10 THEN ga END) a10, count(CASE WHEN match_date > d - 365 THEN 1 END) m365, count(CASE WHEN match_date > d - 14 THEN 1 END) m14, max(match_date) l, max((season = s - 1)::INT) prev, min(season) f, any_value(s) s FROM j GROUP BY match_id, side)
    SELECT t.match_id, t.side, t.team, coalesce(m365, 0) matches_365d, coalesce(m14, 0) matches_14d, (t.match_date - l)::INT rest_days, round(p5, 6) points_last5, round(f10, 6) gf_last10, round(a10, 6) ga_last10, coalesce((prev = 0 AND f < a.s)::INT, 0) promoted, (l IS NULL)::INT new_to_league FROM t LEFT JOIN a ON t.match_id = a.match_id AND t.side = a.side) z""",
    ("matches",),
)
def team_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form of both teams before every match."""
    rows = features.long_form(view(spark, sf_dir, "matches")).withColumn("played", F.col("status") == "FINISHED")
    out = features.team_form(rows)
    return out.select("match_id", "side", "team", "matches_365d", "matches_14d", "rest_days", *(F.round(c, 6).alias(c) for c in ("points_last5", "gf_last10", "ga_last10")), "promoted", "new_to_league")


@R.add(
    "base_rates",
    """SELECT * FROM (WITH d AS (SELECT league, match_date, count(*) c, sum((home_goals > away_goals)::INT) h, sum((home_goals = away_goals)::INT) e, sum((home_goals < away_goals)::INT) a FROM matches WHERE status = 'FINISHED' GROUP BY ALL),
    s AS (SELECT league, match_date, coalesce(sum(c) OVER w, 0) n, coalesce(sum(h) OVER w, 0) h, coalesce(sum(e) OVER w, 0) e, coalesce(sum(a) OVER w, 0) a FROM d WINDOW w AS (PARTITION BY league ORDER BY match_date RANGE BETWEEN INTERVAL 1824 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
    SELECT league, match_date, n::BIGINT n, round((h + 30*0.45)/(n+30), 6) p_home, round((e + 30*0.28)/(n+30), 6) p_draw, round((a + 30*0.27)/(n+30), 6) p_away FROM s) z""",
    ("matches",),
)
def base_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base-rate model: smoothed outcome rates of the five years before each match day."""
    out = features.base_rates(view(spark, sf_dir, "matches").where("status = 'FINISHED'"))
    return out.select("league", "match_date", "n", *(F.round(c, 6).alias(c) for c in ("p_home", "p_draw", "p_away")))


@R.add(
    "league_level",
    """SELECT * FROM (WITH d AS (SELECT league, match_date, count(*) c, sum(home_goals + away_goals) g FROM matches WHERE status = 'FINISHED' GROUP BY ALL)
    SELECT league, match_date, round(sum(g) OVER w / sum(c) OVER w / 2, 6) goals_level FROM d WINDOW w AS (PARTITION BY league ORDER BY match_date RANGE BETWEEN INTERVAL 729 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)) z""",
    ("matches",),
)
def league_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals per team of each league over the two years before each match day."""
    out = features.league_level(view(spark, sf_dir, "matches").where("status = 'FINISHED'"))
    return out.select("league", "match_date", F.round("goals_level", 6).alias("goals_level"))


@R.add(
    "quality_coverage",
    """SELECT * FROM (WITH f AS (SELECT match_id, max((snapshot='PRE_MATCH')::INT) p, max((snapshot='CLOSING')::INT) c, count(DISTINCT book) b FROM prices GROUP BY match_id),
    t AS (SELECT league, season, count(DISTINCT team) teams FROM (SELECT league, season, home_team team FROM matches UNION ALL SELECT league, season, away_team FROM matches) q GROUP BY ALL),
    g AS (SELECT league, season, count(*) matches, count(CASE WHEN status='FINISHED' THEN 1 END) finished, count(CASE WHEN status='SCHEDULED' THEN 1 END) scheduled, count(CASE WHEN disputed=1 THEN 1 END) disputed, avg(coalesce(p,0)) sp, avg(coalesce(c,0)) sc, avg(coalesce(b,0)) bk, min(match_date) first_date, max(match_date) last_date FROM matches m LEFT JOIN f ON m.match_id = f.match_id GROUP BY ALL)
    SELECT g.league, g.season, matches, finished, scheduled, disputed, teams, teams*(teams-1) expected, round(sp, 6) share_pre, round(sc, 6) share_closing, round(bk, 6) books, first_date, last_date FROM g JOIN t ON g.league = t.league AND g.season = t.season) z""",
    ("matches", "prices"),
)
def quality_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each league and season."""
    out = quality.coverage(view(spark, sf_dir, "matches"), view(spark, sf_dir, "prices"))
    return out.select("league", "season", "matches", "finished", "scheduled", "disputed", "teams", "expected", *(F.round(c, 6).alias(c) for c in ("share_pre", "share_closing", "books")), "first_date", "last_date")


@R.add(
    "quality_anomalies",
    """SELECT * FROM (WITH p AS (SELECT league, season, count(CASE WHEN c > 1 THEN 1 END) repeated_pairs FROM (SELECT league, season, home_team, away_team, count(*) c FROM matches GROUP BY ALL) q GROUP BY ALL),
    t AS (SELECT league, season, team, count(*) c FROM (SELECT league, season, home_team team FROM matches UNION ALL SELECT league, season, away_team FROM matches) q GROUP BY ALL),
    n AS (SELECT *, count(*) OVER (PARTITION BY league, season) n FROM t)
    SELECT p.league, p.season, repeated_pairs, (SELECT count(*) FROM n WHERE n.league = p.league AND n.season = p.season AND c <> 2*(n-1))::INT wrong_counts FROM p) z""",
    ("matches",),
)
def quality_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated pairings and teams with a wrong number of matches."""
    return quality.anomalies(view(spark, sf_dir, "matches"))


@R.add("quality_missing_seasons", "SELECT * FROM (WITH m AS (SELECT * FROM matches WHERE (league + season) % 4 <> 0), s AS (SELECT league, unnest(range(min(season), max(season) + 1)) season FROM m GROUP BY league) SELECT league, season::INT season FROM s WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.league = s.league AND m.season = s.season)) z", ("matches",))
def quality_missing_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons that a source with holes lacks."""
    return quality.missing_seasons(view(spark, sf_dir, "matches").where("(league + season) % 4 <> 0"))


@R.add(
    "quality_composite",
    """SELECT * FROM (WITH g AS (SELECT league, season, count(CASE WHEN status='FINISHED' THEN 1 END)::DOUBLE / count(*) fin, 1 - count(CASE WHEN disputed=1 THEN 1 END)::DOUBLE / count(*) undis, CASE WHEN season % 3 = 0 THEN NULL ELSE count(DISTINCT match_date)::DOUBLE / count(*) END spread FROM matches GROUP BY league, season)
    SELECT league, season, round((fin*0.5 + undis*0.3 + coalesce(spread*0.2, 0)) / (0.8 + CASE WHEN spread IS NULL THEN 0 ELSE 0.2 END), 6) score, CASE WHEN spread IS NULL THEN 2 ELSE 3 END::INT measured, CASE WHEN fin <= undis AND (spread IS NULL OR fin < spread) THEN 'finished' WHEN spread IS NOT NULL AND spread <= undis THEN 'spread' ELSE 'undisputed' END weakest FROM g) z""",
    ("matches",),
)
def quality_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted quality score whose weights fall to the measurable components."""
    n = F.count("*").cast("double")
    g = view(spark, sf_dir, "matches").groupBy("league", "season").agg((F.count_if(F.col("status") == "FINISHED") / n).alias("f"), (1 - F.count_if(F.col("disputed") == 1) / n).alias("u"), (F.count_distinct("match_date") / n).alias("s"))
    parts = {"finished": (F.col("f"), 0.5), "undisputed": (F.col("u"), 0.3), "spread": (F.when(F.col("season") % 3 != 0, F.col("s")), 0.2)}
    out = g.select("league", "season", *quality.composite(parts))
    return out.withColumn("score", F.round("score", 6))


@R.add(
    "quality_audit",
    """SELECT "check", violations FROM (SELECT 'result_before_kickoff' "check", count(CASE WHEN available_at < kickoff THEN 1 END) violations FROM matches UNION ALL SELECT 'finished_without_time', count(CASE WHEN status='FINISHED' AND available_at IS NULL THEN 1 END) FROM matches UNION ALL SELECT 'team_against_itself', count(CASE WHEN status='SCHEDULED' AND home_team = away_team THEN 1 END) FROM matches
    UNION ALL SELECT 'price_without_match', count(CASE WHEN kickoff IS NULL THEN 1 END) FROM prices p LEFT JOIN matches m ON p.match_id = m.match_id UNION ALL SELECT 'price_after_kickoff', count(CASE WHEN snapshot='PRE_MATCH' AND seen_at > kickoff THEN 1 END) FROM prices p LEFT JOIN matches m ON p.match_id = m.match_id UNION ALL SELECT 'closing_a_day_early', count(CASE WHEN snapshot='CLOSING' AND seen_at < kickoff - INTERVAL 24 HOUR THEN 1 END) FROM prices p LEFT JOIN matches m ON p.match_id = m.match_id) z""",
    ("matches", "prices"),
)
def quality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-in-time audit."""
    return quality.audit(view(spark, sf_dir, "matches"), view(spark, sf_dir, "prices"))


@R.add(
    "quality_drift",
    """SELECT * FROM (WITH r AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY available_at DESC, match_id DESC) r FROM matches WHERE status='FINISHED'),
    g AS (SELECT league, count(CASE WHEN r<=380 THEN 1 END)::DOUBLE n2, count(CASE WHEN r>380 THEN 1 END)::DOUBLE n1, sum(CASE WHEN r<=380 THEN (home_goals>away_goals)::INT END)::DOUBLE h2, sum(CASE WHEN r>380 THEN (home_goals>away_goals)::INT END)::DOUBLE h1, avg(CASE WHEN r<=380 THEN home_goals+away_goals END) g2, avg(CASE WHEN r>380 THEN home_goals+away_goals END) g1, var_samp(CASE WHEN r<=380 THEN home_goals+away_goals END) v2, var_samp(CASE WHEN r>380 THEN home_goals+away_goals END) v1 FROM r WHERE r <= 2280 GROUP BY league)
    SELECT league, 'home_win_rate' metric, n1::BIGINT n_ref, n2::BIGINT n_cur, round(h1/n1, 6) reference, round(h2/n2, 6) AS "current", round((h2/n2-h1/n1)/sqrt((h1+h2)/(n1+n2)*(1-(h1+h2)/(n1+n2))*(1/n1+1/n2)), 6) statistic FROM g
    UNION ALL SELECT league, 'goals_per_match', n1::BIGINT, n2::BIGINT, round(g1, 6), round(g2, 6), round((g2-g1)/sqrt(v2/n2+v1/n1), 6) FROM g) z""",
    ("matches",),
)
def quality_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent results of each league against the block before them."""
    done = view(spark, sf_dir, "matches").where("status = 'FINISHED'")
    out = quality.result_drift(done, ["league"], ["available_at", "match_id"]).where("metric <> 'draw_rate'")
    return out.select("league", "metric", "n_ref", "n_cur", *(F.round(c, 6).alias(c) for c in ("reference", "current", "statistic")))
