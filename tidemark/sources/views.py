"""Event, price and tick views derived from the order tables, for queries and tests.

The expressions are plain SQL arithmetic that Spark and DuckDB evaluate alike, so the same text serves both.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATCHES = """
SELECT o_orderkey AS match_id, CAST(o_custkey % 5 AS INT) AS league, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END AS INT) AS season,
  CAST((o_custkey % 5) * 100 + (o_orderkey % 20) AS INT) AS home_team,
  CAST((o_custkey % 5) * 100 + ((o_orderkey % 20) + 1 + (CAST(floor(o_orderkey / 20) AS BIGINT) % 19)) % 20 AS INT) AS away_team,
  CAST(o_orderdate AS DATE) AS match_date, o_orderdate + INTERVAL 15 HOUR AS kickoff, o_orderdate + INTERVAL 18 HOUR AS available_at,
  CAST((o_orderkey * 7 + o_custkey) % 5 AS INT) AS home_goals, CAST((o_orderkey * 3 + o_custkey * 11) % 4 AS INT) AS away_goals,
  CASE WHEN o_orderstatus = 'P' THEN 'SCHEDULED' ELSE 'FINISHED' END AS status, CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS disputed, o_custkey AS cust
FROM orders"""

PRICES = """
SELECT match_id, book, supplier, seen_at, snapshot, wh + wd + wa AS w_all, wh, wd, wa,
  round((wh + wd + wa) / (wh * CAST(1.05 AS DOUBLE)), 2) AS odds_h, round((wh + wd + wa) / (wd * CAST(1.05 AS DOUBLE)), 2) AS odds_d, round((wh + wd + wa) / (wa * CAST(1.05 AS DOUBLE)), 2) AS odds_a
FROM (SELECT l_orderkey AS match_id, l_linenumber AS book, l_suppkey AS supplier, o_orderdate + INTERVAL 15 HOUR - CAST(l_quantity AS INT) * INTERVAL 1 HOUR AS seen_at,
    CASE WHEN l_returnflag = 'R' THEN 'CLOSING' ELSE 'PRE_MATCH' END AS snapshot,
    30 + (l_orderkey * 13 + l_linenumber * 5 + l_suppkey * 3) % 25 AS wh, 20 + (l_orderkey * 7 + l_linenumber * 3 + l_suppkey * 5) % 12 AS wd, 25 + (l_orderkey * 11 + l_linenumber * 9 + l_suppkey * 7) % 25 AS wa
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) q"""

#: One row per quoted selection.
QUOTES = """
SELECT match_id, book, supplier, seen_at, snapshot, 'H' AS selection, odds_h AS odds FROM prices
UNION ALL SELECT match_id, book, supplier, seen_at, snapshot, 'D' AS selection, odds_d AS odds FROM prices
UNION ALL SELECT match_id, book, supplier, seen_at, snapshot, 'A' AS selection, odds_a AS odds FROM prices"""

TICKS = "SELECT event_id, user_id, event_type, ts, value FROM events"

#: Forecasts: probabilities of home, draw, away of a model on a finished match, with the outcome (0, 1, 2).
FORECASTS = """
SELECT m.match_id, m.league, m.season, m.match_date, x.model,
  (30 + (m.match_id * x.a) % 25) / CAST(30 + (m.match_id * x.a) % 25 + 20 + (m.match_id * x.b) % 12 + 25 + (m.match_id * x.c) % 25 AS DOUBLE) AS p_home,
  (20 + (m.match_id * x.b) % 12) / CAST(30 + (m.match_id * x.a) % 25 + 20 + (m.match_id * x.b) % 12 + 25 + (m.match_id * x.c) % 25 AS DOUBLE) AS p_draw,
  (25 + (m.match_id * x.c) % 25) / CAST(30 + (m.match_id * x.a) % 25 + 20 + (m.match_id * x.b) % 12 + 25 + (m.match_id * x.c) % 25 AS DOUBLE) AS p_away,
  CASE WHEN m.home_goals > m.away_goals THEN 0 WHEN m.home_goals = m.away_goals THEN 1 ELSE 2 END AS outcome
FROM matches m JOIN (SELECT 'alpha' AS model, 13 AS a, 7 AS b, 11 AS c UNION ALL SELECT 'beta', 17, 5, 3 UNION ALL SELECT 'gamma', 3, 11, 19) x ON m.status = 'FINISHED' AND m.disputed = 0"""

#: The same matches from three sources with shifted days and changed scores.
RECORDS = """
SELECT 'alpha' AS source, match_id AS source_key, league, season, home_team, away_team, match_date, CASE WHEN match_id % 3 <> 0 THEN kickoff END AS kickoff, CASE WHEN status = 'FINISHED' THEN home_goals END AS home_goals, CASE WHEN status = 'FINISHED' THEN away_goals END AS away_goals, status FROM matches
UNION ALL SELECT 'beta', match_id, league, season, home_team, away_team, CAST(match_date + CAST((match_id % 7) - 3 AS INT) * INTERVAL 1 DAY AS DATE), CASE WHEN match_id % 2 = 0 THEN kickoff + CAST(match_id % 50 AS INT) * INTERVAL 1 MINUTE END, CASE WHEN status = 'FINISHED' THEN CASE WHEN match_id % 50 = 0 THEN home_goals + 1 ELSE home_goals END END, CASE WHEN status = 'FINISHED' THEN away_goals END, status FROM matches WHERE match_id % 4 <> 3
UNION ALL SELECT 'gamma', match_id, league, season, home_team, away_team, match_date, NULL, NULL, NULL, 'SCHEDULED' FROM matches WHERE match_id % 5 = 0"""

VIEWS = {"matches": MATCHES, "prices": PRICES, "quotes": QUOTES, "ticks": TICKS, "forecasts": FORECASTS, "records": RECORDS}
BASE = ("orders", "lineitem", "events", "customer", "supplier", "part", "nation", "region")


#: Bytes of the larger table that a part of a join holds (some 300,000 rows), so that a task's rows do not grow with the tables.
PART_BYTES = 4 << 20


def parts(spark: SparkSession, path: str) -> int:
    """Number of parts for a table, by the length of its files; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return math.ceil((files.agg(F.sum("length")).first()[0] or 1) / PART_BYTES)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame; the views that it reads become its common table expressions.

    Prices come in parts by match, whose number grows with the table and is not merged at run time for being small in bytes:
    joins and aggregations by match keep to these parts. Quotes are prices spread over their selections in one pass.
    """
    if name == "quotes":
        each = F.explode(F.array(*(F.struct(F.lit(s).alias("selection"), F.col(f"odds_{s.lower()}").alias("odds")) for s in "HDA")))
        rows = view(spark, sf_dir, "prices").select("match_id", "book", "supplier", "seen_at", "snapshot", each.alias("q"))
        return rows.select("match_id", "book", "supplier", "seen_at", "snapshot", "q.*")
    text = with_views(f"SELECT * FROM {name}", name)
    used = [t for t in BASE if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    if "lineitem" in tables:
        n = max(parts(spark, f"{sf_dir}/lineitem.parquet"), int(spark.conf.get("spark.sql.shuffle.partitions")))
        tables |= {t: tables[t].repartition(n, key) for t, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"))}
    return spark.sql(text, **tables)


_NEEDS = {"prices": (), "matches": (), "quotes": ("prices",), "ticks": (), "forecasts": ("matches",), "records": ("matches",)}


def with_views(text: str, *names: str) -> str:
    """The SQL text, preceded by the named views and those that they read."""
    order: list[str] = []
    for name in names:
        order += [n for n in (*_NEEDS[name], name) if n not in order]
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order) + " " + text
