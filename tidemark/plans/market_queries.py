"""Queries on prices: visibility, consensus, margins, movement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import odds as O
from ..operators import market, pit
from ..sources.views import view
from .registry import Registry

R = Registry()
SELECTIONS = ("H", "D", "A")

_LATEST = "vis AS (SELECT p.*, m.kickoff FROM prices p JOIN matches m ON p.match_id = m.match_id WHERE seen_at <= m.kickoff - INTERVAL 1 HOUR), last AS (SELECT * FROM vis QUALIFY row_number() OVER (PARTITION BY match_id, book ORDER BY seen_at DESC, supplier DESC) = 1)"
_FAIR = "fair AS (SELECT *, (1/odds_h)/(1/odds_h+1/odds_d+1/odds_a) AS fh, (1/odds_d)/(1/odds_h+1/odds_d+1/odds_a) AS fd, (1/odds_a)/(1/odds_h+1/odds_d+1/odds_a) AS fa, 1/odds_h+1/odds_d+1/odds_a-1 AS margin FROM last)"


def last_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest quote of each match, book and selection an hour before kickoff, with that time as as_of.

    A book quotes all selections at once, so the latest row is picked before it is spread over its selections.
    """
    limits = view(spark, sf_dir, "matches").select("match_id", (F.col("kickoff") - F.expr("INTERVAL 1 HOUR")).alias("as_of"))
    rows = view(spark, sf_dir, "prices").select("match_id", "book", "supplier", "seen_at", "odds_h", "odds_d", "odds_a").join(limits, "match_id").where("seen_at <= as_of")
    last = pit.latest(rows, ["match_id", "book"], "seen_at", ["supplier"])
    quotes = F.explode(F.array(*(F.struct(F.lit(s).alias("selection"), F.col(f"odds_{s.lower()}").alias("odds")) for s in SELECTIONS)))
    return last.select("match_id", "as_of", "book", "seen_at", quotes.alias("q")).select("match_id", "as_of", "book", "seen_at", "q.*")


@R.add(
    "market_consensus",
    f"""SELECT * FROM (WITH {_LATEST}, {_FAIR},
    med AS (SELECT match_id, median(fh) mh, median(fd) md, median(fa) ma, count(*) n_books, median(margin) margin, max(odds_h) best_h, max(odds_d) best_d, max(odds_a) best_a, max(seen_at) newest, max(kickoff) kickoff,
      arg_min(book, (-odds_h, book)) book_h, arg_min(fh, (-odds_h, book)) bfh, arg_min(fd, (-odds_d, book)) bfd, arg_min(fa, (-odds_a, book)) bfa, arg_min(book, (-odds_d, book)) book_d, arg_min(book, (-odds_a, book)) book_a,
      CASE WHEN bool_or(book = 3) THEN 3 WHEN bool_or(book = 1) THEN 1 END sharp_book, coalesce(max(CASE WHEN book = 3 THEN fh END), max(CASE WHEN book = 1 THEN fh END)) sharp_h FROM fair GROUP BY match_id)
    SELECT match_id, round(mh/(mh+md+ma), 6) p_home, round(md/(mh+md+ma), 6) p_draw, round(ma/(mh+md+ma), 6) p_away, n_books, round(margin, 6) margin, best_h, best_d, best_a, book_h, sharp_book, round(sharp_h, 6) sharp_h,
      concat_ws(',', CASE WHEN epoch(kickoff - INTERVAL 1 HOUR - newest) / 3600 > 24 THEN 'STALE_ODDS' END, CASE WHEN n_books = 1 THEN 'SINGLE_BOOK' END,
        CASE WHEN n_books >= 3 AND abs(bfh - mh/(mh+md+ma)) > 0.06 THEN concat('OUTLIER_BEST_PRICE:H:', book_h) END, CASE WHEN n_books >= 3 AND abs(bfd - md/(mh+md+ma)) > 0.06 THEN concat('OUTLIER_BEST_PRICE:D:', book_d) END, CASE WHEN n_books >= 3 AND abs(bfa - ma/(mh+md+ma)) > 0.06 THEN concat('OUTLIER_BEST_PRICE:A:', book_a) END) flags
    FROM med) z""",
    ("matches", "prices"),
)
def market_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin-free consensus an hour before kickoff, with best price, number of books and flags."""
    keys = ["match_id", "as_of"]
    books = market.complete_books(last_quotes(spark, sf_dir), keys, "book", "selection", "odds", "seen_at", SELECTIONS, "multiplicative")
    out = market.consensus(books, keys, "book", SELECTIONS, F.col("as_of"), stale_hours=24, sharp=(3, 1))
    p, best = F.col("consensus"), F.col("best_odds")
    return out.select(
        "match_id", F.round(p[0], 6).alias("p_home"), F.round(p[1], 6).alias("p_draw"), F.round(p[2], 6).alias("p_away"), "n_books", F.round("margin_median", 6).alias("margin"),
        best[0].alias("best_h"), best[1].alias("best_d"), best[2].alias("best_a"), F.col("best_book")[0].alias("book_h"), "sharp_book", F.round(F.col("sharp")[0], 6).alias("sharp_h"), F.concat_ws(",", "flags").alias("flags"),
    )


@R.add(
    "market_missing",
    f"""SELECT * FROM (WITH {_LATEST}, q AS (SELECT match_id, book, (odds_h > 2.5)::INT + (odds_d > 2.5)::INT + (odds_a > 2.5)::INT k FROM last), b AS (SELECT match_id, max(k) k FROM q WHERE k > 0 GROUP BY match_id)
    SELECT m.match_id, CASE WHEN b.k IS NULL THEN 'NO_ODDS' ELSE 'INCOMPLETE_MARKET' END flag FROM matches m LEFT JOIN b ON m.match_id = b.match_id WHERE b.k IS NULL OR b.k < 3) z""",
    ("matches", "prices"),
)
def market_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets of outsiders' prices (above 2.5) that no book quotes in full an hour before kickoff."""
    latest = last_quotes(spark, sf_dir).where("odds > 2.5")
    books = market.complete_books(latest, ["match_id"], "book", "selection", "odds", "seen_at", SELECTIONS, "multiplicative")
    return market.missing(view(spark, sf_dir, "matches"), latest, books, ["match_id"])


_TRIPLES = "t AS (SELECT DISTINCT odds_h, odds_d, odds_a, 1/odds_h a, 1/odds_d b, 1/odds_a c FROM prices)"


@R.add(
    "margin_power",
    f"""SELECT * FROM (WITH RECURSIVE {_TRIPLES}, k(odds_h, odds_d, odds_a, a, b, c, i, lo, hi) AS (SELECT *, 0, 1.0::DOUBLE, 50.0::DOUBLE FROM t UNION ALL
      SELECT odds_h, odds_d, odds_a, a, b, c, i + 1, CASE WHEN pow(a, (lo+hi)/2) + pow(b, (lo+hi)/2) + pow(c, (lo+hi)/2) > 1 THEN (lo+hi)/2 ELSE lo END, CASE WHEN pow(a, (lo+hi)/2) + pow(b, (lo+hi)/2) + pow(c, (lo+hi)/2) > 1 THEN hi ELSE (lo+hi)/2 END FROM k WHERE i < 60)
    SELECT odds_h, odds_d, odds_a, round(pow(a, (lo+hi)/2) / (pow(a, (lo+hi)/2) + pow(b, (lo+hi)/2) + pow(c, (lo+hi)/2)), 6) p_home FROM k WHERE i = 60) z""",
    ("prices",),
)
def margin_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin removed by the power method, for every distinct triple of odds."""
    t = view(spark, sf_dir, "prices").select("odds_h", "odds_d", "odds_a").distinct()
    return t.select("odds_h", "odds_d", "odds_a", F.round(O.fair(F.array("odds_h", "odds_d", "odds_a"), "power")[0], 6).alias("p_home"))


@R.add(
    "margin_shin",
    f"""SELECT * FROM (WITH RECURSIVE {_TRIPLES}, k(odds_h, odds_d, odds_a, a, b, c, i, lo, hi) AS (SELECT *, 0, 0.0::DOUBLE, 0.999::DOUBLE FROM t UNION ALL
      SELECT odds_h, odds_d, odds_a, a, b, c, i + 1, CASE WHEN f > 1 THEN z ELSE lo END, CASE WHEN f > 1 THEN hi ELSE z END FROM (SELECT *, (sqrt(z*z + 4*(1-z)*a*a/(a+b+c)) + sqrt(z*z + 4*(1-z)*b*b/(a+b+c)) + sqrt(z*z + 4*(1-z)*c*c/(a+b+c)) - 3*z) / (2*(1-z)) f FROM (SELECT *, (lo+hi)/2 z FROM k WHERE i < 60) q) w),
    e AS (SELECT *, (lo+hi)/2 z FROM k WHERE i = 60)
    SELECT odds_h, odds_d, odds_a, round((sqrt(z*z + 4*(1-z)*a*a/(a+b+c)) - z) / (sqrt(z*z + 4*(1-z)*a*a/(a+b+c)) + sqrt(z*z + 4*(1-z)*b*b/(a+b+c)) + sqrt(z*z + 4*(1-z)*c*c/(a+b+c)) - 3*z), 6) p_home FROM e) y""",
    ("prices",),
)
def margin_shin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin removed by Shin's method."""
    t = view(spark, sf_dir, "prices").select("odds_h", "odds_d", "odds_a").distinct()
    return t.select("odds_h", "odds_d", "odds_a", F.round(O.fair(F.array("odds_h", "odds_d", "odds_a"), "shin")[0], 6).alias("p_home"))


@R.add(
    "margin_odds_ratio",
    f"""SELECT * FROM (WITH RECURSIVE {_TRIPLES}, k(odds_h, odds_d, odds_a, a, b, c, i, lo, hi) AS (SELECT *, 0, 1.0::DOUBLE, 100.0::DOUBLE FROM t UNION ALL
      SELECT odds_h, odds_d, odds_a, a, b, c, i + 1, CASE WHEN a/(m+a-m*a) + b/(m+b-m*b) + c/(m+c-m*c) > 1 THEN m ELSE lo END, CASE WHEN a/(m+a-m*a) + b/(m+b-m*b) + c/(m+c-m*c) > 1 THEN hi ELSE m END FROM (SELECT *, (lo+hi)/2 m FROM k WHERE i < 60) q),
    e AS (SELECT *, (lo+hi)/2 m FROM k WHERE i = 60)
    SELECT odds_h, odds_d, odds_a, round(a/(m+a-m*a) / (a/(m+a-m*a) + b/(m+b-m*b) + c/(m+c-m*c)), 6) p_home, round((a - (a+b+c-1)/3), 6) p_additive FROM e) y""",
    ("prices",),
)
def margin_odds_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin removed by a common odds ratio, and additively."""
    t = view(spark, sf_dir, "prices").select("odds_h", "odds_d", "odds_a").distinct()
    odds = F.array("odds_h", "odds_d", "odds_a")
    return t.select("odds_h", "odds_d", "odds_a", F.round(O.fair(odds, "odds_ratio")[0], 6).alias("p_home"), F.round(O.fair(odds, "additive")[0], 6).alias("p_additive"))


@R.add(
    "closing_value",
    """SELECT * FROM (WITH own AS (SELECT match_id, book, arg_max(odds_h, (seen_at, supplier)) o FROM prices WHERE snapshot = 'CLOSING' GROUP BY ALL), med AS (SELECT match_id, median(o) m FROM own GROUP BY match_id),
    taken AS (SELECT match_id, book, arg_max(odds_h, (seen_at, supplier)) o FROM prices WHERE snapshot = 'PRE_MATCH' GROUP BY ALL)
    SELECT t.match_id, t.book, t.o taken, round(coalesce(own.o, med.m), 6) closing, round(t.o / coalesce(own.o, med.m) - 1, 6) clv FROM taken t LEFT JOIN own ON t.match_id = own.match_id AND t.book = own.book LEFT JOIN med ON t.match_id = med.match_id) z""",
    ("prices",),
)
def closing_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of each price taken against the same book's closing price, else the median of all books."""
    p = view(spark, sf_dir, "prices").select("match_id", "book", "supplier", "seen_at", "snapshot", "odds_h")
    last = pit.latest(p, ["match_id", "book", "snapshot"], "seen_at", ["supplier"])
    own = last.where("snapshot = 'CLOSING'").select("match_id", "book", F.col("odds_h").alias("own"))
    med = own.groupBy("match_id").agg(F.median("own").alias("med"))
    out = last.where("snapshot = 'PRE_MATCH'").join(own, ["match_id", "book"], "left").join(med, "match_id", "left")
    closing = F.coalesce("own", "med")
    return out.select("match_id", "book", F.col("odds_h").alias("taken"), F.round(closing, 6).alias("closing"), F.round(O.clv_price(F.col("odds_h"), closing), 6).alias("clv"))
