"""One small test for each finding of the third round that held."""

import datetime as dt
import math

from oracle import differences, duck
from pyspark.sql import functions as F

from tidemark.operators import entity, market, models
from tidemark.plans import model_queries
from tidemark.plans.catalogue import ORACLES, QUERIES
from tidemark.sources import readers, views


def copies(spark, sf_dir, folder, n, **changed):
    """A folder with the order tables n times, keys shifted; changed: table to (rows -> rows)."""
    shifts = {"orders": {"o_orderkey": 10**6}, "lineitem": {"l_orderkey": 10**6}, "events": {"event_id": 10**6, "user_id": 10**5}}
    for t in ("region", "nation", "customer", "supplier", "part", *shifts):
        rows = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        if t in shifts:
            rows = rows.crossJoin(spark.range(n).withColumnRenamed("id", "__c"))
            rows = rows.withColumns({c: F.col(c) + F.col("__c") * by for c, by in shifts[t].items()}).drop("__c")
        changed.get(t, lambda x: x)(rows).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def duck_result(sf_dir, name):
    """The SQL's rows over the tables that the folder has."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    return con.execute(ORACLES[name]).df()


def test_market_movement_from_an_opening_of_zero(spark, sf_dir, tmp_path):
    """an opening of zero ended the query with DIVIDE_BY_ZERO."""
    T = dt.datetime(2024, 1, 1)
    ticks = spark.createDataFrame([("a", T, 0.0), ("a", T + dt.timedelta(hours=1), 2.0), ("b", T, 0.0), ("c", T, 2.0), ("c", T + dt.timedelta(hours=1), 3.0)], "k string, ts timestamp, v double")
    got = {r["k"]: r["moved"] for r in market.movement(ticks, ["k"], "ts", "v").collect()}
    assert got["a"] == math.inf and math.isnan(got["b"]) and got["c"] == 0.5
    where = copies(spark, sf_dir, tmp_path / "t", 1, events=lambda e: e.withColumn("value", F.when(F.col("user_id") % 3 == 0, 0.0).otherwise(F.col("value"))))
    assert not differences(QUERIES["market_movement"](spark, where).toPandas(), duck_result(where, "market_movement"))


def test_cooccurrence_where_opponents_play_several_times_a_day(spark, sf_dir, tmp_path):
    """a fixture that votes for several teams counted several times in the total, so a perfect match was AMBIGUOUS."""
    day = lambda i: dt.date(2024, 1, 1 + 3 * i)
    fixtures = spark.createDataFrame([(raw, "o", "H", day(i)) for raw in ("x", "y") for i in range(4)], "raw string, opponent_raw string, side string, match_date date")
    resolved = spark.createDataFrame([("o", 50)], "raw string, team int")
    met = lambda team, days: [(50, team, "A", day(i)) for i in days]
    got = lambda rows: {r["raw"]: (r["team"], r["votes"], r["total"], r["method"]) for r in entity.cooccurrence(fixtures.where("raw = 'x'"), resolved, spark.createDataFrame(rows, "team int, opponent int, side string, match_date date"), share=0.9).collect()}
    assert got(met(1, range(4)) + met(2, range(3)) + met(3, range(2))) == {"x": (1, 4, 4, "COOCCURRENCE")}
    assert got(met(1, range(4)) + met(2, range(4))) == {"x": (None, 4, 4, "AMBIGUOUS")}  # no way to tell them apart
    where = copies(spark, sf_dir, tmp_path / "t", 3, orders=lambda o: o.withColumn("o_orderdate", F.col("o_orderdate") - F.make_interval(days=F.dayofyear("o_orderdate") % 200)))
    assert not differences(QUERIES["entity_cooccurrence"](spark, where).toPandas(), duck_result(where, "entity_cooccurrence"))


def test_parts_of_prices_grow_with_their_table(spark, sf_dir, tmp_path, monkeypatch):
    """The number of tasks did not grow with the tables, so a task's rows did."""
    monkeypatch.setattr(views, "PART_BYTES", 8192)
    where = copies(spark, sf_dir, tmp_path / "t", 3)
    n = []
    for d in (sf_dir, where):
        views.view(spark, d, "prices").groupBy("match_id").count().write.parquet(f"{tmp_path}/{len(n)}")
        n.append(len(list((tmp_path / str(len(n))).glob("part-*.parquet"))))
    assert 4 < n[0] < n[1]
    assert not differences(QUERIES["reconcile_outcomes"](spark, where).toPandas(), duck_result(where, "reconcile_outcomes"))
    assert not differences(QUERIES["market_missing"](spark, where).toPandas(), duck_result(where, "market_missing"))


def test_a_fit_reads_sums_by_instant_and_pairing(spark, sf_dir):
    """fits read a row for every result and intervals were drawn for every fixture, alike ones too."""
    m = views.view(spark, sf_dir, "matches").where("status = 'FINISHED' AND disputed = 0 AND league = 0")
    many = m.crossJoin(spark.range(5)).withColumn("match_id", F.col("match_id") + F.col("id") * 10**6).drop("id")
    assert models.tallied(many).count() == models.tallied(m).count()
    rows = m.toPandas().sort_values("available_at")
    age = (rows["available_at"].max() - rows["available_at"]).dt.days.to_numpy(float)
    sums = models.tallied(m).toPandas().sort_values("available_at")
    teams, one, counts = models.Pairings(rows).fit(slice(None), age, models.Goals())
    again, two, counts2 = models.Pairings(sums).fit(slice(None), (sums["available_at"].max() - sums["available_at"]).dt.days.to_numpy(float), models.Goals())
    assert teams.tolist() == again.tolist() and counts.tolist() == counts2.tolist() and abs(one.theta - two.theta).max() < 1e-7 and abs(one.rho - two.rho) < 1e-7
    fixtures = many.select("match_id", "league", "home_team", "away_team", F.lit("1997-01-01").cast("timestamp_ntz").alias("cutoff")).cache()
    got = models.goal_intervals(m, fixtures, models.Goals(least=20)).toPandas()
    assert len(got) == 5 * fixtures.count() and got.assign(k=got["match_id"] % 10**6).groupby(["k", "market"])[["p", "low", "high", "sd"]].nunique().max().max() == 1


def test_wide_files_are_parsed_in_pieces(spark, tmp_path):
    """all cells of a file were held at once. A file of several pieces keeps its rows, their numbers and its encoding."""
    n = 2 * readers.ROWS + 5
    (tmp_path / "a.csv").write_bytes(("Div,HomeTeam,FTHG\r\n" + "".join(f'I1,"Málaga\n{i}",{i}\r\n' for i in range(n))).encode("cp1252"))
    (tmp_path / "b.csv").write_bytes(b"\n")
    rows = {(r["path"][-5:], r["row"]): r["cells"] for r in readers.seasonal_rows(spark, str(tmp_path)).collect()}
    assert len(rows) == n + 1 and rows["b.csv", 0] == {} and rows["a.csv", n - 1] == {"Div": "I1", "HomeTeam": f"Málaga\n{n - 1}", "FTHG": str(n - 1)}


def test_matrices_are_made_once_for_rates(spark, sf_dir):
    """a matrix was made for every match, though few rates occur."""
    seen = []
    out = model_queries.by_rates(spark, sf_dir, lambda r: seen.append(r.count()) or r.withColumn("x", F.col("lh") + F.col("la")))
    assert seen[0] <= 143 < out.count() and out.where("x <> lh + la").isEmpty()
    for name in ("report_top_scores", "slips"):
        assert not differences(QUERIES[name](spark, sf_dir).toPandas(), duck(sf_dir, ORACLES[name]))
