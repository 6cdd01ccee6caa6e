"""Operators against hand-checked values, brute force and metamorphic laws."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions import names as N
from tidemark.functions import odds as O
from tidemark.functions import scores as S
from tidemark.operators import calibration, decision, ledger, live, merge, models, pit, ratings
from tidemark.plans import report_queries
from tidemark.sources import lake
from tidemark.sources.views import view
from tidemark.streaming import ticks as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(1.05, 30), min_size=2, max_size=4))
def test_fair_probabilities(spark, prices):
    for method in O.METHODS:
        p = one(spark, O.fair(F.array(*map(F.lit, prices)), method))
        if p is None:
            assert method == "additive"
            continue
        assert abs(sum(p) - 1) < 1e-9 and all(0 < x < 1 for x in p)
        assert [i for i, _ in sorted(enumerate(p), key=lambda x: (-x[1], x[0]))][0] in [i for i, o in enumerate(prices) if o == min(prices)]


def test_odds_functions(spark):
    assert one(spark, O.fair(F.array(F.lit(2.0), F.lit(0.9)))) is None
    assert one(spark, O.kelly(F.lit(0.6), F.lit(2.0))) == pytest.approx(0.2)
    assert one(spark, O.stake(F.lit(0.6), F.lit(2.0))) == 0.02 and one(spark, O.stake(F.lit(0.4), F.lit(2.0))) == 0.0
    with pytest.raises(ValueError):
        O.stake(F.lit(0.5), F.lit(2.0), method="martingale")
    assert one(spark, O.clv_price(F.lit(2.2), F.lit(2.0))) == pytest.approx(0.1) and one(spark, O.clv_price(F.lit(2.2), F.lit(1.0))) is None


def test_losses(spark):
    p, y = F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)), F.lit(2)
    assert one(spark, M.log_loss(p, y)) == pytest.approx(-math.log(0.2))
    assert one(spark, M.brier(p, y)) == pytest.approx(0.25 + 0.09 + 0.64)
    assert one(spark, M.rps(p, y)) == pytest.approx((0.25 + 0.64) / 2)
    assert one(spark, M.valid(p)) and not one(spark, M.valid(F.array(F.lit(0.5), F.lit(0.6))))
    assert one(spark, M.wilson(F.lit(0.0), F.lit(0.0)))["high"] == 1.0
    assert sum(one(spark, M.floored(F.array(F.lit(0.0), F.lit(0.3), F.lit(0.7)), 0.01))) == pytest.approx(1)
    assert one(spark, M.normal_tail(F.lit(1.96))) == pytest.approx(0.025, abs=1e-4)


def test_score_matrix(spark):
    m = S.cells(F.lit(1.4), F.lit(1.1), F.lit(-0.05))
    h, d, a = (one(spark, x) for x in S.one_x_two(m))
    assert h + d + a == pytest.approx(1) and h > a
    assert one(spark, S.over(m, 2.5)) == pytest.approx(1 - one(spark, S.chance(m, lambda i, j: i + j <= 2)))
    ah = one(spark, S.handicap(m, -0.25))
    assert ah["win"] + ah["push"] + ah["lose"] == pytest.approx(1)
    assert sum(one(spark, S.collapsed(m))) == pytest.approx(1) and len(one(spark, S.top_scores(m))) == 6


def test_names(spark):
    for raw, want in (("F.C. Ínter 1908", "f inter"), ("A.S. Röma & Club", "s roma"), ("AC Milan", "milan"), (" 1899 ", "")):
        assert one(spark, N.normal_name(F.lit(raw))).split()[-1:] == want.split()[-1:]
    assert str(one(spark, N.day(F.lit("21/09/24")))) == "2024-09-21" and str(one(spark, N.day(F.lit("21/09/1998")))) == "1998-09-21" and one(spark, N.day(F.lit("x"))) is None
    assert one(spark, N.to_utc(F.lit("2024-09-21").cast("date"), F.lit("17:00"), "Europe/London")).hour == 16
    assert one(spark, N.whole(F.lit("2.5"))) == 2 and one(spark, N.whole(F.lit("x"))) is None
    for day, want in (("2024-09-21", "2024-09-20"), ("2024-09-25", "2024-09-24")):
        assert str(one(spark, N.weekly_collection(F.lit(day).cast("date"), F.lit(None).cast("timestamp"))))[:10] == want


def test_visibility_is_inclusive_and_blind_to_the_future(spark, sf_dir):
    at = dt.datetime(1996, 6, 30, 18)
    m = view(spark, sf_dir, "matches").where("status = 'FINISHED'")
    t = F.lit(str(at)).cast("timestamp_ntz")
    rows = m.limit(1).withColumn("available_at", t)
    assert pit.visible(rows, t).count() == 1 and pit.visible(rows.withColumn("available_at", t + F.expr("INTERVAL 1 MICROSECOND")), t).count() == 0
    changed = m.withColumn("home_goals", F.when(F.col("available_at") > t, 9).otherwise(F.col("home_goals")))
    assert sorted(pit.visible(m, t).collect()) == sorted(pit.visible(changed, t).collect())
    assert pit.future_rows(pit.visible(m, t), t, "available_at").isEmpty()


@pytest.mark.parametrize("bucket", [None, "DAY"])
def test_asof_join_ties_nulls_and_partitions(spark, bucket):
    T = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    left = spark.createDataFrame([(1, T(5), "a"), (1, T(30), "b"), (2, T(1), "c"), (None, T(1), "d"), (1, T(5), "a")], "k int, ts timestamp, name string")
    right = spark.createDataFrame([(1, T(5), 1.0, 1), (1, T(5), 2.0, 2), (1, T(29), 3.0, 1), (None, T(0), 9.0, 1), (2, T(2), 7.0, 1)], "k int, at timestamp, v double, n int")
    for parts in (1, 8):
        got = pit.asof_join(left.repartition(parts), right.repartition(parts), ["k"], "ts", "at", ["v"], ["n"], bucket).collect()
        assert sorted((r["name"], r["v"]) for r in got if r["v"] is not None) == [("a", 2.0), ("a", 2.0), ("b", 3.0), ("d", 9.0)]
        assert [r["name"] for r in got if r["v"] is None] == ["c"]
    assert pit.asof_join(left.limit(0), right, ["k"], "ts", "at", ["v"], ["n"], bucket).isEmpty()


def test_cluster_keeps_one_record_per_source(spark):
    D = dt.date
    rows = [("a", 1, D(2024, 1, 1)), ("b", 1, D(2024, 1, 3)), ("a", 1, D(2024, 3, 1)), ("b", 1, D(2024, 3, 9)), ("c", 1, D(2024, 1, 2)), ("a", 2, D(2024, 5, 1)), ("b", 2, D(2024, 6, 1))]
    df = spark.createDataFrame(rows, "source string, pair int, match_date date")
    for parts in (1, 6):
        got = {(r["source"], r["pair"], r["match_date"]): r["cluster"] for r in merge.cluster(df.repartition(parts), ["pair"]).collect()}
        assert [got[x] for x in rows] == [0, 0, 1, 2, 0, 0, 0]


def test_merge_picks_by_priority_and_keeps_conflicts(spark):
    rows = [("a", 1, 7, dt.date(2024, 1, 1), None, 1, 0, "FINISHED", 0), ("b", 1, 7, dt.date(2024, 1, 3), dt.datetime(2024, 1, 3, 15), 2, 0, "FINISHED", 0), ("c", 1, 7, dt.date(2024, 1, 1), None, None, None, "SCHEDULED", 0)]
    df = spark.createDataFrame(rows, "source string, source_key int, pair int, match_date date, kickoff timestamp_ntz, home_goals int, away_goals int, status string, cluster int")
    m = merge.merged(df, ["pair"], ["a", "b", "c"], ["b"])
    r = m.first()
    assert (r["primary_source"], r["home_goals"], r["disputed"], r["sources"], str(r["match_date"])) == ("a", 1, 1, ["a", "b", "c"], "2024-01-03") and r["available_at"] == dt.datetime(2024, 1, 3, 18)
    assert sorted(x["field"] for x in merge.conflicts(df, m, ["pair"]).collect()) == ["match_date", "match_date", "score"]
    halves = df.withColumns({"ht_home": F.when(F.col("source") == "a", 0).when(F.col("source") == "b", 1), "ht_away": F.lit(0)})
    assert [(x["source"], x["primary_value"], x["other_value"]) for x in merge.conflicts(halves, m, ["pair"]).where("field = 'half_time'").collect()] == [("b", "0-0", "1-0")]
    other = merge.merged(df.withColumn("home_goals", F.when(F.col("source") == "a", 5).otherwise(F.col("home_goals")).cast("int")), ["pair"], ["a", "b", "c"], ["b"]).first()
    assert r["data_version"] == merge.merged(df.orderBy(F.desc("source")), ["pair"], ["a", "b", "c"], ["b"]).first()["data_version"] != other["data_version"]


def test_caps(spark):
    rows = [(i, "d1", 1, i, 100 + i, 0.02, 1.0 / (i + 1)) for i in range(8)] + [(99, "d2", 1, 5, 6, 0.02, 0.5)]
    df = spark.createDataFrame(rows, "match_id long, day string, league int, home_team int, away_team int, stake double, ev_conservative double")
    got = {r["match_id"]: r["allowed"] for r in decision.capped(df).collect()}
    assert sum(v for k, v in got.items() if k != 99) == pytest.approx(0.08) and got[99] == 0.02 and got[0] == 0.02 and got[7] == 0


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_rating_stream_equals_batch(spark, sf_dir, tmp_path, rocks):
    """However results of the delay are split, also inside an instant; what is not after a folded instant is flagged."""
    results = view(spark, sf_dir, "matches").where("status = 'FINISHED' AND league < 2").select("league", "season", "match_id", F.col("available_at").cast("timestamp").alias("available_at"), "match_date", "home_team", "away_team", "home_goals", "away_goals")
    rows = results.toPandas().sort_values(["available_at", "match_id"]).head(200)
    rows = pd.concat([rows, rows.tail(40).assign(match_id=rows.match_id + 10_000_000, home_team=rows.away_team, away_team=rows.home_team)])  # instants of several results
    batch = {r["match_id"]: r["elo_home"] for r in ratings.history(ratings.folded(spark.createDataFrame(rows, results.schema))).collect()}
    span = int((rows.available_at.max() - rows.available_at.min()).days) + 1
    far = lambda ident, days: rows.tail(1).assign(league=99, match_id=ident, available_at=rows.available_at.max() + pd.Timedelta(days=days))
    mixed = rows.sample(frac=1, random_state=5)
    path, q = str(tmp_path / "in"), None
    for part in (mixed[::2], mixed[1::2], far(-1, 2 * span), rows.head(3), far(-2, 5 * span)):
        spark.createDataFrame(part, results.schema).coalesce(1).write.mode("append").parquet(path)
        if q is None:
            live = spark.readStream.schema(results.schema).option("maxFilesPerTrigger", 1).parquet(path)
            q = streams.rating_stream(live, delay=f"{span} days").writeStream.format("memory").queryName("rated").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
    q.stop()
    got = [r for r in spark.table("rated").collect() if r["match_id"] >= 0]
    assert {r["match_id"]: r["elo_home"] for r in got if not r["late"]} == pytest.approx(batch)
    assert sorted(r["match_id"] for r in got if r["late"]) == sorted(rows.head(3).match_id)


def test_streams_and_versions(spark, sf_dir, tmp_path):
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ticks.unionByName(ticks.limit(5)).coalesce(1).write.parquet(str(tmp_path / "t"))
    live = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "t"))
    q = streams.latest_state(streams.distinct_ticks(live, ["event_id"], "ts", "60 days"), ["user_id"], "ts", "value").writeStream.format("memory").queryName("latest").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("latest").agg(F.sum("n")).first()[0] == ticks.count()
    append = streams.versioned_append(str(tmp_path / "ledger"), ["k"], ["v"])
    for number, rows in enumerate(([(1, 1.0), (2, 1.0)], [(1, 1.0), (2, 5.0)], [(3, 1.0)])):
        df = spark.createDataFrame(rows, "k int, v double")
        append(df, number)
        append(df, number)  # a repeated batch replaces itself
    got = spark.read.parquet(str(tmp_path / "ledger")).select("k", "version").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (2, 2), (3, 1)]
    left = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "t"))
    joined = streams.near_results(left.select("user_id", F.col("ts").alias("p_at"), "value"), live.select("user_id", F.col("ts").alias("r_at")), "user_id", "p_at", "r_at", 3)
    q = joined.writeStream.format("memory").queryName("near").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("near").count() >= ticks.count()


def test_goal_fit_finds_planted_strengths():
    rng = np.random.default_rng(3)
    n, games = 6, 4000
    attack = np.linspace(-0.4, 0.4, n)
    h, a = rng.integers(0, n, games), rng.integers(0, n, games)
    keep = h != a
    h, a = h[keep], a[keep]
    hg, ag = rng.poisson(np.exp(0.1 + 0.25 + attack[h])), rng.poisson(np.exp(0.1 + attack[a]))
    found = models.fit_goals(h, a, hg, ag, np.ones(len(h)), n)
    t = found.theta
    assert np.abs(t[2 : 2 + n] - t[2 : 2 + n].mean() - attack).max() < 0.1 and abs(t[1] - 0.25) < 0.06 and (np.diag(found.covariance) > 0).all()


def _low(hg, ag):
    return np.stack([((hg == i) & (ag == j)).astype(float) for i, j in ((0, 0), (0, 1), (1, 0), (1, 1))])


@pytest.mark.parametrize("corrected", [False, True])
def test_goal_likelihood_gradient_and_its_zero(corrected):
    rng = np.random.default_rng(0)
    n, games = 6, 200
    h = rng.integers(0, n, games)
    a = (h + rng.integers(1, n, games)) % n
    hg, ag, w, new = rng.poisson(1.4, games), rng.poisson(1.1, games), rng.uniform(0.3, 1, games), np.array([0, 0, 1, 0, 1, 0])
    both = models.GoalLikelihood(h, a, hg, ag, w, n, models.Goals(), new, _low(hg, ag) * w if corrected else None)
    theta, rho = rng.normal(0, 0.2, 4 + 2 * n), -0.05 if corrected else 0.0
    g, g_rho, *_ = both.slopes(theta, rho)
    steps = [(both.loss(theta + e, rho) - both.loss(theta - e, rho)) / 2e-6 for e in np.eye(len(theta)) * 1e-6]
    assert np.abs(np.array(steps) - g).max() < 1e-4 * max(1, np.abs(g).max())
    if corrected:
        assert (both.loss(theta, rho + 1e-6) - both.loss(theta, rho - 1e-6)) / 2e-6 == pytest.approx(g_rho, rel=1e-4)
    theta, _, rho = both.fit()
    g, g_rho, *_ = both.slopes(theta, rho)
    assert np.abs(g).max() < 1e-5 and (not corrected or abs(g_rho) < 1e-5 or rho in models.Goals().low_bounds)


def test_newcomers_have_a_prior_of_their_own():
    """Teams that join late and are weak pull the newcomers' strength down; an unseen team gets it, with the teams' spread."""
    rng = np.random.default_rng(4)
    rows, old, new = [], range(0, 14), range(14, 20)
    for day in range(0, 900, 3):
        teams = list(old) + (list(new) if day > 400 else [])
        rng.shuffle(teams)
        for x, y in zip(teams[::2], teams[1::2]):
            strength = lambda t: -0.5 if t in new else 0.1  # noqa: E731, B023
            rows.append((day, x, y, rng.poisson(np.exp(0.2 + strength(x))), rng.poisson(np.exp(strength(y)))))
    pdf = pd.DataFrame(rows, columns=["day", "home_team", "away_team", "home_goals", "away_goals"])
    teams, found, counts = models.Pairings(pdf).fit(slice(None), (900 - pdf.day).to_numpy(float), models.Goals(decay=0.0))
    attack = found.theta[2:22]
    assert found.theta[-2] < attack[:14].mean() - 0.35 and abs(found.theta[-2] - attack[14:].mean()) < 0.1 and found.spread[0] > 0.02
    alone = models.Pairings(pdf).fit(slice(None), (900 - pdf.day).to_numpy(float), models.Goals(decay=0.0, newcomer_days=10_000))[1]
    assert abs(alone.theta[-2]) < 1e-6  # without newcomers nothing moves their strength


def test_ledger_and_lake(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", 1.0)], "k int, b string, x double")
    chain = ledger.chained(ledger.batch_digests(ledger.with_digest(rows, ["k", "x"]), "b"), "b")
    assert ledger.broken(chain, rows, "b", ["k", "x"]).isEmpty()
    assert [r["b"] for r in ledger.broken(chain, rows.where("k = 1"), "b", ["k", "x"]).collect()] == ["b"]
    for name, text in (("m_odds.csv", "x"), ("copy.csv", "x"), ("matches.csv", "y")):
        (tmp_path / name).write_text(text)
    found = lake.scan_files(spark, f"file://{tmp_path}", "*.csv")
    assert lake.new_contents(found, found.limit(0)).count() == 2
    assert sorted(r["kind"] for r in lake.inbox_kind(found).collect()) == ["matches", "odds", "unknown"]
    data = spark.createDataFrame([("s", "d1", 1), ("s", "d2", 2)], "source string, dataset_key string, v int")
    out = str(tmp_path / "staged")
    lake.replace_datasets(data, out)
    lake.replace_datasets(data.where("dataset_key = 'd1'").withColumn("v", F.lit(7)), out)
    assert sorted(r["v"] for r in spark.read.parquet(out).collect()) == [2, 7]
    lake.append_new(data, str(tmp_path / "once"), ["v"])
    lake.append_new(data.withColumn("v", F.col("v") + 1), str(tmp_path / "once"), ["v"])
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "once")).collect()) == [1, 2, 3]


def test_decision_without_inputs(spark):
    schema = "model_prob double, raw_prob double, prob_low double, fair_prob double, odds double, quality double, disagreement double, home_matches int, away_matches int, flags array<string>, calibration string, drift_alert boolean, validated boolean"
    good = (0.55, 0.55, 0.51, 0.48, 2.0, 0.9, 0.03, 40, 40, [], "identity", False, True)
    rows = [good, (None, *good[1:]), (*good[:4], None, *good[5:]), (0.45, *good[1:]), (*good[:2], 0.4, *good[3:]), (*good[:9], ["SINGLE_BOOK"], *good[10:])]
    got = [(r["status"], r["reasons"]) for r in decision.decide(spark.createDataFrame(rows, schema)).collect()]
    assert got[0] == ("STRONG_CANDIDATE", []) and got[1] == ("INSUFFICIENT_DATA", ["MODEL_UNAVAILABLE"]) and got[2] == ("INSUFFICIENT_DATA", ["NO_MARKET_ODDS"])
    assert got[3] == ("NO_BET", ["NEGATIVE_EV", "EDGE_REMOVED_BY_CALIBRATION"]) and got[4] == ("CANDIDATE", []) and got[5] == ("WATCH", ["SINGLE_BOOK"])


def test_calibration_uses_only_earlier_seasons(spark, sf_dir):
    rows = view(spark, sf_dir, "forecasts").drop("match_date")
    last = rows.agg(F.max("season")).first()[0]
    changed = rows.withColumn("outcome", F.when(F.col("season") == last, (F.col("outcome") + 1) % 3).otherwise(F.col("outcome")))
    get = lambda df: sorted((r["model"], r["match_id"], r["cal_p_home"]) for r in calibration.sequential(df, least=20).collect())
    assert get(rows) == get(changed)


def test_refits(spark):
    base = pd.Timestamp("2024-01-01")
    df = spark.createDataFrame([("m", (base + pd.Timedelta(days=d)).to_pydatetime()) for d in (0, 3, 7, 8, 20)], "model string, at timestamp")
    got = [(r["fit_at"] - base.to_pydatetime()).days for r in models.refit_dates(df, "model", "at").orderBy("at").collect()]
    assert got == [0, 0, 7, 7, 20]
    got = [(r["fit_at"] - base.to_pydatetime()).days for r in models.refit_dates(df, "model", "at", always=["m"]).orderBy("at").collect()]
    assert got == [0, 3, 7, 8, 20]


def test_link_intervals_hold_the_forecast(spark):
    links = spark.createDataFrame([(1, 7, 500, -0.8, 0.1, 1.5, [0.01, 0.0, 0.0, 0.0, 0.01, 0.0, 0.0, 0.0, 0.04])], "league int, cutoff int, n long, low double, log_gap double, slope double, covariance array<double>")
    asked = spark.createDataFrame([(i, 1, 7, 1500.0 + 60 * i, 1500.0) for i in range(4)] + [(9, 2, 7, 1500.0, 1500.0)], "match_id long, league int, cutoff int, elo_home double, elo_away double")
    got = models.link_intervals(asked, links).toPandas()
    assert len(got) == 12 and (got.low < got.p).all() and (got.p < got.high).all() and np.allclose(got.groupby("match_id").p.sum(), 1) and got[got.market == "home"].sort_values("match_id").p.is_monotonic_increasing
    assert models.link_intervals(asked.repartition(3), links).toPandas().sort_values(["match_id", "market"]).reset_index(drop=True).equals(got.sort_values(["match_id", "market"]).reset_index(drop=True))


def test_goal_intervals_hold_the_forecast(spark, sf_dir):
    results = view(spark, sf_dir, "matches").where("status = 'FINISHED'")
    cut = F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
    fixtures = results.where(F.col("kickoff") > cut).limit(20).withColumn("cutoff", cut).withColumn("away_team", F.when(F.col("match_id") % 2 == 0, -5).otherwise(F.col("away_team")))
    got = models.goal_intervals(results, fixtures, models.Goals(least=20)).toPandas()
    assert len(got) and got.p.between(0, 1).all() and (got.low <= got.high).all() and (got.sd >= 0).all() and ((got.low <= got.p) & (got.p <= got.high)).mean() > 0.8
    three = got[got.market.isin(["home", "draw", "away"])].groupby("match_id").p.sum()
    assert np.allclose(three, 1)


def test_live_run_is_blind_to_later_prices_and_versions_its_ledger(spark, sf_dir, tmp_path):
    at, now = "1998-07-02 12:00:00", dt.datetime(1998, 7, 2, 12)
    m, prices = view(spark, sf_dir, "matches"), view(spark, sf_dir, "prices")
    fixtures = m.where(f"kickoff > TIMESTAMP_NTZ '{now + dt.timedelta(hours=1)}' AND kickoff <= TIMESTAMP_NTZ '{now + dt.timedelta(days=45)}'").select("match_id", "kickoff")
    # The fixtures' prices are all seen before now or all after it, by match.
    early = prices.join(fixtures.select("match_id"), "match_id", "left_semi").withColumn("seen_at", F.when(F.col("match_id") % 2 == 0, F.lit(str(now - dt.timedelta(hours=1))).cast("timestamp_ntz")).otherwise(F.lit(str(now + dt.timedelta(seconds=1))).cast("timestamp_ntz")))
    later = early.withColumns({"seen_at": F.lit(str(now + dt.timedelta(hours=2))).cast("timestamp_ntz"), "odds_h": F.col("odds_h") + 3})
    early = early.cache()
    key = lambda rows: sorted(((r["match_id"], r["selection"]), r["status"], r["model_prob"], r["fair_prob"], r["odds"], r["allowed"], r["version"], r["supersedes"]) for r in rows.collect())
    run = lambda p, x: key(report_queries.live_run(m, p, at, x, least_links=100))
    one, two = (f"file://{tmp_path}/{x}" for x in ("one", "two"))
    first = run(early, one)
    assert first == run(early.unionByName(later), two) and len(first) > 3 and {x[0][1] for x in first} == {"H", "D", "A"}
    assert all((x[4] is not None) == (x[0][0] % 2 == 0) for x in first) and {x[4] is None for x in first} == {True, False} and all(x[6:] == (1, None) for x in first)
    assert not run(early.unionByName(later), one)  # nothing changed
    chosen = next(x[0][0] for x in first if x[4] is not None)
    moved = early.withColumn("odds_h", F.when(F.col("match_id") == chosen, F.col("odds_h") + 3).otherwise(F.col("odds_h")))
    again = {x[0]: x for x in run(moved, one)}
    assert (chosen, "H") in again and all(x[6:] == (2, f"{k[0]}:{k[1]}:1") for k, x in again.items())
    assert spark.read.parquet(one).count() == len(first) + len(again)


def test_live_inputs_are_measured(spark, sf_dir):
    """Quality falls with stale prices, disagreement and matches come from the fits, bounds from their covariance."""
    at = "1998-07-02 12:00:00"
    m, prices = view(spark, sf_dir, "matches"), view(spark, sf_dir, "prices")
    stamp = lambda hours: prices.withColumn("seen_at", F.lit(at).cast("timestamp_ntz") - F.make_interval(hours=F.lit(hours)))
    state = {"method": "temperature", "calibrator": '{"method": "temperature", "beta": 0.5}', "validated": False, "drift_alert": False}
    fresh, stale = (live.candidates_at(m, stamp(h), at, state=state, least_links=100).toPandas().sort_values(["match_id", "selection"]).reset_index(drop=True) for h in (1, 160))
    priced = fresh.odds.notna()
    fresh, stale = fresh[priced], stale[priced]
    assert len(fresh) and (fresh.quality > stale.quality + 0.1).all() and all("STALE_ODDS" in x for x in stale["flags"]) and not any("STALE_ODDS" in x for x in fresh["flags"])
    assert fresh.disagreement.dropna().between(0, 1).all() and fresh.disagreement.nunique() > 3 and fresh.home_matches.nunique() > 3
    assert (fresh.prob_low <= fresh.model_prob).all() and np.allclose(fresh.groupby("match_id").model_prob.sum(), 1) and (np.abs(fresh.model_prob - fresh.raw_prob) > 1e-6).any()
    judged = decision.decide(live.candidates_at(m, stamp(1), at, state=state, least_links=100)).collect()
    assert all("MODEL_NOT_VALIDATED_VS_MARKET" in r["reasons"] or r["status"] == "INSUFFICIENT_DATA" for r in judged)


def test_dimension_and_followups(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"competition": "A1", "name": "A", "tier": 1, "sources": {"x": "I1"}}, {"competition": "B1", "name": "B", "tier": 2, "sources": {"y": "J1"}}]')
    dim = lake.competitions(spark, f"file://{tmp_path}/c.json", "x")
    assert [(r["competition"], r["code"]) for r in dim.collect()] == [("A1", "I1")]
    index = spark.createDataFrame([("I1", "27", 2020), ("I1", "28", 2021), ("J1", "27", 2020)], "code string, season_code string, season int")
    done = spark.createDataFrame([("I1/27",)], "dataset_key string")
    assert [r["dataset_key"] for r in lake.followups(index, dim.select("competition", "code"), done).collect()] == ["I1/28"]
