"""Access rules, local sources, lake, name resolution and small functions on hand-made rows."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.functions import names as N
from tidemark.functions import odds as O
from tidemark.functions import scores as S
from tidemark.operators import decision, entity, evaluate, ledger, market, models, pit, ratings, registry, reports
from tidemark.plans import model_queries
from tidemark.sources import lake, readers
from tidemark.sources.views import view


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_consensus_leaves_aggregates_out_and_finds_the_sharp_book(spark):
    assert set(readers.BOOKS.values()) >= {*market.SHARP, *market.AGGREGATES}
    prices = {"bet365": (2.0, 3.4, 4.0), "pinnacle": (2.1, 3.5, 3.9), "betfair_exchange": (2.2, 3.6, 4.1), "agg_max": (9.0, 9.0, 9.0)}
    rows = [(1, b, s, o, dt.datetime(2024, 1, 1)) for b, q in prices.items() for s, o in zip("HDA", q, strict=True)]
    rows += [(2, "bet365", "H", 2.0, dt.datetime(2024, 1, 1))]
    latest = spark.createDataFrame(rows, "m int, book string, s string, odds double, seen timestamp")
    books = market.complete_books(latest, ["m"], "book", "s", "odds", "seen", ["H", "D", "A"], "multiplicative")
    out = market.consensus(books, ["m"], "book", ["H", "D", "A"]).collect()
    assert len(out) == 1 and out[0]["n_books"] == 3 and out[0]["best_odds"] == [2.2, 3.6, 4.1] and out[0]["sharp_book"] == "pinnacle" and sum(out[0]["sharp"]) == pytest.approx(1)
    asked = spark.createDataFrame([(1,), (2,), (3,)], "m int")
    assert {r["m"]: r["flag"] for r in market.missing(asked, latest, books, ["m"]).collect()} == {2: "INCOMPLETE_MARKET", 3: "NO_ODDS"}


def test_date_only_decisions_are_local(spark):
    m = spark.createDataFrame([(1, None, dt.date(2024, 7, 6)), (2, None, dt.date(2024, 7, 6)), (3, dt.datetime(2024, 7, 6, 18), dt.date(2024, 7, 6))], "m int, kickoff timestamp_ntz, day date")
    ticks = spark.createDataFrame([(1, dt.datetime(2024, 7, 6, 9, 30)), (1, dt.datetime(2024, 7, 6, 10, 30)), (3, dt.datetime(2024, 7, 6, 17, 30))], "m int, seen timestamp_ntz")
    got = {r["m"]: (r["decision_at"], r["policy"]) for r in pit.decision_times(m, ticks, "m", "kickoff", "seen", 1, "day", "Europe/Rome").collect()}
    assert got == {1: (dt.datetime(2024, 7, 6, 9, 30), "LAST_TICK_BEFORE_NOON"), 2: (dt.datetime(2024, 7, 5, 22), "DATE_ONLY"), 3: (dt.datetime(2024, 7, 6, 17), "LEAD")}


def test_holdout_overdue_and_cutoffs(spark, sf_dir):
    m = view(spark, sf_dir, "matches")
    with pytest.raises(ValueError):
        pit.clip_holdout(m, "match_date", None)
    assert pit.clip_holdout(m, "match_date", "1996-01-01", asked=True).count() == m.count()
    assert pit.clip_holdout(m, "match_date", "1996-01-01").where("match_date >= '1996-01-01'").isEmpty()
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), dt.date(2024, 1, 1), None), (2, dt.datetime(2024, 1, 1), dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 3)), (3, None, dt.date(2024, 1, 1), None), (4, dt.datetime(2024, 1, 1, 23), dt.date(2024, 1, 1), None)], "m int, kickoff timestamp, day date, seen timestamp")
    assert {r["m"] for r in pit.overdue(rows, now, "kickoff", "day", "seen").collect()} == {1, 3}
    bad = spark.createDataFrame([(1, 1, 2, 3), (2, 3, 2, 3), (3, 1, 4, 3)], "m int, cut int, predicted int, kickoff int")
    assert {r["m"] for r in pit.cutoff_violations(bad, ["cut"], "predicted", "kickoff").collect()} == {2, 3}


def test_forecasts_are_blind_to_the_future(spark, sf_dir):
    """Changing every result after a cutoff changes no fit and no rating before it."""
    m = view(spark, sf_dir, "matches").where("status = 'FINISHED'")
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    changed = m.withColumn("home_goals", F.when(F.col("available_at") > cut, 9).otherwise(F.col("home_goals")).cast("int"))
    cutoffs = m.select("league").distinct().withColumn("cutoff", cut)
    show = lambda df: sorted(map(str, df.collect()))
    small = models.Goals(least=5)
    assert show(models.goal_fits(m, cutoffs, small)) == show(models.goal_fits(changed, cutoffs, small)) != []
    before = lambda df: show(df.where(F.col("available_at") <= cut))
    a, b = (ratings.history(ratings.folded(x)) for x in (m, changed))
    assert before(a) == before(b) and show(a) != show(b)
    fits = lambda h, r: show(models.link_fits(h, r, cutoffs, least=20))
    assert fits(a, m) == fits(b, changed)


def test_fingerprint_is_of_a_multiset(spark):
    """Order changes nothing; a repeated row, a null for an empty text and a moved separator do, in the running form too."""
    schema = "k int, a string, b string, at int"
    base = [(1, "x", "y", 1), (2, "", "z", 2), (3, "p|q", "r", 3)]
    show = lambda rows: pit.fingerprint(spark.createDataFrame(rows, schema), ["k", "a", "b"]).first()["fingerprint"]
    others = [[*base, base[0]], [*base, base[0], base[0]], [base[0], (2, None, "z", 2), base[2]], [*base[:2], (3, "p", "q|r", 3)], base[:2], []]
    assert show(base) == show(base[::-1]) and len({show(x) for x in [base, *others]}) == 7
    run = lambda rows: {r["at"]: (r["n"], r["fingerprint"]) for r in pit.running_fingerprint(spark.createDataFrame(rows, schema), ["k", "a", "b"], "at", []).collect()}
    for rows in (base, [*base, base[1]]):
        assert run(rows) == {t: (len(x := [r for r in rows if r[3] <= t]), show(x)) for t in (1, 2, 3)}


def test_student_tails(spark):
    """Against Simpson's rule on the density."""
    def tail(t: float, df: float) -> float:
        n = 20001
        x = np.linspace(0, t, n)
        w = np.where(np.arange(n) % 2, 4, 2)
        w[[0, -1]] = 1
        return 0.5 - (x[1] - x[0]) / 3 * (w * (1 + x * x / df) ** (-(df + 1) / 2)).sum() * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    rows = [(t, float(d)) for d in (1, 2, 5, 37.5, 400, 2000) for t in (0.1, 0.7, 2.0, 4.0)]
    got = spark.createDataFrame(rows, "t double, df double").select("t", "df", M.t_tail(F.col("t"), F.col("df")).alias("p"), M.t_tail(-F.col("t"), F.col("df")).alias("q")).collect()
    assert all(r["p"] == pytest.approx(tail(r["t"], r["df"]), abs=1e-9) and r["p"] + r["q"] == pytest.approx(1) for r in got)
    assert one(spark, M.t_tail(F.lit(0.0), F.lit(3))) == pytest.approx(0.5)


def test_walk_forward_is_blind_to_the_future(spark, sf_dir):
    """No result after a forecast's cutoff reaches it, in any of the models, also where matches share an instant; earlier ones do."""
    one_day = view(spark, sf_dir, "matches").where("status = 'FINISHED' AND disputed = 0 AND league < 2 AND season < 1995")
    again = one_day.withColumns({"match_id": F.col("match_id") + 10**7, "home_team": F.col("away_team"), "away_team": F.col("home_team")})  # a second match of both teams that day
    m = one_day.unionByName(again).cache()
    fixtures = model_queries.fixtures_of(m).cache()
    odd = fixtures.groupBy("league").agg(F.percentile_approx("cutoff", 0.5).alias("cut"))
    hit = m.join(odd, "league").where("available_at > cut")
    assert fixtures.where("cutoff >= kickoff").isEmpty()
    changed = m.join(odd, "league").withColumn("home_goals", F.when(F.col("available_at") > F.col("cut"), 9).otherwise(F.col("home_goals")).cast("int")).select(*m.columns)
    asked = fixtures.join(odd, "league").where("cutoff <= cut").drop("cut").cache()
    small = {"goals": models.Goals(least=20)}
    show = lambda r, x: {(q["model"], q["match_id"]): tuple(q[p] for p in model_queries.PROBABILITIES) for q in model_queries.forecast_models(r, x, goals=small, least_links=20).collect()}
    a, b = show(m, asked), show(changed, asked)
    assert hit.count() > 20 and {k[0] for k in a} == {"elo", "climatology", "goals"} and a == b
    assert show(m, fixtures) != show(changed, fixtures)


def test_cutoffs_share_groups_but_not_rows(spark, sf_dir):
    """A fit by bucket is the fit of its own window, whichever cutoffs share its group."""
    m = view(spark, sf_dir, "matches").where("status = 'FINISHED' AND league = 1")
    days = [dt.datetime(1996, 1, 1) + dt.timedelta(days=9 * i) for i in range(60)]
    many = spark.createDataFrame([(1, d) for d in days], "league int, cutoff timestamp_ntz")
    few = many.where(F.col("cutoff") == days[31])
    pick = lambda df: sorted(map(str, df.where(F.col("cutoff") == days[31]).collect()))
    assert pick(models.goal_fits(m, many, models.Goals(least=5))) == pick(models.goal_fits(m, few, models.Goals(least=5))) != []


def test_resolution_run(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    meetings = [(f"t{a}", f"t{b}", day(7 * k + a)) for k, (a, b) in enumerate((a, b) for a in range(6) for b in range(6) if a != b)]
    reference = spark.createDataFrame([(h, a, "H", d) for h, a, d in meetings] + [(a, h, "A", d) for h, a, d in meetings], "team string, opponent string, side string, match_date date")
    raw = lambda t: f"raw {t}"
    fixtures = spark.createDataFrame([(raw(h), raw(a), "H", d) for h, a, d in meetings] + [(raw(a), raw(h), "A", d) for h, a, d in meetings], "raw string, opponent_raw string, side string, match_date date")
    known = spark.createDataFrame([(raw("t0"), "t0"), (raw("t1"), "t1")], "raw string, team string")
    resolved, review = entity.resolution_run(fixtures, known, reference, least=2, share=0.9)
    got = {r["raw"]: (r["team"], r["round"]) for r in resolved.collect()}
    assert {k: t for k, (t, _) in got.items()} == {raw(f"t{i}"): f"t{i}" for i in range(6)} and {n for _, n in got.values()} >= {0, 1} and review.isEmpty()
    twice = known.unionByName(spark.createDataFrame([("other", "t0")], "raw string, team string"))
    resolved, review = entity.resolution_run(fixtures, twice, reference, rounds=1, least=99)
    assert "t0" not in {r["team"] for r in resolved.collect()} and {r["reason"] for r in review.collect()} == {"AMBIGUOUS", "SHARED_TEAM"}
    assert all(len(r["candidates"]) <= 5 for r in review.collect())


def test_lake_bookkeeping(spark):
    m = spark.createDataFrame([("p", "k", "a", 1), ("p", "k", "b", 2), ("p", "l", "c", 1)], "provider string, dataset_key string, sha256 string, downloaded_at int")
    assert {(r["dataset_key"], r["sha256"]) for r in lake.latest_revisions(m).collect()} == {("k", "b"), ("l", "c")}
    seen = spark.createDataFrame([("a", "1"), ("b", "2")], "sha256 string, parser_version string")
    assert {r["sha256"] for r in lake.unprocessed(m, seen, "1").collect()} == {"b", "c"}
    out = lake.acquisition_report(spark.createDataFrame([("p", "cached"), ("p", "failed"), ("p", "failed")], "provider string, outcome string")).first()
    assert (out["cached"], out["failed"], out["downloaded"]) == (1, 2, 0)
    pairs = spark.createDataFrame([("IT", "Inter", "a"), ("IT", "inter", "b"), ("FR", "Inter", "a")], "country string, alias string, team string")
    assert [r["alias"] for r in entity.alias_collisions(pairs).collect()] == ["inter"]


def test_local_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("competition_id,season,date,time,home,away,home_goals,away_goals,status\nX,2024,2024-05-01,18:00,A,B,1,0,\nX,2024,2024-05-02,,A,B,,,\nX,2024,bad,,A,B,,,\n")
    good, issues = readers.local_matches(spark, f"file://{tmp_path}/m.csv", "Europe/Rome")
    rows = sorted(good.collect(), key=lambda r: r["match_date"])
    assert [r["status"] for r in rows] == ["FINISHED", "SCHEDULED"] and issues.count() == 1 and rows[1]["kickoff"] is None
    (tmp_path / "a.json").write_text(json.dumps([{"match_id": 7, "match_date": "2024-05-01", "kick_off": "20:45:00.000", "home_score": 1, "away_score": 1, "home_team": {"home_team_name": "A", "managers": [{"name": "M"}, {"name": "N"}]}, "away_team": {"away_team_name": "B"}}, {"match_id": 8}]))
    good, issues = readers.match_array_json(spark, f"file://{tmp_path}/a.json", "Europe/Rome")
    r = good.first()
    assert (r["home"], r["home_managers"], r["away_managers"], r["time_quality"], r["status"]) == ("A", ["M", "N"], [], "APPROXIMATE", "FINISHED") and issues.count() == 1
    with pytest.raises(ValueError):
        readers.local_matches(spark, f"file://{tmp_path}/a.json")


def test_small_functions(spark):
    assert one(spark, N.has_key(F.lit('{"a": null, "b": 1}'), "a")) and not one(spark, N.has_key(F.lit('{"a": 1}'), "b")) and not one(spark, N.has_key(F.lit("broken"), "a")) and one(spark, N.has_key(F.lit(None).cast("string"), "a")) is False
    assert one(spark, decision.reason_text(F.lit("STALE_ODDS:x"))) == decision.REASONS["STALE_ODDS"] and one(spark, decision.reason_text(F.lit("OTHER"))) == "OTHER"
    assert one(spark, O.clv_fair(F.lit(2.2), F.lit(0.5))) == pytest.approx(0.1) and one(spark, O.clv_fair(F.lit(2.2), F.lit(1.5))) is None
    assert [one(spark, O.freshness(F.lit(x).cast("double"))) for x in (1, 50, 80, None)] == ["FRESH", "AGING", "STALE", "UNKNOWN"]
    m = S.cells(F.lit(1.3), F.lit(0.9), F.lit(-0.05))
    d = one(spark, S.goal_differences(m))
    assert sum(d.values()) == pytest.approx(1) and d[0] == pytest.approx(one(spark, S.one_x_two(m)[1]))
    rows = S.score_rows(spark.range(1).select("id", F.lit(1.3).alias("h"), F.lit(0.9).alias("a")), F.col("h"), F.col("a"), F.lit(-0.05))
    r = S.shares(rows, ["id"], home=F.col("i") > F.col("j"), goals=F.col("i") + F.col("j")).first()
    assert r["home"] == pytest.approx(one(spark, S.one_x_two(m)[0])) and r["goals"] == pytest.approx(one(spark, S.mean(m, lambda i, j: i + j)))
    table = spark.createDataFrame([("m", 10, 0.5, 0.4), ("m", 30, 0.2, 0.2)], "model string, n int, mean_predicted double, observed double")
    assert evaluate.calibration_error(table, ["model"]).first()["ece"] == pytest.approx(0.025)


def test_ledger_text_tells_null_from_empty(spark):
    df = spark.createDataFrame([(None, "a|b"), ("", "a|b"), ("a|", "b"), ("a", "|b")], "x string, y string")
    assert ledger.with_digest(df, ["x", "y"]).select("row_hash").distinct().count() == 4


def test_experiment_ledger_holdout_and_promotion(spark):
    at, empty = dt.datetime(2024, 1, 1), spark.createDataFrame([], registry.LEDGER)
    kind = "family string, name string, parent_id string, created_at timestamp_ntz, n_candidates long, used_holdout boolean, body string, metrics string"
    first, lost = registry.recorded(spark.createDataFrame([("fam", "a", None, at, 12, False, "{}", '{"ll": 1.0}'), ("fam", "b", "exp-none", at, 1, False, "{}", "{}")], kind), empty)
    assert [(r["name"], r["reason"]) for r in lost.collect()] == [("b", "UNKNOWN_PARENT")]
    top = first.first()["experiment_id"]
    second, _ = registry.recorded(spark.createDataFrame([("fam", "a-fix", top, at, 1, True, "{}", '{"ll": 0.9}')], kind), first)
    book = first.unionByName(second).cache()
    assert [r["version"] for r in book.orderBy("version").collect()] == [1, 2] and registry.tampered(book).isEmpty()
    why = lambda df: sorted(r["reason"] for r in registry.tampered(df).collect())
    assert why(book.withColumn("metrics", F.when(F.col("version") == 1, "{}").otherwise(F.col("metrics")))) == ["CONTENT"]
    redone = registry.recorded(spark.createDataFrame([("fam", "a", None, at, 12, False, "{}", "{}")], kind), empty)[0]
    assert why(second.unionByName(redone)) == ["PARENT_LOST"] and why(second.unionByName(redone.withColumn("experiment_id", F.lit(top)))) == ["IDENTIFIER", "PARENT_CHANGED"]
    asked = spark.createDataFrame([(top, "2025-07-01", "x", at), (top, "2025-07-01", "final check of the champion", at), ("exp-none", "2025-07-01", "a reason long enough", at)], "experiment_id string, holdout_start string, reason string, read_at timestamp_ntz")
    reads, refused = registry.holdout_reads(asked, book)
    assert sorted(r["refused"] for r in refused.collect()) == ["NO_REASON", "UNKNOWN_EXPERIMENT"]
    assert [(r["reads"], r["experiments"], r["unlogged"]) for r in registry.holdout_counts(reads, book).collect()] == [(1, 1, 1)]
    gates = spark.createDataFrame([("m", True, True, False, at), ("m", False, False, False, at + dt.timedelta(days=9))], "model string, calibration boolean, may_forecast boolean, may_bet boolean, checked_at timestamp_ntz")
    ask = [("m", "probability", at + dt.timedelta(days=1)), ("m", "betting", at + dt.timedelta(days=1)), ("m", "probability", at + dt.timedelta(days=10)), ("n", "probability", at)]
    requests = spark.createDataFrame(ask, "model string, scope string, at timestamp_ntz")
    yes, no = registry.promotions(requests, gates, ["calibration"])
    assert [tuple(r)[:3] for r in yes.collect()] == [ask[0]]
    assert sorted((r["model"], r["scope"], r["failed"]) for r in no.collect()) == [("m", "betting", []), ("m", "probability", ["calibration"]), ("n", "probability", ["NOT_CHECKED"])]
    assert registry.ungated(requests, gates, ["calibration"]).count() == 3


def test_gates_fail_on_what_is_not_known(spark):
    scores = spark.createDataFrame([("ref", 1, 3000, 1.0), ("new", 1, 3000, 0.9)], "model string, season int, n int, log_loss double")
    comparisons = spark.createDataFrame([("new", "ref", -0.2, -0.1), ("market", "new", -0.1, 0.2)], "model_a string, model_b string, ci_low double, ci_high double")
    bare = reports.gates(scores, comparisons, "ref").first()
    assert bare["beats_reference"] and bare["robustness"] and not bare["no_leakage"] and not bare["out_of_sample"] and not bare["calibration"] and not bare["market_benchmark"] and not bare["may_forecast"]
    calibration = spark.createDataFrame([("new", 0.01, 0.95, 1.05)], "model string, ece double, slope_low double, slope_high double")
    given = lambda checked, violations, code: reports.gates(scores, comparisons, "ref", calibration=calibration, market="market", audit=spark.createDataFrame([("new", checked, violations)], "model string, checked long, violations long"), code_version=code, fingerprint="f").first()
    assert given(3000, None, "abc")["may_bet"] and not given(3000, 0, "abc-dirty")["may_forecast"] and not given(3000, 1, "abc")["no_leakage"] and not given(2999, 0, "abc")["out_of_sample"]
    runs = spark.createDataFrame([(1, '{"a:calibrated": 1.0}'), (2, '{"a:calibrated": 2.0, "a:raw": 3.0}')], "at int, summary string")
    assert [tuple(r) for r in reports.expected_losses(runs, "at", "summary").collect()] == [("a", 2.0)]


def test_slips(spark):
    from tidemark.operators import slips

    leg = lambda slip, m, market, sel, p, odds: (slip, m, market, sel, 2.5, p, odds, 1.4, 1.1, -0.05)
    rows = [leg(1, 1, "1X2", "H", 0.44, 2.0), leg(1, 1, "1X2", "A", 0.3, 3.0), leg(1, 2, "OU", "OVER", 0.5, 2.2), leg(2, 1, "1X2", "H", 0.44, 2.0)] + [leg(3, m, "1X2", "H", 0.44, 2.0) for m in range(6)]
    df = spark.createDataFrame(rows, "slip int, match_id int, market string, selection string, line double, prob double, odds double, lambda_home double, lambda_away double, rho double")
    got = {r["slip"]: r for r in slips.evaluated(df).collect()}
    assert got[1]["adjusted"] == 0 and got[1]["flags"] == ["SAME_MATCH_CORRELATION:1", "MUTUALLY_EXCLUSIVE_LEGS:1", "INDEPENDENCE_ASSUMED_ACROSS_MATCHES"] and got[1]["odds"] == pytest.approx(13.2)
    assert got[2]["adjusted"] == pytest.approx(one(spark, S.one_x_two(S.cells(F.lit(1.4), F.lit(1.1), F.lit(-0.05)))[0])) and got[2]["flags"] == []
    assert got[3]["adjusted"] is None and "TOO_MANY_LEGS" in got[3]["flags"]
