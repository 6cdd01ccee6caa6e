"""One small test for each finding of the third round on growth: groups, passes and caches that grew with the tables."""

import datetime as dt
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F
from test_findings_r03 import copies, duck_result

from oracle import differences
from tidemark.llm import byte_bpe
from tidemark.operators import calibration, merge, models, ratings
from tidemark.plans.catalogue import QUERIES
from tidemark.sources.views import view


def by_rows(x, y):
    """Ordered logit by Newton steps on all rows, curvature by differences of the gradient."""
    theta = np.array([-0.5, 0.0, 1.0])

    def gradient(t):
        gap = np.exp(t[1])
        s0, s1 = 1 / (1 + np.exp(-(t[0] - t[2] * x))), 1 / (1 + np.exp(-(t[0] + gap - t[2] * x)))
        d0, d1, p = s0 * (1 - s0), s1 * (1 - s1), np.where(y == 0, s0, np.where(y == 1, s1 - s0, 1 - s1))
        a, b = np.where(y == 0, d0, np.where(y == 1, -d0, 0)) / p, np.where(y == 1, d1, np.where(y == 2, -d1, 0)) / p
        return -np.array([(a + b).sum(), gap * b.sum(), -(x * (a + b)).sum()])

    def curvature(t):
        h = np.stack([(gradient(t + e) - gradient(t - e)) / 2e-5 for e in np.eye(3) * 1e-5])
        return (h + h.T) / 2 + 1e-6 * len(x) * np.eye(3)

    for _ in range(60):
        step = np.linalg.solve(curvature(theta), gradient(theta))
        theta = theta - step * min(1.0, 1.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-7:
            break
    return theta, np.linalg.inv(curvature(theta))


def test_link_fits_hold_four_weeks_a_group(spark, sf_dir, monkeypatch):
    """a group held all of a league's results of ten years."""
    held, write = [], models.written
    monkeypatch.setattr(models, "written", lambda df, name: held.append(write(df, name)) or held[-1])
    results = view(spark, sf_dir, "matches").where("status = 'FINISHED'")
    history = ratings.history(ratings.folded(results))
    cutoffs = spark.createDataFrame([(k, dt.datetime(y, 1, 1)) for k in (0, 1) for y in (1980, 1997, 1999)], "league int, cutoff timestamp_ntz")
    got = {(r["league"], r["cutoff"].year): r for r in models.link_fits(history, results, cutoffs, least=20, days=700).collect()}
    rows = history.join(results.select("match_id", "home_goals", "away_goals"), "match_id").toPandas()
    for (league, year), r in got.items():
        end = np.datetime64(f"{year}-01-01")
        mine = rows[(rows["league"] == league) & (rows["available_at"] <= end) & (rows["available_at"] > end - np.timedelta64(700, "D"))]
        assert r["n"] == len(mine)
        if year == 1980:
            assert r["n"] == 0 and r["slope"] is None and r["covariance"] is None
            continue
        theta, cov = by_rows(((mine["elo_home"] - mine["elo_away"] + 65) / 400).to_numpy(), (np.sign(mine["home_goals"] - mine["away_goals"]) + 1).to_numpy())
        assert np.allclose([r["low"], r["log_gap"], r["slope"]], theta, atol=1e-6) and np.allclose(r["covariance"], cov.ravel(), rtol=1e-4, atol=1e-8)
    spans = [np.ptp(np.frombuffer(r["at"], "datetime64[us]")) for r in held[0].collect()]
    assert len(spans) > 100 and max(spans) < np.timedelta64(28, "D")


def as_before(rows, gap=3, single=True):
    """Clusters of a pairing's records (day, source), each compared with every cluster."""
    groups, out = [], []
    for d, s in rows:
        gaps = [(min(abs(d - x) for x in seen), i) for i, (used, seen) in enumerate(groups) if s not in used]
        best = min(gaps) if gaps else None
        if best and (best[0] <= gap or (single and len(groups) == 1)):
            at = best[1]
        else:
            groups.append((set(), []))
            at = len(groups) - 1
        groups[at][0].add(s)
        groups[at][1].append(d)
        out.append(at)
    return out


def test_cluster_of_a_pairing_with_many_records(spark):
    """a record was compared with all clusters of its pairing, so time grew with the square of a pairing's records."""
    rng, first = random.Random(4), dt.date(2000, 1, 1)
    day = lambda d: first + dt.timedelta(days=d)
    schema = "pair string, source string, match_date date, source_key int"
    for single in (True, False):
        rows = [(None if pair == 0 else str(pair), rng.choice("abcd"), rng.randrange(2 + 9 * pair), i) for pair in range(12) for i in range(60)]
        got = merge.cluster(spark.createDataFrame([(p, s, day(d), k) for p, s, d, k in rows], schema).repartition(5), ["pair"], single_any_gap=single).collect()
        got = {r["source_key"] + 1000 * int(r["pair"] or 0): r["cluster"] for r in got}
        for pair in range(12):
            mine = sorted((d, s, k) for p, s, d, k in rows if int(p or 0) == pair)
            assert [got[k + 1000 * pair] for _, _, k in mine] == as_before([(d, s) for d, s, _ in mine], single=single)
    undated = [("x", "a", None, 1), ("x", "b", None, 2), ("x", "c", None, 3), ("x", "a", day(1), 4), ("x", "b", day(2), 5), ("x", "b", day(90), 6)]
    got = {r["source_key"]: r["cluster"] for r in merge.cluster(spark.createDataFrame(undated, schema), ["pair"]).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 2}
    many = spark.range(60_000).select(F.lit("x").alias("pair"), F.lit("a").alias("source"), F.date_add(F.lit(first), (F.col("id") / 20).cast("int")).alias("match_date"), F.col("id").cast("int").alias("source_key"))
    began = time.perf_counter()
    assert merge.cluster(many, ["pair"]).agg(F.max("cluster")).first()[0] == 59_999
    one = time.perf_counter() - began
    both = many.unionByName(many.withColumns({"source": F.lit("b"), "source_key": F.col("source_key") + 10**6}))
    began = time.perf_counter()
    assert merge.cluster(both, ["pair"]).agg(F.max("cluster")).first()[0] == 59_999
    assert max(one, time.perf_counter() - began) < 60


def test_calibration_reads_equal_forecasts_once(spark):
    """each of the passes of the fits went over all forecasts, equal ones too."""
    rng = np.random.default_rng(2)
    rows = [("a", 2000 + i % 4, *map(float, p), int(rng.choice(3, p=p))) for i, p in enumerate(rng.dirichlet([3, 2, 2], 400))]
    schema = "model string, season int, p_home double, p_draw double, p_away double, outcome int"
    once = spark.createDataFrame(rows, schema)
    often = once.crossJoin(spark.range(6)).drop("id")
    slim = lambda df: calibration.slim(df, ["model"], "season", ["p_home", "p_draw", "p_away"], "outcome")
    assert slim(often).count() == slim(once).count() == 400
    singly = slim(often).select("model", "season", "p", "y", F.explode(F.array_repeat(F.lit(1).cast("bigint"), F.col("w").cast("int"))).alias("w"))
    by = lambda df: {(r["cut"], r["method"]): [float(x) for x in re.findall(r"-?\d+\.\d+(?:e-?\d+)?", r["calibrator"])] for r in calibration.fitted(df, ["model"], ["temperature", "dirichlet", "ovr_platt", "ovr_isotonic"]).collect()}
    a, b = by(slim(often)), by(singly)
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)
    out = calibration.sequential(often.where("season < 2001").unionByName(once.where("season >= 2001")))
    assert out.count() == 6 * 100 + 300


def test_team_form_windows_hold_days(spark, sf_dir, tmp_path):
    """windows held all of a team's rows, each with its lists of results."""
    where = copies(spark, sf_dir, tmp_path / "t", 6, orders=lambda o: o.withColumn("o_orderdate", F.col("o_orderdate") - F.make_interval(days=F.dayofyear("o_orderdate") % 20)))
    out = QUERIES["team_form"](spark, where)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and not re.search(r"Window \[.*collect_list\((points|gf|ga)", plan)
    assert not differences(out.toPandas(), duck_result(where, "team_form"))


def test_byte_bpe_leaves_nothing_in_the_worker(spark, sf_dir):
    """pipeline: workers kept vocabulary and known pairs, some 75 MB each, while other stages ran."""
    from public_tokenizers import PATTERN

    docs = spark.createDataFrame([(i, f"one text {i}") for i in range(8)], "doc_id int, text string").repartition(4)
    assert byte_bpe.encoded(docs, byte_bpe.tokenizer_file("byte_bpe_multi_50k.tiktoken"), PATTERN, outputs=("n_tokens",)).count() == 8

    def left(batches):
        import pandas as pd

        from tidemark.llm import byte_bpe

        for _ in batches:
            yield pd.DataFrame({"n": [len(byte_bpe._encoders)]})

    assert spark.range(8).repartition(4).mapInPandas(left, "n int").agg(F.max("n")).first()[0] == 0
