"""Calibrators fitted on sums against fits on rows, round trips of their JSON, choice and live use."""

import json

import numpy as np
import pytest
import rowfits
from pyspark.sql import functions as F

from tidemark.operators import calibration

METHODS = ("temperature", "dirichlet", "ovr_platt", "ovr_isotonic")
SCHEMA = "model string, season int, p_home double, p_draw double, p_away double, outcome int"


def bent(n: int, seed: int, power: float = 2.0):
    rng = np.random.default_rng(seed)
    true = rng.dirichlet([4, 3, 3], n)
    y = np.array([rng.choice(3, p=p) for p in true])
    q = true**power
    return true, q / q.sum(axis=1, keepdims=True), y


@pytest.fixture(scope="module")
def rows():
    _, p, y = bent(1600, 5)
    return [("a", 2000 + i // 400, *map(float, q), int(k)) for i, (q, k) in enumerate(zip(p, y))]


@pytest.fixture(scope="module")
def fits(spark, rows):
    slim = calibration.slim(spark.createDataFrame(rows, SCHEMA).repartition(5), ["model"], "season", ["p_home", "p_draw", "p_away"], "outcome")
    return {(r["cut"], r["method"]): json.loads(r["calibrator"]) for r in calibration.fitted(slim, ["model"], METHODS).collect()}


def test_fits_on_sums_are_fits_on_rows(rows, fits):
    assert {cut for cut, _ in fits} == {2001, 2002, 2003, 2004}
    for cut in (2001, 2003):
        p, y = (np.array([r[i] for r in rows if r[1] < cut]) for i in (slice(2, 5), 5))
        assert 1 / fits[cut, "temperature"]["beta"] == pytest.approx(rowfits.temperature(p, y), rel=1e-5)
        for name in METHODS:
            new = np.random.default_rng(1).dirichlet([2, 2, 2], 50)
            assert np.allclose(applied_rows(fits[cut, name], new), rowfits.CALIBRATORS[name](p, y)(new), atol=1e-6), name


def applied_rows(c: dict, p: np.ndarray) -> np.ndarray:
    """The map of a calibrator in plain numpy."""
    logs = np.log(np.clip(p, 1e-15, 1))
    if c["method"] == "temperature":
        return rowfits.tempered(p, 1 / c["beta"])
    if c["method"] == "dirichlet":
        z = np.exp(np.hstack([logs, np.ones((len(p), 1))]) @ np.array(c["weights"]).T)
        return z / z.sum(axis=1, keepdims=True)
    if c["method"] == "ovr_platt":
        z = np.clip(p, 1e-6, 1 - 1e-6)
        q = np.stack([1 / (1 + np.exp(-(a + b * np.log(z[:, k] / (1 - z[:, k]))))) for k, (a, b) in enumerate(c["coefs"])], axis=1)
    else:
        q = np.stack([np.array(c["values"][k])[np.clip(np.searchsorted(e, p[:, k], "right") - 1, 0, None)] for k, e in enumerate(c["edges"])], axis=1)
    q = np.clip(q, 1e-3, None)
    return q / q.sum(axis=1, keepdims=True)


def test_calibrators_round_trip_as_json_and_columns(spark, fits):
    p = np.vstack([np.random.default_rng(2).dirichlet([2, 2, 2], 40), [[1.0, 0.0, 0.0], [0.0, 0.5, 0.5]]])
    df = spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(p)], "i int, p array<double>")
    for (cut, name), c in fits.items():
        if cut == 2003:
            text = json.dumps(c)
            assert json.loads(text) == c
            got = df.select("i", calibration.applied(F.col("p"), F.from_json(F.lit(text), calibration.SCHEMA)).alias("q")).orderBy("i").collect()
            assert np.allclose([r["q"] for r in got], applied_rows(c, p), atol=1e-9), name
    same = df.select(calibration.applied(F.col("p"), F.from_json(F.lit(calibration.IDENTITY), calibration.SCHEMA)).alias("q"), "p").collect()
    assert all(r["q"] == r["p"] for r in same)


def test_pools_are_the_same_in_any_order():
    rng = np.random.default_rng(3)
    p, hit = np.sort(np.round(rng.random(500), 2)), (rng.random(500) < 0.4).astype(float)
    whole = calibration.pooled(p, hit, np.ones(500))
    parts = [pool for k in range(5) for pool in calibration.pooled(p[k * 100 : k * 100 + 100], hit[k * 100 : k * 100 + 100], np.ones(100))]
    assert np.allclose(calibration.pooled(*zip(*parts)), whole)


def test_live_calibrator_only_if_it_helps(spark):
    _, p, y = bent(4000, 6)
    true, _, z = bent(4000, 7)
    rows = [("bent", 2000 + i // 800, *map(float, q), int(k)) for i, (q, k) in enumerate(zip(p, y))] + [("fine", 2000 + i // 800, *map(float, q), int(k)) for i, (q, k) in enumerate(zip(true, z))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["model"]: r for r in calibration.live(df).collect()}
    assert got["fine"]["method"] == "identity" and got["bent"]["method"] != "identity" and json.loads(got["bent"]["calibrator"])["method"] == got["bent"]["method"]
    out = calibration.sequential(df).toPandas()
    assert set(out[out.season <= 2001].method) == {"identity"} and len(out) == 8000
    late = out[(out.model == "bent") & (out.season == 2004)]
    loss = lambda q, k: -np.log(q[np.arange(len(k)), k]).mean()
    assert set(late.method) != {"identity"} and loss(late[["cal_p_home", "cal_p_draw", "cal_p_away"]].to_numpy(), late.outcome.to_numpy()) < loss(late[["p_home", "p_draw", "p_away"]].to_numpy(), late.outcome.to_numpy()) - 0.01
