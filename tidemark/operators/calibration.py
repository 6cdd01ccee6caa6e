"""Calibrated class probabilities: maps fitted on sums, kept as data, applied by column expressions.

A calibrator is a JSON row: {"method": "identity" | "temperature" | "dirichlet" | "ovr_platt" | "ovr_isotonic", ...}. Fits are
made for each group and season cut, from all forecasts of earlier seasons:

* temperature, Dirichlet and Platt maps by Newton steps. A pass over the forecasts adds up gradient and curvature of all cuts
  and methods at once; a task holds and sends one vector per cut, and the driver solves small systems, as many as there are cuts.
* isotonic maps from pools. Forecasts are dealt by class and stretch of probability; within a stretch falling neighbours are
  pooled, and the pools of all stretches are pooled again, which gives the fit of the rows themselves: pooling is the same in any order.

Forecasts of a group and season with equal probabilities and outcome are one row with their number (slim()), and a map is applied once to equal probabilities.

The choice of a method compares held-out losses by blocks: sums over a fixed number of blocks, resampled.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

SCHEMA = "method string, beta double, weights array<array<double>>, coefs array<array<double>>, edges array<array<double>>, values array<array<double>>"
IDENTITY = json.dumps({"method": "identity"})
SMOOTH = ("temperature", "dirichlet", "ovr_platt")
TINY, EDGE, FLOOR = 1e-15, 1e-6, 1e-3


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


class Temperature:
    """p^beta, scaled to 1."""

    def __init__(self, k: int):
        self.theta, self.most = np.array([1.0]), 0.5

    def slopes(self, logs: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = _softmax(self.theta[0] * logs)
        mean = (q * logs).sum(axis=1)
        return np.array([(w * (mean - logs[np.arange(len(y)), y])).sum()]), np.array([[(w * ((q * logs**2).sum(axis=1) - mean**2)).sum()]])

    def data(self) -> dict:
        return {"method": "temperature", "beta": float(np.clip(self.theta[0], 0.2, 5.0))}


class Dirichlet:
    """Multinomial logistic map of log probabilities, shrunk toward the identity."""

    def __init__(self, k: int, ridge: float = 1.0):
        self.k, self.ridge, self.most = k, ridge, 1.0
        self.start = np.hstack([np.eye(k), np.zeros((k, 1))]).ravel()
        self.theta = self.start.copy()

    def slopes(self, logs: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, x = self.k, np.hstack([logs, np.ones((len(logs), 1))])
        q = _softmax(x @ self.theta.reshape(k, k + 1).T)
        h = np.zeros((k, k + 1, k, k + 1))
        for a in range(k):
            for b in range(a + 1):
                h[a, :, b, :] = (x * (w * q[:, a] * ((a == b) - q[:, b]))[:, None]).T @ x
                h[b, :, a, :] = h[a, :, b, :].T
        return ((w[:, None] * (q - np.eye(k)[y])).T @ x).ravel(), h.reshape(k * (k + 1), -1)

    def prior(self) -> tuple[np.ndarray, np.ndarray]:
        return self.ridge * (self.theta - self.start), self.ridge * np.eye(len(self.theta))

    def data(self) -> dict:
        return {"method": "dirichlet", "weights": self.theta.reshape(self.k, -1).tolist()}


class Platt:
    """Logistic recalibration of each class, scaled to 1."""

    def __init__(self, k: int):
        self.k, self.most = k, 1.0
        self.theta = np.tile([0.0, 1.0], k)

    def slopes(self, logs: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.clip(np.exp(logs), EDGE, 1 - EDGE)
        g, h = np.zeros(2 * self.k), np.zeros((2 * self.k, 2 * self.k))
        for c in range(self.k):
            x, at = np.stack([np.ones(len(y)), np.log(p[:, c] / (1 - p[:, c]))], axis=1), slice(2 * c, 2 * c + 2)
            m = 1 / (1 + np.exp(-x @ self.theta[at]))
            g[at], h[at, at] = x.T @ (w * (m - (y == c))), (x * (w * m * (1 - m))[:, None]).T @ x
        return g, h

    def data(self) -> dict:
        return {"method": "ovr_platt", "coefs": self.theta.reshape(-1, 2).tolist()}


KINDS = {"temperature": Temperature, "dirichlet": Dirichlet, "ovr_platt": Platt}


def pooled(values: Sequence[float], hits: Sequence[float], weights: Sequence[float]) -> list[list[float]]:
    """[first probability, hits, weight] of the monotone fit's pools; rows in order of probability, hits as sums."""
    pools: list[list[float]] = []
    for p, hit, w in zip(values, hits, weights):
        if pools and pools[-1][0] == p:  # equal probabilities are one row
            hit, w = hit + pools[-1][1], w + pools[-1][2]
            pools.pop()
        pools.append([p, hit, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, hit, w = pools.pop()
            pools[-1][1] += hit
            pools[-1][2] += w
    return pools


def _cuts(forecasts: DataFrame, by: Sequence[str]) -> dict[tuple, list[int]]:
    """Seasons of each group, and the one after the last: as many values as there are groups and seasons."""
    found: dict[tuple, list[int]] = {}
    for row in forecasts.select(*by, "season").distinct().collect():
        found.setdefault(tuple(row)[:-1], []).append(row["season"])
    return {key: [*sorted(seasons), max(seasons) + 1] for key, seasons in found.items()}


def _smooth_fits(rows: DataFrame, by: Sequence[str], cuts: dict[tuple, list[int]], methods: Sequence[str], classes: int, rounds: int) -> list[tuple]:
    maps = {(key, cut, name): KINDS[name](classes) for key, seasons in cuts.items() for cut in seasons[1:] for name in methods}
    open_, spark = set(maps), rows.sparkSession
    for _ in range(rounds):
        if not open_:
            break
        now = spark.sparkContext.broadcast({job: maps[job] for job in open_})

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple, np.ndarray] = {}
            for pdf in batches:
                for key, part in pdf.groupby([*by, "season"], sort=False, dropna=False):
                    key = tuple(None if x is None or x != x else x for x in key)
                    logs, y = np.log(np.clip(np.stack(part["p"].to_numpy()), TINY, 1)), part["y"].to_numpy()
                    w = part["w"].to_numpy(float)
                    for job, fit in now.value.items():
                        if job[0] == key[:-1] and key[-1] < job[1]:
                            g, h = fit.slopes(logs, y, w)
                            held[job] = held.get(job, 0.0) + np.concatenate([g, h.ravel()])
            yield pd.DataFrame([(repr(job), i, v) for job, vector in held.items() for i, v in enumerate(vector)], columns=["job", "i", "v"])

        found: dict[str, dict[int, float]] = {}
        for r in rows.mapInPandas(sums, "job string, i int, v double").groupBy("job", "i").agg(F.sum("v").alias("v")).collect():
            found.setdefault(r["job"], {})[r["i"]] = r["v"]
        for job in list(open_):
            fit, vector = maps[job], found.get(repr(job))
            if vector is None:
                open_.discard(job)
                continue
            n = len(fit.theta)
            all_ = np.array([vector[i] for i in range(n + n * n)])
            g, h = all_[:n], all_[n:].reshape(n, n) + 1e-9 * np.eye(n)
            if hasattr(fit, "prior"):
                g, h = g + fit.prior()[0], h + fit.prior()[1]
            step = np.linalg.solve(h, g)
            fit.theta = fit.theta - step * min(1.0, fit.most / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-7:
                open_.discard(job)
    return [(*key, cut, name, json.dumps(fit.data())) for (key, cut, name), fit in maps.items()]


def _isotonic_fits(rows: DataFrame, by: Sequence[str], cuts: dict[tuple, list[int]], stretches: int = 256) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    per = rows.select(*by, "season", "y", "w", F.posexplode("p").alias("class", "value")).withColumn("hit", (F.col("y") == F.col("class")).cast("double") * F.col("w"))
    per = per.groupBy(*by, "season", "class", "value").agg(F.sum("hit").alias("hits"), F.sum("w").cast("double").alias("w")).withColumn("stretch", F.floor(F.col("value") * stretches).cast("int"))
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    pools = f"{fields}, cut bigint, class int, stretch int, pools array<array<double>>"

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["value", "season"])
        out = []
        for cut in cuts.get(tuple(key[: len(by)]), ())[1:]:
            part = pdf[pdf["season"] < cut]
            if len(part):
                out.append((*key[: len(by)], cut, int(key[-2]), int(key[-1]), pooled(part["value"], part["hits"], part["w"])))
        return pd.DataFrame(out, columns=[*by, "cut", "class", "stretch", "pools"])

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        edges, values = [], []
        for _, part in pdf.sort_values(["class", "stretch"]).groupby("class"):
            whole = pooled(*zip(*(pool for some in part["pools"] for pool in some)))
            edges.append([p for p, _, _ in whole])
            values.append([hits / w for _, hits, w in whole])
        return pd.DataFrame([(*key, "ovr_isotonic", json.dumps({"method": "ovr_isotonic", "edges": edges, "values": values}))], columns=[*by, "cut", "method", "calibrator"])

    dealt = per.groupBy(*by, "class", "stretch").applyInPandas(block, pools)
    return dealt.groupBy(*by, "cut").applyInPandas(merged, f"{fields}, cut bigint, method string, calibrator string")


def slim(forecasts: DataFrame, by: Sequence[str], season: str, probabilities: Sequence[str], outcome: str) -> DataFrame:
    """by, season, p, y, w: the different forecasts of a group and season, with their numbers."""
    ps = [f"__p{i}" for i in range(len(probabilities))]
    each = forecasts.select(*by, F.col(season).cast("bigint").alias("season"), *(F.col(c).alias(p) for c, p in zip(probabilities, ps)), F.col(outcome).cast("int").alias("y"))
    return each.groupBy(*by, "season", *ps, "y").agg(F.count("*").alias("w")).select(*by, "season", F.array(*ps).alias("p"), "y", "w")


def fitted(rows: DataFrame, by: Sequence[str], methods: Sequence[str], classes: int = 3, rounds: int = 40) -> DataFrame:
    """by, cut, method, calibrator: each method fitted on the seasons before each cut. rows: slim()."""
    cuts = _cuts(rows, by)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    made = _smooth_fits(rows, by, cuts, [m for m in methods if m in KINDS], classes, rounds)
    out = rows.sparkSession.createDataFrame(made, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", cut bigint, method string, calibrator string")
    return out.unionByName(_isotonic_fits(rows, by, cuts)) if "ovr_isotonic" in methods else out


def applied(p: Column, calibrator: Column) -> Column:
    """Calibrated probabilities (array) of p (array); calibrator: the JSON parsed by SCHEMA, or null for the identity."""
    logs = F.transform(p, lambda x: F.ln(F.greatest(x, F.lit(TINY))))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    let = lambda x, f: F.get(F.transform(F.array(x), f), 0)
    scaled = lambda a: let(a, lambda q: let(total(q), lambda s: F.transform(q, lambda x: x / s)))
    soft = lambda z: let(z, lambda q: let(F.array_max(q), lambda top: scaled(F.transform(q, lambda x: F.exp(x - top)))))
    at = lambda name: calibrator[name]
    tempered = soft(F.transform(logs, lambda x: x * at("beta")))
    matrix = soft(F.transform(at("weights"), lambda w: total(F.zip_with(w, F.array_append(logs, F.lit(1.0)), lambda a, b: a * b))))
    clipped = lambda x: F.least(F.greatest(x, F.lit(EDGE)), F.lit(1 - EDGE))
    floored = lambda a: scaled(F.transform(a, lambda x: F.greatest(x, F.lit(FLOOR))))
    logistic = floored(F.zip_with(at("coefs"), p, lambda c, x: 1 / (1 + F.exp(-(c[0] + c[1] * F.ln(clipped(x) / (1 - clipped(x))))))))
    steps = floored(F.transform(p, lambda x, k: F.get(F.get(at("values"), k), F.greatest(F.lit(0), F.size(F.filter(F.get(at("edges"), k), lambda e: e <= x)) - 1))))
    method = at("method")
    return F.when(method == "temperature", tempered).when(method == "dirichlet", matrix).when(method == "ovr_platt", logistic).when(method == "ovr_isotonic", steps).otherwise(p)


def chosen(rows: DataFrame, fits: DataFrame, by: Sequence[str], gain: float = 0.0005, least: int = 600, replicates: int = 500, blocks: int = 256) -> DataFrame:
    """by, season, method, calibrator for each season and the one after the last: the method with the largest mean gain in log
    loss on the last two seasons before (one, with fewer than four), fitted on those before them. It is used, refitted on all
    earlier seasons, if it gains enough and a bootstrap interval over blocks of forecasts is above zero; else the identity.
    """
    cuts, spark = _cuts(rows, by), rows.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    jobs = []
    for key, seasons in cuts.items():
        for i, now in enumerate(seasons):
            held = 2 if i >= 4 else 1
            if i > held:
                jobs += [(*key, now, seasons[i - held], season) for season in seasons[i - held : i]]
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    asked = spark.createDataFrame(jobs, f"{fields}, now bigint, cut bigint, season bigint")
    counts = rows.groupBy(*by, "season").agg(F.sum("w").alias("n"))
    trained = asked.select(*by, "now", "cut").distinct().join(counts.withColumnRenamed("season", "s"), list(by)).where("s < cut").groupBy(*by, "now").agg(F.sum("n").alias("trained"))
    loss = lambda q: -F.ln(F.greatest(F.get(q, F.col("y")), F.lit(TINY)))
    tried = rows.withColumn("block", F.pmod(F.xxhash64("p", "y"), F.lit(blocks))).join(asked, [*by, "season"]).join(fits, [*by, "cut"])
    tried = tried.withColumn("c", F.from_json("calibrator", SCHEMA)).withColumn("d", loss(F.col("p")) - loss(applied(F.col("p"), F.col("c"))))
    sums = tried.groupBy(*by, "now", "method", "block").agg(F.sum(F.col("d") * F.col("w")).alias("s"), F.sum("w").alias("n")).join(trained, [*by, "now"]).where(F.col("trained") >= least)

    def pick(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["method", "block"])
        means = {m: part["s"].sum() / part["n"].sum() for m, part in pdf.groupby("method")}
        best = max(means, key=lambda m: (means[m], m))
        part = pdf[pdf["method"] == best]
        s, n = part["s"].to_numpy(), part["n"].to_numpy()
        drawn = np.random.default_rng(zlib.crc32("/".join(map(str, key)).encode())).integers(0, len(s), (replicates, len(s)))
        low = np.quantile(s[drawn].sum(axis=1) / n[drawn].sum(axis=1), 0.025)
        return pd.DataFrame([(*key, best if means[best] >= gain and low > 0 else "identity", means[best], low)], columns=[*by, "season", "method", "gain", "gain_low"])

    picked = sums.groupBy(*by, "now").applyInPandas(pick, f"{fields}, season bigint, method string, gain double, gain_low double")
    used = fits.withColumnRenamed("cut", "season")
    return picked.join(used, [*by, "season", "method"], "left").withColumn("calibrator", F.coalesce("calibrator", F.lit(IDENTITY)))


def sequential(
    forecasts: DataFrame, by: Sequence[str] = ("model",), season: str = "season", probabilities: Sequence[str] = ("p_home", "p_draw", "p_away"), outcome: str = "outcome", methods: Sequence[str] = ("temperature", "dirichlet", "ovr_isotonic"),
    **rules,
) -> DataFrame:
    """forecasts with calibrated probabilities (cal_...) and the method, each season by the calibrator chosen on the earlier ones."""
    rows = written(slim(forecasts, by, season, probabilities, outcome), "calibration-rows")
    picks = written(chosen(rows, fitted(rows, by, methods, len(probabilities)), by, **rules), "calibrators")
    keyed = picks.select(*by, F.col("season").alias("__season"), "method", F.from_json("calibrator", SCHEMA).alias("__c"))
    classes = rows.select(*by, F.col("season").alias("__season"), "p").distinct().join(keyed, [*by, "__season"], "left").withColumn("__q", applied(F.col("p"), F.col("__c")))
    names = {c: f"__k{i}" for i, c in enumerate([*by, "__season", *probabilities])}
    made = [F.col(c).alias(names[c]) for c in [*by, "__season"]] + [F.col("p")[i].alias(names[p]) for i, p in enumerate(probabilities)] + [F.col("__q")[i].alias(f"cal_{p}") for i, p in enumerate(probabilities)]
    classes = written(classes.select(*made, F.coalesce("method", F.lit("identity")).alias("method")), "calibrated")
    joined = forecasts.withColumn("__season", F.col(season).cast("bigint")).join(classes, [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()], "left")
    return joined.select(*forecasts.columns, *(f"cal_{p}" for p in probabilities), "method")


def live(forecasts: DataFrame, by: Sequence[str] = ("model",), season: str = "season", probabilities: Sequence[str] = ("p_home", "p_draw", "p_away"), outcome: str = "outcome", methods: Sequence[str] = ("temperature", "dirichlet", "ovr_isotonic"), **rules) -> DataFrame:
    """by, method, calibrator for forecasts to come: fitted on all but the last two seasons, kept, and refitted on all, only if it helps there."""
    rows = written(slim(forecasts, by, season, probabilities, outcome), "calibration-rows")
    picks = chosen(rows, fitted(rows, by, methods, len(probabilities)), by, **rules)
    last = rows.groupBy(*by).agg((F.max("season") + 1).alias("season"))
    return last.join(picks, [*by, "season"], "left").select(*by, F.coalesce("method", F.lit("identity")).alias("method"), F.coalesce("calibrator", F.lit(IDENTITY)).alias("calibrator"))
