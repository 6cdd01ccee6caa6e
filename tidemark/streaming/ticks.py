"""Structured Streaming over price ticks and results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import changed
from ..operators.ratings import RESULT, Elo, League
from ..sources.lake import _has_files


def distinct_ticks(ticks: DataFrame, ident: Sequence[str], at: str, delay: str = "1 hour") -> DataFrame:
    """Ticks without exact repeats that come within the delay."""
    return ticks.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(ident))


def latest_state(ticks: DataFrame, keys: Sequence[str], at: str, value: str, span: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Latest value of each key so far (update or complete mode); of equal times the larger value. With a span (such as
    "1 day") it is the latest of each span of time, whose state ends once the watermark has passed it."""
    if span:
        w = F.window(at, span)
        out = ticks.withWatermark(at, delay).groupBy(*keys, w).agg(F.max_by(value, F.struct(at, value)).alias("latest"), F.max(at).alias("seen_at"), F.count("*").alias("n"))
        return out.select(*keys, F.col("window.start").alias("start"), "latest", "seen_at", "n")
    return ticks.groupBy(*keys).agg(F.max_by(value, F.struct(at, value)).alias("latest"), F.max(at).alias("seen_at"), F.count("*").alias("n"))


def bucketed(ticks: DataFrame, keys: Sequence[str], at: str, value: str, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """First, last, lowest and highest value in tumbling, or with slide in sliding, windows."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = ticks.withWatermark(at, delay).groupBy(*keys, w.alias("w")).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "first", "last", "low", "high", "n")


def bursts(ticks: DataFrame, keys: Sequence[str], at: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of activity."""
    out = ticks.withWatermark(at, delay).groupBy(*keys, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def near_results(prices: DataFrame, results: DataFrame, key: str, price_at: str, result_at: str, hours: int, delay: str = "2 hours") -> DataFrame:
    """Prices within the hours before their result: a stream-stream interval join; both sides have watermarks, so state ends."""
    p = prices.withWatermark(price_at, delay).alias("p")
    r = results.withWatermark(result_at, delay).withColumnRenamed(key, "__key").alias("r")
    near = F.expr(f"p.{key} = r.__key AND p.{price_at} <= r.{result_at} AND p.{price_at} >= r.{result_at} - INTERVAL {hours} HOURS")
    return p.join(r, near).drop("__key")


RATED = "league int, match_id long, elo_home double, elo_away double, late boolean"
BUFFERED = "match_ids array<bigint>, dates array<bigint>, seasons array<int>, homes array<int>, aways array<int>, home_goals array<int>, away_goals array<int>"


class RatingFold(StatefulProcessor):
    """Results wait in a buffer until the watermark has passed their instant; its timer then folds them, all at once and in order."""

    def __init__(self, params: Elo):
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.standings = handle.getMapState("standings", "team int", "rating double, latest int, before int")
        self.waiting = handle.getMapState("waiting", "at bigint", BUFFERED)
        self.mark = handle.getValueState("mark", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = self.mark.get()[0] if self.mark.exists() else None
        for pdf in rows:
            stamps = pdf["available_at"].astype("datetime64[us]").astype("int64")
            late = stamps <= mark if mark is not None else pd.Series(False, index=pdf.index)
            for at, part in pdf[~late].groupby(stamps[~late]):
                columns = [part["match_id"], pd.to_datetime(part["match_date"]).astype("datetime64[us]").astype("int64"), *(part[c] for c in RESULT)]
                old = self.waiting.getValue((at,)) if self.waiting.containsKey((at,)) else [[]] * len(columns)
                self.waiting.updateValue((at,), tuple([*a, *(int(x) for x in b)] for a, b in zip(old, columns)))
                self.handle.registerTimer(-(-at // 1000))
            if late.any():
                yield pd.DataFrame({"league": int(key[0]), "match_id": pdf["match_id"][late], "elo_home": None, "elo_away": None, "late": True})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = sorted(at for (at,) in self.waiting.keys() if at <= expiredTimerInfo.getExpiryTimeInMs() * 1000)
        if not due:
            return
        league, out = League(self.params, [(t, *values) for (t,), values in self.standings.iterator()]), []
        for at in due:
            rows = sorted(zip(*self.waiting.getValue((at,))), key=lambda r: (r[1], r[0]))
            for (ident, *_), pair in zip(rows, league.instant([tuple(r[2:]) for r in rows])):
                out.append((int(key[0]), ident, *map(float, pair), False))
            for team in {t for r in rows for t in r[3:5]}:
                self.standings.updateValue((team,), (float(league.rating[team]), league.latest[team], league.before[team]))
            self.waiting.removeKey((at,))
        self.mark.update((due[-1],))
        yield pd.DataFrame(out, columns=["league", "match_id", "elo_home", "elo_away", "late"])

    def close(self) -> None:
        pass


def rating_stream(results: DataFrame, params: Elo = Elo(), delay: str = "7 days") -> DataFrame:
    """Ratings before each result, by league: the same as the batch fold, however the results within the delay are dealt to
    micro-batches. A result at or before an instant of its league that is folded already comes out flagged late, without ratings.

    results: league, season, match_id, available_at, match_date, home_team, away_team, home_goals, away_goals. State is the
    standings of each league's teams and the results of the delay. Needs the RocksDB state store. The watermark is kept on a
    copy of available_at that is dropped, as Spark would silently drop late rows of a column that bears it.
    """
    marked = results.withColumn("__clock", F.col("available_at")).withWatermark("__clock", delay).drop("__clock")
    return marked.groupBy("league").transformWithStateInPandas(RatingFold(params), RATED, "append", "EventTime")


def versioned_append(path: str, keys: Sequence[str], watched: Sequence[str]):
    """A foreachBatch function that appends new versions of changed rows to a ledger of Parquet files.

    A batch is written under its own number, so a batch that is repeated after a failure replaces itself.
    """

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("row_id", F.concat_ws(":", F.lit(number).cast("string"), *keys))
        schema = T.StructType([*rows.schema.fields, T.StructField("version", T.IntegerType()), T.StructField("supersedes", T.StringType()), T.StructField("batch", T.IntegerType())])
        old = spark.read.schema(schema).parquet(path).where(F.col("batch") < number) if _has_files(spark, path) else spark.createDataFrame([], schema)
        new = changed(rows, old, keys, watched).withColumn("version", F.col("version").cast("int"))
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return append
