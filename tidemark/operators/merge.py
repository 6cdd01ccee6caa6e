"""Merging records of several sources into one row per event, with every disagreement kept."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ledger import canonical


def rank(source: Column, priority: Sequence[str]) -> Column:
    """Place of a source in the priority list; unknown ones last."""
    return F.coalesce(*(F.when(source == s, F.lit(i)) for i, s in enumerate(priority)), F.lit(99))


def cluster(records: DataFrame, keys: Sequence[str], source: str = "source", date: str = "match_date", gap_days: int = 3, single_any_gap: bool = True) -> DataFrame:
    """records with cluster (from 0): records of a pairing by date, each joins the nearest cluster that has none of its
    source and lies within the gap (of equal ones the first); a lone cluster takes any gap if single_any_gap. A record without a date is near to none.

    Rows stream through in the order of their pairings, so the state is one pairing's. Its clusters are held by the sources they have and by
    their last day, so that a record costs as many steps as there are such sets of sources, however many clusters the pairing has.
    """
    names, ties = records.columns, [c for c in records.columns if c.endswith("key") and c not in keys]
    schema = T.StructType([*records.schema.fields, T.StructField("cluster", T.IntegerType())])
    at_keys, at_source = [names.index(k) for k in keys], names.index(source)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict = {}  # a bit for each source
        before, undated, n_clusters = None, 0, 0
        held: dict[int, dict[int, list[int]]] = {}  # sources of a cluster -> its last day, ascending -> heap of clusters
        for batch in batches:
            if not batch.num_rows:
                continue
            begins = np.zeros(batch.num_rows, bool)
            for i in at_keys:
                codes = batch.column(i).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
                begins[1:] |= codes[1:] != codes[:-1]
            first, before = before, [batch.column(i)[-1].as_py() for i in at_keys]
            begins[0] = first != [batch.column(i)[0].as_py() for i in at_keys]
            coded = batch.column(at_source).dictionary_encode("encode")
            of = [bits.setdefault(s, 1 << len(bits)) for s in coded.dictionary.to_pylist()]
            out = []
            for new, d, s in zip(begins.tolist(), batch.column(len(names)).to_pylist(), coded.indices.to_pylist(), strict=True):
                if new:
                    held, n_clusters, undated = {}, 0, 0
                if d is None:  # these come first, each far from all others
                    undated += 1
                    d = (undated - 10**9) * 10**9
                best = None
                for used, by_day in held.items():
                    if used & of[s] or not by_day:
                        continue
                    last = next(reversed(by_day))
                    if d - last > gap_days and n_clusters > 1:
                        by_day.clear()  # days only grow
                    elif best is None or (d - last, by_day[last][0]) < best[:2]:
                        best = d - last, by_day[last][0], used, last
                if best and (best[0] <= gap_days or (single_any_gap and n_clusters == 1)):
                    _, at, used, last = best
                    heapq.heappop(held[used][last])
                    if not held[used][last]:
                        del held[used][last]
                else:
                    at, used = n_clusters, 0
                    n_clusters += 1
                heapq.heappush(held.setdefault(used | of[s], {}).setdefault(d, []), at)
                out.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.int32())], names=[*names, "cluster"])

    dated = records.withColumn("__day", F.unix_date(F.col(date).cast("date")))
    return dated.repartition(*keys).sortWithinPartitions(*keys, date, source, *ties).mapInArrow(assign, schema)


def merged(records: DataFrame, keys: Sequence[str], results: Sequence[str], kickoffs: Sequence[str], buffer_hours: int = 3) -> DataFrame:
    """One row per cluster: score of the best source that has one, kickoff of the best exact source, availability, sources
    by priority, whether scores disagree, and a hash of all this that changes with it. One aggregation; each pick is a min_by
    over a rank."""
    r, k = rank(F.col("source"), results), rank(F.col("source"), kickoffs)
    scored, exact = F.col("home_goals").isNotNull(), F.col("kickoff").isNotNull()
    score = F.when(scored, F.struct("home_goals", "away_goals"))
    who = F.struct(F.when(scored, 0).otherwise(1).alias("a"), r.alias("b"), F.col("source").alias("c"), F.col("source_key").alias("d"))
    best = F.min_by(F.struct("source", "home_goals", "away_goals", "match_date"), who)
    out = records.groupBy(*keys, "cluster").agg(
        best.alias("p"), F.min_by("kickoff", F.when(exact, F.struct(k.alias("a"), F.col("source").alias("b")))).alias("kickoff"),
        F.transform(F.array_sort(F.collect_set(F.struct(r.alias("r"), F.col("source").alias("s")))), lambda x: x["s"]).alias("sources"),
        F.min(score).alias("__least"), F.max(score).alias("__most"), F.bool_or(F.col("status") == "SCHEDULED").alias("__open"), F.count("*").alias("n_records"),
    )
    day = F.coalesce(F.col("kickoff").cast("date"), F.col("p.match_date"))
    status = F.when(F.col("p.home_goals").isNotNull(), "FINISHED").when(F.col("__open"), "SCHEDULED").otherwise("UNKNOWN")
    available = F.when(status == "FINISHED", F.when(F.col("kickoff").isNotNull(), F.col("kickoff") + F.make_interval(hours=F.lit(buffer_hours))).otherwise(F.date_add(day, 1).cast("timestamp_ntz")))
    rows = out.select(
        *keys, "cluster", F.col("p.source").alias("primary_source"), day.alias("match_date"), "kickoff", F.col("p.home_goals").alias("home_goals"), F.col("p.away_goals").alias("away_goals"),
        status.alias("status"), available.alias("available_at"), "sources", "n_records", F.coalesce(F.col("__least") < F.col("__most"), F.lit(False)).cast("int").alias("disputed"),
    )
    return rows.withColumn("data_version", F.substring(F.sha2(canonical(["match_date", "kickoff", "home_goals", "away_goals", "status", "available_at", "sources", "disputed"]), 256), 1, 16))


def conflicts(records: DataFrame, merged_rows: DataFrame, keys: Sequence[str], minutes: int = 20) -> DataFrame:
    """Disagreements of each record with its merged row: score, match_date (over a day apart), kickoff (over the minutes); and
    half-time scores (ht_home, ht_away, if the records have them) that differ from those of the primary source's record."""
    half = {"ht_home", "ht_away"} <= set(records.columns)
    if half:
        first = records.select(*keys, "cluster", F.col("source").alias("primary_source"), F.col("ht_home").alias("__hh"), F.col("ht_away").alias("__ha")).where("__hh IS NOT NULL AND __ha IS NOT NULL").dropDuplicates([*keys, "cluster", "primary_source"])
        merged_rows = merged_rows.join(first, [*keys, "cluster", "primary_source"], "left")
    m = merged_rows.select(*(["__hh", "__ha"] if half else []), *keys, "cluster", "primary_source", F.col("home_goals").alias("h"), F.col("away_goals").alias("a"), F.col("match_date").alias("d"), F.col("kickoff").alias("k"))
    j = records.join(m, [*keys, "cluster"])
    text = lambda x, y: F.concat_ws("-", x.cast("string"), y.cast("string"))
    row = lambda field, mine, other: F.struct(F.lit(field).alias("field"), mine.cast("string").alias("primary_value"), other.cast("string").alias("other_value"))
    apart = F.abs(F.unix_micros(F.col("kickoff").cast("timestamp")) - F.unix_micros(F.col("k").cast("timestamp"))) / 60e6
    found = F.array_compact(
        F.array(
            F.when(F.col("home_goals").isNotNull() & F.col("h").isNotNull() & ((F.col("home_goals") != F.col("h")) | (F.col("away_goals") != F.col("a"))), row("score", text(F.col("h"), F.col("a")), text(F.col("home_goals"), F.col("away_goals")))),
            F.when(F.abs(F.datediff("match_date", "d")) > 1, row("match_date", F.col("d"), F.col("match_date"))),
            F.when(apart > minutes, row("kickoff", F.col("k"), F.col("kickoff"))),
            *([F.when((F.col("ht_home") != F.col("__hh")) | (F.col("ht_away") != F.col("__ha")), row("half_time", text(F.col("__hh"), F.col("__ha")), text(F.col("ht_home"), F.col("ht_away"))))] if half else []),
        )
    )
    return j.select(*keys, "cluster", "primary_source", "source", "source_key", F.explode(found).alias("c")).select(*keys, "cluster", "primary_source", "source", "source_key", "c.*")


def merged_stats(rows: DataFrame, keys: Sequence[str], stats: str, source: str, priority: Sequence[str]) -> DataFrame:
    """Maps of all sources merged; the best-ranked source wins per entry."""
    each = rows.select(*keys, F.col(source).alias("__s"), F.explode(stats).alias("__k", "__v"))
    one = each.groupBy(*keys, "__k").agg(F.min_by("__v", F.struct(rank(F.col("__s"), priority), "__s")).alias("__v"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "__v")))).alias(stats))


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Insert-or-ignore: the first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def duplicate_ordinals(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, with '#n' appended from its second row on."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("__n", n).withColumn(key, F.when(F.col("__n") > 0, F.concat(F.col(key).cast("string"), F.lit("#"), F.col("__n").cast("string"))).otherwise(F.col(key).cast("string"))).drop("__n")
