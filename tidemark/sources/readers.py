"""Source formats: files to (matches, prices, issues) DataFrames. All text is read as strings and cast with checks."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import partial
from itertools import islice, zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators.merge import duplicate_ordinals

# The codes of bookmakers in the column names of wide files (B365H, PSCD, Max>2.5, ...) and the names of their books.
BOOKS = {
    "1XB": "1xbet",
    "Avg": "agg_avg",
    "B365": "bet365",
    "BF": "betfair_sportsbook",
    "BFE": "betfair_exchange",
    "BS": "bluesquare",
    "BW": "bwin",
    "BbAv": "agg_betbrain_avg",
    "BbMx": "agg_betbrain_max",
    "CL": "coral",
    "GB": "gamebookers",
    "IW": "interwetten",
    "LB": "ladbrokes",
    "Max": "agg_max",
    "P": "pinnacle",
    "PS": "pinnacle",
    "SB": "sportingbet",
    "SJ": "stanjames",
    "SO": "sportingodds",
    "SY": "stanleybet",
    "VC": "vcbet",
    "WH": "williamhill",
}
ZONE = "Europe/London"


def _prefixes() -> str:
    return "|".join(sorted(BOOKS, key=lambda x: (-len(x), x)))


def raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column a string, in file order of rows (raw_row within its file)."""
    out = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = [c for c in out.columns if c.strip() and not c.startswith("_c")]
    return out.select(*(F.col(f"`{c}`").alias(c.strip()) for c in names)).withColumn("raw_row", F.monotonically_increasing_id())


def required(df: DataFrame, columns: list[str]) -> list[str]:
    """Missing columns."""
    return [c for c in columns if c not in df.columns]


def results_csv(spark: SparkSession, path: str, tiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results files with Date, Season, home, visitor, hgoal, vgoal, tier. tiers: tier, competition. (matches, issues)"""
    raw = raw_csv(spark, path)
    if missing := required(raw, ["Date", "Season", "home", "visitor", "hgoal", "vgoal", "tier"]):
        raise ValueError(f"missing columns {missing}")
    rows = raw.join(tiers, "tier")
    parsed = rows.select(
        "competition", F.col("Date").try_cast("date").alias("match_date"), F.col("Season").try_cast("int").alias("season"), F.trim("home").alias("home"), F.trim("visitor").alias("away"),
        F.col("hgoal").try_cast("int").alias("home_goals"), F.col("vgoal").try_cast("int").alias("away_goals"), F.lit("DATE_ONLY").alias("time_quality"), F.lit("FINISHED").alias("status"), "raw_row",
    )
    bad = F.col("match_date").isNull() | F.col("season").isNull() | F.col("home_goals").isNull() | F.col("away_goals").isNull()
    good = duplicate_ordinals(parsed.where(~bad).withColumn("source_key", N.natural_key("competition", "match_date", "home", "away")), "source_key", "raw_row")
    return good, parsed.where(bad).select(F.lit("ERROR").alias("severity"), F.lit("PARSE").alias("code"), "raw_row")


ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")
ROWS = 2000  # of a file that are held as cells at once


def seasonal_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, row (from 0) and cells (column name to text) of CSV files that each have their own encoding and header.

    A file is one row of its task, which holds its bytes but no more than some rows of its cells at once. The first encoding
    that decodes all of it counts. Cells past the header are left out, cells that a row lacks are empty, empty rows are
    skipped; an empty file is one row without cells. Spark reads the bytes, so any path that Spark can read will do.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for where, content in zip(batch.column(0), batch.column(1)):
                content = content.as_buffer()
                encoding = next(e for e in ENCODINGS if _decodes(content, e))
                lines = csv.reader(_text(content, encoding))
                header = [name.strip() for name in next(lines, [])]
                rows = ((i, [(name, value.strip()) for name, value in zip_longest(header, row[: len(header)], fillvalue="") if name]) for i, row in enumerate(lines) if any(map(str.strip, row)))
                first = True
                while cells := list(islice(rows, ROWS)) or [(0, [])] * (first and not header):
                    first = False
                    yield pa.RecordBatch.from_arrays([pa.array([where.as_py()] * len(cells), pa.string()), pa.array([i for i, _ in cells], pa.int64()), pa.array([x for _, x in cells], kind)], names=["path", "row", "cells"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(parsed, "path string, row bigint, cells map<string,string>")


def _text(content: pa.Buffer, encoding: str) -> io.TextIOWrapper:
    return io.TextIOWrapper(pa.BufferReader(content), encoding=encoding, newline="")


def _decodes(content: pa.Buffer, encoding: str) -> bool:
    try:
        return all(iter(partial(_text(content, encoding).read, 1 << 20), ""))
    except UnicodeDecodeError:
        return False


def wide_csv(spark: SparkSession, path: str, divisions: DataFrame, acquired: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Wide result files with one column per book, market and selection: (matches, prices, issues). divisions: Div, competition.

    Each file's own header says what its cells are, so files of many seasons may lie in one folder. Odds of 1 or less are
    dropped. Closing prices are stamped at kickoff (or the next local midnight), others at the weekly collection, or at
    acquired for files of coming fixtures.
    """
    raw = seasonal_rows(spark, path)
    opt = lambda c: F.nullif(F.col("cells")[c], F.lit(""))
    rows = raw.withColumn("Div", opt("Div")).join(divisions, "Div")
    base = rows.withColumns({"match_date": N.day(opt("Date")), "home": F.coalesce(opt("HomeTeam"), opt("Home")), "away": F.coalesce(opt("AwayTeam"), opt("Away")), "__clock": opt("Time"), "raw_row": F.struct("path", "row")})
    base = base.withColumn("kickoff", N.to_utc(F.col("match_date"), F.col("__clock"), ZONE)).withColumn("source_key", N.natural_key("Div", "match_date", "home", "away"))
    empty = raw.where(F.size("cells") == 0).select(F.lit("ERROR").alias("severity"), F.lit("EMPTY").alias("code"), "path", "row")
    issues = empty.unionByName(base.where("match_date IS NULL").select(F.lit("ERROR").alias("severity"), F.lit("PARSE").alias("code"), "path", "row"))
    base = duplicate_ordinals(base.where("match_date IS NOT NULL"), "source_key", "raw_row")
    either = lambda *names: F.coalesce(*map(opt, names))
    goals = {"home_goals": N.whole(either("FTHG", "HG")), "away_goals": N.whole(either("FTAG", "AG")), "ht_home": N.whole(opt("HTHG")), "ht_away": N.whole(opt("HTAG"))}
    matches = base.withColumns(goals).withColumn("status", F.when(F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull(), "FINISHED").otherwise("SCHEDULED"))
    matches = matches.select("source_key", "competition", "match_date", "kickoff", "home", "away", *goals, "status", N.season_start(F.col("match_date")).alias("season"), F.when(F.col("kickoff").isNotNull(), "EXACT").otherwise("DATE_ONLY").alias("time_quality"))
    p = _prefixes()
    shapes = {"1X2": rf"^({p})(C?)([HDA])$", "OU": rf"^({p})(C?)([<>])2\.5$", "AH": rf"^({p})(C?)AH([HA])$"}
    lines = {"__pre": N.number(either("AHh", "BbAHh")), "__close": N.number(opt("AHCh"))}
    priced = F.map_filter("cells", lambda k, v: F.regexp_like(k, F.lit("|".join(shapes.values()))))
    long = base.withColumns(lines).select("source_key", "match_date", "kickoff", *lines, F.explode(priced).alias("__c", "__v")).withColumn("odds", N.number(F.col("__v"))).where("odds > 1")
    part = lambda g: F.coalesce(*(F.nullif(F.regexp_extract("__c", s, g), F.lit("")) for s in shapes.values()))
    market = F.coalesce(*(F.when(F.col("__c").rlike(s), m) for m, s in shapes.items()))
    closing = F.coalesce(part(2), F.lit("")) == "C"
    books = F.create_map(*(x for k, v in BOOKS.items() for x in (F.lit(k), F.lit(v))))
    side = part(3)
    selection = F.when(market == "1X2", side).when(side == ">", "OVER").when(side == "<", "UNDER").when(side == "H", "AH_HOME").otherwise("AH_AWAY")
    line = F.when(market == "OU", F.lit(2.5)).when(market == "AH", F.when(closing, F.col("__close")).otherwise(F.col("__pre")))
    before = F.lit(acquired).cast("timestamp") if acquired else N.weekly_collection(F.col("match_date"), F.col("kickoff"))
    seen = F.when(closing, F.coalesce("kickoff", N.next_midnight(F.col("match_date"), ZONE))).otherwise(before)
    prices = long.select("source_key", F.element_at(books, part(1)).alias("book"), market.alias("market"), selection.alias("selection"), line.alias("line"), "odds", F.when(closing, "CLOSING").otherwise("PRE_MATCH").alias("snapshot"), seen.alias("seen_at"))
    return matches, prices.where("market <> 'AH' OR line IS NOT NULL"), issues


def nested_json(spark: SparkSession, path: str, zone: str, today: str) -> tuple[DataFrame, DataFrame]:
    """Files with matches[] (or rounds[].matches[]); teams as text or objects; scores as objects or pairs. (matches, issues)

    Fields that change shape are read as variants, so that a file of either shape, or of both, is one scan.
    """
    match = "array<struct<round:string,date:string,time:string,team1:variant,team2:variant,score:variant>>"
    docs = spark.read.schema(f"name string, matches {match}, rounds array<struct<matches:{match}>>").option("multiLine", True).json(path)
    each = docs.select("name", F.posexplode(F.coalesce("matches", F.flatten("rounds.matches"))).alias("i", "m"))
    get = lambda c, p, t: F.try_variant_get(F.col(c), p, t)
    team = lambda c: F.coalesce(get(c, "$.name", "string"), F.when(F.schema_of_variant(F.col(c)) == "STRING", get(c, "$", "string")))
    goal = lambda part, i: F.coalesce(get("m.score", f"$.{part}[{i}]", "int"), get("m.score", f"$[{i}]", "int") if part == "ft" else F.lit(None).cast("int"))
    rows = each.select(
        "name", "i", F.col("m.date").try_cast("date").alias("match_date"), F.trim("m.time").alias("clock"), F.trim(team("m.team1")).alias("home"), F.trim(team("m.team2")).alias("away"),
        goal("ft", 0).alias("home_goals"), goal("ft", 1).alias("away_goals"), goal("ht", 0).alias("ht_home"), goal("ht", 1).alias("ht_away"), F.schema_of_variant(F.col("m.score")).startswith("ARRAY").alias("__pair"),
    )
    bad = F.col("match_date").isNull() | F.col("home").isNull() | F.col("away").isNull()
    issue = lambda df, severity, code: df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "name", "i")
    issues = issue(rows.where(bad), "ERROR", "PARSE").unionByName(issue(rows.where(F.col("__pair")), "WARN", "FORMAT_DRIFT"))
    good = rows.where(~bad).withColumn("kickoff", N.to_utc(F.col("match_date"), F.col("clock"), zone))
    status = F.when(F.col("home_goals").isNotNull(), "FINISHED").when(F.col("match_date") >= F.lit(today).cast("date"), "SCHEDULED").otherwise("UNKNOWN")
    good = good.withColumn("status", status).withColumn("source_key", N.natural_key("name", "match_date", "home", "away"))
    return duplicate_ordinals(good.drop("__pair"), "source_key", "i"), issues


SQUAD = "array<struct<name:string>>"
LISTED = (
    "match_id bigint, match_date string, kick_off string, home_score int, away_score int, match_week int, season struct<season_id:bigint,season_name:string>, competition_stage struct<name:string>,"
    f" home_team struct<home_team_name:string,managers:{SQUAD}>, away_team struct<away_team_name:string,managers:{SQUAD}>, stadium struct<name:string>, referee struct<name:string>"
)


def match_array_json(spark: SparkSession, path: str, zone: str) -> tuple[DataFrame, DataFrame]:
    """Files that are one array of matches with nested teams: (matches, issues). Kickoffs are local and only approximate."""
    raw = spark.read.schema(LISTED).option("multiLine", True).json(path)
    names = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(SQUAD)), lambda x: x["name"])
    rows = raw.select(
        F.col("match_id").alias("source_key"), F.col("match_date").try_cast("date").alias("match_date"), F.substring("kick_off", 1, 5).alias("clock"), F.trim("home_team.home_team_name").alias("home"), F.trim("away_team.away_team_name").alias("away"),
        F.col("home_score").alias("home_goals"), F.col("away_score").alias("away_goals"), "match_week", F.col("season.season_name").alias("season"), F.col("competition_stage.name").alias("stage"), F.col("stadium.name").alias("stadium"),
        F.col("referee.name").alias("referee"), names("home_team.managers").alias("home_managers"), names("away_team.managers").alias("away_managers"),
    )
    bad = F.col("match_date").isNull() | F.col("home").isNull() | F.col("away").isNull()
    good = rows.where(~bad).withColumn("kickoff", N.to_utc(F.col("match_date"), F.col("clock"), zone))
    good = good.withColumn("time_quality", F.when(F.col("kickoff").isNotNull(), "APPROXIMATE").otherwise("DATE_ONLY")).withColumn("status", F.when(F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull(), "FINISHED").otherwise("SCHEDULED"))
    return good, rows.where(bad).select(F.lit("ERROR").alias("severity"), F.lit("PARSE").alias("code"), "source_key")


def local_matches(spark: SparkSession, path: str, zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """A user's own matches: competition_id, season, date, time, home, away, home_goals, away_goals, status. (matches, issues)
    A status left empty follows from whether there is a score."""
    raw = raw_csv(spark, path)
    wanted = ["competition_id", "season", "date", "time", "home", "away", "home_goals", "away_goals", "status"]
    if missing := required(raw, wanted):
        raise ValueError(f"missing columns {missing}")
    rows = raw.select(
        F.nullif("competition_id", F.lit("")).alias("competition"), F.col("season").try_cast("int").alias("season"), F.col("date").try_cast("date").alias("match_date"), F.trim("time").alias("clock"), F.nullif(F.trim("home"), F.lit("")).alias("home"),
        F.nullif(F.trim("away"), F.lit("")).alias("away"), N.whole(F.col("home_goals")).alias("home_goals"), N.whole(F.col("away_goals")).alias("away_goals"), F.nullif(F.upper(F.trim("status")), F.lit("")).alias("given"), "raw_row",
    )
    bad = F.col("competition").isNull() | F.col("match_date").isNull() | F.col("home").isNull() | F.col("away").isNull()
    scored = F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull()
    good = rows.where(~bad).withColumn("kickoff", N.to_utc(F.col("match_date"), F.col("clock"), zone)).withColumn("status", F.coalesce("given", F.when(scored, "FINISHED").otherwise("SCHEDULED")))
    good = good.withColumn("source_key", N.natural_key("competition", "match_date", "home", "away")).drop("given")
    return duplicate_ordinals(good, "source_key", "raw_row"), rows.where(bad).select(F.lit("ERROR").alias("severity"), F.lit("PARSE").alias("code"), "raw_row")


EVENT = "array<struct<type:struct<name:string>,team:struct<name:string>,shot:struct<expected:double,outcome:struct<name:string>>>>"


def shot_totals(events: DataFrame, key: str) -> DataFrame:
    """Shots, shots on target and expected goals of each team. events: key, type, team, outcome, expected."""
    on = F.col("outcome").isin("Goal", "Saved", "Saved to Post")
    return events.where("type = 'Shot'").groupBy(key, "team").agg(F.count("*").alias("shots"), F.count_if(on).alias("on_target"), F.sum(F.coalesce("expected", F.lit(0.0))).alias("expected_goals"))


def local_prices(spark: SparkSession, path: str, matches: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A user's prices: (prices, stub matches, issues). allowed: market, selection. A price needs a time with a zone.

    Prices without a match row get a stub fixture, which never replaces a match that is there.
    """
    raw = raw_csv(spark, path).withColumn("source_key", N.natural_key("competition", "date", "home", "away"))
    zoned = F.col("captured_at").rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$")
    rows = raw.withColumn("seen_at", F.when(zoned, F.col("captured_at").try_cast("timestamp"))).withColumn("odds", N.number(F.col("odds")))
    known = rows.join(F.broadcast(allowed.withColumn("__ok", F.lit(True))), ["market", "selection"], "left")
    code = F.when(F.col("seen_at").isNull(), "BAD_TIMESTAMP").when(F.col("__ok").isNull(), "BAD_SELECTION").when(F.col("odds").isNull(), "PARSE")
    judged = known.withColumn("code", code)
    good = judged.where("code IS NULL").select("source_key", "competition", "date", "home", "away", "bookmaker", "market", "selection", "odds", "seen_at")
    stubs = good.select("source_key", "competition", F.col("date").try_cast("date").alias("match_date"), "home", "away").distinct().join(matches.select("source_key"), "source_key", "left_anti")
    return good, stubs, judged.where("code IS NOT NULL").select(F.lit("ERROR").alias("severity"), "code", "raw_row")
