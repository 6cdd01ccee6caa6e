"""Elo ratings as a log of changes: results are folded once, and a forecast reads the ratings as of its own cutoff.

All results of an instant belong together: teams that are new to a season are seated from the ratings before the instant,
then its results are played in order, and the log has one row per team and instant with the ratings after it. A reader at a
cutoff takes each team's last row at or before it, and for a season that the team has not begun applies the seating rule to
the squad statistics of the same moment. So no result after the cutoff can reach the forecast.

Seating: a team that already played the season (or a later one) keeps its rating. A newcomer gets a low quantile of the
squad of the season before, or the start rating where there is none. A team that comes back is drawn toward that squad's
mean (toward the mean of all teams where there is none), and half way to a newcomer's rating if it missed the season before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pit


@dataclass(frozen=True)
class Elo:
    k: float = 20.0
    home: float = 65.0
    start: float = 1500.0
    regression: float = 0.20
    newcomer_quantile: float = 0.20
    scale: float = 400.0


def margin_factor(margin: Column | np.ndarray | int):
    """Weight of a win by so many goals."""
    size = abs(margin)
    return np.where(size < 2, 1.0, np.where(size == 2, 1.5, (size + 11.0) / 8.0))


class League:
    """Standings of one league: rating and the latest two seasons of each team."""

    def __init__(self, p: Elo, standings: Iterable[tuple[int, float, int, int]] = ()):
        self.p, self.rating, self.latest, self.before = p, {}, {}, {}
        for team, rating, latest, before in standings:
            self.rating[team], self.latest[team], self.before[team] = rating, latest, before

    def squad(self, season: int) -> tuple[float, float] | None:
        """Mean and newcomer's rating of the teams that played the season, by their ratings now."""
        found = np.array([r for t, r in self.rating.items() if season in (self.latest[t], self.before[t])])
        return (float(found.mean()), float(np.quantile(found, self.p.newcomer_quantile))) if len(found) else None

    def seat(self, season: int, teams: Iterable[int]) -> None:
        new = [t for t in dict.fromkeys(teams) if self.latest.get(t, season - 1) < season]
        if not new:
            return
        squad = self.squad(season - 1)
        mean, low = squad or (float(np.mean([*self.rating.values()] or [self.p.start])), self.p.start)
        for t in new:
            if t in self.rating:
                drawn = self.rating[t] + self.p.regression * (mean - self.rating[t])
                self.rating[t] = drawn if self.latest[t] == season - 1 else (drawn + low) / 2
            else:
                self.rating[t] = low
            self.latest[t], self.before[t] = season, self.latest.get(t, season - 1000)

    def instant(self, results: list[tuple]) -> list[tuple[float, float]]:
        """Ratings before each of an instant's results (season, home, away, home goals, away goals), which are then played."""
        for season in sorted({r[0] for r in results}):
            self.seat(season, (t for r in results if r[0] == season for t in r[1:3]))
        out = []
        for _, home, away, hg, ag in results:
            pair = self.rating[home], self.rating[away]
            expected = 1 / (1 + 10 ** (-(pair[0] - pair[1] + self.p.home) / self.p.scale))
            moved = float(self.p.k * margin_factor(hg - ag) * ((1.0 if hg > ag else 0.5 if hg == ag else 0.0) - expected))
            self.rating[home], self.rating[away] = pair[0] + moved, pair[1] - moved
            out.append(pair)
        return out


ORDER = ("available_at", "match_date", "match_id")
RESULT = ("season", "home_team", "away_team", "home_goals", "away_goals")


def folded(results: DataFrame, league: str = "league", params: Elo = Elo()) -> DataFrame:
    """Rows of three kinds, in the order of the fold: 'match' (ratings before a match: elo_home, elo_away), 'team' (team, rating
    and latest season after an instant) and 'squads' (season, and mean and newcomer's rating of its squad and of the one before,
    and the mean of all teams, after an instant). Leagues run in parallel; a league's results stream through one task."""
    kind = results.schema["available_at"].dataType.simpleString()
    names = ["kind", "league", "available_at", "match_id", "elo_home", "elo_away", "team", "rating", "season", "mean", "low", "before_mean", "before_low", "all_mean"]

    def closed(now: int, at, rows: list[tuple], state: League, out: list) -> None:
        for (ident, *_), pair in zip(rows, state.instant([r[1:] for r in rows])):
            out.append(("match", now, at, ident, *pair, *[None] * 8))
        for team in dict.fromkeys(t for r in rows for t in r[2:4]):
            out.append(("team", now, at, None, None, None, team, state.rating[team], state.latest[team], *[None] * 5))
        newest = max(state.latest.values())
        this, last = state.squad(newest), state.squad(newest - 1) or (None, None)
        out.append(("squads", now, at, None, None, None, None, None, newest, *this, *last, float(np.mean([*state.rating.values()]))))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, at, held = None, League(params), None, []
        for pdf in batches:
            out: list[tuple] = []
            for r in pdf.itertuples(index=False):
                if held and (r.league != now or r.available_at != at):
                    closed(now, at, held, state, out)
                    held = []
                if r.league != now:
                    now, state = r.league, League(params)
                at = r.available_at
                held.append((r.match_id, *(int(getattr(r, c)) for c in RESULT)))
            yield pd.DataFrame(out, columns=names)
        if held:
            out = []
            closed(now, at, held, state, out)
            yield pd.DataFrame(out, columns=names)

    slim = results.select("match_id", F.col(league).cast("int").alias("league"), "available_at", "match_date", *RESULT)
    ordered = slim.repartition(int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")), "league").sortWithinPartitions("league", *ORDER)
    schema = f"kind string, league int, available_at {kind}, match_id bigint, elo_home double, elo_away double, team int, rating double, season int, mean double, low double, before_mean double, before_low double, all_mean double"
    return ordered.mapInPandas(fold, schema).withColumnRenamed("league", league)


def history(fold: DataFrame, league: str = "league") -> DataFrame:
    """Ratings before each match, as the fold met them: what a link is fitted on."""
    return fold.where("kind = 'match'").select("match_id", league, "available_at", "elo_home", "elo_away")


def seated(rating: Column, latest: Column, season: Column, mean: Column, low: Column, all_mean: Column, params: Elo = Elo()) -> Column:
    """The seating rule as a column; mean and low are those of the squad of the season before, null where there is none."""
    low = F.coalesce(low, F.lit(params.start))
    drawn = rating + params.regression * (F.coalesce(mean, all_mean) - rating)
    return F.when(rating.isNull(), low).when(latest >= season, rating).when(latest == season - 1, drawn).otherwise((drawn + low) / 2)


def ratings_at(fixtures: DataFrame, fold: DataFrame, league: str = "league", params: Elo = Elo()) -> DataFrame:
    """fixtures (match_id, league, cutoff, season, home_team, away_team) with elo_home and elo_away as of their cutoffs."""
    teams = fold.where("kind = 'team'").select(league, "team", "available_at", "rating", F.col("season").alias("latest"))
    squads = fold.where("kind = 'squads'").select(league, "available_at", F.struct("season", "mean", "low", "before_mean", "before_low", "all_mean").alias("squads"))
    asked = pit.asof_join(fixtures.select(league, "cutoff").distinct(), squads, [league], "cutoff", "available_at", ["squads"]).drop("available_at")
    sides = fixtures.select("match_id", league, "cutoff", "season", F.explode(F.array(F.struct(F.lit("home").alias("side"), F.col("home_team").alias("team")), F.struct(F.lit("away").alias("side"), F.col("away_team").alias("team")))).alias("x"))
    sides = pit.asof_join(sides.select("match_id", league, "cutoff", "season", "x.side", "x.team"), teams, [league, "team"], "cutoff", "available_at", ["rating", "latest"]).drop("available_at")
    s, season = F.col("squads"), F.col("season")
    of = lambda now, before: F.when(season == s["season"] + 1, s[now]).when(season == s["season"], s[before])
    read = sides.join(asked, [league, "cutoff"]).withColumn("elo", seated(F.col("rating"), F.col("latest"), season, of("mean", "before_mean"), of("low", "before_low"), s["all_mean"], params))
    side = lambda name: F.max(F.when(F.col("side") == name, F.col("elo"))).alias(f"elo_{name}")
    return fixtures.join(read.groupBy("match_id").agg(side("home"), side("away")), "match_id")
