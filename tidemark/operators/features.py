"""Team form from results, as of each match: only earlier days count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_form(matches: DataFrame, home: str = "home_team", away: str = "away_team", home_goals: str = "home_goals", away_goals: str = "away_goals") -> DataFrame:
    """Two rows a match: team, opponent, side, goals for and against, points (3, 1, 0; null without goals)."""
    row = lambda side, t, o, gf, ga: F.struct(F.lit(side).alias("side"), F.col(t).alias("team"), F.col(o).alias("opponent"), F.col(gf).alias("gf"), F.col(ga).alias("ga"))
    sides = F.explode(F.array(row("home", home, away, home_goals, away_goals), row("away", away, home, away_goals, home_goals)))
    rest = [c for c in matches.columns if c not in (home, away, home_goals, away_goals)]
    out = matches.select(*rest, sides.alias("s")).select(*rest, "s.*")
    return out.withColumn("points", F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).when(F.col("gf") < F.col("ga"), 0))


def team_form(rows: DataFrame, key: str = "match_id", team: str = "team", league: str = "league", date: str = "match_date", season: str = "season") -> DataFrame:
    """rows: long form, with played true where the result counts. Per row the form before its day:

    points of the last 5, goals for and against of the last 10 (same league), matches of the last 365 and 14 days and days
    of rest (all leagues), promoted and new_to_league. Rows are put together by team, league and day first, so no group holds a team's rows.
    """
    day = F.datediff(F.col(date), F.lit("1970-01-01")).cast("int")
    rows = rows.withColumn("__day", day).withColumn("__played", F.col("played").cast("int"))
    keys = [team, league, "__day"]
    # A day's last ten rows; then the last ten at the end of each day that has some. Newest first.
    newest = Window.partitionBy(*keys).orderBy(F.desc(key))
    ten = rows.where("__played = 1").select(*keys, key, "points", "gf", "ga").withColumn("__n", F.row_number().over(newest)).where("__n <= 10")
    lists = ten.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__n", "points", "gf", "ga"))).alias("__day_last"))
    ends = Window.partitionBy(team, league).orderBy("__day").rowsBetween(-9, 0)
    lists = lists.select(*(F.col(c).alias(f"{c}__") for c in keys), F.slice(F.flatten(F.reverse(F.collect_list("__day_last").over(ends))), 1, 10).alias("__last"))
    # One row a team, league and day, however many matches the day has: windows run over these.
    per = rows.groupBy(*keys).agg(F.sum("__played").alias("__matches"), F.max(F.when(F.col("__played") == 1, F.col(season))).alias("__seen_season"))
    per = per.join(lists, [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in keys], "left").drop(*(f"{c}__" for c in keys))
    before = Window.partitionBy(team).orderBy("__day")
    days = lambda n: before.rangeBetween(-n, -1)
    w = Window.partitionBy(team, league).orderBy("__day").rangeBetween(Window.unboundedPreceding, -1)
    mean = lambda c, n: F.aggregate(F.filter(F.transform(F.slice("__l", 1, n), lambda x: x[c]), lambda x: x.isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")), lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))
    form = per.withColumns(
        {
            "__l": F.last("__last", ignorenulls=True).over(w), "__first": F.min("__seen_season").over(w), "__seasons": F.collect_set("__seen_season").over(w),
            "matches_365d": F.coalesce(F.sum("__matches").over(days(364)), F.lit(0)), "matches_14d": F.coalesce(F.sum("__matches").over(days(13)), F.lit(0)),
            "rest_days": F.col("__day") - F.max(F.when(F.col("__matches") > 0, F.col("__day"))).over(before.rangeBetween(Window.unboundedPreceding, -1)),
        }
    )
    form = form.select(
        *(F.col(c).alias(f"{c}__") for c in keys), "matches_365d", "matches_14d", "rest_days", mean("points", 5).alias("points_last5"), mean("gf", 10).alias("gf_last10"), mean("ga", 10).alias("ga_last10"),
        F.col("__l").isNull().alias("__new"), "__first", "__seasons",
    )
    out = rows.join(form, [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in keys])
    return out.select(
        key, "side", team, "matches_365d", "matches_14d", "rest_days", "points_last5", "gf_last10", "ga_last10",
        (~F.col("__new") & ~F.array_contains("__seasons", F.col(season) - 1) & (F.col("__first") < F.col(season))).cast("int").alias("promoted"), F.col("__new").cast("int").alias("new_to_league"),
    )


def league_level(matches: DataFrame, league: str = "league", date: str = "match_date", days: int = 730) -> DataFrame:
    """Mean goals per team of each league and day over the days before it: sums per day, then a range window over days."""
    per = matches.groupBy(league, date).agg(F.sum(F.col("home_goals") + F.col("away_goals")).alias("__g"), F.count("*").alias("__n"))
    per = per.withColumn("__day", F.datediff(F.col(date), F.lit("1970-01-01")).cast("int"))
    w = Window.partitionBy(league).orderBy("__day").rangeBetween(-(days - 1), -1)
    return per.select(league, date, (F.sum("__g").over(w) / F.sum("__n").over(w) / 2).alias("goals_level"))


def base_rates(matches: DataFrame, by: str = "league", date: str = "match_date", days: int = 1825, strength: float = 30.0, prior: tuple[float, float, float] = (0.45, 0.28, 0.27)) -> DataFrame:
    """Smoothed home, draw and away rates of each group and day from the days before it."""
    hit = lambda c: F.sum(c.cast("int"))
    per = matches.groupBy(by, date).agg(hit(F.col("home_goals") > F.col("away_goals")).alias("__h"), hit(F.col("home_goals") == F.col("away_goals")).alias("__d"), hit(F.col("home_goals") < F.col("away_goals")).alias("__a"))
    per = per.withColumn("__day", F.datediff(F.col(date), F.lit("1970-01-01")).cast("int"))
    w = Window.partitionBy(by).orderBy("__day").rangeBetween(-(days - 1), -1)
    n = F.coalesce(F.sum(F.col("__h") + F.col("__d") + F.col("__a")).over(w), F.lit(0))
    rate = lambda c, p: ((F.coalesce(F.sum(c).over(w), F.lit(0)) + strength * p) / (n + strength))
    return per.select(by, date, n.alias("n"), rate("__h", prior[0]).alias("p_home"), rate("__d", prior[1]).alias("p_draw"), rate("__a", prior[2]).alias("p_away"))
