"""Resolution of raw names to known entities, by rules and by the fixtures they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..sources.scratch import written


def resolve_static(raw: DataFrame, aliases: DataFrame, by: str = "country", name: str = "raw", alias: str = "alias", team: str = "team") -> DataFrame:
    """by, name, team, method, candidates for each distinct raw name.

    REGISTRY: equal but for case and outer blanks; NORMALIZED: one team has the cleaned name; AMBIGUOUS: several have it, or
    one name's words are part of the other's; NEW_ENTITY otherwise. Subset candidates join on single words, not on all
    pairs of names.
    """
    r = raw.select(by, name).distinct().withColumn("__t", N.tokens(F.col(name))).withColumn("__n", F.array_join("__t", " "))
    a = aliases.select(by, F.col(team).alias("__team"), F.lower(F.trim(alias)).alias("__l"), N.tokens(F.col(alias)).alias("__at")).withColumn("__an", F.array_join("__at", " "))
    exact = r.join(a.select(by, "__l", "__team").distinct(), [F.lower(F.trim(name)) == F.col("__l"), r[by] == a[by]]).select(r[by], name, F.col("__team").alias("__x")).groupBy(by, name).agg(F.min("__x").alias("__exact"))
    normal = r.where("__n <> ''").join(a.select(by, F.col("__an").alias("__n"), "__team").distinct(), [by, "__n"]).groupBy(by, name).agg(F.array_sort(F.collect_set("__team")).alias("__normal"))
    words = lambda df, t: df.select("*", F.explode(F.array_distinct(t)).alias("__w"))
    part = words(r, "__t").join(words(a.select(by, "__team", "__at").distinct(), "__at"), [by, "__w"])
    inside = F.size(F.array_intersect("__t", "__at")) == F.least(F.size(F.array_distinct("__t")), F.size(F.array_distinct("__at")))
    subset = part.where(inside).groupBy(by, name).agg(F.array_sort(F.collect_set("__team")).alias("__subset"))
    out = r.join(exact, [by, name], "left").join(normal, [by, name], "left").join(subset, [by, name], "left")
    one = F.size("__normal") == 1
    method = F.when(F.col("__exact").isNotNull(), "REGISTRY").when(one, "NORMALIZED").when(F.col("__normal").isNotNull() | F.col("__subset").isNotNull(), "AMBIGUOUS").otherwise("NEW_ENTITY")
    return out.select(by, name, F.coalesce("__exact", F.when(one, F.col("__normal")[0])).alias(team), method.alias("method"), F.coalesce("__normal", "__subset", F.array().cast("array<string>")).alias("candidates"))


def cooccurrence(fixtures: DataFrame, resolved: DataFrame, reference: DataFrame, least: int = 3, share: float = 0.9) -> DataFrame:
    """raw, team, votes, total, method: teams whose known fixtures line up with those of an unknown name.

    fixtures: raw, opponent_raw, side, match_date; resolved: raw, team of known names of the source; reference: team,
    opponent, side, match_date. A fixture votes for the opponents that its known opponent met on the other side on that
    day, else the day before, else the day after. total counts the fixtures that vote: one that votes for several teams, as
    where opponents play several times a day, is one. Several teams with most votes leave a name ambiguous.
    """
    known = resolved.select(F.col("raw").alias("opponent_raw"), F.col("team").alias("__o"))
    mine = fixtures.join(resolved.select("raw"), "raw", "left_anti").join(known, "opponent_raw").withColumn("__f", F.monotonically_increasing_id())
    tries = F.explode(F.array(*(F.struct(F.lit(i).alias("pref"), F.lit(d).alias("delta")) for i, d in enumerate((0, -1, 1)))))
    asked = mine.select("raw", "side", "match_date", "__o", tries.alias("t")).withColumn("__day", F.date_add("match_date", F.col("t.delta")))
    ref = reference.select(F.col("team").alias("__o"), F.col("match_date").alias("__day"), F.when(F.col("side") == "H", "A").otherwise("H").alias("side"), F.col("opponent").alias("team"))
    hits = asked.join(ref, ["__o", "__day", "side"])
    fixture = ["raw", "side", "match_date", "__o"]
    best = hits.groupBy(*fixture).agg(F.min("t.pref").alias("__p"))
    votes = hits.join(best, fixture).where(F.col("t.pref") == F.col("__p")).select(*fixture, "team").distinct().groupBy("raw", "team").agg(F.count("*").alias("votes"))
    total = best.groupBy("raw").agg(F.count("*").alias("total"))
    first = Window.partitionBy("raw").orderBy(F.col("votes").desc(), F.col("team").cast("string").desc())
    ranked = votes.withColumn("__n", F.row_number().over(first))
    pick = lambda c: F.max(F.when(F.col("__n") == 1, F.col(c)))
    five = F.transform(F.array_sort(F.collect_list(F.when(F.col("__n") <= 5, F.struct("__n", "team")))), lambda x: x["team"])
    top = ranked.groupBy("raw").agg(pick("team").alias("best"), pick("votes").alias("votes"), F.max(F.when(F.col("__n") == 2, F.col("votes"))).alias("__next"), five.alias("candidates")).join(total, "raw")
    sure = (F.col("votes") >= least) & (F.col("votes") >= share * F.col("total")) & (F.col("votes") > F.coalesce("__next", F.lit(0)))
    return top.select("raw", F.when(sure, F.col("best")).alias("team"), "votes", "total", F.when(sure, "COOCCURRENCE").otherwise("AMBIGUOUS").alias("method"), "candidates")


def resolution_run(fixtures: DataFrame, known: DataFrame, reference: DataFrame, rounds: int = 3, least: int = 3, share: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(resolved, review): rounds of cooccurrence(), each with the names that the rounds before resolved.

    fixtures and reference as in cooccurrence(); known: raw, team by static rules. resolved: raw, team, method, round (0 for
    known ones); review: names left, with up to five candidates each, and names that share a team with another of one
    source, none of which is applied.
    """
    found = known.select("raw", "team", F.lit("STATIC").alias("method"), F.lit(0).alias("round"))
    for n in range(1, rounds + 1):
        now = written(found, "resolved")
        votes = written(cooccurrence(fixtures, now.select("raw", "team"), reference, least, share), "votes")
        found = now.unionByName(votes.where("team IS NOT NULL").select("raw", "team", "method", F.lit(n).alias("round")))
    found = written(found, "resolved")
    shared = found.groupBy("team").agg(F.count_distinct("raw").alias("__raws")).where("__raws > 1").select("team")
    twice = found.join(shared, "team", "left_semi")
    left = votes.where("team IS NULL").select("raw", F.lit("AMBIGUOUS").alias("reason"), F.col("candidates").cast("array<string>").alias("candidates"))
    review = left.unionByName(twice.select("raw", F.lit("SHARED_TEAM").alias("reason"), F.array(F.col("team").cast("string")).alias("candidates")))
    return found.join(shared, "team", "left_anti").select("raw", "team", "method", "round"), review


def not_injective(resolved: DataFrame, keys: tuple[str, ...] = ("source", "season"), raw: str = "raw", team: str = "team") -> DataFrame:
    """Teams that several raw names of one source stand for in one season: all of them are to be reviewed."""
    return resolved.groupBy(*keys, team).agg(F.array_sort(F.collect_set(raw)).alias("raws")).where(F.size("raws") > 1)


def alias_collisions(aliases: DataFrame, by: str = "country", alias: str = "alias", team: str = "team") -> DataFrame:
    """Aliases of one country that lead to several teams; must be empty."""
    return aliases.groupBy(by, F.lower(alias).alias("alias")).agg(F.count_distinct(team).alias("teams")).where("teams > 1")
