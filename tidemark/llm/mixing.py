"""Mixing sources by temperature. DataFrame functions only.

A source's weight is its token share to the power of an exponent in [0, 1], normalised: 1 keeps the natural mix, 0 makes
all sources equal. The exponent is bisected: the largest that reaches the target entropy (a share of the logarithm of
the number of sources), raised as far as needed to keep every source within the repetition limit, which wins. One
aggregation over the table of sources answers 64 bisection points at a time, so the driver sees only scalars.

The weights are realised as block permutations. A source's documents are dealt by hash to blocks of about
``block_tokens`` tokens or ``block_rows`` rows, whichever makes more blocks; every whole epoch takes all blocks, the last
one takes blocks in a hashed order until the source's budget is used up, and of its last block documents in a hashed order.
Sums run over documents of a block, over blocks of a stretch of that order (a 4096th of it) and over the stretches of a
source, never over all documents or blocks of a source, so a source with a third of all rows, with or without words, is
no hot task.

With no ``budget_tokens`` the budget is the smallest that gives each source at least one whole epoch, so no document is
lost; a smaller budget thins out the sources above their weight.

Defined results: a null source is a source of its own; null and empty texts have no tokens and come along with their
source's whole epochs (and with the last one while its budget lasts); a source without tokens gets one epoch; repeated
rows count as often as they come; an empty table gives an empty table; columns of the input that bear the names of results
are left out of the mix unless ``prefix`` names the results otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table, words_of, written

STEPS, POINTS = 4, 64  # 4 rounds of 64 points are 24 halvings


@dataclass(frozen=True)
class Mix:
    entropy_share: float | None = 0.95
    max_epochs: float | None = 4.0
    budget_tokens: int | None = None
    block_tokens: int = 1_000_000
    block_rows: int = 100_000
    seed: str = "mix"


def _draw(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("/", *(p if isinstance(p, Column) else F.lit(p) for p in parts)))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _largest(sources: DataFrame, good: Column) -> float:
    """Largest exponent of the 2**24 grid in [0, 1) for which good, an aggregate of __tokens and __a, holds; good is
    true up to some exponent and false from there on. 0 if it never holds."""
    low, width = 0.0, 1.0
    for _ in range(STEPS):
        width /= POINTS
        points = F.array(*(F.lit(low + i * width) for i in range(POINTS)))
        held = sources.withColumn("__a", F.explode(points)).groupBy("__a").agg(good.alias("__good")).where("__good").agg(F.max("__a")).first()[0]
        low = low if held is None else held
    return low


def exponent(sources: DataFrame, mix: Mix) -> float:
    """sources: __tokens of each source, above 0."""
    size = F.pow(F.col("__tokens").cast("double"), F.col("__a"))
    total = F.sum(size)
    alpha = 1.0
    if mix.entropy_share is not None:
        spread = F.log(total) - F.sum(size * F.col("__a") * F.log(F.col("__tokens").cast("double"))) / total
        alpha = _largest(sources, spread >= F.lit(mix.entropy_share) * F.log(F.count("*").cast("double")))
    if mix.max_epochs is not None:
        epochs = F.max(size / F.col("__tokens")) * (F.lit(float(mix.budget_tokens)) / total if mix.budget_tokens else F.lit(1.0) / F.min(size / F.col("__tokens")))
        beyond = _largest(sources, epochs > F.lit(mix.max_epochs))  # fewer repetitions as the exponent grows
        alpha = max(alpha, beyond + POINTS**-STEPS if beyond else 0.0)
    return alpha


def weighted_sources(counted: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: __source, __tokens, __weight, __epochs (whole and part), __blocks."""
    sums = written(counted.groupBy("__source").agg(F.sum("__n").alias("__tokens"), F.count("*").alias("__rows")), "sources")
    some = sums.where("__tokens > 0")
    alpha = exponent(some, mix)
    size = F.pow(F.col("__tokens").cast("double"), F.lit(alpha))
    total, least = some.agg(F.sum(size), F.min(size / F.col("__tokens"))).first()
    epochs = F.round(size / F.lit(total) * F.lit(mix.budget_tokens) / F.col("__tokens") if mix.budget_tokens else size / F.col("__tokens") / F.lit(least), 9)
    filled = F.col("__tokens") > 0
    return sums.select(
        "__source",
        "__tokens",
        F.when(filled, size / F.lit(total)).otherwise(0.0).alias("__weight"),
        F.when(filled, epochs).otherwise(1.0).alias("__epochs"),
        F.greatest(F.ceil(F.col("__tokens") / mix.block_tokens), F.ceil(F.col("__rows") / mix.block_rows), F.lit(1)).cast("long").alias("__blocks"),
    )


def words(text: str = "text") -> Column:
    """The token count that the mix goes by, unless another is given: white-space separated words."""
    return F.size(words_of(F.col(text))).cast("long")


def copies(docs: DataFrame, mix: Mix, tokens: Column, source: str = "source", ident: str = "doc_id") -> DataFrame:
    """docs with __n (tokens), __block, __weight, __copies (times the document is taken)."""
    kept = docs.columns
    counted = docs.withColumns({"__source": F.col(source), "__n": tokens, "__id": F.coalesce(F.col(ident).cast("string"), F.lit("null"))})
    slim = written(counted.select("__source", "__id", "__n"), "counted")
    sources = written(weighted_sources(slim, mix), "weights")

    def dealt(rows: DataFrame) -> DataFrame:
        few = sources.select(F.col("__source").alias("__s"), "__blocks", "__epochs", "__tokens", "__weight")
        found = rows.join(few, F.col("__source").eqNullSafe(F.col("__s")))
        return found.drop("__s").withColumn("__block", _number(_draw(mix.seed, "block", F.col("__id"))) % F.col("__blocks"))

    whole = F.floor("__epochs")
    blocks = dealt(slim).groupBy("__source", "__block").agg(F.sum("__n").alias("__size"), F.max(whole).alias("__whole"), F.max(F.floor((F.col("__epochs") - whole) * F.col("__tokens"))).alias("__part"))
    blocks = blocks.withColumn("__draw", _draw(mix.seed, "order", F.col("__whole").cast("string"), F.col("__block").cast("string"))).withColumn("__stretch", F.substring("__draw", 1, 3))
    blocks = written(blocks, "block-sizes")
    earlier = lambda *keys: Window.partitionBy("__source", *keys).rowsBetween(Window.unboundedPreceding, -1)
    stretches = blocks.groupBy("__source", "__stretch").agg(F.sum("__size").alias("__all")).select(
        F.col("__source").alias("__s"), F.col("__stretch").alias("__t"), F.coalesce(F.sum("__all").over(earlier().orderBy("__stretch")), F.lit(0)).alias("__before")
    )  # 4096 rows a source at most
    inner = F.coalesce(F.sum("__size").over(earlier("__stretch").orderBy("__draw", "__block")), F.lit(0))
    blocks = blocks.withColumn("__inner", inner).join(stretches, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__stretch") == F.col("__t"))).drop("__s", "__t")
    blocks = blocks.select(F.col("__source").alias("__s"), F.col("__block").alias("__b"), "__whole", F.greatest(F.col("__part") - F.col("__before") - F.col("__inner"), F.lit(0)).alias("__left"))
    placed = dealt(counted).join(written(blocks, "blocks"), F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")))
    inside = Window.partitionBy("__source", "__block").orderBy(_draw(mix.seed, "doc", F.col("__whole").cast("string"), F.col("__id")), "__n")
    used = F.coalesce(F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("__copies", (F.col("__whole") + F.when(used + F.col("__n") <= F.col("__left"), F.col("__n") > 0).otherwise(False).cast("long")).cast("int")).select(
        *kept, "__n", "__block", "__weight", "__copies"
    )


def mixed(docs: DataFrame, mix: Mix, tokens: Column, source: str = "source", ident: str = "doc_id", prefix: str = "") -> DataFrame:
    """The mix: docs, each as often as it is taken, with epoch (from 0), block, draw (order in the epoch: by the block's
    draw, then the document's), n_tokens and weight, each name after the prefix."""
    names = {name: prefix + name for name in ("epoch", "block", "draw", "n_tokens", "weight")}
    found = copies(docs, mix, tokens, source, ident).where("__copies > 0")
    each = found.withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__copies").cast("long") - 1)))
    draw = F.concat(_draw(mix.seed, "order", F.col("__epoch").cast("string"), F.col("__block").cast("string")), _draw(mix.seed, "doc", F.col("__epoch").cast("string"), F.coalesce(F.col(ident).cast("string"), F.lit("null"))))
    made = {"epoch": F.col("__epoch"), "block": F.col("__block"), "draw": draw, "n_tokens": F.col("__n"), "weight": F.col("__weight")}
    return each.select(*(c for c in docs.columns if c not in names.values()), *(made[k].alias(name) for k, name in names.items()))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words().alias("__words"))
    return mixed(docs, Mix(), F.col("__words")).select("doc_id", "source", "epoch", "block", "draw", "n_tokens", F.round("weight", 6).alias("weight"))


def mixing_sql(mix: Mix) -> str:
    """DuckDB SQL of op5_mixing for a mix with these blocks."""
    return OP5_SQL.replace("1000000", str(mix.block_tokens)).replace("100000)", f"{mix.block_rows})")


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
s AS (SELECT source, sum(n)::DOUBLE AS t, count(*) AS rows FROM d GROUP BY source HAVING sum(n) > 0),
eh(k, lo) AS (SELECT 0, 0.0::DOUBLE UNION ALL
  SELECT k + 1, lo + CASE WHEN (SELECT ln(sum(pow(t, a))) - sum(pow(t, a) * a * ln(t)) / sum(pow(t, a)) >= CAST(0.95 AS DOUBLE) * ln(count(*)::DOUBLE) FROM s, (SELECT lo + pow(2.0, -(k + 1)) AS a)) THEN pow(2.0, -(k + 1)) ELSE 0 END FROM eh WHERE k < 24),
er(k, lo) AS (SELECT 0, 0.0::DOUBLE UNION ALL
  SELECT k + 1, lo + CASE WHEN (SELECT max(pow(t, a) / t) / min(pow(t, a) / t) > 4 FROM s, (SELECT lo + pow(2.0, -(k + 1)) AS a)) THEN pow(2.0, -(k + 1)) ELSE 0 END FROM er WHERE k < 24),
x AS (SELECT greatest((SELECT lo FROM eh WHERE k = 24), (SELECT CASE WHEN lo > 0 THEN lo + pow(2.0, -24) ELSE 0 END FROM er WHERE k = 24)) AS a),
f AS (SELECT sum(pow(t, a)) AS total, min(pow(t, a) / t) AS least FROM s, x),
w AS (SELECT source, t, pow(t, a) / total AS weight, round(pow(t, a) / t / least, 9) AS epochs, greatest(ceil(t / 1000000), ceil(rows / 100000), 1)::BIGINT AS blocks FROM s, x, f),
b AS (SELECT d.doc_id, d.source, d.n, w.weight, w.epochs, floor(w.epochs)::BIGINT AS whole, floor((w.epochs - floor(w.epochs)) * w.t)::BIGINT AS part,
  concat('0x', substr(md5(concat_ws('/', 'mix', 'block', d.doc_id::VARCHAR)), 1, 8))::BIGINT % w.blocks AS block FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source),
z AS (SELECT source, block, whole, part, sum(n) AS size FROM b GROUP BY ALL),
l AS (SELECT source, block, greatest(part - coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(concat_ws('/', 'mix', 'order', whole::VARCHAR, block::VARCHAR)), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS room FROM z),
c AS (SELECT b.*, whole + (n > 0 AND sum(n) OVER (PARTITION BY b.source, b.block ORDER BY md5(concat_ws('/', 'mix', 'doc', whole::VARCHAR, doc_id::VARCHAR)), n ROWS UNBOUNDED PRECEDING) <= l.room)::BIGINT AS copies FROM b JOIN l ON b.source IS NOT DISTINCT FROM l.source AND b.block = l.block)
SELECT doc_id, source, epoch, block, concat(md5(concat_ws('/', 'mix', 'order', epoch::VARCHAR, block::VARCHAR)), md5(concat_ws('/', 'mix', 'doc', epoch::VARCHAR, doc_id::VARCHAR))) AS draw, n::BIGINT AS n_tokens, round(weight, 6) AS weight
FROM (SELECT c.*, unnest(range(copies)) AS epoch FROM c)
"""
