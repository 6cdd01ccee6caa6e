"""Quality rules as a short-circuit cascade. DataFrame functions only.

Each rule is a boolean column: true rejects. On a sample of documents each rule's run time and rejection rate are
measured; the rules are then asked in the order of rejections per second, inside one CASE expression, so that a document
meets no rule after the first that rejects it, and no costs that only later rules have. The order changes the cost, never
the verdict.

The sample is about ``sample_rows`` documents, those whose hash of identifier and text is a multiple of a number, so each
task picks its own. A rule's cost is the least time of some runs over the repeated sample, less that of a run without
a rule.

Defined results: a null or empty text has no words and fails the base rules; an empty table gives an empty table;
repeated rows are judged alike; ties in the order go by the rule's name; columns of the input that bear the names of
results are left out.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, removed, table, words_of, written

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def _windows(h: str) -> Column:
    at = ", ".join(f"{h}[i + {k}]" for k in range(WINDOW))
    return F.expr(f"CASE WHEN size({h}) < {WINDOW} THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, size({h}) - {WINDOW}), i -> xxhash64({at})) END")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all long.

    Words in repeated windows: windows are 64-bit hashes of word hashes; only a document with equal windows sorts them,
    to find their places; each place then covers up to WINDOW words, less what the next place covers as well.
    """
    kept = [c for c in docs.columns if c not in MEASURES]
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__text", body).withColumn("__w", words_of(F.col("__text")))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    out = out.select(
        *kept,
        F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"),
    )
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")
    out = out.withColumn("__win", _windows("__h")).drop("__h")
    out = out.withColumn("__equal", F.size(F.array_distinct("__win")) < F.size("__win"))
    out = out.withColumn("__sorted", F.expr("CASE WHEN __equal THEN sort_array(transform(__win, (x, i) -> struct(x AS x, i AS i))) END")).drop("__win")
    twice = "(i > 0 AND __sorted[i - 1].x = e.x) OR (i < size(__sorted) - 1 AND __sorted[i + 1].x = e.x)"
    out = out.withColumn("__at", F.expr(f"CASE WHEN __equal THEN sort_array(transform(filter(__sorted, (e, i) -> {twice}), e -> e.i)) END")).drop("__sorted")
    cover = f"CASE WHEN __equal THEN aggregate(transform(__at, (p, i) -> CASE WHEN i = size(__at) - 1 THEN {WINDOW} ELSE least({WINDOW}, __at[i + 1] - p) END), 0, (a, x) -> a + x) ELSE 0 END"
    return out.withColumn("n_repeat_words", F.expr(cover).cast("long")).select(*kept, *MEASURES)


def default_rules(text: str = "text") -> list[Rule]:
    """Rules on the measured columns and, where they must, on the text."""
    n, chars = F.col("n_words"), F.col("word_chars")
    body = F.coalesce(F.col(text), F.lit(""))
    w = words_of(F.col(text))
    stutter = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: x == y)
    return [
        Rule("symbols", F.col("n_symbols") * 100 > chars * 2),
        Rule("word_length", (chars < n * 2) | (chars > n * 14)),
        Rule("repeated_lines", F.col("n_dup_lines") * 10 > F.greatest(n / 10, F.lit(10)) * 3),
        Rule("stutter", F.size(F.filter(stutter, lambda x: x)) * 10 > n * 2),
        Rule("exclamations", F.regexp_count(body, F.lit("!")) * 10 > n),
        Rule("capitals", F.regexp_count(body, F.lit("[A-Z]")) * 10 > chars * 3),
        Rule("digits", F.regexp_count(body, F.lit("[0-9]")) * 10 > chars * 3),
        Rule("few_letters", F.regexp_count(body, F.lit("\\p{L}")) * 10 < chars * 6),
    ]


def ordered_rules(sample: DataFrame, rules: list[Rule], clock=time.perf_counter, runs: int = 3) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, rejected share) by falling rejections per second on the sample; ties by name."""

    def seconds(condition: Column) -> tuple[float, int]:
        took = []
        for _ in range(runs):
            began = clock()
            hit = sample.agg(F.count_if(condition)).first()[0] or 0
            took.append(clock() - began)
        return min(took), hit

    idle, rows = seconds(F.col("n_words") >= 0)
    found = []
    for rule in rules:
        took, hit = seconds(rule.rejects)
        found.append((rule, max(took - idle, 1e-4), hit / max(rows, 1)))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def cascade(docs: DataFrame, rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, in the given order; null if none does."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, text: str = "text", ident: str = "doc_id", rules: list[Rule] | None = None, sample_rows: int = 2000, repeats: int = 4) -> DataFrame:
    """Measured columns, base_failed, rejected_by and kept. sample_rows only sets the size of the sample for the order."""
    rules = rules or default_rules(text)
    docs = docs.select(*(c for c in docs.columns if c not in ("base_failed", "rejected_by", "kept")))
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    each = max(1, docs.count() // sample_rows)
    some = docs.select(ident, text).where(F.pmod(F.xxhash64(ident, text), F.lit(each)) == 0)
    # Filters come after the written table: pushed below measured() they would repeat its array expressions per element.
    sample = written(measured(some, text).withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(repeats)))), "rule-sample")
    order = [rule for rule, _, _ in ordered_rules(sample.where(~base), rules)]
    removed(sample)
    out = measured(docs, text).withColumn("base_failed", base)
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(out, order)))
    return out.withColumn("kept", F.col("rejected_by").isNull())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT r, doc_id, t, w, len(w) AS n, length(array_to_string(w, '')) AS c, len(regexp_extract_all(t, '[#*$%&|<>]')) AS y, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8) q),
e AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
v AS (SELECT r, sum(k) AS covered FROM (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS k FROM e) q GROUP BY r),
s AS (SELECT r, count(*) AS stutter FROM (SELECT r, w, unnest(range(2, len(w) + 1)) AS i FROM d) q WHERE w[i] = w[i - 1] GROUP BY r),
f AS (SELECT m.*, len(l) - len(list_distinct(l)) AS dup, coalesce(covered, 0) AS rep, coalesce(stutter, 0) AS st FROM m LEFT JOIN v ON m.r = v.r LEFT JOIN s ON m.r = s.r)
SELECT doc_id, n::BIGINT AS n_words, c::BIGINT AS word_chars, y::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words, (n < 20 OR 100 * rep > 30 * n) AS base_failed,
  NOT (n < 20 OR 100 * rep > 30 * n OR y * 100 > c * 2 OR c < n * 2 OR c > n * 14 OR dup * 10 > greatest(n / 10.0, 10) * 3 OR st * 10 > n * 2 OR len(regexp_extract_all(t, '!')) * 10 > n
    OR len(regexp_extract_all(t, '[A-Z]')) * 10 > c * 3 OR len(regexp_extract_all(t, '[0-9]')) * 10 > c * 3 OR len(regexp_extract_all(t, '\p{L}')) * 10 < c * 6) AS kept
FROM f
"""
