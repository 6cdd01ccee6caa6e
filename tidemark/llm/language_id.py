"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed greedily into phrases: from each
position the longest match in the automaton, at least one character. Matches run over words and spaces alike. The language
that needs the fewest phrases per character wins. Texts are lower-cased first; runs of anything but letters and marks are
one space.

The labelled text is a bounded sample: of the ``languages`` with the most labelled rows (ties by name) ``rows_per_language``
distinct labelled texts with the smallest hashes, taken whole while they add up to ``letters_per_language`` characters or less
(one text at least). Nothing else is bounded: every row is predicted, by its whole text. A worker process holds at most two states a character, some 20 MB a language.

Defined results: a text that is null or has no letter is ``und`` with score 0; ties go to the first language by name;
without any learned language every text is ``und``; repeated rows are judged alike; empty tables give empty tables; columns
of the input that bear the names of results are left out of what predicted() and identify() return (see ``names``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import freed, small_batches, table

UNKNOWN = "und"
_between, _letter = regex.compile(r"[^\p{L}\p{M}]+").sub, regex.compile(r"\p{L}").search


def running_text(text: str) -> str:
    """Letters and marks in lower case, one space between their runs and at both ends."""
    return _between(" ", f" {text.lower()} ")


class SuffixAutomaton:
    """Accepts every substring of the texts it was given; built character by character."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, text: str) -> None:
        last = 0
        for letter in text:
            last = self._extend(last, letter)

    def _split(self, state: int, after: int, letter: str) -> int:
        """A copy of `after` as long as what `state` and the letter make, for all that lead there."""
        copy = len(self.next)
        self.next.append(dict(self.next[after]))
        self.length.append(self.length[state] + 1)
        self.link.append(self.link[after])
        self.link[after] = copy
        while state != -1 and self.next[state].get(letter) == after:
            self.next[state][letter] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, letter: str) -> int:
        there = self.next[last].get(letter)
        if there is not None:  # a new text may run along old ones
            return there if self.length[there] == self.length[last] + 1 else self._split(last, there, letter)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        state = last
        while state != -1 and letter not in self.next[state]:
            self.next[state][letter] = new
            state = self.link[state]
        if state != -1:
            there = self.next[state][letter]
            self.link[new] = there if self.length[there] == self.length[state] + 1 else self._split(state, there, letter)
        return new

    def frozen(self) -> dict:
        """The start state, with states as dictionaries from a character to the next state. Made in place: add no more text."""
        for state in self.next:
            for letter, after in state.items():
                state[letter] = self.next[after]
        return self.next[0]


def phrases(start: dict, text: str) -> int:
    """Greedy longest matches that cover the text; a character met nowhere is a phrase of its own."""
    count, state, nowhere = 0, {}, {}
    for letter in text:
        state = state.get(letter)
        if state is None:
            count += 1
            state = start.get(letter, nowhere)
    return count


class Parser:
    """Phrase counts of texts, one per language."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        self.starts = []
        for language in self.languages:
            automaton = SuffixAutomaton()
            for text in samples[language]:
                automaton.add(running_text(text))
            self.starts.append(automaton.frozen())

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: how much shorter the best parse is than the mean of the others' parses, 0 to 1."""
        if not text or not self.languages or not _letter(text):
            return UNKNOWN, 0.0
        running = running_text(text)
        found = [phrases(start, running) for start in self.starts]
        best = min(range(len(found)), key=found.__getitem__)
        others = [n for i, n in enumerate(found) if i != best]
        mean = sum(others) / len(others) if others else len(running)
        return self.languages[best], 1 - found[best] / max(mean, 1)


_parsers: dict[str, Parser] = {}


def training_texts(labelled: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = 200, letters_per_language: int = 40_000, languages: int = 200) -> dict[str, list[str]]:
    """Distinct whole texts per language, within the bounds, in the order of their hashes.

    Copies count once, however many they are: only hashes and lengths are compared before the few texts are read.
    row_number() under a bound makes Spark keep that many rows a task before the exchange.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("__lang"), F.col(text).alias("__text"), F.xxhash64(text).alias("__hash"), F.char_length(text).cast("long").alias("__size"))
    rows = rows.where(F.col("__text").rlike("\\p{L}"))
    top = labelled.where(F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("__lang")).agg(F.count("*").alias("__rows")).orderBy(F.desc("__rows"), "__lang").limit(languages)
    rows = rows.join(F.broadcast(top.select("__lang")), "__lang", "left_semi")
    order = Window.partitionBy("__lang").orderBy(F.col("__size") > letters_per_language, "__hash")
    first = rows.groupBy("__lang", "__hash").agg(F.min("__size").alias("__size")).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= rows_per_language)
    chosen = first.withColumn("__sum", F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("__n") == 1) | (F.col("__sum") <= letters_per_language))
    wanted = F.broadcast(chosen.select("__lang", "__hash", "__n"))  # rows_per_language rows a language at most
    taken = rows.join(wanted, ["__lang", "__hash"]).groupBy("__lang", "__n").agg(F.min("__text").alias("__text"))
    found: dict[str, list[str]] = {}
    for row in sorted(taken.collect(), key=lambda r: (r["__lang"], r["__n"])):
        found.setdefault(row["__lang"], []).append(row["__text"])
    return found


def predicted(docs: DataFrame, samples: dict[str, list[str]], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with language and score. The samples are bounded; each worker builds its automata from them once."""
    small_batches(docs.sparkSession)
    key, kept = uuid.uuid4().hex, [c for c in docs.columns if c not in names]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = Parser(samples)
        parser = _parsers[key]
        for batch in batches:
            found = [parser.predict(value.as_py()) for value in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*kept, *names])
        del parser
        _parsers.clear()
        freed()  # the worker process may go on with another stage, which needs the memory

    schema = docs.select(*kept).schema.add(names[0], "string").add(names[1], "double")
    return docs.select(*kept).mapInArrow(run, schema)


def held_out(ident: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(ident).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", ident: str = "doc_id", names: tuple[str, str] = ("lang_pred", "score"), **bounds: int) -> DataFrame:
    """docs with language and score; learned from the labelled rows that are not held out (see held_out)."""
    return predicted(docs, training_texts(docs.where(~held_out(ident)), text, lang, **bounds), text, names)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = training_texts(docs.where(~held_out()))
    slim = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predicted(slim, samples).drop("text")
