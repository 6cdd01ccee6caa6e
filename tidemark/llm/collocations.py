"""Phrase collocations by prefix-free parsing.

Words that reach the threshold get numbers; any other word and the end of a piece become a break, as no phrase goes beyond
them, and breaks in a row one. Texts in this form are cut into chunks by content: wherever the hash of ``overlap`` consecutive
numbers (one less than the words of the longest phrase) is 0 modulo ``cut``, a chunk ends with these and the next one begins
with them. Texts that share passages share chunks, and every phrase lies whole in a chunk. The distinct chunks with their
frequencies are the dictionary; phrases are counted inside distinct chunks only, weighted by frequency. A phrase that begins in
the last ``overlap`` numbers of a chunk is left to the successor; a text ends with as many breaks. So each occurrence counts once.

Phrases are counted level by level, and only where all their parts of the level before reach the threshold: word pairs, then
three words as two pairs, then longer ones as two phrases of three words, and so on. A phrase is told by the numbers of these
two, which are exact. Tasks add up what they have read and deal the sums to parts by a mixed form of these numbers, so that each
part adds up and filters its own phrases: shuffled rows are no more than places in distinct chunks, whatever the corpus, and
nothing fills up as it grows. The driver gets and sends the words and the phrases of a level that reach the threshold. Score arithmetic
is decimal: 1000 * a * n may pass 64 bits, 38 digits it does not for corpora below 10^17 words.

Defined results: a null text is empty; pieces without words give nothing; a null language is ``und``; repeated rows count as
often as they stand; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import partitions, removed, table, written


@dataclass(frozen=True)
class Mining:
    """At least two words."""

    longest: int = 5
    least: int = 100
    first: int = 2000
    cut: int = 32
    sketch_bits: int = 23  # of a phrase's hash in look-up tables, at most; fewer make look-ups slower and change no result
    chunk_words: int = 4096  # a chunk without a trigger ends here

    @property
    def overlap(self) -> int:
        return self.longest - 1


#: Piece separators become newlines and tabs spaces. bytes.lower() changes A-Z only. After this no \x0b is left; it ends a text.
_PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_NO_WORDS = pa.array([b"", b"\n", b"\x0b"], pa.binary())
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = 0xBF58476D1CE4E5B9


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(29))


def _unmixed(x: np.ndarray) -> np.ndarray:
    """_mixed() maps 64-bit numbers one to one; this is the way back."""
    x = (x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(58))) * np.uint64(pow(_MIX, -1, 2**64))
    return x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))


def _rolled(numbers: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of the n numbers from each of the places on."""
    out = np.full(len(at), seed, np.uint64)
    for k in range(n):
        out = _mixed(out * _ODD + numbers[at + k])
    return out


def _slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with some bytes in the column; a longer value is a part of its own. Memory goes back after each."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
            pa.default_memory_pool().release_unused()


def _by_language(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[str, list[bytes]]]:
    """A language and texts of it, some megabytes of all languages at a time."""
    for batch in _slices(batches, 1, most):
        langs, texts = batch.column(0).dictionary_encode(), batch.column(1).cast(pa.binary())
        code = langs.indices.to_numpy()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, texts.filter(pa.array(code == k)).drop_null().to_pylist()


def _tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The distinct tokens of the texts, and which of them stand one after the other: words, a newline where a piece ends, \\x0b where a text
    ends, and empty ones between spaces."""
    joined = b"".join(t.lower().translate(_PIECES).replace(b"\n", b" \n ") + b" \x0b " for t in texts)
    tokens = pc.split_pattern(pa.array([joined], pa.binary()), " ").values.dictionary_encode()
    return tokens.dictionary, tokens.indices.to_numpy()


def _summed(tables: list[pa.Table]) -> pa.Table:
    """Equal words of some tables as one row each."""
    return pa.concat_tables(tables).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"])


def _words(batches: Iterator[pa.RecordBatch], most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """lang, phrase (a word; empty for all of them), n: summed over the task as long as there are no more than `most` of them."""
    held: list[pa.Table] = []
    for lang, texts in _by_language(batches):
        words, code = _tokens(texts)
        own = pc.invert(pc.is_in(words, value_set=_NO_WORDS))
        n = np.bincount(code, minlength=len(words))[own.to_numpy(zero_copy_only=False)]
        if not len(n):
            continue
        phrase = pa.concat_arrays([words.filter(own), pa.array([b""], pa.binary())]).cast(pa.string())
        held.append(pa.table({"lang": pa.repeat(lang, len(phrase)), "phrase": phrase, "n": pa.array(np.append(n, n.sum()), pa.int64())}))
        if sum(map(len, held)) > most:
            held = [_summed(held)]
            if len(held[0]) > 3 * most // 4:
                yield from held.pop().to_batches()
    if held:
        yield from _summed(held).to_batches()


class Vocabulary:
    """The words of each language that reach the threshold, numbered from 1 on."""

    def __init__(self, frequent: pa.Table):
        frequent = frequent.sort_by([("lang", "ascending"), ("n", "descending")]).combine_chunks()
        self.words = pa.concat_arrays(frequent.column("phrase").chunks).cast(pa.binary())
        langs = pa.concat_arrays(frequent.column("lang").chunks).dictionary_encode()
        self.langs = langs.dictionary
        self.first = np.searchsorted(langs.indices.to_numpy(), np.arange(len(self.langs)))
        self.place = {lang: k for k, lang in enumerate(self.langs.to_pylist())}

    def __len__(self) -> int:
        return len(self.words)

    def numbers(self, lang: str, words: pa.Array) -> np.ndarray:
        """0 for other words."""
        k = self.place[lang]
        first = int(self.first[k])
        own = self.words.slice(first, (int(self.first[k + 1]) if k + 1 < len(self.first) else len(self.words)) - first)
        at = pc.fill_null(pc.index_in(words, value_set=own), -first - 1).to_numpy()
        return (at + np.int32(first + 1)).astype(np.int32)

    def phrases(self, numbers: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Languages and phrases of rows of numbers."""
        lang = np.searchsorted(self.first, numbers[:, 0] - 1, "right") - 1
        words = [self.words.take(pa.array(numbers[:, k] - 1)) for k in range(numbers.shape[1])]
        return self.langs.take(pa.array(lang)), pc.binary_join_element_wise(*words, b" ").cast(pa.string())


END, GAP = -1, -2


def _cut(tokens: np.ndarray, m: Mining) -> Iterator[pa.RecordBatch]:
    """Chunks of texts that are numbers of words, 0 for breaks, END after each text, and GAP for nothing."""
    tokens = tokens[tokens != GAP]
    word = np.pad(tokens > 0, 1)
    tokens[word[1:-1] & ~word[:-2] & ~word[2:]] = 0  # a word alone is in no phrase
    tokens = tokens[(tokens != 0) | (np.append(END, tokens[:-1]) > 0)]
    tokens = tokens[(tokens > 0) | (np.where(tokens == END, np.append(END, tokens[:-1]), np.append(tokens[1:], END)) != END)]
    if not len(tokens):
        return
    ends = tokens == END
    times = np.where(ends, m.overlap, 1)
    stops = np.cumsum(times)[ends]
    starts = np.append(0, stops[:-1])
    tokens = np.repeat(np.maximum(tokens, 0), times)
    at = np.flatnonzero(_rolled(tokens.astype(np.uint64), np.arange(len(tokens) - m.overlap + 1), m.overlap, 1) % np.uint64(m.cut) == 0)
    of = np.searchsorted(stops, at, "right")
    at = at[(at > starts[of]) & (at + m.overlap < stops[of])]

    def until(begin: np.ndarray) -> np.ndarray:
        end = np.append(begin[1:], len(tokens))
        return end + np.where(np.isin(end, stops), 0, m.overlap)

    begin = np.sort(np.concatenate((starts, at)))
    end = until(begin)
    long = np.flatnonzero(end - begin > m.chunk_words)
    if len(long):
        step = m.chunk_words - m.overlap
        begin = np.sort(np.concatenate((begin, *(np.arange(begin[i] + step, end[i] - m.overlap, step) for i in long))))
        end = until(begin)
    sizes = end - begin
    offsets = np.append(0, np.cumsum(sizes))
    values = tokens[np.repeat(begin - offsets[:-1], sizes) + np.arange(offsets[-1])].astype(np.int32)
    chunks = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(values)])
    yield pa.RecordBatch.from_arrays([chunks], names=["chunk"])


def _chunks(batches: Iterator[pa.RecordBatch], m: Mining, vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """chunk: numbers of words as 32-bit integers."""
    for lang, texts in _by_language(batches):
        if lang in vocabulary.place and texts:
            words, code = _tokens(texts)
            numbers = vocabulary.numbers(lang, words)
            for token, number in ((b"\x0b", END), (b"", GAP)):
                at = pc.index(words, pa.scalar(token, pa.binary())).as_py()
                if at >= 0:
                    numbers[at] = number
            yield from _cut(numbers[code], m)


def dictionary(slim: DataFrame, m: Mining, vocabulary) -> DataFrame:
    """Distinct chunks of lang and text with their frequencies, by a broadcast of the vocabulary."""
    chunks = slim.mapInArrow(lambda batches: _chunks(batches, m, vocabulary.value), "chunk binary")
    return written(chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")), "chunks")


def _blocks(batches: Iterator[pa.RecordBatch], m: Mining, most: int = 8 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Some megabytes of distinct chunks at a time: their numbers in a row, whether phrases that begin there are the chunk's own, and its frequency."""

    def block(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        whole = pa.Table.from_batches(held)
        chunks = pa.concat_arrays([c.cast(pa.binary()) for c in whole.column("chunk").chunks])
        sizes = pc.binary_length(chunks).to_numpy() // 4
        offsets = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset :]
        numbers = np.frombuffer(chunks.buffers()[2], np.int32)[offsets[0] // 4 : offsets[len(chunks)] // 4]
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(numbers))
        return numbers, left > m.overlap, np.repeat(whole.column("n").to_numpy(), sizes)

    held, size = [], 0
    for batch in _slices(batches, 0, 1 << 20):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(0))).as_py()
        if size >= most:
            yield block(held)
            held, size = [], 0
    if size:
        yield block(held)


class Level:
    """Phrases of some words that reach the threshold, numbered from 1 on in the order of their keys."""

    def __init__(self, size: int, keys: np.ndarray):
        self.size, self.keys = size, np.sort(keys)

    def ready(self, m: Mining) -> Level:
        """With a table of where the keys begin that agree in their first bits."""
        self.shift = np.uint64(64 - min(m.sketch_bits, len(self.keys).bit_length() + 2))
        first = np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << (64 - int(self.shift)))
        self.begin = np.append(0, np.cumsum(first)).astype(np.int32)
        return self

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """0 for other keys."""
        out = np.zeros(len(keys), np.int32)
        group = (keys >> self.shift).astype(np.int64)
        at, stop = self.begin[group], self.begin[group + 1]
        left = np.flatnonzero(at < stop)
        at, stop = at[left], stop[left]
        while len(left):
            hit = self.keys[at] == keys[left]
            out[left[hit]] = at[hit] + 1
            on = ~hit & (at + 1 < stop)
            left, at, stop = left[on], at[on] + 1, stop[on]
        return out


class Levels:
    """Keys of phrases: two numbers of the level before, of their first and of their last words, as one, mixed."""

    def __init__(self, words: int):
        self.words, self.levels = words, []

    @property
    def size(self) -> int:
        """Words of the phrases of the last level."""
        return self.levels[-1].size if self.levels else 1

    def span(self, k: int) -> np.uint64:
        return np.uint64((len(self.levels[k - 1].keys) if k else self.words) + 1)

    def places(self, numbers: np.ndarray, reach: int) -> np.ndarray:
        """Where a number and so many after it are known."""
        known = numbers > 0
        out = known[: len(known) - reach].copy()
        for k in range(1, reach + 1):
            out &= known[k : len(known) - reach + k]
        return np.flatnonzero(out)

    def keys(self, k: int, numbers: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
        return _mixed(numbers[at].astype(np.uint64) * self.span(k) + numbers[at + reach].astype(np.uint64))

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Of the phrases of the last level that begin at each place."""
        numbers, size = words, 1
        for k, level in enumerate(self.levels):
            at = self.places(numbers, level.size - size)
            out = np.zeros(len(words), np.int32)
            out[at] = level.numbers(self.keys(k, numbers, at, level.size - size))
            numbers, size = out, level.size
        return numbers

    def of(self, keys: np.ndarray, size: int) -> np.ndarray:
        """The words' numbers of phrases counted on top of the last level, a row a phrase."""

        def row(k: int, keys: np.ndarray, size: int) -> np.ndarray:
            base = self.levels[k - 1].size if k else 1
            parts = [x.astype(np.int64) for x in np.divmod(_unmixed(keys), self.span(k))]
            first, last = [row(k - 1, self.levels[k - 1].keys[x - 1], base) if k else x.reshape(-1, 1) for x in parts]
            return np.hstack([first, last[:, 2 * base - size :]])

        return row(len(self.levels), keys, size)


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in their order, with sums."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(n[order], new) if len(keys) else n


def _counted(batches: Iterator[pa.RecordBatch], m: Mining, lengths: range, levels: Levels, parts: int, most: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """size (words of phrases), part, keys (distinct and in their order), n: summed over so many places in chunks."""
    for level in levels.levels:
        level.ready(m)
    bounds = np.array([k * (2**64 // parts) for k in range(1, parts)], np.uint64)
    once: dict[int, list[np.ndarray]] = {n: [] for n in lengths}
    often: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in lengths}

    def rows() -> Iterator[pa.RecordBatch]:
        for size in lengths:
            for keys, n in (np.unique(np.concatenate(once[size]), return_counts=True), _added(*map(np.concatenate, zip(*often[size], strict=True)))):
                at = [0, *np.searchsorted(keys, bounds), len(keys)]
                some = [k for k in range(parts) if at[k] < at[k + 1]]
                blobs = [pa.array([x[at[k] : at[k + 1]].tobytes() for k in some], pa.binary()) for x in (keys, n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([size] * len(some), pa.int32()), pa.array(some, pa.int32()), *blobs], names=["size", "part", "keys", "n"])
            once[size].clear()
            often[size].clear()

    held = 0
    for words, own, weight in _blocks(batches, m):
        numbers = levels.numbers(words)
        for size in lengths:
            reach = size - levels.size
            at = levels.places(numbers, reach)
            at = at[own[at]]
            keys, n = levels.keys(len(levels.levels), numbers, at, reach), weight[at]
            one = n == 1
            once[size].append(keys[one])
            often[size].append((keys[~one], n[~one]))
            held += len(at)
        if held > most:
            yield from rows()
            held = 0
    if held:
        yield from rows()


def _frequent(batches: Iterator[pa.RecordBatch], m: Mining, levels: Levels, vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """lang, phrase, size, n, key: phrases of a part that reach the threshold."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for size, keys, n in zip(batch.column("size").to_pylist(), batch.column("keys"), batch.column("n"), strict=True):
            held.setdefault(size, []).append((np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.int64)))
    for size, some in held.items():
        keys, n = _added(*map(np.concatenate, zip(*some, strict=True)))
        keys, n = keys[n >= m.least], n[n >= m.least]
        if len(keys):
            lang, phrase = vocabulary.phrases(levels.of(keys, size))
            yield pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase, pa.array(np.full(len(n), size), pa.int32()), pa.array(n), pa.array(keys.view(np.int64))], names=["lang", "phrase", "size", "n", "key"])


#: Compressed bytes of chunks for a task that counts, no fewer tasks than twice the cores; and for a part that adds up, no fewer parts than shuffle partitions.
COUNTING_BYTES, PART_BYTES = 256 << 20, 16 << 20


def _size(df: DataFrame) -> int:
    """Bytes of a written table."""
    path, conf = df.sparkSession._jvm.org.apache.hadoop.fs.Path, df.sparkSession._jsc.hadoopConfiguration()
    return sum(path(f).getFileSystem(conf).getContentSummary(path(f)).getLength() for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def phrase_counts(docs: DataFrame, m: Mining = Mining(), text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, phrase, size, n: phrases of 1 to longest words that stand least times or more; size 0 has n of all words."""
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    words = slim.mapInArrow(_words, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    found = written(words.where((F.col("n") >= m.least) | (F.col("phrase") == "")).select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(1).alias("size"), "n"), "words")
    frequent = found.where("size = 1").select("lang", "phrase", "n").toArrow()
    if not len(frequent):
        return found
    vocabulary, levels = spark.sparkContext.broadcast(Vocabulary(frequent)), Levels(len(frequent))
    chunks = dictionary(slim, m, vocabulary)
    size = _size(chunks)
    fewer, parts = chunks.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-size // COUNTING_BYTES))), max(partitions(spark), -(-size // PART_BYTES))

    def counted(lengths: range) -> DataFrame:
        known = spark.sparkContext.broadcast(levels)
        sums = fewer.mapInArrow(lambda batches: _counted(batches, m, lengths, known.value, parts), "size int, part int, keys binary, n binary").repartitionById(parts, F.col("part"))
        return written(sums.mapInArrow(lambda batches: _frequent(batches, m, known.value, vocabulary.value), "lang string, phrase string, size int, n bigint, key bigint"), "phrases")

    while levels.size < m.longest:
        lengths = range(levels.size + 1, min(m.longest, 3 if levels.size == 2 else 2 * levels.size) + 1)
        phrases = counted(lengths)
        found = found.unionByName(phrases.drop("key"))
        keys = phrases.where(F.col("size") == lengths[-1]).select("key").toArrow().column("key").to_numpy().view(np.uint64) if lengths[-1] < m.longest else ()
        if not len(keys):
            break
        levels.levels.append(Level(lengths[-1], keys))
    removed(chunks)
    return found


def collocations(counts: DataFrame, m: Mining = Mining()) -> DataFrame:
    """lang, phrase, a, l, r, n, score of all candidates that no longer one with their frequency contains."""
    totals = counts.where("size = 0").select(F.col("lang").alias("__lang"), F.col("n").alias("total"))
    known = counts.where("size > 0")
    words = F.split("phrase", " ", -1)
    candidates = known.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("words"))
    joined = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = candidates.select("lang", "phrase", "size", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    part = lambda side, n: known.select(F.col("lang"), F.col("phrase").alias(side), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.join(totals, F.col("lang") == F.col("__lang"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    top = (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(20,0)") * F.col("total").cast("decimal(18,0)")
    cuts = cuts.withColumn("top", top.cast("decimal(38,0)")).withColumn("bottom", (wide("l") * wide("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("top div bottom"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", F.col("total").alias("n"))).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")
    inner = candidates.where("size > 2").select("lang", "a", "size", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k")).select("lang", "a", "words", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("i"))
    covered = inner.select("lang", joined(F.col("i"), F.col("k")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    return best.join(covered, ["lang", "phrase"], "left").where(F.col("held").isNull() | (F.col("held") < F.col("a"))).drop("held")


def ranked(found: DataFrame, m: Mining = Mining()) -> DataFrame:
    """The first ones of each language, with their rank. Tasks keep no more than that many before rows are dealt by language."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m.first)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked(collocations(phrase_counts(table(spark, sf_dir, "documents"))))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP13_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
b AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws[i : i + k - 1] AS ph, k FROM b, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, ph, k, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
c AS (SELECT x.lang, x.ph, x.k, x.n AS a, q.j, y.n AS l, z.n AS r, t.n, (1000::HUGEINT * x.n::HUGEINT * t.n) // (y.n::HUGEINT * z.n::HUGEINT) AS score
    FROM f x JOIN t ON t.lang = x.lang JOIN (SELECT unnest(range(1, 5)) AS j) q ON q.j < x.k JOIN f y ON y.lang = x.lang AND y.ph = x.ph[1 : q.j] JOIN f z ON z.lang = x.lang AND z.ph = x.ph[q.j + 1 : x.k]),
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1),
inn AS (SELECT x.lang, x.ph[i.i : i.i + j.j - 1] AS ph, max(x.n) AS held FROM f x JOIN (SELECT unnest(range(2, 5)) AS j) j ON j.j < x.k JOIN (SELECT unnest(range(1, 6)) AS i) i ON i.i + j.j - 1 <= x.k GROUP BY ALL),
k AS (SELECT s.* FROM s LEFT JOIN inn ON inn.lang = s.lang AND inn.ph = s.ph WHERE held IS NULL OR 100 * held < 100 * a),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS rank, array_to_string(ph, ' ') AS phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM k)
SELECT * FROM o WHERE rank <= 2000
"""
