"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Texts become sets of 64-bit hashes of word n-grams; equal sets are one node, named by 120 bits of a digest of the set. All
n-grams have one global order: rarest first by a count sketch of fixed size, then by hash. If two sets reach the
threshold, they share an n-gram within each other's prefix, in the smaller set's even shorter one, and at the first such
n-gram enough of both sets is left (position filter). Each node's prefix is lengthened by l - 1 n-grams, with l chosen by
the estimated cost of its candidates (lists read, and pairs that survive to be verified); a pair then needs min(l) common
n-grams in the prefixes for that l, and parity bitmaps that differ in few enough bits, before its full sets are compared.
All tests are exact: they drop no pair that reaches the threshold. The sketch only affects speed.

Only components are asked for, so pairs within a group are not enumerated. The lists are sorted once by n-gram; every node
of a list meets one pivot, a node in which that n-gram comes early. An n-gram that a five-hundredth of the rows or more
list is dealt over salted lists, whose pivots then meet one pivot of theirs. Then lists of three nodes or more are joined for
pairs that no pivot is part of, between components still apart; sizes, positions and 256 parity bits a set are tested inside
the join, so that a list of sets that are alike but not linked costs comparisons, not rows.

Defined results: null texts and texts without a word have an empty set, linked with nothing; texts of fewer than n
words have one n-gram, the whole sequence; repeated rows are copies; a null identifier counts as larger than any;
columns other than the text and the identifier are not read, so their names cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import parted, partitions, removed, table, written
from .components import components

SKETCH_BITS, SLICE_BITS = 23, 16
MATCHES = 4
VERIFY_COST = 50  # list entries read that cost as much as one verification
HOT_SHARE, HOT_ROWS = 500, 1000  # a list is salted from rows / HOT_SHARE entries on, HOT_ROWS at least
HEAVY = 2000  # nodes outside a list's main component that one task compares with the list
BITS = 4  # 64-bit numbers of parity bits that the join of the lists tests
BROADCAST_ROWS = 1_000_000  # identifiers (some 50 MB) that are broadcast to fetch texts; beyond that texts that a filter leaves are shuffled
_FACTOR, _SHORT = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
_word_hash = xxhash.xxh3_64_intdigest
NODE, NODE_TYPE = "decimal(38,0)", pa.decimal128(38, 0)


def ngrams(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of the text's words, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    h = np.fromiter(map(_word_hash, words), "u8", len(words))
    if not len(h):
        return h
    width = min(n, len(h))
    rolled = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        rolled *= _FACTOR
        rolled += h[i : len(h) - width + 1 + i]
    if width < n:
        rolled ^= np.uint64(_SHORT * width % 2**64)
    return np.unique(rolled)


def node_of(h: np.ndarray) -> bytes | None:
    """120 bits of a digest of a set, as a little-endian number of 16 bytes."""
    return hashlib.blake2b(h.tobytes(), digest_size=15).digest() + b"\0" if len(h) else None


def node_array(nodes: list[bytes | None]) -> pa.Array:
    there = pa.array([x is not None for x in nodes], pa.bool_())
    return pa.Array.from_buffers(NODE_TYPE, len(nodes), [there.buffers()[1], pa.py_buffer(b"".join(x or bytes(16) for x in nodes))])


def _halves(nodes: pa.Array) -> np.ndarray:
    """Nodes without nulls as rows of two numbers."""
    return np.frombuffer(nodes.buffers()[1], "u8").reshape(-1, 2)[nodes.offset : nodes.offset + len(nodes)]


def _nodes_and_counts(n: int, ident: pa.DataType):
    """A row per document (kind 0: ident, size, node) and the counts of the task's n-grams (kind 1: slice, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, "u4")
        names = ["kind", "ident", "size", "node", "slice", "counts"]
        for batch in batches:
            sizes, nodes = [], []
            for value in batch.column(1):
                h = ngrams(value.as_py(), n)
                np.add.at(counts, h >> np.uint64(64 - SKETCH_BITS), 1)
                sizes.append(len(h))
                nodes.append(node_of(h))
            m = len(batch)
            yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), batch.column(0), pa.array(sizes, pa.int64()), node_array(nodes), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        parts = counts.reshape(-1, 1 << SLICE_BITS)
        used = np.flatnonzero(parts.any(axis=1)).tolist()
        packed = [zlib.compress(np.minimum(parts[i], 255).astype("u1").tobytes(), 1) for i in used]  # more is many, however many
        m = len(used)
        if m:
            yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.nulls(m, ident), pa.nulls(m, pa.int64()), pa.nulls(m, NODE_TYPE), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=names)

    return run


def _classes(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact below 128, an eighth of a power of two from there on."""
    high = 128 + 8 * np.log2(np.maximum(counts, 128) / 128)
    return np.where(counts < 128, counts, np.minimum(high, 255)).astype("u1")


def _estimate(classes: np.ndarray) -> np.ndarray:
    c = classes.astype("f8")
    return np.where(c < 128, c, 128 * 2 ** ((c - 128) / 8))


def _sketch(counts: DataFrame) -> bytes:
    """The merged sketch as one byte a counter: 8 MB at most, whatever the corpus."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(packed), "u1").astype("u8")
                sums[i] = sums[i] + part if i in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(_classes(x).tobytes(), 1) for x in sums.values()], pa.binary())], names=["slice", "counts"])

    spark = counts.sparkSession
    merged = counts.repartition(min(partitions(spark), 1 << (SKETCH_BITS - SLICE_BITS)), "slice").mapInArrow(merge, "slice int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, "u1")
    for row in merged.collect():
        out[row["slice"] << SLICE_BITS : (row["slice"] + 1) << SLICE_BITS] = np.frombuffer(zlib.decompress(row["counts"]), "u1")
    return out.tobytes()


def least_overlap(size: int, percent: int) -> int:
    """Common n-grams that a set of this size needs with any set that it is linked to."""
    return -(-percent * size // 100)


def parity_bits(h: np.ndarray, width: int = 0) -> bytes:
    """Bit i says whether an odd number of elements falls on it; width bits, or at least half as many as there are elements."""
    width = width or max(64, 1 << max(0, len(h) // 2 - 1).bit_length())
    return np.packbits((np.bincount((h & np.uint64(width - 1)).astype("i8"), minlength=width) & 1).astype("u1"), bitorder="little").tobytes()


def differing_bits(x: bytes, y: bytes) -> int:
    """At most the number of elements that are in one set alone. The longer bitmap is folded to the shorter one's length."""
    a, b = np.frombuffer(x, "u1"), np.frombuffer(y, "u1")
    if len(a) != len(b):
        few = min(len(a), len(b))
        a, b = (np.bitwise_xor.reduce(v.reshape(-1, few), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


PREFIX = f"kind int, node {NODE}, size bigint, matches int, grams array<bigint>, bits binary, parity array<bigint>, counts array<bigint>"



def _prefixes(n: int, percent: int, sketch):
    """A row per document (kind 0) and, for each batch of rows, n-grams that many of its prefixes hold, with counts (kind 1)."""
    names = ["kind", "node", "size", "matches", "grams", "bits", "parity", "counts"]

    def words(parity: tuple[bytes, ...]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(parity) + 1) * BITS, pa.int32()), pa.array(np.frombuffer(b"".join(parity), "<i8")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(sketch.value, "u1")
        for batch in batches:
            rows: list[tuple] = []
            listed: list[np.ndarray] = []
            for value in batch.column(0):
                h = ngrams(value.as_py(), n)
                if not len(h):
                    continue
                rarity = classes[h >> np.uint64(64 - SKETCH_BITS)]
                need = least_overlap(len(h), percent)
                most = min(MATCHES, need)
                order = np.lexsort((h, rarity))[: len(h) - need + most]
                lists = np.cumsum(_estimate(rarity[order]))
                costs = [lists[len(h) - need + k - 1] * (1 + VERIFY_COST / k) for k in range(1, most + 1)]
                matches = 1 + int(np.argmin(costs))
                grams = h[order[: len(h) - need + matches]].view("i8")
                listed.append(grams[: len(h) - need + 1])
                rows.append((node_of(h), len(h), matches, grams, parity_bits(h), parity_bits(h, 64 * BITS)))
            if rows:
                node, size, matches, grams, bits, parity = zip(*rows, strict=True)
                offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(grams)))
                m = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), node_array(list(node)), pa.array(size, pa.int64()), pa.array(matches, pa.int32()), lists, pa.array(bits, pa.binary()), words(parity), pa.nulls(m, pa.list_(pa.int64()))], names=names)
                gram, count = np.unique(np.concatenate(listed), return_counts=True)
                often = count >= max(4, m // HOT_SHARE)
                if often.any():
                    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype("i8")))
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.nulls(1, NODE_TYPE), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), whole(gram[often]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int64())), whole(count[often])], names=names)

    return run


def _need(size: Column, percent: int) -> Column:
    return F.ceil(size * percent / 100)


def _may_link(percent: int) -> Column:
    """Sizes and what is left of both sets at the shared n-gram allow the threshold."""
    left = F.least(F.col("size") - F.col("pos"), F.col("size2") - F.col("pos2"))
    return (F.least("size", "size2") * 100 >= F.greatest("size", "size2") * percent) & (left * (100 + percent) >= (F.col("size") + F.col("size2")) * percent)


ENTRY = f"gram bigint, salted boolean, many boolean, node {NODE}, size int, pos int, node2 {NODE}, size2 int, pos2 int"


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a sorted list beside the list's first one, the pivot; many: the list is salted or has three nodes or more.
    A list of one node only is left out, unless it is salted, and so is one whose first entry, and thus every entry, comes
    too late for the smaller set of a pair.

    Of a list that may go on in the next batch the first two nodes are held, of one known to have more the pivot and the last."""
    names = ["gram", "salted", "many", "node", "size", "pos", "node2", "size2", "pos2"]
    held: pa.RecordBatch | None = None
    known = False  # the held list has three nodes or more, and the held rows are out

    def shown(t: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch | None, pa.RecordBatch, bool]:
        """Rows to give, rows to hold, and known anew."""
        gram, salt, late, size, pos = (t.column(x).to_numpy(zero_copy_only=False) for x in ("gram", "salt", "late", "size", "pos"))
        node = _halves(t.column("node"))
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])])
        again = np.concatenate([[False], (node[1:] == node[:-1]).all(axis=1)]) & ~new  # copies of a node follow each other
        pivot = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
        nodes = np.bincount(pivot, weights=~again, minlength=len(t))[pivot]
        if known:
            nodes[pivot == 0] += 1
        salted = salt[pivot] >= 0
        give = ~again & (salted | ((nodes > 1) & ~late[pivot]))
        if known:
            give[:2] = False
        tail = pivot == pivot[-1]
        more = bool(nodes[-1] > 2)
        if not last and not more:
            give &= ~tail
        hold = t.take(pa.array([int(pivot[-1]), len(t) - 1] if more else np.flatnonzero(tail & ~again)))
        at = np.flatnonzero(give)
        if not len(at):
            return None, hold, more
        first = pivot[at]
        columns = [pa.array(gram[at]), pa.array(salted[at]), pa.array((salted | (nodes > 2))[at]), t.column("node").take(pa.array(at)), pa.array(size[at]), pa.array(pos[at]), t.column("node").take(pa.array(first)), pa.array(size[first]), pa.array(pos[first])]
        return pa.RecordBatch.from_arrays(columns, names=names), hold, more

    for batch in batches:
        if len(batch):
            out, held, known = shown(batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0], False)
            if out is not None:
                yield out
    if held is not None and not known:
        out, _, _ = shown(held, True)
        if out is not None:
            yield out


def _lists(entries: DataFrame) -> DataFrame:
    """entries: gram, salt, late, node, size, pos."""
    dealt = entries.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "late", "pos", "node")
    return dealt.select("gram", "salt", "late", "node", "size", "pos").mapInArrow(_met, ENTRY)


def _likely(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with min(matches) common n-grams in the prefixes for that number, and bitmaps that allow the threshold."""
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    asked = parted(ends)(prefixes, F.col("node"))[1]  # prefixes are large, and few nodes have pairs
    few = written(asked.join(ends, "node", "left_semi").groupBy("node").agg(F.first(F.struct("size", "matches", "grams", "bits")).alias("p")), "prefixes-used")
    side = lambda x: few.select(F.col("node").alias(x), *(F.col(f"p.{c}").alias(f"{x}_{c}") for c in ("size", "matches", "grams", "bits")))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            sizes, matches, bits, grams = ([batch.column(f"{x}_{c}") for x in "ab"] for c in ("size", "matches", "bits", "grams"))
            for i, (s, t, k, m, x, y) in enumerate(zip(*(c.to_pylist() for c in (*sizes, *matches, *bits)), strict=True)):
                common = -(-percent * (s + t) // (100 + percent))
                fits = differing_bits(x, y) <= s + t - 2 * common
                if fits:
                    k = min(k, m)
                    g, h = (c[i].values.to_numpy()[: size - least_overlap(size, percent) + k] for c, size in zip(grams, (s, t), strict=True))
                    fits = len(np.intersect1d(g, h, assume_unique=True)) >= k
                keep.append(fits)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in "ab"], names=["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *(f"{x}_{c}" for x in "ab" for c in ("size", "matches", "grams", "bits")))
    out = written(both.mapInArrow(test, f"a {NODE}, b {NODE}"), "likely")
    removed(few, ends)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links among the written pairs (a, b). docs: ident, text; firsts: node, ident of one document."""
    wanted = firsts.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", F.col("ident").alias("__ident"))
    wanted = written(wanted, "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(node, h) for node, text in zip(_halves(batch.column(0)), batch.column(1), strict=True) if node_of(h := ngrams(text.as_py(), n)) == node.tobytes()]
            yield pa.RecordBatch.from_arrays([node_array([x.tobytes() for x, _ in made]), pa.array([h.tobytes() for _, h in made], pa.binary())], names=["node", "grams"])

    few = wanted.count() <= BROADCAST_ROWS
    side, asked = (F.broadcast(wanted), docs) if few else (wanted, parted(wanted.select("__ident"))(docs, F.col("ident"))[1])
    found = asked.join(side, F.col("ident").eqNullSafe(F.col("__ident"))).select("node", "text").mapInArrow(sets, f"node {NODE}, grams binary")
    found = written(found.dropDuplicates(["node"]), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(left.as_py(), "u8"), np.frombuffer(right.as_py(), "u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    both = pairs.join(found.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(found.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    links = written(both.select("a", "b", "x", "y").mapInArrow(compare, f"a {NODE}, b {NODE}"), "verified")
    removed(found, wanted, pairs)
    return links


def _hot(marks: DataFrame, rows: int) -> DataFrame:
    """gram, salts: n-grams of many prefixes. At most HOT_SHARE times the mean number of n-grams a prefix."""
    counted = marks.select(F.explode(F.arrays_zip("grams", "counts")).alias("x")).groupBy(F.col("x.grams").alias("gram")).agg(F.sum("x.counts").alias("n"))
    least = max(HOT_ROWS, rows // HOT_SHARE)
    return counted.where(F.col("n") >= least).select("gram", F.ceil(2 * F.col("n") / least).alias("salts"))


def _between(entries: DataFrame, labels: DataFrame, parity: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a list, and are not pairs with its pivot, in question still."""
    few = entries.where("salted OR (many AND node <> node2)").select("gram", "node", "size", "pos")
    sides = few.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_label = sides.groupBy("gram", "label").agg(F.count("*").alias("n"))
    apart = of_label.groupBy("gram").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("off")).where("off > 0")
    kept = written(sides.join(apart.withColumn("salts", (F.floor(F.col("off") / HEAVY) + 1).cast("int")).drop("off"), "gram"), "apart")
    known = parity.join(kept.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("parity").alias("parity"))
    sides = written(kept.join(known, "node").select("*", *(F.col("parity")[i].alias(f"x{i}") for i in range(BITS))).drop("parity"), "sides")
    one = sides.where("label <> main").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).drop("salts")
    other = sides.select("gram", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *(F.col(c).alias(f"{c}2") for c in ("node", "size", "pos", "label")), *(F.col(f"x{i}").alias(f"y{i}") for i in range(BITS)))
    differing = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(1, BITS)), F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))))
    total = F.col("size") + F.col("size2")
    alike = differing <= total - 2 * F.ceil(total * percent / (100 + percent))  # at most so many n-grams are in one set alone
    rest = one.join(other, ["gram", "salt"]).where((F.col("label") != F.col("label2")) & ((F.col("label2") == F.col("main")) | (F.col("node") < F.col("node2"))) & _may_link(percent) & alike)
    out = written(_ordered(rest), "rest-pairs")
    removed(kept, sides)
    return out


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def linked_components(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """One row per document: ident, n_shingles, component_id (smallest identifier reachable by links)."""
    spark = docs.sparkSession
    slim = docs.select(F.col(ident).alias("ident"), F.col(text).alias("text"))
    kind = slim.schema["ident"].dataType.simpleString()
    arrow = pa.binary() if kind == "binary" else pa.int64()
    slim = slim if kind == "binary" else slim.withColumn("ident", F.col("ident").cast("long"))
    first = written(slim.mapInArrow(_nodes_and_counts(n, arrow), f"kind int, ident {'binary' if kind == 'binary' else 'bigint'}, size bigint, node {NODE}, slice int, counts binary"), "nodes")
    rows = written(first.where("kind = 0").select("ident", "size", "node"), "rows")
    sketch = spark.sparkContext.broadcast(_sketch(first.where("kind = 1").select("slice", "counts")))
    removed(first)
    made = written(slim.select("text").mapInArrow(_prefixes(n, percent, sketch), PREFIX), "prefixes")
    prefixes = made.where("kind = 0").select("node", "size", "matches", "grams", "bits")
    firsts = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("ident").alias("ident"), F.count("*").alias("copies"))

    size = F.col("size")
    listed = prefixes.select("node", F.col("size").cast("int").alias("size"), F.posexplode(F.slice(F.col("grams"), F.lit(1), (size - _need(size, percent) + 1).cast("int"))).alias("pos", "gram"))
    late = (size - F.col("pos")) * (100 + percent) < size * 2 * percent  # too late for the smaller set of a pair
    listed = listed.join(F.broadcast(_hot(made.where("kind = 1"), rows.count())), "gram", "left")
    salt = F.when(F.col("salts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("node"), F.col("salts"))).cast("int")
    entries = written(_lists(listed.select("gram", salt.alias("salt"), late.alias("late"), "node", "size", "pos")), "entries")
    pivots = entries.where(F.col("salted") & (F.col("node") == F.col("node2"))).select("gram", F.lit(-1).alias("salt"), F.lit(False).alias("late"), "node", "size", "pos")
    starred = entries.unionByName(_lists(pivots)).where((F.col("node") != F.col("node2")) & _may_link(percent))
    candidates = written(_ordered(starred), "pivot-pairs")
    links = _verified(_likely(candidates, prefixes, percent), slim, firsts, n, percent)
    labels = components(links)

    apart = _between(entries, labels, made.where("kind = 0").select("node", "parity"), percent)
    removed(candidates, entries)
    more = _verified(_likely(apart, prefixes, percent), slim, firsts, n, percent)
    removed(apart, made)
    labels = components(links.unionByName(more))

    grouped = firsts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = grouped.groupBy("label").agg(F.min("ident").alias("component"), F.sum("copies").alias("members")).where("members > 1")
    of_node = grouped.select("node", "label").join(least, "label").select("node", "component")
    return rows.join(of_node, "node", "left").select(F.col("ident").alias(ident), F.col("size").alias("n_shingles"), F.coalesce("component", "ident").alias("component_id"))


def drop_linked(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """docs without near copies: of each component the row with the smallest identifier stays. Columns as they came.

    Rows are told apart by a 128-bit digest of identifier and text, so null and repeated identifiers are rows like others. A
    null identifier counts as larger than any, ties go by the digest, and of rows that repeat the chosen identifier and
    text one stays. Rows without a word all stay. Nothing is joined by component, so a large one is no single task. Only texts
    whose identifier may be one of a row that goes, or of one that repeats the chosen row, are shuffled.
    """
    columns = docs.columns
    name = F.concat_ws("/", F.coalesce(F.length(F.col(ident).cast("string")), F.lit(-1)).cast("string"), F.col(ident).cast("string"), F.coalesce(F.col(text), F.lit("")))
    key = F.unhex(F.md5(name))
    keyed = docs.withColumn("__key", key)
    rows = linked_components(keyed, n, percent, text, "__key").where("n_shingles > 0").groupBy("__key").agg(F.first("component_id").alias("__component"), F.count("*").alias("__n"))
    ids = keyed.groupBy("__key").agg(F.min(ident).alias("__id"))
    members = written(rows.join(ids, "__key"), "members")
    chosen = members.groupBy("__component").agg(F.min_by(F.struct("__key", "__n"), F.struct(F.col("__id").isNull(), "__id", "__key")).alias("c"))
    chosen = written(chosen.select("c.__key", "c.__n"), "chosen")
    gone = written(members.join(chosen, "__key", "left_anti").select("__key", "__id"), "gone")
    again = chosen.where("__n > 1").select("__key")
    repeats = not again.isEmpty()
    ends = gone.unionByName(members.join(again, "__key", "left_semi").select("__key", "__id")) if repeats else gone
    rest, asked = parted(ends.select("__id"))(docs, F.col(ident))
    left = asked.withColumn("__key", key).join(gone.select("__key"), "__key", "left_anti")
    if repeats:
        left = left.join(again, "__key", "left_anti").unionByName(left.join(again, "__key", "left_semi").dropDuplicates(["__key"]))
    return rest.select(*columns).unionByName(left.select(*columns))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"), n=3, percent=90)
