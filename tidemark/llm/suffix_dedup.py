"""Removal of repeated byte strings by a sparse, range-partitioned suffix sort.

Every byte covered by a string of ``length`` bytes that also starts anywhere else is removed. Suffixes are taken where they
can matter: each window of ``length`` bytes chooses the suffix at its smallest ``gram``-byte hash, so two equal windows
choose suffixes that start with the same gram at the same place. A suffix stands for the run of windows that chose it.

1. Suffixes are dealt to buckets by sampled splitters on their leading bytes and gram; a gram so frequent that several
   splitters fall on it is dealt over the buckets between them. Each bucket is sorted. Of neighbours with equal grams,
   those with equal runs are repeats as they stand; a suffix without an equal neighbour is done. Runs count as equal
   where three hashes agree: of the gram, of the run, and an independent one of all bytes of the run (192 bits).
2. What is left, one of each kind of run, is cut out of the texts and dealt by the same splitters. A bucket sorts these
   suffixes by their bytes (multikey sort, eight bytes at a time) and compares the windows of neighbours that share a
   gram: by hash first, then all bytes of windows with equal hashes. Windows of grams dealt over several buckets, or of one
   key with more rows than a task holds, are compared across by an aggregation of two independent hashes (128 bits).
3. The found intervals of a text are united and cut out.

Long texts are handled in blocks of bytes, each window in one block. Defined results: null text is empty; texts shorter than
``length`` lose nothing; rows that repeat a text lose all its windows, as each starts elsewhere too; empty tables give
empty tables; other columns are not read, so their names cannot clash; of rows that repeat identifier and text each one is cut.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import partitions, table, written

LENGTH, GRAM = 200, 40
BLOCK_BITS = 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
_bytes_hash = xxhash.xxh3_64_intdigest


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, "u8")
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
        _powers["byte"] = _mixed(np.arange(1, 257, dtype="u8"))
    return _powers["up"][:n], _powers["down"][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their low bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sums(raw: np.ndarray) -> np.ndarray:
    """Prefix sums that give the hash of every substring."""
    up, _ = _power(len(raw) + 1)
    out = np.zeros(len(raw) + 1, "u8")
    np.cumsum(_powers["byte"][raw] * up[: len(raw)], out=out[1:])
    return out


def _hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, down = _power(len(sums))
    return _mixed((sums[stop] - sums[start]) * down[start])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width neighbours, by running minima from both sides of blocks."""
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo("u8").max, "u8")
    full[:n] = x
    rows = full.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def chosen_suffixes(raw: bytes, length: int = LENGTH, gram: int = GRAM, checked: bool = True) -> dict[str, np.ndarray]:
    """Suffixes that windows choose: start (first window), count (windows), offset (of the suffix from start), hash of the
    gram, lead (first 4 bytes, big-endian), span (hash of all bytes of the run, with offset and count), check (another one
    of the bytes, 0 unless checked)."""
    found: list[list[np.ndarray]] = []
    data, block, width = np.frombuffer(raw, "u1"), 1 << BLOCK_BITS, length - gram + 1
    for at in range(0, len(data) - length + 1, block):
        part = data[at : at + block + length - 1]
        sums = _sums(part)
        places = np.arange(len(part) - gram + 1)
        grams = _hashes(sums, places, places + gram)
        low = np.uint64((1 << (BLOCK_BITS + 1)) - 1)
        best = (_sliding_min((grams & ~low) | places.astype("u8"), width) & low).astype("i8")
        first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        count = np.diff(np.concatenate([first, [len(best)]]))
        suffix = best[first]
        offset = suffix - first
        span = _mixed(_hashes(sums, first, first + count - 1 + length) + (offset * 65536 + count).astype("u8"))
        lead = np.zeros(len(suffix), "u8")
        for i in range(4):
            lead = lead << np.uint64(8) | part[suffix + i]
        ends = (first + count - 1 + length + at).tolist()
        check = np.fromiter((_bytes_hash(raw[i:j]) for i, j in zip((first + at).tolist(), ends, strict=True)), "u8", len(first)) if checked else np.zeros(len(first), "u8")
        found.append([first + at, count, offset, grams[suffix], lead, span, check])
    names = ["start", "count", "offset", "gram", "lead", "span", "check"]
    kinds = ["i8", "i8", "i8", "u8", "u8", "u8", "u8"]
    return {name: np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind) for i, (name, kind) in enumerate(zip(names, kinds, strict=True))}


def range_keys(found: dict[str, np.ndarray]) -> np.ndarray:
    """Order of the suffixes: by leading bytes, then by gram, as signed numbers of 52 bits (quantiles are doubles)."""
    return ((found["lead"] << np.uint64(32) | found["gram"] >> np.uint64(32)) ^ np.uint64(1 << 63)).view("i8") >> 12


class Splitters:
    """Ascending sampled keys; one that occurs more than once marks a key dealt over several buckets."""

    def __init__(self, keys: list[int]):
        self.keys = np.array(sorted(keys), "i8")

    def bucket(self, keys: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each key, and whether its key has several buckets."""
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        several = high - low > 1
        spread = low + (salt % np.maximum(high - low, 1).astype("u8")).astype("i8")
        return np.where(several, spread, high).astype("i4"), several


def _texts(docs: DataFrame, text: str, ident: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(ident).alias("ident"), F.xxhash64(F.col(ident), body).alias("row"), body.alias("text"))


def sampled_splitters(texts: DataFrame, buckets: int, length: int, gram: int, sample_rows: int = 4000) -> Splitters:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [range_keys(chosen_suffixes(value.as_py().encode(), length, gram, False)) for value in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, "i8"))], names=["key"])

    rows = texts.count()
    sample = texts.select("text").sample(min(1.0, sample_rows / rows), seed=7) if rows else texts.select("text")
    shares = [i / buckets for i in range(1, buckets)]
    found = sample.mapInArrow(keys, "key bigint").agg(F.percentile_approx("key", shares, 20_000)).first()[0] if shares else None
    return Splitters(found or [])


def _suffixes(splitters: Splitters, length: int, gram: int):
    names = ["part", "several", "key", "gram", "span", "check", "row", "start", "count", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = chosen_suffixes(value.as_py().encode(), length, gram)
                if not len(found["start"]):
                    continue
                key = range_keys(found)
                part, several = splitters.bucket(key, _mixed(found["span"] ^ np.uint64(row % 2**64)))
                columns = [part, several, key, found["gram"].view("i8"), found["span"].view("i8"), found["check"].view("i8"), np.full(len(key), row, "i8"), found["start"], found["count"].astype("i2"), found["offset"].astype("i2")]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


SUFFIX = "part int, several boolean, key bigint, gram bigint, span bigint, check bigint, row bigint, start bigint, count smallint, offset smallint"
MARKED = "row bigint, start bigint, stop bigint, offset smallint, open boolean"


def _marked(length: int):
    """From a sorted bucket: runs that are repeats (open false), and runs whose windows are to be compared (open true)."""

    def judge(t: pa.Table) -> pa.RecordBatch:
        """All rows but the first and the last, which only stand by as neighbours."""
        col = {n: t.column(n).to_numpy() for n in t.column_names}
        gram = col["gram"][1:] == col["gram"][:-1]
        span = gram & (col["span"][1:] == col["span"][:-1]) & (col["check"][1:] == col["check"][:-1])
        g0, g1, s0, s1 = gram[:-1], gram[1:], span[:-1], span[1:]
        several, equal = col["several"][1:-1], s0 | s1
        shown = (~s0 & g0) | (~s1 & g1) | several & ~s0  # an end of its run of equal spans that has another neighbour
        row, start, offset = (col[n][1:-1] for n in ("row", "start", "offset"))
        stop = start + col["count"][1:-1]
        both = [np.concatenate([x[equal], x[shown]]) for x in (row, start, stop, offset)]
        both[2] = np.concatenate([(stop - 1 + length)[equal], stop[shown]])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in both] + [pa.array(np.repeat([False, True], [equal.sum(), shown.sum()]))], names=["row", "start", "stop", "offset", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["several", "gram", "span", "check", "row", "start", "count", "offset"]
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch]).select(names)
            if not len(t):
                continue
            if held is None:
                held = edge(t.slice(0, 1), ~t.column("gram")[0].as_py())
            held = pa.concat_tables([held, t])
            if len(held) > 2:
                yield judge(held)
                held = held.slice(len(held) - 2)
        if held is not None:
            yield judge(pa.concat_tables([held, edge(held.slice(len(held) - 1), ~held.column("gram")[-1].as_py())]))

    def edge(t: pa.Table, gram: int) -> pa.Table:
        """A row of another gram, before the first or after the last."""
        return t.set_column(t.column_names.index("gram"), "gram", pa.array([gram], pa.int64()))

    return run


CUT = "part int, several boolean, key bigint, row bigint, start bigint, offset smallint, bytes binary"


def _cut(splitters: Splitters, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = value.as_py().encode()
                starts, offsets = [r["start"] for r in runs], np.array([r["offset"] for r in runs], "i8")
                pieces = [raw[r["start"] : r["stop"] - 1 + length] for r in runs]
                flat, bases = np.frombuffer(b"".join(pieces), "u1"), np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]])
                at = bases + offsets
                lead = np.zeros(len(at), "u8")
                for i in range(4):
                    lead = lead << np.uint64(8) | flat[at + i]
                key = range_keys({"lead": lead, "gram": _hashes(_sums(flat), at, at + gram)})
                part, several = splitters.bucket(key, _mixed(np.uint64(row % 2**64) + np.array(starts, "u8")))
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(several), pa.array(key), pa.array([row] * len(runs), pa.int64()), pa.array(starts, pa.int64()), pa.array(offsets.astype("i2")), pa.array(pieces, pa.binary())], names=["part", "several", "key", "row", "start", "offset", "bytes"])

    return run


def multikey_order(suffixes: list[bytes], length: int) -> np.ndarray:
    """Order of the suffixes by their first length bytes, eight at a time; each step only moves what is still equal."""
    words = -(-length // 8)
    matrix = np.frombuffer(b"".join(s[: words * 8].ljust(words * 8, b"\0") for s in suffixes), ">u8").reshape(-1, words)
    order, group = np.arange(len(suffixes)), np.zeros(len(suffixes), "i8")
    for column in range(words):
        tied = np.flatnonzero(np.bincount(group, minlength=len(group))[group] > 1) if column else np.arange(len(order))
        if not len(tied):
            break
        values = matrix[order[tied], column].astype("u8")
        inner = np.lexsort((values, group[tied]))
        order[tied], values = order[tied][inner], values[inner]
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (group[tied][inner][1:] != group[tied][inner][:-1])])
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
    return order


COMPARED = "row bigint, start bigint, stop bigint, hash bigint, check bigint"


def equal_windows(flat: np.ndarray, at: np.ndarray, hashes: np.ndarray, length: int) -> np.ndarray:
    """Which windows of flat, at these places, have an equal one among them: hashes find candidates, all bytes decide."""
    order = np.lexsort((at, hashes))
    sorted_hashes = hashes[order]
    new = np.concatenate([[True], sorted_hashes[1:] != sorted_hashes[:-1]]) if len(order) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else np.zeros(0, "i8")
    size = np.bincount(first, minlength=len(order))[first] if len(order) else first
    again = np.zeros(len(at), bool)
    again[order] = size > 1
    follows = np.flatnonzero(~new)
    windows = np.lib.stride_tricks.sliding_window_view(flat, length)
    for i in range(0, len(follows), 20_000):
        some = follows[i : i + 20_000]
        differs = (windows[at[order[some]]] != windows[at[order[first[some]]]]).any(axis=1)
        for head in np.unique(first[some[differs]]).tolist():  # equal hashes of different bytes: told apart by the bytes
            members = order[np.flatnonzero(first == head)]
            kinds = [windows[at[m]].tobytes() for m in members]
            again[members] = [kinds.count(k) > 1 for k in kinds]
    return again


def _compared(length: int, gram: int, hold: int = 20_000):
    """Of a bucket: intervals of repeated windows (hash null); windows to be compared with other tasks' (with hashes)."""

    def spans(row: np.ndarray, start: np.ndarray) -> list[pa.Array]:
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])) if len(row) else np.zeros(0, "i8")
        last = np.concatenate([new[1:], [len(row)]])[: len(new)] - 1
        return [pa.array(row[new]), pa.array(start[new]), pa.array(start[last] + length), pa.nulls(len(new), pa.int64()), pa.nulls(len(new), pa.int64())]

    def judge(several: list[bool], rows: list[int], starts: list[int], offsets: list[int], pieces: list[bytes]) -> Iterator[pa.RecordBatch]:
        names = ["row", "start", "stop", "hash", "check"]
        order = multikey_order([p[o:] for p, o in zip(pieces, offsets, strict=True)], length)
        heads = [pieces[i][offsets[i] : offsets[i] + gram] for i in order]
        near = np.array([a == b for a, b in zip(heads, heads[1:], strict=False)], bool)
        chosen = order[np.concatenate([[False], near]) | np.concatenate([near, [False]]) | np.array(several)[order]]
        if not len(chosen):
            return
        kept = [pieces[i] for i in chosen]
        flat, sizes = np.frombuffer(b"".join(kept), "u1"), np.array([len(p) for p in kept])
        counts = sizes - length + 1
        owner = np.repeat(np.arange(len(kept)), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(np.cumsum(sizes) - sizes, counts) + inside
        row, start, hashes = np.array(rows, "i8")[chosen][owner], np.array(starts, "i8")[chosen][owner] + inside, _hashes(_sums(flat), at, at + length)
        again = equal_windows(flat, at, hashes, length)
        yield pa.RecordBatch.from_arrays(spans(row[again], start[again]), names=names)
        wide = np.flatnonzero(np.array(several)[chosen][owner])
        for i in range(0, len(wide), 100_000):
            some = wide[i : i + 100_000]
            checks = np.fromiter((_bytes_hash(flat[x : x + length]) for x in at[some].tolist()), "u8", len(some))
            yield pa.RecordBatch.from_arrays([pa.array(row[some]), pa.array(start[some]), pa.array(start[some] + length), pa.array(hashes[some].view("i8")), pa.array(checks.view("i8"))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        keys: list[int] = []
        split = None  # a key with more rows than are held: its windows are compared across, as those of hot grams are
        for batch in batches:
            for i, name in enumerate(("several", "row", "start", "offset", "bytes")):
                held[i] += batch.column(name).to_pylist()
            keys += batch.column("key").to_pylist()
            if len(keys) > hold:  # rows come sorted by key, and equal grams have equal keys: whole keys can go
                cut = bisect.bisect_left(keys, keys[-1])
                if not cut:
                    split, cut = keys[0], len(keys)
                stop = bisect.bisect_right(keys, split) if split is not None else 0
                held[0][:stop] = [True] * stop
                yield from judge(*(x[:cut] for x in held))
                held, keys = [x[cut:] for x in held], keys[cut:]
        if keys:
            stop = bisect.bisect_right(keys, split) if split is not None else 0
            held[0][:stop] = [True] * stop
            yield from judge(*held)

    return run


def repeated_intervals(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """row, start, stop: byte intervals of repeated windows; they may overlap. texts: of _texts()."""
    buckets = partitions(texts.sparkSession)
    splitters = sampled_splitters(texts, buckets, length, gram)
    suffixes = texts.select("row", "text").mapInArrow(_suffixes(splitters, length, gram), SUFFIX)
    suffixes = suffixes.repartitionById(buckets, F.col("part")).sortWithinPartitions("key", "gram", "span", "check", "row", "start")
    marked = written(suffixes.mapInArrow(_marked(length), MARKED), "marked")

    runs = marked.where("open").groupBy("row").agg(F.collect_set(F.struct("start", "stop", "offset")).alias("runs"))
    pieces = texts.select("row", "text").join(runs, "row").mapInArrow(_cut(splitters, length, gram), CUT)
    pieces = pieces.repartitionById(buckets, F.col("part")).sortWithinPartitions("key")
    compared = written(pieces.mapInArrow(_compared(length, gram), COMPARED), "compared")

    wide = compared.where("hash IS NOT NULL")
    again = wide.groupBy("hash", "check").agg(F.count("*").alias("n")).where("n > 1").select("hash", "check")
    across = wide.join(again, ["hash", "check"]).select("row", "start", "stop")
    return marked.where("NOT open").select("row", "start", "stop").unionByName(compared.where("hash IS NULL").select("row", "start", "stop")).unionByName(across)


REMOVED = [("n_bytes", "bigint", pa.int64()), ("n_removed", "bigint", pa.int64()), ("n_spans", "bigint", pa.int64()), ("kept_text", "binary", pa.binary()), ("kept_sha256", "string", pa.string())]


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text", ident: str = "doc_id", outputs: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept_text")) -> DataFrame:
    """One row per document: ident and the outputs asked for. kept_text is bytes, as a cut may fall within a character."""
    texts = _texts(docs, text, ident)
    found = repeated_intervals(texts, length, gram).distinct().groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))
    chosen = [x for x in REMOVED if x[0] in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for value, cuts in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = value.as_py().encode()
                kept, at, gone, spans, last = [], 0, 0, 0, -1
                for start, stop in sorted((c["start"], c["stop"]) for c in cuts or []):
                    if start > last:
                        kept.append(raw[at:start])
                        spans += 1
                        gone += stop - start
                    elif stop > last:
                        gone += stop - last
                    last = max(last, stop)
                    at = last
                left = b"".join([*kept, raw[at:]])
                rows.append({"n_bytes": len(raw), "n_removed": gone, "n_spans": spans, "kept_text": left, "kept_sha256": hashlib.sha256(left).hexdigest()})
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[name] for r in rows], kind) for name, _, kind in chosen)], names=["ident", *(x[0] for x in chosen)])

    kind = texts.schema["ident"].dataType.simpleString()
    out = texts.join(found, "row", "left").select("ident", "text", "cuts").mapInArrow(run, f"ident {kind}, " + ", ".join(f"{n} {k}" for n, k, _ in chosen))
    return out.withColumnRenamed("ident", ident)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"), outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256"))
