"""Token ids as ORC files.

Each file holds a range of ascending identifiers, sorted. ORC stores the id lists with integer run-length encoding in
stripes, with a row index every ``row_index_stride`` rows and a Bloom filter on the identifier, so readers can take
stripes in parallel and skip stripes by their statistics or Bloom filters (``lookup``). Positions of documents in the
whole token sequence come from one count per file, not from a pass in one task.

Ids are encoded where the texts are read, so only ids are shuffled. Range bounds are quantiles of the identifiers, one
per partition. Defined results: null text is empty (the end id alone); a null identifier sorts first; rows that repeat
an identifier follow each other, ordered by their ids; empty tables write no rows; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import new_path, partitions, places_of_none, table, uncollected
from .byte_bpe import tokenizer_file

CACHE_CHUNKS = 900_000
_encoders: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    """Encodes texts by the tokenizers library, each distinct white-space delimited chunk once.

    Exact for tokenizers that drop white space, lower-case letter by letter and never merge across white space; ASCII
    letters are lower-cased and ASCII white space is split on before the library sees a chunk. A chunk that ends in one
    full stop or comma after an ASCII letter is looked up without it. Chunks of lower-case letters alone are one word of
    the vocabulary's word ends each, so the library gets many of them as one text. Texts that hold the string of an added
    token (such as an end-of-text mark), in capitals too, go to the library whole, which gives that token's id where the
    string is exact, as its plain call does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        self.library = Tokenizer.from_file(path)
        self.added = [t.content.lower().encode() for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}
        self.ends = dict(zip(b".,", self._ids(["b", ".", ","])[1:], strict=True))

    @staticmethod
    def of(path: str) -> ChunkEncoder:
        if path not in _encoders:
            _encoders[path] = ChunkEncoder(path)
        return _encoders[path]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        groups = [words[i : i + 200] for i in range(0, len(words), 200)]
        for group, found in zip(groups, self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.kind)
            stops = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(stops) == len(group):
                raw, size = ids.tobytes(), ids.itemsize
                out += [raw[a * size : b * size] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
            else:
                out += self._ids(group)
        return out

    def _learn(self, new: set[bytes]) -> None:
        cache, ends = self.cache, self.ends
        marked = [c for c in new if c[-1] in ends and len(c) > 1 and 97 <= c[-2] <= 122]
        stems = new.difference(marked)
        stems.update(c[:-1] for c in marked if c[:-1] not in cache)
        words, other = [], []
        for text in map(bytes.decode, stems):
            (words if text.isalpha() and text == text.lower() else other).append(text)
        cache.update(zip(map(str.encode, words), self._word_ids(words), strict=True))
        cache.update(zip(map(str.encode, other), self._ids(other), strict=True))
        for c in marked:
            cache[c] = cache[c[:-1]] + ends[c[-1]]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned integers of self.kind."""
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        cache = self.cache
        raw = [(text or "").encode().lower() for text in texts]
        marked = [any(t in x for t in self.added) for x in raw]
        split = [[] if whole else x.split() for x, whole in zip(raw, marked, strict=True)]
        found = [list(map(cache.get, chunks)) for chunks in split]
        missing = [places_of_none(ids) for ids in found]
        self._learn({chunks[i] for chunks, places in zip(split, missing, strict=True) for i in places})
        for text, whole, chunks, ids, places in zip(texts, marked, split, found, missing, strict=True):
            for i in places:
                ids[i] = cache[chunks[i]]
            yield self._ids([text])[0] if whole else b"".join(ids)


def range_bounds(docs: DataFrame, ident: str, parts: int) -> list[int]:
    """At most parts - 1 ascending bounds: quantiles of the identifiers, read from that column alone."""
    shares = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx(ident, shares, 10_000)).first()[0] if shares else None
    return sorted(set(found or []))


def write_orc(
    docs: DataFrame, out: str, tokenizer: str, end_id: int, text: str = "text", ident: str = "doc_id", row_index_stride: int = 1000, stripe_bytes: int = 16 << 20, parts: int | None = None
) -> None:
    """Columns of the files: ident, part (file range, ascending), local_start, n_tokens, ids (array<int>)."""
    spark = docs.sparkSession
    bounds = np.array(range_bounds(docs, ident, parts or partitions(spark)), "int64")
    schema = pa.schema([(ident, pa.int64()), ("part", pa.int32()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(tokenizer)
        end = np.array([end_id], encoder.kind).tobytes()
        for some in (batch.slice(at, 256) for batch in batches for at in range(0, len(batch), 256)):
            key = some.column(0).cast(pa.int64())
            part = np.searchsorted(bounds, key.fill_null(-(2**63)).to_numpy(zero_copy_only=False), "right").astype("int32")
            with uncollected():
                ids = [x + end for x in encoder.encode(some.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([key, pa.array(part), pa.array(ids, pa.binary())], schema=schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, before, kind = 0, None, np.dtype(ChunkEncoder.of(tokenizer).kind)
        for batch in batches:
            key, part, raw = batch.columns
            sizes = np.array([len(x) // kind.itemsize for x in raw.to_pylist()], "int64")
            parts_here = part.to_numpy()
            starts = np.empty(len(sizes), "int64")
            for i, (p, n) in enumerate(zip(parts_here.tolist(), sizes.tolist(), strict=True)):
                start = start if p == before else 0
                starts[i], before, start = start, p, start + n
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            values = pa.array(np.frombuffer(b"".join(raw.to_pylist()), kind).astype("<i4"))
            yield pa.RecordBatch.from_arrays([key, part, pa.array(starts), pa.array(sizes), pa.ListArray.from_arrays(offsets, values)], names=[ident, "part", "local_start", "n_tokens", "ids"])

    ids = docs.select(F.col(ident).cast("long"), text).mapInArrow(encode, f"`{ident}` bigint, part int, ids binary")
    placed = ids.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.col(ident).asc_nulls_first(), "ids")
    placed = placed.mapInArrow(place, f"`{ident}` bigint, part int, local_start bigint, n_tokens bigint, ids array<int>")
    placed.write.options(**{"compression": "snappy", "orc.row.index.stride": row_index_stride, "orc.stripe.size": stripe_bytes, "orc.bloom.filter.columns": ident, "orc.bloom.filter.fpp": 0.01}).orc(out)


def read_orc(spark: SparkSession, path: str, ident: str = "doc_id") -> DataFrame:
    """ident, start (ids of all documents before it), n_tokens, ids. One count per range is broadcast, at most one a file."""
    rows = spark.read.orc(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.sum("n_tokens").alias("__n")).select("part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(starts), "part").select(ident, (F.col("__before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, wanted: list[int], ident: str = "doc_id") -> DataFrame:
    """Rows of some identifiers; ORC prunes stripes and row groups by statistics and Bloom filters."""
    return spark.read.orc(path).where(F.col(ident).isin(wanted))


def with_crc32(rows: DataFrame, ident: str = "doc_id") -> DataFrame:
    """ids become ids_crc32, of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat, at = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=[ident, "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(crc, f"`{ident}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "token-orc")
    write_orc(table(spark, sf_dir, "documents"), out, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return with_crc32(read_orc(spark, out))
