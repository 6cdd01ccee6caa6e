"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that ends the BPE encoding of that prefix. ``Prefixes`` stores
it per prefix: the encoding is read backwards from the end, an append only adds entries, and an edit keeps every entry
before it. A token may end a prefix if it is compatible with the last token of the prefix before it, that is, if
undoing the two tokens' merges from the latest to the earliest never shows a merge across their border that BPE would
have made first.

Encoding runs in each task on Arrow batches. An automaton yields the tokens that end at each byte; chunks and pieces met
before in that task come from bounded caches of two generations: when one is full, the one before it is given up. No shuffle. Defined results: null text is encoded as empty (no ids); empty tables give empty tables;
repeated rows are encoded alike; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._common import freed, places_of_none, small_batches, table

#: Entries of a generation of pieces and chunks, of which there are two at a time, and pairs of tokens.
CACHE_PIECES, CACHE_CHUNKS, KNOWN_PAIRS = 100_000, 30_000, 200_000
_NONE = 1 << 30


class Vocabulary:
    """Ranks, the merge that makes each token, and the longest token to look for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for raw, rank in ranks.items():
            self.bytes_of[rank] = raw
        self.halves: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        self.loose: set[int] = set()  # tokens that no merge makes: only a piece that equals one yields it
        for rank, raw in sorted((r, b) for b, r in ranks.items()):
            if len(raw) == 1:
                continue
            parts = self._merged(raw, rank)
            if len(parts) == 2:
                self.halves[rank] = (parts[0], parts[1])
                self.merges[parts[0], parts[1]] = rank
            else:
                self.loose.add(rank)
        #: Finds all tokens that end at each byte, longest first. Bytes are put as the characters of the same number.
        self.ends = ahocorasick.Automaton()
        for raw, rank in ranks.items():
            if rank not in self.loose:
                self.ends.add_word(raw.decode("latin-1"), (len(raw), rank))
        self.ends.make_automaton()
        self.longest = max(map(len, ranks))
        self.known: dict[int, bool] = {}

    def _merged(self, raw: bytes, below: int) -> list[int]:
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], _NONE))
            if self.ranks.get(parts[at] + parts[at + 1], _NONE) >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE keeps the border between two neighbouring tokens.

        Walk back through both tokens' merges, the latest first. ``before`` is the rank under which a merge across the
        border would have come first; of equal ranks the leftmost merge comes first.
        """
        before = _NONE
        while True:
            across = self.merges.get((left, right))
            if across is not None and across < before:
                return False
            if left > right:
                before = left
                if left not in self.halves:
                    if right not in self.halves:
                        return True
                    before, right = right + 1, self.halves[right][0]
                else:
                    left = self.halves[left][1]
            elif right in self.halves:
                before, right = right + 1, self.halves[right][0]
            elif left in self.halves:
                before, left = left, self.halves[left][1]
            else:
                return True


class Prefixes:
    """The last token of every byte prefix of a text; exact under appends and edits."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.v, self.raw, self.last = vocabulary, b"", []
        self.append(raw)

    def append(self, raw: bytes) -> None:
        """One pass of the automaton: at each end the longest token that is compatible with what its start ends in."""
        done, self.raw = len(self.raw), self.raw + raw
        v, last = self.v, self.last
        known, begin = v.known, max(0, done - v.longest)
        for end, (size, token) in v.ends.iter(self.raw.decode("latin-1"), begin):
            if end < done:
                continue
            if size <= end:
                pair = last[end - size] << 32 | token
                fits = known.get(pair)
                if fits is None:
                    if len(known) >= KNOWN_PAIRS:
                        known.clear()
                    fits = known[pair] = size == 1 or v.compatible(pair >> 32, token)  # one byte fits if no longer token does
                if not fits:
                    continue
            last.append(token)
            done = end + 1

    def edit(self, start: int, stop: int, raw: bytes) -> None:
        """Put raw in place of bytes start to stop; entries before start stay, those after it are found anew."""
        tail = raw + self.raw[stop:]
        self.raw = self.raw[:start]
        del self.last[start:]
        self.append(tail)

    def tokens(self) -> list[int]:
        out, end = [], len(self.raw)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.v.bytes_of[out[-1]])
        return out[::-1]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_encoders: dict[tuple[str, str], Encoder] = {}


def _spaced(split) -> bool:
    """Whether a pattern's matches start at spaces as Encoder needs it, tried on texts of all kinds of characters."""
    kinds = ["a", "Z", "é", "日", "7", "٣", ".", "'", "'s", "'ll", "_", "\u0301", "\n", "\n\n", "\t", "\u00a0", "🙂", "\x00"]
    after = [k for k in kinds if not k.isspace()]
    return all(split(f"{x}{y} {z}{x}") == split(f"{x}{y}") + split(f" {z}{x}") for x in kinds for y in kinds for z in after)


class Encoder:
    """Splits by a pattern and encodes each match on its own.

    Texts are cut at single spaces first, and each chunk is looked up whole, if the pattern lets a match start at every space
    before a character that is not white space, and go back over no such space (``spaced``, the case of public PATTERN). A
    text where a space precedes white space or the end is split by the pattern as a whole.
    """

    def __init__(self, path: str, pattern: str, spaced: bool | None = None):
        self.v, self.split = Vocabulary(load_ranks(path)), regex.compile(pattern).findall
        self.spaced = _spaced(self.split) if spaced is None else spaced
        self.cache: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.older_cache: dict[str, bytes] = {}
        self.older_chunks: dict[str, bytes] = {}

    @staticmethod
    def of(path: str, pattern: str) -> Encoder:
        if (path, pattern) not in _encoders:
            _encoders[path, pattern] = Encoder(path, pattern)
        return _encoders[path, pattern]

    @staticmethod
    def forget() -> None:
        """Give up the worker's encoders. A nested function would clear a copy of _encoders, as it is pickled with its globals."""
        _encoders.clear()
        freed()

    def piece(self, raw: bytes) -> list[int]:
        whole = self.v.ranks.get(raw)
        return [whole] if whole is not None else Prefixes(self.v, raw).tokens()

    def _pieces(self, text: str) -> bytes:
        cache, out = self.cache, []
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.older_cache.get(piece)
                if ids is None:
                    ids = array("I", self.piece(piece.encode())).tobytes()
                if len(cache) >= CACHE_PIECES:
                    self.older_cache = cache
                    self.cache = cache = {}
                cache[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.spaced:
            return self._pieces(text)
        chunks, first = self.chunks, text.partition(" ")
        rest = first[2].split(" ") if first[1] else []
        found = list(map(chunks.get, rest))
        for at in places_of_none(found):
            chunk = rest[at]
            ids = chunks.get(chunk)
            if ids is None:
                ids = self.older_chunks.get(chunk)
                if ids is None:
                    if not chunk or chunk[0].isspace():
                        return self._pieces(text)
                    ids = self._pieces(" " + chunk)
                if len(chunks) >= CACHE_CHUNKS:
                    self.older_chunks = chunks
                    self.chunks = chunks = {}
                chunks[chunk] = ids
            found[at] = ids
        return b"".join([self._pieces(first[0]), *found])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", ident: str = "doc_id", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """ident and the outputs asked for: ids (array<int>), n_tokens, decoded (binary), ids_sha256, decoded_sha256."""
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "n_tokens": ("bigint", pa.int64()), "decoded": ("binary", pa.binary()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    small_batches(docs.sparkSession)
    slim = docs.select(ident, text)
    kind = slim.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, pattern)
        for batch in batches:
            found: dict[str, list] = {name: [] for name in outputs}
            for value in batch.column(1):
                ids = encoder.encode(value.as_py() or "")
                decoded = encoder.decode(ids) if {"decoded", "decoded_sha256"} & found.keys() else b""
                made = {
                    "ids": lambda ids=ids: np.frombuffer(ids, "<i4"),
                    "n_tokens": lambda ids=ids: len(ids) // 4,
                    "decoded": lambda decoded=decoded: decoded,
                    "ids_sha256": lambda ids=ids: hashlib.sha256(ids).hexdigest(),
                    "decoded_sha256": lambda decoded=decoded: hashlib.sha256(decoded).hexdigest(),
                }
                for name in outputs:
                    found[name].append(made[name]())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[n], kinds[n][1]) for n in outputs)], names=[ident, *outputs])
        del encoder
        Encoder.forget()  # the worker process may go on with another stage, which needs the memory

    return slim.mapInArrow(run, f"`{ident}` {kind}, " + ", ".join(f"{n} {kinds[n][0]}" for n in outputs))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return encoded(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
