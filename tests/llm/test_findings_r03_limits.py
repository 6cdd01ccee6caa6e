"""Memory of an executor in byte-level BPE and language ID (F1), CPU of op4 (F2) and op2."""

import gc
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidemark.llm import _common, byte_bpe, language_id, token_orc, warc

SIZE = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def default_batches(spark):
    before = spark.conf.get(SIZE)
    spark.conf.unset(SIZE)
    yield
    spark.conf.set(SIZE, before)


def largest_batch(rows) -> int:
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)], pa.int64())], names=["n"]) for b in batches), "n long")
    return sizes.agg(F.max("n")).first()[0]


@pytest.mark.parametrize("stage", ["byte_bpe", "language_id"])
def test_a_task_is_not_one_batch(spark, default_batches, stage):
    docs = spark.range(5000).repartition(1).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    path = P.path("byte_bpe_multi_50k.tiktoken")
    made = byte_bpe.encoded(docs, path, P.PATTERN, outputs=("n_tokens",)) if stage == "byte_bpe" else language_id.predicted(docs, {"en": ["some words"], "de": ["andere"]})
    assert largest_batch(docs) <= 1000 and made.count() == 5000


def test_smaller_batches_of_the_user_stay(spark, default_batches):
    spark.conf.set(SIZE, "7")
    _common.small_batches(spark)
    assert spark.conf.get(SIZE) == "7"


def test_caches_keep_what_is_used_and_stay_small(monkeypatch):
    path, r = P.path("byte_bpe_multi_50k.tiktoken"), random.Random(3)
    fresh = byte_bpe.Encoder(path, P.PATTERN)
    texts = [" ".join(["again"] + ["".join(r.choices("abcäß.,!", k=r.randint(1, 9))) for _ in range(60)]) for _ in range(60)]
    want = [fresh.encode(t) for t in texts]
    for name, size in (("CACHE_PIECES", 50), ("CACHE_CHUNKS", 80), ("KNOWN_PAIRS", 30)):
        monkeypatch.setattr(byte_bpe, name, size)
    e = byte_bpe.Encoder(path, P.PATTERN)
    for text, ids in zip(texts, want, strict=True):
        assert e.encode(text) == ids and e.decode(ids) == text.encode()
        assert len(e.cache) <= 50 and len(e.chunks) <= 80 and len(e.v.known) <= 30
        assert len(e.older_cache) <= 50 and len(e.older_chunks) <= 80
        assert "again" in e.chunks or "again" in e.older_chunks or text.startswith("again")


def test_lines_are_spaced_as_by_split():
    r = random.Random(4)
    for _ in range(3000):
        line = "".join(r.choices(" \t\xa0 \x1f\x85​ab,é🙂", k=r.randint(0, 8)))
        assert warc._single_spaced(line) == " ".join(line.split())


def test_derived_files_are_those_of_the_steps(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<title>t {i}</title><p>a  b c<p> d &amp; e" * (i % 5)) for i in range(450)] + [(None, None, None)], "page_id long, url string, html string")
    source, a, b = (f"file://{tmp_path}/{x}" for x in "sab")
    warc.write_warc(warc.response_records(pages, "2024-01-01T00:00:00Z"), source)
    warc.write_warc(warc.derivatives(warc.read_warc(spark, source)), a)
    warc.derive_files(spark, source, b)
    rows = [sorted((tuple(sorted(r["headers"].items())), bytes(r["body"])) for r in warc.read_warc(spark, x).collect()) for x in (a, b)]
    assert rows[0] == rows[1] and len(rows[0]) == 902
    files = [r["content"] for r in spark.read.format("binaryFile").load(source).collect()]
    made = list(warc._rederived([pa.RecordBatch.from_arrays([pa.array(files)], names=["content"])]))
    assert max(map(len, made)) <= 200 and sum(map(len, made)) == 902


def test_words_are_encoded_without_searches_for_cycles():
    e = token_orc.ChunkEncoder(P.path("word_bpe_49k.json"))
    texts = [" ".join(f"Word{i}x{j}. über{j}" for j in range(300)) for i in range(60)]
    want = [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]
    found: list[str] = []
    note = lambda phase, _: found.append(phase)
    gc.callbacks.append(note)
    try:
        with _common.uncollected():
            got = list(e.encode(texts))
            assert not found
    finally:
        gc.callbacks.remove(note)
    assert gc.isenabled() and [len(x) // 2 for x in got] == list(map(len, want)) and [list(memoryview(x).cast("H")) for x in got] == want
