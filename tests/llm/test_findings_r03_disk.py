"""F1 of round 3: texts without a copy are not shuffled by the pipeline's dedup stages, and results are those of brute force however full the filter is."""

import random

import pytest
from pyspark.sql import functions as F
from tidemark.llm import _common, exact_dedup, ngram_join


def shuffled(spark) -> int:
    """Bytes that all stages so far wrote to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture
def by_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def corpus(seed: int, n: int, words: int) -> list[tuple]:
    """Texts of random words; every tenth is a copy of one of the first ten, with other capitals. Some rows are repeated, some have no doc_id."""
    r = random.Random(seed)
    made = [(i, " ".join(f"{r.getrandbits(60):x}" for _ in range(words))) for i in range(n)]
    made = [(i, made[i // 10 % 10][1].upper() if i % 10 == 0 else t) for i, t in made]
    return [*made, made[5], made[5], made[-1], made[20], (None, made[30][1]), (None, made[30][1]), (None, "alone"), (None, None), (7, None)]


def test_texts_without_copies_stay_where_they_are(spark, by_shuffle):
    rows = corpus(1, 600, 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    size = sum(len(t or "") for _, t in rows) * 0.55  # hexadecimal digits, compressed
    for stage in (exact_dedup.drop_copies, lambda d: ngram_join.drop_linked(d, 500, 100)):  # sets of one or two n-grams: little besides texts
        before = shuffled(spark)
        _common.written(stage(docs), "out")
        assert shuffled(spark) - before < 0.6 * size


@pytest.mark.parametrize(("key_bits", "filter_bits"), [(64, 27), (1, 1)])
def test_results_do_not_depend_on_the_filter(spark, by_shuffle, monkeypatch, key_bits, filter_bits):
    monkeypatch.setattr(_common, "KEY_BITS", key_bits)
    monkeypatch.setattr(_common, "FILTER_BITS", filter_bits)  # of 1: 2 bits, nearly all rows are in question
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    rows = corpus(2, 120, 12)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, slot int, bit string").repartition(3)
    norm = lambda t: (t or "").lower()
    best = {}
    for i, t in rows:
        best[norm(t)] = max((x for x in (best.get(norm(t)), i) if x is not None), default=None)
    got = exact_dedup.drop_copies(docs, keep="max")
    assert got.columns == docs.columns and sorted((norm(r["text"]), str(r["doc_id"])) for r in got.collect()) == sorted((t, str(i)) for t, i in best.items())
    least = {}
    for i, t in rows:
        least[norm(t)] = min((x for x in (least.get(norm(t)), i) if x is not None), default=None)
    empty = [(norm(t), str(i)) for i, t in rows if not norm(t)]  # linked with nothing
    got = ngram_join.drop_linked(docs, 5, 80)
    assert sorted((norm(r["text"]), str(r["doc_id"])) for r in got.collect()) == sorted([*((t, str(i)) for t, i in least.items() if t), *empty])


def test_a_filter_loses_no_key(spark):
    keys = _common.written(spark.range(0, 3000, 3).selectExpr("CASE WHEN id > 0 THEN id END AS k"), "keys")
    rows = spark.range(60_000).selectExpr("CASE WHEN id > 0 THEN id END AS id", "1 AS bitmap", "2 AS bucket")
    rest, asked = _common.parted(keys)(rows, F.col("id"))
    assert rest.columns == asked.columns == rows.columns
    found = {r["id"] for r in asked.collect()}
    assert found >= {r["k"] for r in keys.collect()} and len(found) < 1000 + 59_000 * 0.03
    assert rest.count() + asked.count() == 60_000 and found.isdisjoint(r["id"] for r in rest.collect())
    rest, asked = _common.parted(keys.limit(0))(rows, F.col("id"))
    assert rest.count() == 60_000 and asked.isEmpty()
