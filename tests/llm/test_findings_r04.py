"""Time of op13 on large tables (F1)."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from tidemark.llm import collocations


def shuffled_bytes(spark) -> int:
    jvm = spark._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_what_is_shuffled_stays_in_proportion_when_a_sketch_would_be_full(spark):
    """Word pairs are all frequent and longer phrases all rare, and there are far more of them than 2 ** sketch_bits."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(30)]
    rows = [(" ".join(rng.choices(words, k=400)), "en") for _ in range(500)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4).cache()
    size = sum(len(t) for t, _ in rows)
    docs.count()
    before = shuffled_bytes(spark)
    found = collocations.phrase_counts(docs, collocations.Mining(least=150, sketch_bits=8)).collect()
    shuffled = shuffled_bytes(spark) - before
    assert {r["size"] for r in found} == {0, 1, 2} and sum(r["size"] == 2 for r in found) == len({(a, b) for t, _ in rows for a, b in zip(t.split(), t.split()[1:])})
    assert 0 < shuffled < 2 * size


@pytest.mark.parametrize("longest", [2, 3, 7])
def test_phrases_of_other_lengths(spark, longest):
    """Levels below and above those of the default length; numbers, breaks and ends of texts in any order."""
    rng = random.Random(longest)
    texts = ["".join(rng.choice(["a ", "b\t", "c ", "ß ", "rare%d " % rng.randrange(10**6), ". ", " ", "\n"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["one two three four five six seven eight"] * 25 + ["a a a a a a a a a", "", "."]
    want: Counter = Counter()
    for text in texts:
        for piece in re.split("[.\n]", text):
            w = piece.split()
            want.update(" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    docs = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string").repartition(3)
    got = collocations.phrase_counts(docs, collocations.Mining(longest=longest, least=20, cut=4, chunk_words=20, sketch_bits=3)).where("size > 0").collect()
    assert {r["phrase"]: r["n"] for r in got} == {p: n for p, n in want.items() if n >= 20} and all(r["size"] == len(r["phrase"].split()) for r in got)


def test_mixing_keys_is_one_to_one():
    x = np.random.default_rng(1).integers(0, 2**64, 10_000, np.uint64, endpoint=False)
    assert (collocations._unmixed(collocations._mixed(x)) == x).all()
