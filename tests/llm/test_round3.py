"""Conversation repair, licence scans and collocations against brute force and edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations, conversations, license_scan

COSTS = conversations.Costs()


# ---- conversations ------------------------------------------------------------------------------------------------------


def cheapest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Every sequence by its cost and letters, by plain search over (rows read, state): keeps whole strings."""
    after = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"0": (0, "")}

    def inserted(best: dict) -> dict:
        out = dict(best)
        for _ in range(4):
            for state, (cost, text) in list(out.items()):
                for role in "ua":
                    if to := after.get((state, role)):
                        new = (cost + 2, text + "I")
                        if to not in out or new < out[to]:
                            out[to] = new
        return out

    for initial, fault in rows:
        found: dict = {}

        def put(to, cost, text):
            if to and (to not in found or (cost, text) < found[to]):  # noqa: B023
                found[to] = (cost, text)  # noqa: B023

        for state, (cost, text) in [*best.items(), *inserted(best).items()]:
            put(state, cost + 3, text + "D")
            if fault < 2:
                put(after.get((state, initial)), cost + (fault == 1), text + "K")
                for role in "ua":
                    put(after.get((state, role)), cost + 2 + (fault == 1), text + "R")
        best = found
    return min(v for state, v in inserted(best).items() if state in "0a")


def decoded(rows):
    d = conversations.Decoder(COSTS)
    most = 0
    for initial, fault in rows:
        d.row(initial, fault)
        most = max(most, d.unresolved())
    return d.end(), most


def test_decoder_equals_plain_search():
    rng = random.Random(7)
    for size in range(4):
        for rows in itertools.product([("s", 0), ("u", 0), ("a", 1), ("x", 0), ("u", 3)], repeat=size):
            assert decoded(rows)[0] == cheapest(list(rows))
    for _ in range(600):
        rows = [(rng.choice("ssuuuaaax "), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 40))]
        assert decoded(rows)[0] == cheapest(rows), rows


def test_decoder_memory_is_that_of_what_is_unresolved():
    rng = random.Random(8)
    usual = [("ua"[i % 2] if rng.random() > 0.1 else rng.choice("usa"), int(rng.random() < 0.1)) for i in range(20_000)]
    (cost, audit), most = decoded(usual)
    assert most < 200 and len(audit) >= 20_000
    (_, audit), most = decoded([("u", 3)] * 5000)
    assert audit == "D" * 5000 and most < 20
    (cost, audit), most = decoded([("u", 0)] * 301)  # parity of the length decides the second edit: nothing can be emitted before the end
    assert (cost, audit) == cheapest([("u", 0)] * 301) and most > 300


def plain_repair(rows: list[tuple]) -> dict:
    """conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of (conv, turn, role, text) after damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv and r[4] != 0), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
        seen, faults = set(), []
        for _, _, role, text, _ in mine:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append(3 if not solid else 2 if (role, text) in seen else 0 if solid[-1] in ".!?" else 1)
            seen.add((role, text))
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[2][:1] for r in mine]
        cost, audit = cheapest(list(zip(initials, faults)))
        state, lines, at = "0", [], 0
        nxt = {"0": "u", "s": "u", "a": "u", "u": "a"}
        for letter in audit:
            if letter == "I":
                state = nxt[state]
                lines.append({"u": "user", "a": "assistant"}[state] + ":")
                continue
            _, _, role, text, _ = mine[at]
            at += 1
            if letter != "D":
                state = role[:1] if letter == "K" else nxt[state]
                lines.append((role if letter == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + text)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(3), faults.count(2), faults.count(1), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def plain_damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code, role, text = zlib.crc32(key.encode()) % 20, role if role is not None else " ", text if text is not None else " "
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text, code)] * (2 if code == 3 else 1)
    return out


def test_repair_of_odd_tables(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 0, 1, 2, 2, 3, 9]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(["Yes.", "no", "", None, " \n", "Was ist das?", "ünï!", "x" * 50_000])) for _ in range(60)]
    rows += [(100 + c, t, "user" if t % 2 else "assistant", f"text {t}.") for c in range(40) for t in range(rng.randrange(1, 4))]
    rows += [(7, t, "user", "again and again") for t in range(300)] * 2
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, gone int")
    frame.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in conversations.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == plain_repair(plain_damage(rows))
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert conversations.op11_conversation_repair(spark, str(tmp_path / "none")).count() == 0


def test_repaired_turns_are_legal(spark, sf_dir):
    rows = conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    plans = conversations.repair_plans(rows, gone="gone")
    turns = conversations.repaired_turns(rows, plans, gone="gone").toPandas().sort_values(["conv", "step"])
    for _, part in turns.groupby("conv"):
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in part.role)) and list(part.step) == list(range(1, len(part) + 1))
    assert set(turns[turns.edit == "I"].text) <= {""} and set(turns.edit) == {"I", "K", "R"}


# ---- licences -----------------------------------------------------------------------------------------------------------

SCAN_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def base_places(text: str | None) -> list[tuple[int, str]]:
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    found = SCAN_WORD.findall(lower)
    return [(i, t.label) for t in license_scan.BASE for i in range(len(found)) if found[i : i + len(t.words())] == t.words()]


MIT = license_scan.NOTICES[0].text
LICENCES = [
    None, "", "no licence here", "Under the MIT License", "under the mit license under\tthe\nMIT-license", "cc by nc cc-by-nc CC BY NC 4.0", "Apache License, Version 2.0", "apache license version 20", "x" * 100_000 + " under the mit license",
    MIT, MIT.replace("copy of this", "full and complete copy of this"), MIT.replace("without restriction", "with restriction"), "Übersicht " + license_scan.NOTICES[5].text + " ende", "under the mit licenses", ("word " * 30_000) + "cc by nc", "this work is licensed under the gnu general public license, version 3.",
]


def test_licence_places_and_labels(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(LICENCES)] + [(None, LICENCES[3]), (3, LICENCES[3])]
    spark.createDataFrame([(*r, "clash", 2) for r in rows], "doc_id long, text string, places string, n_words int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = license_scan.op12_license_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = LICENCES[3] if r["doc_id"] is None else LICENCES[r["doc_id"]]
        places = base_places(text)
        starts = [i for i, _ in places]
        assert (r["n_base"], r["first_word"], r["last_word"]) == (len(places), min(starts, default=None), max(starts, default=None)), text
        assert r["base_labels"] == ",".join(sorted({label for _, label in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"]) and r["n_words"] == len(SCAN_WORD.findall((text or "").lower()))
    labels = {r["doc_id"]: (r["labels"], r["score"]) for r in got}
    assert labels[9] == ("mit", 1.0) and labels[11][0] == "" and labels[12] == ("gpl-3", 1.0) and labels[15] == ("gpl-3", 1.0) and labels[13][0] == ""
    assert labels[10][0] == "mit" and 0.3 < labels[10][1] < 1  # two words more than the notice: the key phrases stand within the slack
    assert labels[5][0] == "cc-by-nc,cc-by-nc-4"


# ---- collocations -------------------------------------------------------------------------------------------------------


def plain_collocations(rows: list[tuple], least: int = 100, first: int = 2000, longest: int = 5) -> list[tuple]:
    counts: dict = collections.defaultdict(collections.Counter)
    total: collections.Counter = collections.Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in some.items():
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and b == a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in some.items()):
                found.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, total[lang], score) for i, (score, a, p, left, right) in enumerate(found[:first])]
    return sorted(out)


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(3)
    words = "the of Über straße ab cd ef gh ij kl mn op ÄB é".split()
    fixed = ["new york city hall", "once upon a time there was", "the the the the"]
    rows = []
    for i in range(900):
        piece = lambda: " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randrange(1, 60)))
        text = "".join(f"{piece()}{rng.choice(['. ', ', ', chr(10), ' ; ', chr(11), ':'])}{rng.choice(fixed) if rng.random() < 0.4 else ''}{rng.choice(['!', ' ', chr(9), '  '])}" for _ in range(4))
        rows.append((text, rng.choice(["en", "en", "de", None])))
    return rows + [(None, "en"), ("", None), ("...", "fr"), ("  \t ", "fr"), ("again " * 30_000, "la"), (rows[0][0], rows[0][1])]


@pytest.mark.parametrize("cut,chunk_words,sketch_bits", [(32, 4096, 23), (3, 50, 12), (1, 4096, 8)])
def test_collocations_equal_counting(spark, phrases, cut, chunk_words, sketch_bits):
    """Also with chunks cut everywhere, capped ones, and sketches so small that they throw out little or nothing."""
    m = collocations.Mining(least=40, cut=cut, chunk_words=chunk_words, sketch_bits=sketch_bits)
    docs = spark.createDataFrame([(*r, 1, "x") for r in phrases], "text string, lang string, n int, phrase string").repartition(4)
    got = collocations.ranked(collocations.collocations(collocations.phrase_counts(docs, m), m), m)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == plain_collocations(phrases, 40)


def test_collocation_arithmetic_passes_64_bits(spark):
    big = 10**15
    counts = spark.createDataFrame([("x", "a b", 2, big + 1), ("x", "a", 1, 3 * big), ("x", "b", 1, 5 * big + 7), ("x", "", 0, 10**17)], "lang string, phrase string, size int, n long")
    r = collocations.collocations(counts).first()
    assert r["score"] == 1000 * (big + 1) * 10**17 // (3 * big * (5 * big + 7)) and (r["l"], r["r"], r["n"]) == (3 * big, 5 * big + 7, 10**17)
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.ranked(collocations.collocations(collocations.phrase_counts(empty))).count() == 0
