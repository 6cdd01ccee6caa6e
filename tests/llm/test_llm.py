"""Training-data operators against brute force, libraries, round trips and edge cases."""

import gzip
import hashlib
import os
import random
import re
import struct
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import public_tokenizers as P  # noqa: E402
import tiktoken  # noqa: E402
from oracle import differences, duck  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from tidemark.llm import byte_bpe, exact_dedup, html_text, language_id, mixing, ngram_join, quality_rules, suffix_dedup, token_orc, warc  # noqa: E402
from tidemark.llm.components import components  # noqa: E402
from tidemark.llm.queries import ORACLES, QUERIES  # noqa: E402

random.seed(11)
VOCAB = "the of and thing never ever blue sky Über straße été niño a b c d e f g h".split()
LONG = " ".join(random.choice(VOCAB) for _ in range(20_000))
TEXTS = [None, "", "   \n\t", "one", "ONE", "two words", "Hello, World! It's 42 (really).", "Äpfel und Öl – naïve café x 日本語 🙂", LONG, LONG + " end", "same line\nsame line\n\nsame line", "x" * 3000, "| a | b | # $ %"]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (3, "one"), (None, "two words"), (100, None)]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, ties, repeated rows, long and empty texts, and columns whose names clash with working columns."""
    return spark.createDataFrame([(i, t, None, None if i is None else f"s{i % 3}", "z", 7, 1.5) for i, t in ROWS], "doc_id long, text string, lang string, source string, kept string, n long, score double").repartition(3)


def by_text(frame, rows=ROWS):
    return {(None if r["doc_id"] is None or r["doc_id"] != r["doc_id"] else int(r["doc_id"])): r for r in frame.to_dict("records")}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    assert len(found)
    if name in ORACLES:
        assert not differences(found, duck(sf_dir, ORACLES[name]))


def test_exact_dedup(docs):
    got = exact_dedup.exact_groups(docs, keep="max").toPandas()
    assert len(got) == len(ROWS)
    sizes = {i: 0 for i, _ in ROWS}
    norm = lambda t: (t or "").translate(brute.LOWER)
    for r in got.to_dict("records"):
        same = [i for i, t in ROWS if hashlib.sha256(norm(t).encode()).hexdigest() == r["text_sha256"]]
        assert r["group_size"] == len(same) and r["keep_id"] == max(x for x in same if x is not None)
    assert sizes
    kept = exact_dedup.drop_copies(docs, keep="max")
    assert kept.columns == docs.columns and kept.count() == len({norm(t) for _, t in ROWS})
    assert exact_dedup.drop_copies(docs.limit(0)).isEmpty()


@pytest.mark.parametrize("leaves", [1, 2, 3, 16, 33])
def test_runs_are_partitions_and_rounds_binary(spark, leaves):
    """Every exchange is by run alone; each power of two of runs gives what grouping gives, whatever the copies."""
    rows = [(random.choice([None, *range(50)]), random.choice(["a", "b", "", None, "C", "c", *map(str, range(40))])) for _ in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    merged = exact_dedup.merged_runs(exact_dedup.digests(df), "min", leaves)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    rounds = max(1, (max(2, leaves) - 1).bit_length())
    assert plan.count("Exchange") == plan.count("shufflepartitionidpassthrough") == rounds + 1 and "hashpartitioning" not in plan
    want = {}
    for i, t in rows:
        key = hashlib.sha256((t or "").translate(brute.LOWER).encode()).hexdigest()
        best, size = want.get(key, (None, 0))
        want[key] = (i if best is None else best if i is None else min(best, i), size + 1)
    assert {r["__sha"].hex(): (r["__keep"], r["__size"]) for r in merged.collect()} == want


def test_different_texts_of_one_digest_stop_the_job(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_sha", lambda text: F.unhex(F.sha2(F.lit("same"), 256)))
    df = spark.createDataFrame([(1, "ab"), (2, "cd")], "doc_id long, text string")
    copies = exact_dedup.digests(df).select("__sha", "__len", "__second").limit(1)
    exact_dedup.verify(df, copies)  # the second hash tells them apart
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    with pytest.raises(ValueError, match="share the digest"):
        exact_dedup.verify(df, exact_dedup.digests(df).select("__sha", "__len", "__second").limit(1))


def test_ngram_join(spark, docs):
    got = ngram_join.linked_components(docs, 3, 90).toPandas()
    want = brute.components(ROWS, 3, 90)
    nan = lambda x: None if x is None or x != x else int(x)
    assert sorted((str(nan(r[0])), r[1], str(nan(r[2]))) for r in got.itertuples(index=False)) == sorted((str(ROWS[i][0]), n, str(c)) for i, (n, c) in want.items())
    base = [random.choice(VOCAB) + str(random.randint(0, 30)) for _ in range(60)]
    rows = []
    for i in range(150):
        w = list(base) if i % 3 else [random.choice(VOCAB) + str(random.randint(0, 30)) for _ in range(40)]
        for _ in range(random.randint(0, 3)):
            w[random.randrange(len(w))] = f"q{random.randint(0, 50)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for n, percent in ((3, 90), (5, 80), (2, 60)):
        want = brute.components(rows, n, percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked_components(df, n, percent).collect()}
        assert got == {rows[i][0]: v for i, v in want.items()}
    assert ngram_join.linked_components(df.limit(0)).isEmpty()


def test_components_of_chains_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(100, 101), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_suffix_dedup(spark, docs):
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = suffix_dedup.removed(docs, outputs=tuple(names)).toPandas()
    assert sorted(map(tuple, got[names].to_numpy().tolist())) == sorted(brute.repeats([t for _, t in ROWS], 200))
    blocks = ["".join(random.choice("ab") for _ in range(90)) for _ in range(3)]
    texts = []
    for _ in range(120):
        x, c = random.choice(blocks), random.randint(0, 70)
        texts.append(random.choice([x, x[:c] + "".join(random.choice("abc") for _ in range(9)) + x[c:], "ab" * random.randint(1, 40), "".join(random.choice("abcé") for _ in range(60)), None]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    for length, gram in ((20, 6), (30, 11)):
        got = suffix_dedup.removed(df, length, gram, outputs=tuple(names)).orderBy("doc_id").toPandas()
        assert list(map(tuple, got[names].to_numpy().tolist())) == brute.repeats(texts, length)
    assert suffix_dedup.removed(df.limit(0)).isEmpty()


def test_suffix_sort_and_blocks(monkeypatch):
    parts = [bytes(random.choice(b"ab") for _ in range(random.randint(8, 40))) for _ in range(300)]
    order = suffix_dedup.multikey_order(parts, 16)
    assert [parts[i][:16].ljust(16, b"\0") for i in order] == sorted(p[:16].ljust(16, b"\0") for p in parts)
    raw = bytes(random.choice(b"abcd") for _ in range(5000))
    whole = suffix_dedup.chosen_suffixes(raw, 50, 10)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BITS", 10)
    cut = suffix_dedup.chosen_suffixes(raw, 50, 10)
    windows = lambda f: sorted((s + i, s + o) for s, c, o in zip(f["start"], f["count"], f["offset"], strict=True) for i in range(c))
    assert windows(whole) == windows(cut) and len(windows(whole)) == 5000 - 49


def test_quality_rules(docs):
    got = quality_rules.judge(docs.select("doc_id", "text", "source")).toPandas()
    want = sorted(brute.quality(t) for _, t in ROWS)
    assert sorted(map(tuple, got[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].to_numpy().tolist())) == want
    assert (got.kept == got.rejected_by.isna()).all() and (got.base_failed == ((got.n_words < 20) | (100 * got.n_repeat_words > 30 * got.n_words))).all()


def test_rule_order_changes_cost_only(spark, docs):
    m = quality_rules.written(quality_rules.measured(docs.select("doc_id", "text")), "m")
    rules = quality_rules.default_rules()
    a = m.select("doc_id", quality_rules.cascade(m, rules).isNull().alias("k")).collect()
    b = m.select("doc_id", quality_rules.cascade(m, rules[::-1]).isNull().alias("k")).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    ticks = iter(range(1000))
    order = quality_rules.ordered_rules(m, rules, clock=lambda: next(ticks))
    rates = [share / seconds for _, seconds, share in order]
    assert rates == sorted(rates, reverse=True)


def test_byte_bpe(docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    e = byte_bpe.Encoder.of(path, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=e.v.ranks, special_tokens={})
    got = byte_bpe.encoded(docs, path, P.PATTERN, outputs=("ids", "n_tokens", "decoded")).toPandas()
    assert sorted(map(str, (list(x) for x in got.ids))) == sorted(str(library.encode_ordinary(t or "")) for _, t in ROWS)
    assert sorted(map(bytes, got.decoded)) == sorted((t or "").encode() for _, t in ROWS)
    for _ in range(300):
        raw = "".join(random.choice("theinand é日\n1.") for _ in range(random.randint(1, 40))).encode()
        p = byte_bpe.Prefixes(e.v)
        for i in range(len(raw)):
            p.append(raw[i : i + 1])
        assert p.tokens() == byte_bpe.Prefixes(e.v, raw).tokens() and b"".join(e.v.bytes_of[t] for t in p.tokens()) == raw
        a = random.randint(0, len(raw))
        b = random.randint(a, len(raw))
        p.edit(a, b, b"then")
        assert p.tokens() == byte_bpe.Prefixes(e.v, raw[:a] + b"then" + raw[b:]).tokens()
    assert byte_bpe.encoded(docs.limit(0), path, P.PATTERN).isEmpty()


def test_token_orc(spark, docs, tmp_path):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = f"file://{tmp_path}/orc"
    token_orc.write_orc(docs, out, path, 1, parts=4)
    got = token_orc.read_orc(spark, out).orderBy("start").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, struct.pack(f"<{len(r[1])}H", *r[1]))
    want = sorted(((i, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in ROWS), key=key)
    assert [(r["doc_id"], r["ids"]) for r in got] == want
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([len(x) for _, x in want])[:-1]]).tolist()
    crc = {zlib.crc32(np.array(x, "<u4").tobytes()) for _, x in want}
    assert {r["ids_crc32"] for r in token_orc.with_crc32(token_orc.read_orc(spark, out)).collect()} == crc
    assert token_orc.lookup(spark, out, [8, 9]).count() == 2
    encoder = token_orc.ChunkEncoder.of(path)
    marked = ["<|endoftext|> a", "a<|startoftext|>b c<|endoftext|>", "<|ENDOFTEXT|> a", "no mark", None, "a <| b", "<|endoftext|>" * 3]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(marked)] == [library.encode(t or "", add_special_tokens=False).ids for t in marked]
    for _ in range(50):
        some = ["".join(random.choice(["the", "Ünï", " ", ".", ",", "'s", "9", "日", "\n", "é.", "x" * 20, "e\u0301", "<|endoftext|>" if random.random() < 0.1 else "-"]) for _ in range(random.randint(0, 30))) for _ in range(20)]
        assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_token_orc_skips_stripes(spark, tmp_path):
    """A read of one identifier takes few of the rows of a file with several stripes and row groups."""
    out = f"file://{tmp_path}/orc"
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.md5(F.concat(F.col("id").cast("string"), F.lit(str(k)))) for k in range(2))).alias("text"))
    token_orc.write_orc(df, out, P.path("word_bpe_49k.json"), 1, parts=2, row_index_stride=1000, stripe_bytes=1 << 18)
    from pyarrow import orc

    files = [os.path.join(str(tmp_path), "orc", f) for f in os.listdir(os.path.join(str(tmp_path), "orc")) if f.endswith(".orc")]
    assert len(files) == 2 and all(orc.ORCFile(f).nstripes > 2 for f in files)
    scan = token_orc.lookup(spark, out, [777])
    assert len(scan.collect()) == 1
    leaf = scan._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert 1 <= leaf.metrics().apply("numOutputRows").value() <= 6000  # of 60,000: whole stripes and row groups are skipped


def test_language_id(spark, docs):
    rows = [(i, f"{random.choice(['the cat and the dog', 'the house of things'])} number {i}" if i % 2 else f"{random.choice(['el perro y la casa', 'los niños que corren'])} numero {i}", "en" if i % 2 else "es") for i in range(200)]
    rows += [(1000 + i, "zzz zzz zzz", "en") for i in range(300)]  # a large group of copies is one text of the sample
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language_id.training_texts(df, rows_per_language=50)
    assert {k: len(v) for k, v in samples.items()} == {"en": 50, "es": 50} and all(len(set(v)) == 50 for v in samples.values())
    assert sum(map(len, language_id.training_texts(df, letters_per_language=100)["es"])) <= 100
    assert len(language_id.training_texts(df, letters_per_language=1)["es"]) == 1
    dirty = df.unionByName(spark.createDataFrame([(10**6 + i, f"label {i}", f"x{i}") for i in range(60)], "doc_id long, text string, lang string"), allowMissingColumns=True)
    assert set(language_id.training_texts(dirty, languages=len(samples))) == set(samples)  # languages with the most rows
    got = language_id.identify(df).withColumn("held_out", language_id.held_out()).toPandas()
    held = got[got.held_out & (got.doc_id < 1000)]
    assert len(held) and (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    odd = language_id.predicted(docs, {"en": ["the"], "es": ["el"]}, names=("lang_pred", "sureness"))
    assert odd.columns == [*docs.columns, "lang_pred", "sureness"]  # a column score of the input is kept
    odd = odd.toPandas()
    assert len(odd) == len(ROWS) and (odd.score == 1.5).all() and (odd[odd.text.isna()].lang_pred == "und").all() and (odd[odd.text == "   \n\t"].lang_pred == "und").all()
    assert language_id.identify(docs).count() == len(ROWS)  # nothing labelled: all und
    assert language_id.identify(df.limit(0)).isEmpty()
    assert language_id.Parser({"b": ["same text"], "a": ["same text"]}).predict("same")[0] == "a"  # ties go by name
    assert language_id.Parser({"b": ["same text"]}).predict(LONG)[0] == "b"


def test_phrases_by_brute_force():
    """Longest matches over running text, words and spaces alike, found by trying every substring."""
    for _ in range(60):
        samples = [language_id.running_text("".join(random.choice("ab c\u0301é") for _ in range(random.randint(0, 30)))) for _ in range(3)]
        automaton = language_id.SuffixAutomaton()
        for x in samples:
            automaton.add(x)
        start = automaton.frozen()
        for _ in range(10):
            text = language_id.running_text("".join(random.choice("ab cdé\u0301.") for _ in range(random.randint(1, 40))))
            at = count = 0
            while at < len(text):
                size = max((n for n in range(1, len(text) - at + 1) if any(text[at : at + n] in x for x in samples)), default=1)
                at, count = at + size, count + 1
            assert language_id.phrases(start, text) == count, (samples, text)
    assert language_id.running_text("Ab1,cÉ हिन्दी") == " ab cé हिन्दी "


def test_language_of_held_out_documents(spark):
    got = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97, right


def test_mixing(spark, docs):
    rows = [(i, "w " * (1 + i % 5), "big" if i % 10 else ("small" if i % 20 else None)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    mix = mixing.Mix(entropy_share=0.99, max_epochs=3.0, block_tokens=50)
    got = mixing.mixed(df, mix, mixing.words()).toPandas()
    assert set(got.doc_id) == set(range(1000))  # nothing is lost
    assert got.groupby(["doc_id", "epoch"]).size().max() == 1 and got.epoch.max() <= 2
    tokens = got.groupby(got.source.fillna("-")).n_tokens.sum()
    natural = {s: sum(1 + i % 5 for i, _, x in rows if (x or "-") == s) for s in ("big", "small", "-")}
    assert tokens["big"] == natural["big"]
    for s in ("small", "-"):
        assert 2.9 * natural[s] - 5 <= tokens[s] <= 3.01 * natural[s]  # the repetition limit holds
    thin = mixing.mixed(df, mixing.Mix(entropy_share=None, max_epochs=None, budget_tokens=300, block_tokens=50), mixing.words()).toPandas()
    assert 250 <= thin.n_tokens.sum() <= 300
    odd = mixing.mixed(docs, mixing.Mix(), mixing.words()).toPandas()
    assert len(odd) >= len(ROWS)
    assert mixing.mixed(df.limit(0), mixing.Mix(), mixing.words()).isEmpty()


def test_html(spark):
    body = "A paragraph of the article with more than enough words to be read as text by anyone."
    pages = [
        (1, f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><div class=ad>Buy it now, it is cheap and good.</div><article><h1>Head</h1><p>{body}<p>Fish &amp; chips&nbsp;!<br>Yes.</article><aside><p>More to read on this site today.</p></aside><footer>&copy; us</footer>", f"Head\n\n{body}\n\nFish & chips !Yes.".replace("!Yes", "! Yes")),
        (2, None, ""), (3, "", ""), (4, "<script>var x = '<p>no</p>';</script><!-- <p>no</p> -->", ""),
        (5, f"<body><div id=cookie-banner><p>We use cookies and you must accept them all to go on.</p></div><article><p>{body}</p><div class='comments'><p>Nice text, I liked reading it very much.</p></div></article><form>Sign up <input></form>", body),
        (6, f"<article><p>{body}</p><p>cut off in the mid", f"{body}\n\ncut off in the mid"),
    ]
    df = spark.createDataFrame([(i, "u", h, 0, "x") for i, h, _ in pages], "page_id long, url string, html string, n_chars long, blocks string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.main_text(df).collect()}
    assert got == {i: (t, len(t)) for i, _, t in pages}
    assert len(html_text.LABELLED_BLOCKS) <= 200


def test_html_keeps_text_below_loose_hints(spark):
    """What an ancestor says loosely, or says of the whole page, loses no main text; what is hidden or aside stays out."""
    a = "The first paragraph of the article has more than enough words to be read as text by anyone."
    b = "The last paragraph of the article has about as many words as the first one and then some more."
    text, menu, junk = f"<p>{a}</p><p>Yes, indeed.</p><p>{b}</p>", "<nav><a href=x>Home</a> <a href=y>News</a></nav>", "Text that does not belong to the article although it is long enough to look like it."
    whole, main = f"{a}\n\nYes, indeed.\n\n{b}", []
    for wrap in (
        '<div style="overflow:hidden">{}</div>', '<div class="overflow-hidden">{}</div>', '<div aria-hidden="false">{}</div>', '<div data-hidden=1 title="hidden">{}</div>', "<div class='has-sidebar social-science comments-open'>{}</div>",
        '<article class="post social-science">{}</article>', '<article class="post social">{}</article>', '<main id="header" class="menu"><article>{}</article></main>', "<form class='menu' action=x><article>{}</article></form>",
        "<form id=aspnetForm action=x><div><h1></h1>{}</div></form>", "<form action=x><div>{}</div></form>", "<div>{}</div>", "<div>{}</div><p>Our page, 2020</p>", "<div>{}</div><p><a href=x>Read more now</a></p>",
    ):
        main += [(f'<html class="menu"><body class="has-sidebar comments-open sidebar">{menu}{wrap.format(text)}<footer>us</footer></body></html>', whole)]
    for wrap in (
        "<div hidden>{}</div>", '<div aria-hidden="true">{}</div>', '<div style="color:red; display: none">{}</div>', "<div style='visibility:hidden'>{}</div>", '<div class="x sidebar">{}</div>', '<div class="site-footer">{}</div>', "<div id=commentList>{}</div>",
        "<div role=navigation>{}</div>", "<form action=x>{}</form>", "<form class=newsletter>{}</form>",
    ):
        main += [(f"<body>{menu}<div>{text}</div>{wrap.format('<p>' + junk + '</p>')}</body>", whole)]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(main)], "page_id long, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert got == {i: t for i, (_, t) in enumerate(main)}


def test_html_of_odd_markup_and_tables(spark):
    a = "The first paragraph of the article has more than enough words to be read as text by anyone."
    b = "The last paragraph of the article has about as many words as the first one and then some more."
    whole = f"{a}\n\n{b}"
    pages = [
        f"<article><p title=it's>{a}</p><p>{b}</p></article>", f"<html><head><title>T</title><article><p>{a}</p><p>{b}</p></article>", f"<head><meta x=1><p>{a}</p><p title='a > b'>{b}</p>", f'<article class="overflow-hidden"><p aria-hidden="false">{a}</p><p>{b}</p></article>',
        f'<body class="has-sidebar"><article><p>{a}</p><p>{b}</p></article>', f'<div class="post with-comments"><article><p data-x="1>2" x=\'"\'>{a}</p><p>{b}</p></article></div>', f"<body class=no-header><main><p>{a}</p><p>{b}</p></main>", f"<article><p a = '{b}' b>{a}</p><p>{b}</p></article>",
    ]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(pages)] + [(0, pages[0])], "page_id long, html string")
    assert all(r["text"] == whole for r in html_text.main_text(df).collect())
    long = "".join(f"<p>{a} {i}</p>" for i in range(20_000))
    text = html_text.main_text(spark.createDataFrame([(1, f"<article>{long}</article>")], "page_id long, html string")).first()
    assert text["n_blocks"] == 20_000 and text["n_chars"] == len(text["text"]) and text["text"].endswith("anyone. 19999")
    assert html_text.main_text(df.limit(0)).isEmpty()


def test_html_tree_uses_words_and_links_of_neighbours(spark):
    """Held-out labelled blocks are told by shallow features; link density and words of the block and its neighbours carry the tree."""
    rows = html_text.LABELLED_BLOCKS
    hits = []
    for fold in range(5):
        main = html_text.trained_tree(spark, [r for i, r in enumerate(rows) if i % 5 != fold])
        held = spark.createDataFrame([tuple(map(float, r)) for i, r in enumerate(rows) if i % 5 == fold], [*html_text.FEATURES, "label"])
        hits += held.select((main(F.struct(*html_text.FEATURES)) == (F.col("label") > 0)).alias("hit"), "label").collect()
    assert sum(r["hit"] for r in hits) / len(hits) > 0.8
    used = str(html_text.trained_tree(spark)(F.col("b"))._jc.toString())
    assert all(name in used for name in ("words", "links", "words_before", "words_after"))


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>T &amp; U</title><p>Hé\r\n\r\nllo<a href='/x'>x</a>"), (2, None, None), (2, "http://b/", "")], "page_id long, url string, html string")
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    warc.write_warc(warc.response_records(pages, "2024-01-01T00:00:00Z"), a)
    responses = {r["headers"]["WARC-Record-ID"]: r for r in warc.read_warc(spark, a).collect()}
    assert len(responses) == 3 and all(r["headers"]["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(r["body"]).hexdigest() for r in responses.values())
    warc.write_warc(warc.derivatives(warc.read_warc(spark, a)), b)
    made = warc.read_warc(spark, b).collect()
    assert len(made) == 6
    by = {r["headers"]["WARC-Record-ID"]: r for r in made}
    for r in made:
        h = r["headers"]
        assert h["WARC-Refers-To"] in responses and by[h["WARC-Concurrent-To"]]["headers"]["WARC-Refers-To"] == h["WARC-Refers-To"] and h["WARC-Block-Digest"] == warc.digest(r["body"])
        assert h.get("WARC-Target-URI") == responses[h["WARC-Refers-To"]]["headers"].get("WARC-Target-URI")
    text = next(r["body"].decode() for r in made if r["headers"]["WARC-Type"] == "conversion" and r["headers"].get("WARC-Target-URI") == "http://a/")
    assert text == "T & UHé\nllox" or text.endswith("Hé\nllox")


def test_warc_headers_and_files(spark, tmp_path):
    """Plain files, whole-file and per-record gzip, lower-case and malformed headers, missing identifiers, cut records."""
    rec = lambda head, body: b"WARC/1.0\r\n" + head + b"\r\n\r\n" + body + b"\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nx-Any:1\r\n\r\n<title>A</title><p>x WARC/ y</p>"
    size = str(len(http)).encode()
    good = [rec(b"warc-type: response\r\ncontent-length: " + size, http), rec(b"WARC-Type:response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length:" + size, http)]
    bad = [rec(b"WARC-Type: response\r\nContent-Length: many", b"zz"), rec(b"WARC-Type: response", b"zz"), rec(b"Content-Length: -4", b"zz")]
    whole, cut = b"".join([good[0], *bad, good[1]]), good[0] + good[1][:-40]
    files = {"a.warc": whole, "b.warc.gz": gzip.compress(whole), "c.warc.gz": b"\0".join(gzip.compress(r) for r in good), "d.warc": cut, "e.warc.gz": gzip.compress(good[0]) + gzip.compress(good[1])[:-20], "f.warc": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        got = warc.read_warc(spark, f"file://{tmp_path}/{name}").collect()
        assert [bytes(r["body"]) for r in got] == [http] * {"f.warc": 0, "d.warc": 1, "e.warc.gz": 1}.get(name, 2), name
        assert all(r["headers"]["WARC-Type"] == "response" and r["headers"]["Content-Length"] == size.decode() for r in got)
    made = warc.derivatives(warc.read_warc(spark, f"file://{tmp_path}/a.warc")).collect()
    assert len(made) == 4 and len({r["record"] for r in made}) == 4 and all("http-x-any: 1" in r["record"] for r in made if "metadata" in r["record"][:40])
    long = "<p>" + "long text " * 400_000
    empty = spark.createDataFrame([(1, "u", long, 7)], "page_id long, url string, html string, record int")
    for df, n in ((empty.limit(0), 0), (empty, 1)):
        out = f"file://{tmp_path}/out{n}"
        warc.write_warc(warc.response_records(df, "2024-01-01T00:00:00Z"), out)
        rows = warc.read_warc(spark, out).collect() if n else []
        assert len(rows) == n and all(bytes(r["body"]).endswith(long.encode()) for r in rows)


def _members(data: bytes) -> list[bytes]:
    """A plain reader of gzip members."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        assert member.eof
        data = member.unused_data
    return out


def test_warc_files_are_plain_gzip_and_lose_one_record_a_flipped_byte(spark, tmp_path):
    big = "x" * (17 << 20)  # its length's highest byte is not zero
    rows = [(i, f"http://a/{i}", f"<p>page {i} {random.random()}</p>" * 50) for i in range(9)] + [(9, "http://a/9", big), (10, "http://a/10", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.response_records(pages, "2024-01-01T00:00:00Z"), path)
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "w").glob("part-*")))
    records = [m for m in _members(data) if m]
    assert len(records) == 11 and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
    assert subprocess.run(["gzip", "-dc"], input=data, capture_output=True).returncode == 0 and gzip.decompress(data) == b"".join(records)
    whole = [h["WARC-Target-URI"] for h, _ in warc.parse_warc(warc._unpacked(data))]
    assert whole == [r[1] for r in rows]
    starts = [m.start() for m in re.finditer(b"\x1f\x8b\x08", data)]
    for at in (starts[1] + 40, starts[1] + 4, starts[4] + 60, starts[2]):
        flipped = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
        found = [h["WARC-Target-URI"] for h, _ in warc.parse_warc(warc._unpacked(flipped))]
        assert len(found) >= 10 and set(found) <= set(whole)
    assert [h["WARC-Target-URI"] for h, _ in warc.parse_warc(warc._unpacked(data[: starts[3] + 30] + data[starts[5] :]))] == [x for i, x in enumerate(whole) if i not in (3, 4)]
    text = b"".join(records)
    bad = text.replace(b"Content-Length: ", b"Content-Length: x", 1)
    assert len(list(warc.parse_warc(iter([bad[i : i + 7000] for i in range(0, len(bad), 7000)])))) == 10


def test_warc_query_by_brute_force(spark):
    """Digests, links, titles and texts of every page of a small table, found from the pages alone."""
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    got = QUERIES["op4_warc"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(pages) and {r["page_id"] for r in got} == set(pages)
    for r in got:
        page = pages[r["page_id"]]
        seen = re.sub(r"(?is)<!--.*?(-->|$)|<(script|style|noscript|template|head)\b.*?(</\2\s*>|$)", "", page)
        assert r["linked"] and r["n_metadata"] == 1 and r["payload_digest"] == "sha256:" + hashlib.sha256(page.encode()).hexdigest()
        assert r["n_links"] == len(re.findall(r"(?i)<a\b[^>]*?\bhref\s*=", seen)) and r["text_sha256"] == hashlib.sha256(warc.plain_text(page).encode()).hexdigest()


def test_mixing_of_many_blocks(spark, sf_dir):
    """The query's SQL with small blocks, so that blocks are permuted and cut; blocks by rows where there are no words."""
    mix = mixing.Mix(block_tokens=300, block_rows=4)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", mixing.words().alias("__words"))
    got = mixing.mixed(docs, mix, F.col("__words")).select("doc_id", "source", "epoch", "block", "draw", "n_tokens", F.round("weight", 6).alias("weight")).toPandas()
    assert got.block.max() > 20 and not differences(got, duck(sf_dir, mixing.mixing_sql(mix)))
    empty = spark.range(90).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("s").alias("source"), F.lit(1).alias("weight"), F.lit(2).alias("block"))
    mix = mixing.Mix(block_rows=30)
    rows = mixing.mixed(empty, mix, mixing.words(), prefix="m_")
    assert rows.columns == [*empty.columns, "m_epoch", "m_block", "m_draw", "m_n_tokens", "m_weight"] and rows.count() == 90 and rows.select("m_block").distinct().count() == 3
    assert mixing.mixed(empty, mix, mixing.words()).columns == ["doc_id", "text", "source", "epoch", "block", "draw", "n_tokens", "weight"]
    assert corpus_pipeline.mixing(spark, empty, sf_dir).columns == empty.columns


def test_quality_rules_of_odd_tables(spark, docs):
    assert quality_rules.judge(docs.limit(0)).isEmpty()
    clash = quality_rules.judge(docs.withColumn("n_words", F.lit(-1))).toPandas()
    assert len(clash) == len(ROWS) and clash.n_words.min() >= 0
    tie = [quality_rules.Rule("b", F.col("n_words") < 0), quality_rules.Rule("a", F.col("n_words") < 0)]
    m = quality_rules.written(quality_rules.measured(docs.select("doc_id", "text")), "m")
    assert [r.name for r, _, _ in quality_rules.ordered_rules(m, tie)] == ["a", "b"]


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("text", F.when(F.col("doc_id") == 5, None).when(F.col("doc_id") == 6, "123 !").otherwise(F.col("text")))
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, before, sf_dir), name)
        sizes.append(docs.count())
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            want = brute.components(rows, 5, 80)
            assert {r["doc_id"] for r in docs.collect()} == {c for _, c in want.values()}
        if name != "byte_bpe":
            assert docs.columns == columns
    assert sizes[1] == sizes[0] - 2 and sizes[4] >= sizes[3] and sizes[5] == sizes[4]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_duplicates", "mixing", "byte_bpe"]


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """One row of each component stays, and every row without a near copy, whatever the identifiers."""
    words = lambda k: [f"{k}w{j}" for j in range(40)]
    near = lambda k, v: " ".join([*words(k)[:-1], f"v{v}"])
    rows = [(None, near("a", 0)), (1, near("a", 1)), (None, near("b", 0)), (None, near("b", 1)), (None, near("c", 0)), (2, near("d", 0)), (2, near("d", 1)), (2, near("d", 2)), (3, near("d", 3)), (2, near("e", 0))]
    rows += [(1, near("f", 0)), (4, near("g", 0)), (1, near("g", 1)), (5, near("h", 0)), (5, near("h", 0)), (6, near("h", 0)), (None, near("i", 0)), (None, near("i", 0)), (None, None), (None, ""), (7, ""), (7, ""), (2, near("a", 0).upper())]
    for _ in range(60):
        rows.append((random.choice([None, 1, 2, 8, 9]), near(random.choice("jklmnopq"), random.randint(0, 4))))
    places = {i: c for i, (_, c) in brute.components(list(enumerate(t for _, t in rows)), 5, 80).items()}
    groups: dict = {}
    for i, c in places.items():
        groups.setdefault(c if (rows[i][1] or "").strip() else ("alone", i), []).append(rows[i])
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    of_text = {t: c for c, members in groups.items() if not isinstance(c, tuple) for _, t in members}
    kept: dict = {}
    for r in got:
        kept.setdefault(of_text[r["text"]] if r["text"] else "alone", []).append((r["doc_id"], r["text"]))
    assert sorted(map(str, kept.pop("alone"))) == sorted(str(m[0]) for c, m in groups.items() if isinstance(c, tuple))
    groups = {c: m for c, m in groups.items() if not isinstance(c, tuple)}
    assert kept.keys() == groups.keys()
    for c, members in groups.items():
        assert len(kept[c]) == 1 and kept[c][0] in members and kept[c][0][0] == min((i for i, _ in members if i is not None), default=None), (c, kept[c], members)


def test_suffix_dedup_with_every_gram_hot(spark, monkeypatch):
    """Splitters that repeat every key deal all grams over several buckets, so all windows are compared across buckets."""
    blocks = ["".join(random.choice("ab") for _ in range(90)) for _ in range(3)]
    texts = [random.choice([x, x[:c] + "zz" + x[c:], "ab" * 20, None]) for x, c in ((random.choice(blocks), random.randint(0, 80)) for _ in range(60))]
    keys = np.unique(np.concatenate([suffix_dedup.range_keys(suffix_dedup.chosen_suffixes((t or "").encode(), 20, 6)) for t in texts])).tolist()
    assert all(int(float(k)) == k for k in keys)  # quantiles keep them exactly
    monkeypatch.setattr(suffix_dedup, "sampled_splitters", lambda *_: suffix_dedup.Splitters(sorted(keys[:: max(1, len(keys) // 10)] * 3)))
    monkeypatch.setattr(suffix_dedup, "partitions", lambda _: 64)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = suffix_dedup.removed(df, 20, 6, outputs=tuple(names)).orderBy("doc_id").toPandas()
    assert list(map(tuple, got[names].to_numpy().tolist())) == brute.repeats(texts, 20)


def test_windows_are_told_apart_by_their_bytes(spark, monkeypatch):
    """Equal hashes of different windows remove nothing; a key with more rows than a task holds is compared across."""
    flat = np.frombuffer(b"abcdeabcdfabcdeXX", "u1")
    at = np.arange(len(flat) - 3)
    want = [flat[i : i + 4].tobytes() in [flat[j : j + 4].tobytes() for j in at if j != i] for i in at]
    assert suffix_dedup.equal_windows(flat, at, np.zeros(len(at), "u8"), 4).tolist() == want
    assert suffix_dedup.equal_windows(flat, at[:0], np.zeros(0, "u8"), 4).tolist() == []
    monkeypatch.setattr(suffix_dedup._compared, "__defaults__", (3,))
    texts = ["".join(random.choice("ab") for _ in range(30)) + "the same passage in all of the texts" + "".join(random.choice("ab") for _ in range(random.randint(0, 40))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = suffix_dedup.removed(df, 20, 6, outputs=tuple(names)).orderBy("doc_id").toPandas()
    assert list(map(tuple, got[names].to_numpy().tolist())) == brute.repeats(texts, 20)


def test_lists_over_batches(monkeypatch):
    """What _met gives is the same however its sorted input is cut into batches."""
    some = [(random.randint(0, 60), random.randint(0, 6)) for _ in range(300)]
    rows = sorted((g, n % 2 if g % 4 == 0 else -1, (g + n) % 3 == 0, (g * 7 + n) % 6, n) for g, n in some)  # a copy of a node has its place
    array = ngram_join.node_array([bytes([n + 1]) + bytes(15) for *_, n in rows])
    whole = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows]), array, pa.array([9] * 300, pa.int32()), pa.array([r[3] for r in rows], pa.int32())], names=["gram", "salt", "late", "node", "size", "pos"])
    show = lambda found: sorted(str(r) for b in found for r in b.to_pylist())
    want = show(ngram_join._met(iter([whole])))
    lists: dict = {}
    for g, s, late, _, n in rows:
        lists.setdefault((g, s), []).append((late, n))
    kept = {k: v for k, v in lists.items() if k[1] >= 0 or (not v[0][0] and len({n for _, n in v}) > 1)}
    assert {(r["gram"], 0 if r["salted"] else -1) for b in ngram_join._met(iter([whole])) for r in b.to_pylist()} == {(g, min(s, 0)) for g, s in kept}
    for _ in range(30):
        cuts = [0, *sorted(random.randint(0, 300) for _ in range(random.randint(1, 40))), 300]
        assert show(ngram_join._met(whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))) == want


def test_salted_lists(spark, monkeypatch):
    """Hot n-grams, dealt over salted lists, and long lists, dealt over tasks, lose no link."""
    for name, value in (("HOT_ROWS", 2), ("HOT_SHARE", 50), ("HEAVY", 3), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = []
    for i in range(240):
        w = [f"{i % 4}w{j}" for j in range(60)] if i % 3 else [f"{i % 7}w{j}" for j in range(random.randint(3, 30))]
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = f"q{random.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for n, percent in ((3, 90), (5, 80), (2, 60), (1, 40)):
        want = brute.components(rows, n, percent)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked_components(df, n, percent).collect()}
        assert got == {rows[i][0]: v for i, v in want.items()}, (n, percent)


def test_pipeline_of_odd_tables(spark, sf_dir):
    """Empty tables stay empty; columns that bear names of results or working columns come through every stage untouched."""
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(1, near, "en", "a"), (2, near + " x", "en", "a"), (3, near.upper(), "en", None), (3, near.upper(), "en", None), (None, "other words of another text", "en", "b"), (4, None, None, "b"), (5, "", "en", "b")]
    names = ["score", "lang_pred", "held_out", "weight", "block", "epoch", "label", "node", "size", "ident", "pos", "gram", "row", "start", "kind", "keep"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", *(F.lit(7).alias(c) for c in names))
    empty, columns = docs.limit(0), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty, docs = corpus_pipeline.written(stage(spark, empty, sf_dir), name), corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        assert empty.columns == docs.columns == columns and empty.isEmpty()
        assert docs.where(" OR ".join(f"NOT {c} <=> 7" for c in names)).isEmpty()
    assert sorted({str(r["doc_id"]) for r in docs.collect()}) in (["2", "None"], ["3", "None"])
    last = corpus_pipeline.byte_bpe(spark, docs, sf_dir)
    assert last.count() == docs.count() and corpus_pipeline.byte_bpe(spark, empty, sf_dir).isEmpty()
