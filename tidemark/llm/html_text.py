"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks of text. Each block has its word count and link density, those of the blocks before and
after it, and whether it is a headline or inside an article. A decision tree trained on the small table LABELLED_BLOCKS, by
Spark's own trainer, says by these which blocks are main text. The tree becomes one CASE expression, so the page's blocks
are judged, filtered and joined by array functions without a shuffle. Blocks that the markup itself puts elsewhere (menus,
page headers and footers, sidebars, forms, and elements whose whole class, id or role says notice, advert or comment) are
neighbours like any other, but are not asked about.

Defined results: null html is empty and has empty text; a page without main text has empty text; repeated rows give
repeated results; markup that is not closed, not nested or cut off ends with the page; empty tables give empty tables;
columns of the input that bear the names of results are left out. What html, body, main and article say of themselves in
class, id or role holds for no text below them, nor does hiding html or body; a form round the page's text (see Form) counts
as any division; a quote opens a value only after an equals sign; text or an element of the body closes an open head.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

# Element names of HTML and the words that pages use in class, id and role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEAD = set("base basefont bgsound head html link meta noscript script style template title".split())
SILENT = set("head script style noscript template svg iframe object canvas select textarea button math audio video datalist title".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
MAIN = set("article main".split())
ASIDE = set("nav footer aside form menu dialog header fieldset".split())
HINTS = set(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header login masthead menu modal nav navbar navigation newsletter notice pagination"
    " pager popup promo promotion promoted recommended related replies responses share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
# Words that leave a hint's meaning as it is, as in site-footer or comment-list, and those that make a header a headline's.
ENTRY = set("article entry page post posts story".split())
NEUTRAL = ENTRY | set("area bar block body bottom box btn button buttons col column container content group inner item items left link links list main menus outer primary right secondary section site slot text title top unit widgets wrap wrapper".split())
PAGE = set("html body main article".split())
CLOSED_BY = {"p": set("p".split()), "li": set("li".split()), "dt": set("dt dd".split()), "dd": set("dt dd".split()), "tr": set("tr td th".split()), "td": set("td th".split()), "th": set("td th".split()), "option": set("option".split())}
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
TOKEN_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_a-zA-Z]+")
RAW_END = {name: re.compile(rf"</{name}\s*>|\Z", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe")}
SPACE = re.compile(r"\s+")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "heading"]

# Fixed values, labelled by hand from pages of many layouts: the features in the order above, then 1 for main text.
LABELLED_BLOCKS = [
    # menus, breadcrumbs, tag lists
    (3, 1, 2, 1, 12, 0, 0, 0, 0), (4, 1, 3, 1, 2, 1, 0, 0, 0),
    (1, 1, 1, 1, 9, 0, 0, 0, 0),
    # stray short text outside an article
    (2, 0, 1, 1, 1, 1, 0, 0, 0), (3, 0, 2, 0.5, 4, 1, 0, 0, 0), (4, 0.6, 3, 1, 2, 0, 0, 0, 0), (6, 0, 3, 1, 3, 1, 0, 0, 0), (1, 0, 0, 0, 3, 1, 0, 0, 0),
    # short text outside an article that is a link, or is not between unlinked blocks
    (2, 1, 60, 0, 40, 0, 0, 0, 0), (4, 1, 50, 0, 3, 1, 0, 0, 0), (6, 1, 30, 0, 0, 0, 0, 0, 0), (3, 1, 80, 0, 25, 0, 0, 0, 0), (12, 1, 40, 0, 9, 1, 0, 0, 0), (5, 1, 15, 0, 70, 0, 0, 0, 0), (2, 1, 18, 0, 2, 0, 0, 0, 0),
    (4, 0, 50, 0, 0, 0, 0, 0, 0), (5, 0, 70, 0, 3, 1, 0, 0, 0), (3, 0, 45, 0, 2, 1, 0, 0, 0), (6, 0, 40, 0, 0, 0, 0, 0, 0), (2, 0, 17, 0, 1, 1, 0, 0, 0), (3, 0, 1, 1, 40, 0, 0, 0, 0), (5, 0, 4, 1, 20, 0, 0, 0, 0), (2, 0, 0, 0, 30, 0, 0, 0, 0),
    (3, 0, 2, 0, 3, 0, 0, 0, 0), (2, 0, 4, 0, 1, 0, 0, 0, 0), (5, 0, 3, 0, 2, 0, 0, 0, 0), (1, 0, 6, 0, 4, 0, 0, 0, 0),
    # headlines
    (10, 0, 8, 0, 25, 0, 1, 1, 1), (7, 0, 8, 0, 30, 0, 1, 1, 1), (3, 0, 4, 0, 40, 0, 1, 1, 1), (2, 0, 5, 0, 2, 0, 1, 1, 1), (12, 0, 1, 1, 50, 0, 1, 1, 1), (1, 0, 8, 0, 1, 0, 1, 1, 1),
    (9, 1, 8, 0, 60, 0, 1, 1, 1), (9, 0, 3, 1, 60, 0, 0, 1, 1), (6, 0, 70, 0, 60, 0, 0, 1, 1), (11, 0, 0, 0, 80, 0, 0, 1, 1),
    # paragraphs of an article
    (40, 0, 10, 0, 55, 0, 1, 0, 1), (90, 0.02, 40, 0, 70, 0, 1, 0, 1), (1, 0, 60, 0, 20, 0, 1, 0, 1), (3, 0, 20, 0, 33, 0, 1, 0, 1), (2, 0, 2, 0, 12, 0, 1, 0, 1), (25, 0.3, 35, 0, 30, 0, 1, 0, 1),
    (8, 0, 30, 0, 14, 0, 1, 0, 1), (15, 0, 8, 0, 12, 0, 1, 0, 1), (4, 1, 45, 0, 30, 0, 1, 0, 1), (6, 0, 1, 0, 20, 0, 1, 0, 1), (120, 0, 70, 0, 14, 0, 1, 0, 1), (200, 0.01, 90, 0, 4, 0, 1, 0, 1),
    (1, 0, 1, 0, 9, 0, 1, 0, 1), (12, 0.9, 20, 0.5, 18, 0, 1, 0, 1), (5, 0, 12, 0, 0, 0, 1, 0, 1), (9, 0, 6, 0, 1, 1, 1, 0, 1),
    # paragraphs of pages without an article element
    (45, 0, 9, 0, 60, 0, 0, 0, 1), (80, 0.05, 45, 0, 33, 0, 0, 0, 1), (30, 0, 60, 0, 25, 0, 0, 0, 1), (150, 0, 1, 1, 90, 0, 0, 0, 1), (22, 0.1, 80, 0, 40, 0, 0, 0, 1), (60, 0.1, 2, 1, 5, 1, 0, 0, 1),
    (11, 0, 50, 0, 60, 0, 0, 0, 1), (14, 0, 30, 0, 45, 0, 0, 0, 1), (12, 0, 40, 0, 12, 0, 0, 0, 1),
    # short paragraphs between them
    (3, 0, 60, 0, 50, 0, 0, 0, 1), (1, 0, 40, 0, 30, 0, 0, 0, 1), (5, 0, 30, 0, 70, 0, 0, 0, 1), (8, 0, 18, 0, 24, 0, 0, 0, 1), (2, 0, 90, 0, 45, 0, 0, 0, 1), (6, 0, 12, 0, 15, 0, 0, 0, 1),
    (4, 0, 25, 0, 12, 0, 0, 0, 1), (7, 0, 14, 0.1, 33, 0, 0, 0, 1), (2, 0, 16, 0, 20, 0.05, 0, 0, 1),
    (2, 0, 50, 0, 2, 0, 0, 0, 1), (2, 0, 2, 0, 50, 0, 0, 0, 1), (1, 0, 20, 0, 3, 0, 0, 0, 1), (4, 0, 1, 0, 22, 0, 0, 0, 1),
    # paragraphs beside them
    (17, 0, 4, 1, 2, 0, 0, 0, 1), (25, 0, 2, 0, 1, 0, 0, 0, 1), (18, 0, 3, 0, 1, 1, 0, 0, 1), (30, 0, 5, 1, 3, 0, 0, 0, 1), (20, 0, 1, 0, 4, 1, 0, 0, 1), (50, 0, 4, 0, 6, 0, 0, 0, 1), (70, 0.05, 3, 0, 0, 0, 0, 0, 1),
    (14, 0, 2, 0, 25, 0, 0, 0, 1), (40, 0.1, 33, 0, 2, 0, 0, 0, 1),
]


def _attributes(text: str) -> dict[str, str]:
    """Attributes by lower-case name; of a repeated one the first counts, as in browsers."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _is_hint(token: str, in_article: bool) -> bool:
    """Whether a whole class, id or role is made of HINTS and NEUTRAL words; an article's own header is not aside."""
    words = [w.lower() for w in TOKEN_WORD.findall(token)]
    hints = {w for w in words if w in HINTS}
    if hints == {"header"} and (in_article or not ENTRY.isdisjoint(words)):
        return False
    return bool(hints) and all(w in HINTS or w in NEUTRAL or w.isdigit() for w in words)


def _says_aside(attributes: dict[str, str], in_article: bool) -> bool:
    return any(_is_hint(token, in_article) for name in ("class", "id", "role") for token in attributes.get(name, "").split())


def _says_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(HIDING.search(attributes.get("style", "")))


class Form:
    """A form is aside unless it is put round the page: it holds an article, main or h1, or most of the page's words outside links."""

    def __init__(self, hinted: bool):
        self.hinted, self.holds, self.words = hinted, False, 0


def flat_blocks(page: str) -> list[dict]:
    """Text blocks in page order: text, words, links (share of words in links), in_article, aside, hinted, heading."""
    blocks: list[dict] = []
    outside: tuple[str, bool, bool, bool, bool, tuple[Form, ...]] = ("", False, False, False, False, ())  # name, in_article, aside, hinted, silent, forms
    open_ = [outside][:0]
    pieces: list[str] = []
    state, links, in_link, at = outside, 0, 0, 0

    def close_block() -> None:
        nonlocal links
        text = SPACE.sub(" ", "".join(pieces)).strip()
        pieces.clear()
        if text:
            words = len(text.split())
            heading = any(x[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for x in open_)
            blocks.append({"text": text, "words": words, "links": min(1.0, links / words), "in_article": state[1], "aside": state[2], "hinted": state[3], "heading": heading, "forms": state[5]})
            for form in state[5]:
                form.words += max(0, words - links)
        links = 0

    def pop(name: str) -> None:
        nonlocal state, in_link
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] == name:
                in_link -= sum(x[0] == "a" for x in open_[i:])
                del open_[i:]
                state = open_[-1] if open_ else outside
                return

    size = len(page)
    while at < size:
        token = TOKEN.search(page, at)
        text = page[at : token.start() if token else size]
        if text and not state[4]:
            text = entities.unescape(text)
            pieces.append(text)
            if in_link > 0:
                links += len(text.split())
        if not token:
            break
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        if name not in INLINE and name != "br":
            close_block()
        if name == "br":
            pieces.append(" ")
        elif token[1]:
            pop(name)
        else:
            if name not in HEAD and any(x[0] == "head" for x in open_):
                pop("head")
            if name in ENDS_P and any(x[0] == "p" for x in open_):
                pop("p")
            if open_ and open_[-1][0] in CLOSED_BY.get(name, ()):
                pop(open_[-1][0])
            if name in VOID or token[0].endswith("/>"):
                continue
            attributes = _attributes(token[3]) if token[3] and not token[3].isspace() else {}
            article = state[1] or name in MAIN
            aside = state[2] or (name in ASIDE and name != "form" and not (name == "header" and article))
            says = bool(attributes) and name not in PAGE and _says_aside(attributes, article)
            hinted = state[3] or (says and name != "form")
            silent = state[4] or name in SILENT or (bool(attributes) and name not in ("html", "body") and _says_hidden(attributes))
            forms = (*state[5], Form(says)) if name == "form" else state[5]
            if name in MAIN or name == "h1":
                for form in forms:
                    form.holds = True
            state = (name, article, aside, hinted, silent, forms)
            open_.append(state)
            in_link += name == "a"
            if name in RAW_END:
                at = RAW_END[name].search(page, at).start()
    close_block()
    total = sum(max(0, b["words"] * (1 - b["links"])) for b in blocks)
    for block in blocks:
        asides = [form for form in block.pop("forms") if not form.holds and 2 * form.words <= total]
        block["aside"] = block["aside"] or bool(asides)
        block["hinted"] = block["hinted"] or any(form.hinted for form in asides)
    return blocks


BLOCK = "array<struct<text:string,elsewhere:boolean," + ",".join(f"{f}:double" for f in FEATURES) + ">>"
_BLOCK_TYPE = pa.list_(pa.struct([("text", pa.string()), ("elsewhere", pa.bool_()), *((f, pa.float64()) for f in FEATURES)]))


def with_neighbours(blocks: list[dict]) -> list[dict]:
    none = {"words": 0, "links": 0.0}
    out = []
    for before, block, after in zip([none, *blocks], blocks, [*blocks[1:], none], strict=False):
        near = {"words_before": before["words"], "links_before": before["links"], "words_after": after["words"], "links_after": after["links"]}
        out.append({"text": block["text"], "elsewhere": block["aside"] or block["hinted"]} | {f: float((block | near)[f]) for f in FEATURES})
    return out


def page_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with the array column blocks in place of html."""
    kept = [c for c in pages.columns if c not in (html, "blocks")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [with_neighbours(flat_blocks(value.as_py() or "")) for value in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(found, _BLOCK_TYPE)], names=[*kept, "blocks"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema)
    return pages.select(*kept, html).mapInArrow(run, f"{fields}, blocks {BLOCK}")


def trained_tree(spark: SparkSession, rows: list[tuple] = LABELLED_BLOCKS, depth: int = 6):
    """Callable from a block column to a boolean column: the decision tree as nested conditions."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors

    data = spark.createDataFrame([(Vectors.dense(r[:-1]), float(r[-1])) for r in rows], ["features", "label"]).coalesce(1)
    root = DecisionTreeClassifier(maxDepth=depth, maxBins=128, seed=1).fit(data)._java_obj.rootNode()

    def read(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return bool(node.prediction())
        split = node.split()
        return FEATURES[split.featureIndex()], split.threshold(), read(node.leftChild()), read(node.rightChild())

    tree = read(root)

    def expression(block: Column, node=tree) -> Column:
        if isinstance(node, bool):
            return F.lit(node)
        feature, bound, low, high = node
        return F.when(block[feature] <= bound, expression(block, low)).otherwise(expression(block, high))

    return expression


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text (main blocks joined by an empty line), n_chars and n_blocks in place of html."""
    main = trained_tree(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html, "blocks", "text", "n_chars", "n_blocks")]
    found = page_blocks(pages.select(*kept, html), html)
    texts = found.select(*kept, F.transform(F.filter("blocks", lambda b: ~b["elsewhere"] & main(b)), lambda b: b["text"]).alias("__main"))
    texts = texts.select(*kept, F.array_join("__main", "\n\n").alias("text"), F.size("__main").cast("long").alias("n_blocks"))
    return texts.select(*kept, "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
