"""Plain versions of the training-data operators, to hold the Spark versions against."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(rows: list[tuple], n: int, percent: int) -> dict:
    """(size, smallest identifier) by position."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    top = list(range(len(rows)))

    def root(x: int) -> int:
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                top[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for i, (ident, _) in enumerate(rows):
        ids[root(i)].append(ident)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return {i: (len(sets[i]), least[root(i)]) for i in range(len(rows))}


def repeats(texts: list[str | None], length: int) -> list[tuple]:
    """n_bytes, n_removed, n_spans, kept_sha256 of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        spans: list[list[int]] = []
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + r[at:a], b
        out.append((len(r), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept + r[at:]).hexdigest()))
    return out


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = text or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)
