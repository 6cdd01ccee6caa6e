"""Licence scan by a positional index of rare tokens. DataFrame functions only.

A template is the words of a licence notice with its mandatory key phrases. The index holds, for each template, the
positions of its words of highest IDF (fewest documents of the corpus; counted over all of them). A file's words that the
index holds are looked up; each posting proposes the place where the template would have to start. Proposals are
intersected by relative position: at one start, at least half of the template's indexed words must stand where they should.
A place that is left must have every key phrase, word by word, where the template has it, give or take ``slack`` words (an
edited notice shifts them). Its score is the share of the template's words that stand at their places.

All of it is column expressions on a row's word array; nothing is shuffled but the document counts of template words.

Defined results: a null text counts as empty; a text without words has no labels and score 0; repeated rows are scanned
alike; a place counts once however many indexed words propose it; an empty table gives an empty table; other columns come
along in scanned(), except those that bear the names of results, which are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, UPPER, ascii_lower, table

BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.lower()) if w]


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...] = ()  # none: the whole text is the phrase, word by word, without slack

    def words(self) -> list[str]:
        return words(self.text)

    def spans(self) -> list[tuple[int, int]]:
        """Place and length of each key phrase."""
        mine, out = self.words(), []
        for phrase in map(words, self.phrases or (self.text,)):
            out.append((next(i for i in range(len(mine)) if mine[i : i + len(phrase)] == phrase), len(phrase)))
        return out


#: The phrases that must be found wherever they stand.
BASE = (Template("mit", "under the mit license"), Template("apache-2", "apache license version 2"), Template("cc-by-nc", "cc by nc"))

#: Opening words of well-known notices, as their authors publish them.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", ("apache license version 2 0",)),
    Template("gpl-3", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("gpl-2", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Template("gpl-3", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu general public license", "version 3 of the license")),
    Template("gpl-2", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("gnu general public license", "version 2 of the license")),
    Template("lgpl-3", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu lesser general public license", "version 3 of the license")),
    Template("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu affero general public license", "version 3 of the license")),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by-4", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("cc-by-nc-4", "licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nc-4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0",)),
    Template("cc-by-sa-4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0",)),
)

TEMPLATES = BASE + NOTICES
SLACK, WORDS_AN_ANCHOR, MOST_ANCHORS = 8, 3, 4


def anchors_of(template: Template) -> int:
    return max(1, min(MOST_ANCHORS, len(template.words()) // WORDS_AN_ANCHOR))


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def document_counts(docs: DataFrame, text: str, templates: tuple[Template, ...]) -> dict[str, int]:
    """In how many rows each word of the templates stands. As many rows come to the driver as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.words()})
    found = docs.select(F.explode(F.array_intersect(word_array(F.col(text)), F.lit(vocabulary))).alias("w"))
    return dict.fromkeys(vocabulary, 0) | {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}


def postings(templates: tuple[Template, ...], counts: dict[str, int], slack: int) -> dict[str, list[Column]]:
    """Word -> the templates that it is an anchor of, with its place in them and all that is needed to verify them."""
    out: dict[str, list[Column]] = {}
    for number, template in enumerate(templates):
        mine = template.words()
        chosen = sorted(range(len(mine)), key=lambda i: (counts[mine[i]], mine[i], i))[: anchors_of(template)]
        anchors = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(mine[p]).alias("w")) for p in chosen))
        spans = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(n).alias("n")) for p, n in template.spans()))
        for j, place in enumerate(chosen):
            out.setdefault(mine[place], []).append(
                F.struct(
                    F.lit(number).alias("t"), F.lit(template.label).alias("label"), F.lit(j).alias("j"), F.lit(place).alias("place"), F.lit((len(chosen) + 1) // 2).alias("need"),
                    F.lit(mine).alias("words"), anchors.alias("anchors"), spans.alias("spans"), F.lit(slack if template.phrases else 0).alias("slack"),
                )
            )
    return out


def _places(found: Column, index: dict[str, list[Column]]) -> Column:
    """Array of (t, label, start, matched, length) of the verified places of a word array."""
    lookup = F.create_map(*(x for word, held in sorted(index.items()) for x in (F.lit(word), F.array(*held))))
    stands = lambda start, a: F.coalesce(F.get(found, start + a["p"]) == a["w"], F.lit(False))
    steps = lambda n: F.sequence(F.lit(0), n - 1)

    def phrase(start: Column, post: Column, span: Column) -> Column:
        same = lambda shift: F.forall(steps(span["n"]), lambda k: F.coalesce(F.get(found, start + span["p"] + shift + k) == F.get(post["words"], span["p"] + k), F.lit(False)))
        return F.exists(F.sequence(-post["slack"], post["slack"]), same)

    def verified(x: Column) -> Column:
        start, post = x["start"], x["post"]
        first = ~F.exists(post["anchors"], lambda a: stands(start, a) & (F.array_position(post["anchors"], a) <= post["j"]))
        votes = F.size(F.filter(post["anchors"], lambda a: stands(start, a)))
        return first & (votes >= post["need"]) & F.forall(post["spans"], lambda span: phrase(start, post, span))

    hits = F.filter(F.transform(found, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(*index))
    proposed = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(lookup, h["w"]), lambda post: F.struct((h["i"] - post["place"]).alias("start"), post.alias("post")))))
    matched = lambda x: F.size(F.filter(steps(F.size(x["post"]["words"])), lambda k: F.coalesce(F.get(found, x["start"] + k) == F.get(x["post"]["words"], k), F.lit(False))))
    made = F.transform(F.filter(proposed, verified), lambda x: F.struct(x["post"]["t"].alias("t"), x["post"]["label"].alias("label"), x["start"].cast("long").alias("start"), matched(x).alias("matched"), F.size(x["post"]["words"]).alias("length")))
    kind = "array<struct<t:int,label:string,start:bigint,matched:int,length:int>>"
    return F.when(F.arrays_overlap(found, F.lit(sorted(index))), made.cast(kind)).otherwise(F.array().cast(kind))


def scanned(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES, slack: int = SLACK) -> DataFrame:
    """docs with n_words and places (t: number of the template, label, start: place of its first word, matched, length)."""
    index = postings(templates, document_counts(docs, text, templates), slack)
    kept = [c for c in docs.columns if c not in ("n_words", "places", "__words")]
    rows = docs.select(*kept, word_array(F.col(text)).alias("__words"))
    return rows.select(*kept, F.size("__words").cast("long").alias("n_words"), _places(F.col("__words"), index).alias("places"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    rows = rows.withColumn("base", F.filter("places", lambda p: p["t"] < len(BASE)))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    starts = F.transform("base", lambda p: p["start"])
    score = F.coalesce(F.array_max(F.transform("places", lambda p: p["matched"] / p["length"])), F.lit(0.0))
    return rows.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names("base").alias("base_labels"), names("places").alias("labels"), score.alias("score"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


OP12_SQL = f"""
WITH tw(t, p, w) AS (VALUES {_values([(t, p, w) for t, x in enumerate(TEMPLATES) for p, w in enumerate(x.words())])}),
tp(t, s, p, n, slack) AS (VALUES {_values([(t, s, p, n, SLACK if x.phrases else 0) for t, x in enumerate(TEMPLATES) for s, (p, n) in enumerate(x.spans())])}),
tl(t, label, k) AS (VALUES {_values([(t, x.label, anchors_of(x)) for t, x in enumerate(TEMPLATES)])}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
v AS (SELECT r, w, i FROM w WHERE w IN (SELECT w FROM tw)),
df AS (SELECT w, count(DISTINCT r) AS n FROM v GROUP BY w),
a AS (SELECT t, p, w, j, k FROM (SELECT tw.t, tw.p, tw.w, tl.k, row_number() OVER (PARTITION BY tw.t ORDER BY coalesce(df.n, 0), tw.w, tw.p) AS j FROM tw JOIN tl USING (t) LEFT JOIN df ON df.w = tw.w) WHERE j <= k),
c AS (SELECT v.r, a.t, v.i - a.p AS s, count(*) AS votes, any_value(a.k) AS k FROM v JOIN a USING (w) GROUP BY v.r, a.t, v.i - a.p),
e AS (SELECT * FROM c WHERE votes >= (k + 1) // 2),
sh AS (SELECT e.r, e.t, e.s, tp.s AS ph, x.shift, tp.n, count(*) AS m FROM e JOIN tp USING (t) JOIN (SELECT unnest(range(-{SLACK}, {SLACK + 1})) AS shift) x ON abs(x.shift) <= tp.slack
    JOIN tw ON tw.t = e.t AND tw.p >= tp.p AND tw.p < tp.p + tp.n JOIN v ON v.r = e.r AND v.i = e.s + tw.p + x.shift AND v.w = tw.w GROUP BY ALL),
ok AS (SELECT o.r, o.t, o.s FROM (SELECT r, t, s, count(DISTINCT ph) AS c FROM sh WHERE m = n GROUP BY r, t, s) o JOIN (SELECT t, count(*) AS c FROM tp GROUP BY t) q ON q.t = o.t AND q.c = o.c),
sc AS (SELECT ok.r, ok.t, ok.s, count(v.w) / (SELECT count(*) FROM tw z WHERE z.t = ok.t) AS score FROM ok JOIN tw ON tw.t = ok.t LEFT JOIN v ON v.r = ok.r AND v.i = ok.s + tw.p AND v.w = tw.w GROUP BY ok.r, ok.t, ok.s),
g AS (SELECT r, count(*) FILTER (t < {len(BASE)}) AS n_base, min(s) FILTER (t < {len(BASE)}) AS first_word, max(s) FILTER (t < {len(BASE)}) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (t < {len(BASE)}) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM sc JOIN tl USING (t) GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN g USING (r)
"""
