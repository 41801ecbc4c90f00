"""Licence scan by a positional index of rare words. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_GPL = "gnu general public license (v|version |as published by the free software foundation (either )?version )"
#: Licence texts and the notices that files carry, as words, and the
#: key phrase (a pattern over words) that must stand in the aligned place.
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "permission is hereby granted free of charge ",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "permission to use copy modify and or distribute ",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistribution and use in source and binary forms ",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "free and unencumbered software released into the public domain ",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "to alter it and redistribute it freely ",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
        "apache license version 2 ",
    ),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2 "),
    ("agpl-3", "gnu affero general public license as published by the free software foundation", "affero general public license "),
    ("agpl-3", "gnu affero general public license version 3", "affero general public license "),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution "),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international", "attribution noncommercial |cc by nc "),
    *((f"gpl-{n}", f"licensed under the gnu general public license version {n}", f"{_GPL}{n} ") for n in "23"),
    *((f"gpl-{n}", f"under the terms of the gnu general public license as published by the free software foundation either version {n} of the license", f"{_GPL}{n} ") for n in "23"),
    *((f"gpl-{n}", f"under the terms of version {n} of the gnu general public license as published by the free software foundation", f"version {n} of the gnu general public license ") for n in "23"),
    ("lgpl", "gnu lesser general public license version", "lesser general public license "),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license "),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license "),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license "),
)
#: Words too common anywhere to be looked up.
COMMON = frozenset(
    "a above all an and any anyone appear applicable are as at be but by can code conditions copies copy deal do else either event except file files following for form forms free freely from http if in is it kind law list may met must no non not notice of on one or org other person persons provided required rights sell shall so source subject terms that the this to under use used version warranties warranty was whom will with work writing www you your 0 2 3 4 v".split()
)
#: Of a file's licence words, those of the highest IDF that are looked up in a template.
RARE_WORDS = 8
#: Least share of the IDF of a template's rarest words that must align at one shift.
MIN_SCORE = 0.6
#: Words on each side of an anchor that are kept to verify a key phrase in.
NEAR_WORDS = 14
#: Words, one of which lies in any key phrase: a phrase is verified around them.
ANCHORS = ("hereby", "distribute", "redistribution", "unencumbered", "redistribute", "apache", "affero", "attribution", "nc", "gnu", "lesser", "mozilla")
#: Rare licence words, numbered, and the places of each in the templates.
WORDS = sorted({w for _, text, _ in TEMPLATES for w in text.split()} - COMMON)
POSTINGS = [(t, place, WORDS.index(w)) for t, (_, text, _) in enumerate(TEMPLATES) for place, w in enumerate(text.split()) if w not in COMMON]


def _places(phrase: str, held: Column) -> Column:
    """Starts of the places in ``_w`` where a phrase's words stand one after another;
    looked for only in texts of which ``held``."""
    words = phrase.split()
    at = F.filter(F.sequence(F.lit(0), F.size("_w") - len(words)), lambda i: _all([F.get("_w", i + k) == w for k, w in enumerate(words)]))
    return F.when((F.size("_w") >= len(words)) & held, at).otherwise(F.array().cast("array<int>"))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def licence_hits(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, ``base_k`` (starts of each base phrase), ``hits`` (place and
    number of each rare licence word) and ``anchors`` (place, words around) of each
    whole text. No word of COMMON is in it, so it is narrow."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = docs.select("doc_id", lower.alias("_t")).select("doc_id", "_t", F.filter(F.split("_t", _GAP), lambda w: w != "").alias("_w"))
    codes = F.create_map(*[x for i, w in enumerate(WORDS) for x in (F.lit(w), F.lit(i))])
    hits = F.filter(F.transform("_w", lambda w, i: F.struct(i.alias("at"), codes[w].alias("code"))), lambda h: h["code"].isNotNull())
    around = lambda h: F.struct(h["at"].alias("at"), F.concat(F.lit(" "), F.array_join(F.slice("_w", F.greatest(h["at"] - NEAR_WORDS, F.lit(0)) + 1, 2 * NEAR_WORDS + 1), " "), F.lit(" ")).alias("near"))
    anchor = [WORDS.index(w) for w in ANCHORS if w in WORDS]
    known = split.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        *[_places(p, F.col("_t").rlike(_GAP.join(p.split()))).alias(f"base_{k}") for k, p in enumerate(BASE)],
        "_w",
        hits.alias("hits"),
    )
    return known.withColumn("anchors", F.transform(F.filter("hits", lambda h: h["code"].isin(anchor)), around)).drop("_w")


def word_weights(hits: DataFrame) -> dict[int, float]:
    """IDF of every rare licence word over all documents; as many rows as such words."""
    total = hits.count()
    counts = hits.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["code"]))).alias("code")).groupBy("code").count().collect()
    found = {r["code"]: r["count"] for r in counts}
    return {i: math.log((1 + total) / (1 + found.get(i, 0))) + 1 for i in range(len(WORDS))}


def _rank(weights: dict[int, float]) -> list[tuple]:
    """Postings (template, place, word, rank, idf): a template's rare words ranked
    by IDF, ties by the word."""
    out = []
    for t in range(len(TEMPLATES)):
        own = [(place, code) for x, place, code in POSTINGS if x == t]
        order = {c: k for k, c in enumerate(sorted({c for _, c in own}, key=lambda c: (-weights[c], c)))}
        out += [(t, place, code, order[code], weights[code]) for place, code in own]
    return out


def licence_candidates(spark: SparkSession, hits: DataFrame, weights: dict[int, float]) -> DataFrame:
    """(row, template, shift, share) of the templates whose rare words align in a file.

    Hits meet the postings of their word (a fixed list). Of a file's words in a
    template those of the ``RARE_WORDS`` highest IDF are looked up; each votes, with
    its IDF, for the shift between its places in file and template, once a shift.
    The best shift's share is that of the IDF of the template's ``RARE_WORDS``
    rarest words; of equal shifts the first counts. No phrase is read here.
    """
    ranked = _rank(weights)
    full = {t: sum(sorted({c: w for x, _, c, _, w in ranked if x == t}.values(), reverse=True)[:RARE_WORDS]) for t in range(len(TEMPLATES))}
    postings = spark.createDataFrame(ranked, "template int, place int, code int, rank int, idf double")
    totals = F.create_map(*[x for t, w in full.items() for x in (F.lit(t), F.lit(w))])
    each = hits.where(F.size("hits") >= 2).select("row", F.explode("hits").alias("h")).select("row", "h.at", "h.code")
    votes = each.join(F.broadcast(postings), "code").select("row", "template", (F.col("at") - F.col("place")).alias("shift"), "rank", "idf")
    votes = votes.repartition("row", "template").groupBy("row", "template", "shift", "rank").agg(F.first("idf").alias("idf"))
    looked = votes.withColumn("k", F.dense_rank().over(Window.partitionBy("row", "template").orderBy("rank"))).where(F.col("k") <= RARE_WORDS)
    shifts = looked.groupBy("row", "template", "shift").agg(F.round(F.sum("idf"), 9).alias("v"))
    best = shifts.groupBy("row", "template").agg(F.max(F.struct("v", (-F.col("shift")).alias("s"))).alias("b"))
    share = F.least(F.col("b.v") / totals[F.col("template")], F.lit(1.0))
    return best.select("row", "template", (-F.col("b.s")).alias("shift"), share.alias("share")).where(F.col("share") >= MIN_SCORE)


def scan_licences(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Licence labels of each whole text of ``docs`` (doc_id, text).

    Returns doc_id, n_words, ``base`` (starts of all base phrases), base_labels,
    labels (arrays, sorted) and score. The texts are read once, into a narrow
    table of the places of rare licence words. Their IDF is counted over all
    documents; a file's words of the highest IDF are looked up in the index of
    the templates and intersected by relative position (``licence_candidates``).
    Last, for the candidates alone, the template's key phrase must stand around a
    word near the aligned place. ``score`` is the best share over the labels
    given, 1 where a base phrase stands.

    Only votes and candidates are shuffled, not texts. Null texts are empty (no
    words, no labels), null doc_ids and repeated rows are scanned each for itself
    (rows are told apart by their place in the written table), further columns
    are ignored, and no rows give none. A very long text is held whole by the
    task that splits it; its hits are rows. Words of equal IDF are ranked by
    their spelling.
    """
    scratch = Scratch(spark, "licences")
    hits = scratch.table(licence_hits(docs).withColumn("row", F.monotonically_increasing_id()), "hits")
    found = scratch.table(licence_candidates(spark, hits, word_weights(hits)), "candidates")
    length = F.create_map(*[x for t, (_, text, _) in enumerate(TEMPLATES) for x in (F.lit(t), F.lit(len(text.split())))])
    near = F.filter("anchors", lambda a: (a["at"] >= F.col("shift") - NEAR_WORDS) & (a["at"] <= F.col("shift") + length[F.col("template")] + NEAR_WORDS))
    key = lambda x: F.coalesce(*[F.when(F.col("template") == t, x.rlike(f" ({key})")) for t, (_, _, key) in enumerate(TEMPLATES)])
    label = F.create_map(*[x for t, (name, _, _) in enumerate(TEMPLATES) for x in (F.lit(t), F.lit(name))])
    held = found.join(hits.select("row", "anchors").where(F.size("anchors") > 0), "row").where(F.exists(near, lambda a: key(a["near"])))
    own = held.groupBy("row").agg(F.collect_set(label[F.col("template")]).alias("own"), F.max("share").alias("share"))
    none = F.array().cast("array<string>")
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"base_{k}") > 0, F.lit(name)) for k, name in enumerate(BASE.values())]))
    out = hits.select("row", "doc_id", "n_words", *[f"base_{k}" for k in range(len(BASE))]).join(own, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.sort_array(F.flatten(F.array(*[F.col(f"base_{k}") for k in range(len(BASE))]))).alias("base"),
        F.sort_array(F.array_distinct(F.coalesce(base_labels, none))).alias("base_labels"),
        F.sort_array(F.array_distinct(F.concat(base_labels, F.coalesce("own", none)))).alias("labels"),
        F.when(F.size(base_labels) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of all documents."""
    found = scan_licences(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.get("base", F.lit(0)).cast("long").alias("first_word"),
        F.get("base", F.size("base") - 1).cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        F.round("score", 9).alias("score"),
    )
