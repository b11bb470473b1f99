"""License scans with a positional index of rare tokens, in DataFrame operations only.

Templates are short notices, each with mandatory key phrases. The index keeps, of every template, the postings
(word, place) of its rarest words by inverse document frequency over the templates, and of every key phrase the
rarest word as its anchor. A document is scanned word by word against the index. An anchor's place in the document
less its place in the phrase is where the phrase would start; the phrase is verified there word by word, and the
other rare tokens whose relative positions agree (within ``SLACK`` words) add to the template's weight. A template
is found where all its key phrases are verified in order and its matched weight reaches ``least``.

The phrases of the base labels are templates whose only key phrase is the phrase itself, so each of their places
is found by the same lookup. The index is fixed by the templates, about a kilobyte each, and is broadcast.

Defined results: null texts have no words; rows that agree in id and text have equal results, one row each; a
document without finds has empty labels, score 0 and null places.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_array

#: Words by which a template may be stretched or shrunk in a document.
SLACK = 6
#: Rarest words kept of each template.
POSTINGS = 12


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]  # mandatory, in order
    least: float = 0.6  # part of the weight of its rare words that must stand in place
    base: bool = False


#: The phrases of the base labels.
BASE = (
    Template("mit", "under the mit license", ("under the mit license",), 0.0, True),
    Template("apache-2", "apache license version 2", ("apache license version 2",), 0.0, True),
    Template("cc-by-nc", "cc by nc", ("cc by nc",), 0.0, True),
)

#: Wordings of public licence notices.
NOTICES = (
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", ("licensed under the apache license version 2 0", "in compliance with the license")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    Template("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("may be used to endorse or promote products derived from this software",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("licensed under a creative commons attribution 4 0 international license",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    Template("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", ("all copyright and related and neighboring rights", "to the public domain")),
    Template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ("terms of the eclipse public license",)),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", ("licensed under the gnu general public license",)),
    Template("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("terms of the gnu general public license", "published by the free software foundation")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted")),
    Template("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license", "published by the free software foundation")),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "a copy of this software and associated documentation files")),
    Template("mit", "Released under the MIT License", ("released under the mit license",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("terms of the mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
)


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]


def _find(words: list[str], phrase: list[str]) -> int:
    at = next((i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase), -1)
    if at < 0:
        raise ValueError(f"a key phrase is not in its template: {' '.join(phrase)}")
    return at


def build_index(templates: tuple[Template, ...]) -> list[tuple]:
    """Rows (word, template, kind, place in the template, key number, phrase, its words, weight).

    Kind 1 is a key phrase's anchor: ``place`` is of the phrase's start, ``shift`` from there to the anchor.
    Kind 0 is a rare token: ``place`` is its own.
    """
    texts = [words_of(t.text) for t in templates]
    df = Counter(w for words in texts for w in set(words))
    idf = {w: math.log(1 + len(texts) / n) for w, n in df.items()}
    rows = []
    for i, (t, words) in enumerate(zip(templates, texts)):
        for k, key in enumerate(t.keys):
            phrase = words_of(key)
            at = _find(words, phrase)
            rarest = max(range(len(phrase)), key=lambda j: (idf[phrase[j]], len(phrase[j]), -j))
            rows.append((phrase[rarest], i, 1, at, rarest, k, " ".join(phrase), len(phrase), 0.0))
        if not t.base:
            first = {w: p for p, w in reversed(list(enumerate(words)))}
            for w in sorted(first, key=lambda w: (-idf[w], first[w]))[:POSTINGS]:
                rows.append((w, i, 0, first[w], 0, -1, "", 0, idf[w]))
    return rows


_INDEX = "word string, template int, kind int, place int, shift int, key int, phrase string, n_phrase int, weight double"


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base_starts (all places of base phrases), base_labels, found (label, start, share) of every row."""
    spark = docs.sparkSession
    rows = build_index(templates)
    total: dict[int, float] = Counter()
    for r in rows:
        total[r[1]] += r[8]
    # Anchors are looked up first: only documents with a verified key phrase of a notice need the other tokens.
    keys = [r for r in rows if r[2] == 1]
    anchors = spark.createDataFrame([*keys, ("", -1, 1, 0, 0, -1, "", 0, 0.0)], _INDEX)
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), word_array(F.col(text_col)).alias("w")).withColumn("n_words", F.size("w"))
    each = words.select("id", "text_hash", "n_words", "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
    start = F.col("pos") - F.col("shift")
    hits = each.join(F.broadcast(anchors), "word").where((start >= 0) & (start + F.col("n_phrase") <= F.col("n_words")) & (F.array_join(F.slice("w", start + 1, F.col("n_phrase")), " ") == F.col("phrase")))
    # What stands around the phrase, as far as its template reaches: the other postings are matched there.
    longest = max((len(words_of(t.text)) for t in templates), default=0)
    reach = F.lit(longest + SLACK)
    first = F.greatest(F.lit(0), start - F.col("place") - SLACK)
    around = F.when((F.col("template") >= 0) & ~F.col("template").isin([i for i, t in enumerate(templates) if t.base]), F.slice("w", first + 1, reach + SLACK))
    hits = hits.select("id", "text_hash", "n_words", "template", "key", start.alias("start"), (start - F.col("place")).alias("origin"), first.alias("first"), around.alias("around"))

    tokens = spark.createDataFrame([(r[1], r[3], r[0], r[8]) for r in rows if r[2] == 0], "template int, place int, word string, weight double")
    tokens = tokens.groupBy("template").agg(F.collect_list(F.struct("place", "word", "weight")).alias("tokens"))
    sums = spark.createDataFrame([(i, float(total[i]) or 1.0, len(t.keys), t.least, t.label, t.base) for i, t in enumerate(templates)] + [(-1, 1.0, 0, 0.0, "", True)], "template int, total double, n_keys int, least double, label string, base boolean")
    hits = hits.join(F.broadcast(tokens), "template", "left").join(F.broadcast(sums), "template")
    places = lambda t: F.filter(F.transform("around", lambda w, i: F.when(w == t["word"], F.abs(F.col("first") + i - F.col("origin") - t["place"]))), lambda d: d <= SLACK)
    matched = F.aggregate(F.coalesce("tokens", F.array().cast("array<struct<place:int,word:string,weight:double>>")), F.lit(0.0), lambda a, t: a + F.when(F.size(places(t)) > 0, t["weight"]).otherwise(0.0))
    hits = hits.withColumn("share", F.when(F.col("base"), 1.0).otherwise(matched / F.col("total"))).drop("around", "tokens")
    per = hits.groupBy("id", "text_hash", "n_words").agg(
        F.count_if(F.col("template") == -1).alias("ends"),
        F.array_sort(F.collect_set(F.when((F.col("template") >= 0) & F.col("base"), F.struct("start", "template", "label")))).alias("bases"),
        F.collect_set(F.when((F.col("template") >= 0) & ~F.col("base") & (F.col("share") >= F.col("least")), F.struct("template", "label", "n_keys", "origin", "key", "start", "share"))).alias("keys"),
    )
    # Key 0 of a template opens a find; each other key must stand at an origin within the slack.
    opened = F.filter("keys", lambda k: k["key"] == 0)
    others = lambda a: F.size(F.array_distinct(F.transform(F.filter("keys", lambda k: (k["template"] == a["template"]) & (F.abs(k["origin"] - a["origin"]) <= SLACK)), lambda k: k["key"])))
    found = F.transform(F.filter(opened, lambda a: others(a) == a["n_keys"]), lambda a: F.struct(a["label"].alias("label"), a["start"].alias("start"), a["share"].alias("share")))
    out = per.select("id", "text_hash", "n_words", "bases", F.array_sort(found).alias("found"), F.explode(F.array_repeat(F.lit(1), F.col("ends").cast("int"))).alias("_"))
    labels = lambda c: F.array_sort(F.array_distinct(F.col(f"{c}.label")))
    return out.select(F.col("id").alias("doc_id"), "text_hash", F.col("n_words").cast("long").alias("n_words"), F.col("bases.start").alias("base_starts"), labels("bases").alias("base_labels"), "found", F.array_sort(F.array_union(labels("bases"), labels("found"))).alias("labels"))
