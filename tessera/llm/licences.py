"""Licence scan by a positional index of rare words.

Each template is a notice with one mandatory key phrase at a known place. Document frequencies of all key words are
counted over every document; a template is posted, with their places, under the RARE rarest words of its key phrase
(highest IDF). A file that holds the rarest of any template has all its indexed words looked up: each posting gives a
template and an offset. Sorted, equal pairs of template and offset stand together, and where all of a template's rare words
agree on one (the intersection of their postings by relative position) the whole key phrase is verified. No place of a key
phrase is missed, as all its words, rare ones included, then stand in their places. The score is the best share, by IDF, of a
template's words found in their places.

Nulls: a null text is empty (no words, no labels, score 0), a null doc_id is kept. Repeated rows and ties: each row
stands alone, ties of IDF go to the smaller word. Very long texts: linear but for the sort of their hits. No rows: none. Extra
columns: ignored, whatever their names. What goes to the driver is one count for each template word, so its bound is the
templates' own size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that separate words: all but digits and letters.
GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False


#: How files name these licences, and the notices that the licences themselves word. Base phrases are marked.
TEMPLATES = (
    Template("gpl", "licensed under the gnu general public license version", "gnu general public license", True),
    Template("apache", "licensed under the apache license version 2 0", "apache license", True),
    Template("cc-by", "licensed under cc by 4 0", "cc by", True),
    Template("mit", "released under the mit license", "mit license", True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("bsd", "licensed under the bsd license", "bsd license"),
    Template("proprietary", "copyright all rights reserved", "all rights reserved"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope "
        "that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "terms of the gnu general public license as published by the free software foundation",
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published "
        "by the free software foundation either version 2 1 of the license or at your option any later version",
        "gnu lesser general public license",
    ),
    Template(
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published "
        "by the free software foundation either version 3 of the license or at your option any later version",
        "gnu affero general public license",
    ),
    Template(
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a "
        "copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "you may not use this file except in compliance with the license",
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
        "you can obtain one at https mozilla org mpl 2 0",
        "mozilla public license",
    ),
    Template(
        "epl",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at "
        "https www eclipse org legal epl 2 0",
        "eclipse public license",
    ),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the "
        "above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "obtaining a copy of this software and associated documentation files",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
        "distribute this software for any purpose with or without fee",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions "
        "in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or "
        "other materials provided with the distribution",
        "redistribution and use in source and binary forms",
    ),
    Template(
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works",
        "obtaining a copy of the software and accompanying documentation covered by this license",
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising "
        "from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to "
        "alter it and redistribute it freely",
        "permission is granted to anyone to use this software for any purpose",
    ),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute "
        "this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "free and unencumbered software released into the public domain",
    ),
)
#: Under how many of its key phrase's words a template is posted at most.
RARE = 3


def licence_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and all characters beyond ASCII."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + GAPS, LOWER + " " * len(GAPS))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def quoted(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


def counts(docs: DataFrame, text: str) -> dict[str, int]:
    """In how many documents each template word stands; and of all documents, under ''."""
    known = sorted({w for t in TEMPLATES for w in t.text.split()})
    held = docs.select(licence_words(F.col(text)).alias("w")).select(F.expr(f"array_append(array_distinct(filter(w, x -> x IN ({quoted(known)}))), '')").alias("w"))
    return {r["w"]: r["n"] for r in held.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}


def idf(seen: dict[str, int], word: str) -> float:
    return round(math.log((1 + seen.get("", 0)) / (1 + seen.get(word, 0))) + 1, 6)


def places(t: Template) -> tuple[list[str], list[str], int]:
    """A template's words, its key phrase's, and where that starts."""
    body, key = t.text.split(), t.key.split()
    return body, key, next(i for i in range(len(body)) if body[i : i + len(key)] == key)


def index(seen: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> tuple[str, str, str, str]:
    """SQL of the templates' array, of the map from an indexed word to its postings, of the indexed words, and of those that
    are a template's rarest."""
    rows, postings, rarest = [], {}, set()
    for at, t in enumerate(templates):
        body, key, start = places(t)
        rare = sorted(dict.fromkeys(key), key=lambda w: (-idf(seen, w), w))[:RARE]
        rarest.add(rare[0])
        rows.append(
            f"named_struct('label', '{t.label}', 'base', {str(t.base).lower()}, 'body', array({quoted(body)}), 'key', array({quoted(key)}), 'start', {start}, "
            f"'rare', {len(rare)}, 'idf', array({', '.join(f'{idf(seen, w)}D' for w in body)}))"
        )
        for w in rare:
            postings.setdefault(w, []).append(f"named_struct('t', {at}, 'p', {start + key.index(w)})")
    listed = ", ".join(f"'{w}', array({', '.join(p)})" for w, p in sorted(postings.items()))
    return f"array({', '.join(rows)})", f"map({listed})", quoted(sorted(postings)), quoted(sorted(rarest))


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the digest columns; found: array<struct<label, base, start, share>> of all verified places."""
    templates, postings, indexed, rarest = index(counts(docs, text))
    split = docs.select(F.col(doc_id).alias("doc_id"), licence_words(F.col(text)).alias("w"))
    hits = split.select("*", F.expr(f"transform(array(w), v -> CASE WHEN exists(v, x -> x IN ({rarest})) THEN filter(sequence(0, size(v) - 1), i -> v[i] IN ({indexed})) ELSE CAST(array() AS array<int>) END)[0]").alias("hits"))
    # from a hit: its postings give offsets; where all rare words of a template meet in one, the key phrase is verified
    found = hits.select("doc_id", F.size("w").cast("long").alias("n_words"), F.expr(f"""
      transform(array(struct(w, hits)), z ->
      CASE WHEN size(z.hits) = 0 THEN NULL ELSE
      transform(
        filter(
          transform(
            filter(
              transform(array(sort_array(flatten(transform(z.hits, i -> transform(element_at({postings}, z.w[i]), c -> struct(c.t AS t, i - c.p AS off)))))), s ->
                transform(s, (c, k) -> struct(c.t AS t, c.off AS off, coalesce(get(s, k - 1) = c, false) AS again,
                  coalesce(get(s, k + 1) = c, false) AS two, coalesce(get(s, k + 2) = c, false) AS three)))[0],
              c -> NOT c.again),
            c -> struct(element_at({templates}, c.t + 1) AS t, c.off AS off, 1 + int(c.two) + int(c.three) AS met)),
          c -> c.met = c.t.rare AND c.off + c.t.start >= 0 AND slice(z.w, greatest(1, c.off + c.t.start + 1), size(c.t.key)) = c.t.key),
        c -> struct(c.t.label AS label, c.t.base AS base, c.off + c.t.start AS start,
          aggregate(sequence(0, size(c.t.body) - 1), 0D, (a, k) -> a + if(coalesce(get(z.w, c.off + k) = c.t.body[k], false), c.t.idf[k], 0D))
            / aggregate(c.t.idf, 0D, (a, x) -> a + x) AS share)) END)[0]""").alias("found"))  # fmt: skip
    base = F.expr("filter(coalesce(found, array()), f -> f.base)")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda f: f["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda f: f["start"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda f: f["label"]))), ",").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(transform(coalesce(found, array()), f -> f.label))), ',')").alias("labels"),
        F.expr("round(coalesce(array_max(transform(found, f -> f.share)), 0D), 6)").alias("score"),
        "found",
    )


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents")).drop("found")


def oracle() -> str:
    """Looks for every key phrase at every place."""
    rows = []
    for at, t in enumerate(TEMPLATES):
        body, key, start = places(t)
        rows.append(f"({at}, '{t.label}', {t.base}, [{quoted(body)}], [{quoted(key)}], {start})")
    return rf"""
WITH t(t, label, base, body, key, start) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
f AS (SELECT x, count(*) AS n FROM (SELECT unnest(list_distinct(w)) AS x FROM d) GROUP BY x),
i AS (SELECT t, k, body[k] AS word, round(ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(n, 0))) + 1, 6) AS idf
  FROM (SELECT t, body, unnest(range(1, len(body) + 1)) AS k FROM t) LEFT JOIN f ON x = body[k]),
p AS (SELECT rid, w, t, label, base, start, unnest(list_filter(range(0, len(w) - len(key) + 1), lambda j: w[j + 1 : j + len(key)] = key)) AS place FROM d, t WHERE list_has_all(w, key)),
s AS (SELECT rid, p.t, any_value(label) AS label, any_value(base) AS base, place, sum(CASE WHEN w[place - start + k] = word AND place - start + k >= 1 THEN idf ELSE 0 END) / sum(idf) AS share
  FROM p JOIN i ON p.t = i.t GROUP BY rid, p.t, place),
g AS (SELECT rid, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM s GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  round(coalesce(score, 0), 6) AS score FROM d LEFT JOIN g USING (rid)
"""


ORACLE_OP8 = oracle()
