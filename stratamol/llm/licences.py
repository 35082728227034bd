"""License scans by a positional index of rare words, in DataFrame functions only.

Templates are the mandatory key phrases of public licence texts and notices. Of each phrase the two words of the highest
inverse document frequency over the documents at hand are posted in an index, word -> (phrase, place in it). A document's
words that stand in the index are looked up; each posting gives the place where its phrase would begin, and phrases both of
whose words agree on this place are compared whole. A template's label needs all of its key phrases.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of characters other than these, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrase and label.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Templates of our own, fixed values: label and the key phrases that must all be there.
TEMPLATES = (
    ("agpl", ("gnu affero general public license",)),
    ("apache-2", ("licensed under the apache license version 2 0", "you may not use this file except in compliance with the license")),
    ("apache-2", ("apache license version 2 0 january 2004", "terms and conditions for use reproduction and distribution")),
    ("artistic", ("the artistic license 2 0",)),
    ("boost", ("boost software license",)),
    ("bsd", ("redistribution and use in source and binary forms",)),
    ("bsd-2", ("redistribution and use in source and binary forms with or without modification are permitted", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary form must reproduce the above copyright notice")),
    ("bsd-3", ("redistribution and use in source and binary forms", "neither the name of")),
    ("bsd-3", ("redistributions of source code must retain the above copyright notice", "may be used to endorse or promote products derived from this software without specific prior written permission")),
    ("cc-by", ("creative commons attribution",)),
    ("cc-by-nc", ("cc by nc",)),
    ("cc-by-nc", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", ("cc by sa",)),
    ("cc-by-sa", ("creative commons attribution sharealike",)),
    ("cc0", ("creative commons zero",)),
    ("cc0", ("to the extent possible under law", "has waived all copyright and related or neighboring rights")),
    ("epl", ("eclipse public license",)),
    ("gpl-2", ("you can redistribute it and or modify it under the terms of the gnu general public license", "either version 2 of the license or at your option any later version")),
    ("gpl-3", ("you can redistribute it and or modify it under the terms of the gnu general public license", "either version 3 of the license or at your option any later version")),
    ("isc", ("isc license",)),
    ("isc", ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",)),
    ("lgpl", ("gnu lesser general public license",)),
    ("mit", ("permission is hereby granted free of charge", "the software is provided as is")),
    ("mit", ("permission is hereby granted free of charge to any person obtaining a copy", "this permission notice shall be included in all copies or substantial portions of the software")),
    ("mpl", ("mozilla public license",)),
    ("mpl-2", ("this source code form is subject to the terms of the mozilla public license v 2 0",)),
    ("ofl", ("sil open font license",)),
    ("proprietary", ("all rights reserved",)),
    ("unlicense", ("this is free and unencumbered software",)),
    ("zlib", ("this software is provided as is without any express or implied warranty", "altered source versions must be plainly marked as such")),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def phrases(base=BASE, templates=TEMPLATES) -> list[str]:
    return sorted({p for p, _ in base} | {p for _, own in templates for p in own})


def words(text: Column) -> Column:
    """The words of a text in their own case; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def inverse_frequencies(docs: DataFrame, text_col: str = "text", base=BASE, templates=TEMPLATES) -> dict[str, float]:
    """log((1 + texts) / (1 + texts with the word)) of each word of the phrases, over all rows.

    At most one row for each of the phrases' words reaches the driver. Null texts count as texts without words; words are
    taken in lower case; repeated rows count each; an empty table gives 0 for every word."""
    vocab = sorted({w for p in phrases(base, templates) for w in p.split()})
    has = F.array_distinct(F.filter(F.transform(words(F.col(text_col)), F.lower), lambda w: w.isin(vocab)))
    found = docs.select(F.explode(F.concat(F.array(F.lit("")), has)).alias("word")).groupBy("word").count()
    count = {r["word"]: r["count"] for r in found.collect()}
    total = count.get("", 0)
    return {w: log((1 + total) / (1 + count.get(w, 0))) for w in vocab}


def postings(idf: dict[str, float], base=BASE, templates=TEMPLATES) -> dict[str, list[tuple[int, int]]]:
    """word -> (phrase, place in it) of the two words of the highest idf of each phrase; ties: the first."""
    out: dict[str, list[tuple[int, int]]] = {}
    for k, p in enumerate(phrases(base, templates)):
        own = p.split()
        for at in sorted(range(len(own)), key=lambda i: (-idf[own[i]], i))[:2]:
            out.setdefault(own[at], []).append((k, at))
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES, idf: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, n_words, places, n_base, first_word, last_word, base_labels, labels, score) of each row.

    places: array of (phrase, start word) of all verified places. score: the largest share of a template's key phrases that
    the text has, 1 for a base phrase, 0 without any. Null or empty text: no words, empty labels. Rows are treated one by
    one: repeated rows give repeated results; other columns, whatever their names, are ignored; an empty table gives an
    empty result."""
    idf = inverse_frequencies(docs, text_col, base, templates) if idf is None else idf
    every, index = phrases(base, templates), postings(idf, base, templates)
    if min(map(len, (p.split() for p in every)), default=2) < 2:
        raise ValueError("a phrase has two words at least")
    d = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.lower(F.get("w", i)).isin(list(index)))
    d = d.withColumn("at", F.when(F.size("w") > 0, at).otherwise(F.array().cast("array<int>")))
    of = F.create_map(*[x for w, ps in index.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("phrase"), F.lit(i).alias("at")) for k, i in ps]))])
    # the index's words only stand for themselves: a map has no other keys
    hits = F.flatten(F.transform("at", lambda i: F.transform(F.element_at(of, F.lower(F.get("w", i))), lambda x: F.struct(x["phrase"].alias("phrase"), (i - x["at"]).alias("start")))))
    d = d.withColumn("hits", F.array_sort(hits))
    twice = F.filter(F.sequence(F.lit(0), F.size("hits") - 2), lambda i: F.get("hits", i) == F.get("hits", i + 1))
    met = F.filter(F.transform(twice, lambda i: F.get("hits", i)), lambda x: x["start"] >= 0)
    texts, sizes = F.array(*map(F.lit, every)), F.array(*[F.lit(len(p.split())) for p in every])
    whole = F.filter(met, lambda x: F.translate(F.array_join(F.slice("w", x["start"] + 1, F.get(sizes, x["phrase"])), " "), _UPPER, _LOWER) == F.get(texts, x["phrase"]))
    places = F.transform(whole, lambda x: F.struct(F.get(texts, x["phrase"]).alias("phrase"), x["start"].cast("long").alias("start")))
    d = d.withColumn("places", F.when(F.size("hits") > 1, places).otherwise(F.array().cast("array<struct<phrase:string,start:bigint>>")))
    d = d.select("doc_id", F.size("w").cast("long").alias("n_words"), "places")
    has = F.transform("places", lambda x: x["phrase"])
    starts = F.transform(F.filter("places", lambda x: x["phrase"].isin([p for p, _ in base])), lambda x: x["start"])
    d = d.withColumn("has", F.array_distinct(has)).withColumn("starts", starts)

    def named(pairs):
        got = F.array(*[F.when(ok, F.lit(label)) for label, ok in pairs])
        return F.array_join(F.array_sort(F.array_distinct(F.filter(got, lambda x: x.isNotNull()))), ",")

    base_ok = [(label, F.array_contains("has", p)) for p, label in base]
    own_ok = [(label, F.forall(F.array(*map(F.lit, ps)), lambda p: F.array_contains("has", p))) for label, ps in templates]
    shares = [F.when(ok, 1.0).otherwise(0.0) for _, ok in base_ok] + [F.size(F.array_intersect("has", F.array(*map(F.lit, ps)))) / F.lit(float(len(ps))) for _, ps in templates]
    return d.select(
        "doc_id", "n_words", "places", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        named(base_ok).alias("base_labels"), named(base_ok + own_ok).alias("labels"), F.greatest(*shares).alias("score"),
    )


def oracle(base=BASE, templates=TEMPLATES) -> str:
    """The digest in DuckDB SQL: each phrase is looked for in the words, joined by two spaces."""

    def pad(p):
        return " " + p.replace(" ", "  ") + " "

    def has(p):
        return f"contains(j, '{pad(p)}')"

    base_starts = " || ".join(f"list_filter(range(0, n_words - {len(p.split()) - 1}), lambda i: contains(j, '{pad(p)}') AND {' AND '.join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))})" for p, _ in base)

    def labels(pairs):
        case = ", ".join(f"CASE WHEN {ok} THEN '{label}' END" for label, ok in pairs)
        return f"array_to_string(list_sort(list_distinct(list_filter([{case}], lambda x: x IS NOT NULL))), ',')"

    base_ok = [(label, has(p)) for p, label in base]
    own = [(label, "(" + " AND ".join(map(has, ps)) + ")") for label, ps in templates]
    shares = [f"CASE WHEN {ok} THEN 1.0::DOUBLE ELSE 0 END" for _, ok in base_ok] + ["(" + " + ".join(f"{has(p)}::INT" for p in ps) + f") / {len(ps)}.0::DOUBLE" for _, ps in templates]
    return f"""
    WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    b AS (SELECT doc_id, w, len(w)::BIGINT AS n_words, CASE WHEN len(w) > 0 THEN ' ' || array_to_string(w, '  ') || ' ' ELSE '' END AS j FROM a),
    c AS (SELECT *, {base_starts} AS s FROM b)
    SELECT doc_id, n_words, len(s)::BIGINT AS n_base, list_min(s)::BIGINT AS first_word, list_max(s)::BIGINT AS last_word,
      {labels(base_ok)} AS base_labels, {labels(base_ok + own)} AS labels, greatest({', '.join(shares)})::DOUBLE AS score FROM c"""
