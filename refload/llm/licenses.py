"""License scans by a positional index of rare words; DataFrame functions only.

The rarest words of every license text (those of the highest inverse document frequency in the corpus itself) are
its entries in an index, with their places in it. A document's words that the index holds are looked up; each gives the
place at which the license would begin if that word belonged to it. Words of one license that agree on where it begins
make a candidate, and a candidate counts if its mandatory phrases stand where they have to. Drift of a few words
(a name in between, other numbering) is allowed for by bins of beginnings, laid twice, half a bin apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refload.llm.common import store
from refload.session import materialize

#: A word in lower-cased text: digits, a to z, everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a license in the index, the share of them that has to agree, and the width of a bin of beginnings.
RARE = 5
AGREE = 0.6
BIN = 8
#: A phrase alone, without the words around it, counts half.
PHRASE_SCORE = 0.5


@dataclass(frozen=True)
class License:
    """A text by which a license is known, and the phrases without which it is not that license."""

    label: str
    text: str
    phrases: tuple[str, ...]

    def words(self) -> list[str]:
        return re.findall(WORD, self.text.lower())

    def phrase_places(self) -> list[tuple[str, int]]:
        own = self.words()
        parts = [p.split() for p in self.phrases]
        return [(" ".join(p), next(i for i in range(len(own)) if own[i : i + len(p)] == p)) for p in parts]


# Phrases that name a license by themselves.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices and opening paragraphs of common licenses, with mandatory phrases.
LICENSES = (
    License("mit", "Released under the MIT License", ("released under the mit license",)),
    License(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    License(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify", "provided that the above copyright notice and this permission notice appear in all copies"),
    ),
    License(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice"),
    ),
    License("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    License("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    License("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    License(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version",
        ("redistribute it and or modify it under the terms of the gnu general public license",),
    ),
    License(
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation",
        ("redistribute it and or modify it under the terms of the gnu lesser general public license",),
    ),
    License(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at",
        ("mozilla public license v 2 0",),
    ),
    License("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    License("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    License("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    License(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software",
        ("unencumbered software released into the public domain",),
    ),
    License(
        "boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
        ("permission is hereby granted free of charge", "reproduce display distribute execute and transmit the software"),
    ),
    License(
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any "
        "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose",
        ("provided as is without any express or implied warranty", "permission is granted to anyone to use this software"),
    ),
)


def words_of(text: Column) -> Column:
    """The words of whole texts; only A to Z are lower-cased, null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_column: str = "text") -> dict[str, int]:
    """In how many documents each word of the licenses stands: as many rows as the licenses have words, over all documents."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = docs.select(F.explode(F.array_intersect(known, words_of(F.col(text_column)))).alias("word"))
    counted = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: counted.get(w, 0) for w in vocabulary}


def rare_index(licenses: tuple[License, ...], frequencies: dict[str, int], rare: int = RARE) -> list[tuple[int, str, int]]:
    """(license, word, place) of the ``rare`` words of each license that the fewest documents hold, equal ones by their bytes."""
    index = []
    for number, known in enumerate(licenses):
        own = known.words()
        first = sorted(set(own), key=lambda w: (frequencies[w], w.encode()))[:rare]
        index += [(number, w, at) for at, w in enumerate(own) if w in first]
    return index


def _facts(docs: DataFrame, licenses: tuple[License, ...], watched: list[str], id_column: str, text_column: str) -> DataFrame:
    """(row, id, n_words, tokens), stored: ``tokens`` are the watched words of each row, with places and the words from there on."""
    longest = max(len(p.split()) for p in [*(p for x in licenses for p in x.phrases), *(p for p, _ in BASE)])
    split = docs.select(F.col(id_column).alias("id"), words_of(F.col(text_column)).alias("words"))
    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(watched), i)), lambda i: i.isNotNull())
    placed = split.select("id", "words", F.size("words").cast("long").alias("n_words"), at.alias("at"))
    tokens = F.transform(
        "at",
        lambda i: F.struct(
            i.cast("long").alias("pos"), F.get("words", i).alias("word"),
            F.concat(F.array_join(F.slice("words", i + 1, longest), " "), F.lit(" ")).alias("words"),
        ),
    )
    told = placed.select(F.monotonically_increasing_id().alias("row"), "id", "n_words", tokens.alias("tokens"))
    return materialize(told, "license-facts")


def _starts(*phrases: str) -> Callable[[Column], Column]:
    """Whether one of the phrases stands at a token."""
    return lambda token: reduce(or_, [token["words"].startswith(p + " ") for p in phrases])


def _known(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """Rows of constants, as many as the license texts give."""
    made = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


def _placed(facts: DataFrame, licenses: tuple[License, ...], index: list[tuple[int, str, int]], agree: float) -> DataFrame:
    """(row, license, start, share) of each place where enough rare words agree and the mandatory phrases stand.

    The index and the phrases are as large as the license texts, whatever the corpus.
    """
    spark = facts.sparkSession
    words = [(n, w, at, w, "") for n, w, at in index]
    phrases = [(n, p.split()[0], at, "", p) for n, x in enumerate(licenses) for p, at in x.phrase_places()]
    postings = _known(spark, words + phrases, ["license", "word", "at", "rare", "phrase"])
    own: dict[int, set[str]] = {}
    for number, word, _ in index:
        own.setdefault(number, set()).add(word)
    needs = [(n, len(own[n]), len(set(x.phrases))) for n, x in enumerate(licenses)]
    needed = _known(spark, needs, ["license", "rare_words", "phrases"])
    hits = facts.select("row", F.explode("tokens").alias("token")).select("row", "token.*")
    hits = hits.join(F.broadcast(postings), "word").filter("phrase = '' OR startswith(words, concat(phrase, ' '))")
    start = F.col("pos") - F.col("at")
    bins = F.explode(F.array(*[F.struct(F.lit(s).alias("shift"), F.floor((start + s) / BIN).alias("bin")) for s in (0, BIN // 2)]))
    binned = hits.select("row", "license", start.alias("start"), "rare", "phrase", bins.alias("place"))
    met = binned.groupBy("row", "license", "place").agg(
        F.min("start").alias("start"), F.collect_set(F.nullif("rare", F.lit(""))).alias("rare"),
        F.collect_set(F.nullif("phrase", F.lit(""))).alias("phrases"),
    )
    met = met.select("row", "license", "start", F.size("rare").alias("n"), F.size("phrases").alias("m"))
    met = met.join(F.broadcast(needed), "license")
    met = met.filter((F.col("m") == F.col("phrases")) & (F.col("n") >= F.ceil(agree * F.col("rare_words"))))
    share = F.max(F.col("n") / F.col("rare_words")).alias("share")
    return met.groupBy("row", "license", F.greatest("start", F.lit(0)).alias("start")).agg(share)


def scan_licenses(
    docs: DataFrame, licenses: tuple[License, ...] = LICENSES, rare: int = RARE, agree: float = AGREE, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, places) of every row.

    ``n_base`` counts the places of the base phrases, ``first_word`` and ``last_word`` are the first and last of them (null if
    none), ``base_labels`` their labels. ``labels`` adds those of licenses found by the index, ``places`` tells of these
    (label, start, share) where they begin and which share of their rare words agrees. ``score`` is the largest share, half
    for a base phrase alone, 0 for nothing.

    Whole texts are scanned; null and empty ones have no words and no labels. Repeated rows and ids, null ids too, are rows
    of their own. A document may hold any number of licenses, also the same one again. Other columns are not looked at; an
    empty table gives no rows.
    """
    vocabulary = sorted({w for x in licenses for w in x.words()})
    index = rare_index(licenses, document_frequencies(docs, vocabulary, text_column), rare)
    heads = {p.split()[0] for x in licenses for p in x.phrases} | {p.split()[0] for p, _ in BASE}
    facts = _facts(docs, licenses, sorted({w for _, w, _ in index} | heads), id_column, text_column)
    labels = F.create_map(*[F.lit(v) for n, x in enumerate(licenses) for v in (n, x.label)])
    place = F.struct(labels[F.col("license")].alias("label"), "start", "share")
    placed = _placed(facts, licenses, index, agree).groupBy("row").agg(F.array_sort(F.collect_set(place)).alias("places"))
    placed = store(placed, "license-places")
    told = facts.join(placed, "row", "left").withColumn("places", F.coalesce("places", F.array().cast(placed.schema["places"].dataType)))
    told = told.withColumn("base", F.filter("tokens", _starts(*[p for p, _ in BASE])))
    at = F.transform("base", lambda t: t["pos"])
    kinds = [F.when(F.exists("base", _starts(p)), F.lit(label)) for p, label in BASE]
    base_labels = F.array_sort(F.array_compact(F.array(*kinds)))
    all_labels = F.array_sort(F.array_union(base_labels, F.transform("places", lambda p: p["label"])))
    best = F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0))
    score = F.greatest(F.when(F.size("base") > 0, F.lit(PHRASE_SCORE)).otherwise(F.lit(0.0)), best)
    return told.select(
        F.col("id").alias(id_column), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"), F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"), score.alias("score"), "places",
    )


def licenses_sql(licenses: tuple[License, ...] = LICENSES, rare: int = RARE, agree: float = AGREE) -> str:
    """The same rows in DuckDB, every word of every document against every license; without ``places``."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    known = ", ".join(f"({n}, '{x.label}', {listed(x.words())})" for n, x in enumerate(licenses))
    phrases = ", ".join(f"({n}, {listed(p.split())}, {at})" for n, x in enumerate(licenses) for p, at in x.phrase_places())
    base = ", ".join(f"({listed(p.split())}, '{label}')" for p, label in BASE)
    here = "list_slice(d.w, o.pos + 1, o.pos + len(p.words)) = p.words"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
  o AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
  known(license, label, words) AS (VALUES {known}),
  phrases(license, words, place) AS (VALUES {phrases}),
  base(words, label) AS (VALUES {base}),
  postings AS (SELECT license, unnest(words) AS word, unnest(range(len(words))) AS place FROM known),
  df AS (SELECT word, count(DISTINCT r) AS n FROM o WHERE word IN (SELECT word FROM postings) GROUP BY word),
  rare AS (SELECT license, word FROM (SELECT DISTINCT license, word FROM postings) LEFT JOIN df USING (word)
    QUALIFY row_number() OVER (PARTITION BY license ORDER BY coalesce(n, 0), word) <= {rare}),
  hits AS (SELECT r, license, pos - place AS start, word AS rare, NULL AS phrase FROM o JOIN postings USING (word) JOIN rare USING (license, word)
    UNION ALL SELECT o.r, p.license, o.pos - p.place, NULL, array_to_string(p.words, ' ') FROM phrases AS p JOIN o ON o.word = p.words[1]
    JOIN d ON d.r = o.r AND {here}),
  met AS (SELECT r, license, count(DISTINCT rare) AS n, count(DISTINCT phrase) AS m
    FROM hits CROSS JOIN (VALUES (0), ({BIN // 2})) AS s(shift) GROUP BY r, license, shift, floor((start + shift) / {BIN}.0)),
  found AS (SELECT met.r, k.label, met.n / x.n AS share FROM met JOIN known AS k USING (license)
    JOIN (SELECT license, count(*) AS n FROM rare GROUP BY license) AS x USING (license)
    WHERE met.n >= ceil({agree} * x.n) AND met.m = (SELECT count(DISTINCT p.words) FROM phrases AS p WHERE p.license = met.license)),
  b AS (SELECT o.r, o.pos, p.label FROM base AS p JOIN o ON o.word = p.words[1] JOIN d ON d.r = o.r AND {here}),
  bs AS (SELECT r, count(*) AS n, min(pos) AS first, max(pos) AS last, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM b GROUP BY r),
  ls AS (SELECT r, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS share
    FROM (SELECT r, label, share FROM found UNION ALL SELECT r, label, {PHRASE_SCORE} FROM b) GROUP BY r)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(bs.n, 0) AS n_base, CAST(bs.first AS BIGINT) AS first_word, CAST(bs.last AS BIGINT) AS last_word,
    coalesce(bs.labels, '') AS base_labels, coalesce(ls.labels, '') AS labels, CAST(coalesce(ls.share, 0) AS DOUBLE) AS score
  FROM d LEFT JOIN bs USING (r) LEFT JOIN ls USING (r)"""
