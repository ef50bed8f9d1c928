"""How far the sources of a language differ in their words, by ranking count cells.

A term's value depends only on how often it occurs in its group (a source of a language) and in the language. Terms of
equal counts are therefore one cell: the formula is evaluated once a cell, equal values are merged, and values are ranked
by how many terms the larger ones cover. Only cells that reach the wanted ranks are opened again into their terms, in
the order of their UTF-8 bytes. Distances between two sources come from cells of both sources' counts in the same way.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refload.llm.common import map_batches, store, utf8

#: A word in lower-cased bytes: ASCII letters and everything beyond ASCII.
WORD = re.compile(rb"[a-z\x80-\xff]+")
MIN_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
#: Added to every count of a kept term.
PRIOR = 1


def term_counts(docs: DataFrame, lang_column: str = "lang", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term; the term '' stands for the group itself."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        columns = (batch.column(c).to_pylist() for c in ("lang", "source", "text"))
        for lang, source, text in zip(*columns, strict=True):
            total, docs_with = groups.setdefault((lang, source), (Counter({b"": 0}), Counter({b"": 0})))
            own = Counter(WORD.findall(text.lower()))
            total.update(own)
            docs_with.update(own.keys())
        told = [(g, len(total)) for g, (total, _) in groups.items()]
        arrays = [pa.array([g[i] for g, n in told for _ in range(n)], pa.string()) for i in (0, 1)]
        arrays.append(pa.array([t for total, _ in groups.values() for t in total], pa.binary()))
        arrays.append(pa.array([n for total, _ in groups.values() for n in total.values()], pa.int64()))
        arrays.append(pa.array([docs_with[t] for total, docs_with in groups.values() for t in total], pa.int64()))
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

    named = [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_column, "lang"), (source_column, "source"))]
    rows = map_batches(docs.select(*named, utf8(text_column).alias("text")), run, "lang string, source string, term binary, n long, docs long")
    rows = rows.withColumn("term", F.col("term").cast("string"))
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), exactly."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(19,0)")
    return F.call_function("div", above, (total + PRIOR * kept).cast("decimal(19,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); the square of two shares stays below 2^63."""
    return F.call_function("div", (p - q) * (p - q), q)


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every group and each other source of its language.

    The value is a sum over all kept terms. Per pair of sources it is split into what every term would add if neither
    source had it, corrections for the terms of one, and corrections for the terms of both. The first two come from
    counts per source; only the last looks at pairs, after terms of equal counts everywhere have become one row.
    """
    own = ["source", "kept", "total", "terms"]
    g = groups.select("lang", *[F.col(c).alias(f"a_{c}") for c in own])
    h = groups.select("lang", *[F.col(c).alias(f"b_{c}") for c in own])
    met = store(g.join(h, "lang").filter("a_source <> b_source"), "divergence-met")

    def f(a: Column, b: Column) -> Column:
        return distance(share(a, F.col("a_total"), F.col("a_kept")), share(b, F.col("b_total"), F.col("b_kept")))

    none = F.lit(0).cast("long")
    rest = F.col("a_kept") - F.col("a_terms") - F.col("b_terms")
    empty = F.when(F.col("a_kept") > 0, rest * f(none, none)).otherwise(none)
    key = ["lang", F.col("a_source").alias("source"), F.col("b_source").alias("item")]
    parts = [met.select(*key, empty.alias("value"))]
    one = kept.select("lang", F.explode("by").alias("by")).groupBy("lang", "by.source", "by.n").agg(F.count("*").alias("m"))
    one = store(one, "divergence-single")
    for side, x, y in (("a", F.col("n"), none), ("b", none, F.col("n"))):
        mine = one.withColumnRenamed("source", f"{side}_source")
        parts.append(met.join(mine, ["lang", f"{side}_source"]).select(*key, (F.col("m") * f(x, y)).alias("value")))
    shapes = kept.filter(F.size("by") > 1).groupBy("lang", "by").agg(F.count("*").alias("m"))
    first = shapes.select("lang", "m", "by", F.posexplode("by").alias("at", "a"))
    later = F.explode(F.slice("by", F.col("at") + 2, F.size("by"))).alias("b")
    cells = first.select("lang", "m", "a", later).groupBy("lang", "a", "b").agg(F.sum("m").alias("m"))
    cells = store(cells, "divergence-cells")
    for x, y in (("a", "b"), ("b", "a")):
        both = cells.select(
            "lang", F.col(f"{x}.source").alias("a_source"), F.col(f"{x}.n").alias("a_n"),
            F.col(f"{y}.source").alias("b_source"), F.col(f"{y}.n").alias("b_n"), "m",
        )
        a, b = F.col("a_n"), F.col("b_n")
        more = f(a, b) - f(a, none) - f(none, b) + f(none, none)
        parts.append(met.join(both, ["lang", "a_source", "b_source"]).select(*key, (F.col("m") * more).alias("value")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    return union.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _terms(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank): each group's terms above the language's share, the first ``top`` of them."""
    group = ["lang", "source"]
    opened = kept.select("lang", "term", F.col("n").alias("of_lang"), F.explode("by").alias("by"))
    opened = opened.select("lang", "by.source", "term", F.col("by.n").alias("of_group"), "of_lang")
    cells = opened.groupBy(*group, "of_group", "of_lang").agg(F.count("*").alias("m")).join(groups, group)
    p = share(F.col("of_group"), F.col("total"), F.col("kept"))
    q = share(F.col("of_lang"), F.col("lang_total"), F.col("kept"))
    cells = cells.select(*group, "of_group", "of_lang", "m", p.alias("p"), q.alias("q")).filter("p > q")
    cells = store(cells.select(*group, "of_group", "of_lang", "m", distance(F.col("p"), F.col("q")).alias("value")), "divergence-ranked")
    # A value stands for a term at least, so the first ``top`` values are enough, whatever the number of cells.
    by_value = Window.partitionBy(*group).orderBy(F.desc("value"))
    values = cells.groupBy(*group, "value").agg(F.sum("m").alias("m")).withColumn("place", F.row_number().over(by_value))
    values = values.filter(F.col("place") <= top)
    before = F.coalesce(F.sum("m").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("before", before).filter(F.col("before") < top).select(*group, "value", "before")
    wanted = store(cells.join(values, [*group, "value"]).select(*group, "of_group", "of_lang", "value", "before"), "divergence-wanted")
    found = opened.join(wanted, [*group, "of_group", "of_lang"])
    in_value = Window.partitionBy(*group, "value").orderBy("term")
    found = found.withColumn("place", F.row_number().over(in_value)).filter(F.col("place") <= top)
    rank = F.col("before") + F.col("place")
    return found.select(*group, F.col("term").alias("item"), "value", rank.cast("int").alias("rank")).filter(F.col("rank") <= top)


def source_divergence(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang_column: str = "lang", source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (language, source) that occurs.

    Part ``pair``: the other sources of the language by their distance over all terms that the language keeps (those in
    ``min_docs`` of its documents or more). Part ``term``: the terms of the group that it has oftener than the
    language, the first ``top``. Ranks count from 1, the largest value first, equal values by the bytes of the item.

    Null texts, languages and sources are ''; that is a language or source of its own. Repeated rows are documents of
    their own. A group without terms, or a language that keeps none, has pairs (of value 0 if nothing is kept) and no
    terms. Very long texts are counted whole. An empty table gives no rows; other columns are not looked at.
    """
    counts = store(term_counts(docs, lang_column, source_column, text_column), "divergence-counts")
    by = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("by")
    kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), by)
    kept = store(kept.filter(F.col("docs") >= min_docs).select("lang", "term", "n", "by"), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    totals = kept.select("lang", F.explode("by").alias("by")).groupBy("lang", "by.source")
    totals = totals.agg(F.sum("by.n").alias("total"), F.count("*").alias("terms"))
    groups = counts.filter("term = ''").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = store(groups.na.fill(0, ["kept", "lang_total", "total", "terms"]), "divergence-groups")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(kept, groups).withColumn("rank", F.row_number().over(by_value))
    shape = ["lang", "source", "part", "item", "value", "rank"]
    terms = _terms(kept, groups, top).withColumn("part", F.lit("term"))
    return pairs.withColumn("part", F.lit("pair")).select(shape).unionAll(terms.select(shape))


#: The same rows in DuckDB, term by term.
DIVERGENCE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
  l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
  g AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
  s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY lang, source),
  e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (coalesce(s.n, 0) + l.v) AS p,
      1 + 1000000000 * (k.n + 1) // (l.n + l.v) AS q
    FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM e AS a JOIN e AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  allpairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
    FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs AS p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM e WHERE n > 0 AND p > q),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
    FROM (SELECT * FROM allpairs UNION ALL SELECT * FROM terms))
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
  WHERE part = 'pair' OR rank <= 200"""
