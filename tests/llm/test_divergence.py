from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from refload.llm.divergence import DIVERGENCE_SQL, source_divergence
from refload.llm.queries import QUERIES
from tests.llm.conftest import SF
from tests.oracle import connect, difference

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs=3, top=200):
    """(text, lang, source) rows, term by term."""
    lower = str.maketrans({c: chr(ord(c) + 32) for c in map(chr, range(65, 91))})
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(lower))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in seen.items() if n >= min_docs]
        counts = defaultdict(Counter)
        for _, source, terms in own:
            counts[source].update(terms)
            counts[None].update(terms)
        total = {s: sum(c[t] for t in kept) for s, c in counts.items()}

        def p(s, t, counts=counts, total=total, kept=kept):
            return 1 + 10**9 * (counts[s][t] + 1) // (total[s] + len(kept))

        def f(a, b):
            return (a - b) ** 2 // b

        for s in set(counts) - {None}:
            far = [(-sum(f(p(s, t), p(o, t)) for t in kept), o.encode(), "pair") for o in set(counts) - {None, s}]
            more = [(-f(p(s, t), p(None, t)), t.encode(), "term") for t in kept if counts[s][t] and p(s, t) > p(None, t)]
            for found in (sorted(far), sorted(more)[:top]):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item, part) in enumerate(found)]
    return sorted(out)


def given(spark, rows, more=False):
    table = pa.table({n: pa.array([r[i] for r in rows], pa.string()) for i, n in enumerate(("text", "lang", "source"))})
    made = spark.createDataFrame(table)
    return made.selectExpr("*", "1 AS term", "'x' AS n", "0 AS _row") if more else made


def found(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_odd_rows(spark):
    words = ["Ab", "cd", "ÄB", "äb", "kK", "x1y", "𝒳z", "e", "f"]
    rng = random.Random(3)
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", None]), rng.choice("abc")) for _ in range(90)]
    rows += [(None, "en", "a"), ("", "fr", "a"), ("only here", "fr", None), ("lone", "it", "a"), ("", "", "b")]
    rows += [("cd, CD; cd\n" * 5000 + "ab", "en", "hot")] + [("ab cd", "de", "copies")] * 40
    assert found(source_divergence(given(spark, rows, more=True))) == plain(rows)


def test_ranks_are_cut_inside_equal_values(spark):
    """Terms of one cell come in the order of their bytes; the cut falls within a cell."""
    many = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    rows = [(many, "en", "a")] * 3 + [("other words here", "en", "b")] * 4 + [("wzz Üb", "en", "a")] * 3
    made = found(source_divergence(given(spark, rows)))
    assert made == plain(rows)
    assert len([r for r in made if r[1:3] == ("a", "term")]) == 200
    assert found(source_divergence(given(spark, rows), min_docs=4, top=2)) == plain(rows, 4, 2)


def test_empty_and_single(spark):
    assert found(source_divergence(given(spark, []))) == []
    assert found(source_divergence(given(spark, [("a b c", "en", "x")]))) == []


def test_query(spark):
    got = QUERIES["op11_source_divergence"](spark, SF).toPandas()
    assert difference(got, connect(SF).sql(DIVERGENCE_SQL).df()) is None
