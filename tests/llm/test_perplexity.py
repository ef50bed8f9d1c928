from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from refload.llm import perplexity as op
from tests.llm.conftest import SF

WORD = r"[^\x20\x09-\x0D]+"


def plain_counts(text):
    words = re.findall(WORD, text or "")
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    covered = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered)


class PlainModel:
    """Interpolated modified Kneser-Ney by dictionaries; n-grams are byte strings, contexts never leave the word."""

    def __init__(self, texts, order):
        self.order = order
        self.a = [defaultdict(int) for _ in range(order + 1)]
        for text in texts:
            for word in re.findall(WORD, text or ""):
                line = b" " + word.encode() + b" "
                for q in range(1, len(line)):
                    gram = line[max(0, q - order + 1) : q + 1]
                    self.a[len(gram)][gram] += 1
        for n in range(order - 1, 0, -1):
            below = Counter(g[1:] for g in self.a[n + 1])
            for g, c in below.items():
                if n == 1 or g[0] != 32:
                    self.a[n][g] = c
        self.cut, self.total, self.hand = {}, defaultdict(int), defaultdict(float)
        for n in range(1, order + 1):
            n1, n2, n3, n4 = (sum(v == i for v in self.a[n].values()) for i in (1, 2, 3, 4))
            y = n1 / max(n1 + 2 * n2, 1)
            d = [1 - 2 * y * n2 / max(n1, 1), 2 - 3 * y * n3 / max(n2, 1), 3 - 4 * y * n4 / max(n3, 1)]
            self.cut[n] = [min(max(x, 0.05), i) for i, x in enumerate(d, 1)]
            for g, c in self.a[n].items():
                self.total[n, g[:-1]] += c
                self.hand[n, g[:-1]] += self.cut[n][min(c, 3) - 1]

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / 257
        if not self.total[n, gram[:-1]]:
            return self.p(gram[1:])
        c, total = self.a[n].get(gram, 0), self.total[n, gram[:-1]]
        own = max(c - self.cut[n][min(c, 3) - 1], 0) if c else 0
        return own / total + self.hand[n, gram[:-1]] / total * self.p(gram[1:])

    def logp(self, text):
        total, symbols = 0.0, 0
        for word in re.findall(WORD, text or ""):
            line = b" " + word.encode() + b" "
            for q in range(1, len(line)):
                total += math.log(self.p(line[max(0, q - self.order + 1) : q + 1]))
                symbols += 1
        return total, symbols


def test_query_against_brute_force(spark):
    from refload.llm.queries import QUERIES

    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in QUERIES["op5_ngram_perplexity"](spark, SF).collect()}
    assert len(got) == len(rows)
    losses = defaultdict(list)
    for lang in ("de", "es"):
        mine = [r for r in rows if r["lang"] == lang]
        model = PlainModel([r["text"] for r in mine], op.ORDER)
        for r in mine:
            total, symbols = model.logp(r["text"])
            assert math.isclose(got[r["doc_id"]].perplexity, math.exp(-total / symbols), rel_tol=1e-9)
    for r in rows:
        g, want = got[r["doc_id"]], plain_counts(r["text"])
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert g.kept == (not g.base_failed and g.lower <= g.perplexity <= g.upper)
        if want[0] >= 20:
            losses[r["lang"]].append(math.log(g.perplexity))
    for r in rows:
        if (n := got[r["doc_id"]].n_words) >= 20:
            own = sorted(losses[r["lang"]])
            q1, q2, q3 = (own[max(0, math.ceil(len(own) * p) - 1)] for p in (0.25, 0.5, 0.75))
            dev = math.sqrt(max((q3 - q1) / 1.349, op.FLOOR) ** 2 + op.SHORT**2 / n)
            assert math.isclose(math.log(got[r["doc_id"]].upper), q2 + op.WIDTH * dev, rel_tol=1e-6)


def test_good_documents_stay_and_junk_goes(spark):
    from refload.llm.queries import QUERIES

    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    got = [r for r in QUERIES["op5_ngram_perplexity"](spark, SF).collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in got if labels[r.doc_id] == 1]
    junk = [r.kept for r in got if labels[r.doc_id] == 0]
    assert np.mean(good) > 0.98 and np.mean(junk) < 0.9


def test_unseen_texts_both_ways(spark, documents):
    corpus = documents([(i, t) for i, t in enumerate(["the cat sat", "a cat and the hat", "über alles", "that that thatch"] * 2)])
    model = op.fit_model(corpus, order=4)
    plain = PlainModel([r.text for r in corpus.collect()], 4)
    texts = ["the cat", "zzz qqq", "über catch that", "", None, "hat " * 50, "ÿÿÿ the"]
    docs = documents(list(enumerate(texts))).withColumnRenamed("doc_id", "id")
    for most in (0, 10**6):
        got = op.score_rows(docs, model, "lang", "text", 4, most).collect()
        assert len(got) == len(texts)
        for r in got:
            total, symbols = plain.logp(texts[r.id])
            assert r.symbols == symbols and math.isclose(r.logp, total, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("most", [0, 10**6])
def test_keep_good_agrees_with_the_report(spark, most):
    docs = spark.read.parquet(SF.replace("0.01", "0.001") + "/documents.parquet").selectExpr("*", "1 AS kept", "2 AS id", "'x' AS key")
    want = sorted(r.doc_id for r in op.quality_rules(docs).filter("kept").collect())
    got = op.keep_good(docs, most=most)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want


def test_odd_rows(spark, documents):
    rows = [(1, None), (1, ""), (None, "one two"), (2, "x" * 300_000), (3, "\n\n \t"), (4, "a b c d e f g h " * 4000), (5, "\x00 é")]
    docs = documents(rows)
    got = op.quality_rules(docs).collect()
    assert sorted(map(str, (r.n_words for r in got))) == sorted(str(plain_counts(t)[0]) for _, t in rows)
    assert all(r.base_failed and not r.kept for r in got)
    assert op.keep_good(docs).collect() == []
    nulls = spark.createDataFrame(pa.table({"doc_id": [1], "text": ["some words " * 3], "lang": pa.array([None], pa.string())}))
    assert op.quality_rules(nulls).count() == 1
    assert op.quality_rules(documents([])).collect() == [] and op.keep_good(documents([])).collect() == []


def test_repeats_are_exact():
    rng = np.random.default_rng(0)
    for _ in range(100):
        ids = rng.integers(0, 2, rng.integers(0, 60))
        assert op.repeated_words(ids) == plain_counts(" ".join(map(str, ids)))[4]
