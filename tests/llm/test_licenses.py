from __future__ import annotations

import re

import pyarrow as pa

from refload.llm.licenses import BASE, BIN, LICENSES, WORD, License, licenses_sql, scan_licenses
from refload.llm.queries import QUERIES
from tests.llm.conftest import SF
from tests.oracle import connect, rows_of

MIT = LICENSES[1].text
COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def plain(texts, licenses=LICENSES, rare=5, agree=0.6):
    """Every place of every text tried as the beginning of every license."""
    docs = [re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    df = {w: sum(w in set(d) for d in docs) for x in licenses for w in x.words()}
    out = []
    for own in docs:
        stands = lambda p, at: own[at : at + len(p.split())] == p.split()  # noqa: B023, E731
        base = [(i, label) for i in range(len(own)) for p, label in BASE if stands(p, i)]
        labels, score = {label for _, label in base}, 0.5 if base else 0.0
        for x in licenses:
            words = x.words()
            index = set(sorted(set(words), key=lambda w: (df[w], w.encode()))[:rare])
            begins = [(i - at, w) for i, o in enumerate(own) for at, w in enumerate(words) if o == w and w in index]
            phrases = [(i - at, p) for p, at in x.phrase_places() for i in range(len(own)) if stands(p, i)]
            for shift in (0, BIN // 2):
                for part in {(s + shift) // BIN for s, _ in begins}:
                    met = {w for s, w in begins if (s + shift) // BIN == part}
                    told = {p for s, p in phrases if (s + shift) // BIN == part}
                    if told == set(x.phrases) and len(met) >= agree * len(index):
                        labels.add(x.label)
                        score = max(score, len(met) / len(index))
        at = [i for i, _ in base]
        told = ",".join(sorted({label for _, label in base}))
        out.append((len(own), len(base), min(at, default=None), max(at, default=None), told, ",".join(sorted(labels)), score))
    return out


def given(spark, texts):
    return spark.createDataFrame(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}))


def found(df, **options):
    rows = scan_licenses(df, **options).select(COLUMNS).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r.doc_id)]


TEXTS = [
    MIT, f"Intro words here.\n{MIT} and more", MIT.upper(), " ".join(MIT.split()[:12]), MIT.replace("software", "program"), "Released under the MIT License.",
    "the MIT license, the mit-License; Apache license and GENERAL public\nlicense", "mitlicense mit licenses submit license", None, "", "... !!", "mit", "license",
    "This work is licensed under the GNU General Public License, version 3.", "licensed under the GNU General Public License (GPL) version 3",
    "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.", "cc by 4 0", "4 0 by cc under licensed",
    "x " * 40000 + "Licensed under the Apache License, Version 2.0" + " y" * 40000 + " Apache License, version 2.0", "Lİcensed under the Apache Lİcense é MIT License",
    *[x.text for x in LICENSES], LICENSES[3].text.replace("Redistributions of", "Clause 1: Redistributions of"), MIT + " " + LICENSES[2].text,
]


def test_odd_texts(spark):
    assert found(given(spark, TEXTS).selectExpr("*", "0 AS row", "'x' AS words", "1 AS at")) == plain(TEXTS)


def test_each_license_is_known(spark):
    for x, row in zip(LICENSES, found(given(spark, [x.text for x in LICENSES])), strict=True):
        assert x.label in row[5].split(",") and row[6] == 1.0


def test_places_and_other_licenses(spark):
    own = License("acme", "Acme frobnication grant: anyone may frobnicate widgets", ("anyone may frobnicate",))
    text = f"one two {own.text} {'pad ' * 30}{own.text} three Acme grant"
    row = scan_licenses(given(spark, [text]), licenses=(own,), rare=3, agree=1.0).first()
    assert [(p.label, p.start, p.share) for p in row.places] == [("acme", 2, 1.0), ("acme", 39, 1.0)]
    assert found(given(spark, [text]), licenses=(own,), rare=3, agree=1.0) == plain([text], (own,), 3, 1.0)


def test_repeated_rows_and_empty(spark):
    rows = [(1, MIT), (1, MIT), (None, "MIT License"), (None, "MIT License")]
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows])})
    assert sorted(r.labels for r in scan_licenses(spark.createDataFrame(table)).collect()) == ["mit"] * 4
    assert scan_licenses(given(spark, [])).collect() == []


def test_query_against_sql(spark):
    got = QUERIES["op13_license_scan"](spark, SF).toPandas()
    told = connect(SF).sql(licenses_sql()).df()
    assert list(got.columns) == COLUMNS and rows_of(got) == rows_of(told)
    assert {"apache,apache-2.0", "cc-by-nc-4.0", "gpl,gpl-3.0", "mit"} <= set(got["labels"])


def test_no_python_in_the_plan(spark):
    plan = scan_licenses(given(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
