from __future__ import annotations

from collections import defaultdict

import pyarrow as pa

from refload.llm import chat as op
from tests.llm.conftest import SF
from tests.oracle import connect, difference


def frame(spark, rows):
    names = ("conv_id", "turn", "role", "text")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}))


def rendered(rows):
    made = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.seq):
        made[r.conv_id, r.perspective].append(r)
    for k, parts in made.items():
        whole = "".join(r.segment for r in parts)
        assert all(whole[r.char_from : r.char_to] == r.segment for r in parts)
        yield k, whole, [whole[r.mask_from : r.mask_to] for r in parts if r.mask_from is not None]


def test_query_against_sql(spark):
    from refload.llm.queries import ORACLE_SQL, QUERIES

    got = QUERIES["op9_perspectives"](spark, SF).toPandas()
    assert difference(got, connect(SF).sql(ORACLE_SQL["op9_perspectives"]).df()) is None


def test_every_speaker_in_turn(spark):
    rows = [(1, 0, "system", "Be <|kind|>."), (1, 1, "ann", "Hé"), (1, 2, "bob", "Yo"), (1, 3, "ann", None), (1, 4, None, "psst")]
    made = {k: (whole, masks) for k, whole, masks in rendered(op.perspectives(frame(spark, rows)).collect())}
    assert set(made) == {(1, "ann"), (1, "bob")}
    whole, masks = made[1, "ann"]
    assert whole == (
        "<|im_start|>system\nBe < |kind|>.<|im_end|>\n<|im_start|>assistant\nHé<|im_end|>\n<|im_start|>user name=bob\nYo<|im_end|>\n"
        "<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=unknown\npsst<|im_end|>\n"
    )
    assert masks == ["Hé<|im_end|>", "<|im_end|>"]
    assert made[1, "bob"][1] == ["Yo<|im_end|>"]


def test_odd_rows(spark):
    rows = [(None, 1, "a", "x"), (None, None, "b", "y"), (2, 1, "system", "only"), (3, 1, None, "z"), (4, 1, "a", "t"), (4, 1, "a", "t")]
    rows += [(5, i, "ab"[i % 2], "w " * 20_000) for i in range(3)]
    made = {k: masks for k, _, masks in rendered(op.perspectives(frame(spark, rows)).collect())}
    assert set(made) == {(None, "a"), (None, "b"), (4, "a"), (5, "a"), (5, "b")}
    assert made[4, "a"] == ["t<|im_end|>"] * 2
    clash = frame(spark, rows).selectExpr("*", "1 AS conv", "2 AS speaker", "3 AS rank", "4 AS perspective")
    assert op.perspectives(clash).count() == 2 + 2 + 2 + 6
    assert op.perspectives(frame(spark, [])).collect() == []
