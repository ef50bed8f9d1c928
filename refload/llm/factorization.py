"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j). The pairs are never listed: for each of the RANK
dimensions their sum is half of (sum v_i x_i)^2 - sum v_i^2 x_i^2, so a text costs as much as it has features.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refload.llm.common import ROWS, map_batches, utf8
from refload.session import materialize

#: Buckets that words are hashed into.
WORDS = 4096
RANK = 4
#: Labelled rows that the machine is fitted on, at most: those of the smallest hashes.
SAMPLE = 4096
EPOCHS = 30
#: Steps of a statistic: each is one feature, so that the machine may bend.
STEPS = 12
#: A statistic's range, cut into even steps after the map named; beyond it the end steps hold.
STATS = {
    "words": ("log", 0, 10), "chars": ("log", 0, 13), "stored_chars": ("log", 0, 13), "word_length": ("lin", 0, 15),
    "longest": ("log", 0, 8), "upper": ("root", 0, 1), "digits": ("root", 0, 1), "symbols": ("root", 0, 1),
    "bangs": ("root", 0, 1), "bars": ("root", 0, 1), "stops": ("root", 0, 1), "white": ("root", 0, 1),
    "wide": ("root", 0, 1), "lines": ("root", 0, 1), "dup_lines": ("root", 0, 1), "distinct": ("lin", 0, 1),
    "top_word": ("root", 0, 1), "edge": ("root", 0, 1),
}
FEATURES = WORDS + len(STATS) * STEPS
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
WHITE = b" \t\n\x0b\x0c\r"


def _share(text: bytes, chars: bytes) -> float:
    return (len(text) - len(text.translate(None, chars))) / len(text)


def statistics(text: bytes, words: list[bytes], counted: Counter, stored: int | None) -> list[float]:
    """The values of STATS; of an empty text all are 0 but the stored length."""
    kept = float(stored if stored is not None and stored >= 0 else 0)
    if not words:
        return [0.0, float(len(text)), kept] + [0.0] * (len(STATS) - 3)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    edge = sum(not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in b".,;:?") for w in words)
    letters = sum(map(len, words))
    return [
        float(len(words)), float(len(text)), kept, letters / len(words), float(max(map(len, counted))),
        _share(text, UPPER), _share(text, DIGITS), _share(text, b"#*$%&<>^~=+@_\\{}"), _share(text, b"!?"), _share(text, b"|"),
        _share(text, b".,;:"), _share(text, WHITE), 1 - _share(text, bytes(range(128))), len(lines) / len(words),
        1 - len(set(lines)) / len(lines), len(counted) / len(words), max(counted.values()) / len(words), edge / len(words),
    ]


def features(text: bytes, stored: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of a text's features: words by root of their count at length one, and a step a statistic."""
    words = text.split()
    counted = Counter(words)
    at = np.fromiter((zlib.crc32(w) % WORDS for w in counted), np.int64, len(counted))
    own, where = np.unique(at, return_inverse=True)
    value = np.sqrt(np.bincount(where, weights=np.fromiter(counted.values(), float, len(counted)), minlength=len(own)))
    value /= max(np.sqrt((value * value).sum()), 1e-12)
    steps = np.empty(len(STATS), np.int64)
    for k, (x, (kind, low, high)) in enumerate(zip(statistics(text, words, counted, stored), STATS.values(), strict=True)):
        x = np.log1p(x) if kind == "log" else np.sqrt(x) if kind == "root" else x
        steps[k] = WORDS + k * STEPS + int(min(max((x - low) / (high - low) * STEPS, 0), STEPS - 1))
    return np.concatenate((own, steps)), np.concatenate((value, np.full(len(steps), 0.5)))


class Machine:
    """Weights of a fitted machine."""

    def __init__(self, bias: float = 0.0, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.bias, self.w, self.v = bias, np.zeros(FEATURES), rng.normal(scale=0.02, size=(FEATURES, RANK))

    def parts(self) -> tuple[float, np.ndarray, np.ndarray]:
        """What is sent to tasks: numbers and arrays, which they can read without this package."""
        return self.bias, self.w, self.v

    @classmethod
    def of(cls, parts: tuple[float, np.ndarray, np.ndarray]) -> Machine:
        made = cls.__new__(cls)
        made.bias, made.w, made.v = parts
        return made

    def raw(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of texts laid end to end (their first features at ``starts``), and sums by dimension."""
        scaled = self.v[at] * x[:, None]
        sums = np.add.reduceat(scaled, starts)
        pairs = 0.5 * (sums * sums - np.add.reduceat(scaled * scaled, starts)).sum(axis=1)
        return self.bias + np.add.reduceat(self.w[at] * x, starts) + pairs, sums

    def score(self, texts: list[bytes], stored: list[int | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        made = [features(t, s) for t, s in zip(texts, stored, strict=True)]
        starts = np.concatenate(([0], np.cumsum([len(m[0]) for m in made])[:-1]))
        raw, _ = self.raw(np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]), starts)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Machine:
    """Log loss by Adam over shuffled batches, with weight decay; the same rows give the same machine."""
    rate = (labels.sum() + 1) / (len(labels) + 2)
    machine = Machine(float(np.log(rate / (1 - rate))), seed)
    if len(labels) == 0 or labels.min() == labels.max():
        machine.v[:] = 0
        return machine
    rng = np.random.default_rng(seed)
    moments = [np.zeros_like(a) for a in (machine.w, machine.w, machine.v, machine.v)]
    batch = int(np.clip(len(rows) // 16, 16, 256))
    step, pull, keep = 0, 0.02, 2e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), batch):
            part = order[lo : lo + batch]
            at, x = (np.concatenate([rows[i][k] for i in part]) for k in (0, 1))
            sizes = np.array([len(rows[i][0]) for i in part])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            raw, sums = machine.raw(at, x, starts)
            slope = np.repeat((1 / (1 + np.exp(-raw)) - labels[part]) / len(part), sizes)
            toward_w = np.bincount(at, weights=slope * x, minlength=FEATURES) + keep * machine.w / len(part)
            own = (slope * x)[:, None] * (np.repeat(sums, sizes, axis=0) - machine.v[at] * x[:, None])
            toward_v = np.stack([np.bincount(at, weights=own[:, k], minlength=FEATURES) for k in range(RANK)], axis=1)
            toward_v += keep * machine.v / len(part)
            step += 1
            for value, toward, first, second in ((machine.w, toward_w, *moments[:2]), (machine.v, toward_v, *moments[2:])):
                first += 0.1 * (toward - first)
                second += 0.001 * (toward * toward - second)
                value -= pull * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            machine.bias -= pull * float(slope[starts].sum())
    return machine


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, remainder 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", chars_column: str = "n_chars",
    label_column: str = "quality", sample: int = SAMPLE,
) -> Machine:
    """A machine from the labelled rows that are not held out, at most ``sample`` of them (a bound, not a share).

    Labels other than 0 and 1, and rows with a null id, teach nothing. The sampled ids are sent to the scan; the
    features of the sampled rows, and nothing else, come to the driver.
    """
    named = labels.select(F.col(id_column).alias("_id"), F.col(label_column).alias("_label"))
    named = named.filter(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
    named = materialize(named.orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample), "fm-labels")
    rows = docs.select(F.col(id_column).alias("_id"), utf8(text_column).alias("text"), F.col(chars_column).cast("long").alias("chars"))
    rows = rows.join(F.broadcast(named), "_id")  # at most ``sample`` rows

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [features(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("chars").to_pylist(), strict=True)]
        lists = [pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), *lists], names=["key", "label", "at", "x"])

    keyed = rows.select(F.xxhash64("_id", "text").alias("key"), F.col("_label").cast("int").alias("label"), "text", "chars")
    # A sampled id may stand in several rows; the first ``sample`` by hash are taken.
    found = map_batches(keyed, run, "key long, label int, at array<long>, x array<double>").orderBy("key", "label").limit(sample)
    got = found.toArrow()
    pairs = [
        (np.array(a, np.int64), np.array(x, float))
        for a, x in zip(got.column("at").to_pylist(), got.column("x").to_pylist(), strict=True)
    ]
    return fit_machine(pairs, np.array(got.column("label").to_pylist(), float))


def score_quality(
    docs: DataFrame, machine: Machine, id_column: str = "doc_id", text_column: str = "text", chars_column: str = "n_chars"
) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    The score hangs on the text and its stored length alone. Null and empty texts are scored by their statistics;
    null lengths count as 0; ids may be null (never held out) or repeated. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine.parts())  # of fixed size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = Machine.of(sent.value).score(batch.column("text").to_pylist(), batch.column("chars").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("out"), pa.array(scores)], names=["id", "out", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(
        F.col(id_column).alias("id"), held_out(id_column).alias("out"), utf8(text_column).alias("text"),
        F.col(chars_column).cast("long").alias("chars"),
    )
    scored = map_batches(rows, run, f"id {kind}, out boolean, score double")
    return scored.select(
        F.col("id").alias(id_column), F.col("out").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_predicted(docs: DataFrame, machine: Machine, text_column: str = "text", chars_column: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` whose score is at least one half, judged where they are read."""
    sent = docs.sparkSession.sparkContext.broadcast(machine.parts())

    @F.pandas_udf("boolean")
    def good(text: pd.Series, chars: pd.Series) -> pd.Series:
        texts = [(t or "").encode() for t in text]
        lengths = [None if pd.isna(c) else int(c) for c in chars]
        made = [Machine.of(sent.value).score(texts[i : i + ROWS], lengths[i : i + ROWS]) >= 0.5 for i in range(0, len(texts), ROWS)]
        return pd.Series(np.concatenate(made) if made else [], dtype=bool)

    return docs.filter(good(F.col(text_column), F.col(chars_column).cast("long")))
