"""Quality rules, and the perplexity of an n-gram model counted over the whole corpus.

The model: a word is its UTF-8 bytes with a space in front and behind, and the symbols of an n-gram are bytes, up to
``ORDER`` of them, never reaching over the start of a word. An n-gram of up to seven bytes fits a 64-bit key (its
length in the top byte), so keys are hashes without collisions. Estimates are interpolated modified Kneser-Ney, one
model for each language. Spark counts n-grams (each batch counts its distinct words first), derives the lower orders
from the distinct n-grams above them, and joins the probabilities upward; every text is counted.

Scoring looks n-grams up in arrays sorted by key, sent to the tasks where the model has at most ``MODEL_ROWS`` rows.
A larger one stays a table and the texts' n-grams are joined with it. Both give the same scores.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refload.llm.common import ROWS, map_batches, store, utf8
from refload.session import materialize

ORDER = 5
#: Probability of a byte that no model has seen: one of 256 or the end of the word.
UNSEEN = 1 / 257
#: A model of more rows than this (about 100 MB in a task) is not sent to the tasks.
MODEL_ROWS = 4_000_000
#: Band: so many deviations to either side of the language's median.
WIDTH = 5.0
#: Deviation of the mean log-probability of a text: at least FLOOR, and per square root of its words SHORT.
FLOOR, SHORT = 0.01, 0.2
WINDOW = 8
LOW = (1 << 56) - 1
WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a run of ``window`` words found at least twice."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    at = np.flatnonzero(mixed[order[1:]] == mixed[order[:-1]])
    if not len(at):
        return 0
    first, second = order[at], order[at + 1]
    same = np.ones(len(at), bool)
    for k in range(window):
        same &= ids[first + k] == ids[second + k]
    steps = np.zeros(len(ids) + 1, np.int64)
    starts = np.unique(np.concatenate((first[same], second[same])))
    steps[starts] += 1
    steps[starts + window] -= 1
    return int((np.cumsum(steps) > 0).sum())


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, WHITE)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(ids)


def grams(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest n-gram of every symbol of the words, and the number of its word."""
    line = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    space = line == 32
    places = np.arange(len(line))
    last = np.maximum.accumulate(np.where(space, places, 0))[:-1]
    length = np.minimum(order, places[1:] - last + 1)
    wide = line.astype(np.uint64)
    keys = length.astype(np.uint64) << np.uint64(56)
    for k in range(order):
        back = wide[1:] if k == 0 else np.concatenate((np.zeros(k - 1, np.uint64), wide[: len(wide) - k]))
        keys |= np.where(k < length, back << np.uint64(8 * k), np.uint64(0))
    return keys, np.cumsum(space)[:-1] - 1


def gram_counts(docs: DataFrame, lang: str, text: str, order: int) -> DataFrame:
    """(lang, key, n): how often each longest n-gram occurs. Null languages count as the empty one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[str, Counter] = {}
        for tag, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found.setdefault(tag, Counter()).update(body.split())
        tags, keys, counts = [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for tag, counted in found.items():
            if counted:
                grown, word = grams(list(counted), order)
                own, at = np.unique(grown, return_inverse=True)
                times = np.fromiter(counted.values(), np.int64, len(counted))
                tags += [tag] * len(own)
                keys.append(own)
                counts.append(np.bincount(at, weights=times[word]).astype(np.int64))
        key = pa.array(np.concatenate(keys).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(tags, pa.string()), key, pa.array(np.concatenate(counts))], names=["lang", "key", "n"])

    rows = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), utf8(text).alias("text"))
    return map_batches(rows, run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _size(key: str = "key") -> Column:
    return F.shiftright(key, 56)


def _suffix(key: Column, n: Column) -> Column:
    """The last ``n`` symbols of an n-gram."""
    low = key.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (n * 8).cast("int")) - 1)
    return low.bitwiseOR(F.call_function("shiftleft", n.cast("long"), F.lit(56)))


def fit_model(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER) -> DataFrame:
    """(lang, key, logp, back), stored: an n-gram's log-probability, and the log of what it hands down as a context.

    ``back`` is null where the n-gram is no context. Only contexts and n-grams of the corpus have rows.
    """
    events = gram_counts(docs, lang, text, order)
    shorter = F.transform(F.sequence(F.lit(1), _size().cast("int")), lambda n: _suffix(F.col("key"), n))
    spread = events.select("lang", F.col("key").alias("whole"), "n", F.explode(shorter).alias("key"))
    raw = F.sum(F.when(F.col("key") == F.col("whole"), F.col("n")).otherwise(0))
    seen = store(spread.groupBy("lang", "key").agg(raw.alias("raw")), "ngrams")
    # Counts: an n-gram's own where nothing can stand in front of it, else how many symbols do.
    longer = seen.filter(_size() > 1).select("lang", _suffix(F.col("key"), _size() - 1).alias("key"))
    fronts = longer.groupBy("lang", "key").agg(F.count("*").alias("fronts"))
    count = F.when(F.col("raw") > 0, F.col("raw")).otherwise(F.col("fronts"))
    counted = seen.join(fronts, ["lang", "key"], "left").select("lang", "key", count.alias("a"))
    counted = store(counted.withColumn("size", _size().cast("int")), "ngram-counts")
    tally = [F.sum((F.col("a") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    cuts = []
    for i in (1, 2, 3):
        d = F.lit(float(i)) - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.col(f"n{i}"), F.lit(1.0))
        cuts.append(F.least(F.greatest(d, F.lit(0.05)), F.lit(float(i))).alias(f"d{i}"))
    discounts = counted.groupBy("lang", "size").agg(*tally).select("lang", "size", *cuts)
    cut = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
    front = F.shiftright(F.col("key").bitwiseAND(F.lit(LOW)), 8).bitwiseOR((_size() - 1) * F.lit(1 << 56))
    rows = counted.join(discounts, ["lang", "size"]).select("lang", "key", "size", "a", cut.alias("cut"), front.alias("context"))
    same = Window.partitionBy("lang", "context")  # at most one row for each byte
    total = F.sum("a").over(same)
    rows = rows.withColumn("own", (F.col("a") - F.col("cut")) / total).withColumn("hand", F.sum("cut").over(same) / total)
    rows = store(rows.select("lang", "key", "size", "context", "own", "hand"), "ngram-shares")
    # An n-gram's probability adds up over its suffixes: each one's own share, and what it hands down.
    suffixes = F.transform(F.sequence(F.lit(1), F.col("size")), lambda n: _suffix(F.col("key"), n))
    chain = rows.select("lang", F.col("key").alias("whole"), F.explode(suffixes).alias("key"))
    parts = F.sort_array(F.collect_list(F.struct("size", "own", "hand")))
    p = F.aggregate(parts, F.lit(UNSEEN), lambda p, part: part["own"] + part["hand"] * p)
    known = chain.join(rows, ["lang", "key"]).groupBy("lang", "whole").agg(F.log(p).alias("logp"))
    handed = rows.groupBy("lang", "context").agg(F.log(F.first("hand")).alias("back"))
    both = known.withColumnRenamed("whole", "key").join(handed.withColumnRenamed("context", "key"), ["lang", "key"], "full_outer")
    return store(both.select("lang", "key", "logp", "back"), "ngram-model")


class SortedModel:
    """One language's model as arrays sorted by key."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray, back: np.ndarray) -> None:
        self.keys, self.logp, self.back = keys, logp, back

    def score(self, keys: np.ndarray) -> np.ndarray:
        """Log-probability of each n-gram, falling back to shorter ones where it was never seen."""
        total = np.zeros(len(keys))
        rest = np.arange(len(keys))
        keys = keys.copy()
        while len(rest):
            found, at = self._find(keys[rest])
            good = found & ~np.isnan(self.logp[at])
            total[rest[good]] += self.logp[at[good]]
            rest = rest[~good]
            size, body = keys[rest] >> np.uint64(56), keys[rest] & np.uint64(LOW)
            shorter = size - np.uint64(1)
            has, at = self._find((body >> np.uint64(8)) | (shorter << np.uint64(56)))
            total[rest] += np.where(has, self.back[at], 0.0)
            keys[rest] = (body & ((np.uint64(1) << (np.uint64(8) * shorter)) - np.uint64(1))) | (shorter << np.uint64(56))
            total[rest[shorter == 0]] += np.log(UNSEEN)
            rest = rest[shorter > 0]
        return total

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at


def sorted_arrays(model: DataFrame) -> dict[str, tuple[np.ndarray, ...]]:
    """The model of each language as arrays: what is sent to tasks, which need no code of this package to read it."""
    rows = model.toArrow()
    tags = rows.column("lang").combine_chunks().dictionary_encode()
    number = tags.indices.to_numpy()
    keys = rows.column("key").to_numpy().astype(np.uint64)
    logp, back = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("logp", "back"))
    back = np.nan_to_num(back)
    order = np.lexsort((keys, number))
    ends = np.searchsorted(number[order], np.arange(len(tags.dictionary) + 1))
    parts = [order[ends[i] : ends[i + 1]] for i in range(len(tags.dictionary))]
    return {t: (keys[o], logp[o], back[o]) for t, o in zip(tags.dictionary.to_pylist(), parts, strict=True)}


def score_texts(
    models: dict[str, tuple[np.ndarray, ...]], langs: list[str], split: list[list[bytes]], order: int
) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log-probabilities, and number of symbols, of each text. Distinct words are scored once a batch."""
    total, symbols = np.zeros(len(split)), np.zeros(len(split), np.int64)
    places: dict[str, list[int]] = {}
    for i, tag in enumerate(langs):
        places.setdefault(tag, []).append(i)
    for tag, rows in places.items():
        model = SortedModel(*models[tag]) if tag in models else None
        words: dict[bytes, int] = {}
        ids = [np.fromiter((words.setdefault(w, len(words)) for w in split[i]), np.int64, len(split[i])) for i in rows]
        if not words:
            continue
        keys, word = grams(list(words), order)
        own, at = np.unique(keys, return_inverse=True)
        scored = model.score(own) if model is not None else np.full(len(own), np.log(UNSEEN))
        sums, sizes = np.bincount(word, weights=scored[at]), np.bincount(word)
        for i, numbers in zip(rows, ids, strict=True):
            total[i], symbols[i] = sums[numbers].sum(), sizes[numbers].sum()
    return total, symbols


FACTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _facts(texts: list[bytes]) -> tuple[list[list[bytes]], list[pa.Array]]:
    split = [t.split() for t in texts]
    counts = [base_counts(t, w) for t, w in zip(texts, split, strict=True)]
    return split, [pa.array([c[k] for c in counts], pa.int64()) for k in range(5)]


def score_rows(docs: DataFrame, model: DataFrame, lang: str, text: str, order: int, most: int = MODEL_ROWS) -> DataFrame:
    """(id, lang, base counts, logp, symbols) of every row of ``docs``, whose id column is ``id``."""
    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.select("id", F.coalesce(F.col(lang), F.lit("")).alias("lang"), utf8(text).alias("text"))
    if model.count() <= most:
        sent = docs.sparkSession.sparkContext.broadcast(sorted_arrays(model))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            split, facts = _facts(batch.column("text").to_pylist())
            total, symbols = score_texts(sent.value, batch.column("lang").to_pylist(), split, order)
            names = ["id", "lang", *(f.split()[0] for f in FACTS.split(", ")), "logp", "symbols"]
            return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), *facts, pa.array(total), pa.array(symbols)], names=names)

        return map_batches(rows, run, f"id {kind}, lang string, {FACTS}, logp double, symbols long")

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        split, facts = _facts(batch.column("text").to_pylist())
        keys, times = [], []
        for words in split:
            own, n = np.unique(grams(words, order)[0], return_counts=True) if words else (np.empty(0, np.uint64), np.empty(0, int))
            keys.append(own.astype(np.int64).tolist())
            times.append(n.tolist())
        lists = [pa.array(v, pa.list_(pa.int64())) for v in (keys, times)]
        names = ["id", "lang", *(f.split()[0] for f in FACTS.split(", ")), "keys", "times"]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), *facts, *lists], names=names)

    made = map_batches(rows, spread, f"id {kind}, lang string, {FACTS}, keys array<long>, times array<long>")
    made = materialize(made.withColumn("row", F.monotonically_increasing_id()), "ngram-rows")
    todo = made.select("row", "lang", F.explode(F.arrays_zip("keys", "times")).alias("z"))
    todo = todo.select("row", "lang", F.col("z.keys").alias("key"), F.col("z.times").alias("times"), F.lit(0.0).alias("so_far"))
    parts = None
    for n in range(order, 0, -1):
        known = model.filter("logp IS NOT NULL").select("lang", "key", "logp")
        looked = todo.join(known, ["lang", "key"], "left")
        sums = looked.filter("logp IS NOT NULL").groupBy("row").agg(F.sum((F.col("logp") + F.col("so_far")) * F.col("times")).alias("logp"))
        parts = sums if parts is None else parts.union(sums)
        missed = materialize(looked.filter("logp IS NULL").drop("logp"), "ngram-missed")
        body, shorter = F.col("key").bitwiseAND(F.lit(LOW)), _size() - 1
        missed = missed.withColumn("context", F.shiftright(body, 8).bitwiseOR(shorter * F.lit(1 << 56)))
        handed = model.filter("back IS NOT NULL").select("lang", F.col("key").alias("context"), "back")
        missed = missed.join(handed, ["lang", "context"], "left")
        mask = F.expr("shiftleft(1L, cast(8 * (shiftright(key, 56) - 1) as int)) - 1")
        todo = missed.select(
            "row", "lang", body.bitwiseAND(mask).bitwiseOR(shorter * F.lit(1 << 56)).alias("key"), "times",
            (F.col("so_far") + F.coalesce("back", F.lit(0.0))).alias("so_far"),
        )
        ended = todo.filter(_size() == 0).groupBy("row").agg(F.sum((F.col("so_far") + float(np.log(UNSEEN))) * F.col("times")).alias("logp"))
        parts, todo = parts.union(ended), todo.filter(_size() > 0)
    sums = materialize(parts.groupBy("row").agg(F.sum("logp").alias("logp")), "ngram-sums")
    symbols = F.aggregate("times", F.lit(0).cast("long"), lambda a, b: a + b)
    told = made.select("row", "id", "lang", *(f.split()[0] for f in FACTS.split(", ")), symbols.alias("symbols"))
    return told.join(sums, "row", "left").drop("row").withColumn("logp", F.coalesce("logp", F.lit(0.0)))


def bands(scored: DataFrame) -> DataFrame:
    """(lang, middle, spread): median and robust deviation of the mean log-loss of the language's texts."""
    loss = -F.col("logp") / F.col("symbols")
    cuts = F.percentile_approx(loss, [0.25, 0.5, 0.75], 10_000)
    found = scored.filter("n_words >= 20").groupBy("lang").agg(cuts.alias("q"))
    spread = F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(FLOOR))
    return store(found.select("lang", F.col("q")[1].alias("middle"), spread.alias("spread")), "ngram-bands")


def verdict(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds perplexity, lower, upper, base_failed and kept."""
    joined = scored.join(limits.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of"), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    deviation = F.sqrt(F.col("spread") * F.col("spread") + F.lit(SHORT * SHORT) / F.greatest(F.col("n_words"), F.lit(1)))
    loss = F.when(F.col("symbols") > 0, -F.col("logp") / F.col("symbols"))
    joined = joined.withColumns(
        {
            "perplexity": F.exp(loss), "lower": F.exp(F.col("middle") - WIDTH * deviation),
            "upper": F.exp(F.col("middle") + WIDTH * deviation), "base_failed": failed,
        }
    )
    inside = F.coalesce(F.col("perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop("of", "middle", "spread", "logp", "symbols")


def quality_rules(
    docs: DataFrame, id_column: str = "doc_id", lang_column: str = "lang", text_column: str = "text", order: int = ORDER,
    most: int = MODEL_ROWS,
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, perplexity, lower, upper, base_failed, kept).

    One row for every row of ``docs``. Texts of fewer than 20 words (null and empty ones too) or with more than 30 %
    of their words in repeated 8-word windows fail the base rules. The rest stays where its perplexity lies in its
    language's band: the median log-loss of the language, five deviations either way, the deviation of a short text
    being wider. Null languages are judged together with empty ones. Ids are handed through, null or repeated.
    An empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(lang_column).alias("_lang"), F.col(text_column).alias("_text"))
    model = fit_model(rows, "_lang", "_text", order)
    scored = materialize(score_rows(rows, model, "_lang", "_text", order, most), "ngram-scored")
    return verdict(scored, bands(scored)).drop("lang").withColumnRenamed("id", id_column)


def keep_good(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", order: int = ORDER, most: int = MODEL_ROWS) -> DataFrame:
    """The rows of ``docs`` that the rules keep. A row's verdict hangs on its text and language alone.

    The bands come from a first pass. Where the model is small enough to send, texts are then judged where they are
    read, without a shuffle; else the rows kept are joined by text hash and language.
    """
    rows = docs.select(F.lit(0).alias("id"), F.col(lang_column).alias("_lang"), F.col(text_column).alias("_text"))
    model = fit_model(rows, "_lang", "_text", order)
    if model.count() > most:
        text = F.coalesce(F.col(text_column), F.lit(""))
        print_ = F.struct(F.xxhash64(text), F.crc32(text.cast("binary")), F.coalesce(F.col(lang_column), F.lit("")))
        printed = docs.select(print_.alias("id"), F.col(lang_column).alias("_lang"), F.col(text_column).alias("_text"))
        scored = materialize(score_rows(printed, model, "_lang", "_text", order, most), "ngram-scored")
        good = verdict(scored, bands(scored)).filter("kept").select(F.col("id").alias("_print")).distinct()
        return docs.join(good, print_ == F.col("_print"), "left_semi")
    scored = materialize(score_rows(rows, model, "_lang", "_text", order, most), "ngram-scored")
    limits = {r.lang: (r.middle, r.spread) for r in bands(scored).collect()}  # a row a language
    sent = docs.sparkSession.sparkContext.broadcast(sorted_arrays(model))

    @F.pandas_udf("boolean")
    def good(lang: pd.Series, text: pd.Series) -> pd.Series:
        made = [judge(lang[at : at + ROWS], text[at : at + ROWS]) for at in range(0, len(text), ROWS)]
        return pd.Series(np.concatenate(made) if made else [], dtype=bool)

    def judge(lang: pd.Series, text: pd.Series) -> np.ndarray:
        tags = [t or "" for t in lang]
        split, facts = _facts([(t or "").encode() for t in text])
        total, symbols = score_texts(sent.value, tags, split, order)
        n, repeats = (facts[k].to_numpy() for k in (0, 4))
        middle, spread = (np.array([limits.get(t, (0.0, 0.0))[k] for t in tags]) for k in (0, 1))
        deviation = np.sqrt(spread * spread + SHORT * SHORT / np.maximum(n, 1))
        off = np.abs(-total / np.maximum(symbols, 1) - middle)
        return (n >= 20) & (100 * repeats <= 30 * n) & (off <= WIDTH * deviation)

    return docs.filter(good(F.col(lang_column), F.col(text_column)))
