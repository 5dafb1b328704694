"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is an n-gram inside a padded lower-case word; its value in a text is the number of distinct words that
hold it, divided by the root of the text's number of distinct words. Weights are fitted by logistic regression on values
times log-count ratios. A text's score is then a sum over its distinct words, so a worker scores each word once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_map, held_out, mix, share_of, sized, table

#: The bounded sample: so many labelled documents of each label, those with the least hash of the id; their texts are read whole.
ROWS = 1500
GRAMS, BITS = (3, 4, 5), 19
STEPS, RATE, PENALTY, SMOOTH = 150, 0.3, 1e-4, 1.0
#: Words whose scores a worker keeps: beyond so many they become the older half, which is asked until the next are as many.
CACHED = 150_000
_WORD = re.compile(r"\w+")


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word's index, feature) of every n-gram of every word, each pair once."""
    joined = "".join(f"<{w}>" for w in words)
    code = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), size)
    pairs = []
    for n in GRAMS:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + code[j : j + len(h)]
        inside = word[: len(h)] == word[n - 1 :]
        f = (mix(h[inside]) >> np.uint64(64 - BITS)).astype(np.int64)
        pairs.append(word[: len(h)][inside] << BITS | f)
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)
        self.cache: dict[str, float] = {}
        self.older: dict[str, float] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "cache": {}, "older": {}}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        sets = [distinct_words(t) for t in texts]
        if len(self.cache) > CACHED:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        new = [w for w in set().union(*sets) if w not in cache]
        if older:
            cache.update((w, older[w]) for w in new if w in older)
            new = [w for w in new if w not in older]
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            word, f = word_features(part)
            cache.update(zip(part, np.bincount(word, self.weights[f], len(part)).tolist(), strict=True))
        z = np.array([sum([cache[w] for w in s]) / max(1, len(s)) ** 0.5 + self.bias for s in sets])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class _Groups:
    """Sums of values[into] over consecutive groups, none empty, of the places that starts bound; a part at a time."""

    def __init__(self, into: np.ndarray, starts: np.ndarray):
        self.into, self.starts = into.astype(np.int32), np.append(starts, len(into))

    def sums(self, values: np.ndarray) -> np.ndarray:
        out, n = np.zeros(len(self.starts) - 1), len(self.starts) - 1
        a = 0
        while a < n:
            i = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.starts, i + 500_000, side="right")) - 1)
            out[a:b] = np.add.reduceat(values[self.into[i : self.starts[b]]], self.starts[a:b] - i)
            a = b
        return out


def _new_runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def fit(rows: Iterable[tuple[int, int, str | None]], most: int | None = None) -> Model:
    """The model of (label, order, text) rows, of each label the first `most` by order. Texts are read one by one, and only their words'
    numbers are held. Without rows of both labels the model answers with the only label's side everywhere, or 0 for none."""
    vocabulary: dict[str, int] = {}
    held, y, order = [], [], []
    for label, at, text in rows:
        words = distinct_words(text)
        held.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
        y.append(label)
        order.append(at)
    taken = [i for label in (0, 1) for i in sorted((i for i in range(len(y)) if y[i] == label), key=lambda i: order[i])[:most]]
    y = np.array([y[i] for i in taken], np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), 20.0 if len(y) and y[0] else -20.0)
    # words are numbered anew, in their own order, so that the weights don't depend on the order of arrival
    used = np.zeros(len(vocabulary), bool)
    for i in taken:
        used[held[i]] = True
    names = sorted(w for w, i in vocabulary.items() if used[i])
    number = np.zeros(len(vocabulary), np.int32)
    number[[vocabulary[w] for w in names]] = np.arange(len(names))
    del vocabulary
    place = np.concatenate([np.sort(number[held[i]]) for i in taken])
    doc = np.repeat(np.arange(len(taken)), [len(held[i]) for i in taken])
    del held
    n_words, n_docs, size = len(names), len(taken), 1 << BITS
    pairs = [word_features(names[i : i + 20_000]) for i in range(0, n_words, 20_000)] or [(np.zeros(0, np.int64),) * 2]
    word = np.concatenate([(w + 20_000 * k).astype(np.int32) for k, (w, _) in enumerate(pairs)])
    f = np.concatenate([x.astype(np.int32) for _, x in pairs])
    del pairs, names
    by_word = _Groups(f, _new_runs(word))  # every word has an n-gram
    turned = np.argsort(f, kind="stable").astype(np.int32)
    starts = _new_runs(f[turned])
    by_feature, seen = _Groups(word[turned], starts), f[turned][starts]
    del word, f, turned
    norm = 1 / np.sqrt(np.maximum(1, np.bincount(doc, minlength=n_docs)))

    toxic = np.bincount(place, y[doc], n_words)
    plain = np.bincount(place, minlength=n_words) - toxic
    p, q = by_feature.sums(toxic) + SMOOTH, by_feature.sums(plain.astype(np.float64)) + SMOOTH
    unseen = SMOOTH * (size - len(seen))
    ratio = np.zeros(size)  # 0 for features never seen
    ratio[seen] = np.log(p / (p.sum() + unseen)) - np.log(q / (q.sum() + unseen))
    ratio_seen, part = ratio[seen], np.zeros(size)

    w, b = np.zeros(len(seen)), 0.0
    m, v, mb, vb = np.zeros(len(seen)), np.zeros(len(seen)), 0.0, 0.0
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for step in range(1, STEPS + 1):  # Adam on the weighted log loss
        part[seen] = w * ratio_seen
        z = np.bincount(doc, by_word.sums(part)[place], n_docs) * norm + b
        error = share * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        g = by_feature.sums(np.bincount(place, (error * norm)[doc], n_words)) * ratio_seen + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.999 * vb + 0.001 * error.sum() ** 2
        rate = RATE * 0.1 * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
        w -= rate * m / (np.sqrt(v) + 1e-12)
        b -= rate * mb / (vb**0.5 + 1e-12)
    part[seen] = w * ratio_seen
    return Model(part, b)


def _fitted(rows: int):
    """One task's work: the model of all its rows (toxic, h, text), of each label those with the least h."""

    def run(batches):
        model = fit(((b.column("toxic")[k].as_py(), b.column("h")[k].as_py(), b.column("text")[k].as_py()) for b in batches for k in range(len(b))), rows)
        yield pa.RecordBatch.from_pydict({"weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": pa.array([model.bias], pa.float64())})

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Fits on a bounded sample of docs (doc_id, text) that labels (doc_id, toxic) mark 0 or 1, whole texts.

    Which documents are drawn follows from a hash of their ids and each label's count, so nothing is ranked; the fit runs in
    one task of an executor, whose rows the sample bounds, and the driver gets the weights. Where labels disagree about a
    document 1 counts; of rows that repeat a doc_id the text with the least hash is learned from. Null ids and labels teach nothing."""
    marked = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out())
    count = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not count:
        return fit([])
    drawn = F.when(F.col("toxic") == 1, min(1.0, 1.2 * rows / max(1, count.get(1, 0)))).otherwise(min(1.0, 1.2 * rows / max(1, count.get(0, 0))))
    some = marked.filter(share_of("doc_id") <= drawn)  # 2.4 x rows, about
    got = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    one = arrow_map(got.select("toxic", F.xxhash64("doc_id").alias("h"), "text").repartition(1), _fitted(rows), "weights binary, bias double").collect()
    return Model(np.frombuffer(one[0]["weights"], np.float32), one[0]["bias"]) if one else fit([])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for each row of docs; every whole text has a score, null and empty ones by the bias alone. Rows
    are scored each for itself, repeated ones alike; a very long text costs its distinct words. Other columns are left out."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2 MB: 2**19 weights
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for part in sized(pa.Table.from_batches([batch]), "text"):
                s = shared.value.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").combine_chunks(), "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    return arrow_map(texts, run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores below 0.5, with all their columns, whatever their names; null and empty texts are scored as score() does."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches):
        for batch in batches:
            for part in sized(pa.Table.from_batches([batch]), text_col):
                yield from part.filter(pa.array(shared.value.scores(part.column(at).to_pylist()) < 0.5)).to_batches()

    return arrow_map(docs, run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
