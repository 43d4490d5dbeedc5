"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

The features of a block of ``BLOCK`` words (the next block begins in its middle) are the character n-grams of its distinct lower-case words, each with a mark at
both ends. The value of an n-gram is the number of distinct words that hold it, times its log-count ratio between the
classes; logistic regression over these values gives the block's score, and the highest block decides, so a toxic passage
is not diluted by a long text, wherever it stands. As values add up over words, a word's share is computed once and kept in a bounded memo.

Labels are a bounded sample: at most ``per_class`` toxic and ``per_class`` x ``clean_each`` other labelled rows outside the held-out third (crc32 of the id
modulo 3 is 1), chosen by a hash of the id. Scoring covers every whole text. The only inputs of a score are the text's words.

Defined cases: null and empty texts get the score of a document without words; without labels of both classes the score is
the share of toxic labels (0 without any); of several labels of an id the largest counts; repeated rows are each scored.
"""

from __future__ import annotations

import zlib
from math import exp, fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow, id_remainder, in_share, text_or_empty

MEMO_WORDS, MEMO_LENGTH, BLOCK = 700_000, 40, 400
THRESHOLD = 0.7


def ngrams(word: str, low: int, high: int, buckets: int) -> list[int]:
    """Hashed n-grams of a word without its outer punctuation; long words have long lists, nothing is cut."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    w = f"<{word[a:b]}>"
    if len(w) == 2:
        return []
    return [zlib.crc32(w[i : i + n].encode("utf-8", "surrogatepass")) % buckets for n in range(low, high + 1) for i in range(len(w) - n + 1)]


class _Memo(dict):
    def __init__(self, model):
        self.model = model

    def __missing__(self, word):
        s = self.model.word(word)
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = s
        return s


class Model:
    def __init__(self, weights: np.ndarray, bias: float, low: int, high: int):
        self.weights, self.bias, self.low, self.high = weights, bias, low, high
        self.memo = _Memo(self)

    def __getstate__(self):
        return self.weights, self.bias, self.low, self.high

    def __setstate__(self, state):
        self.__init__(*state)

    def word(self, word: str) -> float:
        return float(self.weights[ngrams(word, self.low, self.high, len(self.weights))].sum()) if word else 0.0

    def score(self, text: str) -> float:
        """The highest of the scores of a text's blocks of ``BLOCK`` words."""
        total = max(self.blocks(text.lower().split())) + self.bias
        return 1 / (1 + exp(-min(40.0, max(-40.0, total))))

    def blocks(self, words: list[str]) -> list[float]:
        """Sums over the distinct words of each block: of its two halves, less what both have."""
        get = self.memo.__getitem__
        if len(words) <= BLOCK:
            return [fsum(map(get, set(words)))]
        halves = [set(words[i : i + BLOCK // 2]) for i in range(0, len(words), BLOCK // 2)]
        sums = [fsum(map(get, h)) for h in halves]
        return [a + b - fsum(map(get, x & y)) for a, b, x, y in zip(sums, sums[1:], halves, halves[1:], strict=False)]


def train(rows: list[tuple[str, int]], low: int = 2, high: int = 5, buckets: int = 1 << 18, smooth: float = 1.0, l2: float = 1e-4, rounds: int = 80) -> Model:
    """Naive Bayes ratios, then logistic regression (full-batch Adam) over the scaled features."""
    y = np.array([int(t) for _, t in rows], np.float32)
    empty = np.zeros(buckets, np.float32)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(empty, 40.0 if share == 1 else -40.0, low, high)
    index, value, owner = [], [], []
    known: dict[str, np.ndarray] = {}
    for k, (text, _) in enumerate(rows):
        grams = [np.zeros(0, np.int32)]
        for w in set(text.lower().split()):
            if w not in known:
                known[w] = np.array(ngrams(w, low, high, buckets), np.int32)
            grams.append(known[w])
        i, n = np.unique(np.concatenate(grams), return_counts=True)
        index.append(i.astype(np.int32))
        value.append(n.astype(np.float32))
        owner.append(np.full(len(i), k, np.int32))
    known.clear()
    idx, val, own = map(np.concatenate, (index, value, owner))
    del index, value, owner
    p = np.bincount(idx, (y[own] > 0) * np.minimum(val, 1), buckets) + smooth
    q = np.bincount(idx, (y[own] == 0) * np.minimum(val, 1), buckets) + smooth
    ratio = np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)
    ratio[(p + q) < 2 * smooth + 2] = 0
    val *= ratio[idx]
    seen = np.flatnonzero(np.bincount(idx, minlength=buckets))
    place = np.zeros(buckets, np.int32)
    place[seen] = np.arange(len(seen), dtype=np.int32)
    pos = place[idx]
    del idx
    w, b = np.zeros(len(seen)), 0.0
    weight = 1 / len(y)
    m1, m2, c1, c2 = np.zeros(len(seen)), np.zeros(len(seen)), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(own, w[pos] * val, len(y)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        gw = np.bincount(pos, g[own] * val, len(seen)) + l2 * w
        gb = g.sum()
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.99 * m2 + 0.01 * gw * gw
        c1, c2 = 0.9 * c1 + 0.1 * gb, 0.99 * c2 + 0.01 * gb * gb
        rate = 0.05 / np.sqrt(t)
        w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        b -= rate * 4 * (c1 / (1 - 0.9**t)) / (np.sqrt(c2 / (1 - 0.99**t)) + 1e-8)
    empty[seen] = w
    return Model(empty * ratio, float(b), low, high)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 600, clean_each: int = 3, **how) -> Model:
    """Learn from the bounded sample above, the only rows that reach the driver."""
    known = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (id_remainder("doc_id", 3) != 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    most = {1: per_class, 0: per_class * clean_each}
    share = F.when(F.col("toxic") == 1, 1.5 * most[1] / max(1, sizes.get(1, 0))).otherwise(1.5 * most[0] / max(1, sizes.get(0, 0)))
    known = known.where(in_share("doc_id", share))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = {r.doc_id: r.toxic for r in known.withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.when(F.col("toxic") == 1, most[1]).otherwise(most[0])).collect()}
    if not chosen:
        return train([], **how)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(docs["text"]).alias("text"))
    ids = docs.sparkSession.createDataFrame([(k,) for k in chosen], "doc_id long")  # per_class * (1 + clean_each) ids at most
    got = texts.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).collect()  # an id's rows are one
    return train([(r.text, chosen[r.doc_id]) for r in sorted(got, key=lambda r: r.doc_id)], **how)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(id_remainder(docs["doc_id"], 3) == 1, F.lit(False)).alias("held_out"), text_or_empty(docs["text"]).alias("text"))

    def run(batches):
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                s = [m.score(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")
