"""Quality classifier: averaged subword embeddings with a softmax, fitted by numpy SGD.

A document is the mean of the learned vectors of its features: each word, the
character n-grams of each word, and a common feature for each word bigram that
says the same word twice, hashed to a fixed number of rows. Two
outputs and a softmax give the probability of label 1. As the mean is linear, a
fitted model folds to one number for each row of the hash table; scoring sums
those over the whole text.

The model is fitted on at most ``max_labelled`` labelled rows, chosen by a hash
of their ids; scoring covers every row and every word.

Defined results: a null or empty text, or one without words, gets the score of
the bias alone; unlabelled rows and null labels aren't learned from; repeated
labels of a document count once, by their largest value, and rows that repeat an
id are learned from once, by the first of their texts in order; repeated rows give
repeated results; an id without a remainder (null) is not held out; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import crc_fold, map_rows, small_batches, table

#: N-grams of words of more bytes are hashed by numpy, and such words are not cached.
LONG_WORD = 64
#: Characters of a long word that are hashed at once.
BLOCK = 1 << 16
#: What a bigram of twice the same word counts for, in features; a word has about as many.
SAME = 16


@dataclass(frozen=True)
class Params:
    max_labelled: int = 6000
    buckets: int = 1 << 17
    dim: int = 16
    epochs: int = 5
    rate: float = 0.5
    seed: int = 7
    least: int = 3
    most: int = 5


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1)
    return c


CRC = _crc_table()


def long_ids(word: bytes, p: Params) -> Iterator[np.ndarray]:
    """What feature_ids gives, in blocks, with the crc32 of all n-grams of a block taken a byte at a time."""
    last = p.buckets - 1
    yield np.array([zlib.crc32(word) & last], np.int64)
    raw = np.frombuffer(b"<" + word + b">", np.uint8)
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where characters start, and the end
    for a in range(0, len(at) - p.least, BLOCK):
        b = min(a + BLOCK, len(at) - p.least)
        crc = np.full(b - a, 0xFFFFFFFF, np.uint32)
        for n in range(1, p.most + 1):
            crc = crc[: len(at) - n - a]
            starts, ends = at[a + n - 1 : a + n - 1 + len(crc)], at[a + n : a + n + len(crc)]
            for k in range(int((ends - starts).max(initial=0))):
                has = starts + k < ends
                byte = raw[np.minimum(starts + k, len(raw) - 1)]
                crc = np.where(has, CRC[(crc ^ byte) & 255] ^ (crc >> 8), crc)
            if n >= p.least:
                yield (~crc & np.uint32(last)).astype(np.int64)


def feature_ids(word: bytes, p: Params) -> list[int]:
    """Rows of the hash table for a word: itself and its character n-grams."""
    if word.isascii():  # a character is a byte
        w = b"<" + word + b">"
        parts = [word] + [w[i : i + n] for n in range(p.least, p.most + 1) for i in range(len(w) - n + 1)]
    else:
        w = f"<{word.decode(errors='replace')}>"
        parts = [word] + [
            w[i : i + n].encode() for n in range(p.least, p.most + 1) for i in range(len(w) - n + 1)
        ]
    last, crc = p.buckets - 1, zlib.crc32
    return [crc(x) & last for x in parts]


def features(word: bytes, p: Params) -> np.ndarray:
    if len(word) > LONG_WORD:
        return np.concatenate(list(long_ids(word, p)))
    return np.array(feature_ids(word, p), np.int64)


class Words(dict):
    """Word -> what make(word) gives, in bounded memory; long words are made each time."""

    def __init__(self, make, most: int = 150_000):
        self.make, self.most = make, most

    def __missing__(self, word: bytes):
        if len(word) > LONG_WORD:
            return self.make(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = value = self.make(word)
        return value


def same_row(p: Params) -> int:
    return zlib.crc32(b"\x00same") & (p.buckets - 1)


def twice(words: list[bytes]) -> int:
    """Words equal to the one before them."""
    return sum(map(operator.eq, words, words[1:]))


def doc_words(text: str | None) -> list[bytes]:
    return (text or "").encode(errors="replace").split()


def fit(texts, labels: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """The folded model: a number for each row of the table, and the bias."""
    rng = np.random.default_rng(p.seed)
    emb = ((rng.random((p.buckets, p.dim), dtype=np.float32) - 0.5) / p.dim).astype(np.float32)
    out = np.zeros((2, p.dim), np.float32)
    bias = np.zeros(2, np.float32)
    cache = Words(lambda w: features(w, p))
    docs = []
    for text in texts:
        words = doc_words(text)
        ids = [cache[w] for w in words] + [np.full(SAME * twice(words), same_row(p))] * bool(words)
        rows, n = np.unique(np.concatenate(ids), return_counts=True) if ids else (np.zeros(0, np.int64), np.zeros(0))
        docs.append((rows.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    steps, step = p.epochs * len(docs), 0
    for _ in range(p.epochs):
        for i in rng.permutation(len(docs)):
            rate = p.rate * (1 - step / steps)
            step += 1
            rows, share = docs[i]
            vec = share @ emb[rows]
            z = out @ vec + bias
            z = np.exp(z - z.max())
            g = z / z.sum()
            g[labels[i]] -= 1
            back = out.T @ g
            out -= rate * np.outer(g, vec)
            bias -= 0.1 * rate * g
            emb[rows] -= rate * share[:, None] * back
    return emb @ (out[1] - out[0]), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, label_col: str, learn, p: Params) -> tuple[np.ndarray, float]:
    """Fits in one executor task, on at most p.max_labelled rows."""
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.max(label_col).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(p.max_labelled)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_label").alias("_label"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"], kind="stable")
        table_, bias = fit(pdf.text, (pdf._label.to_numpy() > 0).astype(int), p)
        return pd.DataFrame({"model": [table_.astype(np.float32).tobytes()], "bias": [bias]})

    got = rows.groupBy(F.lit(0).alias("_all")).applyInPandas(one, "model binary, bias double").collect()
    if not got:
        return np.zeros(p.buckets, np.float32), 0.0
    return np.frombuffer(got[0].model, np.float32), got[0].bias


def scorer(model: tuple[np.ndarray, float], p: Params):
    """A function of a whole text to its score; it keeps a cache of words."""
    weights, bias = model
    same = float(weights[same_row(p)])

    numbers = weights.tolist()

    def number(word: bytes) -> tuple[float, int]:
        if len(word) > LONG_WORD:
            parts = [(float(weights[ids].sum(dtype=float)), len(ids)) for ids in long_ids(word, p)]
            return sum(x for x, _ in parts), sum(k for _, k in parts)
        ids = feature_ids(word, p)
        return sum([numbers[i] for i in ids]), len(ids)

    cache = Words(number)

    def score(text: str | None) -> float:
        words = doc_words(text)
        got = [cache[w] for w in words]
        n_same = SAME * twice(words)
        z = bias + (sum(x for x, _ in got) + same * n_same) / max(1, sum(k for _, k in got) + n_same)
        return float(1 / (1 + np.exp(-z)))

    return score


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], p: Params) -> DataFrame:
    """doc_id, score in [0, 1] of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = scorer(shared.value, p)
        return lambda doc_id, text: (doc_id, score(text))

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, score double")


def keep_quality(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.5, params: Params = Params()
) -> DataFrame:
    """docs without the rows whose score is below threshold; no row moves."""
    model = train(docs, labels, label_col, crc_fold("doc_id", 4) != 2, params)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = scorer(shared.value, params)
        for texts in batches:
            yield pd.Series([score(t) for t in texts], dtype=float)

    return docs.where(scores("text") >= threshold)


def classify_quality(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.7,
    params: Params = Params(),
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = train(docs, labels, label_col, crc_fold("doc_id", 4) != 2, params)
    return score_quality(docs, model, params).select(
        "doc_id",
        F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
