"""Supervised subword embeddings for text quality.

A word's vector is the mean of a learned vector for the whole word and of those of its character
n-grams, all hashed into one table; a document is the mean of its words' vectors, where a word
that repeats the one before is the bigram mark and an end mark counts as a word; a softmax layer
on it gives the score. Everything is trained by stochastic gradient descent in numpy, on the
driver, over at most MAX_TRAIN labelled documents, whose features executors have hashed before.

Scoring needs no vectors: the softmax of two classes depends on one inner product, so the table
folds into one number for each hashed feature, and a word into one number.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, small, word_hashes

#: Documented bounds: labelled documents learnt from, hashed features, length of a vector.
MAX_TRAIN, BUCKETS, WIDTH = 2_000, 1 << 16, 8
#: n-gram lengths in bytes of the word between angle brackets.
NGRAMS = (3, 4)
EPOCHS, RATE, SEED = 8, 2.0, 11
THRESHOLD = 0.3
#: Marks that no word equals: the end of a document, and the word bigram of a word and its like.
END, SAME = b"\n", b"\n="
#: Words whose folded number a worker remembers before it starts again.
CACHE_WORDS = 400_000


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for rows whose labels are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % 5 == 0, F.lit(False))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, first feature of each word): the word itself, then its n-grams."""
    whole = (word_hashes(words, 5) % U64(BUCKETS)).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    data = np.frombuffer(b"".join([b"<%b>" % w for w in words]), np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    found, owners = [whole], [np.arange(len(words))]
    word_of = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(data))
    for n in NGRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * U64(257) + data[j : len(data) - n + 1 + j]
        ok = np.flatnonzero(left[: len(h)] >= n)
        found.append((mix(h[ok]) % U64(BUCKETS)).astype(np.int64))
        owners.append(word_of[ok])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(owner[order], np.arange(len(words)))


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a whole text and an end mark; a word equal to the one before becomes the bigram mark."""
    words = (text or b"").split()
    words.append(END)
    return words[:1] + [SAME if a == b else b for a, b in pairwise(words)]


def document_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a whole text and their weights, which sum to 1."""
    words = tokens(text)
    distinct, counts = np.unique(np.array(words, object), return_counts=True)
    ids, first = word_features(list(distinct))
    sizes = np.diff(np.append(first, len(ids)))
    weights = np.repeat(counts / (len(words) * sizes), sizes)
    total = np.bincount(ids, weights, BUCKETS)
    ids = np.flatnonzero(total)
    return ids, total[ids].astype(np.float32)


class Model:
    """score(text) = 1 / (1 + exp(-(mean over words of the mean of `fold` over a word's features + bias)))."""

    def __init__(self, fold: np.ndarray, bias: float):
        self.fold, self.bias = fold, bias

    def words(self, words: list[bytes]) -> np.ndarray:
        ids, first = word_features(words)
        return np.add.reduceat(self.fold[ids], first) / np.diff(np.append(first, len(ids)))

    def score(self, text: bytes | None, cache: dict[bytes, float]) -> float:
        words = tokens(text)
        missing = list(set(words).difference(cache))
        if missing:
            if len(cache) + len(missing) > CACHE_WORDS:
                cache.clear()
                missing = list(set(words))
            for k in range(0, len(missing), 50_000):
                cache.update(zip(missing[k : k + 50_000], self.words(missing[k : k + 50_000]).tolist(), strict=True))
        mean = sum(map(cache.__getitem__, words)) / len(words)
        return float(1 / (1 + np.exp(-np.clip(mean + self.bias, -500, 500))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Train on (feature ids, weights, label); one class or no rows give that class's share."""
    labels = np.array([r[2] for r in rows], np.int64)
    if not len(rows) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))))
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    steps, at = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            ids, weights, label = rows[i]
            rate = np.float32(RATE * (1 - at / steps))
            at += 1
            own = table[ids]
            mean = weights @ own
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= rate * np.float32(0.1) * p
            # a mean spreads a step over hundreds of features; scaling it back by their number keeps rare ones moving
            table[ids] = own - rate * np.float32(len(ids) ** 0.5) * np.outer(weights, back)
    return Model((table @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on the max_train learnable labelled documents whose ids hash lowest.

    Null labels and ids are not used; where labels repeat a doc_id, their mean decides; where docs
    repeat one, the text of smallest hash is learnt from. Neither lang, source nor doc_id
    is an input of the model.
    """
    learn = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg((F.avg("quality") >= 0.5).cast("int").alias("__y"))
    learn = learn.where(~held_out("__id")).orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    some = docs.select("doc_id", F.col("text").cast("binary").alias("__t")).join(F.broadcast(learn), F.col("doc_id") == F.col("__id"))
    # the ids of learn, not those of docs, bound what reaches the driver
    one = some.groupBy(F.col("__id").alias("doc_id")).agg(F.min(F.struct(F.xxhash64("__t").alias("h"), "__t")).alias("first"), F.first("__y").alias("y"))
    some = one.select("doc_id", "first.__t", "y")

    def run(batches):
        for b in small(batches):
            found = [document_features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())],
                ["doc_id", "y", "ids", "weights"],
            )

    rows = some.mapInArrow(run, f"doc_id {some.schema[0].dataType.simpleString()}, y int, ids binary, weights binary")
    rows = sorted((r for r in rows.toLocalIterator()), key=lambda r: r["doc_id"])
    return fit([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["weights"], np.float32), r["y"]) for r in rows])


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted, and the columns named in keep.

    Whole texts are scored; a null or wordless text gets the score of the end mark alone. Rows are
    scored alone, so repeated rows agree; an empty table gives no rows; a null doc_id stays null
    and is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.fold, model.bias))
    kept = [c for c in keep if c != "doc_id"]

    def run(batches):
        own, cache = Model(*shared.value), {}
        for b in small(batches):
            scores = [own.score(t, cache) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(scores, pa.float64())], names)

    some = docs.select("doc_id", F.col("text").cast("binary").alias("__t"), *[F.col(f"`{c}`").alias(f"__k{k}") for k, c in enumerate(kept)])
    names = ["doc_id", *[f"__k{k}" for k in range(len(kept))], "score"]
    schema = ", ".join([f"doc_id {some.schema[0].dataType.simpleString()}", *[f"__k{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(kept)], "score double"])
    out = some.mapInArrow(run, schema)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *[F.col(f"__k{k}").alias(f"__k_{c}") for k, c in enumerate(kept)])
