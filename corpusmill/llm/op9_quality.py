"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its features: hashed words, hashed pairs of
neighbouring words, and hashed character n-grams (3 to 5 bytes, with word edges).  In a pair a
word that repeats the one before is written as "the same", so all such pairs share a vector;
every feature weighs alike.  A softmax over the average gives the class.  Vectors and output weights are learned together by stochastic gradient descent in
numpy, on the driver, from a bounded sample of labelled rows (at most PER_CLASS rows of the
classes and TRAIN_CHARS characters of them, documented parameters) whose features the executors count.  As the output is linear in the
average, each feature's share of the logit is known after training: executors score whole
documents with one table look-up a feature.

Scores are brought from the balanced sample to the frequencies of the classes among all
rows that may be learnt from.

Defined results: a null or empty text has no features and gets the score of the frequencies
alone; without labels of both classes every score is the share of label 1 (0.5 without any);
repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_rows, map_rows, release_driver, table
from .hashing import BLANK_BYTE, as_bytes, gram_hashes, mix, word_hashes
from .labelled import held_out, training_rows

BUCKETS, DIM = 1 << 17, 12
PER_CLASS, EPOCHS, RATE, SEED = (1500, 1500), 8, 0.5, 7
THRESHOLD = 0.3
#: The pair of a word and "the same".
SAME = np.uint64(0x5EED)


def features(text: str) -> np.ndarray:
    """Buckets of all features of a text, with repeats."""
    raw = as_bytes(f" {text} ")
    blank = BLANK_BYTE[raw]
    words = word_hashes(raw, ~blank)[0]
    pairs = np.where(words[1:] == words[:-1], SAME, mix(words[:-1] * np.uint64(3) + words[1:]))
    parts = [words, pairs, *(gram_hashes(raw, blank, n) for n in (3, 4, 5))]
    return (np.concatenate(parts) & np.uint64(BUCKETS - 1)).astype(np.int32)


def counted(rows: DataFrame) -> list:
    """(label, buckets, counts) of each training row, in a fixed order."""

    def work(chunk):
        pairs = [np.unique(features(t), return_counts=True) for t in chunk.column(0).to_pylist()]
        return [chunk.column(1), [a for a, _ in pairs], [n.astype(np.float32) for _, n in pairs]]

    got = map_rows(rows, ["text", "label"], "label int, bucket array<int>, n array<float>", work).toArrow().combine_chunks()
    bucket, n = (got[c].combine_chunks() if got.num_rows else None for c in ("bucket", "n"))
    out = []
    for i, y in enumerate(got["label"].to_pylist()):
        a, b = bucket.offsets[i].as_py(), bucket.offsets[i + 1].as_py()
        out.append((y, bucket.values[a:b].to_numpy(), n.values[a:b].to_numpy()))
    return sorted(out, key=lambda x: (x[0], len(x[1]), x[1][:64].tobytes(), x[2][:64].tobytes()))


class SubwordClassifier:
    def __init__(self, share: np.ndarray, bias: float):
        self.share, self.bias = share, bias

    @classmethod
    def fit(cls, rows: list, totals: dict[int, int], epochs: int = EPOCHS, rate: float = RATE) -> SubwordClassifier:
        known = {k: v for k, v in totals.items() if v}
        if len(known) < 2 or len({y for y, _, _ in rows}) < 2:
            p = min(max(totals.get(1, 0) / sum(totals.values()), 1e-6), 1 - 1e-6) if sum(totals.values()) else 0.5
            return cls(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
        rng = np.random.default_rng(SEED)
        vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
        size = [sum(y == k for y, _, _ in rows) for k in (0, 1)]
        weight = [len(rows) / (2 * s) for s in size]
        steps, done = epochs * len(rows), 0
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                y, bucket, n = rows[i]
                now = rate * (1 - done / steps) * weight[y]
                done += 1
                if not len(bucket):
                    continue
                part = n / n.sum()
                hidden = part @ vectors[bucket]
                z = hidden @ out + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y] -= 1
                back = out @ p
                out -= now * np.outer(hidden, p)
                bias -= now * p
                vectors[bucket] -= now * len(bucket) ** 0.5 * part[:, None] * back
        prior = np.log(totals[1] / totals[0])
        return cls((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0] + prior))

    def score(self, text: str) -> float:
        f = features(text)
        z = self.bias + (float(self.share[f].mean(dtype=np.float64)) if len(f) else 0.0)
        return float(1 / (1 + np.exp(-z)))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: tuple[int, int] = PER_CLASS) -> SubwordClassifier:
    rows, totals = training_rows(docs, labels, label, per_class)
    model = SubwordClassifier.fit(counted(rows), totals)
    release_driver(docs.sparkSession)  # which goes on without the training rows
    return model


def score_quality(docs: DataFrame, model: SubwordClassifier, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and score.  The model has a fixed size (512 kB)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.share, model.bias))
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def work(chunk):
        model = SubwordClassifier(*shared.value)
        return [*(chunk.column(i) for i in range(len(keep))), [model.score(t or "") for t in chunk.column(len(keep)).to_pylist()]]

    return map_rows(docs, [*keep, text_col], f"{kept}, score double", work)


def keep_quality(docs: DataFrame, model: SubwordClassifier, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least the threshold; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast((model.share, model.bias))

    def good(texts: list) -> list[bool]:
        model = SubwordClassifier(*shared.value)
        return [model.score(t or "") >= threshold for t in texts]

    return filter_rows(docs, text_col, good)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
