"""Toxicity: class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney bigram models, of toxic and of ordinary documents.  The top order
has raw counts of pairs, the order below counts after how many different words a word stands;
from each the fixed discount D = n1 / (n1 + 2 n2) is taken off (n1 and n2: how many counts are
1 and 2), and what that frees goes to the order below.  Below both lies one shared order: how
often each word stands in the whole corpus, and after how many different words in the labelled
rows of either class.  A word that one class lacks is thus backed off to the same probability
in both, and only words whose use differs between the classes tell them apart.

A document's evidence is the length-normalised difference of its two log-likelihoods: over the
whole text, over its strongest window of WINDOW words, and over its strongest single word (by
the lower order), since abuse is often a few words of a long text.  A logistic regression makes
these into a probability; its inputs are cross-fitted (each half of the labelled rows is scored
by models of the other half).

Words are runs of letters and digits, lower-cased, known by 64-bit hashes.  Corpus counts lie in
a table by word that grows with the corpus; of words that stand in no labelled row the shared
probability is the same on both sides and drops out, so scoring needs the counts of the sample's
words alone.  The models are fitted on at most PER_CLASS labelled rows of the classes and at
most TRAIN_CHARS characters of them (documented parameters); the corpus counts cover every
document.

Defined results: a null or empty text has no words and gets the score of no evidence; without
labels of both classes every score is the share of label 1 (0 without any); repeated rows get
equal scores; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, release, rows_in_chunks, small_batches, table
from .hashing import WORD_BYTE, as_bytes, mix, word_hashes
from .labelled import held_out, training_rows

PER_CLASS = (2500, 2500)
WINDOW = 6
#: Different words that a task holds before it passes their counts on.
HELD_WORDS = 400_000
#: Of the logistic regression.
RIDGE = 0.1


def words(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased words of a text."""
    raw = as_bytes(text.lower())
    return word_hashes(raw, WORD_BYTE[raw])[0]


def corpus_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): occurrences of each word in all documents, counted in each task before they
    are summed by word."""

    def out(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)].view(np.int64)), pa.array(n[k : k + (1 << 16)])], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for chunk in rows_in_chunks(batches):
            found, times = np.unique(words(" ".join(t for t in chunk.column(0).to_pylist() if t)), return_counts=True)
            keys, at = np.unique(np.concatenate((keys, found)), return_inverse=True)
            n = np.bincount(at, np.concatenate((n, times)), minlength=len(keys)).astype(np.int64)
            if len(keys) > HELD_WORDS:
                yield from out(keys, n)
                keys, n = keys[:0], n[:0]
        yield from out(keys, n)
        release()

    small_batches(docs.sparkSession)
    return docs.select(text_col).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bigrams(h: np.ndarray) -> np.ndarray:
    """64-bit hashes of the neighbouring pairs of words."""
    return mix(h[:-1] * np.uint64(3) + h[1:])


def joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def continuations(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The words, as sorted hashes, and after how many different words (or the start) each stands."""
    item = joined(docs)
    before = joined([np.concatenate((np.zeros(1, np.uint64), h))[: len(h)] for h in docs])
    first = np.unique(mix(before * np.uint64(3) + item), return_index=True)[1]
    return np.unique(item[first], return_counts=True)


def discount(count: np.ndarray) -> float:
    """Kneser and Ney's estimate; a half where there are no counts of 1 or 2."""
    n1, n2 = int((count == 1).sum()), int((count == 2).sum())
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    """values[i] where keys[i] (sorted) is the wanted key, else other."""
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


class Shared:
    """The order that both classes back off to: the words' share of the corpus, mixed half and
    half with their share of the continuation counts of the labelled rows; never 0."""

    def __init__(self, docs: list[np.ndarray], corpus: tuple[np.ndarray, np.ndarray, int, int]):
        known, n, total, kinds = corpus
        self.word, after = continuations(docs)
        kinds = max(kinds, len(self.word), 1)
        own = (after + 1) / (after.sum() + kinds)
        self.share = 0.5 * own + 0.5 * (looked_up(known, n, self.word, 0.0) + 1) / (total + kinds)
        self.other = 0.5 / (after.sum() + kinds) + 0.5 / (total + kinds)

    def of(self, h: np.ndarray) -> np.ndarray:
        return looked_up(self.word, self.share, h, self.other)


class ClassModel:
    """An interpolated Kneser-Ney bigram model of one class over the shared order."""

    def __init__(self, docs: list[np.ndarray], shared: Shared):
        self.shared = shared
        self.word, count = continuations(docs)
        d, total = discount(count), max(count.sum(), 1)
        self.one, self.rest_of_all = (count - d) / total, d * len(count) / total if len(count) else 1.0
        two = [h for h in docs if len(h) > 1]
        self.pair, first, count = np.unique(joined([bigrams(h) for h in two]), return_index=True, return_counts=True)
        d = discount(count)
        self.context, at = np.unique(joined([h[:-1] for h in two])[first], return_inverse=True)
        stands = np.bincount(at, count, minlength=len(self.context))
        self.two = (count - d) / stands[at] if len(count) else np.zeros(0)
        self.rest = d * np.bincount(at, minlength=len(self.context)) / stands if len(count) else np.zeros(0)


class Contrast:
    """The log-likelihoods of two class models against each other.  The words and pairs of both
    lie in one table each, in which a batch of documents is looked up together, in the order of
    the hashes."""

    def __init__(self, toxic: ClassModel, plain: ClassModel):
        both = (toxic, plain)
        self.word, self.pair = (np.unique(np.concatenate(x)) for x in ((toxic.word, plain.word), (toxic.pair, plain.pair)))
        share = toxic.shared.of(self.word)
        one = [looked_up(m.word, m.one, self.word, 0.0) + m.rest_of_all * share for m in both]
        rest = [looked_up(m.context, m.rest, self.word, 1.0) for m in both]
        two = [looked_up(m.pair, m.two, self.pair, 0.0) for m in both]
        # the last entry stands for what is in neither
        self.one = [np.append(x, m.rest_of_all * m.shared.other) for x, m in zip(one, both, strict=True)]
        self.rest, self.two = [np.append(x, 1.0) for x in rest], [np.append(x, 0.0) for x in two]

    @staticmethod
    def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted key, the number of keys for those that are none."""
        if not len(keys) or not len(wanted):
            return np.full(len(wanted), len(keys))
        some, of = np.unique(wanted, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
        return np.where(keys[at] == some, at, len(keys))[of]

    def differences(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Toxic less ordinary log-probability of each word of all documents in a row: by itself,
        and after the one before it in its document."""
        flat = joined(docs)
        at = self._places(self.word, flat)
        one = [x[at] for x in self.one]
        alone = np.log(one[0]) - np.log(one[1])
        inside = np.ones(len(flat), bool)
        starts = np.cumsum([0, *map(len, docs)])[:-1]
        inside[starts[starts < len(flat)]] = False
        i = np.flatnonzero(inside)
        known = (at[i] < len(self.word)) & (at[i - 1] < len(self.word))  # a pair of the tables has words of them
        pair = np.full(len(i), len(self.pair))
        pair[known] = self._places(self.pair, mix(flat[i - 1][known] * np.uint64(3) + flat[i][known]))
        p = [two[pair] + rest[at[i - 1]] * x[i] for two, rest, x in zip(self.two, self.rest, one, strict=True)]
        after = alone.copy()
        after[i] = np.log(p[0]) - np.log(p[1])
        return alone, after

    def evidence(self, docs: list[np.ndarray]) -> np.ndarray:
        """For each document the length-normalised log-likelihood differences: of the text, of its
        strongest window of WINDOW words, and of its strongest single word; 0 without words."""
        out, end = np.zeros((len(docs), 3)), 0
        alone, after = self.differences(docs)
        for k, h in enumerate(docs):
            if len(h):
                d, end = after[end : end + len(h)], end + len(h)
                total = np.concatenate(([0.0], d.cumsum()))
                size = min(WINDOW, len(d))
                out[k] = d.mean(), (total[size:] - total[:-size]).max() / WINDOW, alone[end - len(h) : end].max()
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights (the last for the constant) by Newton's method with a ridge."""
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + RIDGE * w
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + RIDGE * np.eye(len(w)), grad)
    return w


class ToxicityModel:
    def __init__(self, contrast: Contrast | None, weights: np.ndarray):
        self.contrast, self.weights = contrast, weights

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, int]], totals: dict[int, int], corpus: tuple[np.ndarray, np.ndarray, int, int]) -> ToxicityModel:
        by = {k: [h for h, y in rows if y == k] for k in (0, 1)}
        if len(by[0]) < 2 or len(by[1]) < 2:
            p = min(max(totals.get(1, 0) / max(sum(totals.values()), 1), 1e-6), 1 - 1e-6)
            return cls(None, np.array([0.0, 0.0, 0.0, np.log(p / (1 - p))]))
        x, y = [], []
        for half in (0, 1):
            learn = {k: by[k][half::2] for k in (0, 1)}
            contrast = contrasted(learn[1], learn[0], corpus)
            for k in (0, 1):
                some = by[k][1 - half :: 2]
                x.append(contrast.evidence(some))
                y += [k] * len(some)
        weights = fit_logistic(np.concatenate(x), np.array(y, float))
        weights[-1] += np.log(totals[1] / totals[0]) - np.log(len(by[1]) / len(by[0]))
        return cls(contrasted(by[1], by[0], corpus), weights)

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), 3)) if self.contrast is None else self.contrast.evidence([words(t) for t in texts])
        z = x @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def contrasted(toxic: list[np.ndarray], plain: list[np.ndarray], corpus: tuple[np.ndarray, np.ndarray, int, int]) -> Contrast:
    shared = Shared(toxic + plain, corpus)
    return Contrast(ClassModel(toxic, shared), ClassModel(plain, shared))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: tuple[int, int] = PER_CLASS) -> ToxicityModel:
    rows, totals = training_rows(docs, labels, label, per_class)

    def work(chunk):
        return [chunk.column(1), [words(t).view(np.int64) for t in chunk.column(0).to_pylist()]]

    got = map_rows(rows, ["text", "label"], "label int, words array<long>", work).toArrow().combine_chunks()
    flat = got["words"].combine_chunks() if got.num_rows else None
    at = flat.offsets.to_pylist() if got.num_rows else []
    learnt = [(flat.values[at[i] : at[i + 1]].to_numpy().view(np.uint64), y) for i, y in enumerate(got["label"].to_pylist())]
    learnt.sort(key=lambda r: (r[1], len(r[0]), r[0][:64].tobytes()))
    model = ToxicityModel.fit(learnt, totals, sample_counts(docs, joined([h for h, _ in learnt])))
    del learnt, flat, got
    release()  # the driver goes on without the training rows
    return model


def sample_counts(docs: DataFrame, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of the corpus: the sample's words (sorted) and their occurrences, all occurrences, and how
    many different words there are.  The whole table is counted; the sample's part is bounded."""
    spark = docs.sparkSession
    wanted = np.unique(sample)
    ids = spark.createDataFrame(pa.table({"word": pa.array(wanted.view(np.int64)), "ours": pa.array(np.ones(len(wanted), bool))}))
    counts = corpus_counts(docs).join(F.broadcast(ids), "word", "left")
    # one row for the words that are not ours
    found = counts.groupBy(F.when(F.col("ours"), F.col("word")).alias("word")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()
    n, kinds = found["n"].to_numpy(), found["kinds"].to_numpy()
    known = found["word"].is_valid().to_numpy() if found.num_rows else np.zeros(0, bool)
    word = found["word"].fill_null(0).to_numpy().view(np.uint64)[known]
    order = np.argsort(word)
    return word[order], n[known][order].astype(float), int(n.sum()), int(kinds.sum())


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and score.  The model's tables have the size of the bounded sample: its
    different words and pairs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def work(chunk):
        return [*(chunk.column(i) for i in range(len(keep))), shared.value.scores([t or "" for t in chunk.column(len(keep)).to_pylist()])]

    return map_rows(docs, [*keep, text_col], f"{kept}, score double", work)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
