"""Substring duplicates by content-defined chunking.

A gear hash rolls over the bytes of a text (each byte's random number, shifted by one bit a
step, so it depends on the last 16 bytes only); where its upper bits are zero a chunk ends.
Boundaries thus move with the text: an insertion changes the chunks it touches and no others,
and two copies of a passage are cut alike from some bytes after their start.  numpy computes
the rolling hash by doubling, 1, 2, 4 and 8 bytes at a time.

A window is a shortest row of whole neighbouring chunks with at least RUN_WORDS words: one
from each chunk on, and one back from each chunk where that is another.  It is known by a
96-bit cryptographic digest of its bytes, so a digest that stands in more than one document is
a stretch of RUN_WORDS words that another document holds as it stands, not a sum of common
phrases from many.  Any stretch of whole chunks with that many words is made of windows.

Texts are read and windows shuffled once: what meets its like there is stored, a small part.
Of windows that are alike within one Arrow batch only the first goes to their task, the others
(already known to be repeated) are dealt by salt, so a window that a third of all documents
share is a row a batch there.  Among what is stored, the first holders come from an aggregation
that combines in each task and are joined back, where Spark splits skewed keys.

The repeated passages of a document are the unions of its repeated windows that touch or
overlap and first stand in the same document.  Where a quote of one document lies in copies
of another, passages thus overlap at its edges, each with a first holder that has its text;
and as what is cut from a document stands in one with a smaller id, one copy of every text
stays.  At the edges a passage ends at the last whole chunk, so passages of over 50
words are found with about three fifths of their length or more, and what is shorter than
RUN_WORDS words (a licence line, a title) is left alone.

Defined results: null and empty texts have no chunks; rows that share an id are one document
and don't repeat each other, and places are of their own text; rows with a null id are neither counted nor reported, and
`drop_repeats` keeps them as they are; an empty table has no passages; other columns are not
read, and `drop_repeats` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, release, rows_in_chunks, scratch, shared_dir, small_batches, stored, table, written
from .hashing import BLANK_BYTE, as_bytes, mix

#: Mean bytes of a chunk (of the random cuts), least bytes between cuts, most bytes of a chunk.
MEAN, LEAST, MOST = 24, 6, 1024
RUN_WORDS = 15
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
#: Ways in which windows that are alike within a batch are dealt.
WAYS = 62


def rolled(raw: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, 16 bits."""
    h = GEAR[raw]
    for step in (1, 2, 4, 8):
        low = h.copy()
        low[step:] += h[:-step] << np.uint16(step)
        h = low
    return h


def cuts(raw: np.ndarray) -> np.ndarray:
    """Ends of the chunks of some bytes; the last is their length."""
    found = np.flatnonzero(rolled(raw) < 65536 // MEAN) + 1
    found = found[np.diff(found, prepend=-LEAST) >= LEAST]
    ends = np.append(found[found < len(raw)], len(raw))
    size = np.diff(ends, prepend=0)
    if size.max() > MOST:  # runs without a cut are cut at fixed steps from the last one
        parts = -(-size // MOST)
        first = np.repeat(ends - size, parts)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts) + 1
        ends = np.minimum(first + nth * MOST, np.repeat(ends, parts))
    return ends


def words_before(raw: np.ndarray) -> np.ndarray:
    """How many words start before each place."""
    solid = ~BLANK_BYTE[raw]
    return np.concatenate(([0], np.cumsum(solid & ~np.concatenate(([False], solid[:-1])))))


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each stretch of bytes, as 64 and 32."""
    all_ = b"".join(blake2b(raw[a:b], digest_size=12).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    parts = np.frombuffer(all_, np.dtype([("digest", "<i8"), ("tag", "<i4")]))
    return parts["digest"], parts["tag"]


def chunks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Digest of each chunk, and start << 22 | bytes << 11 | words that start in it."""
    raw = as_bytes(text)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = cuts(raw)
    starts = np.concatenate(([0], ends[:-1]))
    begun = words_before(raw)
    return digests(raw.tobytes(), starts, ends)[0], starts << 22 | (ends - starts) << 11 | (begun[ends] - begun[starts])


def text_key(raw: bytes) -> int:
    """64 bits that tell the texts of one id apart."""
    return int.from_bytes(blake2b(raw, digest_size=8).digest(), "little", signed=True)


def windows(text: str, run_words: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest of each window (64 and 32 bits), start << 32 | end, and words before it << 10 |
    words beyond run_words (in the last chunk or the first, so below 1024)."""
    raw = as_bytes(text)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.concatenate(([0], cuts(raw)))
    word = words_before(raw)[edge]
    last = len(edge) - 1
    to = np.maximum(np.searchsorted(word, word[:-1] + run_words), np.arange(1, last + 1))  # beyond last: none
    back = np.minimum(np.searchsorted(word, word[1:] - run_words, "right") - 1, np.arange(last))  # -1: none
    i = np.flatnonzero(to <= last)
    j = np.flatnonzero(back >= 0) + 1
    j = j[to[back[j - 1]] != j]
    a, b = np.concatenate((i, back[j - 1])), np.concatenate((to[i], j))
    return *digests(raw.tobytes(), edge[a], edge[b]), edge[a] << 32 | edge[b], word[a] << 10 | (word[b] - word[a] - run_words)


def window_rows(docs: DataFrame, run_words: int, keyed: bool) -> DataFrame:
    """(digest, tag, doc_id, key, place, words) for each window of each document (doc_id, text).
    The lowest six bits of words are 0 where a batch has the digest once, 1 for the first of
    several, beyond for the others, whose digests have their upper bits flipped by them and so
    go elsewhere.  Where no id repeats, all keys are 0 (and take no room)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows, keys = [], [], []
            for chunk in rows_in_chunks(iter([batch])):
                rows += chunk.column(0).to_pylist()
                for t in chunk.column(1).to_pylist():
                    found.append(windows(t or "", run_words))
                    keys.append(text_key((t or "").encode()) if keyed and len(found[-1][0]) else 0)
            if not rows:
                continue
            digest, tag, place, words = (np.concatenate([x[k] for x in found]) for k in range(4))
            _, first, of, times = np.unique(digest, return_index=True, return_inverse=True, return_counts=True)
            m = np.where(times[of] > 1, 2 + np.arange(len(digest)) % WAYS, 0).astype(np.int64)
            m[first[times > 1]] = 1
            digest = digest ^ np.where(m > 1, m << 58, 0)
            n = [len(x[0]) for x in found]
            columns = [digest, tag, np.repeat(np.array(rows, np.int64), n), np.repeat(np.array(keys, np.int64), n), place, words << 6 | m]
            for at in range(0, len(digest), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in columns], names=["digest", "tag", "doc_id", "key", "place", "words"])
        release()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "digest long, tag int, doc_id long, key long, place long, words long")


def united(key: np.ndarray, place: np.ndarray, words: np.ndarray, first: np.ndarray, run_words: int) -> list[tuple[int, int, int, int, int]]:
    """(key, start, end, n_words, first) of the passages that the repeated windows of a document make."""
    start, end = place >> 32, place & 0xFFFFFFFF
    order = np.lexsort((end, start, first, key))
    start, end, key, first = start[order], end[order], key[order], first[order]
    before = words[order] >> 10
    after = before + run_words + (words[order] & 1023)
    other = np.concatenate(([True], (key[1:] != key[:-1]) | (first[1:] != first[:-1])))
    group = np.cumsum(other) << 32
    reach = np.maximum.accumulate(group | end)
    new = np.flatnonzero(other | np.concatenate(([False], start[1:] > (reach[:-1] & 0xFFFFFFFF))))
    till = np.append(new[1:], len(start)) - 1
    n_words = (np.maximum.accumulate(group | after) & 0xFFFFFFFF)[till] - before[new]
    return list(zip(key[new].tolist(), start[new].tolist(), (reach[till] & 0xFFFFFFFF).tolist(), n_words.tolist(), first[new].tolist(), strict=True))


def passages(docs: DataFrame, id_col: str, text_col: str, run_words: int) -> DataFrame:
    """(doc_id, key, start, end, n_words, first_doc_id): repeated passages with the key of their
    text (0 if no id repeats), as a table in the shared folder."""
    run_words, spark = max(run_words, 1), docs.sparkSession
    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")

    def work(chunk):
        out = []
        for i, d in enumerate(chunk.column(0).to_pylist()):
            out += [(d, *r) for r in united(*(np.asarray(chunk.column(k)[i].values) for k in (1, 2, 3, 4)), run_words)]
        return list(map(list, zip(*out, strict=True))) if out else [[] for _ in range(6)]

    with scratch(spark):
        keyed = not some.groupBy("doc_id").count().where("count > 1").isEmpty()
        rows, m, alike = window_rows(some, run_words, keyed), F.col("words").bitwiseAND(63), Window.partitionBy("digest")
        met = rows.select("*", F.min("doc_id").over(alike).alias("low"), F.max("doc_id").over(alike).alias("high")).where((F.col("low") != F.col("high")) | (m != 0))
        digest = F.when(m > 1, F.col("digest").bitwiseXOR(F.shiftleft(m, 58))).otherwise(F.col("digest"))
        kept = stored(met.select(digest.alias("digest"), "tag", "doc_id", "key", "place", F.shiftright("words", 6).alias("words")), "windows")
        repeats = kept.groupBy("digest", "tag").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("digest", "tag", "first")
        marked = kept.join(repeats, ["digest", "tag"]).select("doc_id", "key", "place", "words", "first")
        gathered = marked.groupBy("doc_id").agg(F.collect_set(F.struct("key", "place", "words", "first")).alias("x")).select("doc_id", "x.key", "x.place", "x.words", "x.first")
        found = map_rows(gathered, ["doc_id", "key", "place", "words", "first"], "doc_id long, key long, start long, end long, n_words long, first_doc_id long", work)
        return written(found, shared_dir(spark), "passages")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_id) for each repeated passage: places in bytes;
    first_doc_id is the least id that holds it, window by window."""
    return passages(docs, id_col, text_col, run_words).drop("key")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """docs with the repeated passages cut out of all documents but the first of each; whole
    characters are cut."""
    spans = passages(docs, id_col, text_col, run_words).where("doc_id <> first_doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "key"))).alias("_spans"))
    packed = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.struct(*docs.columns).alias("_row"))
    joined = packed.join(spans.withColumnRenamed("doc_id", "_id"), "_id", "left")

    def work(chunk):
        out = []
        for t, spans in zip(chunk.column(1).to_pylist(), chunk.column(2).to_pylist(), strict=True):
            if t and spans:
                raw, at, kept = t.encode(), 0, []
                key = text_key(raw)
                for s in spans:
                    if s["key"] in (0, key) and s["end"] > at:
                        start, end = max(s["start"], at), s["end"]
                        while start < end and raw[start] & 0xC0 == 0x80:
                            start += 1
                        while start < end < len(raw) and raw[end] & 0xC0 == 0x80:
                            end -= 1
                        kept.append(raw[at:start])
                        at = end
                t = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
            out.append(t)
        return [chunk.column(0), out]

    cut = map_rows(joined, ["_row", "_text", "_spans"], T.StructType([joined.schema["_row"], T.StructField("_cut", T.StringType())]), work)
    return cut.select(*(F.col("_cut").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
