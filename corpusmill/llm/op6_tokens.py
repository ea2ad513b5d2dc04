"""Token ids in binary shards, each a wavelet matrix.

Writing.  Documents are dealt by ranges of their id and sorted, so that the shards in order
hold all ids in ascending order of the documents.  A task tokenizes its documents as they
come and closes a shard at SHARD_TOKENS ids, between documents: a shard is one compressed
file image with a document table and one bit-plane for each bit of an id.  Each plane lies
in blocks of 4096 bytes, compressed one by one where that makes them smaller, with the count
of ones before each block, so access, rank and select open a few blocks only.
Shards are rows (part, seq, start_in_part, n_tokens, payload) of a Parquet table in the
shared folder: Spark's own writer is the one that reaches every store and commits a task's
output once, however often the task ran.

Reading.  Each shard gives back its documents; what stands before a shard is its part's
total of earlier parts (one row a part, counted on the driver) plus its start in the part.

Defined results: a null text counts as empty and has the end id alone; rows go by id, nulls
first, and equal ids by the 64-bit hash of the text, then the text, however many partitions
there are; repeated rows are repeated in the files; an empty
table gives no shard; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, scratch, shared_dir, small_batches, stored, table, written
from .hashing import BLANK_BYTE, word_hashes

#: Ids after which a shard is closed (at the end of a document).
SHARD_TOKENS = 1 << 18
BLOCK = 4096
BITS = 16
#: Chunks of text at which a worker forgets half of them (about 45 bytes each).
CACHE_CHUNKS = 3_000_000
#: Text that is tokenized at a time.
BATCH_BYTES = 4 << 20
MAGIC = b"WMTX0001"
END_ID = 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Tokens:
    """The library's tokenizer behind a table of chunks, for whole batches of texts.

    The vocabulary's normalizer and splitter never join anything across white space, so a
    text's ids are those of its chunks between ASCII white space.  Chunks are found by the
    64-bit hash of their bytes in a sorted array, and their bytes are compared: all of a batch
    with the first of their hash, those with what the table holds.  A batch in which two chunks
    clash goes to the library without the table.  New chunks go there many in one call, with a
    special token between them (which it cuts out before all else).
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.get_vocab_size() > 1 << BITS:
            raise ValueError(f"an id needs more than {BITS} bits")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.between = self.specials[0]
        self.between_id = self.tokenizer.token_to_id(self.between)
        self.turn, self.key, self.pool, self.raw = 0, np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.uint8)
        self.at, self.size, self.raw_at, self.raw_size, self.used = (np.zeros(0, np.int32) for _ in range(5))

    def forget(self) -> None:
        """Keeps the half of the table that was used last."""
        keep = self.used > np.sort(self.used)[len(self.used) // 2]
        self.pool = self.pool[spread(self.at[keep], self.size[keep])]
        self.raw = self.raw[spread(self.raw_at[keep], self.raw_size[keep])]
        self.key, self.size, self.raw_size, self.used = self.key[keep], self.size[keep], self.raw_size[keep], self.used[keep]
        self.at, self.raw_at = (np.cumsum(x, dtype=np.int32) - x for x in (self.size, self.raw_size))

    def ask(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks in a row, and how many each has."""
        marked = [i for i, c in enumerate(chunks) if "<" in c and any(x in c for x in self.specials)]
        if marked:
            codes = [np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, np.uint32) for c in chunks]
            return np.concatenate(codes), np.array([len(c) for c in codes])
        ids, sizes = [], []
        for k in range(0, len(chunks), 4096):
            got = np.array(self.tokenizer.encode_batch_fast([self.between.join(chunks[k : k + 4096])], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(got == self.between_id)
            sizes.append(np.diff(np.concatenate(([-1], cut, [len(got)]))) - 1)
            ids.append(np.delete(got, cut))
        return np.concatenate(ids), np.concatenate(sizes)

    def learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        ids, size = self.ask([c.decode() for c in chunks])
        raw, raw_size = np.frombuffer(b"".join(chunks), np.uint8), np.array(list(map(len, chunks)))
        to = np.searchsorted(self.key, keys)
        self.key = np.insert(self.key, to, keys)
        self.at = np.insert(self.at, to, len(self.pool) + np.cumsum(size) - size)
        self.size = np.insert(self.size, to, size)
        self.raw_at = np.insert(self.raw_at, to, len(self.raw) + np.cumsum(raw_size) - raw_size)
        self.raw_size = np.insert(self.raw_size, to, raw_size)
        self.used = np.insert(self.used, to, self.turn)
        self.pool, self.raw = np.concatenate((self.pool, ids.astype(np.uint16))), np.concatenate((self.raw, raw))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts in a row, and how many each has."""
        self.turn += 1
        parts = [t.encode() for t in texts]
        raw = np.frombuffer(b"\n".join(parts), np.uint8)
        text_end = np.cumsum([len(x) + 1 for x in parts]) - 1
        hashes, start, end = word_hashes(raw, ~BLANK_BYTE[raw])
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        keys, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        length = end - start
        clash = not same_bytes(raw, start, length, raw, start[first][of], length[first][of])
        if len(self.key) > CACHE_CHUNKS:
            self.forget()
        to = np.searchsorted(self.key, keys)
        old = np.zeros(len(keys), bool) if not len(self.key) else self.key[np.minimum(to, len(self.key) - 1)] == keys
        clash = clash or not same_bytes(raw, start[first[old]], length[first[old]], self.raw, self.raw_at[to[old]], self.raw_size[to[old]])
        data = raw.tobytes()
        if clash:
            ids, size = self.ask([data[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        else:
            if not old.all():
                new = first[~old]
                self.learn(keys[~old], [data[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
                to = np.searchsorted(self.key, keys)
            self.used[to] = self.turn
            size = self.size[to][of]
            ids = self.pool[spread(self.at[to][of], size)].astype(np.uint32)
        upto = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(start, text_end)]
        return ids, np.diff(np.concatenate(([0], upto)))


def same_bytes(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> bool:
    """Whether all runs of a are those of b, byte for byte."""
    return bool((a_size == b_size).all()) and bool((a[spread(a_at, a_size)] == b[spread(b_at, b_size)]).all())


def spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes of the runs that begin at at and have the sizes."""
    end = np.cumsum(size, dtype=np.int64)
    return np.repeat(at - (end - size), size) + np.arange(end[-1] if len(end) else 0)


@lru_cache(maxsize=2)
def _tokens(spec: str) -> Tokens:
    return Tokens(spec)


def shard(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard's file image."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    valid = np.array([d is not None for d in doc_ids], bool)
    head = squeeze(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.packbits(valid).tobytes() + np.array(lengths, "<u4").tobytes())
    v, planes, blocks = ids.astype(np.uint16), [], []
    for level in range(BITS):
        bit = (v & np.uint16(1 << (BITS - 1 - level))) != 0
        raw = np.packbits(bit)
        ones = np.concatenate(([0], np.bitwise_count(raw).cumsum(dtype=np.int64)[BLOCK - 1 :: BLOCK]))[: -(-len(raw) // BLOCK)]
        v = np.concatenate((np.compress(~bit, v), np.compress(bit, v)))
        sizes = []
        for at in range(0, len(raw), BLOCK):
            plain = raw[at : at + BLOCK].tobytes()
            small = squeeze(plain)
            blocks.append(small if len(small) < len(plain) else plain)
            sizes.append(len(blocks[-1]))
        planes.append(struct.pack("<I", int(len(ids) - bit.sum())) + np.array(ones, "<u4").tobytes() + np.array(sizes, "<u4").tobytes())
    return MAGIC + struct.pack("<IIII", len(doc_ids), len(ids), BITS, len(head)) + head + b"".join(planes) + b"".join(blocks)


class WaveletMatrix:
    """Reads a shard's image; blocks are opened when they are needed."""

    def __init__(self, image: bytes):
        if image[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.docs, self.n, self.bits, head = struct.unpack_from("<IIII", image, 8)
        self.open = zstandard.ZstdDecompressor().decompress
        raw = self.open(image[24 : 24 + head])
        valid = np.unpackbits(np.frombuffer(raw[8 * self.docs : -4 * self.docs or None], np.uint8))[: self.docs].astype(bool)
        self.doc_ids = [int(d) if ok else None for d, ok in zip(np.frombuffer(raw[: 8 * self.docs], "<i8"), valid, strict=True)]
        self.lengths = np.frombuffer(raw[len(raw) - 4 * self.docs :], "<u4").astype(np.int64)
        self.plane_bytes = -(-self.n // 8)
        count, at = -(-self.plane_bytes // BLOCK), 24 + head
        self.zeros, self.ones, sizes = [], [], []
        for _ in range(self.bits):
            self.zeros.append(struct.unpack_from("<I", image, at)[0])
            self.ones.append(np.frombuffer(image, "<u4", count, at + 4))
            sizes.append(np.frombuffer(image, "<u4", count, at + 4 + 4 * count))
            at += 4 + 8 * count
        ends = at + np.cumsum(np.concatenate(sizes).astype(np.int64)) if count else np.zeros(0, np.int64)
        self.where = [(int(e - s), int(e)) for e, s in zip(ends, np.concatenate(sizes) if count else [], strict=True)]
        self.count, self.image, self.kept = count, image, {}

    def block(self, level: int, k: int) -> bytes:
        if (level, k) not in self.kept:
            a, b = self.where[level * self.count + k]
            size = min(BLOCK, self.plane_bytes - k * BLOCK)
            self.kept[level, k] = self.image[a:b] if b - a == size else self.open(self.image[a:b])
        return self.kept[level, k]

    def _bit(self, level: int, i: int) -> int:
        return self.block(level, i // (8 * BLOCK))[i // 8 % BLOCK] >> (7 - i % 8) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        k, rest = divmod(i, 8 * BLOCK)
        if k == self.count:
            return self.n - self.zeros[level]
        if not rest:
            return int(self.ones[level][k])
        part = self.block(level, k)[: rest // 8 + 1]
        return int(self.ones[level][k]) + (int.from_bytes(part, "big") >> (8 * len(part) - rest)).bit_count()

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, value: int, end: int) -> int:
        """Occurrences of the id before place end."""
        start = 0
        for level in range(self.bits):
            a, b = self._rank1(level, start), self._rank1(level, end)
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.bits - 1 - level) & 1 else (start - a, end - b)
        return end - start

    def total(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence, by bisection on rank; -1 if there are fewer."""
        if k >= self.total(value):
            return -1
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.rank(value, mid) > k else (mid + 1, high)
        return low - 1

    def ids(self) -> np.ndarray:
        """All ids, rebuilt from the lowest plane up."""
        v = np.zeros(self.n, np.uint16)
        for level in range(self.bits - 1, -1, -1):
            raw = np.frombuffer(b"".join(self.block(level, k) for k in range(self.count)), np.uint8)
            bit = np.unpackbits(raw, count=self.n).view(bool)
            up, zeros = np.empty_like(v), self.zeros[level]
            up[np.flatnonzero(~bit)] = v[:zeros]
            up[np.flatnonzero(bit)] = v[zeros:] | np.uint16(1 << (self.bits - 1 - level))
            v = up
        return v


def by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about BATCH_BYTES of text each."""
    for batch in batches:
        rows = max(1, int(BATCH_BYTES / max(batch.nbytes / max(batch.num_rows, 1), 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards to the shared folder; returns the table of them, as read again."""
    small_batches(docs.sparkSession)
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = _tokens(spec.value), TaskContext.get().partitionId()
        seq = start = 0
        doc_ids, lengths, codes, held = [], [], [], 0

        def closed():
            ids = np.concatenate(codes)
            if len(ids) and ids.max() >= 1 << BITS:
                raise ValueError(f"an id needs more than {BITS} bits")
            image = shard(doc_ids, lengths, ids)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "start_in_part": pa.array([start], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64()), "payload": pa.array([image], pa.binary())})

        for chunk in by_bytes(batches):
            ids, size = tokens.encode_all([t or "" for t in chunk.column(1).to_pylist()])
            ids, size = np.insert(ids, np.cumsum(size), end_id), size + 1
            done = 0
            for d, n in zip(chunk.column(0).to_pylist(), size.tolist(), strict=True):
                doc_ids.append(d)
                lengths.append(n)
                codes.append(ids[done : done + n])
                done, held = done + n, held + n
                if held >= shard_tokens:
                    yield closed()
                    seq, start, held = seq + 1, start + held, 0
                    doc_ids.clear(), lengths.clear(), codes.clear()
        if doc_ids:
            yield closed()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    by = ["doc_id", F.xxhash64("text")]  # the same keys for ranges and for the order inside them
    ordered = ordered.repartitionByRange(*by).sortWithinPartitions(*by, "text")
    return stored(ordered.mapInArrow(run, "part int, seq int, start_in_part long, n_tokens long, payload binary"), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards."""
    spark = shards.sparkSession
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each write task
    before, bases = 0, []
    for part, n in totals:
        bases.append((part, before))
        before += n
    located = shards.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").select((F.col("base") + F.col("start_in_part")).alias("start"), "payload")

    def work(chunk):
        out_doc, out_start, out_n, out_crc = [], [], [], []
        for start, image in zip(chunk.column(0).to_pylist(), chunk.column(1), strict=True):
            matrix = WaveletMatrix(image.as_py())
            raw = memoryview(matrix.ids().astype("<u4").tobytes())
            ends = np.cumsum(matrix.lengths)
            out_doc += matrix.doc_ids
            out_n += matrix.lengths.tolist()
            out_start += (start + ends - matrix.lengths).tolist()
            out_crc += [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - matrix.lengths).tolist(), ends.tolist(), strict=True)]
        return [out_doc, out_start, out_n, out_crc]

    return map_rows(located, ["start", "payload"], "doc_id long, start long, n_tokens long, ids_crc32 long", work)


def occurrences(shards: DataFrame, ids: list[int]) -> DataFrame:
    """(id, n): how often each id stands in the shards, by rank on the bit-planes: only the
    blocks that it needs are opened."""
    wanted = sorted(set(ids))

    def work(chunk):
        found = [[m.total(v) for v in wanted] for m in map(WaveletMatrix, chunk.column(0).to_pylist())]
        return [wanted * len(found), [n for row in found for n in row]]

    return map_rows(shards, ["payload"], "id int, n long", work).groupBy("id").agg(F.sum("n").alias("n"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):  # the shards go when they have been read back
        return written(read_shards(write_shards(table(spark, sf_dir, "documents"))), shared_dir(spark), "token-rows")
