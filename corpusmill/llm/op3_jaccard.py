"""N-gram Jaccard join by universe partition and pigeonhole, with exact verification.

A document is the set of its distinct word shingles.  Documents whose words are the same in
the same order form one class (by a 128-bit cryptographic digest); classes are joined.

Exactness.  A shingle is counted and compared by its words: within a text, and between two
texts, words become numbers by their bytes and shingles numbers by pairs of numbers.  64-bit
hashes of shingles serve for the filter alone, where a clash can only bring one more candidate:
equal shingles have equal hashes, so a set keeps as many hashes as it has shingles, and what
similar sets share they share in hashes as well.

Filter.  Sets are put into bands by size, such that similar sets lie in the same band or in
neighbouring ones; each set appears in its own band and in the one below.  For a band, at
most H hashes differ between similar sets.  The range of the hash is cut into m segments, and
a set's signature for a segment is a hash of its members there.  Since H differences spoil at
most H segments, similar sets agree on one of the others.  The plan of a band is chosen by
cost: either full signatures of H + 1 segments and some spare ones, of which a set leaves out
the smallest (the least selective) as far as the pigeonhole allows; or, for small sets, half
as many segments with their one-deletion neighbourhoods (signatures of the segment without
one member), which also bear a single difference in the segment.  Empty segments have no
signature; the rare sets whose segments don't suffice are matched through a second table of
empty segments.

Candidates.  Rows that share a signature form a bucket.  One shuffle of (signature, id) finds
those of more than one row; of rows that share a signature within a group of GROUP documents only
the first goes to the bucket's task, the others (already known to have company) are dealt by salt,
so a signature that a third of all rows hold doesn't meet in one task.  In buckets of up to
SMALL members all are compared.  Beyond, each round takes leaders and compares them with the
members that they aren't linked with so far; what is verified is contracted into components,
and a bucket is done when its members that never led lie in one component, so no link between
different components is lost however large the bucket.  The leaders of a bucket become four
times as many each round.  Leaders are found by group limits and joined to members by joins
whose skewed partitions Spark splits.

Before a pair is verified, its sizes and the sets' parity sketches (512 bits; d differing
members change at most d of them) must leave room for similarity.

Verification.  A leader's text is read once for a salted part of its partners, which stream
past it.  Components are found by contraction of the links, in tables; new links are
contracted over the roots of the old ones.  Nothing of that size reaches the driver; tables
are removed when their successors are stored.

Defined results: a null, empty or blank text has no shingles and is its own component; a text
of fewer words than a shingle is one shingle; rows that share an id count as one document,
linked by all their texts; a null id is linked with nothing and has no component; ties and
repeated rows are classes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from hashlib import blake2b
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, map_rows, release, rows_in_chunks, scratch, shared_dir, small_batches, stored, table, written
from .hashing import BLANK_BYTE, as_bytes, mix, word_hashes

SHINGLE, SIMILAR = 4, 85
#: Chance that a set's segments don't suffice, from which a plan counts as good.
RARE = 1e-6
#: Mean members of a segment below which full signatures are no choice.
LEAST_MEMBERS = 2.2
#: Words of 64 bits in a set's parity sketch.
SKETCH = 8
#: Buckets up to this size are compared at once; larger ones by leaders.
SMALL = 6
#: Ids that may be broadcast (16 MB), and pairs; beyond that they are joined by a shuffle.
BROADCAST_IDS, BROADCAST_PAIRS = 1_000_000, 100_000
#: Partners of a leader that one task reads.
SALT_ROWS = 256
#: Documents among whose signatures repeats are found at once, and ways in which these are dealt.
GROUP, WAYS = 1024, 62
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SKETCHES = [f"k{i}" for i in range(SKETCH)]


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than 32 and 9 to 13, A-Z lower-cased (bytes know ASCII only)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Grams:
    """The distinct shingles of a text, numbered exactly.

    Words are numbered by their bytes.  Two neighbouring (or overlapping) runs make a longer
    run, numbered by the pair of their numbers, until runs are as long as a shingle.
    """

    def __init__(self, found: list[bytes], size: int):
        self.size = min(size, len(found))
        self.number = dict(zip(dict.fromkeys(found), count()))
        now = np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))
        self.levels, run = [], 1
        self.first = np.unique(now, return_index=True)[1] if self.size == 1 else now[:0]
        while run < self.size:
            step = min(run, self.size - run)
            most = int(now.max()) + 1
            pair = now[: len(now) - step] * most + now[step:]
            known, self.first, now = np.unique(pair, return_index=True, return_inverse=True)
            self.levels.append((step, most, known))
            run += step

    @property
    def n(self) -> int:
        return len(self.first)

    def hashes(self, text: str) -> np.ndarray:
        """Sorted 64-bit hashes, one for each shingle of the text."""
        raw = LOWER[as_bytes(text)]
        h = word_hashes(raw, ~BLANK_BYTE[raw])[0]
        total = np.full(len(self.first), np.uint64(self.size))
        for i in range(self.size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + h[self.first + i]
            total ^= total >> np.uint64(29)
        return np.sort(mix(total))

    def shared(self, found: list[bytes], size: int) -> int:
        """How many distinct shingles of the other text are among these."""
        if min(size, len(found)) != self.size:
            return 0
        now = np.fromiter((self.number.get(w, -1) for w in found), np.int64, len(found))
        for step, most, known in self.levels:
            left, right = now[: len(now) - step], now[step:]
            pair = np.where((left >= 0) & (right >= 0), left * most + right, -1)
            at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
            now = np.where(known[at] == pair, at, -1)
        return len(np.unique(now[now >= 0]))


def digest(found: list[bytes]) -> bytes | None:
    """128 bits that name the words in their order; none without words."""
    return blake2b(b" ".join(found), digest_size=16).digest() if found else None


def enough(both: int, a: int, b: int, percent: int) -> bool:
    return both > 0 and 100 * both >= percent * (a + b - both)


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int
    differ: int  # H
    segments: int
    deletions: bool

    @cached_property
    def bounds(self) -> np.ndarray:
        return np.array([(i << 64) // self.segments for i in range(1, self.segments)], np.uint64)

    @cached_property
    def salts(self) -> np.ndarray:
        return mix(np.arange(self.segments, dtype=np.uint64) + np.uint64(self.number << 32 | 1))


def _short(m: int, need: int, n: int) -> float:
    """Bound on the chance that n random members fill fewer than need of m segments."""
    if need <= 1:
        return 0.0
    ways = math.lgamma(m + 1) - math.lgamma(need) - math.lgamma(m - need + 2)
    return math.exp(min(ways + n * math.log((need - 1) / m), 0.0))


class Plan:
    """Bands of sizes and their segments for a similarity in per cent."""

    def __init__(self, percent: int = SIMILAR):
        self.percent, self.bands, self.low = percent, [], []

    def _differ(self, low: int, high: int) -> int:
        top = high + high * 100 // self.percent
        return max(s - 2 * -(-self.percent * s // (100 + self.percent)) for s in range(max(2 * low, top - 250), top + 1))

    def _extend(self) -> None:
        low = self.bands[-1].high + 1 if self.bands else 1
        high = low * 100 // self.percent
        differ = self._differ(low, high)
        need, half = differ + 1, -(-(differ + 1) // 2)
        choices = []
        for m in range(need, 2 * need + 12):
            if _short(m, need, low) <= RARE and (low >= LEAST_MEMBERS * m or differ == 0):
                spare = (m - need) // 2
                choices += [(m - spare, m, False)]
        for m in range(half, 2 * half + 12):
            if _short(m, half, low) <= RARE:
                choices += [(m + high, m, True)]
        _, m, deletions = min(choices, default=(0, half, True))
        self.bands.append(Band(len(self.bands), low, high, differ, m, deletions))
        self.low.append(low)

    def of(self, n: int) -> int:
        while not self.bands or self.bands[-1].high < n:
            self._extend()
        return int(np.searchsorted(np.array(self.low), n, "right")) - 1

    def signatures(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signatures, keys of empty segments, and keys that the set needs among those."""
        sigs, empty, needed = [], [], []
        if len(s):
            own = self.of(len(s))
            value = mix(s ^ np.uint64(0x1234567))
            upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
            for band in self.bands[max(own - 1, 0) : own + 1]:
                cut = np.concatenate(([0], np.searchsorted(s, band.bounds), [len(s)]))
                size, total = np.diff(cut), upto[cut[1:]] - upto[cut[:-1]]
                full = np.flatnonzero(size)
                n, need = len(full), band.differ + 1
                blank = mix(band.salts ^ np.uint64(0xE))
                if band.deletions:
                    segment = np.repeat(np.arange(band.segments), size)
                    more = size[segment] > 1
                    sigs.append(mix((total[segment] - value)[more] + band.salts[segment[more]]))
                    bare = blank[size <= 1]
                    # a segment of one member bears no difference: without it nothing is left to match
                    suffices = n + int((size > 1).sum()) >= need
                else:
                    bare = blank[size == 0]
                    suffices = n >= need
                    if n > need + 1:
                        full = full[np.argsort(-size[full], kind="stable")][: n - (n - need) // 2]
                sigs.append(mix(total[full] + band.salts[full]))
                empty.append(bare)
                if not suffices:
                    needed.append(bare)
        none = [np.zeros(0, np.uint64)]
        return tuple(np.concatenate(x or none).view(np.int64) for x in (sigs, empty, needed))


@lru_cache(maxsize=4)
def _plan(percent: int) -> Plan:
    return Plan(percent)


def digests(docs: DataFrame) -> DataFrame:
    """A row a row of docs (doc_id, text): doc_id, dg (digest of the words, none without)."""
    return map_rows(docs, ["doc_id", "text"], "doc_id long, dg binary", lambda chunk: [chunk.column(0), [digest(words(t)) for t in chunk.column(1).to_pylist()]])


def signature_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(sig, doc, m) for every signature.  m is 0 where a group of documents has it once, 1 for the
    first of several, beyond for the others; keys of empty segments that a set needs have -1.
    A row with m = -2 - n for each text holds the size n of its set and, as sig, its digest's
    first 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = _plan(percent)
        for batch in (b.slice(at, GROUP) for b in batches for at in range(0, b.num_rows, GROUP)):
            sigs, needs, rows, names, sizes = [], [], [], [], []
            for chunk in rows_in_chunks(iter([batch])):
                for d, t in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), strict=True):
                    if found := words(t):
                        g = Grams(found, size)
                        s, _, needed = plan.signatures(g.hashes(t))
                        rows.append(d)
                        sigs.append(s)
                        needs.append(needed)
                        names.append(int.from_bytes(digest(found)[:8], "big", signed=True))
                        sizes.append(-2 - g.n)
            if not rows:
                continue
            ids, flat, more = np.array(rows, np.int64), np.concatenate(sigs), np.concatenate(needs)
            _, first, of, times = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
            m = np.where(times[of] > 1, 2 + np.arange(len(flat)) % WAYS, 0).astype(np.int32)
            m[first[times > 1]] = 1
            sig = np.concatenate((flat, more, np.array(names, np.int64)))
            doc = np.concatenate((np.repeat(ids, [len(x) for x in sigs]), np.repeat(ids, [len(x) for x in needs]), ids))
            m = np.concatenate((m, np.full(len(more), -1, np.int32), np.array(sizes, np.int32)))
            for at in range(0, len(sig), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (sig, doc, m)], names=["sig", "doc", "m"])
        release()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "sig long, doc long, m int")


def empty_segments(docs: DataFrame, keys: list[int], size: int, percent: int) -> DataFrame:
    """(key, b) for every set that has one of the segments empty."""
    wanted = np.array(sorted(keys), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = _plan(percent)
        for chunk in rows_in_chunks(batches):
            got = [np.intersect1d(plan.signatures(Grams(words(t), size).hashes(t or ""))[1], wanted) for t in chunk.column(1).to_pylist()]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got), pa.int64()), pa.array(np.repeat(np.array(chunk.column(0).to_pylist(), np.int64), [len(x) for x in got]))], names=["key", "b"])
        release()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "key long, b long")


def sketch(s: np.ndarray) -> list[int]:
    """Parity of the members at each of 512 places: sets that differ in d members differ in at
    most d bits."""
    odd = np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def may_be_similar(percent: int) -> Column:
    """Whether sizes and sketches of the two sides (…_a, …_b) leave room for similarity."""
    total = F.col("n_a") + F.col("n_b")
    most = total - 2 * F.ceil(total * percent / (100 + percent))
    apart = F.lit(0)
    for k in SKETCHES:
        apart = apart + F.bit_count(F.col(f"{k}_a").bitwiseXOR(F.col(f"{k}_b")))
    return (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent) & (apart <= most)


def few(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def keyed(df: DataFrame, ids: DataFrame, col: str, how: str) -> DataFrame:
    """df semi- or anti-joined with distinct ids (one column of the same name); the ids are
    broadcast only when they are counted to be few."""
    return df.join(F.broadcast(ids) if few(ids, BROADCAST_IDS) else ids, col, how)


def contracted(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the links (a, b): equal roots for connected nodes.

    Each turn every node moves to the neighbour (or itself) of least rank; links that have
    become loops go.  Ranks are the ids in the first turn, which ends stars around a least id,
    and random later, which leaves a fraction of the nodes each turn.
    """
    spark = edges.sparkSession
    edges = stored(edges.where("a <> b").distinct(), "links")
    roots, turn = None, 0
    while not edges.isEmpty():
        rank = lambda c: F.xxhash64(F.lit(turn), c) if turn else c  # noqa: B023, E731
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        best = both.groupBy("v").agg(F.min(F.struct(rank(F.col("w")).alias("r"), F.col("w"))).alias("x"))
        moved = stored(best.select("v", F.when(F.struct(rank(F.col("v")).alias("r"), F.col("v").alias("w")) < F.col("x"), F.col("v")).otherwise(F.col("x.w")).alias("to")), "moved")
        step = lambda df, c: df.join(moved.withColumnRenamed("v", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023, E731
        old_roots, old_edges = roots, edges
        named = moved.select(F.col("v").alias("node"), F.col("to").alias("root"))
        roots = stored(named if roots is None else step(roots, "root").unionByName(named.join(roots.select("node"), "node", "left_anti")), "roots")
        edges = stored(step(step(edges, "a"), "b").where("a <> b").distinct(), "links")
        discard(moved, old_roots, old_edges)
        turn += 1
    discard(edges)
    return roots if roots is not None else spark.createDataFrame([], "node long, root long")


def rooted(df: DataFrame, roots: DataFrame | None, col: str, name: str) -> DataFrame:
    """df with the root of the node in col, which is itself where it has none."""
    if roots is None:
        return df.withColumn(name, F.col(col))
    return df.join(roots.select(F.col("node").alias(col), F.col("root").alias("_root")), col, "left").withColumn(name, F.coalesce("_root", col)).drop("_root")


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The roots after new links, which are contracted over the old roots."""
    new = contracted(rooted(rooted(links, roots, "a", "ra"), roots, "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    if roots is None:
        return new
    moved = rooted(roots.withColumnRenamed("root", "old"), new, "old", "root").select("node", "root")
    out = stored(moved.unionByName(new.join(roots.select("node"), "node", "left_anti")), "roots")
    discard(roots, new)
    return out


def texts_of(docs: DataFrame, ids: DataFrame, repeats: bool, size: int) -> DataFrame:
    """(doc, dg, n, sketch, text) of the documents with these ids; a text once an id."""

    def work(chunk):
        out = []
        for d, t in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), strict=True):
            if found := words(t):
                g = Grams(found, size)
                out.append((d, digest(found), g.n, *sketch(g.hashes(t)), t))
        return list(map(list, zip(*out, strict=True))) if out else [[] for _ in range(4 + SKETCH)]

    some = keyed(docs, ids.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")
    found = map_rows(some, ["doc_id", "text"], ", ".join(["doc long, dg binary, n int", *(f"{k} long" for k in SKETCHES), "text string"]), work)
    return stored(found.dropDuplicates(["doc", "dg"]) if repeats else found, "texts")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents with similar sets; each a is read once for a part of its b."""
    side = lambda x: texts.select(*(F.col(c).alias(c if c == "doc" else f"{c}_{x}") for c in ["doc", "dg", "n", *SKETCHES])).withColumnRenamed("doc", x)
    near = stored(pairs.join(side("b"), "b").join(side("a"), "a").where(may_be_similar(percent)).select("a", "dg_a", "b", "dg_b"), "near")
    small = few(near, BROADCAST_PAIRS)
    parts = near.groupBy("a", "dg_a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("parts"))
    parts = parts if small else stored(parts, "parts")  # then Spark splits the join's skewed keys
    salted = near.join(F.broadcast(parts) if small else parts, ["a", "dg_a"]).select("a", "dg_a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "dg_b")
    heads = parts.select("a", "dg_a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    wanted = salted.select("a", "dg_a", "part", F.lit(1).alias("member"), F.col("b").alias("doc"), F.col("dg_b").alias("dg")).unionByName(heads.select("a", "dg_a", "part", F.lit(0).alias("member"), F.col("a").alias("doc"), F.col("dg_a").alias("dg")))
    wanted = F.broadcast(wanted) if small else wanted
    met = texts.select("doc", "dg", "n", "text").join(wanted, ["doc", "dg"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for chunk in rows_in_chunks(batches):
            left, right = [], []
            for a, dg, part, member, b, n, t in zip(*(chunk.column(i).to_pylist() for i in range(7)), strict=True):
                if not member:
                    head, own = (a, dg, part), Grams(words(t), size)
                elif head == (a, dg, part) and enough(own.shared(words(t), size), own.n, n, percent):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
        release()

    ordered = met.select("a", "dg_a", "part", "member", "doc", "n", "text").repartition("a", "dg_a", "part").sortWithinPartitions("a", "dg_a", "part", "member")
    found = stored(ordered.mapInArrow(run, "a long, b long").distinct(), "verified")
    discard(near, parts)
    return found


def once(pairs: DataFrame) -> DataFrame:
    """Each pair once, in one of the directions that it came in."""
    return pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("a").alias("a")).select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"))


def node_links(nodes: DataFrame, repeats: bool, size: int, percent: int, every: bool = False) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Links (a, b) between the documents of nodes (doc_id, text), enough to connect all that are
    linked or every link; the roots that they make; and (doc, name, n) with the sizes of sets."""
    spread = signature_rows(nodes, size, percent)
    same = Window.partitionBy("sig", F.greatest("m", F.lit(1)))
    spread = spread.withColumn("c", F.count("*").over(same)).where("c > 1 OR m <> 0").drop("c")
    buckets = stored(spread, "buckets")
    sizes = stored(buckets.where("m < -1").select("doc", F.col("sig").alias("name"), (-2 - F.col("m")).alias("n")).distinct(), "sizes")
    short = buckets.where("m = -1").select(F.col("doc").alias("a"), F.col("sig").alias("key"))
    # what shares most signatures leads: of near copies the one in the middle
    active = buckets.where("m >= 0").select("sig", "doc")
    active = stored(active.join(active.groupBy("doc").agg(F.count("*").alias("w")), "doc"), "active")
    # the first of each bucket; map tasks pass on no more than that of any signature
    order = Window.partitionBy("sig").orderBy(F.desc("w"), "doc")
    ranked = active.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SMALL + 1)
    heads = stored(ranked.groupBy("sig").agg(F.array_sort(F.collect_set("doc")).alias("docs"), F.max("k").alias("k"), F.min_by("doc", "k").alias("a")).where("k > 1"), "heads")
    large = heads.where(F.col("k") > SMALL).select("sig", "a")
    members = stored(active.join(large, "sig").where("doc <> a"), "members")
    each = F.flatten(F.transform("docs", lambda x, i: F.transform(F.slice("docs", i + 2, SMALL), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = heads.where(F.col("k") <= SMALL).select(F.explode(each).alias("p")).select("p.a", "p.b").unionByName(members.select("a", F.col("doc").alias("b")))
    if not short.isEmpty():
        keys = [r["key"] for r in short.select("key").distinct().collect()]  # at most the segments of the plan
        pairs = pairs.unionByName(short.join(empty_segments(nodes, keys, size, percent), "key").where("a <> b").select("a", "b"))
    pairs = stored(once(pairs), "pairs")
    discard(heads, active, buckets)
    texts = texts_of(nodes, pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct(), repeats, size)
    links = verified(pairs, texts, size, percent)
    roots = None if every else merged(None, links)
    discard(pairs)
    members, leaders_now = members.drop("a"), 4
    sketches = texts.select("doc", "n", *SKETCHES)
    while True:
        # members: those that have not led yet, in buckets that aren't done
        now = rooted(members, roots, "doc", "root")
        main = now.groupBy("sig", "root").agg(F.count("*").alias("k")).groupBy("sig").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("k", "root")).alias("main")).where("roots > 1").drop("roots")
        main = stored(main, "main")
        if main.isEmpty():
            break
        open_ = stored(now.join(main, "sig"), "open")
        leaders = open_.where("root <> main").withColumn("k", F.row_number().over(order)).where(F.col("k") <= leaders_now).select("sig", "doc", "root")
        leaders = stored(leaders, "leaders")
        lead, other = (x.select("sig", "doc", "root").join(sketches, "doc") for x in (leaders, open_))
        lead, other = (x.select("sig", *(F.col(c).alias(f"{c}_{k}") for c in x.columns if c != "sig")) for x, k in ((lead, "a"), (other, "b")))
        met = lead.join(other, (lead["sig"] == other["sig"]) & (F.col("root_a") != F.col("root_b")) & may_be_similar(percent))
        pairs = stored(once(met.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))), "pairs")
        found = verified(pairs, texts, size, percent)
        left = stored(open_.select("sig", "doc", "w").join(leaders.select("sig", "doc"), ["sig", "doc"], "left_anti"), "members")
        roots = roots if every else merged(roots, found)
        links = stored(links.unionByName(found).distinct(), "links")
        discard(main, open_, leaders, pairs, found, members)
        members, leaders_now = left, leaders_now * 4
    return links, roots, sizes


def prepared(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, bool]:
    """(rows, members, nodes, extra, repeats): doc_id, digest and representative of each row;
    (doc_id, lo) with the least representative of each document; the representatives' texts;
    links by repeated ids, if there are any."""
    plain = plain_rows(docs, id_col, text_col)
    rows = stored(digests(plain), "digests")
    classes = stored(rows.where("doc_id IS NOT NULL AND dg IS NOT NULL").groupBy("dg").agg(F.min("doc_id").alias("rep")), "classes")
    rows = stored(rows.join(classes, "dg", "left"), "rows")
    by_id = rows.where("doc_id IS NOT NULL AND dg IS NOT NULL").select("doc_id", "rep")
    members = stored(by_id.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("k")), "docs")
    repeats = not members.where("k > 1").isEmpty()
    extra = by_id.join(members.where("lo <> hi").select("doc_id", "lo"), "doc_id").select(F.col("lo").alias("a"), F.col("rep").alias("b"))
    # a document is a node if its text (or one of them) is the first of its class
    copies = members.where("hi < doc_id").select("doc_id")
    nodes = keyed(plain.where("doc_id IS NOT NULL"), copies, "doc_id", "left_anti")
    return rows, members, nodes, extra, repeats


def _components(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id), read from tables of the scratch folder."""
    rows, members, nodes, extra, repeats = prepared(docs, id_col, text_col)
    _, roots, sizes = node_links(nodes, repeats, size, percent)
    roots = merged(roots, extra) if repeats else roots
    homes = stored(rooted(members.select("doc_id", "lo"), roots, "lo", "root"), "homes")
    least = stored(homes.groupBy("root").agg(F.min("lo").alias("component_id")), "least")
    by_id = homes.join(least, "root").select("doc_id", "component_id")
    # the first 64 bits of a digest tell the texts of one representative apart
    name = F.conv(F.substring(F.hex("dg"), 1, 16), 16, -10).cast("long")
    named = rows.where("doc_id IS NOT NULL").withColumn("name", name).join(sizes.withColumnRenamed("doc", "rep"), ["rep", "name"], "left").join(by_id, "doc_id", "left")
    out = named.select(F.col("doc_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.when(F.col("dg").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.unionByName(without_id(plain_rows(docs, id_col, text_col), size))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.  The result is a table in the
    shared folder; what was stored on the way to it is removed."""
    spark = docs.sparkSession
    with scratch(spark):
        return written(_components(docs, id_col, text_col, size, percent).withColumnRenamed("doc_id", id_col), shared_dir(spark), "components")


def plain_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def without_id(plain: DataFrame, size: int) -> DataFrame:
    """The rows without an id, which are linked with nothing."""
    sized = map_rows(plain.where("doc_id IS NULL"), ["doc_id", "text"], "doc_id long, n_shingles long", lambda chunk: [chunk.column(0), [Grams(words(t), size).n for t in chunk.column(1).to_pylist()]])
    return sized.withColumn("component_id", F.lit(None).cast("long"))


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Every link between different texts, once, as a pair (a, b) of representatives, a < b, and
    the members (doc_id, rep) of the classes that they represent.  A row that repeats an id stands
    for each class that one of its texts is in."""
    spark = docs.sparkSession
    with scratch(spark):
        rows, _, nodes, _, repeats = prepared(docs, id_col, text_col)
        links, _, _ = node_links(nodes, repeats, size, percent, every=True)
        pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        classes = rows.where("doc_id IS NOT NULL AND dg IS NOT NULL").select(F.col("doc_id").alias(id_col), "rep").distinct()
        return written(pairs, shared_dir(spark), "pairs"), written(classes, shared_dir(spark), "classes")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates (the one with the smallest id).
    Documents without shingles and rows without an id stay; of rows that repeat an id and stay,
    all stay."""
    spark = docs.sparkSession
    with scratch(spark):
        groups = _components(docs, id_col, text_col, size, percent)
        gone = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), shared_dir(spark), "gone")
    return keyed(docs, gone, id_col, "left_anti").select(docs.columns)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
