"""Benchmark decontamination in DataFrame functions only.

A benchmark item's windows are its runs of 13 words (the whole item, if it is shorter).  Of
windows of L words, each holds exactly one run of g words that starts at a multiple of
L - g + 1 in the document, so a document is scanned only there: the hashes of those anchors
are looked up in a broadcast hash set of the anchors of all windows, and around each find the
possible windows are verified as exact strings in the set of windows.  Both sets are part of
the expression (a literal set, shipped once a stage): a document is judged in its own row,
with no join, no shuffle and no copy of its text.  Only the few rows with hits are joined with
the items of their windows, for their names.

The sets are bounded: a benchmark of more than SET_LIMIT windows is taken in batches of that
many, in the order of its items, each by a pass of the same kind over the texts; the driver
holds one batch at a time.  What the passes find is gathered by the digest of the text.

Words: A-Z are lower-cased, then runs of digits, letters and everything beyond ASCII.
Anchors are compared in full lower case, which only finds more to verify.

Defined results: a null or empty text has no words and no hits; an item without words has no
windows; a null item id counts as an item named by the empty string, repeated item ids are
one item; equal rows get equal results, each its own row; an empty benchmark hits nothing;
other columns of either table are not read, and `decontaminate` keeps them.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import folded, let, scratch, shared_dir, stored, table, written

WINDOW, ANCHOR = 13, 5
#: Windows that may be shipped with the expression (some 10 MB; neighbours share their anchors,
#: of which there are nine times as many at most).
SET_LIMIT = 60_000
#: Hit windows and their items that may be broadcast to find the items of documents.
BROADCAST_ITEMS = 200_000
#: Contaminated: n_hit > 0 and SHARE * n_hit >= n_words.
SHARE = 20
#: The words of the contract, as they stand before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPANS = "array<struct<s:int,l:int>>"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def run_text(w: Column, start: Column, size) -> Column:
    """The words from start (1-based) as one string, A-Z lower-cased."""
    return F.translate(F.array_join(F.slice(w, start, size), " "), string.ascii_uppercase, string.ascii_lowercase)


def anchor_hash(w: Column, start: Column, size: int) -> Column:
    return F.xxhash64(F.replace(F.lower(F.array_join(F.slice(w, start, size), " ")), F.lit("ς"), F.lit("σ")))


def starts(w: Column, size, step: int = 1) -> Column:
    """1-based places at which a run of size words can start."""
    return F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


Batch = dict[int, tuple[list[str], list[int]]]  # l -> windows, anchors


def anchor_of(size: int) -> int:
    return min(ANCHOR, size)


@dataclass
class Windows:
    """The windows of a benchmark."""

    table: DataFrame  # window, l, items, place
    limit: int
    only: Batch | None  # when all fit into one batch

    @property
    def small(self) -> bool:
        return self.only is not None

    def batches(self) -> Iterator[Batch]:
        if self.small:
            yield self.only
            return
        rows = self.table.orderBy("place").select("window", "l").toLocalIterator()
        while some := list(islice(rows, self.limit)):
            yield batch_of(self.table.sparkSession, some)


def batch_of(spark: SparkSession, rows: list[Row]) -> Batch:
    out: Batch = {}
    w = F.split("window", " ")
    for n in sorted({r["l"] for r in rows}):
        g, texts = anchor_of(n), sorted(r["window"] for r in rows if r["l"] == n)
        found = spark.createDataFrame([(t,) for t in texts], "window string").select(F.explode(F.transform(starts(w, g), lambda s: anchor_hash(w, s, g))).alias("h")).distinct().collect()
        out[n] = texts, sorted(r["h"] for r in found)
    return out


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = SET_LIMIT) -> Windows:
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    cut = items.withColumn("l", size).select("item", "l", F.posexplode(F.transform(starts(F.col("w"), F.col("l")), lambda s: run_text(F.col("w"), s, F.col("l")))).alias("at", "window"))
    found = cut.groupBy("window", "l").agg(F.array_sort(F.collect_set("item")).alias("items"), F.min(F.struct("item", "at")).alias("place"))
    got = found.select("window", "l").limit(limit + 1).collect()
    return Windows(found, limit, batch_of(benchmark.sparkSession, got) if len(got) <= limit else None)


def hit_spans(w: Column, batch: Batch) -> Column:
    """Array of (s, l): where windows of the batch occur among the words."""
    parts = []
    for n, (texts, anchors) in batch.items():
        g = anchor_of(n)
        step = n - g + 1
        found = F.filter(F.when(F.size(w) >= n, starts(w, g, step)).otherwise(F.array().cast("array<int>")), lambda j: anchor_hash(w, j, g).isin(anchors))
        around = F.flatten(F.transform(found, lambda j: F.when(F.greatest(j - step + 1, F.lit(1)) <= F.least(j, F.size(w) - n + 1), F.sequence(F.greatest(j - step + 1, F.lit(1)), F.least(j, F.size(w) - n + 1))).otherwise(F.array().cast("array<int>"))))
        real = F.filter(around, lambda s: run_text(w, s, n).isin(texts))
        parts.append(F.transform(real, lambda s: F.struct(s.alias("s"), F.lit(n).alias("l"))))
    return F.concat(*parts) if parts else F.array().cast(SPANS)


def covered(spans: Column) -> Column:
    """Number of words inside any span."""
    zero = F.struct(F.lit(1).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(F.array_sort(spans), zero, lambda a, x: F.struct(F.greatest(a["end"], x["s"] + x["l"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["s"] + x["l"] - F.greatest(a["end"], x["s"]))).alias("n")), lambda a: a["n"])


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (n_hit * SHARE >= n_words)


def facts(text: Column, batch: Batch) -> Column:
    """Struct of n_words, spans and found: the texts of the windows that occur."""
    body = lambda w, spans: F.struct(F.size(w).alias("n_words"), spans.alias("spans"), F.array_distinct(F.transform(spans, lambda x: run_text(w, x["s"], x["l"]))).alias("found"))
    return let(words(text), lambda w: let(hit_spans(w, batch), lambda spans: body(w, spans)))


def text_hits(docs: DataFrame, windows: Windows, text_col: str) -> DataFrame:
    """(_key, n_words, spans, found) of each text with hits, by its digest: a pass over the texts
    for each batch of windows.  What the passes find is stored."""
    parts = None
    for batch in windows.batches():
        one = docs.select(F.md5(F.col(text_col)).alias("_key"), facts(F.col(text_col), batch).alias("x")).select("_key", "x.*").where(F.size("spans") > 0)
        one = stored(one.dropDuplicates(["_key"]), "hits")
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("_key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("found")).alias("found"))


def contamination(docs: DataFrame, windows: Windows, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs, as a table
    in the shared folder."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    with scratch(spark):
        if windows.small:
            judged = plain.select("_id", facts(F.col("_text"), windows.only).alias("x"))
            rows = judged.select("_id", "x.n_words", F.col("x.spans").alias("spans"), F.col("x.found").alias("found"))
        else:
            hits = text_hits(plain, windows, "_text").drop("n_words")
            keyed = plain.select("_id", F.size(words(F.col("_text"))).alias("n_words"), F.md5("_text").alias("_key"))
            rows = keyed.join(hits, "_key", "left").select("_id", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("found", F.array().cast("array<string>")).alias("found"))
        # the texts are read once; only rows with hits look for their items
        rows = stored(rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "n_words", covered(F.col("spans")).alias("n_hit"), "found"), "judged")
        hit = rows.where(F.size("found") > 0).select("_row", F.explode("found").alias("window"))
        items = windows.table.select("window", "items")
        few = windows.small and items.agg(F.sum(F.size("items")).alias("n")).first()["n"] or 0
        of = hit.join(F.broadcast(items) if windows.small and few <= BROADCAST_ITEMS else items, "window")
        named = of.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        with_items = rows.where(F.size("found") > 0).join(named, "_row").select("_id", "n_words", "n_hit", "items")
        without = rows.where(F.size("found") == 0).select("_id", "n_words", "n_hit", F.array().cast("array<string>").alias("items"))
        out = with_items.unionByName(without)
        return written(out.select(F.col("_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated")), shared_dir(spark), "contamination")


def without_spans(text: Column, spans: Column) -> Column:
    """text without the words inside spans; what stands between words stays."""
    zero = "struct<s:int,e:int>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        e = x["s"] + x["l"]
        new = F.struct(F.greatest(at, x["s"]).alias("s"), e.alias("e"))
        return F.greatest(at, e), F.when(e > at, F.array(new)).otherwise(F.array().cast(f"array<{zero}>"))

    def cut(gaps: Column, w: Column, gone: Column) -> Column:
        solid = F.zip_with(F.slice(gaps, F.lit(1), F.size(w)), w, lambda a, b: F.concat(a, b))  # each word behind its gap
        before = lambda i: F.when(i > 0, F.get(gone, i - 1)["e"]).otherwise(F.lit(1))
        part = lambda all_: lambda x, i: F.concat(F.array_join(F.slice(all_, before(i), x["s"] - before(i)), ""), F.array_join(F.slice(gaps, x["s"], x["e"] - x["s"]), ""))
        last = F.element_at(gone, -1)["e"]
        rest = lambda all_: F.array_join(F.slice(all_, last, F.size(w) - last + 1), "")
        return let(solid, lambda all_: F.concat(F.array_join(F.transform(gone, part(all_)), ""), rest(all_), F.element_at(gaps, -1)))

    whole = let(F.split(text, WORD, -1), lambda gaps: let(words(text), lambda w: let(folded(F.array_sort(spans), 1, step, zero), lambda gone: cut(gaps, w, gone))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", mode: str = "documents") -> DataFrame:
    """docs without its contaminated rows (mode "documents"), or with the hit words cut out of
    every text (mode "spans").  All columns are kept."""
    windows = benchmark_windows(benchmark)
    key = F.md5(F.col(text_col))
    if mode == "documents" and windows.small:
        bad = let(words(F.col(text_col)), lambda w: let(hit_spans(w, windows.only), lambda spans: is_contaminated(F.size(w), covered(spans))))
        return docs.where(~bad)
    if mode == "documents":
        bad = text_hits(docs, windows, text_col).where(is_contaminated(F.col("n_words"), covered(F.col("spans")))).select(F.col("_key").alias("_bad_key"))
        return docs.join(bad, key == bad["_bad_key"], "left_anti")
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"), key.alias("_key"))
    if windows.small:
        found = packed.withColumn("_spans", let(words(F.col("_text")), lambda w: hit_spans(w, windows.only)))
    else:
        found = packed.join(text_hits(docs, windows, text_col).select("_key", F.col("spans").alias("_spans")), "_key", "left").withColumn("_spans", F.coalesce("_spans", F.array().cast(SPANS)))
    cut = without_spans(F.col("_text"), F.col("_spans"))
    return found.select(*(cut.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), benchmark_windows(table(spark, sf_dir, "benchmark")))


ORACLE_SQL = r"""
WITH item AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
cut AS (
  SELECT item, least(len(w), 13) AS l, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS s FROM item WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, l, array_to_string(w[s : s + l - 1], ' ') AS t FROM cut),
runs AS (
  SELECT r, s, k.l AS l, array_to_string(w[s : s + k.l - 1], ' ') AS t
  FROM (SELECT r, l, w, unnest(generate_series(1, len(w) - l + 1)) AS s FROM doc, (SELECT DISTINCT l FROM windows) WHERE len(w) >= l) k),
hit AS (SELECT r, s, runs.l AS l, item FROM runs JOIN windows USING (t)),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + l - 1)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
