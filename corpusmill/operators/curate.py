"""Curation: sentences through gates, flags, near and exact duplicates, into buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions import text as T
from ..functions.lexicon import Lexicons, matches
from ..functions.sketch import band, simhash64

FLAGS = ("finance_term", "company_term", "direction_up", "direction_down", "legal_reg", "guidance_modal", "rating_action", "money_or_number")
#: What the stages take when nothing else is said.
MIN_CHARS, MAX_CHARS, NEAR_BITS, BAND_BITS, TEMPLATE_CAP, MIN_TRUE = 20, 400, 3, 16, 3, 4
FRACTIONS = {
    "finance_up": 0.20,
    "finance_down": 0.20,
    "legal_reg": 0.15,
    "guidance_modal": 0.15,
    "rating_action": 0.10,
    "numeric_finance": 0.10,
    "finance_other": 0.10,
    "finance_updown": 0.00,
}


@dataclass(frozen=True)
class Curation:
    lexicons: Lexicons
    min_chars: int = MIN_CHARS
    max_chars: int = MAX_CHARS
    near_bits: int | None = None  # Hamming threshold of near duplicates; None: off
    context: bool = False
    band_bits: int = BAND_BITS
    split: Callable[[Column], Column] = T.split_sentences


def flags(s: Column, lex: Lexicons) -> dict[str, Column]:
    number = s.rlike(lex.money) if lex.money else T.has_money(s)
    period = s.rlike(lex.period) if lex.period else T.has_period(s)
    return {
        "finance_term": matches(s, lex.pattern("finance")),
        "company_term": matches(s, lex.pattern("company")),
        "direction_up": matches(s, lex.pattern("up")),
        "direction_down": matches(s, lex.pattern("down")),
        "legal_reg": matches(s, lex.pattern("legal")),
        "guidance_modal": matches(s, lex.pattern("risk")) | period,
        "rating_action": matches(s, lex.pattern("rating")),
        "money_or_number": number,
    }


def keeps(f: Column) -> Column:
    """An anchor (finance or company) and at least one trigger."""
    trigger = f["direction_up"] | f["direction_down"] | f["legal_reg"] | f["guidance_modal"] | f["rating_action"] | f["money_or_number"]
    return (f["finance_term"] | f["company_term"]) & trigger


def bucket_of(f: Column) -> Column:
    return T.bucket(f["finance_term"], f["company_term"], f["direction_up"], f["direction_down"], f["legal_reg"], f["guidance_modal"], f["rating_action"], f["money_or_number"])


def sentences(docs: DataFrame, keys: list[str], text_col: str, split: Callable[[Column], Column] = T.split_sentences) -> DataFrame:
    """keys, idx (from 0) and sentence; rows without text have none."""
    return docs.where(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "").select(*keys, F.posexplode(split(F.col(text_col))).alias("idx", "sentence"))


def gated(docs: DataFrame, job: Curation, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, idx, sentence, prev, next, features of sentences within the length bounds that
    aren't boilerplate.  Flags are made inside the array, so each pattern runs once and what
    the gates reject never becomes a row."""
    listed = docs.where(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "").select(*keys, job.split(F.col(text_col)).alias("_s"))
    zipped = F.arrays_zip(F.col("_s").alias("sentence"), F.concat(F.array(F.lit("")), F.col("_s")).alias("prev"), F.slice(F.col("_s"), F.lit(2), F.size("_s") + 1).alias("next"))
    numbered = F.transform(zipped, lambda x, i: F.struct(i.alias("idx"), x["sentence"], F.coalesce(x["prev"], F.lit("")).alias("prev"), F.coalesce(x["next"], F.lit("")).alias("next")))
    fit = lambda x: x["sentence"].isNotNull() & F.length(x["sentence"]).between(job.min_chars, job.max_chars) & ~T.is_boilerplate(x["sentence"], job.lexicons.boilerplate)
    flagged = F.transform(F.filter(numbered, fit), lambda x: F.struct(x["idx"], x["sentence"], x["prev"], x["next"], F.struct(*(c.alias(n) for n, c in flags(x["sentence"], job.lexicons).items())).alias("features")))
    return listed.select(*keys, F.inline(flagged))


def first_of(df: DataFrame, group: list[Column], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def greedy_survivors(hashes: DataFrame, hash_col: str, order: list[str], bits: int = NEAR_BITS, band_bits: int = BAND_BITS) -> DataFrame:
    """The first row of each hash that is further than bits from every earlier survivor of its
    band.

    Equal hashes share their fate with the first of them, so only that one, found by an
    aggregation that combines in each task, enters the ordered fold.  The fold streams each
    band's hashes in order and holds its survivors only, filed by bits + 1 blocks of their other
    bits: hashes at most bits apart agree in one block, so few survivors are compared.
    """
    at = F.struct(*order)
    once = hashes.groupBy(hash_col).agg(F.min(at).alias("_at")).withColumn("_band", band(F.col(hash_col), band_bits))
    kind = once.schema["_at"].dataType.simpleString()

    rest, blocks = 64 - band_bits, bits + 1
    edges = [rest * i // blocks for i in range(blocks + 1)]
    cuts = [(low, (1 << (high - low)) - 1) for low, high in zip(edges, edges[1:])]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, alive = None, {}
        for b in batches:
            keep = []
            for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != now:
                    now, alive = k, {}
                h &= 0xFFFFFFFFFFFFFFFF
                keys = [(i, h >> low & mask) for i, (low, mask) in enumerate(cuts)]
                near = any((h ^ x).bit_count() <= bits for key in keys for x in alive.get(key, ()))
                keep.append(not near)
                if not near:
                    for key in keys:
                        alive.setdefault(key, []).append(h)
            yield b.filter(pa.array(keep, pa.bool_())).select([1, 2])

    ship(hashes.sparkSession)
    ordered = once.select("_band", hash_col, "_at").repartition("_band").sortWithinPartitions("_band", "_at")
    kept = ordered.mapInArrow(fold, f"`{hash_col}` long, _at {kind}")
    return kept.select(hash_col, *(F.col(f"_at.{c}").alias(c) for c in order))


def candidates(docs: DataFrame, job: Curation, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Stage 1: id, kept columns, idx, sentence, bucket, the flags, and context if asked for.

    Near duplicates are dropped before the keep rule (a sentence that the rule rejects still
    stands against later ones), exact duplicates after it; the order of rows is (id, idx).
    """
    keys = [id_col, *(keep or [])]
    rows = gated(docs, job, keys, text_col)
    order = [id_col, "idx"]
    if job.near_bits is not None:
        hashed = rows.withColumn("_h", simhash64(F.col("sentence")))
        alive = greedy_survivors(hashed.select("_h", *order), "_h", order, job.near_bits, job.band_bits)
        rows = hashed.join(alive, ["_h", *order], "left_semi").drop("_h")
    kept = rows.where(keeps(F.col("features")))
    unique = first_of(kept, [T.md5_norm(F.col("sentence"))], order)
    context = ["prev", "next"] if job.context else []
    return unique.select(*keys, "idx", "sentence", bucket_of(F.col("features")).alias("bucket"), *(F.col(f"features.{f}").alias(f) for f in FLAGS), *context)


#: How candidates lie in files: flags and context in structs of their own.
LAYOUT = f"doc_id string, date string, source string, idx int, sentence string, bucket string, features struct<{','.join(f'{f}:boolean' for f in FLAGS)}>, context struct<prev:string,next:string>"


def laid_out(cands: DataFrame, id_col: str = "doc_id", date_col: str | None = None, source_col: str | None = None) -> DataFrame:
    """Candidates as they lie in files; date and source are NULL where no column is named."""
    named = lambda c, name: (F.col(c).cast("string") if c else F.lit(None).cast("string")).alias(name)
    context = [F.struct("prev", "next").alias("context")] if "prev" in cands.columns else []
    more = ["true_feature_count"] if "true_feature_count" in cands.columns else []
    return cands.select(named(id_col, "doc_id"), named(date_col, "date"), named(source_col, "source"), "idx", "sentence", "bucket", F.struct(*FLAGS).alias("features"), *context, *more)


def flat(rows: DataFrame) -> DataFrame:
    """Candidates from their layout in files: flags and context as columns."""
    context = ["context.prev", "context.next"] if "context" in rows.columns else []
    return rows.select("doc_id", "date", "source", "idx", "sentence", "bucket", *(F.coalesce(f"features.{f}", F.lit(False)).alias(f) for f in FLAGS), *context)


def downsample(cands: DataFrame, targets: dict[str, int], seed: str, order: list[str], template_cap: int = TEMPLATE_CAP) -> DataFrame:
    """Stage 2: buckets with a target, at most template_cap rows a template (the first by
    order), then a seeded draw of each bucket's target."""
    wanted = cands.where(F.col("bucket").isin([b for b, k in targets.items() if k > 0])).where(F.trim(F.coalesce("sentence", F.lit(""))) != "")
    w = Window.partitionBy("_t").orderBy(*order)
    capped = wanted.withColumn("_t", T.template(F.col("sentence"))).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= template_cap).drop("_r", "_t")
    return drawn(capped, "bucket", targets, seed, order)


def drawn(df: DataFrame, bucket_col: str, targets: dict[str, int] | int, seed: str, keys: list[str]) -> DataFrame:
    """Of each bucket the rows of lowest seeded rank, as many as its target; ties by keys."""
    rank = T.seeded(seed, F.col(bucket_col), *(F.col(k) for k in keys))
    w = Window.partitionBy(bucket_col).orderBy("_h", *keys)
    ranked = df.withColumn("_h", rank).withColumn("_r", F.row_number().over(w))
    if isinstance(targets, int):
        return ranked.where(F.col("_r") <= targets).drop("_h", "_r")
    most = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for b, k in targets.items() for x in (b, k))), F.col(bucket_col)), F.lit(0))
    return ranked.where((F.col("_r") <= max(targets.values())) & (F.col("_r") <= most)).drop("_h", "_r")


def true_count(names: list[str] | tuple[str, ...] = FLAGS) -> Column:
    out = F.lit(0)
    for n in names:
        out = out + F.coalesce(F.col(n), F.lit(False)).cast("int")
    return out


def filter_features(cands: DataFrame, least: int = MIN_TRUE) -> DataFrame:
    """Stage 3: rows with at least so many true flags, and their count."""
    return cands.withColumn("true_feature_count", true_count()).where(F.col("true_feature_count") >= least)


def run_all(docs: DataFrame, job: Curation, total: int, seed: str, least: int = MIN_TRUE, fractions: dict[str, float] | None = None, **columns) -> DataFrame:
    """All three stages as one plan."""
    from ..functions.money import bucket_targets

    order = [columns.get("id_col", "doc_id"), "idx"]
    sampled = downsample(candidates(docs, job, **columns), bucket_targets(total, fractions or FRACTIONS), seed, order)
    return filter_features(sampled, least) if least > 0 else sampled
