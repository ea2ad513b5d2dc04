"""The labelled rows from which the classifiers learn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Characters of the sample's texts, for each class: rows come whole, as many as fit.
TRAIN_CHARS = 24_000_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], chars: int = TRAIN_CHARS) -> tuple[DataFrame, dict[int, int]]:
    """(text, label) of at most per_class[k] rows of class k and at most chars characters of them,
    and the counts of the classes among all rows that may be learnt from.

    The rows are those with the smallest hash of the id, so the choice depends neither on the
    order of rows nor on partitions.  Being bounded, they are broadcast to find their texts.
    """
    fair = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
    totals = {int(k): int(n) for k, n in fair.groupBy("label").count().collect()}
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = None
    for k in (0, 1):
        part = fair.where(F.col("label") == k).orderBy(*order).limit(per_class[k])
        chosen = part if chosen is None else chosen.unionByName(part)
    text = docs.select(F.col("doc_id").alias("_id"), "text").where(F.col("text").isNotNull())
    sizes = text.select("_id", F.length("text").alias("n")).join(F.broadcast(chosen), "_id").groupBy("label", "_id").agg(F.sum("n").alias("n")).select("label", "_id", "n", F.xxhash64("_id").alias("h"))
    taken, used = [], {0: 0, 1: 0}
    for r in sorted(sizes.collect(), key=lambda r: (r["label"], r["h"], r["_id"])):  # a bounded sample's
        used[r["label"]] += r["n"]
        if used[r["label"]] <= chars:
            taken.append((r["_id"], r["label"]))
    few = docs.sparkSession.createDataFrame(taken, "_id long, label int")
    return text.join(F.broadcast(few), "_id").select("text", "label"), totals
