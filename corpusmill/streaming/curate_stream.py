"""Stage 1 of curation over a stream of documents (an addition; the batch stages are the norm).

Gates, flags and buckets need no state.  Exact duplicates are dropped within a watermark, so
the state stays bounded; near duplicates need the order of all rows and are left to batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import md5_norm
from ..operators.curate import FLAGS, Curation, bucket_of, gated, keeps


def stream_candidates(docs: DataFrame, job: Curation, time_col: str, delay: str = "1 hour", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kept = gated(docs.withWatermark(time_col, delay), job, [id_col, time_col], text_col).where(keeps(F.col("features")))
    unique = kept.withColumn("hash", md5_norm(F.col("sentence"))).dropDuplicatesWithinWatermark(["hash"])
    return unique.select(id_col, time_col, "idx", "sentence", bucket_of(F.col("features")).alias("bucket"), *(F.col(f"features.{f}").alias(f) for f in FLAGS))
