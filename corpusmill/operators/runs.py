"""Training logs, sweeps and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: gap of accuracies (in points) up to which a fit counts as good.
GOOD_GAP = 5.0


def log_kinds(log: DataFrame) -> DataFrame:
    """log with kind: train (loss without eval_loss), eval, or other."""
    return log.withColumn("kind", F.when(F.col("eval_loss").isNotNull(), "eval").when(F.col("loss").isNotNull(), "train").otherwise("other"))


def final_run(log: DataFrame) -> DataFrame:
    """Last evaluation loss and number of training records."""
    kinds = log_kinds(log)
    return kinds.agg(F.max_by(F.when(F.col("kind") == "eval", F.col("eval_loss")), F.when(F.col("kind") == "eval", F.col("step"))).alias("last_eval_loss"), F.count_if(F.col("kind") == "train").alias("train_records"))


def timing(steps: DataFrame, seconds: str = "seconds") -> DataFrame:
    """total, mean and count of step times; NULL totals without steps."""
    return steps.agg(F.round(F.sum(seconds), 6).alias("total_s"), F.round(F.avg(seconds), 6).alias("mean_s"), F.count(seconds).alias("steps"))


def sweep_best(sweep: DataFrame) -> DataFrame:
    """The run of least evaluation loss; ties by optimiser, then rate."""
    best = sweep.agg(F.min_by(F.struct(*sweep.columns), F.struct("eval_loss", "optim", "lr")).alias("x"))
    return best.select("x.*")


def train_eval_gap(metrics: DataFrame) -> DataFrame:
    """(epoch, train_accuracy, eval_accuracy, gap_pct, fit) from rows (epoch, kind, accuracy)."""
    side = lambda k: F.max(F.when(F.col("kind") == k, F.col("accuracy")))
    wide = metrics.groupBy("epoch").agg(side("train").alias("train_accuracy"), side("eval").alias("eval_accuracy"))
    gap = F.round((F.col("train_accuracy") - F.col("eval_accuracy")) * 100, 2)
    return wide.withColumn("gap_pct", gap).withColumn("fit", F.when(F.col("gap_pct") <= GOOD_GAP, "good").otherwise("moderate"))


def costs(usage: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Tokens and their cost at prices for a million."""
    cost = F.col("input_tokens") * price_in / 1e6 + F.col("output_tokens") * price_out / 1e6
    return usage.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum(cost), 6).alias("cost"))
