"""Classification and language-model metrics from counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = ("negative", "neutral", "positive")
IGNORE = -100


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x.cast("double") - top.cast("double")))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def argmax(values: Column) -> Column:
    """0-based place of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def confusion(df: DataFrame, truth: str, predicted: str, groups: Sequence[str] = (), labels: Sequence[str] = LABELS, strict: bool = False) -> DataFrame:
    """(groups, truth, n_<label> ...): dense in the labels.  Labels outside are an error if
    strict, else their rows don't count."""
    known = F.col(truth).isin(*labels) & F.col(predicted).isin(*labels)
    if strict:
        bad = F.when(~F.coalesce(known, F.lit(False)), F.raise_error(F.concat_ws(" ", F.lit("unknown label:"), F.col(truth), F.col(predicted))).cast("boolean"))
        df = df.where(F.coalesce(bad, F.lit(True)))
    counts = df.where(known).groupBy(*groups).agg(*(F.count_if((F.col(truth) == t) & (F.col(predicted) == p)).alias(f"{t}|{p}") for t in labels for p in labels))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("truth"), *(F.col(f"{t}|{p}").alias(f"n_{p}") for p in labels)) for t in labels)))
    return counts.select(*groups, rows.alias("x")).select(*groups, "x.*")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def per_class(df: DataFrame, truth: str, predicted: str, groups: Sequence[str] = (), labels: Sequence[str] = LABELS) -> DataFrame:
    """(groups, label, precision, recall, f1, support, predicted_n), unrounded; one pass."""
    known = F.col(truth).isin(*labels) & F.col(predicted).isin(*labels)
    counts = df.where(known).groupBy(*groups).agg(
        *(F.count_if((F.col(truth) == k) & (F.col(predicted) == k)).alias(f"hit|{k}") for k in labels),
        *(F.count_if(F.col(truth) == k).alias(f"true|{k}") for k in labels),
        *(F.count_if(F.col(predicted) == k).alias(f"pred|{k}") for k in labels),
    )
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.lit(i).alias("place"), F.col(f"hit|{k}").alias("hit"), F.col(f"true|{k}").alias("support"), F.col(f"pred|{k}").alias("predicted_n")) for i, k in enumerate(labels))))
    p, r = _ratio(F.col("hit"), F.col("predicted_n")), _ratio(F.col("hit"), F.col("support"))
    out = counts.select(*groups, rows.alias("x")).select(*groups, "x.*").withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def rounded_classes(classes: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return classes.select(*groups, "label", *(F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")), "support")


def summary(classes: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, count, accuracy, macro_f1): the macro mean is over classes with support only."""
    return classes.groupBy(*groups).agg(
        F.sum("support").alias("count"),
        F.round(_ratio(F.sum("hit"), F.sum("support")), 4).alias("accuracy"),
        F.round(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)), 4).alias("macro_f1"),
    )


def weighted(classes: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Accuracy and precision, recall and f1 weighted by support."""
    mean = lambda c: F.round(_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")), 4).alias(c)
    return classes.groupBy(*groups).agg(F.round(_ratio(F.sum("hit"), F.sum("support")), 4).alias("accuracy"), mean("precision"), mean("recall"), mean("f1"))


def grouped_summary(df: DataFrame, truth: str, predicted: str, by: Sequence[str], labels: Sequence[str] = LABELS) -> DataFrame:
    """(grouping, key, count, accuracy, macro_f1) overall and by each column, from one pass
    over the rows: counts by all columns are summed up again for each grouping."""
    cells = df.groupBy(F.col(truth).alias("_t"), F.col(predicted).alias("_p"), *by).agg(F.count("*").alias("_n"))
    keys = F.explode(F.array(F.struct(F.lit("overall").alias("grouping"), F.lit("").alias("key")), *(F.struct(F.lit(c).alias("grouping"), F.col(c).cast("string").alias("key")) for c in by)))
    long = cells.select("_t", "_p", "_n", keys.alias("g")).select("_t", "_p", "_n", "g.grouping", "g.key").where(F.col("_t").isin(*labels) & F.col("_p").isin(*labels))
    sums = long.groupBy("grouping", "key").agg(*(F.sum(F.when((F.col("_t") == k) & (F.col("_p") == k), F.col("_n")).otherwise(0)).alias(f"hit|{k}") for k in labels), *(F.sum(F.when(F.col("_t") == k, F.col("_n")).otherwise(0)).alias(f"true|{k}") for k in labels), *(F.sum(F.when(F.col("_p") == k, F.col("_n")).otherwise(0)).alias(f"pred|{k}") for k in labels))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("label"), F.col(f"hit|{k}").alias("hit"), F.col(f"true|{k}").alias("support"), F.col(f"pred|{k}").alias("predicted_n")) for k in labels)))
    p, r = _ratio(F.col("hit"), F.col("predicted_n")), _ratio(F.col("hit"), F.col("support"))
    flat = sums.select("grouping", "key", rows.alias("x")).select("grouping", "key", "x.*").withColumn("precision", p).withColumn("recall", r)
    return summary(flat.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))), ["grouping", "key"])


def masked_accuracy(df: DataFrame, predicted: str, label: str, ignore: int = IGNORE) -> DataFrame:
    return df.agg(F.round(F.coalesce(F.avg(F.when(F.col(label) != ignore, (F.col(predicted) == F.col(label)).cast("int"))), F.lit(0.0)), 4).alias("accuracy"))


def mlm_metrics(df: DataFrame, batch: str, loss: str, label: str, ranked: str, k: int = 5, ignore: int = IGNORE) -> DataFrame:
    """avg_loss is the mean of the batches' mean losses; ranked holds the best ids, best first."""
    real = df.where(F.col(label) != ignore)
    by_batch = real.groupBy(batch).agg(F.avg(loss).alias("l"), F.count("*").alias("n"), F.count_if(F.get(ranked, F.lit(0)) == F.col(label)).alias("one"), F.count_if(F.array_contains(F.slice(ranked, 1, k), F.col(label))).alias("some"))
    out = by_batch.agg(F.coalesce(F.avg("l"), F.lit(0.0)).alias("avg_loss"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("masked_tokens"), F.coalesce(F.sum("one"), F.lit(0)).alias("one"), F.coalesce(F.sum("some"), F.lit(0)).alias("some"), F.count("*").alias("steps"))
    n = F.greatest(F.col("masked_tokens"), F.lit(1))
    return out.select(F.round("avg_loss", 6).alias("avg_loss"), F.round(F.exp("avg_loss"), 6).alias("perplexity"), F.round(F.col("one") / n, 6).alias("top1_acc"), F.round(F.col("some") / n, 6).alias(f"top{k}_acc"), "masked_tokens", "steps")


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """df with the columns that it lacks, filled by their defaults: a value, or the name of a
    column after "=".  Columns that it has stay as they are."""
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.col(value[1:]) if value.startswith("=") else F.lit(value))
    return df


def attach_predictions(rows: DataFrame, predictions: DataFrame, key: str, truth: str, check: bool = False, defaults: dict[str, str] | None = None) -> DataFrame:
    """rows with their predictions and correct, joined by key; with check, unequal counts are an
    error; columns that rows lack come from defaults."""
    rows = with_defaults(rows, defaults or {})
    if check and rows.count() != predictions.count():
        raise ValueError("rows and predictions differ in number")
    return rows.join(predictions, key).withColumn("correct", F.col(truth) == F.col("predicted_label"))
