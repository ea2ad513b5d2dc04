"""Report tables over predictions, and a small HTML page of them."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


NO_ERRORS = "hata yok"


def mismatches(df: DataFrame, truth: str = "ground_truth", predicted: str = "predicted_label") -> DataFrame:
    return df.where(~F.coalesce(F.col(truth) == F.col(predicted), F.lit(False)))


def transitions(wrong: DataFrame, order: str, truth: str = "ground_truth", predicted: str = "predicted_label", groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, truth, predicted, n, rank): most common first, then the first seen by order."""
    counts = wrong.groupBy(*groups, truth, predicted).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(*groups).orderBy(F.desc("n"), "_first") if groups else Window.orderBy(F.desc("n"), "_first")  # 9 rows at most
    return counts.withColumn("rank", F.row_number().over(w)).drop("_first")


def dominant(df: DataFrame, category: str, order: str, truth: str = "ground_truth", predicted: str = "predicted_label") -> DataFrame:
    """(category, dominant): each category's most common mismatch, or a word that there is none."""
    best = transitions(mismatches(df, truth, predicted), order, truth, predicted, (category,)).where("rank = 1")
    text = F.concat(F.col(truth), F.lit(" → "), F.col(predicted), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return df.select(category).distinct().join(best.select(category, text.alias("dominant")), category, "left").withColumn("dominant", F.coalesce("dominant", F.lit(NO_ERRORS)))


def category_report(by_category: DataFrame, df: DataFrame, category: str, order: str, truth: str = "ground_truth", predicted: str = "predicted_label") -> DataFrame:
    """Metrics of each category (key, count, accuracy, macro_f1) joined with its mismatches: how
    many, and the most common one.  Categories without metrics are left out."""
    wrong = mismatches(df, truth, predicted).groupBy(F.col(category).alias("key")).agg(F.count("*").alias("mismatch_count"))
    common = dominant(df, category, order, truth, predicted).withColumnRenamed(category, "key")
    return by_category.join(wrong, "key", "left").join(common, "key", "left").withColumn("mismatch_count", F.coalesce("mismatch_count", F.lit(0)).cast("long")).withColumn("dominant", F.coalesce("dominant", F.lit(NO_ERRORS)))


def class_distribution(df: DataFrame, truth: str = "ground_truth", predicted: str = "predicted_label") -> DataFrame:
    """(label, truth_n, predicted_n) in one pass."""
    both = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"))
    return both.groupBy(F.col("x.label").alias("label")).agg(F.sum("x.t").alias("truth_n"), F.sum("x.p").alias("predicted_n"))


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of each column, values as text, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(pairs.alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def ranking(by_category: DataFrame) -> DataFrame:
    """Categories from the worst: by accuracy, macro f1, name."""
    return by_category.withColumn("rank", F.row_number().over(Window.orderBy("accuracy", "macro_f1", "key")))  # a row a category


def lowest_recall(classes: DataFrame) -> DataFrame:
    """The label of least recall, the first listed among equals."""
    return classes.agg(F.min_by("label", F.struct("recall", "place")).alias("label"), F.round(F.min("recall"), 4).alias("recall"))


def intensity(cells: DataFrame, n: str = "n") -> DataFrame:
    """cells with n as a share of the greatest (1 if that is 0)."""
    top = cells.agg(F.greatest(F.max(n), F.lit(1)).alias("_top"))
    return cells.join(F.broadcast(top)).withColumn("intensity", F.round(F.col(n) / F.col("_top"), 4)).drop("_top")


def tier(accuracy: Column) -> Column:
    return F.when(accuracy >= 0.95, "top").when(accuracy >= 0.8, "good").when(accuracy >= 0.5, "weak").otherwise("poor")


def comparison(results: DataFrame, keys: list[str], model: str, value: str, models: list[str]) -> DataFrame:
    """A column of values for each model."""
    return results.groupBy(*keys).pivot(model, models).agg(F.first(value))


def render(title: str, tables: dict[str, DataFrame], rows: int = 50) -> str:
    """An HTML page of small tables, each cut at rows (a report, not data)."""
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
        out.append(f"<h2>{escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join([*out, "</body></html>"])


def bar_chart(counts: dict[str, int], width: int = 360) -> str:
    """An SVG of horizontal bars."""
    top = max([1, *counts.values()])
    bars = "".join(f"<text x='0' y='{20 * i + 14}'>{escape(k)}</text><rect x='120' y='{20 * i + 2}' height='14' width='{round(v / top * width)}'/><text x='{126 + round(v / top * width)}' y='{20 * i + 14}'>{v}</text>" for i, (k, v) in enumerate(counts.items()))
    return f"<svg xmlns='http://www.w3.org/2000/svg' width='{width + 200}' height='{20 * len(counts) + 4}'>{bars}</svg>"


def heat_map(cells: dict[tuple[str, str], int], rows: list[str], columns: list[str], size: int = 72) -> str:
    """An SVG of a confusion matrix: darker cells hold more of their row."""
    out = [f"<text x='{120 + size * j}' y='16'>{escape(c)}</text>" for j, c in enumerate(columns)]
    for i, r in enumerate(rows):
        total = max(sum(cells.get((r, c), 0) for c in columns), 1)
        out.append(f"<text x='0' y='{24 + size * i + size // 2}'>{escape(r)}</text>")
        for j, c in enumerate(columns):
            n = cells.get((r, c), 0)
            shade = 255 - round(200 * n / total)
            out.append(f"<rect x='{120 + size * j}' y='{24 + size * i}' width='{size - 2}' height='{size - 2}' fill='rgb({shade},{shade},255)'/><text x='{126 + size * j}' y='{24 + size * i + size // 2}'>{n}</text>")
    return f"<svg xmlns='http://www.w3.org/2000/svg' width='{130 + size * len(columns)}' height='{30 + size * len(rows)}'>{''.join(out)}</svg>"
