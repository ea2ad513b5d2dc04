"""Readers and writers of the line, table and array formats."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names.  Only a
    session on one machine may go without it: executors elsewhere would each write to their own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"/tmp/checkpoints/{os.getpid()}"


def spread_out(scan: DataFrame) -> DataFrame:
    """A scan (of a table, nothing else) over at least as many partitions as there are cores: a
    small file of one row group would keep one core busy.  Large tables stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def read_jsonl(spark: SparkSession, path: str, fields: Sequence[str], text_field: str | None = None) -> DataFrame:
    """Tolerant: blank lines, bad JSON and values that aren't objects are left out, and so are
    objects whose text_field is no string.  Fields come as text; other kinds as JSON text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    v = lines.select(F.try_parse_json("value").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    if text_field is not None:
        v = v.where(F.schema_of_variant(F.try_variant_get("v", f"$.{text_field}", "variant")) == "STRING")
    return v.select(*(F.try_variant_get("v", f"$.{f}", "string").alias(f) for f in fields))


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines don't count; anything else that isn't JSON of the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, quoted line breaks, doubled quotes; every value is text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A predictions table written as CSV, with correct as a boolean again."""
    df = read_csv(spark, path)
    return df.withColumn("correct", F.lower("correct") == "true") if "correct" in df.columns else df


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line; NULL fields are written."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "overwrite") -> bool:
    """CSV with a header; nothing is written without rows.  Says whether it wrote."""
    if df.isEmpty():
        return False
    df.select(*(columns or df.columns)).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return True


def write_summary(summary: dict, path: str, spark: SparkSession | None = None) -> None:
    """A small JSON document, indented by 2: a file of the driver, or of any store when a session
    is given."""
    text = json.dumps(summary, ensure_ascii=False, indent=2)
    if spark is None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return
    fs, at = _filesystem(spark, path)
    out = fs.create(at(path), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_summary(spark: SparkSession, path: str) -> dict:
    """A small JSON document of any store."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def read_config(path: str) -> dict:
    """A job's configuration: JSON, or YAML where a parser is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def save_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def rewrite(df: DataFrame, path: str, write) -> None:
    """Replaces the folder that df may be reading: write(df, folder beside it), then a swap."""
    spark = df.sparkSession
    fs, at = _filesystem(spark, path)
    fresh, old = f"{path.rstrip('/')}.{uuid.uuid4().hex}.new", f"{path.rstrip('/')}.{uuid.uuid4().hex}.old"
    write(df, fresh)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(fresh), at(path))
    fs.delete(at(old), True)


def run_folder(spark: SparkSession, root: str, config: dict) -> str:
    """A new folder named by the time, with the run's configuration."""
    path = f"{root.rstrip('/')}/{datetime.now():%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:6]}"
    spark.createDataFrame([(json.dumps(config, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/config")
    return path
