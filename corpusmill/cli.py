"""Command line: curate | downsample | filter | run-all | lexicons | score."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .deploy import ship
from .functions.lexicon import Lexicons, simple_stem, write_starter
from .functions.money import bucket_targets
from .operators import curate as C
from .operators.score import rule_model, score_texts
from .sources import files


def parser(defaults: dict | None = None) -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusmill", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("curate", "downsample", "filter", "run-all"):
        p = sub.add_parser(name)
        p.add_argument("--config", help="JSON or YAML file with values for the options, by their names")
        p.add_argument("--input", required=True)
        p.add_argument("--output", required=True)
        p.add_argument("--output-format", choices=("jsonl", "parquet"), default="jsonl")
        p.add_argument("--seed", default="42")
        if name in ("curate", "run-all"):
            p.add_argument("--format", choices=("jsonl", "csv", "parquet"), default="jsonl")
            p.add_argument("--lexicons", help="folder of phrase files")
            p.add_argument("--text-field", default="text")
            p.add_argument("--id-field", default="id")
            p.add_argument("--date-field")
            p.add_argument("--source-field")
            p.add_argument("--min-chars", type=int, default=C.MIN_CHARS)
            p.add_argument("--max-chars", type=int, default=C.MAX_CHARS)
            p.add_argument("--near-bits", type=int, help="Hamming threshold of near duplicates")
            p.add_argument("--band-bits", type=int, default=C.BAND_BITS)
            p.add_argument("--context", action="store_true")
            p.add_argument("--stem", action="store_true", help="phrases of one word also match by their stem")
            p.add_argument("--max-per-bucket", type=int, default=0, help="seeded draw from each bucket; 0: all")
        else:
            p.add_argument("--format", choices=("jsonl", "parquet"), default="jsonl")
        if name in ("downsample", "run-all"):
            p.add_argument("--total", type=int, default=20_000)
            p.add_argument("--template-cap", type=int, default=C.TEMPLATE_CAP)
        if name in ("filter", "run-all"):
            p.add_argument("--min-true", type=int, default=C.MIN_TRUE)
        p.set_defaults(**(defaults or {}))
    sub.add_parser("lexicons").add_argument("folder")
    sub.add_parser("score").add_argument("texts", nargs="+")
    return top


def parsed(argv: list[str] | None) -> argparse.Namespace:
    """The options; those that the command line leaves out come from the configuration."""
    args = parser().parse_args(argv)
    if getattr(args, "config", None):
        known = {k.replace("-", "_"): v for k, v in files.read_config(args.config).items()}
        args = parser({k: v for k, v in known.items() if hasattr(args, k)}).parse_args(argv)
    return args


def documents(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    fields = [f for f in (args.id_field, args.text_field, args.date_field, args.source_field) if f]
    if args.format == "jsonl":
        return files.read_jsonl(spark, args.input, fields, args.text_field)
    return files.read_csv(spark, args.input) if args.format == "csv" else spark.read.parquet(args.input)


def candidates(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Stage 1 by the options, in the layout of files."""
    lex = Lexicons.from_folder(args.lexicons) if args.lexicons else Lexicons()
    lex = replace(lex, stem=simple_stem) if args.stem else lex
    job = C.Curation(lex, args.min_chars, args.max_chars, args.near_bits, args.context, args.band_bits)
    keep = [f for f in (args.date_field, args.source_field) if f]
    found = C.candidates(documents(spark, args), job, args.id_field, args.text_field, keep)
    if args.max_per_bucket > 0:
        found = C.drawn(found, "bucket", args.max_per_bucket, args.seed, [args.id_field, "idx"])
    return C.laid_out(found, args.id_field, args.date_field, args.source_field)


def sampled(rows: DataFrame, args: argparse.Namespace) -> DataFrame:
    return C.downsample(rows, bucket_targets(args.total, C.FRACTIONS), args.seed, ["doc_id", "idx"], args.template_cap)


def main(argv: list[str] | None = None) -> None:
    args = parsed(argv)
    if args.command == "lexicons":
        write_starter(args.folder)
        return
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    if args.command == "score":  # ad-hoc texts by the stand-in model
        rows = score_texts(spark.createDataFrame([(t,) for t in args.texts], "text string"), "text", rule_model)
        rows.show(len(args.texts), truncate=False)
        return
    if args.command in ("curate", "run-all"):
        out = C.flat(candidates(spark, args))
    else:
        read = spark.read.schema(C.LAYOUT)
        out = C.flat(read.json(args.input) if args.format == "jsonl" else spark.read.parquet(args.input)).where(F.col("bucket").isNotNull())
    if args.command in ("downsample", "run-all"):
        out = sampled(out, args)
    if args.command == "filter" or args.command == "run-all" and args.min_true > 0:
        out = C.filter_features(out, args.min_true)
    rows = C.laid_out(out, "doc_id", "date", "source")
    if args.output_format == "jsonl":
        files.write_jsonl(rows, args.output)
    else:
        rows.write.mode("overwrite").parquet(args.output)


if __name__ == "__main__":
    main()
