import json

import pytest
from pyspark.sql import functions as F

from corpusmill import cli
from corpusmill.functions.lexicon import Lexicons
from corpusmill.operators.curate import Curation
from corpusmill.sources import files
from corpusmill.streaming.curate_stream import stream_candidates


def test_tolerant_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"text":"a","id":1}\n[{"text":"b","id":2}]\nnot json\n\n"str"\n{"text":5,"id":"x"}\n{"text":null}\n')
    assert [(r["id"], r["text"]) for r in files.read_jsonl(spark, str(p), ["id", "text"], "text").collect()] == [("1", "a")]
    with pytest.raises(Exception):
        files.read_jsonl_strict(spark, str(p), "text string, id string").collect()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a \"q\"\nline", "True"), ("ş, b", "False")], "text string, correct string")
    assert files.write_csv(df, str(tmp_path / "c"))
    assert sorted(r["text"] for r in files.read_csv(spark, str(tmp_path / "c")).collect()) == ["a \"q\"\nline", "ş, b"]
    assert {r["correct"] for r in files.read_predictions(spark, str(tmp_path / "c")).collect()} == {True, False}
    assert not files.write_csv(df.limit(0), str(tmp_path / "d")) and not (tmp_path / "d").exists()


def test_json_sinks_and_rewrite(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "ş")], "i int, t string")
    path = str(tmp_path / "j")
    files.write_jsonl(df.coalesce(1), path)
    lines = [json.loads(x) for f in (tmp_path / "j").glob("part-*") for x in f.read_text().splitlines()]
    assert {"i": 1, "t": None} in lines
    files.rewrite(spark.read.schema("i int, t string").json(path).withColumn("t", F.upper("t")), path, files.write_jsonl)
    assert {r["t"] for r in spark.read.schema("i int, t string").json(path).collect()} == {None, "Ş"}
    files.write_summary({"a": 1}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": 1}
    (tmp_path / "arr.json").write_text('[{"url":"u","sentences":["a","b"]},{"url":"v","sentences":[]}]')
    assert files.read_json_array(spark, str(tmp_path / "arr.json")).count() == 2
    assert files.run_folder(spark, str(tmp_path / "runs"), {"a": 1}).startswith(str(tmp_path / "runs"))
    files.save_dataset(df, str(tmp_path / "p"))
    assert files.load_dataset(spark, str(tmp_path / "p")).count() == 2


def read_lines(folder):
    return [json.loads(x) for f in sorted(folder.glob("part-*.json")) for x in f.read_text().splitlines()]


def test_cli(spark, tmp_path):
    rows = [{"id": str(i), "text": f"Şirketin kâr rakamı {i} puan arttı bugün. Önceki gün durgundu.", "day": "2024", "site": "x"} for i in range(5)]
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    cli.main(["lexicons", str(tmp_path / "lex")])
    common = ["--lexicons", str(tmp_path / "lex"), "--date-field", "day", "--source-field", "site", "--context", "--near-bits", "3", "--band-bits", "8", "--stem"]
    cli.main(["curate", "--input", str(tmp_path / "in.jsonl"), "--output", str(tmp_path / "out"), "--lexicons", str(tmp_path / "lex"), "--date-field", "day", "--source-field", "site", "--context"])
    got = read_lines(tmp_path / "out")
    assert len(got) == 5 and list(got[0]) == ["doc_id", "date", "source", "idx", "sentence", "bucket", "features", "context"]
    assert got[0]["date"] == "2024" and got[0]["source"] == "x" and got[0]["features"]["direction_up"] is True and got[0]["context"]["next"].startswith("Önceki")
    cli.main(["downsample", "--input", str(tmp_path / "out"), "--output", str(tmp_path / "down"), "--total", "20"])
    assert len(read_lines(tmp_path / "down")) == 3  # one template
    cli.main(["filter", "--input", str(tmp_path / "down"), "--output", str(tmp_path / "few"), "--min-true", "2"])
    assert all(r["true_feature_count"] >= 2 and r["features"] for r in read_lines(tmp_path / "few"))
    (tmp_path / "job.json").write_text(json.dumps({"max-per-bucket": 2, "min-true": 0, "output_format": "parquet"}))
    cli.main(["run-all", "--input", str(tmp_path / "in.jsonl"), "--output", str(tmp_path / "all"), "--config", str(tmp_path / "job.json"), *common])
    assert spark.read.parquet(str(tmp_path / "all")).count() <= 2


def test_shared_folder_and_small_scans(spark, tmp_path):
    assert files.work_folder(spark).startswith("/tmp/checkpoints")
    files.write_summary({"a": "ş"}, str(tmp_path / "s.json"), spark)
    assert files.read_summary(spark, str(tmp_path / "s.json")) == {"a": "ş"} and files.read_config(str(tmp_path / "s.json")) == {"a": "ş"}
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "one"))
    scan = spark.read.parquet(str(tmp_path / "one"))
    assert files.spread_out(scan).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and files.spread_out(scan).count() == 10


def test_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "Kâr bu yıl arttı ve büyüdü."), (2, "2024-01-01 00:01:00", "Kâr bu yıl arttı ve büyüdü.")]
    spark.createDataFrame(rows, "doc_id int, at string, text string").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id int, at timestamp, text string").parquet(str(tmp_path / "in"))
    q = stream_candidates(docs, Curation(Lexicons(finance=("kâr",), up=("arttı",))), "at").writeStream.format("memory").queryName("got").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select * from got").count() == 1


def test_catalogue_is_consistent():
    from corpusmill.plans import catalogue

    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.queries()) >= 60
