"""The stages of the pipeline on a small table, each against brute force or its own rule."""

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm.common import release_driver, stored

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, n=400):
    rng = random.Random(21)
    say = lambda k: " ".join(f"w{rng.randrange(10**5)}" for _ in range(k))
    item = say(30)
    texts, labels = {}, []
    for i in range(n):
        junk = rng.random() < 0.2
        t = say(80)
        texts[i] = " ".join(x + "***" for x in t.split()) if junk else t
        labels.append((i, int(not junk), 0))
    near = texts[2000] = say(100)
    for k in range(1, 6):
        w = near.split()
        w[rng.randrange(100)] = "other"
        texts[2000 + k] = " ".join(w)
    texts |= {3000: f"{item} tail", 3001: f"{say(900)} {item}", 4000: f"{say(60)} reach q@mail.example.com or 10.1.2.3", 5000: None, 5001: ""}
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, labels


def test_pipeline(spark, tmp_path):
    texts, labels = write(spark, str(tmp_path))
    assert len(corpus_pipeline.STAGES) == 5
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[k] = {r["doc_id"]: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == [f.split()[0] for f in DOCS.split(", ")], name
    junk = {i for i, good, _ in labels if not good}
    assert len(junk & seen[0].keys()) <= 2 and len(set(texts) - junk - seen[0].keys()) <= 2
    assert [i for i in seen[1] if 2000 <= i < 2010] == [2000] and len(seen[0]) - len(seen[1]) == 5
    assert set(seen[1]) - set(seen[2]) == {3000} and 3001 in seen[2]
    assert seen[3][4000]["text"].endswith("reach <EMAIL> or <IP>") and seen[3][4000]["n_chars"] == len(seen[3][4000]["text"])
    assert set(seen[4]) == set(seen[3])
    last = docs.join(spark.read.parquet(f"{tmp_path}/out3").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("want")), "doc_id")
    assert last.where(F.col("decoded_sha256") != F.col("want")).count() == 0 and last.where(F.size("ids") != F.col("n_tokens")).count() == 0
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in whole.collect()} == set(seen[4])


def test_stages_on_odd_documents(spark, tmp_path):
    """Nulls, repeated ids, long texts, extra columns and an empty table, stage by stage."""
    write(spark, str(tmp_path), 120)
    plain = "doc_id long, text string, lang string, source string, n_chars long, _key string, spans string, row int"
    long_text = " ".join(f"w{k % 7919}" for k in range(60_000))
    rows = [(1, "a b c d e f g h", "en", "s", 15, "k", "x", 1), (1, "q r s t u v w x", "en", "s", 15, "k", "x", 2), (2, "a b c d e f g h", None, None, None, None, None, 3), (None, "a b c d e f g h", "en", "s", 15, "k", "x", 4), (3, None, "en", "s", 0, "k", "x", 5), (4, "", "en", "s", 0, "k", "x", 6), (5, long_text, "en", "s", 1, "k", "x", 7), (6, long_text, "en", "s", 1, "k", "x", 8)]
    docs = spark.createDataFrame(rows, plain)
    near = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in near if r["doc_id"] is None or r["doc_id"] < 5) == [(False, None), (True, 1), (True, 1), (True, 3), (True, 4)]
    assert [r["doc_id"] for r in near if r["doc_id"] in (5, 6)] == [5]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        n = out.count()
        assert (n == 5 + 1 if k == 1 else 0 < n <= len(rows)), name
        if k < 4:
            assert out.columns == plain.replace(" long", "").replace(" string", "").split(", ")[:5]
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0 and none.columns == out.columns


@pytest.mark.parametrize("through", ["stage", "stored"])
def test_the_driver_gives_freed_memory_back(spark, through):
    """Blocks that the JVM has freed between some that it still holds: the C heap keeps them by itself."""
    if not release_driver(spark):
        pytest.skip("this JDK can't be asked")
    jvm = spark.sparkContext._jvm
    path = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    held = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", path.read_text()))) / 1024
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], DOCS)
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe, size = field.get(None), 100_000
    some = [unsafe.allocateMemory(size) for _ in range(1500)]
    for x in some:
        unsafe.setMemory(x, size, 1)
    for k, x in enumerate(some):
        if k % 10:
            unsafe.freeMemory(x)
    before = held()
    if through == "stage":
        corpus_pipeline.encoding(spark, docs, "")
    else:
        stored(docs, "small")
    after = held()
    for x in some[::10]:
        unsafe.freeMemory(x)
    assert before - after > 60, (before, after)
