import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.lexicon import Lexicons
from corpusmill.operators import curate as C
from corpusmill.operators import localise, metrics, packing, report, sampling, score, synth

LEX = Lexicons(finance=("kâr",), up=("arttı",), down=("düştü",), legal=("dava",), rating=("not",), risk=("beklenti",), boilerplate=("abone ol",))


def test_packing_lengths():
    for docs, want in (([[3, 2], [4]], [9, 7]), ([[3], [], [], [2]], [8, 5]), ([[20, 1]], [10, 10, 6, 4]), ([[6]], [9]), ([[5], [2]], [8, 5])):
        p, out = packing.Packer(10, 4), []
        for d in docs:
            for n in d:
                out += p.sentence([7] * n)
            out += p.document_end()
        out += p.end()
        assert [len(b) for b in out] == want
        assert all(b[0] == packing.CLS and b[-1] == packing.SEP and len(b) <= 10 for b in out)


def test_pack_on_spark(spark):
    df = spark.createDataFrame([(0, [[7, 7, 7], [7, 7]]), (1, [[7] * 4]), (2, None)], "doc_id int, s array<array<int>>")
    rows = packing.pack(df, ["doc_id"], "s", 1, 10, 4).orderBy("block").collect()
    assert [len(r["input_ids"]) for r in rows] == [9, 8] and all(len(r["attention_mask"]) == len(r["input_ids"]) for r in rows)
    assert packing.pack(df.limit(0), ["doc_id"], "s", 2, 10, 4).count() == 0
    stats = packing.packing_stats(packing.pack(df, ["doc_id"], "s", 1, 10, 4), 10).first()
    assert (stats["blocks"], stats["tokens"], stats["max_len"]) == (2, 17, 9)


def test_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([(0, [1] * n) for n in (400, 403, 404, 511, 512, 399)], "k int, input_ids array<int>")
    assert {r["bin_start"]: r["n"] for r in packing.length_histogram(df).collect()} == {400: 2, 404: 1, 508: 2}


def test_near_duplicates_fold(spark):
    rows = [(i, h) for i, h in enumerate((0, 1, 240, 241, 15))]
    got = C.greedy_survivors(spark.createDataFrame(rows, "i int, h long"), "h", ["i"]).select("i").collect()
    assert sorted(r["i"] for r in got) == [0, 2, 4]


def test_curation_stages(spark):
    docs = spark.createDataFrame(
        [
            (1, "Şirketin kâr rakamı bu yıl arttı. Şirketin kâr rakamı bu yıl arttı. Bugün hava çok güzel olacak."),
            (2, "Şirketin  KÂR rakamı bu yıl arttı. Mahkeme kâr payı için dava açtı ve kâr arttı. Kâr için bize abone ol arttı."),
            (3, None),
            (4, "   "),
            (5, "Kâr arttı ve sonra kâr düştü diye yazdı. Kâr %5 oranında açıklandı bugün. Kâr için beklenti korunuyor."),
        ],
        "doc_id int, text string",
    )
    rows = C.candidates(docs, C.Curation(LEX, context=True)).orderBy("doc_id", "idx").collect()
    assert [(r["doc_id"], r["idx"], r["bucket"]) for r in rows] == [(1, 0, "finance_up"), (2, 1, "legal_reg"), (5, 0, "finance_updown"), (5, 1, "numeric_finance"), (5, 2, "guidance_modal")]
    assert rows[1]["prev"].endswith("arttı.") and rows[0]["prev"] == ""
    assert C.filter_features(C.candidates(docs, C.Curation(LEX)), 3).count() == 2
    near = C.candidates(docs, C.Curation(LEX, near_bits=3))
    assert near.where("doc_id = 1").count() == 1
    assert C.candidates(docs.limit(0), C.Curation(LEX)).count() == 0
    spread = C.candidates(docs.repartition(7), C.Curation(LEX)).select("doc_id", "idx").orderBy("doc_id", "idx").collect()
    assert spread == [r for r in spark.createDataFrame([(r["doc_id"], r["idx"]) for r in rows], "doc_id int, idx int").collect()]


def test_samples_depend_on_the_seed_only(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    a = sampling.stratified(df, ["k"], ["id"], "1").groupBy("k", "split").count().collect()
    assert {(r["k"], r["split"]): r["count"] for r in a}[(0, "train")] == 267
    one = {r["id"] for r in sampling.shuffled(df, ["id"], "s", 20).collect()}
    two = {r["id"] for r in sampling.shuffled(df.repartition(9), ["id"], "s", 20).collect()}
    assert one == two and len(one) == 20
    assert 20 <= sampling.holdout(df, ["id"], "s").where("split = 'test'").count() <= 80
    assert [r["id"] for r in sampling.sliced(df, ["id"], -5, 2).collect()] == [0, 1]
    with pytest.raises(ValueError):
        sampling.sliced(df, ["id"], 1000)


GOLDEN = [
    ([[60, 40, 20], [0, 114, 6], [0, 20, 100]], 0.7611, 0.7517, [(1.0, 0.5, 0.6667), (0.6552, 0.95, 0.7755), (0.7937, 0.8333, 0.8130)]),
    ([[122, 128, 100], [0, 313, 37], [0, 79, 271]], 0.6724, 0.6505, None),
]


@pytest.mark.parametrize(("matrix", "accuracy", "macro", "classes"), GOLDEN)
def test_golden_metrics(spark, matrix, accuracy, macro, classes):
    L = metrics.LABELS
    rows = [(L[t], L[p]) for t in range(3) for p in range(3) for _ in range(matrix[t][p])]
    df = spark.createDataFrame(rows, "t string, p string")
    per = metrics.per_class(df, "t", "p")
    s = metrics.summary(per).first()
    assert (s["count"], s["accuracy"], s["macro_f1"]) == (len(rows), accuracy, macro)
    if classes:
        got = {r["label"]: (r["precision"], r["recall"], r["f1"]) for r in metrics.rounded_classes(per).collect()}
        assert [got[k] for k in L] == classes
    cm = {r["truth"]: [r[f"n_{k}"] for k in L] for r in metrics.confusion(df, "t", "p").collect()}
    assert [cm[k] for k in L] == matrix


def test_metric_edges(spark):
    schema = "t string, p string"
    single = spark.createDataFrame([("neutral", "neutral")] * 3, schema)
    assert metrics.summary(metrics.per_class(single, "t", "p")).first()["macro_f1"] == 1.0
    none = spark.createDataFrame([("neutral", "positive")] * 3, schema)
    assert metrics.summary(metrics.per_class(none, "t", "p")).first()["macro_f1"] == 0.0
    empty = metrics.summary(metrics.per_class(none.limit(0), "t", "p")).first()
    assert empty["accuracy"] == 0.0 and empty["macro_f1"] == 0.0
    odd = spark.createDataFrame([("other", "positive"), ("neutral", "neutral")], schema)
    assert metrics.confusion(odd, "t", "p").agg(F.sum("n_neutral")).first()[0] == 1
    with pytest.raises(Exception):
        metrics.confusion(odd, "t", "p", strict=True).collect()


def test_reports(spark):
    df = spark.createDataFrame([(1, "a", "negative", "neutral"), (2, "a", "negative", "positive"), (3, "a", "negative", "positive"), (4, "b", "neutral", "neutral")], "i int, category string, ground_truth string, predicted_label string")
    got = {r["category"]: r["dominant"] for r in report.dominant(df, "category", "i").collect()}
    assert got == {"a": "negative → positive (2)", "b": report.NO_ERRORS}
    page = report.render("R <1>", {"d": report.class_distribution(df)})
    assert "R &lt;1&gt;" in page and "<table>" in page
    assert report.bar_chart({"a": 2}).startswith("<svg")


def test_scores(spark):
    df = spark.createDataFrame([("wow!!!",), ("long " * 200 + ",",), (None,)], "text string")
    out = score.score_texts(df, "text", score.rule_model).collect()
    assert out[0]["predicted_label"] == "negative" and abs(sum(out[0][f"score_{k}"] for k in metrics.LABELS) - 1) < 1e-5


def test_text_resolution(spark):
    cases = [
        ('{"train":{"sentence":"s"},"text":"t"}', "s"),
        ('{"content":"c","text":5}', "c"),
        ('{"a":"short","b":"long enough text"}', "long enough text"),
        ('{"a":{"x":"y","z":"nested long text"}}', "nested long text"),
        ("[1]", None),
        ("nope", None),
        ('{"a":1}', None),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, r string")
    got = [r["t"] for r in df.select("i", localise.resolve_text(F.col("r")).alias("t")).orderBy("i").collect()]
    assert got == [w for _, w in cases]
    up = localise.translate(spark.createDataFrame([("a",), (None,)], "t string"), "t", lambda xs: [x.upper() for x in xs])
    assert sorted((r["translated_text"] or "") for r in up.collect()) == ["", "A"]


def test_synthetic(spark):
    b = synth.benchmark(spark, per_family=5)
    rows = b.collect()
    assert b.columns == ["id", "text", "ground_truth", "ground_truth_tr", "difficulty", "difficulty_tr", "category", "category_tr", "label_rationale", "source"]
    assert len(rows) == 90 and len({r["text"] for r in rows}) == 90 and len({r["category"] for r in rows}) == 18 and not any("{" in r["text"] for r in rows)
    assert {r["ground_truth_tr"] for r in rows} == {"negatif", "nötr", "pozitif"} and all(r["category_tr"] and r["label_rationale"] for r in rows)
    p = synth.phrasebank(spark, per_family=3).collect()
    assert len(p) == 63 and len({r["category_id"] for r in p}) == 21 and len({r["category_id"] for r in p if r["hard_case"]}) == 5 and {r["viewpoint"] for r in p} == {"investor_impact"}
    with pytest.raises(Exception, match="too few"):
        synth.benchmark(spark, [synth.Family("x", "neutral", "clear", "{company}.")], per_family=50).collect()


def test_shards_are_packed_as_one_run_each(spark):
    """Against the plain fold, document by document."""
    rng = random.Random(3)
    rows = [(k, [[rng.randrange(9, 99) for _ in range(rng.randrange(1, 30))] for _ in range(rng.randrange(0, 6))]) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, s array<array<int>>")
    got = {}
    for r in packing.pack(df, ["k"], "s", 4, 24, 5).collect():
        got.setdefault(r["shard"], {})[r["block"]] = r["input_ids"]
    want = {}
    for shard in range(4):
        packer, out = packing.Packer(24, 5), []
        for k, s in rows:
            if int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % 4 == shard:
                out += [b for x in s for b in packer.sentence(x)] + packer.document_end()
        want[shard] = dict(enumerate(out + packer.end()))
    assert got == want


def test_tokenizer_and_splitter_plug_in(spark):
    df = spark.createDataFrame([("a bb. ccc",), (None,)], "t string")
    ids = df.select(packing.tokenized(F.split("t", " "), lambda texts: [[len(t)] for t in texts], spark).alias("x")).collect()
    assert [r["x"] for r in ids] == [[[1], [3], [3]], None]
    halves = df.select(T.split_by(lambda texts: [t.split(".") for t in texts])(F.col("t")).alias("x")).collect()
    assert halves[0]["x"] == ["a bb", " ccc"]
    fails = df.select(T.split_by(lambda texts: 1 / 0)(F.col("t")).alias("x"), T.split_sentences(F.col("t")).alias("y")).collect()
    assert fails[0]["x"] == fails[0]["y"]


def test_defaults_category_report_and_charts(spark):
    df = spark.createDataFrame([(1, "negative", "a"), (2, "neutral", "a"), (3, "neutral", "b")], "id int, ground_truth string, category string")
    filled = metrics.with_defaults(df, {"difficulty": "unknown", "category": "x", "name": "=category"})
    assert [tuple(r)[3:] for r in filled.collect()] == [("unknown", "a"), ("unknown", "a"), ("unknown", "b")]
    predicted = spark.createDataFrame([(1, "neutral"), (2, "neutral"), (3, "neutral")], "id int, predicted_label string")
    scored = metrics.attach_predictions(df, predicted, "id", "ground_truth", True, {"difficulty": "clear"})
    by = metrics.grouped_summary(scored, "ground_truth", "predicted_label", ["category"]).where("grouping = 'category'")
    rows = {r["key"]: (r["mismatch_count"], r["dominant"]) for r in report.category_report(by, scored, "category", "id").collect()}
    assert rows == {"a": (1, "negative → neutral (1)"), "b": (0, report.NO_ERRORS)}
    svg = report.heat_map({("x", "x"): 3, ("x", "<y>"): 1}, ["x", "<y>"], ["x", "<y>"])
    assert svg.count("<rect") == 4 and "&lt;y&gt;" in svg


@pytest.mark.parametrize("bits", [0, 1, 3, 6])
def test_near_duplicate_fold_against_brute_force(spark, bits):
    rng = random.Random(bits)
    hashes = []
    for _ in range(40):
        base = rng.getrandbits(64)
        hashes += [base] + [base ^ sum(1 << b for b in rng.sample(range(48), rng.randrange(0, 9))) for _ in range(6)]
    rows = [(h - (1 << 64) if h >> 63 else h, i) for i, h in enumerate(hashes)]
    got = {r["at"] for r in C.greedy_survivors(spark.createDataFrame(rows, "h long, at int"), "h", ["at"], bits, 16).collect()}
    alive, want = {}, set()
    for i, h in enumerate(hashes):
        near = [x for x in alive.setdefault(h >> 48, []) if (x ^ h).bit_count() <= bits]
        if not near:
            alive[h >> 48].append(h)
            want.add(i)
    assert got == want
