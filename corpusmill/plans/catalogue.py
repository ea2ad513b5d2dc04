"""Catalogue of the named queries over the test tables, with their SQL.

The tables hold invented prose, so curation takes a lexicon of frequent words; a rule on the
text stands for a classifier, and labels stand for its truth.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import text as T
from ..functions.lexicon import Lexicons, phrase_pattern
from ..functions.sketch import band, hamming, simhash64
from ..operators import curate as C
from ..operators import localise, metrics, packing, report, runs, sampling, score, synth
from ..sources import files

SEED = "42"
LEX = Lexicons(
    finance=tuple("the and der die la el le les".split()),
    up=tuple("from von que est".split()),
    down=tuple("with den en des".split()),
    risk=tuple("for ist por dans".split()),
    legal=tuple("which sich los pour".split()),
    rating=tuple("was nicht una une".split()),
    boilerplate=("rights reserved", "licensed under"),
    word=r"\p{L}\p{N}",
    money="[%$€£]",
)
JOB = C.Curation(LEX)
TOTAL = 1000
#: Of the blocks of the small packing queries.
MAX_LEN = 64


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.spread_out(_t(spark, sf_dir, "documents"))


# --- predictions: labels as truth, a rule on the text as prediction -------------------------


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).join(_t(spark, sf_dir, "labels"), "doc_id")
    truth = F.when(F.col("quality") == 0, "negative").when(F.col("toxic") == 1, "neutral").otherwise("positive")
    rule = F.when(F.col("text").contains("!!") | F.col("text").contains("$$$"), "negative").when(F.col("n_chars") < 500, "neutral").otherwise("positive")
    return rows.select("doc_id", truth.alias("ground_truth"), rule.alias("predicted_label"), F.when(F.col("n_chars") > 2000, "clear").otherwise("nuanced").alias("difficulty"), F.col("lang").alias("category")).withColumn("correct", F.col("ground_truth") == F.col("predicted_label"))


def _classes(spark: SparkSession, sf_dir: str, groups: tuple[str, ...] = ()) -> DataFrame:
    return metrics.per_class(_predictions(spark, sf_dir), "ground_truth", "predicted_label", groups)


PRED_SQL = """pred AS (
  SELECT doc_id, CASE WHEN quality = 0 THEN 'negative' WHEN toxic = 1 THEN 'neutral' ELSE 'positive' END AS ground_truth,
    CASE WHEN contains(text, '!!') OR contains(text, '$$$') THEN 'negative' WHEN n_chars < 500 THEN 'neutral' ELSE 'positive' END AS predicted_label,
    CASE WHEN n_chars > 2000 THEN 'clear' ELSE 'nuanced' END AS difficulty, lang AS category
  FROM documents JOIN labels USING (doc_id)),
lab AS (SELECT * FROM (VALUES (0, 'negative'), (1, 'neutral'), (2, 'positive')) t(place, label))"""


def _class_sql(group: str = "") -> str:
    g = f"{group}, " if group else ""
    on = f"k.{group} = p.{group}" if group else "TRUE"
    keys = f"SELECT DISTINCT {group} FROM pred" if group else "SELECT 1 AS one"
    kg = f"k.{group}, " if group else ""
    return f"""{PRED_SQL},
cnt AS (SELECT {kg}label, place, count(*) FILTER (WHERE ground_truth = label AND predicted_label = label) AS hit,
    count(*) FILTER (WHERE ground_truth = label) AS support, count(*) FILTER (WHERE predicted_label = label) AS predicted_n
  FROM lab, ({keys}) k JOIN pred p ON {on} GROUP BY {kg}label, place),
pr AS (SELECT *, CASE WHEN predicted_n = 0 THEN 0 ELSE hit / predicted_n END AS p, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS r FROM cnt),
cls AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr)"""


# --- sentences -------------------------------------------------------------------------------

LOWER = "replace(replace(lower({0}), 'ß', 'ss'), 'ς', 'σ')"
NORM = "trim(regexp_replace(" + LOWER + r", '\s+', ' ', 'g'))"
SENT_SQL = r"""sents AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?…]) +', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 2) AS s
  FROM documents WHERE trim(coalesce(text, '')) <> ''),
sent AS (SELECT doc_id, unnest(generate_series(0, len(s) - 1))::INT AS idx, unnest(s) AS sentence, unnest(list_concat([''], s[:-2])) AS prev, unnest(list_append(s[2:], '')) AS next FROM sents WHERE len(s) > 0)"""


def _hit(name: str) -> str:
    pattern = phrase_pattern(getattr(LEX, name), LEX.word)
    return f"regexp_matches(' ' || sentence || ' ', '(?i){pattern}')" if pattern else "FALSE"


FLAG_SQL = f"""{SENT_SQL},
flag AS (SELECT *, {_hit("finance")} AS finance_term, FALSE AS company_term, {_hit("up")} AS direction_up, {_hit("down")} AS direction_down,
    {_hit("legal")} AS legal_reg, {_hit("risk")} OR regexp_matches(sentence, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(çeyrek|ceyrek|q[1-4]|yıllık|yillik|aylık|aylik|yoy|qoq)([^\\p{{L}}\\p{{N}}_]|$)') AS guidance_modal,
    {_hit("rating")} AS rating_action, regexp_matches(sentence, '[%$€£]') AS money_or_number
  FROM sent WHERE length(sentence) BETWEEN 20 AND 400 AND NOT contains({NORM.format("sentence")}, 'rights reserved') AND NOT contains({NORM.format("sentence")}, 'licensed under')),
kept AS (SELECT *, CASE WHEN legal_reg THEN 'legal_reg' WHEN rating_action THEN 'rating_action' WHEN direction_up AND NOT direction_down THEN 'finance_up'
    WHEN direction_down AND NOT direction_up THEN 'finance_down' WHEN direction_up THEN 'finance_updown' WHEN guidance_modal THEN 'guidance_modal'
    WHEN money_or_number THEN 'numeric_finance' WHEN finance_term OR company_term THEN 'finance_other' ELSE 'other' END AS bucket
  FROM flag WHERE (finance_term OR company_term) AND (direction_up OR direction_down OR legal_reg OR guidance_modal OR rating_action OR money_or_number)),
uniq AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY md5({NORM.format("sentence")}) ORDER BY doc_id, idx) = 1)"""

_TEMPL = LOWER
for mark, pat in (
    ("<DATE>", r"\b(\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{4})\b"),
    ("<QTR>", r"\b(q[1-4]|[1-4]\.?\s*çeyrek|çeyrek|ceyrek|yoy|qoq)\b"),
    ("<PCT>", r"(%|\byüzde\b)"),
    ("<CUR>", r"(₺|\btl\b|\btry\b|\busd\b|\beur\b|\bgbp\b|\bdolar\b|\beuro\b)"),
    ("<NUM>", r"\b\d+(?:[.,]\d+)?\b"),
):
    _TEMPL = f"regexp_replace({_TEMPL}, '{pat.replace('{', '{{').replace('}', '}}')}', ' {mark} ', 'gi')"
TEMPL = f"trim(regexp_replace({_TEMPL}, '\\s+', ' ', 'g'))"
SIM_TOKENS = f"list_filter(regexp_split_to_array(regexp_replace({NORM}, '[^0-9A-Za-zğüşöçıİĞÜŞÖÇ]', ' ', 'g'), ' +'), lambda t: length(t) >= 2)"
SIM_SQL = f"""tok AS (SELECT doc_id, unnest({SIM_TOKENS.format("text")}) AS t FROM documents),
half AS (SELECT doc_id, xor(('0x' || substr(md5(t), 1, 16))::UBIGINT, ('0x' || substr(md5(t), 17, 16))::UBIGINT) AS h FROM tok),
bits AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM half, generate_series(0, 63) g(b) GROUP BY doc_id, b),
sim AS (SELECT doc_id, coalesce(sum(CASE WHEN v >= 0 THEN (1::HUGEINT << b) ELSE 0 END), 0)::UBIGINT AS h FROM documents LEFT JOIN bits USING (doc_id) GROUP BY doc_id),
first AS (SELECT h, min(doc_id) AS doc_id FROM sim GROUP BY h)"""


def sentence_split(spark, sf_dir):
    return C.sentences(_docs(spark, sf_dir), ["doc_id"], "text")


def sentence_clean(spark, sf_dir):
    cleaned = T.clean_sentences(T.split_sentences(T.preprocess(F.col("text"))))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(cleaned).alias("idx", "sentence"))


def normalize_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.md5_norm(F.col("text")).alias("hash"))


def lexicon_flags(spark, sf_dir):
    return C.gated(_docs(spark, sf_dir), JOB, ["doc_id"]).select("doc_id", "idx", *(F.col(f"features.{f}").alias(f) for f in C.FLAGS))


def keep_rule(spark, sf_dir):
    rows = C.gated(_docs(spark, sf_dir), JOB, ["doc_id"]).where(C.keeps(F.col("features")))
    return rows.select("doc_id", "idx", C.bucket_of(F.col("features")).alias("bucket"))


def bucket_counts(spark, sf_dir):
    return keep_rule(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"))


def boilerplate_drop(spark, sf_dir):
    rows = C.sentences(_docs(spark, sf_dir), ["doc_id"], "text")
    return rows.groupBy(T.is_boilerplate(F.col("sentence"), LEX.boilerplate).alias("boilerplate")).agg(F.count("*").alias("n"))


def context_window(spark, sf_dir):
    return C.gated(_docs(spark, sf_dir), JOB, ["doc_id"]).where(C.keeps(F.col("features"))).select("doc_id", "idx", F.md5("sentence").alias("sentence"), F.md5("prev").alias("prev"), F.md5("next").alias("next"))


def _candidates(spark, sf_dir):
    return C.candidates(_docs(spark, sf_dir), JOB)


def exact_dedup(spark, sf_dir):
    return _candidates(spark, sf_dir).select("doc_id", "idx", "bucket")


def near_candidates(spark, sf_dir):
    return C.candidates(_docs(spark, sf_dir), C.Curation(LEX, near_bits=3, context=True)).select("doc_id", "idx", "bucket", "prev", "next")


def _hashed(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", simhash64(F.col("text")).alias("h"))


def simhash(spark, sf_dir):
    return _hashed(spark, sf_dir).select("doc_id", F.lower(F.lpad(F.hex("h"), 16, "0")).alias("simhash"))


def simhash_band_pairs(spark, sf_dir):
    """Pairs of different hashes (each with its first document) within 3 bits in a band."""
    once = _hashed(spark, sf_dir).groupBy("h").agg(F.min("doc_id").alias("doc_id")).withColumn("band", band(F.col("h")))
    a, b = (once.select("band", F.col("h").alias(f"h_{k}"), F.col("doc_id").alias(f"doc_{k}")) for k in "ab")
    return a.join(b, "band").where((F.col("doc_a") < F.col("doc_b")) & (hamming(F.col("h_a"), F.col("h_b")) <= 3)).select("doc_a", "doc_b", hamming(F.col("h_a"), F.col("h_b")).cast("long").alias("distance"))


def neardup_greedy(spark, sf_dir):
    return C.greedy_survivors(_hashed(spark, sf_dir), "h", ["doc_id"]).select("doc_id")


def template_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.template(F.col("text"))).alias("template"))


def template_cap(spark, sf_dir):
    rows = C.sentences(_docs(spark, sf_dir), ["doc_id"], "text").withColumn("t", T.template(F.col("sentence")))
    w = Window.partitionBy("t").orderBy("doc_id", "idx")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 3).select("doc_id", "idx")


def template_counts(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("t", F.md5(T.template(F.col("sentence"))))
    by = rows.groupBy("bucket", "t").agg(F.count("*").alias("n"))
    return by.groupBy("bucket").agg(F.sum("n").alias("seen"), F.sum(F.least("n", F.lit(3))).alias("kept"), F.count("*").alias("templates"))


def bucket_targets(spark, sf_dir):
    rows = [(t, b, n) for t in (20000, 100, 7, 33, 10, 25) for b, n in M.bucket_targets(t, C.FRACTIONS).items()]
    return spark.createDataFrame(rows, "total int, bucket string, target int")


def reservoir_per_bucket(spark, sf_dir):
    return C.drawn(_candidates(spark, sf_dir), "bucket", 50, SEED, ["doc_id", "idx"]).select("doc_id", "idx", "bucket")


def downsample(spark, sf_dir):
    return C.downsample(_candidates(spark, sf_dir), M.bucket_targets(TOTAL, C.FRACTIONS), SEED, ["doc_id", "idx"]).select("doc_id", "idx", "bucket")


def min_true_filter(spark, sf_dir):
    return C.filter_features(_candidates(spark, sf_dir)).select("doc_id", "idx", "true_feature_count")


def curate_run_all(spark, sf_dir):
    return C.run_all(_docs(spark, sf_dir), JOB, TOTAL, SEED, least=3).select("doc_id", "idx", "bucket", "true_feature_count")


# --- samples ---------------------------------------------------------------------------------


def holdout_split(spark, sf_dir):
    return sampling.holdout(_docs(spark, sf_dir), ["doc_id"], SEED).select("doc_id", "split")


def _stratified(spark, sf_dir):
    return sampling.stratified(_t(spark, sf_dir, "labels"), ["quality", "toxic"], ["doc_id"], SEED)


def stratified_split(spark, sf_dir):
    return _stratified(spark, sf_dir).select("doc_id", "split")


def split_sizes(spark, sf_dir):
    return sampling.split_sizes(_stratified(spark, sf_dir))


def union_splits(spark, sf_dir):
    s = _stratified(spark, sf_dir)
    return s.where("split = 'train'").unionByName(s.where("split = 'validation'")).groupBy("quality").agg(F.count("*").alias("n"))


def head_subset(spark, sf_dir):
    return sampling.head(_docs(spark, sf_dir), ["doc_id"], 100).select("doc_id", "n_chars")


def shuffled_subset(spark, sf_dir):
    return sampling.shuffled(_docs(spark, sf_dir), ["doc_id"], SEED, 100).select("doc_id")


def slice_rows(spark, sf_dir):
    return sampling.sliced(_docs(spark, sf_dir), ["doc_id"], 50, 120).select("doc_id")


# --- packing ---------------------------------------------------------------------------------


def _sentence_ids():
    return F.transform(T.split_sentences(F.col("text")), lambda s: packing.stand_in_ids(F.split(s, " ")))


def _blocks(spark, sf_dir):
    return packing.pack(_t(spark, sf_dir, "benchmark").select("item_id", _sentence_ids().alias("s")), ["item_id"], "s", 1, MAX_LEN, 8)


def _listed_blocks(blocks):
    return blocks.select("shard", "block", F.size("input_ids").alias("n"), F.md5(F.concat_ws(",", F.col("input_ids").cast("array<string>"))).alias("ids"), F.size("attention_mask").alias("mask_n"))


def packed_documents(spark, sf_dir):
    """Blocks of the documents, in the constant number of runs (the fold is too slow in SQL here)."""
    blocks = packing.pack(_docs(spark, sf_dir).select("doc_id", _sentence_ids().alias("s")), ["doc_id"], "s")
    return _listed_blocks(blocks)


def token_packing(spark, sf_dir):
    """Short blocks of the benchmark's items, in one run."""
    return _listed_blocks(_blocks(spark, sf_dir))


def packing_stats(spark, sf_dir):
    return packing.packing_stats(_blocks(spark, sf_dir), MAX_LEN)


def block_histogram(spark, sf_dir):
    return packing.length_histogram(_blocks(spark, sf_dir), 16, MAX_LEN, 4)


def _turn_ids(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), packing.stand_in_ids(F.split(T.collapse(F.col("text")), " ")).alias("ids"))
    return rows


def mlm_mask(spark, sf_dir):
    rows = _turn_ids(spark, sf_dir)
    x, y = packing.masked(F.col("ids"), SEED, F.col("key"))
    return rows.select("key", F.concat_ws(",", x.cast("array<string>")).alias("input_ids"), F.concat_ws(",", y.cast("array<string>")).alias("labels"))


def mlm_metrics(spark, sf_dir):
    rows = _turn_ids(spark, sf_dir).select("key", F.posexplode("ids").alias("pos", "id"))
    rows = rows.select((F.pmod(F.col("id"), F.lit(7))).alias("batch"), F.when(F.col("id") % 5 == 0, F.lit(-100)).otherwise(F.col("id")).alias("label"), ((F.col("id") % 11) / 10.0).alias("loss"), F.array(*(F.col("id") + (F.col("id") % 4) - i for i in range(3))).alias("ranked"))
    return metrics.mlm_metrics(rows, "batch", "loss", "label", "ranked", 2)


def pad_truncate(spark, sf_dir):
    return _turn_ids(spark, sf_dir).select("key", F.concat_ws(",", packing.padded(F.col("ids"), 24).cast("array<string>")).alias("padded"), F.size(packing.chunked(F.col("ids"), 10)).alias("chunks"))


# --- metrics and reports ---------------------------------------------------------------------


def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_predictions(spark, sf_dir), "ground_truth", "predicted_label")


def class_metrics(spark, sf_dir):
    return metrics.rounded_classes(_classes(spark, sf_dir))


def overall_metrics(spark, sf_dir):
    return metrics.summary(_classes(spark, sf_dir))


def weighted_metrics(spark, sf_dir):
    return metrics.weighted(_classes(spark, sf_dir))


def group_metrics(spark, sf_dir):
    return metrics.grouped_summary(_predictions(spark, sf_dir), "ground_truth", "predicted_label", ["difficulty", "category"])


def score_texts(spark, sf_dir):
    """A stand-in model's classes, in Arrow batches."""
    scored = score.score_texts(_docs(spark, sf_dir).select("doc_id", "text"), "text", score.rule_model)
    return scored.select("doc_id", "predicted_label", *(F.round(f"score_{k}", 5).alias(f"score_{k}") for k in metrics.LABELS))


def attach_predictions(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "negative").otherwise("positive").alias("ground_truth"))
    predicted = _predictions(spark, sf_dir).select("doc_id", "predicted_label")
    return metrics.attach_predictions(rows, predicted, "doc_id", "ground_truth").groupBy("ground_truth", "correct").agg(F.count("*").alias("n"))


def masked_accuracy(spark, sf_dir):
    rows = _t(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 3 == 0, -100).otherwise(F.col("quality")).alias("label"), (F.col("doc_id") % 5 != 0).cast("int").alias("predicted"))
    return metrics.masked_accuracy(rows, "predicted", "label")


def softmax_argmax(spark, sf_dir):
    p = metrics.softmax(F.col("embedding"))
    return _t(spark, sf_dir, "embeddings").select("vec_id", metrics.argmax(F.col("embedding")).alias("predicted"), F.round(F.array_max(p), 6).alias("score"))


def mismatches(spark, sf_dir):
    return report.mismatches(_predictions(spark, sf_dir)).select("doc_id", "ground_truth", "predicted_label")


def error_transitions(spark, sf_dir):
    return report.transitions(report.mismatches(_predictions(spark, sf_dir)), "doc_id").withColumn("rank", F.col("rank").cast("long"))


def dominant_transition(spark, sf_dir):
    return report.dominant(_predictions(spark, sf_dir), "category", "doc_id")


def class_distribution(spark, sf_dir):
    return report.class_distribution(_predictions(spark, sf_dir))


def category_ranking(spark, sf_dir):
    g = group_metrics(spark, sf_dir).where("grouping = 'category'")
    return report.ranking(g).select("key", "accuracy", "macro_f1", F.col("rank").cast("long").alias("rank"), report.tier(F.col("accuracy")).alias("tier"))


def worst_categories(spark, sf_dir):
    g = group_metrics(spark, sf_dir).where("grouping = 'category'")
    return g.orderBy("accuracy", "macro_f1", "key").limit(2).select("key", T.percent(F.col("accuracy")).alias("accuracy"), T.four_places(F.col("macro_f1")).alias("macro_f1"))


def lowest_recall(spark, sf_dir):
    return report.lowest_recall(_classes(spark, sf_dir))


def intensity(spark, sf_dir):
    cells = _predictions(spark, sf_dir).groupBy("ground_truth", "predicted_label").agg(F.count("*").alias("n"))
    return report.intensity(cells)


def label_distribution(spark, sf_dir):
    return report.distribution(_predictions(spark, sf_dir), ["ground_truth", "difficulty", "category", "correct"])


LABEL_NAMES = {"negative": "negatif", "neutral": "nötr"}


def label_translate(spark, sf_dir):
    return _predictions(spark, sf_dir).select("doc_id", T.translated(F.col("ground_truth"), LABEL_NAMES).alias("name"), T.slug(F.concat_ws(" ", "category", "difficulty")).alias("slug"))


# --- money, JSON, synthetic data, runs -------------------------------------------------------


def _amounts(spark, sf_dir):
    k = F.col("o_orderkey")
    unit = F.element_at(F.array(*map(F.lit, ("", "k", " million", "m", " bn"))), (k % 5 + 1).cast("int"))
    whole = F.floor(F.col("o_totalprice") / 1000).cast("string")
    return _t(spark, sf_dir, "orders").select(k.alias("k"), (F.lit(1999) + k % 14).cast("int").alias("year"), F.element_at(F.array(*map(F.lit, ("USD", "EUR", "GBP"))), (k % 3 + 1).cast("int")).alias("currency"), F.when(k % 17 == 0, "n/a").otherwise(F.concat(F.lit("$"), whole, F.lit("."), (k % 10).cast("string"), unit)).alias("amount"))


def money_convert(spark, sf_dir):
    out = M.convert(_amounts(spark, sf_dir), "year", "currency", "amount", strict_reference=True)
    return out.select("k", F.col("amount_value").cast("double").alias("amount_value"), "tl_formatted")


def tl_format(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", M.format_lira(F.col("o_totalprice").cast("decimal(20,2)")).alias("tl"), T.decimal_comma(F.col("o_totalprice").cast("double"), 2).alias("plain"))


def json_text_resolve(spark, sf_dir):
    """A field of the list, a nested one, one a level below, any long string, and no object."""
    text, role, k = F.col("text"), F.col("role"), F.col("turn") % 5
    record = (
        F.when(k == 0, F.to_json(F.struct(text.alias("content"), role.alias("role"))))
        .when(k == 1, F.to_json(F.struct(F.struct(text.alias("sentence")).alias("train"), role.alias("prompt"))))
        .when(k == 2, F.to_json(F.struct(F.struct(F.lit(1).alias("n"), text.alias("note")).alias("meta"))))
        .when(k == 3, F.to_json(F.struct(text.alias("remark"), F.lit(2).alias("n"))))
        .otherwise(F.lit("[1]"))
    )
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(localise.resolve_text(record)).alias("text"))


def synthetic_benchmark(spark, sf_dir):
    return synth.benchmark(spark)


def phrasebank(spark, sf_dir):
    return synth.phrasebank(spark)


def synthetic_distribution(spark, sf_dir):
    return report.distribution(synth.benchmark(spark), ["ground_truth", "difficulty", "category", "category_tr"])


# --- sources and sinks: written to the shared folder and read back ---------------------------


def _folder(spark, name):
    return f"{files.work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def jsonl_round_trip(spark, sf_dir):
    """The tolerant reader leaves out what has no text."""
    path = _folder(spark, "jsonl")
    files.write_jsonl(_docs(spark, sf_dir).select("doc_id", "text", "lang"), path)
    return files.read_jsonl(spark, path, ["doc_id", "text", "lang"], "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text"), "lang")


def jsonl_strict(spark, sf_dir):
    path = _folder(spark, "strict")
    files.write_jsonl(_docs(spark, sf_dir).select("doc_id", "text", "n_chars"), path)
    return files.read_jsonl_strict(spark, path, "doc_id long, text string, n_chars long").select("doc_id", F.md5("text").alias("text"), "n_chars")


def csv_round_trip(spark, sf_dir):
    """Quotes and line breaks come back; an empty text is a missing one."""
    path = _folder(spark, "csv")
    files.write_csv(_docs(spark, sf_dir).where("text <> ''"), path, ["doc_id", "text", "source"])
    return files.read_csv(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text"), "source")


def dataset_rewrite(spark, sf_dir):
    """A stored dataset that is replaced by what is computed from it."""
    path = _folder(spark, "dataset")
    files.save_dataset(_docs(spark, sf_dir).select("doc_id", "lang", "n_chars"), path)
    files.rewrite(files.load_dataset(spark, path).withColumn("n_chars", F.col("n_chars") * 2), path, files.save_dataset)
    return files.load_dataset(spark, path)


def candidate_files(spark, sf_dir):
    """Candidates written in the layout of files and read back as columns."""
    path = _folder(spark, "candidates")
    found = C.candidates(_docs(spark, sf_dir), C.Curation(LEX, context=True), keep=["source"])
    files.write_jsonl(C.laid_out(found, source_col="source"), path)
    rows = C.flat(spark.read.schema(C.LAYOUT).json(path))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "idx", F.md5("sentence").alias("sentence"), "bucket", C.true_count().alias("n_true"), F.md5("prev").alias("prev"))


def category_report(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    return report.category_report(group_metrics(spark, sf_dir).where("grouping = 'category'").drop("grouping"), p, "category", "doc_id")


SWEEP = [("adamw", 5e-5, 300, 1.92, 0.61), ("adamw", 1e-4, 300, 1.81, 0.63), ("lion", 1e-5, 300, 1.87, 0.62), ("adafactor", 1e-4, 300, 1.81, 0.6)]
LOG = [("train", 1, 10, 0.9, None, None), ("train", 1, 20, 0.7, None, None), ("eval", 1, 20, None, 0.65, 0.81), ("train", 2, 30, 0.5, None, None), ("eval", 2, 40, None, 0.6, 0.84), ("end", 2, 40, None, None, None)]
GAP = [(1, "train", 0.8512), (1, "eval", 0.8119), (2, "train", 0.912), (2, "eval", 0.8489), (3, "train", 0.9305), (3, "eval", 0.8622)]


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)


def _log(spark):
    return spark.createDataFrame(LOG, "what string, epoch int, step int, loss double, eval_loss double, eval_accuracy double")


def sweep_best(spark, sf_dir):
    return runs.sweep_best(spark.createDataFrame(SWEEP, "optim string, lr double, steps int, eval_loss double, eval_accuracy double"))


def train_eval_gap(spark, sf_dir):
    return runs.train_eval_gap(spark.createDataFrame(GAP, "epoch int, kind string, accuracy double"))


def log_split(spark, sf_dir):
    return runs.log_kinds(_log(spark)).groupBy("kind").agg(F.count("*").alias("n"))


def final_run(spark, sf_dir):
    return runs.final_run(_log(spark))


def timing_summary(spark, sf_dir):
    return runs.timing(_t(spark, sf_dir, "events").select(F.abs("value").alias("seconds")))


def compare_pivot(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("model", F.when(F.col("event_id") % 2 == 0, "base").otherwise("adapted")).groupBy("event_type", "model").agg(F.count("*").alias("n"))
    return report.comparison(rows, ["event_type"], "model", "n", ["base", "adapted"])


def cost_totals(spark, sf_dir):
    usage = _docs(spark, sf_dir).select(F.col("n_chars").alias("input_tokens"), (F.col("n_chars") % 100).alias("output_tokens"))
    return runs.costs(usage, 1.25, 10.0)


NAMES = (
    "sentence_split sentence_clean normalize_hash lexicon_flags keep_rule bucket_counts boilerplate_drop context_window exact_dedup near_candidates "
    "simhash simhash_band_pairs neardup_greedy template_normalize template_cap template_counts bucket_targets reservoir_per_bucket downsample min_true_filter "
    "curate_run_all holdout_split stratified_split split_sizes union_splits head_subset shuffled_subset slice_rows token_packing packed_documents packing_stats block_histogram "
    "mlm_mask mlm_metrics pad_truncate confusion_matrix class_metrics overall_metrics weighted_metrics group_metrics score_texts attach_predictions masked_accuracy softmax_argmax mismatches "
    "error_transitions dominant_transition class_distribution category_ranking worst_categories lowest_recall intensity label_distribution label_translate "
    "money_convert tl_format json_text_resolve synthetic_benchmark phrasebank synthetic_distribution jsonl_round_trip jsonl_strict csv_round_trip dataset_rewrite candidate_files category_report sweep_best train_eval_gap log_split final_run timing_summary compare_pivot cost_totals"
).split()


def queries() -> dict:
    here = globals()
    return {n: here[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return {n: SQL[n] for n in NAMES if n in SQL}
