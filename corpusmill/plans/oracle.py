"""SQL of the catalogue's queries, for an independent engine."""

from __future__ import annotations

from ..functions.money import FX
from ..operators.curate import FRACTIONS
from ..operators.synth import benchmark_sql, phrasebank_sql
from . import catalogue as C

SEED = C.SEED
DRAWN = f"md5('{SEED}' || '|' || bucket || '|' || doc_id || '|' || idx)"
TARGETS = f"tgt AS (SELECT * FROM (VALUES {', '.join(f"('{b}', {n})" for b, n in C.M.bucket_targets(C.TOTAL, FRACTIONS).items())}) t(bucket, target))"
DOWN = f"""{C.FLAG_SQL},
{TARGETS},
capped AS (SELECT * FROM uniq JOIN tgt USING (bucket) WHERE target > 0 QUALIFY row_number() OVER (PARTITION BY {C.TEMPL.format("sentence")} ORDER BY doc_id, idx) <= 3),
down AS (SELECT * FROM capped QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY {DRAWN}, doc_id, idx) <= target)"""
TRUE_N = "(" + " + ".join(f"{f}::INT" for f in ("finance_term", "company_term", "direction_up", "direction_down", "legal_reg", "guidance_modal", "rating_action", "money_or_number")) + ")"
CLEAN = r"""pre AS (SELECT doc_id, trim(regexp_replace(replace(translate(regexp_replace(regexp_replace(coalesce(text, ''), '(\d+)([a-zA-ZçğıöşüÇĞİÖŞÜ])', '\1 \2', 'g'), '\s+', ' ', 'g'), '–—', '--'), '…', '...'), '([a-zçğıöşü])([A-ZÇĞİÖŞÜ][a-zçğıöşü])', '\1. \2', 'g')) AS text FROM documents),
sents AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?…]) +', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 2) AS s FROM pre),
good AS (SELECT doc_id, list_transform(list_filter(s, lambda x: length(x) BETWEEN 15 AND 512 AND regexp_matches(x, '\p{L}') AND len(string_split(x, ' ')) >= 2), lambda x: CASE WHEN regexp_matches(x, '[\p{L}\p{N}]$') THEN x || '.' ELSE x END) AS s FROM sents)
SELECT doc_id, unnest(generate_series(0, len(s) - 1))::INT AS idx, unnest(s) AS sentence FROM good WHERE len(s) > 0"""
STRAT = f"""ranked AS (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5('{SEED}|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY quality, toxic) AS n FROM labels),
split AS (SELECT doc_id, quality, CASE WHEN r <= round(n * 0.8, 0) THEN 'train' WHEN r <= round(n * 0.9, 0) THEN 'validation' ELSE 'test' END AS split FROM ranked)"""
GROUPS = f"""{C.PRED_SQL},
long AS (SELECT 'overall' AS grouping, '' AS key, * FROM pred UNION ALL SELECT 'difficulty', difficulty, * FROM pred UNION ALL SELECT 'category', category, * FROM pred),
cnt AS (SELECT grouping, key, label, count(*) FILTER (WHERE ground_truth = label AND predicted_label = label) AS hit, count(*) FILTER (WHERE ground_truth = label) AS support, count(*) FILTER (WHERE predicted_label = label) AS predicted_n FROM long, lab GROUP BY ALL),
pr AS (SELECT *, CASE WHEN predicted_n = 0 THEN 0 ELSE hit / predicted_n END AS p, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS r FROM cnt),
cls AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr),
grp AS (SELECT grouping, key, sum(support)::BIGINT AS count, round(sum(hit) / sum(support), 4) AS accuracy, round(avg(f1) FILTER (WHERE support > 0), 4) AS macro_f1 FROM cls GROUP BY ALL)"""
IDS = r"list_transform({0}, lambda w: ('0x' || substr(md5(w), 1, 4))::INT + 5)"
TURNS = rf"""turn_ids AS (SELECT conv_id || '-' || turn AS key, {IDS.format(r"string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')")} AS ids FROM conversations)"""
HIDDEN = f"(('0x' || substr(md5('{SEED}|' || key || '|' || (i - 1)), 1, 8))::BIGINT < {int(0.15 * (1 << 32))} AND ids[i] NOT IN (0, 1, 2, 3, 4))"


def _pack(table: str, key: str, shards: int, most: int, least: int) -> str:
    """Blocks of a table's sentences by a fold in order, a run a shard."""
    done = f"list_filter([CASE WHEN {{0}}[-1] <> 3 THEN list_append({{0}}, 3) ELSE {{0}} END], lambda x: len(x) >= {least})"
    return rf"""dealt AS (SELECT {key} AS k, (('0x' || substr(md5({key}::VARCHAR), 1, 8))::BIGINT % {shards})::INT AS shard, text FROM {table}),
sents AS (SELECT k, shard, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?…]) +', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 2) AS s FROM dealt),
flat AS (SELECT k, shard, unnest(generate_series(1, len(s))) AS i, unnest(s) AS sentence FROM sents WHERE len(s) > 0),
steps AS (SELECT row_number() OVER (PARTITION BY shard ORDER BY k, kind, i) AS step, shard, kind, t FROM (
  SELECT k, shard, 0 AS kind, i, {IDS.format("string_split(sentence, ' ')")} AS t FROM flat UNION ALL SELECT k, shard, 1, 0, []::INT[] FROM dealt)),
fold AS (SELECT DISTINCT shard, 0::BIGINT AS step, [2]::INT[] AS cur, []::INT[][] AS done FROM dealt
  UNION ALL SELECT s.shard, s.step,
    CASE WHEN kind = 1 THEN CASE WHEN len(cur) > 1 AND len(cur) < {most - 1} THEN list_append(cur, 3) WHEN len(cur) = {most - 1} THEN [2] ELSE cur END
      WHEN len(t) > {most - 2} THEN [2] WHEN len(cur) + len(t) + 1 <= {most} THEN list_append(list_concat(cur, t), 3) ELSE list_append(list_concat([2], t), 3) END,
    CASE WHEN kind = 1 THEN CASE WHEN len(cur) = {most - 1} THEN [list_append(cur, 3)] ELSE [] END
      WHEN len(t) > {most - 2} THEN list_concat(CASE WHEN len(cur) > 1 THEN {done.format("cur")} ELSE [] END, list_transform(generate_series(0, (len(t) - 1) // {most - 2}), lambda j: list_append(list_concat([2], t[j * {most - 2} + 1 : j * {most - 2} + {most - 2}]), 3)))
      WHEN len(cur) + len(t) + 1 <= {most} THEN [] ELSE {done.format("cur")} END
  FROM fold f JOIN steps s ON s.shard = f.shard AND s.step = f.step + 1),
out AS (SELECT shard, step, unnest(generate_series(1, len(done))) AS j, unnest(done) AS ids FROM fold WHERE len(done) > 0
  UNION ALL SELECT shard, step + 1, 1, unnest({done.format("cur")}) FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY shard ORDER BY step DESC) = 1) WHERE len(cur) > 1),
blocks AS (SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY step, j) - 1 AS block, ids FROM out)"""


PACK = _pack("benchmark", "item_id", 1, 64, 8)
BLOCKS = "SELECT shard, block, len(ids)::INT AS n, md5(array_to_string(ids, ',')) AS ids, len(ids)::INT AS mask_n FROM blocks"
FX_ROWS = ", ".join(f"({y}, '{c}', {r})" for y, by in FX.items() for c, r in by.items())
AMOUNTS = """amt AS (SELECT o_orderkey AS k, (1999 + o_orderkey % 14)::INT AS year, ['USD', 'EUR', 'GBP'][o_orderkey % 3 + 1] AS currency,
  CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE '$' || floor(o_totalprice / 1000)::BIGINT || '.' || (o_orderkey % 10) || ['', 'k', ' million', 'm', ' bn'][o_orderkey % 5 + 1] END AS amount FROM orders)"""
DOTS = "replace(format('{{:,}}', {0}), ',', '.')"


def _dist(source: str, table: str, columns: list[str]) -> str:
    return f"WITH {source} " + " UNION ALL ".join(f"SELECT '{c}' AS field, {c}::VARCHAR AS value, count(*) AS n FROM {table} GROUP BY {c}" for c in columns)


SQL = {
    "sentence_split": f"WITH {C.SENT_SQL} SELECT doc_id, idx, sentence FROM sent",
    "sentence_clean": f"WITH {CLEAN}",
    "normalize_hash": f"SELECT doc_id, md5({C.NORM.format('text')}) AS hash FROM documents",
    "lexicon_flags": f"WITH {C.FLAG_SQL} SELECT doc_id, idx, finance_term, company_term, direction_up, direction_down, legal_reg, guidance_modal, rating_action, money_or_number FROM flag",
    "keep_rule": f"WITH {C.FLAG_SQL} SELECT doc_id, idx, bucket FROM kept",
    "bucket_counts": f"WITH {C.FLAG_SQL} SELECT bucket, count(*) AS n FROM kept GROUP BY bucket",
    "boilerplate_drop": f"WITH {C.SENT_SQL} SELECT contains({C.NORM.format('sentence')}, 'rights reserved') OR contains({C.NORM.format('sentence')}, 'licensed under') AS boilerplate, count(*) AS n FROM sent GROUP BY 1",
    "context_window": f"WITH {C.FLAG_SQL} SELECT doc_id, idx, md5(sentence) AS sentence, md5(prev) AS prev, md5(next) AS next FROM kept",
    "exact_dedup": f"WITH {C.FLAG_SQL} SELECT doc_id, idx, bucket FROM uniq",
    "near_candidates": f"""WITH RECURSIVE {C.FLAG_SQL},
tok AS (SELECT doc_id, idx, unnest({C.SIM_TOKENS.format("sentence")}) AS t FROM flag),
half AS (SELECT doc_id, idx, xor(('0x' || substr(md5(t), 1, 16))::UBIGINT, ('0x' || substr(md5(t), 17, 16))::UBIGINT) AS h FROM tok),
bits AS (SELECT doc_id, idx, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM half, generate_series(0, 63) g(b) GROUP BY doc_id, idx, b),
sim AS (SELECT doc_id, idx, coalesce(sum(CASE WHEN v >= 0 THEN (1::HUGEINT << b) ELSE 0 END), 0)::UBIGINT AS h FROM flag LEFT JOIN bits USING (doc_id, idx) GROUP BY doc_id, idx),
first AS (SELECT * FROM sim QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, idx) = 1),
seq AS (SELECT doc_id, idx, h, h >> 48 AS band, row_number() OVER (PARTITION BY h >> 48 ORDER BY doc_id, idx) AS r FROM first),
fold AS (SELECT band, r, doc_id, idx, [h] AS alive, TRUE AS keep FROM seq WHERE r = 1
  UNION ALL SELECT s.band, s.r, s.doc_id, s.idx, CASE WHEN len(list_filter(f.alive, lambda x: bit_count(xor(x, s.h)) <= 3)) > 0 THEN f.alive ELSE list_append(f.alive, s.h) END, len(list_filter(f.alive, lambda x: bit_count(xor(x, s.h)) <= 3)) = 0
  FROM fold f JOIN seq s ON s.band = f.band AND s.r = f.r + 1)
SELECT doc_id, idx, bucket, prev, next FROM kept SEMI JOIN (SELECT doc_id, idx FROM fold WHERE keep) USING (doc_id, idx)
QUALIFY row_number() OVER (PARTITION BY md5({C.NORM.format("sentence")}) ORDER BY doc_id, idx) = 1""",
    "simhash": f"WITH {C.SIM_SQL} SELECT doc_id, lpad(lower(to_hex(h)), 16, '0') AS simhash FROM sim",
    "simhash_band_pairs": f"WITH {C.SIM_SQL} SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, bit_count(xor(a.h, b.h))::BIGINT AS distance FROM first a JOIN first b ON a.h >> 48 = b.h >> 48 AND a.doc_id < b.doc_id AND bit_count(xor(a.h, b.h)) <= 3",
    "neardup_greedy": f"""WITH RECURSIVE {C.SIM_SQL},
seq AS (SELECT doc_id, h, h >> 48 AS band, row_number() OVER (PARTITION BY h >> 48 ORDER BY doc_id) AS r FROM first),
fold AS (SELECT band, r, doc_id, [h] AS alive, TRUE AS keep FROM seq WHERE r = 1
  UNION ALL SELECT s.band, s.r, s.doc_id, CASE WHEN len(list_filter(f.alive, lambda x: bit_count(xor(x, s.h)) <= 3)) > 0 THEN f.alive ELSE list_append(f.alive, s.h) END, len(list_filter(f.alive, lambda x: bit_count(xor(x, s.h)) <= 3)) = 0
  FROM fold f JOIN seq s ON s.band = f.band AND s.r = f.r + 1)
SELECT doc_id FROM fold WHERE keep""",
    "template_normalize": f"SELECT doc_id, md5({C.TEMPL.format('text')}) AS template FROM documents",
    "template_cap": f"WITH {C.SENT_SQL} SELECT doc_id, idx FROM sent QUALIFY row_number() OVER (PARTITION BY {C.TEMPL.format('sentence')} ORDER BY doc_id, idx) <= 3",
    "template_counts": f"WITH {C.FLAG_SQL}, cnt AS (SELECT bucket, md5({C.TEMPL.format('sentence')}) AS t, count(*) AS n FROM uniq GROUP BY ALL) SELECT bucket, sum(n)::BIGINT AS seen, sum(least(n, 3))::BIGINT AS kept, count(*) AS templates FROM cnt GROUP BY bucket",
    "bucket_targets": "SELECT * FROM (VALUES " + ", ".join(f"({t}, '{b}', {n})" for t, row in ((20000, (4000, 4000, 3000, 3000, 2000, 2000, 2000)), (100, (20, 20, 15, 15, 10, 10, 10)), (7, (1,) * 7), (33, (7, 7, 5, 5, 3, 3, 3)), (10, (1, 2, 2, 2, 1, 1, 1)), (25, (6, 5, 4, 4, 2, 2, 2))) for b, n in zip(FRACTIONS, row, strict=False)) + ") t(total, bucket, target)",
    "reservoir_per_bucket": f"WITH {C.FLAG_SQL} SELECT doc_id, idx, bucket FROM uniq QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY {DRAWN}, doc_id, idx) <= 50",
    "downsample": f"WITH {DOWN} SELECT doc_id, idx, bucket FROM down",
    "min_true_filter": f"WITH {C.FLAG_SQL} SELECT doc_id, idx, {TRUE_N} AS true_feature_count FROM uniq WHERE {TRUE_N} >= 4",
    "curate_run_all": f"WITH {DOWN} SELECT doc_id, idx, bucket, {TRUE_N} AS true_feature_count FROM down WHERE {TRUE_N} >= 3",
    "holdout_split": f"SELECT doc_id, CASE WHEN ('0x' || substr(md5('{SEED}|' || doc_id), 1, 8))::BIGINT / 4294967296.0 < 0.05 THEN 'test' ELSE 'train' END AS split FROM documents",
    "stratified_split": f"WITH {STRAT} SELECT doc_id, split FROM split",
    "split_sizes": f"WITH {STRAT} SELECT split, count(*) AS n FROM split GROUP BY split",
    "union_splits": f"WITH {STRAT} SELECT quality, count(*) AS n FROM split WHERE split <> 'test' GROUP BY quality",
    "head_subset": "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100",
    "shuffled_subset": f"SELECT doc_id FROM documents ORDER BY md5('{SEED}|' || doc_id), doc_id LIMIT 100",
    "slice_rows": "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 120 OFFSET 50",
    "token_packing": f"WITH RECURSIVE {PACK} {BLOCKS}",
    "packing_stats": f"WITH RECURSIVE {PACK} SELECT count(*) AS blocks, sum(len(ids))::BIGINT AS tokens, round(avg(len(ids)), 4) AS mean_len, round(sum(len(ids)) * 100 / (count(*) * 64), 4) AS efficiency_pct, count(*) FILTER (WHERE len(ids) = 64) AS full, round(count(*) FILTER (WHERE len(ids) = 64) * 100 / count(*), 4) AS full_pct, min(len(ids))::INT AS min_len, max(len(ids))::INT AS max_len FROM blocks",
    "block_histogram": f"WITH RECURSIVE {PACK}, inside AS (SELECT len(ids) AS n FROM blocks WHERE len(ids) BETWEEN 16 AND 64) SELECT (least((n - 16) // 4, 11) * 4 + 16)::INT AS bin_start, count(*) AS n, round(count(*) / (sum(count(*)) OVER () * 4), 6) AS density FROM inside GROUP BY 1",
    "mlm_mask": f"""WITH {TURNS} SELECT key, array_to_string(list_transform(generate_series(1, len(ids)), lambda i: CASE WHEN {HIDDEN} THEN 4 ELSE ids[i] END), ',') AS input_ids,
  array_to_string(list_transform(generate_series(1, len(ids)), lambda i: CASE WHEN {HIDDEN} THEN ids[i] ELSE -100 END), ',') AS labels FROM turn_ids""",
    "mlm_metrics": f"""WITH {TURNS}, flat AS (SELECT unnest(ids) AS id FROM turn_ids),
real AS (SELECT id % 7 AS batch, id, (id % 11) / 10.0::DOUBLE AS loss, id % 4 AS off FROM flat WHERE id % 5 <> 0),
b AS (SELECT batch, avg(loss) AS l, count(*) AS n, count(*) FILTER (WHERE off = 0) AS one, count(*) FILTER (WHERE off IN (0, 1)) AS two FROM real GROUP BY batch)
SELECT round(avg(l), 6) AS avg_loss, round(exp(avg(l)), 6) AS perplexity, round(sum(one) / sum(n), 6) AS top1_acc, round(sum(two) / sum(n), 6) AS top2_acc, sum(n)::BIGINT AS masked_tokens, count(*) AS steps FROM b""",
    "pad_truncate": f"WITH {TURNS} SELECT key, array_to_string(list_transform(generate_series(1, 24), lambda i: CASE WHEN i <= len(ids) THEN ids[i] ELSE 0 END), ',') AS padded, ceil(len(ids) / 10)::INT AS chunks FROM turn_ids",
    "confusion_matrix": f"WITH {C.PRED_SQL} SELECT label AS truth, count(*) FILTER (WHERE ground_truth = label AND predicted_label = 'negative') AS n_negative, count(*) FILTER (WHERE ground_truth = label AND predicted_label = 'neutral') AS n_neutral, count(*) FILTER (WHERE ground_truth = label AND predicted_label = 'positive') AS n_positive FROM lab, pred GROUP BY label",
    "class_metrics": f"WITH {C._class_sql()} SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(f1, 4) AS f1, support FROM cls",
    "overall_metrics": f"WITH {C._class_sql()} SELECT sum(support)::BIGINT AS count, round(sum(hit) / sum(support), 4) AS accuracy, round(avg(f1) FILTER (WHERE support > 0), 4) AS macro_f1 FROM cls",
    "weighted_metrics": f"WITH {C._class_sql()} SELECT round(sum(hit) / sum(support), 4) AS accuracy, round(sum(p * support) / sum(support), 4) AS precision, round(sum(r * support) / sum(support), 4) AS recall, round(sum(f1 * support) / sum(support), 4) AS f1 FROM cls",
    "group_metrics": f"WITH {GROUPS} SELECT * FROM grp",
    "score_texts": """WITH z AS (SELECT doc_id, [(length(text) - length(replace(text, '!', '')) + length(text) - length(replace(text, '$', '')))::DOUBLE, (length(text) < 500)::INT::DOUBLE, (length(text) - length(replace(text, ',', ''))) / 10::DOUBLE] AS z FROM documents),
e AS (SELECT doc_id, z, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z)
SELECT doc_id, ['negative', 'neutral', 'positive'][list_position(z, list_max(z))] AS predicted_label, round(round(e[1] / list_sum(e), 6), 5) AS score_negative, round(round(e[2] / list_sum(e), 6), 5) AS score_neutral, round(round(e[3] / list_sum(e), 6), 5) AS score_positive FROM e""",
    "attach_predictions": f"WITH {C.PRED_SQL}, r AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'negative' ELSE 'positive' END AS ground_truth FROM labels) SELECT r.ground_truth, r.ground_truth = predicted_label AS correct, count(*) AS n FROM r JOIN pred USING (doc_id) GROUP BY ALL",
    "masked_accuracy": "SELECT round(avg((quality = (doc_id % 5 <> 0)::INT)::INT), 4) AS accuracy FROM labels WHERE doc_id % 3 <> 0 AND quality <> -100",
    "softmax_argmax": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT vec_id, (list_position(v, list_max(v)) - 1)::INT AS predicted, round(1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) AS score FROM e",
    "mismatches": f"WITH {C.PRED_SQL} SELECT doc_id, ground_truth, predicted_label FROM pred WHERE ground_truth <> predicted_label",
    "error_transitions": f"WITH {C.PRED_SQL}, t AS (SELECT ground_truth, predicted_label, count(*) AS n, min(doc_id) AS f FROM pred WHERE ground_truth <> predicted_label GROUP BY ALL) SELECT ground_truth, predicted_label, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM t",
    "dominant_transition": f"WITH {C.PRED_SQL}, t AS (SELECT category, ground_truth, predicted_label, count(*) AS n, min(doc_id) AS f FROM pred WHERE ground_truth <> predicted_label GROUP BY ALL), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, f) = 1) SELECT c.category, coalesce(ground_truth || ' → ' || predicted_label || ' (' || n || ')', 'hata yok') AS dominant FROM (SELECT DISTINCT category FROM pred) c LEFT JOIN b USING (category)",
    "class_distribution": f"WITH {C.PRED_SQL}, x AS (SELECT ground_truth AS label, 1 AS t, 0 AS p FROM pred UNION ALL SELECT predicted_label, 0, 1 FROM pred) SELECT label, sum(t)::BIGINT AS truth_n, sum(p)::BIGINT AS predicted_n FROM x GROUP BY label",
    "category_ranking": f"WITH {GROUPS} SELECT key, accuracy, macro_f1, row_number() OVER (ORDER BY accuracy, macro_f1, key) AS rank, CASE WHEN accuracy >= 0.95 THEN 'top' WHEN accuracy >= 0.8 THEN 'good' WHEN accuracy >= 0.5 THEN 'weak' ELSE 'poor' END AS tier FROM grp WHERE grouping = 'category'",
    "worst_categories": f"WITH {GROUPS} SELECT key, printf('%.1f%%', accuracy * 100) AS accuracy, printf('%.4f', macro_f1) AS macro_f1 FROM grp WHERE grouping = 'category' ORDER BY grp.accuracy, grp.macro_f1, key LIMIT 2",
    "lowest_recall": f"WITH {C._class_sql()} SELECT label, round(r, 4) AS recall FROM cls ORDER BY r, place LIMIT 1",
    "intensity": f"WITH {C.PRED_SQL}, c AS (SELECT ground_truth, predicted_label, count(*) AS n FROM pred GROUP BY ALL) SELECT *, round(n / greatest(max(n) OVER (), 1), 4) AS intensity FROM c",
    "label_distribution": _dist(C.PRED_SQL.replace("lang AS category\n", "lang AS category, CASE WHEN quality = 0 THEN 'negative' WHEN toxic = 1 THEN 'neutral' ELSE 'positive' END = CASE WHEN contains(text, '!!') OR contains(text, '$$$') THEN 'negative' WHEN n_chars < 500 THEN 'neutral' ELSE 'positive' END AS correct\n"), "pred", ["ground_truth", "difficulty", "category", "correct"]),
    "label_translate": f"WITH {C.PRED_SQL} SELECT doc_id, CASE ground_truth WHEN 'negative' THEN 'negatif' WHEN 'neutral' THEN 'nötr' ELSE ground_truth END AS name, lower(category) || '-' || lower(difficulty) AS slug FROM pred",
    "money_convert": f"""WITH {AMOUNTS}, fx AS (SELECT year, currency, rate::DECIMAL(10, 4) AS rate FROM (VALUES {FX_ROWS}) t(year, currency, rate)),
v AS (SELECT k, year, currency, regexp_extract(lower(amount), '\\d+(?:[.,]\\d+)?') AS num, CASE WHEN contains(lower(amount), 'bn') THEN 1000000000 WHEN contains(lower(amount), 'million') OR amount LIKE '%m' THEN 1000000 WHEN amount LIKE '%k' THEN 1000 ELSE 1 END AS unit FROM amt),
w AS (SELECT k, year, currency, CASE WHEN num <> '' THEN num::DECIMAL(20, 6) * unit END AS a FROM v)
SELECT k, a::DOUBLE AS amount_value, {DOTS.format("round(a * rate, 0)::BIGINT")} || ' TL' AS tl_formatted FROM w LEFT JOIN fx USING (year, currency)""",
    "tl_format": f"SELECT o_orderkey, {DOTS.format('round(o_totalprice::DECIMAL(20, 2), 0)::BIGINT')} || ' TL' AS tl, replace(printf('%.2f', o_totalprice::DOUBLE), '.', ',') AS plain FROM orders",
    "json_text_resolve": "SELECT conv_id, turn, CASE WHEN turn % 5 IN (0, 1) THEN md5(text) WHEN turn % 5 IN (2, 3) AND length(text) > 10 THEN md5(text) END AS text FROM conversations",
    "synthetic_benchmark": benchmark_sql(),
    "phrasebank": phrasebank_sql(),
    "synthetic_distribution": _dist(f"b AS ({benchmark_sql()})", "b", ["ground_truth", "difficulty", "category", "category_tr"]),
    "jsonl_round_trip": "SELECT doc_id, md5(text) AS text, lang FROM documents WHERE text IS NOT NULL",
    "jsonl_strict": "SELECT doc_id, md5(text) AS text, n_chars FROM documents",
    "csv_round_trip": "SELECT doc_id, md5(text) AS text, source FROM documents WHERE text <> ''",
    "dataset_rewrite": "SELECT doc_id, lang, n_chars * 2 AS n_chars FROM documents",
    "candidate_files": f"WITH {C.FLAG_SQL} SELECT doc_id, source, idx, md5(sentence) AS sentence, bucket, {TRUE_N} AS n_true, md5(prev) AS prev FROM uniq JOIN documents USING (doc_id)",
    "category_report": f"""WITH {GROUPS}, t AS (SELECT category, ground_truth, predicted_label, count(*) AS n, min(doc_id) AS f FROM pred WHERE ground_truth <> predicted_label GROUP BY ALL),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, f) = 1), w AS (SELECT category, sum(n)::BIGINT AS mismatch_count FROM t GROUP BY category)
SELECT key, count, accuracy, macro_f1, coalesce(mismatch_count, 0) AS mismatch_count, coalesce(ground_truth || ' → ' || predicted_label || ' (' || b.n || ')', 'hata yok') AS dominant
FROM grp LEFT JOIN w ON w.category = key LEFT JOIN b ON b.category = key WHERE grouping = 'category'""",
    "sweep_best": f"SELECT optim, lr::DOUBLE AS lr, steps::INT AS steps, eval_loss::DOUBLE AS eval_loss, eval_accuracy::DOUBLE AS eval_accuracy FROM (VALUES {C._values(C.SWEEP)}) t(optim, lr, steps, eval_loss, eval_accuracy) ORDER BY eval_loss, optim, lr LIMIT 1",
    "train_eval_gap": f"WITH g AS (SELECT * FROM (VALUES {C._values(C.GAP)}) t(epoch, kind, accuracy)), w AS (SELECT epoch::INT AS epoch, max(accuracy::DOUBLE) FILTER (WHERE kind = 'train') AS train_accuracy, max(accuracy::DOUBLE) FILTER (WHERE kind = 'eval') AS eval_accuracy FROM g GROUP BY epoch) SELECT *, round((train_accuracy - eval_accuracy) * 100, 2) AS gap_pct, CASE WHEN round((train_accuracy - eval_accuracy) * 100, 2) <= 5 THEN 'good' ELSE 'moderate' END AS fit FROM w",
    "log_split": f"SELECT CASE WHEN eval_loss IS NOT NULL THEN 'eval' WHEN loss IS NOT NULL THEN 'train' ELSE 'other' END AS kind, count(*) AS n FROM (VALUES {C._values(C.LOG)}) t(what, epoch, step, loss, eval_loss, acc) GROUP BY 1",
    "final_run": f"SELECT max_by(eval_loss::DOUBLE, step) FILTER (WHERE eval_loss IS NOT NULL) AS last_eval_loss, count(*) FILTER (WHERE loss IS NOT NULL AND eval_loss IS NULL) AS train_records FROM (VALUES {C._values(C.LOG)}) t(what, epoch, step, loss, eval_loss, acc)",
    "timing_summary": "SELECT round(sum(abs(value)), 6) AS total_s, round(avg(abs(value)), 6) AS mean_s, count(value) AS steps FROM events",
    "compare_pivot": "SELECT event_type, count(*) FILTER (WHERE event_id % 2 = 0) AS base, count(*) FILTER (WHERE event_id % 2 <> 0) AS adapted FROM events GROUP BY event_type",
    "cost_totals": "SELECT sum(n_chars)::BIGINT AS input_tokens, sum(n_chars % 100)::BIGINT AS output_tokens, round(sum(n_chars * 1.25::DOUBLE / 1e6 + (n_chars % 100) * 10.0::DOUBLE / 1e6), 6) AS cost FROM documents",
}
