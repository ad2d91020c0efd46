"""Vocabulary, tokenization and training views over documents (max_len 157, multiple 16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearline.functions import tokens as TK
from nearline.operators import tokenize as K
from nearline.plans.registry import register
from nearline.plans.sqlparts import DOC_BATCHES, VOCAB, first_half, half, hex8, mask, pad, words
from nearline.session import table
from nearline.sources import fixtures as X

MAX_LEN, L, EOS = 157, 160, K.EOS_ID
T3 = "(list_slice(input_ids, 1, 156) || [CAST(2 AS INTEGER)])"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _vocab(spark, sf_dir):
    return K.fit_vocab(_docs(spark, sf_dir))


def _tok(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return K.tokenize(d, _vocab(spark, sf_dir)).select(F.col("id").alias("doc_id"), "input_ids")


def _t3(spark, sf_dir):
    return _tok(spark, sf_dir).withColumn("ids", TK.truncate_append_eos("input_ids", MAX_LEN, True, EOS))


@register("k1_fit_vocab", f"WITH {VOCAB} SELECT term, term_id, cf, df FROM vocab")
def k1_fit_vocab(spark, sf_dir):
    return _vocab(spark, sf_dir)


@register("k2_tokenize", f"WITH {VOCAB} SELECT doc_id, input_ids FROM dtok")
def k2_tokenize(spark, sf_dir):
    return _tok(spark, sf_dir)


@register("u2_user_tokenizer", f"""
SELECT doc_id, list_transform({words('text')}, lambda w: CAST({hex8('md5(w)')} % 30000 + 4 AS INTEGER)) AS input_ids FROM documents
""")
def u2_user_tokenizer(spark, sf_dir):
    """K2 with a tokenizer of the user's, loaded once per task."""
    return K.tokenize_with(table(spark, sf_dir, "documents").select("doc_id", "text"), K.HashTokenizer).select("doc_id", "input_ids")


@register("k3_truncate_append_eos", f"WITH {VOCAB} SELECT doc_id, {T3} AS ids FROM dtok")
def k3_truncate_append_eos(spark, sf_dir):
    return _t3(spark, sf_dir).select("doc_id", "ids")


@register("k4_pad_fixed", f"WITH {VOCAB} SELECT doc_id, {pad(T3, '160')} AS ids FROM dtok")
def k4_pad_fixed(spark, sf_dir):
    return _t3(spark, sf_dir).select("doc_id", TK.pad_fixed("ids", MAX_LEN, EOS, 16).alias("ids"))


@register("k5_pad_longest", f"""
WITH {VOCAB}, {DOC_BATCHES},
t AS (SELECT m.batch_id, m.doc_id, {T3} AS ids FROM batch_member m JOIN dtok d ON m.doc_id = d.doc_id),
b AS (SELECT *, CAST(ceil(max(len(ids)) OVER (PARTITION BY batch_id) / 16.0) * 16 AS INTEGER) AS Lb FROM t)
SELECT batch_id, doc_id, {pad('ids', 'Lb')} AS ids FROM b
""")
def k5_pad_longest(spark, sf_dir):
    m = X.document_batches(spark, sf_dir).select("batch_id", "doc_id")
    t = m.join(_t3(spark, sf_dir).select("doc_id", "ids"), "doc_id")
    return K.pad_longest(t, "ids", "batch_id", EOS, 16).select("batch_id", "doc_id", "ids")


@register("k6_attention_mask", f"WITH {VOCAB} SELECT doc_id, {mask(f'len({T3})', '160')} AS attention_mask FROM dtok")
def k6_attention_mask(spark, sf_dir):
    return _t3(spark, sf_dir).select("doc_id", TK.attention_mask(F.size("ids"), L).alias("attention_mask"))


LM = "list_slice(input_ids, 1, 156)"


@register("k7_lm_labels", f"""
WITH {VOCAB}
SELECT doc_id, list_transform({pad(LM, '160')}, lambda x: CASE WHEN x = 2 THEN -100 ELSE x END) AS labels FROM dtok
""")
def k7_lm_labels(spark, sf_dir):
    t = _tok(spark, sf_dir)
    lm = TK.pad_fixed(F.slice("input_ids", 1, MAX_LEN - 1), MAX_LEN, EOS, 16)
    return t.select("doc_id", TK.lm_labels(lm, EOS).alias("labels"))


@register("k8_first_half", f"WITH {VOCAB} SELECT doc_id, {first_half(T3)} AS ids FROM dtok")
def k8_first_half(spark, sf_dir):
    return _t3(spark, sf_dir).select("doc_id", TK.first_half("ids", EOS).alias("ids"))


@register("k9_first_half_mask", f"""
WITH {VOCAB}, h AS (SELECT doc_id, {T3} AS ids FROM dtok)
SELECT doc_id, {mask(half('ids'), '160')} AS first_half_mask FROM h
""")
def k9_first_half_mask(spark, sf_dir):
    return _t3(spark, sf_dir).select("doc_id", TK.first_half_mask("ids", EOS, L).alias("first_half_mask"))


K10_SQL = f"""
WITH {VOCAB}, {DOC_BATCHES},
pfx AS (SELECT coalesce((SELECT CAST(term_id AS INTEGER) FROM vocab WHERE term = 'passage'), 3) AS p,
               coalesce((SELECT CAST(term_id AS INTEGER) FROM vocab WHERE term = 'query'), 3) AS q),
t AS (SELECT m.batch_id, m.src, m.pos, m.doc_id, d.input_ids AS lm_raw,
             [CAST(1 AS INTEGER), pfx.p] || list_slice(d.input_ids, 2, len(d.input_ids)) AS p_raw,
             [CAST(1 AS INTEGER), pfx.q] || list_slice(d.input_ids, 2, len(d.input_ids)) AS q_raw
      FROM batch_member m JOIN dtok d ON m.doc_id = d.doc_id, pfx),
u AS (SELECT *, list_slice(p_raw, 1, 156) || [CAST(2 AS INTEGER)] AS p, list_slice(lm_raw, 1, 156) AS lm,
             list_slice(q_raw, 1, 156) || [CAST(2 AS INTEGER)] AS q, src NOT IN ('stackoverflow', 'src3') AS fh FROM t),
v AS (SELECT *, CASE WHEN fh THEN {first_half('q')} ELSE q END AS qf FROM u)
SELECT batch_id, src, pos, doc_id, {pad('p', '160')} AS p_input_ids, {mask('len(p)', '160')} AS p_attention_mask,
       {pad('lm', '160')} AS lm_input_ids, {mask('len(lm)', '160')} AS lm_attention_mask,
       list_transform({pad('lm', '160')}, lambda x: CASE WHEN x = 2 THEN -100 ELSE x END) AS lm_labels,
       {pad('qf', '160')} AS q_input_ids, {mask('len(qf)', '160')} AS q_attention_mask,
       CASE WHEN fh THEN {mask(half('q'), '160')} END AS first_half_mask
FROM v
"""


@register("k10_training_views", K10_SQL)
def k10_training_views(spark, sf_dir):
    m = X.document_batches(spark, sf_dir)
    return K.training_views(m, _vocab(spark, sf_dir), max_len=MAX_LEN, append_eos=True, multiple=16,
                            excluded_src=("stackoverflow", "src3"))


@register("k11_next_token_pairs", f"""
WITH {VOCAB},
w AS (SELECT doc_id, {pad(LM, '160')} AS ids FROM dtok),
x AS (SELECT doc_id, ids, list_transform(ids, lambda x: CASE WHEN x = 2 THEN -100 ELSE x END) AS labels FROM w),
z AS (SELECT doc_id, unnest(list_slice(ids, 1, len(ids) - 1)) AS input_id, unnest(list_slice(labels, 2, len(labels))) AS target,
             generate_subscripts(list_slice(ids, 1, len(ids) - 1), 1) - 1 AS pos FROM x)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, input_id, target FROM z WHERE target <> -100
""")
def k11_next_token_pairs(spark, sf_dir):
    t = _tok(spark, sf_dir)
    lm = TK.pad_fixed(F.slice("input_ids", 1, MAX_LEN - 1), MAX_LEN, EOS, 16)
    v = t.select("doc_id", lm.alias("ids")).withColumn("labels", TK.lm_labels("ids", EOS))
    return K.next_token_pairs(v, "ids", "labels", "doc_id").withColumnRenamed("id", "doc_id")
