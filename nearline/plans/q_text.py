"""Formatting and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearline.functions import text as TX
from nearline.operators import search as S
from nearline.plans.registry import register
from nearline.plans.sqlparts import DOC_BATCHES, TRAIN_GROUPS, strip
from nearline.session import table
from nearline.sources import fixtures as X


@register("p1_format_query", f"""
SELECT item_id AS id, {strip("'query: ' || " + strip('text'))} AS query FROM benchmark
""")
def p1_format_query(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark")
    return q.select(F.col("item_id").alias("id"), TX.format_query("text", "query: ").alias("query"))


_TITLE_SQL = "CASE WHEN lang = 'en' THEN source ELSE '' END"


@register("p2_format_passage", f"""
SELECT doc_id AS id,
       {strip("'passage: ' || " + strip(_TITLE_SQL) + " || ' ' || " + strip('text'))} AS passage
FROM documents
""")
def p2_format_passage(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    title = F.when(F.col("lang") == "en", F.col("source")).otherwise(F.lit(""))
    return d.select(F.col("doc_id").alias("id"), TX.format_passage("text", title, "passage: ").alias("passage"))


@register("p3_add_prefix", """
SELECT doc_id AS id, 'passage: ' || text AS p_text, 'query: ' || text AS q_text FROM documents
""")
def p3_add_prefix(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), TX.add_prefix("text", "passage: ").alias("p_text"),
                    TX.add_prefix("text", "query: ").alias("q_text"))


@register("p4_filter_groups", f"""
WITH {TRAIN_GROUPS}
SELECT group_id, len(negatives)::BIGINT AS n_neg FROM train_groups
WHERE len(positives) >= 1 AND len(negatives) >= 4 - 1
""")
def p4_filter_groups(spark, sf_dir):
    from nearline.operators.sampling import filter_groups
    g = filter_groups(X.train_groups(spark, sf_dir), group_size=4)
    return g.select("group_id", F.size("negatives").cast("bigint").alias("n_neg"))


@register("p5_first_half_applies", f"""
WITH {DOC_BATCHES}
SELECT batch_id, src, src NOT IN ('stackoverflow', 'src3') AS first_half FROM batches
""")
def p5_first_half_applies(spark, sf_dir):
    b = X.collect_batches(X.document_batches(spark, sf_dir))
    return b.select("batch_id", "src",
                    TX.first_half_applies("src", excluded=("stackoverflow", "src3")).alias("first_half"))


@register("p6_stringify_ids", """
SELECT CAST(q.vec_id AS VARCHAR) AS qid, CAST(d.vec_id AS VARCHAR) AS docid
FROM embeddings q JOIN embeddings d ON q.vec_id // 16 = d.vec_id // 16
""")
def p6_stringify_ids(spark, sf_dir):
    m = X.embedding_batches(spark, sf_dir)
    pairs = m.select(F.col("doc_id").alias("qid"), "batch_id").join(
        m.select(F.col("doc_id").alias("docid"), "batch_id"), "batch_id")
    return S.stringify_ids(pairs.select("qid", "docid"))


@register("p7_concat_title", "SELECT doc_id AS id, source || ' ' || text AS passage FROM documents")
def p7_concat_title(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), TX.concat_title("text", "source").alias("passage"))
