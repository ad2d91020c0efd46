"""Scans and sinks, checked by write -> read round trips where they write."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearline.operators import search as S
from nearline.plans.registry import register
from nearline.plans.sqlparts import KNN10, DOC_BATCHES, TRAIN_GROUPS
from nearline.session import scratch_path, table
from nearline.sources import fixtures as X
from nearline.sources import io

TG_OUT_SQL = f"""
WITH {TRAIN_GROUPS}
SELECT group_id, query, len(positives)::BIGINT AS n_pos, positives[1].docid AS pos_docid,
       list_transform(negatives, lambda x: x.docid) AS neg_docids
FROM train_groups
"""


def _tg_out(df):
    return df.select("group_id", "query", F.size("positives").cast("bigint").alias("n_pos"),
                     F.col("positives")[0]["docid"].alias("pos_docid"),
                     F.transform("negatives", lambda x: x["docid"]).alias("neg_docids"))


@register("s1_read_train_groups", TG_OUT_SQL)
def s1_read_train_groups(spark, sf_dir):
    path = scratch_path(spark, "train_groups")
    X.train_groups(spark, sf_dir).write.json(path)
    return _tg_out(io.read_train_groups(spark, path))


@register("s1_read_published_groups", f"""
WITH {TRAIN_GROUPS}
SELECT query, len(positives)::BIGINT AS n_pos, len(negatives)::BIGINT AS n_neg, count(*)::BIGINT AS n
FROM train_groups GROUP BY 1, 2, 3
""")
def s1_read_published_groups(spark, sf_dir):
    """Files without a group id, under the published names, next to another split."""
    path = scratch_path(spark, "published")
    g = X.train_groups(spark, sf_dir).select("query", F.col("positives").alias("positive_passages"),
                                             F.col("negatives").alias("negative_passages"))
    g.write.json(path)
    read = io.read_train_groups(spark, path, split="part")
    return read.groupBy("query", F.size("positives").cast("bigint").alias("n_pos"),
                        F.size("negatives").cast("bigint").alias("n_neg")).agg(
        F.count_distinct("group_id").alias("n"))


BATCH_OUT_SQL = f"""
WITH {DOC_BATCHES}
SELECT batch_id, CASE WHEN batch_id % 2 = 0 THEN '' ELSE src END AS src,
       len(list_slice(texts, 1, 8))::BIGINT AS n_texts,
       md5(array_to_string(list_slice(texts, 1, 8), '|')) AS texts_md5
FROM batches
"""


def _batch_digest(df):
    return df.select("batch_id", "src", F.size("texts").cast("bigint").alias("n_texts"),
                     F.md5(F.array_join("texts", "|")).alias("texts_md5"))


@register("s2_read_batches", BATCH_OUT_SQL)
def s2_read_batches(spark, sf_dir):
    # Mixed-shape lines built in the plan (list form for even batch ids), parsed back.
    b = X.collect_batches(X.document_batches(spark, sf_dir))
    lines = io.batch_lines(b.select("batch_id", "src", "texts"), as_list=(F.col("batch_id") % 2 == 0))
    return _batch_digest(io.parse_batch_lines(lines, top_k=8))


@register("s2_read_batch_files", f"SELECT src, n_texts, texts_md5 FROM ({BATCH_OUT_SQL})")
def s2_read_batch_files(spark, sf_dir):
    """Stored files of mixed lines, read back."""
    path = scratch_path(spark, "batch_lines")
    b = X.collect_batches(X.document_batches(spark, sf_dir))
    io.write_batches(b, path, as_list=(F.col("batch_id") % 2 == 0))
    return _batch_digest(io.read_batches(spark, path, top_k=8)).drop("batch_id")


@register("s3_read_corpus", "SELECT doc_id AS id, text FROM documents")
def s3_read_corpus(spark, sf_dir):
    return io.read_corpus(spark, f"{sf_dir}/documents.parquet", id_col="doc_id", text_col="text")


@register("s4_shard", """
WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT doc_id,
       CAST(CASE WHEN i < (n % 3) * (n // 3 + 1) THEN i // (n // 3 + 1)
                 ELSE (n % 3) + (i - (n % 3) * (n // 3 + 1)) // greatest(n // 3, 1) END AS INTEGER) AS shard_contiguous,
       CAST(i % 3 AS INTEGER) AS shard_strided
FROM i
""")
def s4_shard(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    c = io.shard(d, 3, "doc_id", mode="contiguous", shard_col="shard_contiguous")
    s = io.shard(d, 3, "doc_id", mode="strided", shard_col="shard_strided")
    return c.join(s, "doc_id")


@register("s5_write_read_reps", """
SELECT vec_id AS id, embedding AS rep, CAST(vec_id % 4 AS INTEGER) AS shard FROM embeddings
""")
def s5_write_read_reps(spark, sf_dir):
    r = X.reps(spark, sf_dir).select("id", "rep")
    path = scratch_path(spark, "reps")
    io.write_reps(io.shard(r, 4, "id", mode="strided"), path)
    return io.read_reps(spark, path).select("id", "rep", F.col("shard").cast("int").alias("shard"))


@register("s6_read_rep_shards", """
SELECT vec_id AS id, embedding AS rep FROM embeddings
""")
def s6_read_rep_shards(spark, sf_dir):
    r = X.reps(spark, sf_dir).select("id", "rep")
    path = scratch_path(spark, "rep_shards")
    for i in range(3):
        io.write_reps(io.shard(r, 3, "id", mode="hash", index=i).drop("shard").withColumn("shard", F.lit(i)),
                      f"{path}/part{i}", shard_col="shard")
    return io.read_rep_shards(spark, f"{path}/part*/shard=*/*.parquet").select("id", "rep")


def _run10(spark, sf_dir):
    r = X.reps(spark, sf_dir).select("id", "rep")
    return S.knn_exact(r, r, k=10, decimals=6)


@register("s7_write_ranking", f"""
SELECT printf('%d\t%d\t%.6f', qid, docid, score) AS value FROM ({KNN10}) r
""")
def s7_write_ranking(spark, sf_dir):
    path = scratch_path(spark, "ranking")
    io.write_ranking(_run10(spark, sf_dir), path)
    return spark.read.text(path)


@register("s8_pack_ranking", f"""
SELECT qid, list(docid ORDER BY rank) AS docids, list(score ORDER BY rank) AS scores
FROM ({KNN10}) r GROUP BY qid
""")
def s8_pack_ranking(spark, sf_dir):
    return io.pack_ranking(_run10(spark, sf_dir))


@register("s9_write_batches", f"""
WITH {DOC_BATCHES}
SELECT src, len(texts)::BIGINT AS n_texts, md5(array_to_string(texts, '|')) AS texts_md5 FROM batches
""")
def s9_write_batches(spark, sf_dir):
    b = X.collect_batches(X.document_batches(spark, sf_dir)).select("src", "texts")
    path = scratch_path(spark, "batches")
    io.write_batches(b, path)
    return _batch_digest(io.read_batches(spark, path, top_k=None)).drop("batch_id")
