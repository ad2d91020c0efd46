"""Reference inputs derived from the driver tables by Spark jobs.

* corpus  = documents (id = doc_id)
* queries = benchmark (id = item_id)
* reps    = embeddings (id = vec_id, rep = embedding)
* train_groups from conversations: query = a user turn, positive = the next
  assistant turn, negatives = assistant turns of the next ``neg_convs``
  conversations by id (an equi-join on ``conv_id + offset``, so no global
  ordering is needed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearline.operators.indexing import with_global_index
from nearline.session import table

PASSAGE = "struct<docid:string,title:string,text:string>"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("title"), "source", "lang")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


def reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("rep"),
                                                     "label")


def _passage(conv, turn, text):
    return F.struct(F.concat_ws("-", F.col(conv).cast("string"), F.col(turn).cast("string")).alias("docid"),
                    F.lit("").alias("title"), F.col(text).alias("text"))


def train_groups(spark: SparkSession, sf_dir: str, neg_convs: int = 2) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    user = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("query"))
    asst = conv.where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    pos = asst.select("conv_id", (F.col("turn") - 1).alias("turn"), _passage("conv_id", "turn", "text").alias("p"))
    groups = user.join(pos, ["conv_id", "turn"])
    # Negatives: assistant turns of conversations conv_id+1 .. conv_id+neg_convs.
    negs = (asst.withColumn("_off", F.explode(F.sequence(F.lit(1), F.lit(neg_convs))))
            .select((F.col("conv_id") - F.col("_off")).alias("conv_id"),
                        F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t"),
                                 _passage("conv_id", "turn", "text").alias("p")).alias("n"))
            .groupBy("conv_id").agg(F.array_sort(F.collect_list("n")).alias("ns"))
            .select("conv_id", F.transform("ns", lambda s: s["p"]).alias("negatives")))
    return (groups.join(negs, "conv_id", "left")
            .select((F.col("conv_id") * 1000 + F.col("turn")).alias("group_id"), "query",
                    F.array("p").alias("positives"),
                    F.coalesce("negatives", F.array().cast(f"array<{PASSAGE}>")).alias("negatives")))


def document_batches(spark: SparkSession, sf_dir: str, batch_size: int = 16) -> DataFrame:
    """batch_member(batch_id, src, pos, doc_id, text): documents in (source, doc_id)
    order cut into consecutive batches; ``src`` is the first member's source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    idx = with_global_index(docs, ["source", "doc_id"], "idx")
    m = idx.select(F.floor(F.col("idx") / batch_size).cast("bigint").alias("batch_id"),
                   (F.col("idx") % batch_size).cast("int").alias("pos"), "doc_id", "text", "source")
    first = m.where(F.col("pos") == 0).select("batch_id", F.col("source").alias("src"))
    return m.join(first, "batch_id").select("batch_id", "src", "pos", "doc_id", "text")


def embedding_batches(spark: SparkSession, sf_dir: str, batch_size: int = 16) -> DataFrame:
    """batch_member over embeddings: batch = floor(vec_id / batch_size)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / batch_size).cast("bigint").alias("batch_id"),
                    (F.col("vec_id") % batch_size).cast("int").alias("pos"),
                    F.col("vec_id").alias("doc_id"), F.col("embedding").alias("rep"))


def collect_batches(members: DataFrame) -> DataFrame:
    """batch_member -> batches(batch_id, src, texts, doc_ids) in member order.

    Groups are batches, bounded by the batch size.
    """
    g = members.groupBy("batch_id").agg(
        F.first("src").alias("src"),
        F.array_sort(F.collect_list(F.struct("pos", "text", "doc_id"))).alias("m"))
    return g.select("batch_id", "src", F.transform("m", lambda s: s["text"]).alias("texts"),
                    F.transform("m", lambda s: s["doc_id"]).alias("doc_ids"))
