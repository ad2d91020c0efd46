"""Relevance judgements and ranking metrics.

Metrics follow the usual trec_eval definitions: linear gain, ``log2(rank+1)``
discount, ideal ranking from the judgements, MAP@k divided by the number of
relevant documents.  Queries with judgements but no hits score 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearline.operators.lexical import BM25Index


def build_qrels_contains(queries: DataFrame, corpus_terms: DataFrame, corpus: DataFrame, index: BM25Index,
                         q_id: str = "id", q_text: str = "text", q_terms: str = "terms", block: int = 256) -> DataFrame:
    """Rel 1 where the document text contains the query passage verbatim.

    Candidates come from an equi-join, not a scan of all pairs: if a passage
    occurs inside a document, its interior words (all but the first and last,
    which may be cut mid-word) are whole words of that document.  Each passage
    is anchored on its interior word of smallest document frequency; only the
    documents holding that word are checked with ``contains``.  Passages without
    an interior index term (too few or only short and stop words) are checked
    against all documents, in blocks of ``block`` passages.  Null texts and empty
    passages have no judgements.
    """
    qt = queries.select(F.col(q_id).alias("qid"), F.col(q_text).alias("qtext"), F.col(q_terms).alias("qterms"))
    qt = qt.where(F.length("qtext") > 0)
    inner = F.when(F.size("qterms") >= 3, F.slice("qterms", 2, F.size("qterms") - 2)).otherwise(F.array().cast("array<string>"))
    ex = qt.select("qid", F.explode(inner).alias("term"))
    ranked = ex.join(index.terms.select("term", "df"), "term")
    w = Window.partitionBy("qid").orderBy(F.col("df").asc(), F.col("term").asc())
    anchors = ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select("qid", "term")
    cands = anchors.join(index.tf.select("term", F.col("doc_id").alias("docid")), "term")
    docs = corpus.select(F.col(q_id).alias("docid"), F.col(q_text).alias("dtext"))
    hits = (cands.join(qt.select("qid", "qtext"), "qid").join(docs, "docid")
            .where(F.col("dtext").contains(F.col("qtext"))).select("qid", "docid"))
    found = hits.select("qid", "docid")
    rest = qt.where(F.size(inner) == 0).select("qid", "qtext")
    n = rest.count()
    if n:
        blocks = -(-n // block)
        packed = (rest.groupBy(F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("_b"))
                  .agg(F.collect_list(F.struct("qid", "qtext")).alias("_q")))
        dealt = docs.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "_b")
        match = F.filter("_q", lambda q: F.contains(F.col("dtext"), q["qtext"]))
        found = found.union(dealt.select(F.explode(match).alias("q"), "docid").select("q.qid", "docid"))
    return found.select("qid", "docid", F.lit(1).cast("int").alias("rel"))


def _judged(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    r = run.where(F.col("rank") <= k).select("qid", "docid", "rank")
    return r.join(qrels.select("qid", "docid", "rel"), ["qid", "docid"], "left").fillna(0, ["rel"])


def _per_query(qrels: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Left join from the judged queries; missing -> 0."""
    qs = qrels.where(F.col("rel") > 0).select("qid").distinct()
    return qs.join(values, "qid", "left").select("qid", F.coalesce(F.col(name), F.lit(0.0)).alias(name))


def ndcg(run: DataFrame, qrels: DataFrame, k: int = 10, decimals: int = 6) -> DataFrame:
    """R2: nDCG@k per judged query."""
    j = _judged(run, qrels, k)
    dcg = j.groupBy("qid").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    w = Window.partitionBy("qid").orderBy(F.col("rel").desc(), F.col("docid").asc())
    ideal = (qrels.where(F.col("rel") > 0).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
             .groupBy("qid").agg(F.sum(F.col("rel") / F.log2(F.col("_r") + 1.0)).alias("idcg")))
    v = ideal.join(dcg, "qid", "left").select(
        "qid", F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("idcg"), decimals).alias(f"ndcg_{k}"))
    return _per_query(qrels, v, f"ndcg_{k}")


def recall_precision(run: DataFrame, qrels: DataFrame, k: int = 10, decimals: int = 6) -> DataFrame:
    """recall@k and precision@k per judged query."""
    j = _judged(run, qrels, k)
    hits = j.groupBy("qid").agg(F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).alias("hits"))
    nrel = qrels.where(F.col("rel") > 0).groupBy("qid").agg(F.count(F.lit(1)).alias("nrel"))
    v = nrel.join(hits, "qid", "left").select(
        "qid", F.round(F.coalesce(F.col("hits"), F.lit(0)) / F.col("nrel"), decimals).alias(f"recall_{k}"),
        F.round(F.coalesce(F.col("hits"), F.lit(0)) / F.lit(float(k)), decimals).alias(f"precision_{k}"))
    return v


def mrr(run: DataFrame, qrels: DataFrame, k: int = 10, decimals: int = 6) -> DataFrame:
    """Reciprocal rank of the first relevant hit within k."""
    j = _judged(run, qrels, k).where(F.col("rel") > 0)
    v = j.groupBy("qid").agg(F.round(1.0 / F.min("rank"), decimals).alias(f"mrr_{k}"))
    return _per_query(qrels, v, f"mrr_{k}")


def average_precision(run: DataFrame, qrels: DataFrame, k: int = 10, decimals: int = 6) -> DataFrame:
    """AP@k = sum over relevant hits of precision at their rank / #relevant."""
    j = _judged(run, qrels, k)
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("_cum", F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).over(w))
    ap = j.where(F.col("rel") > 0).groupBy("qid").agg(F.sum(F.col("_cum") / F.col("rank")).alias("_s"))
    nrel = qrels.where(F.col("rel") > 0).groupBy("qid").agg(F.count(F.lit(1)).alias("nrel"))
    v = nrel.join(ap, "qid", "left").select(
        "qid", F.round(F.coalesce(F.col("_s"), F.lit(0.0)) / F.col("nrel"), decimals).alias(f"map_{k}"))
    return v


def evaluate(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """All per-query metrics side by side."""
    out = ndcg(run, qrels, k)
    for part in (recall_precision(run, qrels, k), mrr(run, qrels, k), average_precision(run, qrels, k)):
        out = out.join(part, "qid")
    return out


def mean_over_queries(per_query: DataFrame, decimals: int = 6) -> DataFrame:
    """One row of means over judged queries (missing hits already count 0)."""
    cols = [c for c in per_query.columns if c != "qid"]
    return per_query.agg(F.count(F.lit(1)).cast("bigint").alias("n_queries"),
                         *[F.round(F.avg(c), decimals).alias(c) for c in cols])


def run_overlap(approx: DataFrame, exact: DataFrame, k: int = 10, decimals: int = 6) -> DataFrame:
    """Per query, fraction of the exact top-k also returned by the approximate run."""
    e = exact.where(F.col("rank") <= k).select("qid", "docid")
    a = approx.where(F.col("rank") <= k).select("qid", "docid", F.lit(1).alias("_hit"))
    j = e.join(a, ["qid", "docid"], "left")
    return j.groupBy("qid").agg(F.round(F.sum(F.coalesce("_hit", F.lit(0))) / F.count(F.lit(1)), decimals)
                                .alias(f"overlap_{k}"))
