"""B1-B3, B5 and the R1-R6 evaluation of a BM25 run (the flagship)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearline.operators import lexical as B
from nearline.operators import metrics as R
from nearline.plans.registry import register
from nearline.plans.sqlparts import BM25, WS, analyzed
from nearline.session import scratch_path, stored_tables, table


def _index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs, B.bm25_index(B.analyze(docs, "doc_id", "text"))


def _run(spark, sf_dir, k=10):
    docs, idx = _index(spark, sf_dir)
    q = B.analyze(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return B.bm25_search(q, idx, k=k, decimals=6), docs, idx


def _qrels(spark, sf_dir, docs, idx):
    bench = table(spark, sf_dir, "benchmark")
    q = bench.select(F.col("item_id").alias("id"), "text", B.analyze_col(F.col("text")).alias("terms"))
    return R.build_qrels_contains(q, None, docs.select(F.col("doc_id").alias("id"), "text"), idx)


@register("b1_analyze", f"SELECT doc_id AS id, {analyzed('text')} AS terms FROM documents")
def b1_analyze(spark, sf_dir):
    return B.analyze(table(spark, sf_dir, "documents"), "doc_id", "text")


@register("b2_bm25_index", f"WITH {BM25} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM bm_idf")
def b2_bm25_index(spark, sf_dir):
    _, idx = _index(spark, sf_dir)
    return idx.terms.select("term", F.col("df").cast("bigint").alias("df"), F.round("idf", 6).alias("idf"))


@register("b2_bm25_postings", f"""
WITH {BM25} SELECT term, doc_id, tf::BIGINT AS tf, round(w, 6) AS w FROM bm_post
""")
def b2_bm25_postings(spark, sf_dir):
    _, idx = _index(spark, sf_dir)
    return idx.postings.select("term", "doc_id", F.col("tf").cast("bigint").alias("tf"), F.round("w", 6).alias("w"))


@register("b3_bm25_search", f"WITH {BM25} SELECT qid, docid, rank, score FROM bm_run")
def b3_bm25_search(spark, sf_dir):
    return _run(spark, sf_dir)[0]


@register("b3_bm25_blocks", f"WITH {BM25} SELECT qid, docid, rank, score FROM bm_run")
def b3_bm25_blocks(spark, sf_dir):
    """B3 on stored posting blocks in order of language and length; only what can reach the k-th score is read."""
    with stored_tables(spark):  # once the blocks are written, the index that they were made of goes
        docs, idx = _index(spark, sf_dir)
        order = docs.select(F.col("doc_id").alias("doc"), F.struct("lang", F.length("text").alias("n")).alias("key"))
        blocks = B.bm25_blocks(idx, order=order)
    q = B.analyze(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return B.bm25_block_search(q, blocks, k=10, decimals=6)


@register("b1_stemmed", f"""
WITH t AS (SELECT doc_id AS id, {analyzed('text')} AS terms FROM documents)
SELECT id, list_transform(terms, lambda w: CASE WHEN length(w) < 3 THEN w
  WHEN suffix(w, 'ies') AND NOT (suffix(w, 'eies') OR suffix(w, 'aies')) THEN w[1:length(w) - 3] || 'y'
  WHEN suffix(w, 'es') AND NOT (suffix(w, 'aes') OR suffix(w, 'ees') OR suffix(w, 'oes')) THEN w[1:length(w) - 2] || 'e'
  WHEN suffix(w, 's') AND NOT (suffix(w, 'us') OR suffix(w, 'ss')) THEN w[1:length(w) - 1] ELSE w END) AS terms FROM t
""")
def b1_stemmed(spark, sf_dir):
    return B.analyze(table(spark, sf_dir, "documents"), "doc_id", "text", stemmer=B.PLURALS)


@register("b2_index_append", f"WITH {BM25} SELECT qid, docid, rank, score FROM bm_run")
def b2_index_append(spark, sf_dir):
    """An index of the even documents, stored and read back, to which the odd ones are appended."""
    docs = B.analyze(table(spark, sf_dir, "documents"), "doc_id", "text")
    path = scratch_path(spark, "bm25")
    B.write_index(B.bm25_index(docs.where(F.col("id") % 2 == 0)), path)
    idx = B.bm25_append(B.read_index(spark, path), docs.where(F.col("id") % 2 != 0))
    q = B.analyze(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return B.bm25_search(q, idx, k=10, decimals=6)


@register("b5_chunk", f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, CASE WHEN len(w) <= 100 THEN 1 ELSE CAST(ceil((len(w) - 20) / 80.0) AS INTEGER) END AS nc FROM w)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, array_to_string(list_slice(w, i * 80 + 1, i * 80 + 100), ' ') AS text
FROM c, range(0, nc) r(i)
""")
def b5_chunk(spark, sf_dir):
    return B.chunk(table(spark, sf_dir, "documents"), max_words=100, overlap=20, id_col="doc_id")


@register("r1_build_qrels", f"WITH {BM25} SELECT qid, docid, rel FROM qrels")
def r1_build_qrels(spark, sf_dir):
    _, docs, idx = _run(spark, sf_dir)
    return _qrels(spark, sf_dir, docs, idx)


def _eval(spark, sf_dir):
    run, docs, idx = _run(spark, sf_dir)
    return run, _qrels(spark, sf_dir, docs, idx)


@register("r2_ndcg_bm25", f"WITH {BM25} SELECT qid, ndcg_10 FROM ev_ndcg")
def r2_ndcg_bm25(spark, sf_dir):
    """Flagship: benchmark -> BM25 over documents -> top-10 -> nDCG@10 per judged query."""
    return R.ndcg(*_eval(spark, sf_dir), k=10)


@register("r3_recall_precision", f"WITH {BM25} SELECT qid, recall_10, precision_10 FROM ev_rp")
def r3_recall_precision(spark, sf_dir):
    return R.recall_precision(*_eval(spark, sf_dir), k=10)


@register("r4_mrr", f"WITH {BM25} SELECT qid, mrr_10 FROM ev_mrr")
def r4_mrr(spark, sf_dir):
    return R.mrr(*_eval(spark, sf_dir), k=10)


@register("r5_map", f"WITH {BM25} SELECT qid, map_10 FROM ev_map")
def r5_map(spark, sf_dir):
    return R.average_precision(*_eval(spark, sf_dir), k=10)


@register("r6_mean_over_queries", f"""
WITH {BM25}
SELECT count(*)::BIGINT AS n_queries, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(recall_10), 6) AS recall_10,
       round(avg(precision_10), 6) AS precision_10, round(avg(mrr_10), 6) AS mrr_10, round(avg(map_10), 6) AS map_10
FROM ev_ndcg JOIN ev_rp USING (qid) JOIN ev_mrr USING (qid) JOIN ev_map USING (qid)
""")
def r6_mean_over_queries(spark, sf_dir):
    return R.mean_over_queries(R.evaluate(*_eval(spark, sf_dir), k=10))


NEIGHBOURS = f"""{BM25},
seed_t AS (SELECT DISTINCT doc_id AS seed, term FROM bm_tf),
ns AS (SELECT st.seed, p.doc_id AS docid, round(sum(p.w), 6) AS score
      FROM seed_t st JOIN bm_post p ON st.term = p.term WHERE p.doc_id <> st.seed GROUP BY 1, 2)"""


@register("b4_build_batches", f"""
WITH {NEIGHBOURS}
SELECT seed, CAST(row_number() OVER (PARTITION BY seed ORDER BY score DESC, docid) AS BIGINT) AS rank, docid, score
FROM ns QUALIFY rank <= 7
""")
def b4_build_batches(spark, sf_dir):
    _, idx = _index(spark, sf_dir)
    return B.build_batches(idx, top_k=8, seed_block=128, cand_block=256, decimals=6)


def _other_texts(spark, sf_dir, top_k):
    docs, idx = _index(spark, sf_dir)
    return docs, B.build_batches(idx, docs, top_k=top_k, cand_block=256, exclude_same_text=True, id_col="doc_id", decimals=6)


OTHER_TEXTS = f"""{NEIGHBOURS},
nt AS (SELECT ns.* FROM ns JOIN documents a ON a.doc_id = seed JOIN documents b ON b.doc_id = docid WHERE a.text <> b.text),
nb AS (SELECT seed, docid, score, CAST(row_number() OVER (PARTITION BY seed ORDER BY score DESC, docid) AS BIGINT) AS rank
       FROM nt QUALIFY rank <= 7)"""


@register("b4_exclude_same_text", f"WITH {OTHER_TEXTS} SELECT seed, rank, docid, score FROM nb")
def b4_exclude_same_text(spark, sf_dir):
    """Neighbours of another text than the seed's."""
    return _other_texts(spark, sf_dir, 8)[1]


@register("b4_neighbour_batches", f"""
WITH {OTHER_TEXTS}
SELECT d.doc_id AS batch_id, any_value(d.source) AS src,
       [d.doc_id] || coalesce(list(nb.docid ORDER BY nb.rank) FILTER (nb.docid IS NOT NULL), []) AS doc_ids
FROM documents d LEFT JOIN nb ON nb.seed = d.doc_id GROUP BY d.doc_id
""")
def b4_neighbour_batches(spark, sf_dir):
    """Batches of a seed and its neighbours, with the seed's source."""
    docs, near = _other_texts(spark, sf_dir, 8)
    return B.neighbour_batches(near, docs.select(F.col("doc_id").alias("id"), "source"))
