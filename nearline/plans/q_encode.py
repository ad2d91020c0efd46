"""Encoders, pooling and sparse search."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearline.functions.hashing import hex8, md5_key
from nearline.functions.text import words
from nearline.operators import encode as E
from nearline.operators import lexical as B
from nearline.operators import search as S
from nearline.plans.registry import register
from nearline.plans.sqlparts import BM25, MODEL_OUT, WS, analyzed, hash_encode, hex8 as sql_hex8, md5k, unit
from nearline.session import table

R6 = lambda c: F.transform(c, lambda x: F.round(x, 6) + F.lit(0.0))  # noqa: E731  (no negative zero)


def _index(spark, sf_dir):
    return B.bm25_index(B.analyze(table(spark, sf_dir, "documents"), "doc_id", "text"))


def _doc_reps(spark, sf_dir, idx):
    return E.hashing_encode_index(idx, dim=64)


def _query_reps(spark, sf_dir, idx):
    return E.hashing_encode(table(spark, sf_dir, "benchmark"), idx, dim=64, id_col="item_id", is_query=True,
                            binary=True, prefix="query: ", max_terms=32)


DOC_SRC = f"he_src AS (SELECT doc_id AS id, {analyzed('text')} AS terms FROM documents)"
Q_SRC = f"hq_src AS (SELECT item_id AS id, list_slice({analyzed(chr(39) + 'query: ' + chr(39) + ' || text')}, 1, 32) AS terms FROM benchmark)"


@register("e1_encode", f"""
WITH {BM25}, {DOC_SRC}, {hash_encode('he', 'he_src')}
SELECT id, list_transform(rep, lambda x: round(x, 6) + 0.0::DOUBLE) AS rep FROM he
""")
def e1_encode(spark, sf_dir):
    r = _doc_reps(spark, sf_dir, _index(spark, sf_dir))
    return r.select("id", R6("rep").alias("rep"))


@register("e2_encode_query", f"""
WITH {BM25}, {Q_SRC}, {hash_encode('hq', 'hq_src', binary=True)}
SELECT id, list_transform(rep, lambda x: round(x, 6) + 0.0::DOUBLE) AS rep FROM hq
""")
def e2_encode_query(spark, sf_dir):
    r = _query_reps(spark, sf_dir, _index(spark, sf_dir))
    return r.select("id", R6("rep").alias("rep"))


@register("e3_untied_search", f"""
WITH {BM25}, {DOC_SRC}, {hash_encode('he', 'he_src')}, {Q_SRC}, {hash_encode('hq', 'hq_src', binary=True)},
s AS (SELECT q.id AS qid, d.id AS docid, round(list_inner_product(q.rep, d.rep), 6) AS score FROM hq q, he d)
SELECT qid, docid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS BIGINT) AS rank, score
FROM s QUALIFY rank <= 10
""")
def e3_untied_search(spark, sf_dir):
    idx = _index(spark, sf_dir)
    return S.knn_exact(_query_reps(spark, sf_dir, idx), _doc_reps(spark, sf_dir, idx), k=10, decimals=6)


def hidden_states(spark, sf_dir, padding: int = 2, dim: int = 8):
    """hidden_states(id, h, attention_mask) with md5-derived values: every word, then ``padding`` masked positions."""
    b = table(spark, sf_dir, "benchmark")
    n = F.size(words("text"))
    val = lambda p, d: hex8(md5_key(42, "item_id", p, d)).cast("double") / F.lit(4294967296.0) * 2.0 - 1.0
    h = F.transform(F.sequence(F.lit(0), n + F.lit(padding - 1)),
                    lambda p: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: val(p, d)))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), padding))
    return b.select(F.col("item_id").alias("id"), h.alias("h"), mask.alias("attention_mask"))


HS_SQL = f"""
hs AS (SELECT item_id AS id,
              list_transform(range(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) + 2), lambda p: list_transform(range(8),
                  lambda d: {unit(md5k("'42'", 'item_id', 'p', 'd'))} * 2.0::DOUBLE - 1.0::DOUBLE)) AS h,
              len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS n
       FROM benchmark)
"""


@register("e4_pool_first", f"WITH {HS_SQL} SELECT id, list_transform(h[1], lambda x: round(x, 6) + 0.0::DOUBLE) AS rep FROM hs")
def e4_pool_first(spark, sf_dir):
    hs = hidden_states(spark, sf_dir)
    return hs.select("id", R6(E.pool(F.col("h"), F.col("attention_mask"), "cls")).alias("rep"))


@register("e5_pool_mean", f"""
WITH {HS_SQL},
u AS (SELECT id, n, unnest(list_slice(h, 1, n)) AS v FROM hs),
e AS (SELECT id, n, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM u),
m AS (SELECT id, d, sum(x) / any_value(n) AS x FROM e GROUP BY id, d)
SELECT hs.id, CASE WHEN hs.n > 0 THEN (SELECT list(round(x, 6) + 0.0::DOUBLE ORDER BY d) FROM m WHERE m.id = hs.id) END AS rep FROM hs
""")
def e5_pool_mean(spark, sf_dir):
    hs = hidden_states(spark, sf_dir)
    return hs.select("id", R6(E.pool(F.col("h"), F.col("attention_mask"), "mean")).alias("rep"))


@register("e6_pool_last", f"""
WITH {HS_SQL} SELECT id, CASE WHEN n > 0 THEN list_transform(h[n], lambda x: round(x, 6) + 0.0::DOUBLE) END AS rep FROM hs
""")
def e6_pool_last(spark, sf_dir):
    hs = hidden_states(spark, sf_dir)
    return hs.select("id", R6(E.pool(F.col("h"), F.col("attention_mask"), "eos")).alias("rep"))


def _positions(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), words("text").alias("w"))
    n = F.size("w")
    return b.select("id", "w", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos")).where(n > 0)


def token_logits(spark, sf_dir):
    p = _positions(spark, sf_dir).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(7))))
    u = lambda seed: hex8(md5_key(seed, "id", "pos", "j")).cast("double") / F.lit(4294967296.0)
    return p.select("id", "pos", F.pmod(hex8(md5_key(42, "id", "pos", "j")), F.lit(1000)).cast("int").alias("term_id"),
                    (u(43) * 4.0 - 2.0).alias("logit"), F.lit(1).alias("mask"))


def token_weights(spark, sf_dir):
    p = _positions(spark, sf_dir)
    term = F.element_at("w", (F.col("pos") + 1).cast("int"))
    u = hex8(md5_key(44, "id", "pos")).cast("double") / F.lit(4294967296.0)
    return p.select("id", "pos", F.pmod(hex8(F.md5(term)), F.lit(30000)).cast("int").alias("term_id"),
                    (u * 2.0 - 1.0).alias("weight"))


@register("e8_splade_pool", f"""
WITH {MODEL_OUT}
SELECT id, term_id, round(max(ln(1 + greatest(logit, 0.0::DOUBLE)) * mask), 6) AS weight FROM token_logits
GROUP BY id, term_id HAVING max(ln(1 + greatest(logit, 0.0::DOUBLE)) * mask) > 0
""")
def e8_splade_pool(spark, sf_dir):
    s = E.splade_pool(token_logits(spark, sf_dir))
    return s.select("id", "term_id", F.round("weight", 6).alias("weight"))


UNICOIL_SQL = """
SELECT id, term_id, max(greatest(weight, 0.0::DOUBLE)) AS weight FROM token_weights
WHERE term_id NOT IN (0, 101, 102, 103) GROUP BY id, term_id HAVING max(greatest(weight, 0.0::DOUBLE)) > 0
"""


@register("e9_unicoil_pool", f"WITH {MODEL_OUT} SELECT id, term_id, round(weight, 6) AS weight FROM ({UNICOIL_SQL}) u")
def e9_unicoil_pool(spark, sf_dir):
    s = E.unicoil_pool(token_weights(spark, sf_dir))
    return s.select("id", "term_id", F.round("weight", 6).alias("weight"))


V6_SQL = f"""
WITH {MODEL_OUT},
q AS ({UNICOIL_SQL}),
dt AS (SELECT doc_id, unnest({analyzed('text')}) AS term FROM documents),
d AS (SELECT doc_id AS id, CAST({sql_hex8('md5(term)')} % 30000 AS INTEGER) AS term_id, count(*)::DOUBLE AS weight
      FROM dt GROUP BY 1, 2),
s AS (SELECT q.id AS qid, d.id AS docid, round(sum(q.weight * d.weight), 6) AS score
      FROM q JOIN d ON q.term_id = d.term_id GROUP BY 1, 2)
SELECT qid, docid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS BIGINT) AS rank, score
FROM s QUALIFY rank <= 10
"""


def _sparse(spark, sf_dir):
    q = E.unicoil_pool(token_weights(spark, sf_dir))
    docs = B.analyze(table(spark, sf_dir, "documents"), "doc_id", "text")
    # Documents are exchanged once, as arrays; the counts need no other exchange.
    d = (E.md5_term_ids(docs, 30000).repartition("id").select("id", F.explode("terms").alias("term_id"))
         .groupBy("id", "term_id").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    return q, d


@register("v6_knn_sparse", V6_SQL)
def v6_knn_sparse(spark, sf_dir):
    return S.knn_sparse(*_sparse(spark, sf_dir), k=10, decimals=6)


@register("v6_blocks", V6_SQL)
def v6_blocks(spark, sf_dir):
    """V6 on stored posting blocks."""
    q, d = _sparse(spark, sf_dir)
    return S.knn_sparse_blocks(q, S.sparse_blocks(d, range_docs=64), k=10, decimals=6)


def _plain_encoded(name: str, texts: str, id_col: str, prefix: str, longest: int) -> str:
    """CTEs ``{name}`` (id, rep): the unweighted hashing encoder over the first words of prefix + text."""
    cut = rf"regexp_extract('{prefix}' || text, '^(?:{WS}*[^\t\n\x0B\f\r ]+){{0,{longest}}}', 0)"
    return f"""
{name}_src AS (SELECT {id_col} AS id, {analyzed(cut)} AS terms FROM {texts}),
{name}_t AS (SELECT id, unnest(terms) AS term FROM {name}_src),
{name}_b AS (SELECT id, CAST({sql_hex8('md5(term)')} % 64 AS INTEGER) AS bucket,
    sum(CASE WHEN {sql_hex8("substr(md5(term), 9, 8)")} % 2 = 0 THEN 1 ELSE -1 END) AS v FROM {name}_t GROUP BY ALL),
{name}_d AS (SELECT s.id, list(coalesce(b.v, 0)::DOUBLE ORDER BY r.i) AS d
    FROM {name}_src s CROSS JOIN range(64) r(i) LEFT JOIN {name}_b b ON b.id = s.id AND b.bucket = r.i GROUP BY s.id),
{name} AS (SELECT id, list_transform(d, lambda x: x / greatest(sqrt(list_inner_product(d, d)), 1e-12::DOUBLE)) AS rep FROM {name}_d)
"""


@register("u1_batch_encoder", f"""
WITH {_plain_encoded('p', 'documents', 'doc_id', 'passage: ', 128)}
SELECT id, list_transform(rep, lambda x: round(x, 6) + 0.0::DOUBLE) AS rep FROM p
""")
def u1_batch_encoder(spark, sf_dir):
    """Any encoder with a batch ``encode``: passages cut at 128 words, prefix included."""
    docs = table(spark, sf_dir, "documents")
    reps = E.encode(docs, E.HashingEncoder, id_col="doc_id", passage_max_len=128, out_type="array<double>")
    return reps.select("id", R6("rep").alias("rep"))


@register("e3_untied_encoders", f"""
WITH {_plain_encoded('q', 'benchmark', 'item_id', 'query: ', 16)}, {_plain_encoded('p', 'documents', 'doc_id', 'passage: ', 64)},
s AS (SELECT q.id AS qid, p.id AS docid, round(list_inner_product(q.rep, p.rep), 6) + 0.0::DOUBLE AS score FROM q, p)
SELECT qid, docid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS BIGINT) AS rank, score
FROM s QUALIFY rank <= 10
""")
def e3_untied_encoders(spark, sf_dir):
    """Separate query and passage encoders with their own maximum lengths, then exact search."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    q, d = E.encode_untied(queries, docs, E.HashingEncoder, E.HashingEncoder, query_max_len=16, passage_max_len=64,
                           out_type="array<double>")
    return S.knn_exact(q, d, k=10, decimals=6).withColumn("score", F.col("score") + F.lit(0.0))
