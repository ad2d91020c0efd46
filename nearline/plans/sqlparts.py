"""DuckDB fragments shared by oracle statements (mirrors of nearline.sources.fixtures)."""

from __future__ import annotations


def hex8(expr: str) -> str:
    return f"('0x' || substr({expr}, 1, 8))::BIGINT"


def md5k(*parts: str) -> str:
    """md5('seed:part:...') with parts given as SQL expressions."""
    return "md5(concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


WS = r"[\t\n\x0B\f\r ]"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


WORDS = r"[\p{L}\p{N}_]{2,}"


def words(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{WORDS}')"


# train_groups(group_id, query, positives, negatives); negatives of the next 2 conversations.
TRAIN_GROUPS = """
tg_user AS (SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user'),
tg_asst AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
tg_pos AS (SELECT conv_id, turn - 1 AS turn,
                  {'docid': CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), 'title': '', 'text': text} AS p
           FROM tg_asst),
tg_neg AS (SELECT a.conv_id - o.o AS conv_id,
                  list({'docid': CAST(a.conv_id AS VARCHAR) || '-' || CAST(a.turn AS VARCHAR), 'title': '', 'text': a.text}
                       ORDER BY a.conv_id, a.turn) AS negatives
           FROM tg_asst a, (VALUES (1), (2)) o(o) GROUP BY 1),
train_groups AS (
  SELECT u.conv_id * 1000 + u.turn AS group_id, u.query, [p.p] AS positives,
         coalesce(n.negatives, []) AS negatives
  FROM tg_user u JOIN tg_pos p ON u.conv_id = p.conv_id AND u.turn = p.turn
  LEFT JOIN tg_neg n ON n.conv_id = u.conv_id)
"""

# batch_member(batch_id, src, pos, doc_id, text): documents in (source, doc_id) order, 16 per batch.
DOC_BATCHES = """
db_idx AS (SELECT doc_id, text, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS idx FROM documents),
db_m AS (SELECT idx // 16 AS batch_id, CAST(idx % 16 AS INTEGER) AS pos, doc_id, text, source FROM db_idx),
batch_member AS (SELECT m.batch_id, f.source AS src, m.pos, m.doc_id, m.text
                 FROM db_m m JOIN db_m f ON f.batch_id = m.batch_id AND f.pos = 0),
batches AS (SELECT batch_id, any_value(src) AS src, list(text ORDER BY pos) AS texts,
                   list(doc_id ORDER BY pos) AS doc_ids
            FROM batch_member GROUP BY batch_id)
"""

STOPWORDS = ("a an and are as at be but by for if in into is it no not of on or such that the their then "
             "there these they this to was will with").split()
STOP_LIST = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def analyzed(expr: str) -> str:
    return f"list_filter({words(expr)}, lambda x: NOT list_contains({STOP_LIST}, x))"


# BM25 index over documents and top-10 run of benchmark queries (k1 1.5, b 0.75).
BM25 = f"""
bm_dt AS (SELECT doc_id, {analyzed('text')} AS terms FROM documents),
bm_docs AS (SELECT doc_id, len(terms) AS dl FROM bm_dt),
bm_stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM bm_docs),
bm_tf AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM bm_dt) x GROUP BY 1, 2),
bm_terms AS (SELECT term, count(*) AS df FROM bm_tf GROUP BY 1),
bm_idf AS (SELECT term, df, ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM bm_terms, bm_stats),
bm_post AS (SELECT t.term, t.doc_id, t.tf,
                   i.idf * t.tf / (1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d.dl / s.avgdl) + t.tf) AS w
            FROM bm_tf t JOIN bm_docs d ON t.doc_id = d.doc_id JOIN bm_idf i ON t.term = i.term, bm_stats s),
bm_q AS (SELECT item_id AS qid, text AS qtext, {analyzed('text')} AS terms FROM benchmark),
bm_qt AS (SELECT DISTINCT qid, unnest(terms) AS term FROM bm_q),
bm_scores AS (SELECT qid, doc_id AS docid, round(sum(w), 6) AS score
              FROM bm_qt JOIN bm_post ON bm_qt.term = bm_post.term GROUP BY 1, 2),
bm_run AS (SELECT qid, docid, score,
                  CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS BIGINT) AS rank
           FROM bm_scores QUALIFY rank <= 10),
qrels AS (SELECT b.item_id AS qid, d.doc_id AS docid, CAST(1 AS INTEGER) AS rel
          FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
ev_j AS (SELECT r.qid, r.docid, r.rank, coalesce(q.rel, 0) AS rel
         FROM bm_run r LEFT JOIN qrels q ON r.qid = q.qid AND r.docid = q.docid),
ev_nrel AS (SELECT qid, count(*) AS nrel FROM qrels WHERE rel > 0 GROUP BY qid),
ev_ndcg AS (
  SELECT i.qid, round(coalesce(d.dcg, 0) / i.idcg, 6) AS ndcg_10
  FROM (SELECT qid, sum(rel / log2(r + 1.0::DOUBLE)) AS idcg
        FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docid) AS r
              FROM qrels WHERE rel > 0) x WHERE r <= 10 GROUP BY qid) i
  LEFT JOIN (SELECT qid, sum(rel / log2(rank + 1.0::DOUBLE)) AS dcg FROM ev_j GROUP BY qid) d ON i.qid = d.qid),
ev_rp AS (
  SELECT n.qid, round(coalesce(h.hits, 0) / n.nrel, 6) AS recall_10, round(coalesce(h.hits, 0) / 10.0::DOUBLE, 6) AS precision_10
  FROM ev_nrel n LEFT JOIN (SELECT qid, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS hits FROM ev_j GROUP BY qid) h
  ON n.qid = h.qid),
ev_mrr AS (
  SELECT n.qid, coalesce(m.v, 0.0) AS mrr_10 FROM ev_nrel n
  LEFT JOIN (SELECT qid, round(1.0::DOUBLE / min(rank), 6) AS v FROM ev_j WHERE rel > 0 GROUP BY qid) m ON n.qid = m.qid),
ev_map AS (
  SELECT n.qid, round(coalesce(a.s, 0.0) / n.nrel, 6) AS map_10 FROM ev_nrel n
  LEFT JOIN (SELECT qid, sum(cum / rank) AS s FROM (
               SELECT qid, rank, rel, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END)
                      OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
               FROM ev_j) x WHERE rel > 0 GROUP BY qid) a ON n.qid = a.qid)
"""

# Vocabulary over documents and word-id tokenization ([BOS]=1 first, unknown -> 3).
VOCAB = f"""
vw AS (SELECT doc_id, {words('text')} AS w FROM documents),
vt AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM vw),
vc AS (SELECT term, count(*)::BIGINT AS cf, count(DISTINCT doc_id)::BIGINT AS df FROM vt GROUP BY term),
vocab AS (SELECT term, (row_number() OVER (ORDER BY cf DESC, term) - 1 + 4)::BIGINT AS term_id, cf, df FROM vc
          UNION ALL SELECT * FROM (VALUES ('<pad>', 0::BIGINT, 0::BIGINT, 0::BIGINT), ('<s>', 1, 0, 0),
                                          ('</s>', 2, 0, 0), ('<unk>', 3, 0, 0)) s(term, term_id, cf, df)),
dids AS (SELECT doc_id, list(CAST(coalesce(v.term_id, 3) AS INTEGER) ORDER BY p) AS ids
         FROM vt LEFT JOIN vocab v ON vt.term = v.term GROUP BY doc_id),
dtok AS (SELECT d.doc_id, [1] || coalesce(x.ids, []::INTEGER[]) AS input_ids
         FROM documents d LEFT JOIN dids x ON d.doc_id = x.doc_id)
"""


def rep(value: int, n: str) -> str:
    return f"list_transform(range(greatest({n}, 0)), lambda x: CAST({value} AS INTEGER))"


def pad(ids: str, length: str, pad_id: int = 2) -> str:
    return f"({ids} || {rep(pad_id, f'{length} - len({ids})')})"


def mask(n: str, length: str) -> str:
    return f"({rep(1, n)} || {rep(0, f'{length} - {n}')})"


def half(ids: str, eos: int = 2) -> str:
    return f"CAST(floor((len({ids}) - CASE WHEN {ids}[-1] = {eos} THEN 1 ELSE 0 END) * 0.5::DOUBLE) AS INTEGER)"


def first_half(ids: str, eos: int = 2) -> str:
    return f"(list_slice({ids}, 1, {half(ids, eos)}) || [CAST({eos} AS INTEGER)])"


def hash_encode(name: str, src: str, binary: bool = False, dim: int = 64) -> str:
    """CTEs ``{name}`` (id, rep) of the hashing encoder over ``src`` (id, terms); needs bm_idf."""
    terms = "list_distinct(terms)" if binary else "terms"
    return f"""
{name}_tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({terms}) AS term FROM {src}) x GROUP BY 1, 2),
{name}_w AS (SELECT id, CAST({hex8('md5(term)')} % {dim} AS INTEGER) AS bucket,
                 CASE WHEN {hex8('substr(md5(term), 9, 8)')} % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * tf * idf AS v
          FROM {name}_tf JOIN bm_idf USING (term)),
{name}_b AS (SELECT id, bucket, CAST(sum(CAST(floor(v * 1e9::DOUBLE + 0.5::DOUBLE) AS BIGINT)) AS DOUBLE) / 1e9::DOUBLE AS v FROM {name}_w GROUP BY 1, 2),
{name}_d AS (SELECT s.id, list(coalesce(b.v, 0.0::DOUBLE) ORDER BY r.i) AS dense
          FROM {src} s CROSS JOIN range({dim}) r(i) LEFT JOIN {name}_b b ON b.id = s.id AND b.bucket = r.i GROUP BY s.id),
{name} AS (SELECT id, list_transform(dense, lambda x: x / greatest(sqrt(list_inner_product(dense, dense)), 1e-12::DOUBLE)) AS rep
        FROM {name}_d)
"""


# Exact inner-product top-k of all embeddings against all.
KNN_SQL = """
SELECT qid, docid, rank, score FROM (
  SELECT q.vec_id AS qid, d.vec_id AS docid,
         round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score,
         CAST(row_number() OVER (PARTITION BY q.vec_id
              ORDER BY round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) DESC,
                       d.vec_id) AS BIGINT) AS rank
  FROM embeddings q, embeddings d) t
WHERE rank <= {k}
"""
KNN10 = KNN_SQL.format(k=10)


def unit(expr: str) -> str:
    return f"({hex8(expr)}::DOUBLE / 4294967296.0::DOUBLE)"


# Synthetic model outputs over benchmark words from md5 values.
MODEL_OUT = f"""
mo_w AS (SELECT item_id AS id, {words('text')} AS w FROM benchmark),
mo_n AS (SELECT id, w, len(w) AS n FROM mo_w),
mo_pos AS (SELECT id, n, w, unnest(range(n)) AS pos FROM mo_n),
token_logits AS (SELECT id, pos, CAST({hex8(md5k("'42'", 'id', 'pos', 'j'))} % 1000 AS INTEGER) AS term_id,
                        {unit(md5k("'43'", 'id', 'pos', 'j'))} * 4.0::DOUBLE - 2.0::DOUBLE AS logit, 1 AS mask
                 FROM mo_pos, range(8) r(j)),
token_weights AS (SELECT id, pos, CAST({hex8('md5(w[pos + 1])')} % 30000 AS INTEGER) AS term_id,
                         {unit(md5k("'44'", 'id', 'pos'))} * 2.0::DOUBLE - 1.0::DOUBLE AS weight FROM mo_pos)
"""
