"""Lexical analysis, BM25 indexing and search, chunking.

The index is a few grouped aggregates over exploded tokens; search is an
equi-join of distinct query terms, with their idf, and the stored term counts,
summed per (query, document).  Corpus-wide constants (document count, average
length) enter as scalar subqueries, so nothing is collected.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearline.functions.text import WS_CLASS, words
from nearline.operators.indexing import with_global_index, with_row_key
from nearline.operators.postings import PostingBlocks, blocks_of, pack_documents, search_blocks
from nearline.operators.search import id_order, meet_groups, rank_results, rounded, whole
from nearline.session import materialize as materialize_table

# English stopword list of the lexical analyzer ('en').
ENGLISH_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it",
    "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they",
    "this", "to", "was", "will", "with",
)


def analyze_col(text, stopwords=ENGLISH_STOPWORDS) -> Column:
    """B1 as a column: lower-cased words of 2+ word characters minus stopwords."""
    toks = words(text)
    if stopwords:
        stop = list(stopwords)
        toks = F.filter(toks, lambda x: ~x.isin(stop))
    return toks


@dataclass(frozen=True)
class SuffixRule:
    """Words that end in ``suffix``, and not in one of ``unless``, get ``replacement`` in its place."""

    suffix: str
    replacement: str = ""
    unless: tuple[str, ...] = ()


#: The three plural rules of the S-stemmer; the first whose suffix fits decides.
PLURALS = (SuffixRule("ies", "y", ("eies", "aies")), SuffixRule("es", "e", ("aes", "ees", "oes")), SuffixRule("s", "", ("us", "ss")))


def stem(term: Column, rules=PLURALS, shortest: int = 3) -> Column:
    """B1: the first rule that applies to a word of at least ``shortest`` characters, as a column."""
    out = term
    for rule in reversed(rules):
        fits = term.endswith(rule.suffix)
        for other in rule.unless:
            fits = fits & ~term.endswith(other)
        cut = F.concat(F.substring(term, F.lit(1), F.length(term) - len(rule.suffix)), F.lit(rule.replacement))
        out = F.when(fits, cut).otherwise(out)
    return F.when(F.length(term) >= shortest, out).otherwise(term)


def analyze(df: DataFrame, id_col: str = "id", text_col: str = "text", stopwords=ENGLISH_STOPWORDS,
            stemmer=None, out: str = "terms") -> DataFrame:
    """B1: (id, terms ARRAY<STRING>) of each row, whatever its id.

    ``stemmer`` is a sequence of ``SuffixRule``, evaluated as a column, or a Python
    ``str -> str``, which runs once per *distinct* term over a Spark-partitioned
    term table and is joined back, never once per token.
    """
    res = df.select(F.col(id_col).alias("id"), analyze_col(F.col(text_col), stopwords).alias(out))
    if stemmer is None:
        return res
    if callable(stemmer):
        return stem_terms(res, stemmer, out)
    return res.withColumn(out, F.transform(out, lambda t: stem(t, tuple(stemmer))))


def stem_terms(df: DataFrame, stemmer, col: str = "terms") -> DataFrame:
    """Terms replaced by a Python stemmer; rows are put back by a stored row number."""
    import pandas as pd

    rows = with_row_key(df)
    toks = rows.select("_nl_row", F.posexplode(col).alias("pos", "term"))

    def run(it):
        for pdf in it:
            yield pd.DataFrame({"term": pdf["term"], "stem": [stemmer(t) for t in pdf["term"]]})

    stems = toks.select("term").distinct().mapInPandas(run, "term string, stem string")
    g = toks.join(stems, "term").groupBy("_nl_row").agg(F.array_sort(F.collect_list(F.struct("pos", "stem"))).alias("_s"))
    stemmed = F.coalesce(F.transform("_s", lambda x: x["stem"]), F.col(col))
    return rows.join(g, "_nl_row", "left").withColumn(col, stemmed).select(*df.columns)


@dataclass
class BM25Index:
    """Stored parts of an index; weights are computed where postings are read."""

    tf: DataFrame        # term, doc_id, tf, dl; clustered by document
    terms: DataFrame     # term, df, idf
    docs: DataFrame      # doc_id, dl
    stats: DataFrame     # n, avgdl (one row)
    k1: float
    b: float

    def weight(self) -> Column:
        """BM25 weight of a row with tf, dl and idf."""
        return F.col("idf") * F.col("tf") / (self._norm() + F.col("tf"))

    def tf_weight(self) -> Column:
        """Its part without idf."""
        return F.col("tf") / (self._norm() + F.col("tf"))

    def _norm(self) -> Column:
        avgdl = self.stats.select("avgdl").scalar()
        return F.lit(self.k1) * (1.0 - self.b + self.b * F.col("dl") / avgdl)

    @property
    def postings(self) -> DataFrame:
        """All postings (term, doc_id, tf, w)."""
        return self.tf.join(self.terms.select("term", "idf"), "term").select("term", "doc_id", "tf",
                                                                             self.weight().alias("w"))


def _with_idf(dfs: DataFrame, n: Column) -> DataFrame:
    return dfs.withColumn("idf", F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def _stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def _stored(df: DataFrame, name: str, store: bool) -> DataFrame:
    return materialize_table(df, name) if store else df


def bm25_index(analyzed: DataFrame, k1: float = 1.5, b: float = 0.75, id_col: str = "id",
               terms_col: str = "terms", materialize: bool = True) -> BM25Index:
    """B2: tf(term, doc_id, tf, dl), terms(term, df, idf), docs(doc_id, dl), stats(n, avgdl).

    Ids must be set and differ; else the index raises.  Documents are exchanged once, as term arrays hashed on their id; the counts
    per (document, term) then need no further exchange, and the table stays
    clustered by document, so score sums of a search combine map-side.  The
    tables are written to the shared checkpoint folder; ``write_index`` keeps
    them for later sessions.
    """
    docs = analyzed.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(terms_col), F.array()).alias("_terms"))
    docs = docs.select("doc_id", F.size("_terms").cast("bigint").alias("dl"), "_terms").repartition("doc_id")
    tf = (docs.select("doc_id", "dl", F.explode("_terms").alias("term"))
          .groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
          .select("term", "doc_id", "tf", "dl"))
    tf = _stored(tf, "bm25_tf", materialize)
    # One row of each id; the lengths repeat the analysis only for documents without terms.
    rows = analyzed.groupBy(F.col(id_col).alias("doc_id")).agg(F.count(F.lit(1)).alias("_rows"))
    wrong = F.raise_error(F.concat(F.lit("document ids must be set and differ: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    one = F.when(F.col("doc_id").isNull() | (F.col("_rows") > 1), wrong.cast("bigint"))
    lengths = tf.groupBy("doc_id").agg(F.first("dl").alias("dl"))
    docs = (rows.withColumn("_rows", F.coalesce(one, F.lit(0)))
            .join(lengths, "doc_id", "left").select("doc_id", (F.coalesce("dl", F.lit(0)) + F.col("_rows")).cast("bigint").alias("dl")))
    docs = _stored(docs, "bm25_docs", materialize)
    stats = _stored(_stats(docs), "bm25_stats", materialize)
    dfs = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = _stored(_with_idf(dfs, stats.select("n").scalar()), "bm25_terms", materialize)
    return BM25Index(tf, terms, docs, stats, k1, b)


def bm25_append(index: BM25Index, analyzed: DataFrame, id_col: str = "id", terms_col: str = "terms") -> BM25Index:
    """The index of the old and the new documents: new postings are added, document
    frequencies summed, idf and lengths derived anew.  Ids must be new."""
    new = bm25_index(analyzed, index.k1, index.b, id_col, terms_col)
    docs = index.docs.unionByName(new.docs)
    stats = materialize_table(_stats(docs), "bm25_stats")
    dfs = index.terms.unionByName(new.terms).groupBy("term").agg(F.sum("df").alias("df"))
    terms = materialize_table(_with_idf(dfs, stats.select("n").scalar()), "bm25_terms")
    return BM25Index(index.tf.unionByName(new.tf), terms, docs, stats, index.k1, index.b)


PARTS = ("tf", "terms", "docs", "stats")


def write_index(index: BM25Index, path: str) -> None:
    """Store an index under ``path`` (one Parquet folder a part; k1 and b in ``stats``)."""
    for part in PARTS:
        df = getattr(index, part)
        if part == "stats":
            df = df.select("n", "avgdl", F.lit(index.k1).alias("k1"), F.lit(index.b).alias("b"))
        df.write.parquet(f"{path.rstrip('/')}/{part}")


def read_index(spark: SparkSession, path: str) -> BM25Index:
    """An index stored by ``write_index``."""
    tf, terms, docs, stats = (spark.read.parquet(f"{path.rstrip('/')}/{part}") for part in PARTS)
    params = stats.select("k1", "b").first()
    return BM25Index(tf, terms, docs, stats.select("n", "avgdl"), params.k1, params.b)


def bm25_scores(query_terms: DataFrame, index: BM25Index, qid: str = "id", terms_col: str = "terms",
                decimals: int | None = None) -> DataFrame:
    """(qid, docid, score) over distinct query terms; documents sharing no term get no row."""
    qt = query_terms.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(terms_col)).alias("term"))
    qt = qt.join(index.terms.select("term", "idf"), "term")
    return (qt.join(index.tf, "term").groupBy("qid", F.col("doc_id").alias("docid"))
            .agg(rounded(F.sum(index.weight()), decimals).alias("score")))


def bm25_search(query_terms: DataFrame, index: BM25Index, k: int = 10, qid: str = "id",
                terms_col: str = "terms", decimals: int | None = None) -> DataFrame:
    """run(qid, docid, rank, score), ties by docid; ``decimals`` rounds scores before ranking."""
    s = bm25_scores(query_terms, index, qid, terms_col, decimals)
    return rank_results(s, k).select("qid", "docid", "rank", "score")


#: A vocabulary of at most so many bytes is sent to the tasks that read postings; a larger one is joined.
SENT_BYTES = 64 << 20


def bm25_blocks(index: BM25Index, range_docs: int = 64, buckets: int = 16, path: str | None = None,
                order: DataFrame | None = None) -> PostingBlocks:
    """The index's weights as posting blocks.

    ``order(doc, key)`` puts documents of alike words together (a language, a
    source); without it they go by length, as short ones weigh alike.
    """
    if order is None:
        order = index.docs.select(F.col("doc_id").alias("doc"), F.col("dl").alias("key"))
    names = with_global_index(index.terms.select("term", F.col("idf").alias("scale")), ["term"], "no").withColumn("no", F.col("no").cast("int"))
    names = materialize_table(names, "bm25_names")
    size = names.agg(F.sum(F.octet_length("term") + F.lit(12))).first()[0] or 0
    names = F.broadcast(names) if size <= SENT_BYTES else names
    # Within a document these weights take few values, and terms are numbers: arrays of both are small.
    weights = index.tf.join(names, "term").select(F.col("doc_id").alias("doc"), F.col("no").alias("term"), index.tf_weight().alias("w"))
    return blocks_of(pack_documents(weights), order, range_docs, buckets, path, names)


def query_weights(query_terms: DataFrame, qid: str = "id", terms_col: str = "terms") -> DataFrame:
    """(qid, term, qw): the distinct terms of each query, weight one; ids must differ."""
    return query_terms.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(terms_col)).alias("term"), F.lit(1.0).alias("qw"))


def bm25_block_search(query_terms: DataFrame, blocks: PostingBlocks, k: int = 10, qid: str = "id", terms_col: str = "terms",
                      decimals: int | None = None, first: int = 6, **kw) -> DataFrame:
    """B3 on posting blocks: the run of ``bm25_search``, reading only blocks that can reach the top k."""
    return search_blocks(query_weights(query_terms, qid, terms_col), blocks, k, first, decimals, **kw)


def chunk(corpus: DataFrame, max_words: int = 128, overlap: int = 0, id_col: str = "id",
          text_col: str = "text") -> DataFrame:
    """Passages of at most ``max_words`` whitespace-separated words, ``overlap``
    words shared by neighbours -> (doc_id, chunk_no, text).  Every word is kept."""
    if not 0 <= overlap < max_words:
        raise ValueError("need 0 <= overlap < max_words")
    step = max_words - overlap
    words_of = F.filter(F.split(F.col(text_col), f"{WS_CLASS}+"), lambda x: x != "")
    docs = corpus.select(F.col(id_col).alias("doc_id"), words_of.alias("_w"))
    n = F.size("_w")
    n_chunks = F.when(n <= max_words, F.lit(1)).otherwise(
        F.ceil((n - F.lit(overlap)) / F.lit(step)).cast("int"))
    # Slices are joined before the explode, so no chunk row carries the whole word array.
    passages = F.transform(F.sequence(F.lit(0), (n_chunks - 1).cast("int")),
                           lambda i: F.array_join(F.slice("_w", i * step + 1, max_words), " "))
    return docs.select("doc_id", F.posexplode(passages).alias("chunk_no", "text"))


#: Terms that are multiplied at once; a term in more than a share ``DENSE`` of the candidates is multiplied, a rarer one is added up by its postings.
TERM_SLICE, DENSE = 4096, 1 / 16
#: Postings of a group of seeds and of candidates, scores of a pair of groups that are worth a task, products of rare terms held at once.
SEED_POSTINGS, CAND_POSTINGS, PAIR_SCORES, RARE_PRODUCTS = 16 << 20, 6 << 20, 1 << 25, 1 << 22
#: Postings that are sent at once, of seeds and of candidates; more go in waves of candidate groups, each stored and its shuffle files deleted.
WAVE_POSTINGS = 1 << 28
#: Least seeds and candidates that are scored at a time: smaller matrices cost more to make than to multiply.
SEED_STEP, CAND_STEP = 512, 2048


def _entries(lists) -> tuple[np.ndarray, np.ndarray]:
    """(start of each row and the end, values) of an Arrow list column."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.r_[0, np.cumsum(sizes)], lists.flatten().to_numpy(zero_copy_only=False)


def _keep_best(best: np.ndarray, places: np.ndarray, S: np.ndarray, lo: int) -> None:
    """Merge the scores ``S`` of documents from place ``lo`` on into the best so far; equal scores go to the smaller place."""
    k = best.shape[1]
    hits = S > best[:, -1:]  # a later document of the k-th score does not enter
    if np.count_nonzero(hits) > 4 * hits.shape[0] * k and S.shape[1] > k:
        hits &= S >= np.partition(S, S.shape[1] - k, axis=1)[:, S.shape[1] - k][:, None]
    r, c = np.nonzero(hits)
    if not r.size:
        return
    u, inv = np.unique(r, return_inverse=True)
    rows = np.concatenate([np.repeat(np.arange(u.size), k), inv])
    at, score = np.concatenate([places[u].ravel(), c + lo]), np.concatenate([best[u].ravel(), S[r, c]])
    order = np.lexsort((at, -score, rows))
    rows = rows[order]
    order = order[np.arange(rows.size) - np.searchsorted(rows, rows) < k]
    best[u], places[u] = score[order].reshape(-1, k), at[order].reshape(-1, k)


def _neighbour_scorer(k: int, decimals: int | None, exclude_same_text: bool, seed_block: int, cand_block: int):
    """Kernel over a group of seeds (i, terms[, h]) and one of candidates (i, terms, weights[, h]): the best k of each seed."""
    seed_block, cand_block = max(seed_block, SEED_STEP), max(cand_block, CAND_STEP)

    def run(s: pa.Table, c: pa.Table) -> pa.Table:
        s_ids, n_s = whole(s.column("i")), s.num_rows
        c = id_order(c)
        c_ids, n_c = whole(c.column("i")), c.num_rows
        best, places = np.full((n_s, k), -np.inf), np.full((n_s, k), -1, dtype=np.int64)
        if n_s and n_c and k:
            s_at, s_term = _entries(whole(s.column("terms")))
            c_at, c_term = _entries(whole(c.column("terms")))
            c_w = _entries(whole(c.column("weights")))[1]
            known, c_term = np.unique(c_term, return_inverse=True)
            dense = np.bincount(c_term) > DENSE * n_c
            column = np.cumsum(dense) - 1  # of a dense term
            n_dense = int(dense.sum())
            t = np.searchsorted(known, s_term)
            t = np.where(known[np.minimum(t, known.size - 1)] == s_term, t, -1)
            own = pc.index_in(s_ids, value_set=c_ids).fill_null(-1).to_numpy(zero_copy_only=False)
            texts = [whole(x.column("h")).to_numpy(zero_copy_only=False) for x in (s, c)] if exclude_same_text else None
            for lo in range(0, n_c, cand_block):
                hi = min(n_c, lo + cand_block)
                wide = hi - lo
                part = slice(c_at[lo], c_at[hi])
                terms, w = c_term[part], c_w[part]
                col = np.repeat(np.arange(wide), np.diff(c_at[lo:hi + 1]))
                common = dense[terms]
                d_col, d_row, d_w = col[common], column[terms[common]], w[common]
                order = np.argsort(terms[~common], kind="stable")
                r_term, r_col, r_w = terms[~common][order], col[~common][order], w[~common][order]

                def weights(first: int, d_col=d_col, d_row=d_row, d_w=d_w, wide=wide) -> np.ndarray:
                    W = np.zeros((min(TERM_SLICE, n_dense - first), wide))
                    some = (d_row >= first) & (d_row < first + TERM_SLICE)
                    W[d_row[some] - first, d_col[some]] = d_w[some]
                    return W

                once = weights(0) if 0 < n_dense <= TERM_SLICE else None
                for a in range(0, n_s, seed_block):
                    b = min(n_s, a + seed_block)
                    asked = t[s_at[a]:s_at[b]]
                    row = np.repeat(np.arange(b - a), np.diff(s_at[a:b + 1]))[asked >= 0]
                    asked = asked[asked >= 0]
                    S = np.zeros((b - a, wide))
                    among = dense[asked]
                    q_row, q_col = row[among], column[asked[among]]
                    for first in range(0, n_dense, TERM_SLICE):  # memory does not grow with the texts' vocabulary
                        W = weights(first) if once is None else once
                        Q = np.zeros((b - a, W.shape[0]))
                        some = (q_col >= first) & (q_col < first + TERM_SLICE)
                        Q[q_row[some], q_col[some] - first] = 1.0
                        S += Q @ W
                    row, asked = row[~among], asked[~among]
                    start = np.searchsorted(r_term, asked)
                    n = np.searchsorted(r_term, asked, side="right") - start
                    row, start, n = row[n > 0], start[n > 0], n[n > 0]
                    ends = np.cumsum(n)
                    x = 0
                    while x < n.size:
                        y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + RARE_PRODUCTS, side="right")))
                        size = n[x:y]
                        at = np.repeat(start[x:y] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                        cell = np.repeat(row[x:y] * wide, size) + r_col[at]
                        S += np.bincount(cell, weights=r_w[at], minlength=S.size).reshape(S.shape)
                        x = y
                    out = S <= 0  # no term is shared
                    here = np.flatnonzero((own[a:b] >= lo) & (own[a:b] < hi))
                    out[here, own[a:b][here] - lo] = True
                    if texts is not None:
                        out |= texts[0][a:b, None] == texts[1][None, lo:hi]
                    if decimals is not None:
                        S = np.round(S, decimals)
                    S[out] = -np.inf
                    _keep_best(best[a:b], places[a:b], S, lo)
        row, at = np.nonzero(places >= 0)
        return pa.table({"seed": s_ids.take(pa.array(row)), "docid": c_ids.take(pa.array(places[row, at])), "score": pa.array(best[row, at])})

    return run


def _neighbour_groups(n: int, postings: int, parts: int) -> tuple[int, int]:
    """Groups of seeds and of candidates: as few as memory and the tasks allow, as each is sent to every group of the other.

    A candidate's posting has a weight and is three times as long as a seed's.
    """
    pairs = max(1, min(parts, -(-n * n // PAIR_SCORES)))
    s = max(-(-postings // SEED_POSTINGS), math.ceil(math.sqrt(pairs / 3)))
    return s, max(-(-postings // CAND_POSTINGS), -(-pairs // s))


def build_batches(index: BM25Index, corpus: DataFrame | None = None, top_k: int = 16, seed_block: int = 128,
                  cand_block: int = 512, exclude_same_text: bool = False, id_col: str = "id", text_col: str = "text",
                  decimals: int | None = None) -> DataFrame:
    """Every document as a seed plus its ``top_k - 1`` best BM25 neighbours.

    Exact: the seed's distinct terms are the query, every other document sharing
    a term is scored.  No (seed, candidate) pair is ever emitted as a row: documents
    are stored once as lists of term numbers and weights, and dealt into a few groups of seeds
    and of candidates, bounded by their postings.  Each pair of groups is one task's work:
    it scores ``seed_block`` seeds with ``cand_block`` candidates at a time (``SEED_STEP``
    and ``CAND_STEP``, if more), common terms by a matrix product and rare ones by their postings, and only its top ``top_k - 1`` per
    seed leaves it.  The final merge is a ``row_number`` window per seed.  Where more than ``WAVE_POSTINGS`` would be
    sent, the groups of candidates go in waves, so disk grows with the postings and not with their square.
    Output: neighbours(seed, rank, docid, score).
    """
    spark = index.tf.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = index.tf.schema["doc_id"].dataType.simpleString()
    # The commonest terms have the least numbers, which are short once compressed.
    numbered = with_global_index(index.terms.select("term", "idf", (-F.col("df")).alias("low")), ["low", "term"], "t")
    post = index.tf.join(numbered.select("term", "idf", F.col("t").cast("int").alias("t")), "term")
    docs = post.select(F.col("doc_id").alias("i"), F.struct("t", index.weight().alias("w")).alias("p"))
    docs = docs.groupBy("i").agg(F.array_sort(F.collect_list("p")).alias("p"))
    docs = docs.select("i", F.col("p.t").alias("terms"), F.col("p.w").alias("weights"))
    seed_cols, cand_cols = ["i", "terms"], ["i", "terms", "weights"]
    if exclude_same_text:
        if corpus is None:
            raise ValueError("exclude_same_text needs the corpus")
        hashes = corpus.groupBy(F.col(id_col).alias("i")).agg(F.max(F.xxhash64(text_col)).alias("h"))
        stray = F.raise_error(F.concat(F.lit("no text of document "), F.col("i").cast("string")))
        docs = docs.join(hashes, "i", "left").withColumn("h", F.when(F.col("h").isNull(), stray.cast("bigint")).otherwise(F.col("h")))
        seed_cols, cand_cols = [*seed_cols, "h"], [*cand_cols, "h"]
    docs = materialize_table(docs, "bm25_packed")
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    s_groups, c_groups = _neighbour_groups(size["n"], size["postings"], parts)
    dealt = lambda n, seed: F.pmod(F.xxhash64(F.col("i"), F.lit(seed)), F.lit(n)).cast("int")
    seeds = docs.select(dealt(s_groups, 3).alias("qg"), *seed_cols)
    cands = docs.select(dealt(c_groups, 7).alias("dg"), *cand_cols)
    scorer = _neighbour_scorer(top_k - 1, decimals, exclude_same_text, seed_block, cand_block)
    w = Window.partitionBy("seed").orderBy(F.col("score").desc(), F.col("docid").asc())

    def best(first: int, n: int) -> DataFrame:
        """The neighbours among ``n`` groups of candidates from ``first`` on."""
        met = seeds.withColumn("dg", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))))
        local = meet_groups(met, cands.where(F.col("dg").between(first, first + n - 1)), n, s_groups, scorer, f"seed {kind}, docid {kind}, score double")
        return local.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top_k - 1).select("seed", "rank", "docid", "score")

    sent = size["postings"] + s_groups * size["postings"] // c_groups  # by one group of candidates
    step = max(1, min(c_groups, WAVE_POSTINGS // max(1, sent)))
    if step == c_groups:
        return best(0, c_groups)
    waves = [materialize_table(best(first, min(step, c_groups - first)), "bm25_wave") for first in range(0, c_groups, step)]
    local = functools.reduce(DataFrame.unionByName, waves).drop("rank")
    return (local.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top_k - 1)
            .select("seed", "rank", "docid", "score"))


def neighbour_batches(neighbours: DataFrame, seeds: DataFrame, src_col: str = "source") -> DataFrame:
    """B4 as batches(batch_id, src, doc_ids): [seed] + neighbours in rank order; src of the seed."""
    g = neighbours.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("rank", "docid"))).alias("n"))
    s = seeds.select(F.col("id").alias("seed"), F.col(src_col).alias("src"))
    return s.join(g, "seed", "left").select(
        F.col("seed").alias("batch_id"), "src",
        F.concat(F.array("seed"), F.coalesce(F.transform("n", lambda x: x["docid"]), F.array().cast(f"array<{seeds.schema['id'].dataType.simpleString()}>")))
        .alias("doc_ids"))
