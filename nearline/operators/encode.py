"""Encoding text to vectors and pooling.

``encode`` runs any ``Encoder`` (loaded once per task by a factory) over Arrow
batches with ``mapInPandas``; ids travel with their vectors, so order and the
last partial batch need no special care.  The built-in offline encoder is
signed feature hashing of analyzed terms weighted by corpus idf and
L2-normalised; it is written with Spark expressions and joins, so it runs
JVM-side and has an SQL equivalent.
"""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearline.functions.hashing import hex8
from nearline.functions.text import WS_CLASS, add_prefix
from nearline.functions.vectors import l2_normalize
from nearline.operators.indexing import with_row_key
from nearline.operators.lexical import BM25Index, analyze_col, ENGLISH_STOPWORDS


class Encoder(Protocol):
    """Anything with a dimension and a batch ``encode``."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


def encode(df: DataFrame, encoder_factory, is_query: bool = False, id_col: str = "id", text_col: str = "text",
           query_prefix: str = "query: ", passage_prefix: str = "passage: ", add_prefix_on: bool = True,
           batch_size: int = 128, out_type: str = "array<float>", query_max_len: int | None = 32,
           passage_max_len: int | None = 128) -> DataFrame:
    """(id, rep) for every row; the prefix, length and encoder depend on ``is_query``.

    A text keeps its first ``query_max_len`` or ``passage_max_len`` words, those of
    the prefix included (None: the whole text).  A null text is encoded as empty, without prefix.
    ``encoder_factory`` is called once per task (load a model there).
    """
    prefix, longest = (query_prefix, query_max_len) if is_query else (passage_prefix, passage_max_len)
    text = add_prefix(text_col, prefix) if add_prefix_on else F.col(text_col)
    if longest is not None:
        # White space before a kept word stays, so a short text is unchanged.
        text = F.regexp_extract(text, f"^(?:{WS_CLASS}*[^\\t\\n\\x0B\\f\\r ]+){{0,{int(longest)}}}", 0)
    src = df.select(F.col(id_col).alias("id"), text.alias("_t"))

    def run(it):
        enc = encoder_factory()
        for pdf in it:
            texts = pdf["_t"].fillna("").tolist()
            vecs = []
            for s in range(0, len(texts), batch_size):
                vecs.append(np.asarray(enc.encode(texts[s:s + batch_size]), dtype=np.float64))
            mat = np.concatenate(vecs) if vecs else np.zeros((0, enc.dim))
            yield pd.DataFrame({"id": pdf["id"], "rep": list(mat)})

    return src.mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, rep {out_type}")


def encode_untied(queries: DataFrame, corpus: DataFrame, query_encoder_factory, passage_encoder_factory,
                  **kw) -> tuple[DataFrame, DataFrame]:
    """Separate query and passage encoders."""
    return (encode(queries, query_encoder_factory, is_query=True, **kw),
            encode(corpus, passage_encoder_factory, is_query=False, **kw))


# ---------------------------------------------------------------- hashing encoder

def term_bucket(term: Column, dim: int) -> Column:
    return F.pmod(hex8(F.md5(term)), F.lit(dim)).cast("int")


def term_sign(term: Column) -> Column:
    return F.when(F.pmod(hex8(F.substring(F.md5(term), 9, 8)), F.lit(2)) == 0, 1.0).otherwise(-1.0)


def hashing_encode(df: DataFrame, index: BM25Index, dim: int = 64, is_query: bool = False, binary: bool = False,
                   id_col: str = "id", text_col: str = "text", prefix: str | None = None,
                   max_terms: int | None = None, stopwords=ENGLISH_STOPWORDS) -> DataFrame:
    """Built-in encoder: sum of sign(t) * weight(t) into bucket(t), L2-normalised.

    weight = tf * idf (passages) or idf per distinct term (``binary``, the usual
    query side); terms absent from the index vocabulary are ignored.
    ``max_terms`` keeps the first terms only (query/passage max length, E2).
    """
    text = add_prefix(text_col, prefix) if prefix else F.col(text_col)
    terms = analyze_col(text, stopwords)
    if max_terms:
        terms = F.slice(terms, 1, int(max_terms))
    if binary:
        terms = F.array_distinct(terms)
    base = with_row_key(df.select(F.col(id_col).alias("id"), terms.alias("_terms")))
    tf = base.select("_nl_row", F.explode("_terms").alias("term")).groupBy("_nl_row", "term").agg(
        F.count(F.lit(1)).alias("tf"))
    return (base.select("id", "_nl_row").join(_hashed(tf, index, "_nl_row", dim), "_nl_row", "left")
            .select("id", l2_normalize(_dense(dim)).alias("rep")))


def _hashed(tf: DataFrame, index: BM25Index, key: str, dim: int) -> DataFrame:
    """(key, _m): bucket -> summed signed weight of rows (key, term, tf); a term is hashed once, where it is stored.

    Weights are rounded to 1e-9 and summed as integers, so the sum does not
    depend on the order of rows, and terms that cancel leave a plain zero.
    """
    term = F.col("term")
    terms = index.terms.select("term", term_bucket(term, dim).alias("bucket"), (term_sign(term) * F.col("idf")).alias("x"))
    w = tf.join(terms, "term").select(key, "bucket", F.floor(F.col("tf") * F.col("x") * 1e9 + 0.5).cast("bigint").alias("v"))
    b = w.groupBy(key, "bucket").agg(F.sum("v").alias("v"))
    return b.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "v"))).alias("_m"))


def _dense(dim: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                       lambda i: F.coalesce(F.element_at(F.col("_m"), i), F.lit(0)).cast("double") / 1e9)


def md5_term_ids(docs: DataFrame, size: int) -> DataFrame:
    """(id, terms ARRAY<INT>) of ``docs(id, terms)``: the first 8 hex digits of a term's md5, modulo ``size``.

    A term is hashed once for each batch of documents.
    """
    def run(batches):
        for b in batches:
            terms = b.column(1)
            coded = terms.flatten().dictionary_encode()
            known = [None if t is None else int(hashlib.md5(t.encode("utf-8")).hexdigest()[:8], 16) % size for t in coded.dictionary.to_pylist()]
            at = pa.array(known, pa.int32()).take(coded.indices)
            sizes = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, at)], ["id", "terms"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "terms").mapInArrow(run, f"id {kind}, terms array<int>")


def hashing_encode_index(index: BM25Index, dim: int = 64) -> DataFrame:
    """Hashing encoder of the indexed corpus itself, read off the stored postings
    (tf) instead of analysing the text again; equals ``hashing_encode`` on it."""
    return (index.docs.select("doc_id").join(_hashed(index.tf, index, "doc_id", dim), "doc_id", "left")
            .select(F.col("doc_id").alias("id"), l2_normalize(_dense(dim)).alias("rep")))


class HashingEncoder:
    """numpy form of the hashing encoder (tf weights, no idf) for the ``encode`` path."""

    def __init__(self, dim: int = 64, stopwords=ENGLISH_STOPWORDS):
        import regex

        self.dim = dim
        self._re = regex.compile(r"[\p{L}\p{N}_]{2,}")
        self._stop = set(stopwords)

    def _hash(self, term: str):
        h = hashlib.md5(term.encode("utf-8")).hexdigest()
        return int(h[:8], 16) % self.dim, (1.0 if int(h[8:16], 16) % 2 == 0 else -1.0)

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for r, t in enumerate(texts):
            for term in self._re.findall(t.lower()):
                if term in self._stop:
                    continue
                b, s = self._hash(term)
                out[r, b] += s
        n = np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return out / n


# ---------------------------------------------------------------- pooling

def pool_first(h) -> Column:
    """E4 (cls/first): the first token's vector."""
    return F.element_at(F.col(h) if isinstance(h, str) else h, 1)


def pool_mean(h, mask) -> Column:
    """E5 (mean/avg/average): masked mean; null when the mask is empty."""
    hc = F.col(h) if isinstance(h, str) else h
    mc = F.col(mask) if isinstance(mask, str) else mask
    n = F.aggregate(mc, F.lit(0), lambda acc, x: acc + x)
    dim = F.size(F.element_at(hc, 1))
    sums = F.transform(F.sequence(F.lit(0), dim - 1), lambda d: F.aggregate(
        F.zip_with(hc, mc, lambda v, m: v[d] * m.cast("double")), F.lit(0.0).cast("double"), lambda a, x: a + x))
    return F.when(n > 0, F.transform(sums, lambda s: s / n))


def pool_last(h, mask) -> Column:
    """E6 (last/eos): vector at position sum(mask) (right padding); null for an empty mask."""
    hc = F.col(h) if isinstance(h, str) else h
    mc = F.col(mask) if isinstance(mask, str) else mask
    n = F.aggregate(mc, F.lit(0), lambda acc, x: acc + x)
    return F.when(n > 0, F.element_at(hc, n))


POOLERS = {"cls": "first", "first": "first", "mean": "mean", "avg": "mean", "average": "mean",
           "last": "last", "eos": "last"}


def pool(h, mask, method: str = "cls", normalize: bool = False) -> Column:
    """Pooling by name; unknown names raise."""
    kind = POOLERS.get(method)
    if kind is None:
        raise ValueError(f"Unknown pooling method: {method}")
    col = {"first": lambda: pool_first(h), "mean": lambda: pool_mean(h, mask), "last": lambda: pool_last(h, mask)}[kind]()
    return l2_normalize(col) if normalize else col


def splade_pool(token_logits: DataFrame, id_col: str = "id", mask_col: str | None = "mask") -> DataFrame:
    """Per (id, term_id): max over positions of log(1 + relu(logit)) * mask; zeros dropped."""
    x = F.log1p(F.greatest(F.col("logit"), F.lit(0.0)))
    if mask_col and mask_col in token_logits.columns:
        x = x * F.col(mask_col)
    g = token_logits.groupBy(F.col(id_col).alias("id"), "term_id").agg(F.max(x).alias("weight"))
    return g.where(F.col("weight") > 0)


def unicoil_pool(token_weights: DataFrame, disabled=(0, 101, 102, 103), id_col: str = "id") -> DataFrame:
    """Per (id, term_id): max relu(weight), disabled ids zero; zeros dropped."""
    t = token_weights.where(~F.col("term_id").isin(list(disabled)))
    g = t.groupBy(F.col(id_col).alias("id"), "term_id").agg(F.max(F.greatest(F.col("weight"), F.lit(0.0))).alias("weight"))
    return g.where(F.col("weight") > 0)
