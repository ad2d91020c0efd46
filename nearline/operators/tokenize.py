"""Vocabulary, tokenization and training views as corpus jobs.

Rows are tokenized one by one: a vocabulary of checked size is looked up inside
the tasks; of a larger one the commonest words are, and only the others are joined and
put back by stored row.  A user
tokenizer (``Tokenizer`` protocol) runs over Arrow batches instead.
"""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearline.functions import tokens as TK
from nearline.functions.text import WORD_PATTERN, words
from nearline.operators.indexing import with_global_index, with_row_key

# Special tokens and their ids.
SPECIALS = ("<pad>", "<s>", "</s>", "<unk>")
PAD_ID, BOS_ID, EOS_ID, UNK_ID = 0, 1, 2, 3


class Tokenizer(Protocol):
    def encode(self, texts: list[str]) -> list[list[int]]: ...


def fit_vocab(corpus: DataFrame, text_col: str = "text", max_size: int | None = None, min_df: int = 1,
              specials=SPECIALS) -> DataFrame:
    """K1: vocab(term, term_id, cf, df); specials first, then by cf desc, term asc.

    df counts rows, whatever their ids; one exchange, of sums by term.
    """
    own = words(F.col(text_col))
    marks = F.concat(F.transform(own, lambda w: F.struct(w.alias("term"), F.lit(1).alias("cf"), F.lit(0).alias("df"))),
                     F.transform(F.array_distinct(own), lambda w: F.struct(w.alias("term"), F.lit(0).alias("cf"), F.lit(1).alias("df"))))
    stats = corpus.select(F.inline(marks)).groupBy("term").agg(F.sum("cf").cast("bigint").alias("cf"), F.sum("df").cast("bigint").alias("df"))
    if min_df > 1:
        stats = stats.where(F.col("df") >= min_df)
    ranked = with_global_index(stats, [F.col("cf").desc(), F.col("term").asc()], "_i")
    if max_size is not None:
        ranked = ranked.where(F.col("_i") < max_size - len(specials))
    terms = ranked.select("term", (F.col("_i") + len(specials)).cast("bigint").alias("term_id"), "cf", "df")
    sp = corpus.sparkSession.createDataFrame([(t, i, 0, 0) for i, t in enumerate(specials)],
                                             "term string, term_id bigint, cf bigint, df bigint")
    return sp.unionByName(terms)


#: A vocabulary is looked up in each task up to so many bytes of terms; the words of the rest are joined.
LOOKUP_BYTES = 64 << 20
#: Ids that are counted together where a vocabulary is cut, and the mark of a word not looked up.
ID_RANGE, MISSING = 4096, -(1 << 31)


def tokenize(df: DataFrame, vocab: DataFrame, text_col: str = "text", add_bos: bool = True, out: str = "input_ids",
             lookup_bytes: int | None = None) -> DataFrame:
    """K2: word ids in text order ([BOS] first), unknown words -> UNK; a null text has no words.

    Every row is tokenized by itself, whatever its id.  A vocabulary of at most
    ``lookup_bytes`` bytes (counted first) is sent to the tasks and looked up there,
    without an exchange; of a larger one the least ids, the commonest words, that fit are
    looked up, and only the other words are joined and go back to their stored row.
    """
    lookup_bytes = LOOKUP_BYTES if lookup_bytes is None else lookup_bytes
    v = vocab.select("term", F.col("term_id").cast("int").alias("term_id"))
    size = v.agg(F.sum(F.octet_length("term") + 12)).first()[0] or 0
    body = F.coalesce(words(F.col(text_col)), F.expr("cast(array() as array<string>)"))
    res = _looked_up(df, v, body) if size <= lookup_bytes else _joined(df, v, body, lookup_bytes)
    full = F.concat(F.array(F.lit(BOS_ID)), F.col("_nl_ids")) if add_bos else F.col("_nl_ids")
    return res.withColumn(out, full).drop("_nl_ids")


def _looked_up(df: DataFrame, vocab: DataFrame, body: Column, unknown: int = UNK_ID) -> DataFrame:
    rows = vocab.toArrow()
    bc = df.sparkSession.sparkContext.broadcast((rows.column("term").combine_chunks(), rows.column("term_id").to_numpy()))

    @F.arrow_udf("array<int>")
    def ids(lists: pa.Array) -> pa.Array:
        terms, numbers = bc.value
        coded = lists.flatten().dictionary_encode()
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=terms), -1).to_numpy(zero_copy_only=False)
        known = np.append(numbers, unknown)[at].astype(np.int32)  # -1: the last
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(known[code] if len(code) else code, pa.int32()))

    return df.withColumn("_nl_ids", ids(body))


def _head_end(vocab: DataFrame, lookup_bytes: int) -> int:
    """The id below which the terms fit ``lookup_bytes``; one sum for ``ID_RANGE`` ids reaches the driver."""
    sums = vocab.groupBy(F.floor(F.col("term_id") / ID_RANGE).alias("r")).agg(F.sum(F.octet_length("term") + 12).alias("n"))
    end, held = MISSING, 0
    for r in sorted(sums.collect()):
        held += r["n"]
        if held > lookup_bytes:
            break
        end = (r["r"] + 1) * ID_RANGE
    return end


def _joined(df: DataFrame, vocab: DataFrame, body: Column, lookup_bytes: int) -> DataFrame:
    end = _head_end(vocab, lookup_bytes)
    rows = _looked_up(df.withColumn("_nl_words", body), vocab.where(F.col("term_id") < end), F.col("_nl_words"), MISSING)
    missing = F.filter("_nl_words", lambda w, i: F.element_at("_nl_ids", i + 1) == MISSING)
    rows = with_row_key(rows.withColumn("_nl_missing", missing).drop("_nl_words"))
    terms = rows.select("_nl_row", F.posexplode("_nl_missing").alias("p", "term")).join(vocab.where(F.col("term_id") >= end), "term", "left")
    found = terms.groupBy("_nl_row").agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("term_id", F.lit(UNK_ID)).alias("t")))).alias("_nl_s"))
    found = found.select("_nl_row", F.transform("_nl_s", lambda s: s["t"]).alias("_nl_found"))

    @F.arrow_udf("array<int>")
    def filled(ids: pa.Array, found: pa.Array) -> pa.Array:
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        flat[flat == MISSING] = found.flatten().to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, pa.int32()))

    rows = rows.drop("_nl_missing").join(found, "_nl_row", "left")
    return rows.withColumn("_nl_ids", filled("_nl_ids", "_nl_found")).drop("_nl_row", "_nl_found")


#: Text that a user tokenizer gets at once.
ENCODE_BYTES = 256 << 10


def _pieces(texts: pa.Array, most: int):
    """(start, rows) of runs of texts of about ``most`` bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi - lo
        lo = hi


def tokenize_with(df: DataFrame, tokenizer_factory, text_col: str = "text", out: str = "input_ids") -> DataFrame:
    """K2 with a user tokenizer, loaded once per task and fed pieces of Arrow batches."""
    schema = T.StructType([*[f for f in df.schema if f.name != out], T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches):
        tok = tokenizer_factory()
        for batch in batches:
            kept = [c for c in batch.schema.names if c != out]
            for start, n in _pieces(batch.column(text_col), ENCODE_BYTES):  # Python objects of one piece at a time
                part = batch.slice(start, n)
                ids = pa.array(tok.encode([t or "" for t in part.column(text_col).to_pylist()]), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], ids], names=[*kept, out])

    return df.mapInArrow(run, schema)


class HashTokenizer:
    """A ``Tokenizer`` without a vocabulary: words of two or more characters by md5, into ``size`` ids after the specials."""

    def __init__(self, size: int = 30_000):
        import regex

        self.size = size
        self._re = regex.compile(WORD_PATTERN)

    def encode(self, texts: list[str]) -> list[list[int]]:
        number = lambda w: int(hashlib.md5(w.encode("utf-8")).hexdigest()[:8], 16) % self.size + len(SPECIALS)
        return [[number(w) for w in self._re.findall(t.lower())] for t in texts]


def prefix_ids(spark, vocab: DataFrame, prefix: str):
    """Token ids of a fixed prefix string, as a scalar-subquery array column."""
    pw = spark.createDataFrame([(prefix,)], "t string").select(F.posexplode(words(F.col("t"))).alias("p", "term"))
    j = pw.join(vocab.select("term", "term_id"), "term", "left").select(
        "p", F.coalesce("term_id", F.lit(UNK_ID)).cast("int").alias("t"))
    return j.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda s: s["t"])
                 .alias("ids")).scalar()


def _prefix_splits(prefix: str) -> bool:
    """True when tokenizing prefix + text equals tokens(prefix) + tokens(text)."""
    import regex
    return not prefix or not regex.match(r"[\p{L}\p{N}_]", prefix[-1])


def pad_longest(df: DataFrame, ids: str, batch: str, pad_id: int, multiple: int | None = 16,
                out: str | None = None) -> DataFrame:
    """K5: pad to the longest sequence of the batch, rounded up to ``multiple``."""
    w = Window.partitionBy(batch)
    longest = F.max(F.size(ids)).over(w)
    L = (F.ceil(longest / F.lit(multiple)) * multiple).cast("int") if multiple else longest
    return df.withColumn(out or ids, TK.pad_to(ids, L, pad_id))


def training_views(members: DataFrame, vocab: DataFrame, max_len: int = 128, append_eos: bool = True,
                   multiple: int = 16, passage_prefix: str = "passage: ", query_prefix: str = "query: ",
                   add_passage_prefix: bool = True, add_query_prefix: bool = True, first_half_on: bool = True,
                   ratio: float = 0.5, excluded_src=("stackoverflow",), pad_id: int = EOS_ID,
                   eos_id: int = EOS_ID) -> DataFrame:
    """Passage, LM and query views of every batch member, aligned in one row.

    ``members(batch_id, src, pos, doc_id, text)``.  The first-half query view is
    decided per batch by its ``src`` (P5).  ``pad_id`` defaults to EOS, as in
    the reference setup, so the LM labels mask EOS ids too (K7).
    """
    from nearline.functions.text import add_prefix, first_half_applies

    L = TK.round_up(max_len, multiple)
    spark = members.sparkSession
    m = tokenize(members, vocab, "text", out="_lm_raw")
    body = F.slice("_lm_raw", 2, F.size("_lm_raw"))
    for name, prefix, on in (("_p_raw", passage_prefix, add_passage_prefix), ("_q_raw", query_prefix, add_query_prefix)):
        if not on:
            m = m.withColumn(name, F.col("_lm_raw"))
        elif _prefix_splits(prefix):
            # Word tokens of prefix + text are the prefix's tokens followed by the text's.
            m = m.withColumn(name, F.concat(F.array(F.lit(BOS_ID)), prefix_ids(spark, vocab, prefix), body))
        else:
            m = tokenize(m.withColumn("_t", add_prefix("text", prefix)), vocab, "_t", out=name).drop("_t")
    p = TK.truncate_append_eos("_p_raw", max_len, append_eos, eos_id)
    lm = F.slice("_lm_raw", 1, max_len - 1 if append_eos else max_len)
    q = TK.truncate_append_eos("_q_raw", max_len, append_eos, eos_id)
    m = m.withColumn("_p", p).withColumn("_lm", lm).withColumn("_q", q)
    applies = first_half_applies("src", excluded_src) if first_half_on else F.lit(False)
    q_final = F.when(applies, TK.first_half("_q", eos_id, ratio)).otherwise(F.col("_q"))
    out = m.select(
        "batch_id", "src", "pos", "doc_id",
        TK.pad_to("_p", L, pad_id).alias("p_input_ids"),
        TK.attention_mask(F.size("_p"), L).alias("p_attention_mask"),
        TK.pad_to("_lm", L, pad_id).alias("lm_input_ids"),
        TK.attention_mask(F.size("_lm"), L).alias("lm_attention_mask"),
        TK.lm_labels(TK.pad_to("_lm", L, pad_id), pad_id).alias("lm_labels"),
        TK.pad_to(q_final, L, pad_id).alias("q_input_ids"),
        TK.attention_mask(F.size(q_final), L).alias("q_attention_mask"),
        F.when(applies, TK.first_half_mask("_q", eos_id, L, ratio)).alias("first_half_mask"),
    )
    return out


def next_token_pairs(df: DataFrame, ids: str = "input_ids", labels: str = "labels", id_col: str = "id",
                     ignore: int = TK.IGNORE) -> DataFrame:
    """(id, pos, input_id, target) where position t predicts label t+1; -100 dropped."""
    n = F.size(ids) - 1
    z = F.arrays_zip(F.slice(ids, 1, n).alias("x"), F.slice(labels, 2, n).alias("y"))
    e = df.select(F.col(id_col).alias("id"), F.posexplode(z).alias("pos", "p"))
    return (e.select("id", F.col("pos").cast("int").alias("pos"), F.col("p.x").alias("input_id"),
                     F.col("p.y").alias("target"))
            .where(F.col("target") != ignore))

