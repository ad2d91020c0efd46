"""A term is hashed and a vector's norm is taken once; a stream reads its arrivals in as many micro-batches as folders."""

import os

from pyspark.sql import functions as F

from nearline.functions.vectors import l2_normalize
from nearline.operators import encode as E
from nearline.operators import lexical as L
from nearline.plans.q_streaming import t1_stream_encode_append
from nearline.session import scratch_path
from nearline.streaming import jobs as T


def test_terms_are_hashed_where_they_are_stored(spark):
    idx = L.bm25_index(L.analyze(spark.createDataFrame([(0, "red green red"), (1, "blue green")], "id bigint, text string")))
    plan = E.hashing_encode_index(idx, dim=4)._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    above = plan[:plan.index(join)]
    assert "md5" in plan and "md5" not in above


def test_norm_is_taken_once(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,), ([1.0, None],)]
    df = spark.createDataFrame(rows, "v array<double>").coalesce(1)
    got = [r[0] for r in df.select(l2_normalize("v")).collect()]
    assert got[:4] == [[0.6, 0.8], [0.0, 0.0], [], None] and got[4][1] is None
    # Parts of the vector that are costly to make are made once.
    plan = df.select(l2_normalize(F.transform("v", lambda x: F.round(x, 3))).alias("u"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("round(") == 1


def test_micro_batches_are_arrivals(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text")).repartition(6)
    src, sink, ckpt = (scratch_path(spark, n) for n in ("src", "sink", "ckpt"))
    files = T.split_files(docs, "doc_id", 4, src)
    assert files == 6
    T.stream_encode_append(spark, f"{src}/part*", docs.schema, lambda df: df, sink, ckpt, max_files_per_trigger=files)
    assert spark.read.parquet(sink).count() == 400
    assert len([f for f in os.listdir(sink.replace("file:", "", 1)) if f.startswith("epoch=")]) == 4


def test_query_has_four_micro_batches(spark, tmp_path, monkeypatch):
    texts = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id")).alias("text"))
    texts.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    whole = T.stream_encode_append

    def watched(spark, source, schema, encode_fn, sink, *args, **kw):
        whole(spark, source, schema, encode_fn, sink, *args, **kw)
        seen.append(len([f for f in os.listdir(sink.replace("file:", "", 1)) if f.startswith("epoch=")]))

    monkeypatch.setattr(T, "stream_encode_append", watched)
    assert t1_stream_encode_append(spark, str(tmp_path)).count() == 40
    assert seen[0] <= 4
