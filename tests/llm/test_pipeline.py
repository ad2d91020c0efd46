"""Stages of the corpus pipeline, each judged on its own input."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline as P
from nearline.llm import queries

SMALL = "/root/testdata/sf0.001"


def docs(spark):
    return queries.table(spark, SMALL, "documents")


def test_stages_keep_the_columns_of_documents(spark):
    df = docs(spark)
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, df, SMALL).columns == df.columns, name
    assert len(P.STAGES) == 5


def test_language_stage_rejects_only_unknown(spark):
    df = docs(spark).unionByName(docs(spark).limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit("123 ... 99")}))
    left = {r["doc_id"] for r in P.language_id(spark, df, SMALL).select("doc_id").collect()}
    assert -1 not in left and left == {r["doc_id"] for r in docs(spark).select("doc_id").collect()}


def test_language_stage_keeps_short_rare_and_new_words(spark):
    own = docs(spark)
    row = lambda i, text, lang: (i, text, lang, "s", len(text))
    low = [row(9001, "Re.", "en"), row(9002, "A.", "es"), row(9003, "xq zv wk", "en"), row(9004, "kwyjibo frobnicate zxqv", "de"),
           row(9005, "\u6f22\u5b57\u4eee\u540d", None), row(9006, "hau da euskarazko testu bakarra", "eu"), row(9007, "mundu zaharra", "und")]
    bad = [row(9101, "12 34 ... !!", "en"), row(9102, "", "en"), (9103, None, "en", "s", None)]
    df = own.unionByName(spark.createDataFrame(low + bad, own.schema))
    left = {r["doc_id"] for r in P.language_id(spark, df, SMALL).select("doc_id").collect()}
    assert left == {r["doc_id"] for r in own.select("doc_id").collect()} | {r[0] for r in low}
    # es with three learning rows: every held-out text of it stays.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    few = own.withColumn("n", rank).where(queries.held_out() | (F.col("lang") != "es") | (F.col("n") <= 3)).drop("n")
    assert P.language_id(spark, few, SMALL).count() == few.count()
    # No labels at all.
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert P.language_id(spark, unlabelled, SMALL).count() == own.count() + len(low)


def test_dedup_stage_keeps_one_of_each_component(spark):
    df = docs(spark)
    twice = df.unionByName(df.withColumn("doc_id", F.col("doc_id") + 10_000)).unionByName(df.limit(3))
    left = sorted(r["doc_id"] for r in P.simhash_dedup(spark, twice, SMALL).select("doc_id").collect())
    want = sorted({r["component_id"] for r in queries.op5_simhash_dedup(spark, SMALL).collect()})
    assert left == want


def test_dedup_stage_with_repeated_and_missing_ids(spark):
    def text(seed, n=60):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))

    rows = [(1, text(1), "en", "s"), (1, text(2), "en", "s"), (1, text(1), "en", "s"), (2, text(3), "en", "s"), (3, text(3), "en", "s"),
            (3, text(4), "en", "s"), (None, text(5), "en", "s"), (None, text(5), "en", "t"), (None, text(6), "en", "s"),
            (None, text(1), "en", "s"), (4, text(7), "en", None), (4, text(7), None, "en"), (5, text(7), "en", "s"), (None, None, None, "s")]
    rows = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]
    schema = docs(spark).schema
    seen = []
    for order in (rows, rows[::-1], random.Random(1).sample(rows, len(rows))):
        out = P.simhash_dedup(spark, spark.createDataFrame(order, schema).repartition(3), SMALL)
        assert out.columns == schema.names
        seen.append(sorted(map(tuple, out.collect()), key=repr))
    assert seen[0] == seen[1] == seen[2]
    want = [(1, text(1)), (1, text(2)), (2, text(3)), (3, text(4)), (None, text(5)), (None, text(6)), (4, text(7)), (None, None)]
    assert sorted((r[:2] for r in seen[0]), key=repr) == sorted(want, key=repr)
    assert all(r in rows for r in seen[0])


def test_secret_stage_masks(spark):
    out = P.secret_scan(spark, docs(spark), SMALL)
    assert out.count() == docs(spark).count()
    assert out.where(F.col("text").rlike("[0-9a-f]{24,}")).count() == 0
    assert out.where("n_chars <> length(text)").count() == 0


def test_run_covers_every_kept_document(spark):
    out = P.run(spark, SMALL)
    n = len({r["component_id"] for r in queries.op5_simhash_dedup(spark, SMALL).collect()})
    assert out.select("doc_id").distinct().count() == n
    assert out.where("n_tokens <> size(ids)").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_take_empty_and_null_rows(spark, name):
    stage = dict(P.STAGES)[name]
    df = docs(spark)
    assert stage(spark, df.limit(0), SMALL).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0)], df.schema)
    assert stage(spark, nulls, SMALL).count() <= 6
