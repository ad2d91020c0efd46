"""Language ID sends each text to the tasks once."""

from pyspark.sql import functions as F

from nearline.llm import language_bits as L


def test_text_is_sent_once(spark):
    docs = spark.createDataFrame([(i, "de" if i % 2 else "en", ("über das größte Haus " if i % 2 else "all of the large houses ") * 5) for i in range(60)],
                                 "doc_id long, lang string, text string").unionByName(
        spark.createDataFrame([(60, None, None), (61, "en", "123"), (62, None, "")], "doc_id long, lang string, text string"))
    model = L.train(docs)
    out = L.predict(docs, model)
    assert "lang_body" not in out._jdf.queryExecution().analyzed().toString()
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in out.collect()}
    raw = docs.withColumn("text", F.col("text").cast("binary"))
    assert got == {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in L.predict(raw, model).collect()}
    assert got[1][0] == "de" and got[2][0] == "en" and {got[i] for i in (60, 61, 62)} == {("und", 0.0)}
