"""Accuracy of the trained operators on rows that they never learned from."""

import random
import re

import pytest
from pyspark.sql import functions as F

from nearline.llm import language_bits, quality_crf, queries, secret_markov
from tests.conftest import MEDIUM
from tests.llm.test_llm_operators import make

TENTH = "/root/testdata/sf0.1"


def docs_of(spark, sf_dir):
    return queries.table(spark, sf_dir, "documents")


def test_language_held_out(spark):
    """Every fifth document, by the hash of its id, is held out; the rest teaches."""
    out = queries.op2_language_id(spark, MEDIUM).join(docs_of(spark, MEDIUM).select("doc_id", "lang"), "doc_id")
    row = out.where("held_out and lang_pred <> 'und' and lang is not null").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first()
    assert row.n > 150 and row.a >= 0.98


def test_language_filter_grows_with_its_languages(spark):
    """No language loses typical n-grams: the filter is sized for the largest."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(9))
    rows = [(i, " ".join(word() for _ in range(60)), "big" if i % 10 else "small", "s") for i in range(300)]
    model = language_bits.train(make(spark, rows), least_count=1, slots=1 << 8)
    assert model.size() > 1 << 15 and (model.false_positives() < 0.05).all()
    seen = language_bits.predict(make(spark, rows), model).where("lang_pred <> lang").count()
    assert seen == 0
    odd = make(spark, rows[:20]).withColumns({"__lang_body": F.lit(1), "__lang_letters": F.lit(2), "lang_score": F.lit(3)})
    kept = language_bits.predict(odd, model)
    assert kept.where("__lang_body = 1 and __lang_letters = 2 and lang_score <= 1").count() == 20


def test_quality_held_out(spark):
    """A quarter of the labels is held out; verdicts of documents that pass the base rules."""
    docs, labels = docs_of(spark, TENTH), queries.table(spark, TENTH, "labels")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 0
    model = quality_crf.train(docs, labels.where(~held))
    out = (quality_crf.assess(docs.join(labels.where(held).select("doc_id"), "doc_id", "left_semi"), model)
           .where("not base_failed").join(labels.select("doc_id", "quality"), "doc_id"))
    got = {(r["quality"], r["kept"]): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    good, bad = got.get((1, True), 0) + got.get((1, False), 0), got.get((0, True), 0) + got.get((0, False), 0)
    assert good > 500 and bad > 30
    assert got.get((1, True), 0) >= 0.98 * good and got.get((0, False), 0) >= 0.9 * bad


@pytest.fixture(scope="module")
def secret_model(spark):
    return secret_markov.train(docs_of(spark, MEDIUM))


def test_secret_recall_by_alphabet(spark, secret_model):
    assert set(secret_model.recall) == set(secret_markov.RANDOM) and min(secret_model.recall.values()) >= 0.9
    assert secret_model.false_positives <= 0.001
    rng = random.Random(8)  # strings from another generator than the training's
    rows = [(kind, "".join(rng.choice(letters) for _ in range(rng.randint(20, 40)))) for kind, letters in secret_markov.RANDOM.items() for _ in range(300)]
    df = spark.createDataFrame(rows, "kind string, token string")
    share = df.groupBy("kind").agg(F.avg((secret_model.score(F.col("token")) > secret_model.threshold).cast("double")).alias("s")).collect()
    assert min(r.s for r in share) >= 0.9, share
    plain = ["-" * 40, "_" * 25, "+-" * 15, "/" * 30, "K" * 30, "2024-03-17-12-45-10-0001", "12345678901234567890", "0" * 32, "en_the_of_and_is_with_that_this",
             "thanTheOfAndWithThatThis", "docs/the/of/and/with/that/index"]
    scored = {r.value: r.s for r in spark.createDataFrame([(p,) for p in plain], "value string").withColumn("s", secret_model.score(F.col("value"))).collect()}
    assert not [p for p, s in scored.items() if s > secret_model.threshold], scored


def test_added_spans_equal_brute_force(spark, secret_model):
    """The model's spans: runs of token characters above the threshold that touch no fixed span, scored in Python."""
    letters = secret_markov.ALPHABET
    n = len(letters)

    def score(token):
        at = [letters.index(c) for c in token]
        sums = [sum(secret_model.ratios[t * n * n + a * n + b] for a, b in zip(at, at[1:])) for t in range(len(secret_markov.RANDOM))]
        return max(sums) / (len(token) - 1)

    rng = random.Random(3)
    rand = lambda kind, k: "".join(rng.choice(secret_markov.RANDOM[kind]) for _ in range(k))
    texts = [f"see {rand('base62', 32)} and {rand('upper_hex', 40)}, {rand('hex', 30)} é token={rand('base62', 24)} {rand('lower_digits', 22)}.",
             "nothing_at_all_but_some_words here", f"{rand('base64url', 300)}", f"🙂 {rand('base32', 20)} {rand('base64', 20)}=", None, "", "-" * 80]
    texts += [f"w{i} {rand(rng.choice(list(secret_markov.RANDOM)), rng.randint(15, 30))} the_of_and_with_that" for i in range(60)]
    for r in secret_markov.scan(make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), secret_model).collect():
        spans = [(s["start"], s["end"]) for s in r["secret_spans"] if s["kind"] < 3]
        want = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9_+/-]{20,}", r["text"] or "")
                if score(m[0]) > secret_model.threshold and not any(a < m.end() and m.start() < b for a, b in spans)]
        assert [(s["start"], s["end"]) for s in r["secret_spans"] if s["kind"] == 3] == want
