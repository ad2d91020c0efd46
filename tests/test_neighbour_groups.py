"""Neighbour batches (B4): documents meet in a few groups; a pair of groups is scored by steps."""

import numpy as np
import pytest

from nearline.operators import lexical as L
from nearline.session import materialize, stored_tables


def _docs(spark, n=90, copies=3):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, size=rng.integers(0, 30)), 400)) for _ in range(n)]
    return spark.createDataFrame([(i, texts[i % (n - copies)]) for i in range(n)], "id bigint, text string")


def _want(docs, index, k, decimals, other_text=False):
    text = {r.id: r.text for r in docs.collect()}
    held = {}
    for r in index.postings.collect():
        held.setdefault(r.doc_id, {})[r.term] = r.w
    out = []
    for s in held:
        scores = [(-round(sum(w for t, w in held[d].items() if t in held[s]), decimals), d) for d in held
                  if d != s and held[d].keys() & held[s].keys() and not (other_text and text[d] == text[s])]
        out += [(s, rank + 1, d, -x) for rank, (x, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("other_text", [False, True])
def test_groups_and_steps_equal_brute_force(spark, monkeypatch, other_text):
    for name, value in {"SEED_POSTINGS": 200, "CAND_POSTINGS": 150, "SEED_STEP": 1, "CAND_STEP": 1, "TERM_SLICE": 3, "RARE_PRODUCTS": 5}.items():
        monkeypatch.setattr(L, name, value)
    docs = _docs(spark)
    index = L.bm25_index(L.analyze(docs))
    got = L.build_batches(index, docs, top_k=6, seed_block=4, cand_block=7, exclude_same_text=other_text, decimals=5).collect()
    want = _want(docs, index, 5, 5, other_text)
    assert sorted(tuple(r)[:3] for r in got) == [w[:3] for w in want]
    assert np.allclose([r.score for r in sorted(got)], [w[3] for w in want], atol=1e-5)


def test_documents_are_sent_to_few_groups(spark):
    """51,282 documents were 401 blocks of seeds, each sent to 201 blocks of candidates."""
    s, c = L._neighbour_groups(51_282, 15_000_000, 24)
    assert s * c >= 24 and 12 * s + 4 * c < 100
    plan = L.build_batches(L.bm25_index(L.analyze(_docs(spark))), seed_block=4, cand_block=4)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "sequence(0, 0" in plan


@pytest.mark.parametrize("step", [1, 1200])
def test_waves_of_candidate_groups_equal_brute_force(spark, monkeypatch, step):
    """Where more would be sent than ``WAVE_POSTINGS``, groups of candidates are sent and stored one after another."""
    for name, value in {"SEED_POSTINGS": 300, "CAND_POSTINGS": 150, "WAVE_POSTINGS": step}.items():
        monkeypatch.setattr(L, name, value)
    docs = _docs(spark)
    index = L.bm25_index(L.analyze(docs))
    with stored_tables(spark) as stored:
        run = L.build_batches(index, docs, top_k=6, exclude_same_text=True, decimals=5)
        assert sum("bm25_wave" in path for path in stored) > 1
        assert "FlatMapCoGroupsInArrow" not in run._jdf.queryExecution().toString()
        got = run.collect()
    want = _want(docs, index, 5, 5, True)
    assert sorted(tuple(r)[:3] for r in got) == [w[:3] for w in want]


def test_stored_tables_leave_no_shuffle_files(spark):
    local = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffled = lambda: local.getAllFiles().mkString(" ").count("shuffle_")
    before = shuffled()
    materialize(spark.range(1000).repartition(5, "id"), "no_shuffle")
    assert shuffled() <= before
    spark.range(1000).repartition(5, "id").write.mode("overwrite").format("noop").save()
    assert shuffled() > before  # what is not stored is left to Spark
