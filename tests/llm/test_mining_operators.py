"""Licence scan, hard negatives and collocations against brute force, and their edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearline.llm import arrowwords, license_index, phrase_parsing, segment_negatives
from tests.llm.test_llm_operators import CLASHES, edge_rows, make

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# ---------------------------------------------------------------- licence scan

def license_rows():
    rng = random.Random(7)
    grant = next(t for t in license_index.TEMPLATES if t.label == "mit" and len(t.words) > 10).text
    prose = lambda n: " ".join(rng.choice(("the", "of", "and", "file", "is", "under", "version", "zeta", "copy", "a")) for _ in range(n))
    texts = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
             "This work is licensed under the GNU General Public License, version 3.", "see the Mit\nlicense and the MIT-License!",
             prose(400) + " " + grant + " " + prose(300) + " Licensed under the Apache License, Version 2.0. " + grant,
             grant.replace("free of charge", "free of any charge"), " ".join(grant.split()[4:]), "mit", "license mit license",
             "a version 3 of the general public license", prose(50_000) + " under the mit license", "é MIT LICENSE é", "", None, " ... "]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    return rows + [(None, texts[0], "en", "s"), (0, texts[0], "en", "s"), (0, prose(9), None, None)]


def brute_licenses(rows, model):
    frequency = Counter(w for _, t, *_ in rows for w in set(WORD.findall(ascii_lower(t))) & set(model.names))
    out = []
    for i, text, *_ in rows:
        ws = WORD.findall(ascii_lower(text))
        base = sorted((p, label) for phrase, label in license_index.BASE for p in range(len(ws))
                      if ws[p:p + len(phrase.split())] == phrase.split())
        notices = []
        for number, t in enumerate(model.templates):
            anchors = sorted(set(t.words) & set(ws), key=lambda w: (frequency[w], w))[:model.anchors]
            votes = Counter(p - q for p, w in enumerate(ws) if w in anchors for q, x in enumerate(t.words) if x == w)
            for start, count in votes.items():
                near = all(any(ws[p:p + len(m.split())] == m.split()
                               for p in range(max(0, start + t.text.split(m)[0].count(" ") - model.slack),
                                              start + t.text.split(m)[0].count(" ") + model.slack + 1)) for m in t.mandatory)
                fit = sum(0 <= start + q < len(ws) and ws[start + q] == w for q, w in enumerate(t.words))
                if count >= model.votes and near and fit >= model.share * len(t.words):
                    notices.append((start, number, t.label, fit, len(t.words)))
        out.append((i, len(ws), tuple(base), tuple((x[2], x[0], x[3], x[4]) for x in sorted(notices))))
    return sorted(out, key=repr)


def scanned(df, model):
    return sorted(((r["doc_id"], r["license_scan"]["n_words"], tuple((b["start"], b["label"]) for b in r["license_scan"]["base"]),
                    tuple((x["label"], x["start"], x["in_place"], x["size"]) for x in r["license_scan"]["notices"]))
                   for r in license_index.scan(df, model).collect()), key=repr)


def test_license_scan(spark):
    for rows in (license_rows(), edge_rows()):
        df = make(spark, rows)
        model = license_index.train(df)
        assert scanned(df, model) == brute_licenses(rows, model)
    rows = license_rows()
    model = license_index.train(make(spark, rows))
    labels = {r["doc_id"]: {x["label"] for x in r["license_scan"]["notices"]}
              for r in license_index.scan(make(spark, rows[:8]), model).collect()}
    assert labels[0] == {"mit"} and labels[1] == {"apache-2.0"} and labels[2] == {"cc-by-nc-4.0"} and labels[3] == {"gpl-3.0"}
    assert labels[4] == set() and labels[5] == {"mit", "apache-2.0"} and labels[6] == {"mit"}


def test_license_scan_keeps_columns(spark):
    df = make(spark, license_rows(), clash=True).withColumns({c: F.lit(7) for c in ("c0", "license_scan", "text.a", "start")})
    out = license_index.scan(df, license_index.train(df))
    assert out.columns == [c for c in df.columns if c != "license_scan"] + ["license_scan"]
    assert out.where("license_scan.n_words is null or c0 <> 7 or pack <> 'clash'").count() == 0
    empty = df.limit(0)
    assert license_index.scan(empty, license_index.train(empty)).count() == 0


# ---------------------------------------------------------------- hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def vector_rows(n=400, dim=20, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal(dim)
    x = rng.standard_normal((n, dim)) * 0.7 + centre
    rows = [(i, [float(v) for v in np.float32(x[i])], int(rng.integers(0, 4))) for i in range(n)]
    same = rows[3][1]
    rows += [(1000 + i, same, 1 + i % 2) for i in range(60)]  # ties
    rows += [(None, same, 1), (2000, None, 1), (2001, [None] + same[1:], 1), (2002, [float("nan")] + same[1:], 1),
             (2003, [float("inf")] + same[1:], 1), (2004, same, None), (2005, same[:5], 1), (2006, [], 1), (2007, same[:5], 2),
             (7, rows[7][1], rows[7][2]), (9, rows[11][1], 3)]
    return rows


def brute_negatives(rows, anchor, k=5, m=5, low=80, high=100):
    good = []
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        good.append((i, [int(np.floor(256 * np.float64(np.float32(v)))) for v in x], label))
    out = []
    for i, x, label in {(i, tuple(x), label) for i, x, label in good if anchor(i)}:
        near = [(-sum(a * b for a, b in zip(x, y)), j, l) for j, y, l in good if j != i and len(x) == len(y) and x]
        for s, j, _ in sorted(n for n in near if n[2] == label)[:k]:
            hits = sorted((t, g) for t, g, l in near if l != label and low * -s <= 100 * -t <= high * -s)[:m]
            out += [(i, j, r + 1, g, -s, -t) for r, (t, g) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("dim", [1, 3, 20, 64])
def test_hard_negatives(spark, dim):
    rows = vector_rows(dim=dim) if dim > 5 else [r for r in vector_rows(dim=dim) if r[0] not in (2005, 2007)]
    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({c: F.lit("clash") for c in (*CLASHES, "id", "win", "hit", "low")})
    out = segment_negatives.hard_negatives(df, df.where("vec_id % 9 = 0"))
    assert sorted(tuple(r) for r in out.collect()) == brute_negatives(rows, lambda i: i % 9 == 0)


def test_hard_negatives_windows_and_empty(spark):
    rows = vector_rows(120)
    df = spark.createDataFrame(rows, VECTORS)
    out = segment_negatives.hard_negatives(df, df.where("vec_id < 40"), positives=2, negatives=3, low=-50, high=70)
    assert sorted(tuple(r) for r in out.collect()) == brute_negatives(rows, lambda i: i < 40, 2, 3, -50, 70)
    assert segment_negatives.hard_negatives(df.limit(0), df).count() == 0
    assert segment_negatives.hard_negatives(df, df.limit(0)).count() == 0


def test_anchor_groups_are_not_broadcast(spark):
    df = spark.createDataFrame(vector_rows(120), VECTORS)
    plan = segment_negatives.hard_negatives(df, df.where("vec_id < 40"), cells=30)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [cell" not in plan and "SortMergeJoin [cell" in plan


def test_segment_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    # Vectors whose segments differ in mean, so that summaries say much.
    x = (np.repeat(rng.standard_normal((3000, 16)), 4, axis=1) * 200 + rng.standard_normal((3000, 64)) * 20).astype(np.int64)
    a, ids = x[:50], np.arange(3000)
    sums = segment_negatives.summaries(x)
    low = [np.zeros((50, 3000))] * 3
    for step, (mean, dev) in enumerate(sums):
        middle, apart = mean[:50] @ mean.T, dev[:50] @ dev.T + 1e-3
        score = a @ x.T
        assert (np.abs(score - middle) <= apart).all()
        low[step] = apart
    assert (low[2] <= low[1] + 1e-6).all() and (low[1] <= low[0] + 1e-6).all()
    stats = []
    none, most = np.full((50, 1), segment_negatives.LEAST + 1), np.full((50, 1), segment_negatives.MOST)
    w, i, s = segment_negatives.search(ids[:50], a, ids, x, [(m[:50], d[:50]) for m, d in sums], sums, np.ones((50, 3000), bool), none, most, 5, stats)
    for q in range(50):
        best = sorted((-int(v), j) for j, v in enumerate(score[q]) if j != q)[:5]
        assert [(-int(v), int(j)) for v, j in zip(s[w == q], i[w == q])] == best
    left = stats[0]
    assert left[0] >= left[1] >= left[2] >= left[3] and left[3] < 0.5 * left[0]


# ---------------------------------------------------------------- slices of a batch

def test_slices_of_long_batches():
    """Texts beyond one slice are lower-cased and split as if alone."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(("Mit", "License", "É漢", "x", "under.")) for _ in range(rng.randint(0, 1500))) for _ in range(4000)]
    texts[17] = None
    batch = pa.RecordBatch.from_pydict({"lang": pa.array(["en"] * len(texts)), "text": pa.array(texts)}).slice(3)
    parts = list(arrowwords.slices(batch, "text"))
    assert len(parts) > 1 and sum(p.num_rows for p in parts) == len(texts) - 3
    total = Counter()
    for out in phrase_parsing._parse(32)([batch]):
        for chunk, freq in zip(out.column("chunk").to_pylist(), out.column("freq").to_pylist()):
            total.update({w: freq for w in set(chunk.split(" "))})
    assert set(total) == {"mit", "license", "É漢", "x", "under", "."}
    model = license_index.LicenseModel({w: 1 for w in license_index.vocabulary(license_index.TEMPLATES)})
    got = np.concatenate([license_index._codes(p.column("text"), list(model.names))[0] for p in parts])
    assert got.tolist() == [len(WORD.findall(ascii_lower(t))) for t in texts[3:]]


# ---------------------------------------------------------------- collocations

def brute_collocations(rows, least, longest=5, top=2000, percent=100):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(ws)
            for n in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], a)
        got = []
        for p, a in cand.items():
            if p in inside and 100 * inside[p] >= percent * a:
                continue
            score, k = min((1000 * a * total[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            got.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, l, x, total[lang], -s) for r, (s, a, p, l, x) in enumerate(sorted(got)[:top])]
    return sorted(out)


def collocation_rows():
    rng = random.Random(11)
    vocab = ["w%d" % i for i in range(12)] + ["Été", "A\x1cb", "\x85"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice((" ", " ", " ", "\t ", ", ", ".", "\n")) for _ in range(n))
    hot = text(300)
    rows = [(i, hot, "en", "a") for i in range(40)] + [(100 + i, text(rng.randint(0, 200)), rng.choice(("en", "fr", None)), "b") for i in range(60)]
    return rows + [(None, hot, None, None), (1, None, "en", "a"), (2, "", "en", "a"), (3, " .,;\t\n", "fr", "a"), (4, "same " * 9000, "fr", "a"),
                   (5, text(20_000), "de", "c"), (6, "one", "de", "c"), (7, "x y", "", "c")]


@pytest.mark.parametrize("spread", [1, 3, 32])
def test_collocations(spark, spread):
    rows = collocation_rows()
    out = phrase_parsing.collocations(make(spark, rows, clash=True), least=20, spread=spread)
    assert sorted(tuple(r) for r in out.collect()) == brute_collocations(rows, 20)


def test_collocations_limits(spark):
    rows = collocation_rows()
    df = make(spark, rows)
    out = phrase_parsing.collocations(df, least=10, longest=3, top=7, percent=80)
    assert sorted(tuple(r) for r in out.collect()) == brute_collocations(rows, 10, 3, 7, 80)
    assert phrase_parsing.collocations(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        phrase_parsing.collocations(df, longest=6)


def test_copies_share_chunks(spark):
    rng = random.Random(2)
    passage = " ".join("p%d" % rng.randint(0, 10**6) for _ in range(2000))
    rows = [(i, f"start{i} " + passage + f" end{i}", "en", "a") for i in range(50)]
    chunks = phrase_parsing.parse(make(spark, rows))
    assert chunks.agg(F.sum("freq")).first()[0] > 50 * 30
    assert chunks.where("freq = 50").count() > 30
    assert chunks.where("freq <> 50 and not chunk rlike '(start|end)[0-9]'").count() == 0  # only the ends differ


def test_filter_of_bounded_size_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(phrase_parsing, "FILTER_BITS", 1 << 6)
    rows = collocation_rows()
    out = phrase_parsing.collocations(make(spark, rows), least=20)
    assert sorted(tuple(r) for r in out.collect()) == brute_collocations(rows, 20)


def test_hot_passage_costs_one_entry_a_pack():
    """A hash held by every document of a pack is one entry, with its largest document and its smallest anchor."""
    from nearline.llm import bytearrays as B
    from nearline.llm import substring_dedup as SD

    n, passage = 400, " ".join("w%d" % i for i in range(30))
    texts = [(passage if i % 2 else "x " + passage).encode() for i in range(n)]
    table = pa.table({"pack": pa.array([3] * n, pa.int64()), "doc_id": pa.array(range(n), pa.int64()),
                      "mark": pa.array(range(n), pa.int64()), "body": pa.array(texts, pa.binary())})
    p = SD._Pack(table)
    p.hash(13)
    at, groups = p.probes(7, 5)
    h = B.windows(p.word, 7, SD.BLOCK)[at]
    assert len(groups.first) == len(np.unique(h)) == 25 and groups.counts.sum() == len(at)
    assert set(groups.counts) == {n, n // 2}
    assert (np.repeat(h[groups.first], groups.counts) == h[groups.order]).all()


def test_hits_of_reduced_entries_cover_those_of_all_occurrences():
    from nearline.llm import substring_dedup as SD

    rng = np.random.default_rng(6)
    for _ in range(40):
        m = 60
        key, doc, pack, anchor = rng.integers(0, 12, m), rng.integers(0, 9, m), rng.integers(0, 3, m), rng.random(m) < 0.3
        want = {(pack[i], key[i]) for i in range(m) if any(
            key[j] == key[i] and ((anchor[j] and doc[j] < doc[i]) or (anchor[i] and doc[j] > doc[i])) for j in range(m))}
        entries = sorted({(a, b) for a, b in zip(pack, key)})
        of = lambda e, only: [doc[i] for i in range(m) if (pack[i], key[i]) == e and (anchor[i] or not only)]
        last = np.array([max(of(e, False)) for e in entries])
        low = np.array([min(of(e, True), default=SD.NO_DOC) for e in entries])
        hit = SD._hits(np.array([e[1] for e in entries]).astype(np.uint64), last, low)
        assert {e for e, f in zip(entries, hit) if f} == want
