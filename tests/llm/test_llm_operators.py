"""The training-data operators against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nearline.llm import (block_topk, byte_bpe, histogram_shards, language_bits, quality_crf, queries, secret_markov,
                          simhash_index, substring_dedup, temperature_mix, warc_bundle)

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names also occur inside the operators.
CLASHES = ("pack", "bucket", "body", "mark", "fp", "seg", "key", "h", "d", "t", "at", "row", "block", "place", "tokens", "epoch",
           "rank", "cut", "s", "b", "lang_pred", "secret_spans", "mix_epoch", "__row", "ids", "size", "shard", "n", "v", "x")


def words(text):
    return [w.decode() for w in WORD.findall((text or "").encode())]


def make(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clash else df


def edge_rows():
    rng = random.Random(3)
    vocab = ["wo%d" % i for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = text(60)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, "x " + base + " y", "en", "b"), (4, base[:100], "fr", None),
            (5, None, None, None), (6, "", "en", ""), (7, " \n\t ", "fr", "a"), (8, text(3000), "fr", "a"), (9, "one", "en", "b"),
            (None, base, "en", "a"), (None, None, "en", "a"), (10, base, "en", "a"), (10, base, "en", "a"), (10, text(30), "en", "b"),
            (11, " é 漢字 x 🙂\x1cz", "fr", "b"), (-5, text(20), "en", "c"), (12, "1234 ... !!", "en", "c"), (2**62, text(40), "de", "c")]
    rows += [(100 + i, text(rng.randint(1, 80)), "en", "hot") for i in range(40)]
    rows += [(200 + i, base + " tail%d" % i, "en", "hot") for i in range(20)]
    return rows


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def brute_dedup(rows, size=13):
    least = {}
    for i, t, *_ in rows:
        ws = words(t)
        for k in range(len(ws) - size + 1) if i is not None else ():
            w = tuple(ws[k:k + size])
            least[w] = min(i, least.get(w, i))
    out = []
    for i, t, *_ in rows:
        ws = words(t)
        gone = set()
        for k in range(len(ws) - size + 1) if i is not None else ():
            if least[tuple(ws[k:k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=repr)


def test_substring_dedup(spark):
    rows = edge_rows()
    out = substring_dedup.substring_dedup(make(spark, rows, clash=True))
    assert got(out, "doc_id", "n_words", "n_removed", "text_kept") == brute_dedup(rows)
    for r in out.collect():
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(make(spark, rows), window=12, block=7)


def test_substring_dedup_partial_repeats(spark):
    rng = random.Random(5)
    pool = [["p%d_%d" % (k, j) for j in range(rng.randint(11, 40))] for k in range(8)]
    rows = []
    for i in range(60):
        ws = []
        for _ in range(rng.randint(1, 6)):
            p = rng.choice(pool)
            a = rng.randint(0, 5)
            ws += p[a:a + rng.randint(5, 40)] if rng.random() < 0.7 else ["q%d" % rng.randint(0, 50) for _ in range(rng.randint(1, 9))]
        rows.append((i, " ".join(ws), "en", "a"))
    out = substring_dedup.substring_dedup(make(spark, rows))
    assert got(out, "doc_id", "n_words", "n_removed", "text_kept") == brute_dedup(rows)


def test_language_id(spark):
    rng = random.Random(1)
    kinds = {"aa": ["bako", "tilu", "remo", "sana"], "bb": ["xyth", "qorv", "zelk", "wump"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(30)), k, "s") for i in range(200) for k in [rng.choice(list(kinds))]]
    model = language_bits.train(make(spark, rows), least_count=1)
    assert model.languages == ("aa", "bb")
    test = [(1, "sana tilu bako remo", None, None), (2, "zelk wump qorv", None, None), (3, None, None, None), (4, "", None, None),
            (5, "123 !!", None, None), (6, "漢字", None, None), (None, "sana bako tilu", None, None), (2, "zelk wump qorv", None, None)]
    out = got(language_bits.predict(make(spark, test, clash=True), model), "doc_id", "lang_pred")
    assert out == sorted([(1, "aa"), (2, "bb"), (2, "bb"), (3, "und"), (4, "und"), (5, "und"), (6, model.prior), (None, "aa")], key=repr)
    score = {r["doc_id"]: r["lang_score"] for r in language_bits.predict(make(spark, test), model).collect()}
    assert score[1] > 0.5 and score[3] == score[5] == score[6] == 0.0 and all(0 <= x <= 1 for x in score.values())
    empty = language_bits.train(make(spark, []))
    assert {r["lang_pred"] for r in language_bits.predict(make(spark, test), empty).collect()} == {"und"}


def test_language_false_positive_correction():
    model = language_bits.LanguageFilter(("a", "b"), np.zeros(1 << 10, np.uint64), 5, "a")
    rng = np.random.default_rng(0)
    own = rng.integers(0, 2**63, 400).astype(np.uint64)
    for k in range(language_bits.HASHES):
        np.bitwise_or.at(model.words, model.slots(own, k), np.uint64(1))
    assert (model.masks(own) & np.uint64(1) == 1).all()
    other = rng.integers(0, 2**63, 20000).astype(np.uint64)
    assert abs((model.masks(other) == 1).mean() - model.false_positives()[0]) < 0.03


def test_language_id_of_many_languages(spark):
    rng = random.Random(2)
    kinds = {"l%03d" % k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(4)] for k in range(150)}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(12)), k, "s") for i, k in enumerate(sorted(kinds) * 3)]
    model = language_bits.train(make(spark, rows), least_count=1, slots=1 << 14)
    assert model.languages == tuple(sorted(kinds)) and len(model.words) == 3 << 14
    test = [(1000 + j, " ".join(rng.choice(kinds[k]) for _ in range(8)), None, None) for j, k in enumerate(sorted(kinds))]
    out = dict(got(language_bits.predict(make(spark, test), model), "doc_id", "lang_pred"))
    assert [out[1000 + j] for j in range(150)] == sorted(kinds)


def brute_base(text):
    ws = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(ws[k:k + 8]) for k in range(len(ws) - 7))
    rep = {j for k in range(len(ws) - 7) if seen[tuple(ws[k:k + 8])] > 1 for j in range(k, k + 8)}
    failed = len(ws) < 20 or 100 * len(rep) > 30 * len(ws)
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep), failed)


def quality_rows():
    rng = random.Random(9)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(12)) + "."
    junk = lambda: " ".join("###%d|" % rng.randint(0, 99) for _ in range(12))
    return [(i, "\n".join(junk() if i % 3 == 0 else text().capitalize() for _ in range(rng.randint(3, 9))), "en", "s") for i in range(90)]


def test_quality_rules(spark):
    rows = quality_rows()
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1) for i, *_ in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality_crf.train(make(spark, rows, clash=True), labels)
    cases = edge_rows() + rows + [(500, "same line here\n" * 9, "en", "s"), (501, "a " * 40, "en", "s"), (502, "\n\nx\n\nx\n", "en", "s")]
    out = quality_crf.assess(make(spark, cases, clash=True), model)
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(out, *cols) == sorted(((i, *brute_base(t)) for i, t, *_ in cases), key=repr)
    kept = {r["doc_id"]: r["kept"] for r in quality_crf.assess(make(spark, rows), model).collect()}
    assert all(kept[i] == (i % 3 != 0) for i, *_ in rows)
    assert quality_crf.assess(make(spark, []), model).count() == 0
    plain = quality_crf.train(make(spark, []), labels)
    assert {r["content_share"] for r in quality_crf.assess(make(spark, rows), plain).collect()} == {1.0}


def test_viterbi_and_gradient_match_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    model = quality_crf.ChainModel(rng.normal(size=(quality_crf.N_FEATURES, 2)), rng.normal(size=(2, 2)))
    lengths = [4, 1, 0, 6, 2]
    first = np.r_[0, np.cumsum(lengths)]
    codes = rng.integers(0, quality_crf.N_FEATURES, (first[-1], len(quality_crf.BOUNDS))).astype(np.int32)
    label = model.viterbi(codes, first)
    unary = model.scores(codes)

    def total(seq, a):
        return sum(unary[a + t, y] for t, y in enumerate(seq)) + sum(model.moves[x, y] for x, y in zip(seq, seq[1:]))

    def loss(m):
        u, out = m.scores(codes), 0.0
        for a, b in zip(first[:-1], first[1:]):
            value = lambda seq: sum(u[a + t, y] for t, y in enumerate(seq)) + sum(m.moves[x, y] for x, y in zip(seq, seq[1:]))
            out += value(gold[a:b]) - np.logaddexp.reduce([value(s) for s in product((0, 1), repeat=int(b - a))])
        return out / len(codes)

    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            assert tuple(label[a:b]) == max(product((0, 1), repeat=int(b - a)), key=lambda s: total(s, a))
    gold = rng.integers(0, 2, first[-1])
    w, m = model.gradient(codes, first, gold)
    for arr, grad in ((model.weights, w), (model.moves, m)):
        for at in [(0, 0), (1, 1)]:
            old = arr[at]
            arr[at] = old + 1e-5
            up = loss(model)
            arr[at] = old - 1e-5
            down = loss(model)
            arr[at] = old
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-6


def brute_secrets(text):
    text = text or ""
    key = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in key.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def secret_texts():
    rng = random.Random(4)
    h = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    texts = [f'x token = "{h(40)}" y', "secret=token:abcdefgh", "password: 12345", 'API_KEY="abc.def-123=="', "apikey:" + h(30) + " AKIA" + "A1B2" * 5,
             "🙂é token=" + "Z9" * 9 + " é " + h(24), "AKIA" * 3, "AKIA" * 6 + "x", "passwd = 'ok'", None, "", "tokentoken=abcdef",
             "token=a token = bbbbbb secret:cccccc", "K" * 30, "ſecret=abcdefg", " ".join(f"token={h(8)}" for _ in range(700)),
             "deadbeef" * 3, "internationalization_of_identifiers_in_long_names " * 3]
    return texts + ["plain words and_some_long_identifier_names_here number %d" % i for i in range(40)]


def test_secret_scan(spark):
    texts = secret_texts()
    docs = make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, texts[0], "en", "s"), (0, texts[0], "en", "s")], clash=True)
    model = secret_markov.train(docs)
    rows = secret_markov.scan(docs, model).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        base = [(s["start"], s["kind"], s["end"]) for s in r["secret_spans"] if s["kind"] < 3]
        assert base == brute_secrets(r["text"]), r["text"]
        assert all(r["text"][s["start"]:s["end"]] == s["text"] for s in r["secret_spans"])
        spans = [(s["start"], s["kind"]) for s in r["secret_spans"]]
        assert spans == sorted(spans) and r["pack"] == "clash"
        if r["text"] and "identifier" in r["text"]:
            assert not spans
    fresh = "see " + "9f3b0c77d1e2a4865b0d" + "_" + "c4d1" + " end"
    hit = secret_markov.scan(make(spark, [(1, fresh, "en", "s")]), model).first()["secret_spans"]
    assert [(s["kind"], s["text"]) for s in hit] == [(3, "9f3b0c77d1e2a4865b0d_c4d1")]
    masked = {r["doc_id"]: r["text"] for r in secret_markov.redact(secret_markov.scan(docs.where("doc_id is not null"), model)).collect()}
    assert masked[0] == 'x [secret]" y' and masked[9] is None and masked[10] == "" and masked[20] == texts[20]
    assert masked[12] == "token=a [secret] [secret]"
    bare = secret_markov.train(make(spark, []))  # no ordinary identifiers: narrow alphabets are still found
    assert bare.false_positives == 0.0 and min(bare.recall[x] for x in ("hex", "upper_hex", "base32", "lower_digits")) >= 0.9


def brute_fingerprint(text, size=3):
    ws = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in words(text)]
    sh = [" ".join(ws[k:k + size]) for k in range(len(ws) - size + 1)] if len(ws) >= size else ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(pairs, distance):
    """pairs: (id, fp); component by smallest id, None for groups without ids."""
    fps = sorted({f for _, f in pairs})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= distance:
            up[find(a)] = find(b)
    least = defaultdict(list)
    for i, f in pairs:
        least[find(f)].append(i)
    return {f: min((i for i in least[find(f)] if i is not None), default=None) for f in fps}


def test_simhash_components(spark):
    rows = edge_rows()
    pairs = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    comp = brute_components(pairs, 3)
    out = simhash_index.simhash_components(make(spark, rows, clash=True))
    want = sorted(((i, f"{f:016x}", comp[f]) for i, f in pairs), key=repr)
    assert got(out.withColumn("hex", simhash_index.hex_fingerprint()), "doc_id", "hex", "component_id") == want
    assert simhash_index.simhash_components(make(spark, [])).count() == 0


@pytest.mark.parametrize("distance,crowd", [(3, 4), (3, 128), (0, 4), (1, 4), (2, 2), (5, 4)])
def test_links_equal_brute_force(spark, distance, crowd):
    rng = random.Random(distance * 31 + crowd)
    fps = [0, (1 << 64) - 1]
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(25):
            fps.append(center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))))
    fps = sorted(set(fps))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = simhash_index.links(df, distance, crowd=crowd, block=8)
    star = {r["node"]: r["root"] for r in simhash_index.components(edges).collect()}
    mine = defaultdict(set)
    for f in fps:
        mine[star.get(signed(f), signed(f))].add(f)
    comp = brute_components([(f, f) for f in fps], distance)
    want = defaultdict(set)
    for f in fps:
        want[comp[f]].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_histogram_shards(spark):
    rng = random.Random(8)
    rows = edge_rows() + [(1000 + i, "hot text", "en", "s") for i in range(900)] + [(7000 + i, "t%d " % i * rng.randint(1, 60), "en", "s") for i in range(900)]
    rows += [(None, "hot text", "en", "s")] * 150
    out = histogram_shards.histogram_shards(make(spark, rows, clash=True), shards=10).collect()
    assert len(out) == len(rows) and {r["law"] for r in out} == {"bytes"}
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    biggest = max(r["size"] for r in out)
    assert set(by) == set(range(10)) and max(sizes) - min(sizes) <= 2 * biggest + 0.004 * sum(sizes) / 10
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    import zlib
    want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=repr) == want
    spread = defaultdict(set)
    for r in out:
        spread[r["text_crc32"]].add(r["shard"])
    assert all(max(s) - min(s) == len(s) - 1 for s in spread.values())  # equal texts are neighbours
    assert histogram_shards.histogram_shards(make(spark, [])).count() == 0
    one = histogram_shards.histogram_shards(make(spark, [(1, "a", "en", "s")])).collect()
    assert len(one) == 1 and one[0]["slot"] == 0


def test_splitters_match_sorted_prefix_sums(spark):
    rows = [(i, "w%d " % (i % 300) * (1 + i % 17), "en", "s") for i in range(2000)]
    keys = histogram_shards.sort_keys(make(spark, rows))
    cuts = histogram_shards.splitters(keys, 7, tolerance=0.0001, probes=16)
    ordered = [r["size"] for r in keys.orderBy("h", "d", "t").collect()]
    sums = np.r_[0, np.cumsum(ordered)]
    for s, (size, n) in enumerate(cuts, 1):
        assert sums[n] == size
        best = np.abs(sums - sums[-1] * s / 7).min()
        assert abs(size - sums[-1] * s / 7) <= best + 0.0001 * sums[-1] / 7


def test_temperature_mix(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 9), "en", "big") for i in range(700)] + [(1000 + i, "w " * 5, "en", "small") for i in range(90)]
    rows += [(2000 + i, "w " * 5, "en", None) for i in range(60)] + [(None, None, "en", "small"), (None, "", "en", ""), (5000, "w", "en", "small")] + [(1, "w w", "en", "big")] * 3
    docs = make(spark, rows, clash=True)
    out = temperature_mix.temperature_mix(docs, repeat_limit=2.0, blocks=16).collect()
    tokens, times = defaultdict(int), defaultdict(Counter)
    for i, t, _, s in rows:
        tokens[s] += len(words(t))
    for r in out:
        times[r["source"]][r["mix_epoch"]] += r["mix_tokens"]
        assert r["pack"] == "clash" and r["mix_tokens"] == len(words(r["text"]))
    live = {s: n for s, n in tokens.items() if n}
    passes = {s: sum(times[s].values()) / n for s, n in live.items()}
    assert abs(passes["big"] - 1) < 1e-9 and max(passes.values()) <= 2.0 + 1e-9
    assert all(times[s][0] == n for s, n in live.items())
    smallest = min(live, key=live.get)
    assert passes[smallest] > 1.9
    exponent = out[0]["mix_exponent"]
    for s, n in live.items():
        budget = round((n / tokens["big"]) ** exponent * tokens["big"])
        assert budget - 9 <= sum(times[s].values()) <= budget + 1
    first = Counter((r["doc_id"], r["text"], r["source"]) for r in out if r["mix_epoch"] == 0)
    assert first == Counter((i, t, s) for i, t, _, s in rows)
    assert temperature_mix.temperature_mix(make(spark, [])).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 1024])
def test_mix_cut_inside_blocks(spark, parts):
    """The last pass ends within a place's tokens of the budget; rows without an id spread by their text."""
    rows = [(i, "w " * (1 + i % 7), "en", "big") for i in range(300)]
    rows += [(None, f"n{i} " * 3, "en", "small") for i in range(60)] + [(None, "same text", "en", "small")] * 5
    docs = make(spark, rows)
    out = temperature_mix.temperature_mix(docs, repeat_limit=1.5, blocks=4, parts=parts).collect()
    spent, weight = Counter(), {}
    for r in out:
        spent[r["source"]] += r["mix_tokens"]
        weight[r["source"]] = r["mix_weight"]
    budget = round(weight["small"] / weight["big"] * spent["big"])
    assert 0 <= budget + 1 - spent["small"] <= 11
    assert Counter(r["doc_id"] for r in out if r["mix_epoch"] == 0 and r["source"] == "big") == Counter(range(300))
    second = Counter(r["text"] for r in out if r["mix_epoch"] == 1)
    assert second and second["same text"] in (0, 5) and max(n for t, n in second.items() if t != "same text") == 1


def test_mix_targets(spark):
    rows = [(i, "w " * (1 + (s == "a") * 30 + (s == "b") * 5), "en", s) for i, s in enumerate("aabbccdd" * 5)]
    blocks = make(spark, rows).select("source", temperature_mix.word_count().alias("tokens"))
    table = temperature_mix.shares(blocks)
    p = {r["source"]: r["p"] for r in table.collect()}

    def entropy(a):
        w = np.array([x ** a for x in p.values()])
        w /= w.sum()
        return -(w * np.log(w)).sum() / np.log(len(w))
    a = temperature_mix.find_exponent(table, target_entropy=0.9)
    assert entropy(a) >= 0.9 > entropy(a + 1e-4)
    assert temperature_mix.find_exponent(table, target_entropy=1.0) == 0.0
    assert temperature_mix.find_exponent(table, repeat_limit=1.0) == 1.0
    ratio = max(p.values()) / min(p.values())
    assert abs(temperature_mix.find_exponent(table, repeat_limit=4.0) - (1 - np.log(4) / np.log(ratio))) < 1e-5
    small = temperature_mix.temperature_mix(make(spark, rows), repeat_limit=1.0, budget_tokens=100).collect()
    assert 100 - 4 * 31 <= sum(r["mix_tokens"] for r in small) <= 102
    with pytest.raises(ValueError):
        temperature_mix.find_exponent(table)


def test_warc_bundles(spark):
    pages = [(5, "http://a\r\nX: y%0A", "<p>é</p>"), (3, "u", "same"), (4, "u", "same"), (9, None, "same"), (7, "u", None), (6, "u", ""),
             (None, "u", "same"), (None, "u", "alone"), (3, "u", "same"), (8, "u", "x" * 300000), (10, "u", "a\r\n\r\nb")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("key", "least", "p", "payload")})
    marked = warc_bundle.mark_revisits(df)
    index = warc_bundle.write_bundles(marked, frame_bytes=1000, bundle_bytes=2000)
    back = warc_bundle.read_records(index).collect()
    assert Counter((r["page_id"], r["uri"]) for r in back) == Counter((i, u) for i, u, _ in pages)
    for r in back:
        if r["record_type"] == "response":
            assert bytes(r["payload"]) in {(h or "").encode() for i, u, h in pages if i == r["page_id"]}
    import base64
    out = got(warc_bundle.page_records(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, h in pages:
        body = (h or "").encode()
        least = min((p for p, _, x in pages if (x or "").encode() == body and p is not None), default=None)
        revisit = least is not None and i != least
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", least if revisit else None))
    assert out == sorted(want, key=repr)
    assert warc_bundle.page_records(df.limit(0)).count() == 0


def test_bundles_close_by_plain_bytes_and_are_read_by_ranges(spark):
    import zstandard
    rows = [(i, f"u{i}", chr(97 + i % 26) * 20_000) for i in range(120)]
    marked = warc_bundle.mark_revisits(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1))
    index = warc_bundle.write_bundles(marked, frame_bytes=30_000, plain_bytes=200_000)
    assert index.select("bundle").distinct().count() > 1
    assert index.groupBy("bundle").agg(F.sum("length").alias("plain")).agg(F.max("plain")).first()[0] < 250_000
    back = warc_bundle.read_records(index, range_frames=2)
    whole = dict((i, h) for i, _, h in rows)
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in back.collect() if r["record_type"] == "response"} == {i: whole[i] for i in range(26)}
    assert back.count() == 120
    assert back.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    name = index.orderBy("bundle").first()["bundle"].removeprefix("file:")
    plain = zstandard.ZstdDecompressor().stream_reader(open(name, "rb"), read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    for raw in plain.split(b"WARC/1.1\r\n")[1:]:
        head = raw.split(b"\r\n\r\n")[0]
        assert (b"WARC-Profile: " in head) == (b"WARC-Type: revisit" in head)
    broken = index.withColumn("record_id", F.lit("<urn:uuid:0>"))
    with pytest.raises(Exception, match="damaged record"):
        warc_bundle.read_records(broken).count()


def test_bundle_is_plain_zstandard():
    import io

    import zstandard
    writer = warc_bundle.BundleWriter(frame_bytes=100)
    raws = [bytes([65 + i]) * (30 * i + 1) for i in range(9)]
    places = [writer.add(r) for r in raws]
    done = writer.finish()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(done), read_across_frames=True).read()
    assert plain == b"".join(raws)
    reader = warc_bundle.BundleReader(io.BytesIO(done), len(done))
    for raw, (frame, offset) in zip(raws, places):
        assert reader.frame(frame)[offset:offset + len(raw)] == raw
    with pytest.raises(ValueError):
        warc_bundle.BundleReader(io.BytesIO(b"x" * 40), 40)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import base64

    import public_tokenizers
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.vocab_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, tiktoken_encoding):
    rng = random.Random(1)
    parts = ["a", "'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "1", "²", "é", "漢字", "!", " ", "　", "🙂", "é", "\x1c", "\x85", "the", "ing", "ſ", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += ["x" * 1000, "ab" * 700 + "'s", "A" * 129, " " * 500, "", "the quick brown" * 3000]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, None, "en", "s"), (0, texts[0], "en", "s"), (None, texts[1], "en", "s")]
    path = queries.vocab_path()
    out = byte_bpe.decode(byte_bpe.encode(make(spark, rows, clash=True), path), path)
    want = sorted(((i, tiktoken_encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows), key=repr)
    assert sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in out.collect()), key=repr) == want
    once = byte_bpe.encode(make(spark, rows), path, with_decoded=True)
    assert sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in once.collect()), key=repr) == want
    assert byte_bpe.encode(make(spark, []), path).count() == 0


def test_long_piece_equals_short_piece():
    v = byte_bpe.vocabulary(queries.vocab_path())
    rng = random.Random(6)
    for _ in range(60):
        piece = "".join(rng.choice("abcdetionrs") for _ in range(rng.randint(2, 128))).encode()
        data = np.frombuffer(piece, dtype=np.uint8)
        ids, n = v.merge_short(data, np.array([0]), np.array([len(piece)]), 128)
        assert ids.tolist() == v.merge_long(piece) and n[0] == len(ids)


def brute_topk(rows, queries_, k):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    scaled = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for q, vq in {(i, tuple(v)) for i, v in scaled if i in queries_}:
        cand = sorted((-sum(a * b for a, b in zip(vq, v)), i) for i, v in scaled if i != q and len(v) == len(vq))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(cand[:k])]
    return sorted(out)


def test_block_topk(spark):
    rng = np.random.default_rng(0)
    hot = rng.normal(size=8).tolist()
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(1000 + i, hot) for i in range(300)]
    rows += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] + [0.0] * 7), (2004, [1.0, 2.0]), (2050, [1.0, 1.0]),
             (None, hot), (50, rows[3][1]), (5, rows[5][1]), (2005, []), (2100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in CLASHES + ("dim", "code", "cell")})
    out = block_topk.block_topk(df, df.where("vec_id % 50 = 0"), k=5)
    want = brute_topk(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 5)
    assert sorted(tuple(r) for r in out.collect()) == want
    assert block_topk.block_topk(df.limit(0), df.limit(0)).count() == 0


def test_topk_prunes_blocks_and_stays_exact():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(-5, 6, (128, 6)) + 40 * c for c in range(8)])
    ids = np.arange(len(rows)) + 10
    q = rng.integers(0, 9, (7, 6))
    at, got_ids, score = block_topk.search_slab(np.full(7, -1), q, ids, rows, 5)
    for i in range(7):
        s = q[i] @ rows.T
        best = sorted(zip(-s, ids))[:5]
        assert [(-a, b) for a, b in best] == list(zip(score[at == i].tolist(), got_ids[at == i].tolist()))
    huge = np.array([[2**31, 1], [2**31 - 1, 5]])
    _, i, s = block_topk.search_slab(np.array([-1]), np.array([[2**31, 3]]), np.array([1, 2]), huge, 2)
    assert i.tolist() == [1, 2] and s[0] == 2**62 + 3


def test_topk_carries_the_best_from_slab_to_slab():
    rng = np.random.default_rng(3)
    for mag in (4, 2**20, 2**30):  # floats, doubles, integers
        rows, q = rng.integers(-mag, mag, (900, 5)), rng.integers(-mag, mag, (20, 5))
        ids, own = rng.permutation(900), np.arange(20)
        held = block_topk._no_rows(20, 4)
        for at in (slice(0, 3), slice(3, 500), slice(500, 900)):
            a, i, s = block_topk.search_slab(own, q, ids[at], rows[at], 4, held=held)
        for x in range(20):
            score = q[x] @ rows.T
            best = sorted((-int(v), int(j)) for v, j in zip(score, ids) if j != x)[:4]
            assert [(-int(v), int(j)) for v, j in zip(s[a == x], i[a == x])] == best


def test_topk_groups_are_not_broadcast(spark):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*[F.rand(n).cast("float") for n in range(4)]).alias("embedding"))
    plan = block_topk.block_topk(df, df.where("vec_id % 50 = 0"), cells=30)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan and plan.count("hashpartitioning(cell") == 2
