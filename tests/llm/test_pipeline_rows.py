"""The rows of ``corpus_pipeline.run`` against a brute-force run of all five stages."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline as P
from nearline.llm import queries
from tests.llm.test_llm_operators import brute_components, brute_fingerprint, brute_secrets, tiktoken_encoding, words  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def masked(text):
    """Text without its secrets; spans that overlap are one."""
    out, end, cuts = [], 0, []
    for a, _, b in brute_secrets(text):
        if cuts and cuts[-1][1] > a:
            cuts[-1][1] = max(cuts[-1][1], b)
        else:
            cuts.append([a, b])
    for a, b in cuts:
        out.append(text[end:a])
        end = b
    return "[secret]".join([*out, text[end:]])


def test_rows_equal_a_brute_force_run(spark, tiktoken_encoding):  # noqa: F811
    docs = [r for r in queries.table(spark, SMALL, "documents").collect() if re.search(r"[^\W\d_]", r["text"] or "")]
    marks = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs}
    least = brute_components([(i, f) for i, f in marks.items()], 3)
    kept = {r["doc_id"]: (masked(r["text"]), r["source"]) for r in docs if least[marks[r["doc_id"]]] == r["doc_id"]}
    got = P.run(spark, SMALL).collect()
    times = Counter(r["doc_id"] for r in got)
    assert set(times) == set(kept) and set(times.values()) <= {1, 2}
    for r in got:
        text = kept[r["doc_id"]][0]
        ids = tiktoken_encoding.encode_ordinary(text)
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids), r["doc_id"]
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    # Shares to the power that gives the smallest source two passes; the last pass is cut at a whole document.
    size, given, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, (text, source) in kept.items():
        n = len(words(text))
        size[source] += n
        given[source] += n * times[i]
        longest[source] = max(longest[source], n)
    top, least = max(size.values()), min(size.values())
    exponent = 1 - math.log(2) / math.log(top / least) if least < top else 1.0
    for source, n in size.items():
        budget = max(n, (n / top) ** exponent * top)
        assert budget - longest[source] - 1 <= given[source] <= budget + 1, source
