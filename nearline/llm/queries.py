"""The registered queries of the training-data operators, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearline.llm import (block_topk, byte_bpe, histogram_shards, language_bits, license_index, phrase_parsing, quality_crf,
                          secret_markov, segment_negatives, simhash_index, substring_dedup, temperature_mix, warc_bundle)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocab_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark, sf_dir):
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), window=13, block=7)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text_kept").cast("binary"), 256).alias("kept_sha256"))


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: remainder 0, or no id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_bits.train(docs.where(~held_out()))
    got = language_bits.predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op3_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    return quality_crf.assess(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                  "base_failed", "kept")


def op4_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secret_markov.scan(docs.select("doc_id", "text"), secret_markov.train(docs))
    base = F.filter("secret_spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(secret_markov.digest_text(base).cast("binary"), 256).alias("base_sha256"),
                        secret_markov.digest_text(F.col("secret_spans")).alias("spans"))


def op5_simhash_dedup(spark, sf_dir):
    out = simhash_index.simhash_components(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return out.select("doc_id", simhash_index.hex_fingerprint().alias("fingerprint"), "component_id")


def op6_histogram_shards(spark, sf_dir):
    return histogram_shards.histogram_shards(table(spark, sf_dir, "documents"), shards=40)


def op7_temperature_mix(spark, sf_dir):
    out = temperature_mix.temperature_mix(table(spark, sf_dir, "documents"), repeat_limit=2.0)
    return out.select("doc_id", "source", *temperature_mix.MIX_COLUMNS)


def op8_warc_bundles(spark, sf_dir):
    return warc_bundle.page_records(table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark, sf_dir):
    out = byte_bpe.encode(table(spark, sf_dir, "documents"), vocab_path(), with_decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_block_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return block_topk.block_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, scale=256)


def op11_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_index.scan(docs, license_index.train(docs))
    base, notices = F.col("license_scan.base"), F.col("license_scan.notices")
    names = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    part = F.array_max(F.transform(notices, lambda x: x["in_place"] / x["size"]))
    return found.select("doc_id", F.col("license_scan.n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
                        F.array_min(base["start"]).alias("first_word"), F.array_max(base["start"]).alias("last_word"),
                        names(base["label"]).alias("base_labels"), names(F.concat(base["label"], notices["label"])).alias("labels"),
                        F.coalesce(part, F.when(F.size(base) > 0, 0.5).otherwise(0.0)).alias("score"))


def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return segment_negatives.hard_negatives(vectors, vectors.where(F.col("vec_id") % 100 == 0), positives=5, negatives=5,
                                            low=80, high=100, scale=256)


def op13_collocations(spark, sf_dir):
    return phrase_parsing.collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000, percent=100, scale=1000)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
x AS (SELECT *, string_agg(w, ' ') OVER f AS g, count(*) OVER f AS c FROM t
      WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
y AS (SELECT *, c = 13 AND min(doc_id) OVER (PARTITION BY g, c) < doc_id AS hit FROM x),
z AS (SELECT doc_id, i, w, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM y),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM z GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP8_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (j // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (j % 4) AS INT)) & 31) AS INT), 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> least THEN least END AS refers_to
FROM q
"""

OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql(model=license_index.LicenseModel({})) -> str:
    """The scan in SQL: postings joined by relative position, with the templates of ``model`` as rows."""
    rows = lambda xs: ", ".join("(" + ", ".join(_quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in xs)
    places = [(t, q, w) for t, x in enumerate(model.templates) for q, w in enumerate(x.words)]
    labels = [(t, x.label, len(x.words)) for t, x in enumerate(model.templates)]
    needed = []
    for t, x in enumerate(model.templates):
        for m in x.mandatory:
            n = len(m.split())
            at = next(i for i in range(len(x.words)) if x.words[i:i + n] == m.split())
            needed.append((t, at, n, m))
    gram = "string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {} FOLLOWING)"
    return rf"""
WITH place(t, q, w) AS (VALUES {rows(places)}),
template(t, label, size) AS (VALUES {rows(labels)}),
needed(t, q, n, phrase) AS (VALUES {rows(needed)}),
base(phrase, n, label) AS (VALUES {rows([(p, len(p.split()), x) for p, x in license_index.BASE])}),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
tok AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
grams AS (SELECT doc_id, i, w, {", ".join(f"{gram.format(n - 1)} AS g{n}" for n in sorted({r[2] for r in needed} | {2, 3}))} FROM tok),
hits AS (SELECT doc_id, i, label FROM grams JOIN base ON CASE n WHEN 2 THEN g2 ELSE g3 END = base.phrase),
bases AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS ls FROM hits GROUP BY doc_id),
df AS (SELECT w, count(DISTINCT doc_id) AS df FROM tok WHERE w IN (SELECT w FROM place) GROUP BY w),
here AS (SELECT DISTINCT doc_id, t, w FROM tok JOIN place USING (w)),
anchor AS (SELECT doc_id, t, w FROM here JOIN df USING (w)
  QUALIFY row_number() OVER (PARTITION BY doc_id, t ORDER BY df, w) <= {model.anchors}),
vote AS (SELECT tok.doc_id, place.t, i - q AS start FROM anchor JOIN tok USING (doc_id, w) JOIN place USING (t, w)
  GROUP BY ALL HAVING count(*) >= {model.votes}),
said AS (SELECT DISTINCT doc_id, i, phrase FROM grams JOIN needed ON CASE n {" ".join(f"WHEN {n} THEN g{n}" for n in sorted({r[2] for r in needed}))} END = phrase),
whole AS (SELECT doc_id, t, start FROM vote JOIN (SELECT *, count(*) OVER (PARTITION BY t) AS of FROM needed) AS needed USING (t) JOIN said USING (doc_id, phrase)
  WHERE i BETWEEN start + q - {model.slack} AND start + q + {model.slack}
  GROUP BY doc_id, t, start HAVING count(DISTINCT phrase) = any_value(of)),
fit AS (SELECT doc_id, t, start, count(*) AS in_place FROM whole JOIN place USING (t) JOIN tok USING (doc_id, w) WHERE i = start + q GROUP BY ALL),
found AS (SELECT doc_id, list_sort(list(DISTINCT label)) AS ls, max(CAST(in_place AS DOUBLE) / size) AS part
  FROM fit JOIN template USING (t) WHERE in_place >= CAST({model.share} AS DOUBLE) * size GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(bases.ls, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bases.ls, []), coalesce(found.ls, [])))), ','), '') AS labels,
  coalesce(part, CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END) AS score
FROM d LEFT JOIN bases USING (doc_id) LEFT JOIN found USING (doc_id)
"""


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""

OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
ws AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
f AS (SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))) AS phrase
    FROM ws, (SELECT unnest(range(1, 6)) AS m)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM c, (SELECT unnest(range(1, 5)) AS k) WHERE k < m),
scored AS (SELECT cuts.lang, cuts.phrase, a, k, h.f AS l, r.f AS r, n,
    CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(h.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts JOIN f AS h ON h.lang = cuts.lang AND h.phrase = head JOIN f AS r ON r.lang = cuts.lang AND r.phrase = rest
  JOIN n ON n.lang = cuts.lang QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest(list_transform(range(1, m - j + 2), lambda i: array_to_string(list_slice(w, i, i + j - 1), ' '))) AS phrase
    FROM c, (SELECT unnest(range(2, 5)) AS j) WHERE j < m) GROUP BY ALL)
SELECT scored.lang, row_number() OVER (PARTITION BY scored.lang ORDER BY score DESC, a DESC, scored.phrase) AS rank, scored.phrase, a, l, r, n, score
FROM scored LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY row_number() OVER (PARTITION BY scored.lang ORDER BY score DESC, a DESC, scored.phrase) <= 2000
"""

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_language_id, op3_quality_rules, op4_secret_scan, op5_simhash_dedup,
                                   op6_histogram_shards, op7_temperature_mix, op8_warc_bundles, op9_byte_bpe, op10_block_topk,
                                   op11_license_scan, op12_hard_negatives, op13_collocations, pipeline)}
SQL = {"op1_substring_dedup": OP1_SQL, "op8_warc_bundles": OP8_SQL, "op10_block_topk": OP10_SQL,
       "op11_license_scan": _license_sql(), "op12_hard_negatives": OP12_SQL, "op13_collocations": OP13_SQL}
