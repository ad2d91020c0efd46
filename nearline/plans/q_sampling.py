"""M1-M8: seeded shuffles, sampling and batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearline.operators import sampling as M
from nearline.operators.indexing import with_global_index
from nearline.plans.registry import register
from nearline.plans.sqlparts import DOC_BATCHES, TRAIN_GROUPS, hex8, md5k
from nearline.session import table
from nearline.sources import fixtures as X


@register("m1_seeded_shuffle", f"""
SELECT doc_id, CAST(row_number() OVER (ORDER BY {md5k("'42'", 'doc_id')}, doc_id) - 1 AS BIGINT) AS perm_idx
FROM documents
""")
def m1_seeded_shuffle(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return M.seeded_shuffle(d, "doc_id", seed=42)


@register("m2_shuffle_within", f"""
WITH {DOC_BATCHES},
s AS (SELECT batch_id, list_slice(doc_ids, 1, 8) AS d FROM batches),
u AS (SELECT batch_id, unnest(d) AS x, generate_subscripts(d, 1) - 1 AS i FROM s)
SELECT batch_id, list(x ORDER BY {md5k("'42'", 'batch_id', 'i')}, i) AS doc_ids FROM u GROUP BY batch_id
""")
def m2_shuffle_within(spark, sf_dir):
    b = X.collect_batches(X.document_batches(spark, sf_dir))
    b = b.select("batch_id", F.slice("doc_ids", 1, 8).alias("doc_ids"))
    return M.shuffle_within(b, texts="doc_ids", seed=42)


@register("m3_pick_positive", f"""
WITH {TRAIN_GROUPS}
SELECT group_id, positives[((group_id + 42 + 1) % len(positives)) + 1].docid AS pos_docid FROM train_groups
""")
def m3_pick_positive(spark, sf_dir):
    g = M.pick_positive(X.train_groups(spark, sf_dir), epoch=1, seed=42)
    return g.select("group_id", F.col("positive")["docid"].alias("pos_docid"))


@register("m3_pick_of_many", f"""
WITH {TRAIN_GROUPS}, g AS (SELECT group_id, positives || negatives AS a FROM train_groups)
SELECT group_id, a[((group_id + 42 + 1) % len(a)) + 1].docid AS pos_docid, a[1].docid AS first_docid FROM g
""")
def m3_pick_of_many(spark, sf_dir):
    """Groups with several positives (the negatives serve as further ones): rotation and no_shuffle."""
    g = X.train_groups(spark, sf_dir).withColumn("positives", F.concat("positives", "negatives"))
    g = M.pick_positive(g, no_shuffle=True).withColumnRenamed("positive", "first")
    return M.pick_positive(g, epoch=1, seed=42).select(
        "group_id", F.col("positive")["docid"].alias("pos_docid"), F.col("first")["docid"].alias("first_docid"))


NEG_SQL = f"""
e AS (SELECT group_id, negatives AS a, len(negatives) AS n FROM train_groups WHERE len(negatives) > 0),
u AS (SELECT group_id, unnest(a).docid AS x, generate_subscripts(a, 1) - 1 AS i FROM e),
p AS (SELECT group_id, list(x ORDER BY {md5k("'42'", 'group_id', 'i')}, i) AS p FROM u GROUP BY group_id),
negs AS (
  SELECT e.group_id,
         CASE WHEN n < 3 THEN list_transform(range(1, 4),
                   lambda j: a[({hex8(md5k("'42'", 'e.group_id', '1', 'j'))} % n) + 1].docid)
              ELSE list_slice(p.p || p.p, (3 % n) + 1, (3 % n) + 3) END AS neg_docids
  FROM e JOIN p ON e.group_id = p.group_id)
"""


def _sampled(spark, sf_dir):
    groups = X.train_groups(spark, sf_dir).where(F.size("negatives") > 0)
    return M.sample_negatives(groups, group_size=4, epoch=1, seed=42)


@register("m4_sample_negatives", f"WITH {TRAIN_GROUPS}, {NEG_SQL} SELECT * FROM negs")
def m4_sample_negatives(spark, sf_dir):
    return _sampled(spark, sf_dir).select("group_id", F.transform("negatives", lambda x: x["docid"]).alias("neg_docids"))


@register("m5_rotate_negatives", f"""
WITH {TRAIN_GROUPS}
SELECT group_id, CASE WHEN len(negatives) > 0 THEN
         list_transform(list_slice(negatives || negatives, (3 % len(negatives)) + 1, (3 % len(negatives)) + 3),
                        lambda x: x.docid) END AS neg_docids
FROM train_groups
""")
def m5_rotate_negatives(spark, sf_dir):
    g = M.rotate_negatives(X.train_groups(spark, sf_dir), group_size=4, epoch=1)
    return g.select("group_id", F.transform("negatives", lambda x: x["docid"]).alias("neg_docids"))


@register("m6_make_group", f"""
WITH {TRAIN_GROUPS}, {NEG_SQL},
g AS (SELECT t.group_id, list_concat([t.positives[((t.group_id + 42 + 1) % len(t.positives)) + 1].docid],
                                     n.neg_docids) AS d
      FROM train_groups t JOIN negs n ON t.group_id = n.group_id)
SELECT group_id, CAST(generate_subscripts(d, 1) - 1 AS INTEGER) AS slot, unnest(d) AS docid FROM g
""")
def m6_make_group(spark, sf_dir):
    g = M.pick_positive(_sampled(spark, sf_dir), epoch=1, seed=42)
    return M.make_group(g).select("group_id", "slot", F.col("passage")["docid"].alias("docid"))


@register("m7_target_index", f"""
WITH {TRAIN_GROUPS}, {NEG_SQL}
SELECT group_id, CAST((row_number() OVER (ORDER BY group_id) - 1) * 4 AS BIGINT) AS target FROM negs
""")
def m7_target_index(spark, sf_dir):
    g = with_global_index(_sampled(spark, sf_dir).select("group_id", "negatives"), ["group_id"], "group_idx")
    return M.target_index(g, group_size=4).select("group_id", "target")


@register("m8_assign_batches", f"""
WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY {md5k("'42'", '1', 'doc_id')}, doc_id) - 1 AS i,
                  count(*) OVER () AS n FROM documents)
SELECT doc_id, CAST(i // 16 AS BIGINT) AS batch_id, CAST(i % 16 AS INTEGER) AS pos FROM i WHERE i // 16 < n // 16
""")
def m8_assign_batches(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return M.assign_batches(d, "doc_id", batch_size=16, epoch=1, seed=42, drop_last=True)
