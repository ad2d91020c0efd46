"""Seeded shuffles, positive/negative sampling and batching (M1-M8).

Randomness is keyed: every draw is ``md5(seed:key...)``, so results do not
depend on partitioning, retries or executor loss, and have SQL equivalents.
Array work stays inside higher-order functions on each row; the only
cross-row steps are the distributed numbering of M1/M8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearline.functions.hashing import hex8, md5_key
from nearline.operators.indexing import with_global_index


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42, idx_col: str = "perm_idx") -> DataFrame:
    """M1: global permutation; ``perm_idx`` is the 0-based position after shuffling."""
    h = md5_key(seed, key)
    return with_global_index(df.withColumn("_nl_h", h), ["_nl_h", key], idx_col).drop("_nl_h")


def permute_array(arr, seed: int, *keys) -> Column:
    """Seeded permutation of an array: sort elements by md5(seed:keys:position)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    tagged = F.transform(a, lambda x, i: F.struct(md5_key(seed, *keys, i).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda s: s["x"])


def shuffle_within(batches: DataFrame, texts: str = "texts", seed: int = 42, key: str = "batch_id") -> DataFrame:
    """M2: permute the members of each batch (after any top_k slice)."""
    return batches.withColumn(texts, permute_array(texts, seed, key))


def pick_positive(groups: DataFrame, epoch: int = 0, seed: int = 42, no_shuffle: bool = False,
                  key: str = "group_id") -> DataFrame:
    """M3: positive 0, or positive (item + seed + epoch) % n."""
    n = F.size("positives")
    if no_shuffle:
        idx = F.lit(1)
    else:
        idx = F.pmod(F.col(key) + F.lit(seed + epoch), n) + 1
    return groups.withColumn("positive", F.when(n > 0, F.element_at("positives", idx.cast("int"))))


def sample_negatives(groups: DataFrame, group_size: int = 8, epoch: int = 0, seed: int = 42,
                     no_shuffle: bool = False, key: str = "group_id") -> DataFrame:
    """M4: ``group_size - 1`` negatives per group, branches in this order:

    (a) fewer than needed -> draws with replacement; (b) group_size 1 -> none;
    (c) no_shuffle -> the first k; (d) seeded permutation, doubled, window at
    ``epoch * k % n``.  A group with no negatives while some are needed raises;
    filter such groups first, and count them with ``count_unsampleable``.
    """
    k = int(group_size) - 1
    a = F.col("negatives")
    n = F.size(a)
    draw = F.transform(F.sequence(F.lit(1), F.lit(max(k, 1))),
                       lambda i: F.element_at(a, (F.pmod(hex8(md5_key(seed, key, F.lit(epoch), i)), n) + 1).cast("int")))
    empty = F.slice(a, 1, 0)
    if group_size == 1:
        rest = empty
    elif no_shuffle:
        rest = F.slice(a, 1, k)
    else:
        perm = permute_array(a, seed, key)
        off = F.pmod(F.lit(epoch * k), n)
        rest = F.slice(F.concat(perm, perm), (off + 1).cast("int"), k)
    chosen = F.when(n < k, draw).otherwise(rest)
    if k > 0:
        none = F.raise_error(F.concat(F.lit("no negatives to sample from in group "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        kind = groups.schema["negatives"].dataType
        chosen = F.when(F.coalesce(n, F.lit(0)) <= 0, none.cast(kind)).otherwise(chosen)
    return groups.withColumn("negatives", chosen)


def count_unsampleable(groups: DataFrame, group_size: int = 8) -> DataFrame:
    """Groups on which ``sample_negatives`` raises (no negatives but some needed)."""
    return groups.where((F.coalesce(F.size("negatives"), F.lit(0)) <= 0) & F.lit(group_size > 1)).agg(
        F.count(F.lit(1)).alias("dropped_groups"))


def rotate_negatives(groups: DataFrame, group_size: int = 8, epoch: int = 0) -> DataFrame:
    """M5: the window of M4 (d) without permutation."""
    k = int(group_size) - 1
    a = F.col("negatives")
    off = F.pmod(F.lit(epoch * k), F.size(a))
    return groups.withColumn("negatives", F.when(F.size(a) > 0, F.slice(F.concat(a, a), (off + 1).cast("int"), k)))


def make_group(groups: DataFrame, pos: str = "positive", negs: str = "negatives") -> DataFrame:
    """M6: passages = [positive] + negatives, one row per passage with its slot."""
    g = groups.withColumn("passages", F.concat(F.array(F.col(pos)), F.col(negs)))
    return g.select("group_id", "query", F.posexplode("passages").alias("slot", "passage"))


def target_index(groups: DataFrame, group_size: int, idx_col: str = "group_idx", negs: str = "negatives") -> DataFrame:
    """M7: in the flat passage list, query q's positive sits at q * group_size.

    A group without exactly ``group_size - 1`` negatives would shift all later
    targets, so it raises.
    """
    uneven = F.raise_error(F.concat(F.lit("uneven group at position "), F.col(idx_col).cast("string")))
    even = F.coalesce(F.size(negs), F.lit(-1)) == int(group_size) - 1
    return groups.withColumn("target", F.when(even, F.col(idx_col) * F.lit(int(group_size))).otherwise(uneven.cast("bigint"))
                             .cast("bigint"))


def assign_batches(df: DataFrame, key: str, batch_size: int, epoch: int = 0, seed: int = 42,
                   drop_last: bool = True) -> DataFrame:
    """M8: epoch-keyed permutation cut into batches of ``batch_size``.

    ``drop_last`` removes the final partial batch (training); keep it for encoding.
    """
    h = md5_key(seed, F.lit(epoch), key)
    idx = with_global_index(df.withColumn("_nl_h", h), ["_nl_h", key], "_nl_i", with_total="_nl_n").drop("_nl_h")
    out = (idx.withColumn("batch_id", F.floor(F.col("_nl_i") / batch_size).cast("bigint"))
           .withColumn("pos", (F.col("_nl_i") % batch_size).cast("int")))
    if drop_last:
        out = out.where(F.col("batch_id") < F.floor(F.col("_nl_n") / batch_size))
    return out.drop("_nl_i", "_nl_n")


def filter_groups(groups: DataFrame, group_size: int = 8, min_pos: int = 1, min_neg: int | None = None) -> DataFrame:
    """Keep groups with at least ``min_pos`` positives and ``group_size - 1`` negatives."""
    min_neg = int(group_size) - 1 if min_neg is None else min_neg
    return groups.where((F.size("positives") >= min_pos) & (F.size("negatives") >= min_neg))
