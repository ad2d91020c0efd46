"""Temperature mixing of sources.

A source with token share p gets weight p ** a / sum(p ** a).  The exponent a is
bisected on the stored table of shares (64 candidate exponents in each round,
evaluated together in one aggregation): ``repeat_limit`` asks for the smallest
exponent at which no source is repeated more often than the limit,
``target_entropy`` (as a share of the greatest possible) for the largest
exponent that reaches it.

Weights become budgets of tokens.  Without a stated budget it is the smallest one
that gives every source one whole pass, so no document is lost and the small
sources are repeated.  A budget is realised as passes over the source's blocks,
each in its own permutation: whole passes take every block, the last pass takes
blocks in permuted order while they fit, then parts of the block at the cut in
order, then documents of the part at the cut.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearline.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: A stored table of so many narrow rows (about 50 MB) may be broadcast.
BROADCAST_ROWS = 500_000
MIX_COLUMNS = ("mix_epoch", "mix_block", "mix_rank", "mix_tokens", "mix_exponent", "mix_weight")


def word_count(text_col: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def shares(blocks: DataFrame) -> DataFrame:
    """Stored (source, tokens, p): p sums to one; sources without tokens have p = 0."""
    total = blocks.agg(F.sum("tokens")).first()[0] or 1
    by = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    return materialize(by.withColumn("p", F.col("tokens") / F.lit(float(total))), "mix-shares")


def _grid(table: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(exponent, entropy, most passes of a source when the least repeated has one) for each exponent."""
    live = table.where("p > 0").withColumn("a", F.explode(F.array(*[F.lit(x) for x in exponents])))
    w, lp = F.pow("p", F.col("a")), F.log("p")
    passes = F.pow("p", F.col("a") - 1)
    got = live.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * lp).alias("s"), (F.max(passes) / F.min(passes)).alias("r"))
    return sorted((r["a"], log(r["z"]) - r["a"] * r["s"] / r["z"], r["r"]) for r in got.collect())


def find_exponent(table: DataFrame, target_entropy: float | None = None, repeat_limit: float | None = None,
                  rounds: int = 4, probes: int = 64) -> float:
    """Exponent in [0, 1] that meets the target, to six decimals."""
    if (target_entropy is None) == (repeat_limit is None):
        raise ValueError("give either target_entropy or repeat_limit")
    n = table.where("p > 0").count()
    if n < 2:
        return 1.0
    greatest = log(n)

    def met(row) -> bool:
        return row[2] <= repeat_limit * (1 + 1e-12) if repeat_limit is not None else row[1] < target_entropy * greatest

    lo, hi = 0.0, 1.0  # met holds from some exponent upwards
    if met(_grid(table, [0.0])[0]):
        return 0.0
    for _ in range(rounds):
        rows = _grid(table, [lo + (hi - lo) * i / probes for i in range(probes + 1)])
        first = next((i for i, r in enumerate(rows) if met(r)), None)
        if first is None:
            return 1.0
        lo, hi = rows[max(0, first - 1)][0], rows[first][0]
    up = -(-hi * 1e6 // 1)
    return min(1.0, up / 1e6) if repeat_limit is not None else (lo * 1e6 // 1) / 1e6


def _beside(table: DataFrame, rows: int) -> DataFrame:
    """A counted table as the side of a join: broadcast up to ``BROADCAST_ROWS`` narrow rows, else as Spark plans it."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _cuts(turns: DataFrame, fine: DataFrame, narrow: DataFrame, sources: int) -> DataFrame:
    """Stored (s, b, epoch, last_part, last_place) of the turns that the budget cuts.

    Parts below ``last_part`` are taken whole, of that part the rows up to
    ``last_place`` (null: none).  Only sums by part, and sums by place inside
    the one part at the cut, pass through a window.
    """
    parts = fine.select(F.col("source").alias("fs"), F.col("block").alias("fb"), "part", "tokens")
    order = Window.partitionBy("s", "b", "epoch").orderBy("part")
    last = (turns.where("cut").join(parts, F.col("s").eqNullSafe(F.col("fs")) & (F.col("b") == F.col("fb")))
            .withColumn("after", F.sum("tokens").over(order))
            .where("after > left and after - tokens <= left")
            .select("s", "b", "epoch", F.col("part").alias("last_part"), F.expr("left - after + tokens").alias("room")))
    last = materialize(last, "mix-last-parts")
    inside = (narrow.join(_beside(last, sources), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
                          & (F.col("part") == F.col("last_part")))
              .groupBy("s", "b", "epoch", "room", "place").agg(F.sum("tokens").alias("tokens")))
    order = Window.partitionBy("s", "b", "epoch").orderBy("place")
    places = (inside.withColumn("used", F.sum("tokens").over(order)).where("used <= room")
              .groupBy(F.col("s").alias("ps"), F.col("b").alias("pb"), F.col("epoch").alias("pe")).agg(F.max("place").alias("last_place")))
    same = F.col("s").eqNullSafe(F.col("ps")) & (F.col("b") == F.col("pb")) & (F.col("epoch") == F.col("pe"))
    return materialize(last.join(places, same, "left").select("s", "b", "epoch", "last_part", "last_place"), "mix-cuts")


def temperature_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                    tokens=None, target_entropy: float | None = None, repeat_limit: float | None = 2.0,
                    budget_tokens: int | None = None, blocks: int = 1024, parts: int = 1024, seed: int = 7) -> DataFrame:
    """Every input column, once for each pass that takes the row, and the mixture's own columns.

    Adds mix_epoch (pass, from 0), mix_block, mix_rank (place of the block in
    that pass), mix_tokens, mix_exponent and mix_weight; input columns with such
    names are replaced.  ``tokens`` is a Column (default: words of the text).

    Null sources form one source of their own, apart from the empty name.  Null
    texts and texts without words have no tokens: they are in every whole pass.
    A row's place in its source is a hash of id and text, so rows with a null id
    spread by their text; rows equal in both share a place, stay together at the
    cut, and are kept as often as they occur.  Windows hold at most ``blocks``
    or ``parts`` sums of a source, or the places of one part of one block.  An
    empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in MIX_COLUMNS]
    count = word_count(text_col) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    place = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                       F.col(source_col).cast("string").alias("source"), count.alias("tokens"), place.alias("place"))
    base = (base.withColumn("block", F.pmod("place", F.lit(blocks)).cast("int"))
            .withColumn("part", F.pmod(F.shiftrightunsigned("place", 32), F.lit(parts)).cast("int")))
    fine = materialize(base.groupBy("source", "block", "part").agg(F.sum("tokens").alias("tokens")), "mix-parts")
    sums = materialize(fine.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    table = shares(sums)
    exponent = find_exponent(table, target_entropy, None if target_entropy is not None else repeat_limit)
    plan = table.withColumn("w", F.when(F.col("p") > 0, F.pow("p", F.lit(exponent))).otherwise(0.0))
    z, whole, sources = plan.agg(F.sum("w"), F.max(F.when(F.col("w") > 0, F.col("tokens") / F.col("w"))), F.count(F.lit(1))).first()
    z = z or 1.0
    budget = float(budget_tokens) if budget_tokens is not None else (whole or 0.0) * z
    plan = (plan.withColumn("weight", F.col("w") / F.lit(z))
            .withColumn("budget", F.round(F.col("w") * F.lit(budget / z)).cast("long"))
            .withColumn("passes", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1).cast("int"))
            .withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("passes") * F.col("tokens")).otherwise(0))
            .select("source", "weight", "passes", "rest"))
    # Blocks of each pass, in the order of that pass; the last pass ends at the budget.
    turns = (sums.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source"))).drop("s")
             .withColumn("epoch", F.explode(F.expr("sequence(0, if(rest > 0, passes, passes - 1))")))
             .where("epoch >= 0 and epoch <= passes"))
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64(F.lit(seed), "source", "epoch", "block"), "block")
    turns = (turns.withColumn("rank", F.row_number().over(order) - 1)
             .withColumn("after", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("left", F.col("rest") - F.col("after") + F.col("tokens"))
             .where("epoch < passes or left > 0")
             .withColumn("cut", F.expr("epoch = passes and left < tokens"))
             .select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "rank", "weight", "left", "cut"))
    turns = materialize(turns, "mix-turns")
    cuts = _cuts(turns, fine, base.drop("row"), sources)
    same = F.col("s").eqNullSafe(F.col("cs")) & (F.col("b") == F.col("cb")) & (F.col("epoch") == F.col("ce"))
    turns = (turns.join(cuts.select(F.col("s").alias("cs"), F.col("b").alias("cb"), F.col("epoch").alias("ce"), "last_part", "last_place"),
                        same, "left").drop("cs", "cb", "ce", "left"))
    inside = F.expr("not cut or part < last_part or (part = last_part and place <= last_place)")
    out = base.join(_beside(turns, turns.count()), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")) & inside)
    return out.select(*[F.col("row").getField(c).alias(c) for c in names],
                      F.col("epoch").alias("mix_epoch"), F.col("block").alias("mix_block"), F.col("rank").alias("mix_rank"),
                      F.col("tokens").alias("mix_tokens"), F.lit(exponent).alias("mix_exponent"), F.col("weight").alias("mix_weight"))
