"""Mixing sources to target weights, with DataFrame operations alone.

Every document gets a hash-random key; within its source, documents are ranged by that key into
buckets of the key's leading bits, so that no task holds a whole source however large. Prefix sums
of token counts are the sums of all earlier buckets (a small table of one row per source and
bucket) plus a running sum inside the bucket. A document is taken whole once for each full epoch
of its source, and once more as far as the prefix sum stays inside what is left of the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix as a share of all sizes, in halves (3/2), and the epochs at which a source stops.
SHARE_HALVES, EPOCHS = 3, 2
#: Rows that one bucket of keys aims at.
PER_BUCKET = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Shares 150 % of all sizes by weight; targets stop at twice the source's size and the excess
    is shared again by weight until none is above: the fixed point fills sources in the order of
    limit / weight. Sources are few against documents; this table alone is ordered in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    choose = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    out = sizes.withColumn("w", choose.cast("long")).withColumn("cap", EPOCHS * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every) * SHARE_HALVES / F.lit(2.0)
    out = out.withColumn("left_", total - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_left", F.sum("w").over(rest))
    out = out.withColumn("capped", F.col("cap") * F.col("w_left") <= F.col("w") * F.col("left_"))
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.coalesce("source", F.lit("")), "left_", "w_left"))).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level.left_") / F.col("level.w_left"))
    return out.withColumn("level", first).select("source", "source_size", target.alias("target"))


def document_key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target (its source's), taken.

    A null text has size 0; a null source is a source of its own, ordered last; a null doc_id has
    the empty key. Rows that tie on key and source are ordered by doc_id and size; equal rows are
    interchangeable. A source whose words are 0 gets target 0. An empty table gives no rows. The
    words taken of a source are its target rounded down; no document exceeds twice its size.
    Reruns agree, since keys depend on ids alone. Other columns of docs are not read.
    """
    base = docs.select("doc_id", "source", word_count("text").alias("size"), document_key(seed).alias("key"))
    held = Stash(base, "sizes")
    stash = held.df
    rows = stash.count()
    digits = 1
    while 16**digits * PER_BUCKET < rows and digits < 8:
        digits += 1
    stash = stash.withColumn("bucket", F.substring("key", 1, digits + 1))
    per_bucket = stash.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("offset", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)))
    targets = source_targets(stash.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    small = per_bucket.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    small = small.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "offset", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    out = stash.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(small, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    budget = F.floor("target").cast("long")
    epochs = F.coalesce(F.expr("div(cast(floor(target) as bigint), nullif(source_size, 0))"), F.lit(0))
    more = budget - epochs * F.col("source_size") - (F.col("offset") + F.col("inner"))
    taken = F.col("size") * epochs + F.greatest(F.lit(0), F.least(F.col("size"), more))
    out = Stash(out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken")), "mix")
    held.drop()
    return out.df
