"""Joins and running values over keys that may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from kgspark.session import Scratch, unused

#: A key is hot when it holds more than one row in SHARE, so fewer than SHARE keys are hot, whatever the input's size.
SHARE = 1000


def with_share(counts: DataFrame, n: str, share: int = SHARE) -> DataFrame:
    """counts (one row a key, n: its rows) with `hot`: whether the key holds more than one row in `share`. Fewer than `share` keys do."""
    total = counts.agg(F.sum(n).alias("kg_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("hot", F.col(n) * share > F.col("kg_total")).drop("kg_total")


def join_one(left: DataFrame, right: DataFrame, on: list[str], share: int = SHARE) -> DataFrame:
    """left with the columns of right's row of the same key, or nulls where right has none (rows with a null key too). right: one row a key at most.

    right's rows of hot keys of left are broadcast, fewer than `share` of them; the other keys are shuffled and hold at most one row in `share` each.
    """
    there = F.lit(True)
    for c in on:
        there = there & F.col(c).isNotNull()
    keyed = left.where(there)
    counts = with_share(keyed.groupBy(*on).agg(F.count("*").alias("kg_n")), "kg_n", share)
    hot = F.broadcast(counts.where("hot").select(*on))
    cold = keyed.join(hot, on, "left_anti").join(right, on, "left")
    warm = keyed.join(hot, on, "left_semi").join(F.broadcast(right.join(hot, on, "left_semi")), on, "left")
    rest = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns if c not in on]
    bare = left.where(~there).select(*[F.col(c) for c in left.columns], *rest)
    names = cold.columns
    return cold.unionByName(warm.select(*names)).unionByName(bare.select(*names))


def running(s: Scratch, df: DataFrame, key: str, order: list[str], values: dict[str, tuple[str, Callable[[Column], Column]]], name: str, totals: dict[str, str] | None = None) -> DataFrame:
    """df with running values along each key's rows in `order` (this row included): values maps a new column to (column, aggregate); totals maps one to a column whose sum over the key it holds.

    The aggregate must be associative (sum or bit_xor). Rows are dealt by ranges of (key, order), so a key of any size spreads over
    many tasks; each slice is summed up by itself, and one row a slice and key carries what earlier slices of the key hold. Rows equal in
    key and order are told apart arbitrarily.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = unused("kg_slice", df)
    sliced = s.write(df.repartitionByRange(n, key, *order).withColumn(part, F.spark_partition_id()), name)
    inside = Window.partitionBy(part, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spans = sliced.groupBy(part, key).agg(*[agg(F.col(c)).alias(f"kg_before_{k}") for k, (c, agg) in values.items()], *[F.sum(c).alias(f"kg_before_{k}") for k, c in (totals or {}).items()])
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(part, key, *[agg(F.col(f"kg_before_{k}")).over(earlier).alias(f"kg_before_{k}") for k, (_, agg) in values.items()], *[F.sum(f"kg_before_{k}").over(Window.partitionBy(key)).alias(k) for k in totals or {}])
    got = sliced.withColumns({k: agg(F.col(c)).over(inside) for k, (c, agg) in values.items()}).join(spans, [part, key])
    plus = {k: _joined(agg, F.col(k), F.col(f"kg_before_{k}")) for k, (_, agg) in values.items()}
    return got.withColumns(plus).select(*df.columns, *values, *(totals or {}))


def _joined(agg: Callable[[Column], Column], here: Column, before: Column) -> Column:
    if agg is F.bit_xor:
        return here.bitwiseXOR(F.coalesce(before, F.lit(0).cast("bigint")))
    if agg is F.sum:
        return here + F.coalesce(before, F.lit(0))
    raise ValueError("running values are sums or bit_xor")
