"""Ordered scans of keys of any size: the last value known, the row before.

A window puts all rows of a key into one task. Keys with more rows than ``share`` are scanned in ranges instead: their rows
are range-partitioned and sorted by (key, order), each range of a key is scanned by its own task, and what a range has to know
from those before it comes from a scan over one row a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.columns import unused
from tallyspark.functions.lineage import partitions_of, written

LEAST_SHARE = 500_000


def _same(names: list[str], others: list[str]) -> Column:
    """Keys that are equal, null to null."""
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(names, others, strict=True)])


def hot_keys(df: DataFrame, keys: list[str], share: int | None = None) -> tuple[DataFrame, bool]:
    """Keys with more rows than ``share``, by default a shuffle partition's share of all rows, and whether there are any.

    As their rows sum to all rows, there are no more of them than partitions.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = share or max(LEAST_SHARE, (total or 0) // partitions_of(df.sparkSession))
    return counts.where(F.col("n") > limit).select(*keys), (most or 0) > limit


def last_known(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, *, before: bool = False, share: int | None = None) -> DataFrame:
    """``df`` with ``name``: the last value that isn't null at each row of its key or earlier, or only earlier (``before``).

    ``order`` should tell a key's rows apart; rows that are equal in it stand in any order. A null key is a key. The
    result doesn't depend on ``share``.
    """
    end = -1 if before else Window.currentRow
    hot, any_hot = hot_keys(df, keys, share)
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    if not any_hot:
        return df.withColumn(name, F.last(value, ignorenulls=True).over(within))
    of_key = [unused(df, f"hot_{k}") for k in range(len(keys))]
    named = F.broadcast(hot.toDF(*of_key))  # no more than partitions
    cold = df.join(named, _same(keys, of_key), "left_anti").withColumn(name, F.last(value, ignorenulls=True).over(within))
    return cold.unionByName(_in_ranges(df.join(named, _same(keys, of_key), "left_semi"), keys, order, value, name, end))


def _in_ranges(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, end: int) -> DataFrame:
    came, row, part, held, local, carried, of_part = (unused(df, stem) for stem in ("came", "row", "part", "held", "local", "carried", "of_part"))
    of_key = [unused(df, f"of_key_{k}") for k in range(len(keys))]
    # rows that are equal in keys and order are dealt by where they come from, so they may lie in several ranges
    numbered = df.withColumns({held: F.struct(value.alias("v")), came: F.monotonically_increasing_id()})
    by = [*[F.col(k) for k in keys], *order, F.col(came)]
    placed = numbered.repartitionByRange(partitions_of(df.sparkSession), *by).sortWithinPartitions(*by)
    placed = written(placed.withColumn(row, F.monotonically_increasing_id()).withColumn(part, F.shiftright(row, 33)), "scan-ranges")
    known = F.when(F.col(held)["v"].isNotNull(), F.col(held))
    in_range = Window.partitionBy(part, *keys).orderBy(row).rowsBetween(Window.unboundedPreceding, end)
    scanned = placed.withColumn(local, F.last(known, ignorenulls=True).over(in_range))
    last = placed.groupBy(part, *keys).agg(F.max_by(F.col(held), F.when(F.col(held)["v"].isNotNull(), F.col(row))).alias(carried))
    over = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range and key
    ahead = last.withColumn(carried, F.last(carried, ignorenulls=True).over(over)).select(F.col(part).alias(of_part), *[F.col(k).alias(n) for k, n in zip(keys, of_key, strict=True)], carried)
    joined = scanned.join(ahead, (F.col(part) == F.col(of_part)) & _same(keys, of_key))
    return joined.withColumn(name, F.coalesce(local, carried)["v"]).select(*[c for c in df.columns if c != name], name)
