"""Data-quality assertions: each returns the rows that violate it, so an empty result passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """Grains that occur more than once; nulls are equal."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def is_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def not_accepted(df: DataFrame, column: str, values: list) -> DataFrame:
    """Values outside the list, with their counts; null is not a violation."""
    return df.where(~F.col(column).isin(*values)).groupBy(column).count()


def orphans(df: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    return df.join(parent.select(*key).distinct(), key, "left_anti")


def totals_differ(a: DataFrame, b: DataFrame, keys: list[str], value: str, *, absolute: float = 0.0, relative: float = 0.0) -> DataFrame:
    """Keys whose sums differ by more than the larger of the two tolerances, or that one side lacks."""
    left = a.groupBy(*keys).agg(F.sum(value).alias("left_total"))
    right = b.groupBy(*keys).agg(F.sum(value).alias("right_total"))
    both = left.join(right, keys, "full_outer")
    allowed = F.greatest(F.lit(float(absolute)), F.abs("right_total") * F.lit(float(relative)))
    return both.where(F.col("left_total").isNull() | F.col("right_total").isNull() | (F.abs(F.col("left_total") - F.col("right_total")) > allowed))


def values_disagree(df: DataFrame, parent: DataFrame, keys: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """Rows whose parent is missing or holds another value; two nulls agree, null keys are equal."""
    right = parent.select(*[F.col(k).alias(f"right_{k}") for k in keys], F.col(value).alias("parent_value"), F.lit(True).alias("has_parent"))
    joined = df.join(right, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys]), "left").drop(*[f"right_{k}" for k in keys])
    same = F.coalesce(F.abs(F.col(value) - F.col("parent_value")) <= tolerance, F.col(value).isNull() & F.col("parent_value").isNull())
    return joined.where(F.col("has_parent").isNull() | ~same).drop("has_parent")


def double_counted(totals: DataFrame, rows: DataFrame, keys: list[str], unit: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """Totals that differ from their rows' with every unit taken once a key, however often it is listed."""
    once = rows.groupBy(*keys, unit).agg(F.max(value).alias("unit_value")).groupBy(*keys).agg(F.sum("unit_value").alias("true_value"))
    return totals.join(once, keys, "full_outer").where(~F.coalesce(F.abs(F.col(value) - F.col("true_value")) <= tolerance, F.lit(False)))


def weak_evidence(mentions: DataFrame, kinds: list[str], stop: list[str], evidence: str = "evidence", matched: str = "matched") -> DataFrame:
    """Mentions whose evidence is of no accepted kind, or one of whose matched terms is a stop word; must be empty."""
    terms = F.transform(F.split(F.coalesce(matched, F.lit("")), r"\|"), lambda t: F.upper(F.trim(t)))
    return mentions.where(~F.coalesce(F.col(evidence).isin(*kinds), F.lit(False)) | F.arrays_overlap(terms, F.array(*map(F.lit, stop))))


def flow_imbalance(edges: DataFrame, value: str = "amount") -> DataFrame:
    """Inner nodes where what comes in differs from what goes out; roots and leaves are left out."""
    into = edges.groupBy(F.col("node_to").alias("node")).agg(F.sum(value).alias("value_in"))
    out = edges.groupBy(F.col("node_from").alias("node")).agg(F.sum(value).alias("value_out"))
    return into.join(out, "node").where("value_in <> value_out")


def several_values(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """Keys that resolve to more than one value."""
    return df.groupBy(*key).agg(F.countDistinct(column).alias("n_values")).where("n_values > 1")


def breaks(df: DataFrame, holds: Column) -> DataFrame:
    """Rows where a condition is false or unknown."""
    return df.where(~F.coalesce(holds, F.lit(False)))


def differs_from_pins(df: DataFrame, pins: DataFrame, keys: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """Pinned values that the table lacks or holds differently."""
    joined = pins.withColumnRenamed(value, "pinned").join(df.select(*keys, value), keys, "left")
    return joined.where(F.col(value).isNull() | (F.abs(F.col(value) - F.col("pinned")) > tolerance))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (as a multiset) that only one table has, with the side that has them."""
    return a.exceptAll(b.select(a.columns)).withColumn("side", F.lit("left")).unionByName(b.select(a.columns).exceptAll(a).withColumn("side", F.lit("right")))
