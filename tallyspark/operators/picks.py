"""Picking rows: one per group by a total order, priorities, margins, samples, latest, carry-forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.scans import last_known


def pick_first(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; the order must be total for the result to be the same every time."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("pick_place", place).where(F.col("pick_place") <= n).drop("pick_place")


def first_with_rows(candidates: DataFrame, rows: DataFrame, on: list[str], keys: list[str], priority: str) -> DataFrame:
    """Of the candidates of a key, the one of smallest priority that has rows."""
    return pick_first(candidates.join(rows, on), keys, [F.asc(priority)])


def winner_margin(df: DataFrame, group: list[str], member: str, value: str, digits: int = 4) -> DataFrame:
    """First and second member of a group and ``(first - second) / first``; null without a second."""
    sums = df.groupBy(*group, member).agg(F.sum(value).alias("v"))
    top = pick_first(sums, group, [F.desc("v"), F.asc(member)], 2)
    w = Window.partitionBy(*group).orderBy(F.desc("v"), F.asc(member))
    led = top.withColumn("second_value", F.lead("v").over(w)).withColumn("runner_up", F.lead(member).over(w)).withColumn("p", F.row_number().over(w))
    margin = F.round(F.try_divide((F.col("v") - F.col("second_value")).cast("double"), F.nullif(F.col("v"), F.lit(0)).cast("double")), digits)
    return led.where("p = 1").select(*group, F.col(member).alias("winner"), "runner_up", margin.alias("margin"))


def stratified_sample(df: DataFrame, strata: list[str], key: list[str], n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows a stratum, by an MD5 of the seed and the key: the same rows in every run and every engine."""
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return pick_first(df, strata, [drawn, *[F.col(k) for k in key]], n)


def carry_forward(df: DataFrame, keys: list[str], order: str, value: str, name: str, *, share: int | None = None) -> DataFrame:
    """The last known value at or before each row, as a section header holds for the lines under it."""
    return last_known(df, keys, [F.col(order)], F.col(value), name, share=share)


def previous_period(df: DataFrame, keys: list[str], period: str, value: str, name: str, *, share: int | None = None) -> DataFrame:
    """The value of the period just before; null where that period is missing. A key has a row a period."""
    found = last_known(df, keys, [F.col(period)], F.struct(F.col(period).alias("at"), F.col(value).alias("v")), name, before=True, share=share)
    return found.withColumn(name, F.when(F.col(name)["at"] == F.col(period) - 1, F.col(name)["v"]))


def upsert(standing: DataFrame, batch: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """Rows by key: the batch wins unless the standing row's method ranks above (a smaller rank)."""
    both = standing.withColumn("is_batch", F.lit(0)).unionByName(batch.withColumn("is_batch", F.lit(1)))
    others = [c for c in standing.columns if c not in keys]
    return pick_first(both.withColumn("method_rank", rank), keys, [F.asc("method_rank"), F.desc("is_batch"), *[F.asc(c) for c in others]]).drop("is_batch", "method_rank")
