"""Aggregations: concentration, pivots, collisions, hierarchies, top-N with a rest, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.lineage import partitions_of


def pct_change(new: Column, base: Column, digits: int = 2) -> Column:
    """Change in per cent; null where the base is null or 0."""
    return F.round(F.try_divide(F.lit(100.0) * (new - base), F.nullif(base, F.lit(0))), digits)


def conditional_pivot(df: DataFrame, keys: list[str], column: str, values: dict[str, object], amount: str) -> DataFrame:
    """One summed column per named value; absent stays null."""
    return df.groupBy(*keys).agg(*[F.sum(F.when(F.col(column) == v, F.col(amount))).alias(n) for n, v in values.items()])


def concentration(df: DataFrame, group: list[str], member: str, value: str, *, digits: int = 4) -> DataFrame:
    """Herfindahl index of positive members per group (0 to 10,000), members, net total and the top member.

    Members are summed first, so the index needs one more shuffle of (group, member) rows only.
    """
    members = df.groupBy(*group, member).agg(F.sum(value).alias("member_value"))
    w = Window.partitionBy(*group)
    positive = F.when(F.col("member_value") > 0, F.col("member_value"))
    shares = members.withColumn("positive_total", F.sum(positive).over(w)).withColumn("share", F.try_divide(positive.cast("double"), F.col("positive_total").cast("double")))
    first = Window.partitionBy(*group).orderBy(F.desc("member_value"), F.asc(member))
    ranked = shares.withColumn("place", F.row_number().over(first))
    return ranked.groupBy(*group).agg(
        F.round(F.coalesce(F.sum(F.col("share") * F.col("share")), F.lit(0.0)) * 10000, digits).alias("hhi"),
        F.count(positive).alias("members"),
        F.sum("member_value").alias("net_total"),
        F.max(F.when(F.col("place") == 1, F.col(member))).alias("top_member"),
        F.max(F.when(F.col("place") == 1, F.col("member_value"))).alias("top_value"),
    )


def collisions(df: DataFrame, key: list[str], slot: list[str], owner: str) -> DataFrame:
    """Keys that have more than one distinct owner within one slot."""
    return df.groupBy(*key, *slot).agg(F.countDistinct(owner).alias("owners")).where("owners > 1").select(*key).distinct()


def regrain(df: DataFrame, key: list[str], slot: list[str], owner: str, value: str) -> DataFrame:
    """Sums by key and slot, with the owner kept in the grain only where the key collides, else null.

    Rows are dealt by key before anything is grouped: grains are nearly as many as rows, so a map that combines them before the
    shuffle would hold a whole input split. That one exchange serves all groupings. A null key doesn't collide.
    """
    dealt = df.select(*key, *slot, owner, value).repartition(partitions_of(df.sparkSession), *key)  # a number, so that tasks aren't merged by compressed size
    sums = dealt.groupBy(*key, *slot, owner).agg(F.sum(value).alias(value), F.count("*").alias("n_rows"))
    owners = sums.withColumn("owners", F.count(owner).over(Window.partitionBy(*key, *slot)))
    marked = owners.withColumn("collides", F.max(F.col("owners") > 1).over(Window.partitionBy(*key)))
    collides = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key], F.col("collides"))
    return marked.groupBy(*key, *slot, F.when(collides, F.col(owner)).alias(owner)).agg(F.sum(value).alias(value), F.sum("n_rows").alias("n_rows"))


def hierarchy_edges(df: DataFrame, levels: list[str], value: str, root: str = "TOTAL") -> DataFrame:
    """Edges between successive levels with sums and counts, in one pass of grouping sets.

    Node keys are paths (``a|b|c``); null level values count as ``?``.
    """
    filled = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in levels], F.col(value).alias("edge_value"))
    sets = [[F.col(c) for c in levels[: k + 1]] for k in range(len(levels))]
    grouped = filled.groupingSets(sets, *levels).agg(F.sum("edge_value").alias("amount"), F.count("*").alias("line_count"), F.grouping_id(*levels).alias("gid"))
    depth = len(levels) - F.bit_count("gid")
    path = lambda n: F.array_join(F.slice(F.array(*levels), 1, n), "|")
    names = F.array(F.lit("total"), *[F.lit(c) for c in levels])
    return grouped.select(
        F.element_at(names, depth.cast("int")).alias("level_from"),
        F.when(depth == 1, F.lit(root)).otherwise(path((depth - 1).cast("int"))).alias("node_from"),
        F.element_at(names, (depth + 1).cast("int")).alias("level_to"),
        path(depth.cast("int")).alias("node_to"),
        "amount",
        "line_count",
    )


def top_n_other(df: DataFrame, group: list[str], key: str, value: str, n: int, other: str = "Other") -> DataFrame:
    """The n largest keys a group (ties by key) and one row for the rest, so that totals are conserved."""
    sums = df.groupBy(*group, key).agg(F.sum(value).alias(value))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(value), F.asc(key)))
    shown = sums.withColumn("shown", F.when(place <= n, F.col(key).cast("string")).otherwise(F.lit(other)))
    return shown.groupBy(*group, F.col("shown").alias(key)).agg(F.sum(value).alias(value), F.count("*").alias("members"))


def top_n_levels(leaves: DataFrame, levels: list[str], value: str, n: int, *, shown: int = 12, other: str = "Other") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a river of levels in which each level keeps its ``n`` largest nodes and folds the rest into one.

    Node keys are paths (``a|b``), ranked by value, ties by key. A rest node counts its members, lists the ``shown``
    largest of them and the value of those it doesn't list. Edges run through the rest nodes, so every level's values and
    every node's edges sum to the same total. Only the ``n`` kept keys a level are sent to the rows.
    """
    paths = [f"path_{k}" for k in range(len(levels))]
    routes = [f"route_{k}" for k in range(len(levels))]
    whole = leaves.groupBy(*levels).agg(F.sum(value).alias("leaf"))
    rows = whole.select("leaf", *[F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in levels[: k + 1]]), "|").alias(p) for k, p in enumerate(paths)])
    nodes = None
    for level, path, route in zip(levels, paths, routes, strict=True):
        sums = rows.groupBy(F.col(path).alias("node")).agg(F.sum("leaf").alias("value"))
        top = sums.orderBy(F.desc("value"), "node").limit(n)  # n rows
        keep = F.broadcast(top.select(F.col("node").alias(path), F.lit(True).alias("is_top")))
        rest = sums.join(F.broadcast(top.select("node")), "node", "left_anti")
        first = rest.orderBy(F.desc("value"), "node").limit(shown).agg(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("rank"), "node"))).alias("listed"), F.sum("value").alias("listed_value"))
        rest = rest.agg(F.count("*").alias("members"), F.sum("value").alias("value")).where("members > 0").crossJoin(first)  # one row each
        kept = top.select(F.lit(level).alias("level"), "node", "value", F.lit(1).cast("bigint").alias("members"), F.lit(None).cast("string").alias("listed"), (F.col("value") * 0).alias("omitted_value"))
        folded = rest.select(F.lit(level).alias("level"), F.lit(other).alias("node"), "value", "members", F.array_join(F.transform("listed", lambda x: x["node"]), ";").alias("listed"), (F.col("value") - F.coalesce("listed_value", F.lit(0))).alias("omitted_value"))
        nodes = kept.unionByName(folded) if nodes is None else nodes.unionByName(kept).unionByName(folded)
        rows = rows.join(keep, path, "left").withColumn(route, F.when(F.col("is_top"), F.col(path)).otherwise(F.lit(other))).drop("is_top")
    steps = F.array(*[F.struct(F.lit(a).alias("level_from"), f.alias("node_from"), F.lit(b).alias("level_to"), t.alias("node_to")) for a, f, b, t in zip(["total", *levels], [F.lit("TOTAL"), *map(F.col, routes)], levels, map(F.col, routes), strict=False)])
    edges = rows.groupBy(*routes).agg(F.sum("leaf").alias("leaf")).select("leaf", F.explode(steps).alias("e")).groupBy("e.level_from", "e.node_from", "e.level_to", "e.node_to").agg(F.sum("leaf").alias("amount"))
    return nodes, edges


def latest_weighted_rate(df: DataFrame, key: list[str], period: str, part: str, whole: str, digits: int = 4) -> DataFrame:
    """part / whole of each key's latest period, weighted by the whole; null where the whole is 0."""
    latest = F.max(period).over(Window.partitionBy(*key))
    rows = df.withColumn("latest", latest).where(F.col(period) == F.col("latest"))
    return rows.groupBy(*key, F.col("latest").alias(period)).agg(
        F.sum(whole).alias(whole), F.round(F.try_divide(F.sum(part).cast("double"), F.nullif(F.sum(whole), F.lit(0)).cast("double")), digits).alias("rate")
    )


def both_present(df: DataFrame, key: list[str], side: str, sides: list) -> DataFrame:
    """Rows of the keys that occur on all the sides."""
    kept = df.where(F.col(side).isin(*sides)).groupBy(*key).agg(F.countDistinct(side).alias("n")).where(F.col("n") == len(sides)).select(*key)
    return df.where(F.col(side).isin(*sides)).join(kept, key, "left_semi")


def share_of(value: str, partition: list[str], digits: int = 6) -> Column:
    """A row's share of its partition's sum; null for a sum of 0."""
    total = F.sum(value).over(Window.partitionBy(*partition))
    return F.round(F.try_divide(F.col(value).cast("double"), F.nullif(total, F.lit(0)).cast("double")), digits)


def coverage(df: DataFrame, covered: DataFrame, key: list[str], value: str, top: int = 10) -> DataFrame:
    """The largest uncovered keys beside the covered share in per cent, floored so that it reaches 100 only at all."""
    sums = df.groupBy(*key).agg(F.sum(value).alias(value))
    flagged = sums.join(covered.select(*key).distinct().withColumn("is_covered", F.lit(True)), key, "left")
    total = flagged.agg(F.sum(value).alias("all_value"), F.sum(F.when(F.col("is_covered"), F.col(value))).alias("covered_value"))
    pct = (F.floor(F.coalesce("covered_value", F.lit(0)) * 1000 / F.nullif(F.col("all_value"), F.lit(0))) / 10).alias("covered_pct")
    largest = flagged.where(F.col("is_covered").isNull()).orderBy(F.desc(value), *key).limit(top).select(*key, value)
    return largest.crossJoin(F.broadcast(total.select(pct)))  # one row


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
