"""Joins that SQL models spell out by hand: fallbacks, scopes, tolerances, as-of, editions, lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.columns import unused
from tallyspark.functions.lineage import partitions_of
from tallyspark.operators.scans import last_known


def _and(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def specific_then_general(left: DataFrame, table: DataFrame, specific: list[str], general: list[str], values: list[str]) -> DataFrame:
    """Values of ``table`` by the specific keys, else by the general keys from its rows without a specific one.

    ``table`` holds general rows with a null in every key that isn't general.
    """
    extra = [k for k in specific if k not in general]
    exact = table.where(_and([F.col(k).isNotNull() for k in extra])).select(*specific, *[F.col(v).alias(f"exact_{v}") for v in values])
    wide = table.where(_and([F.col(k).isNull() for k in extra])).select(*general, *[F.col(v).alias(f"general_{v}") for v in values])
    joined = left.join(exact, specific, "left").join(wide, general, "left")
    return joined.select(*left.columns, *[F.coalesce(f"exact_{v}", f"general_{v}").alias(v) for v in values], F.col(f"exact_{values[0]}").isNotNull().alias("is_specific"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", *, also: Column | None = None) -> DataFrame:
    """Join on keys where null equals null. Columns of ``right`` other than its keys must not clash."""
    renamed = right.select(*[F.col(k).alias(f"right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = _and([F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys])
    joined = left.join(renamed, on if also is None else on & also, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"right_{k}" for k in keys])


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_value: Column, right_value: Column, tolerance: float, how: str = "inner", *, null_safe: bool = False) -> DataFrame:
    """Equal keys, and values less than ``tolerance`` apart; null values are near nothing.

    Values are put into bins, and a row meets only rows of its key in bins near its own: a key of many rows is spread over
    its bins, and costs what its rows near each other do. Where only the left rows are asked for (``left_semi``,
    ``left_anti``), a bin of the right side is its smallest and largest value, so no pair is made at all. For ``inner``
    and ``left`` the columns of both sides but the right keys are kept, and must not clash.
    """
    value, near, bin_, of_bin = (unused(left, stem) for stem in ("band_value", "band_near", "band_bin", "band_of_bin"))
    of_key = [f"right_{k}" for k in keys]
    same = [F.col(k).eqNullSafe(F.col(r)) if null_safe else F.col(k) == F.col(r) for k, r in zip(keys, of_key, strict=True)]
    only_left = how in ("left_semi", "left_anti")
    # two values less than the tolerance apart lie in bins of half of it that are two apart at most, and any two of one bin are
    # near; bins of twice the tolerance, a little wider for rounding, are met by a row of the other side in two
    width = tolerance / 2 if only_left else 2 * tolerance * (1 + 1e-6)
    place = lambda v: F.floor(v.cast("double") / F.lit(float(width)))
    binned = left.withColumn(value, left_value).withColumn(bin_, place(F.col(value)))
    named = right.select(*[F.col(k).alias(r) for k, r in zip(keys, of_key, strict=True)], *[c for c in right.columns if c not in keys], right_value.alias(near)).where(F.col(near).isNotNull())
    if not only_left:
        reach = [place(F.col(near).cast("double") + sign * tolerance * (1 + 1e-7)) for sign in (-1, 1)]
        copies = named.withColumn(of_bin, F.explode(F.sequence(*reach)))
        on = _and([*same, F.col(bin_) == F.col(of_bin), F.abs(F.col(value) - F.col(near)) < tolerance])
        return binned.join(copies, on, how).drop(value, near, bin_, of_bin, *of_key)
    ends = named.groupBy(*of_key, place(F.col(near)).alias(near + "_bin")).agg(F.min(near).alias("band_least"), F.max(near).alias("band_most"))
    copies = ends.withColumn(of_bin, F.explode(F.sequence(F.col(near + "_bin") - 2, F.col(near + "_bin") + 2)))
    is_near = (F.abs(F.col(value) - F.col("band_least")) < tolerance) | (F.abs(F.col(value) - F.col("band_most")) < tolerance) | (F.col(bin_) == F.col(near + "_bin"))
    return binned.join(copies, _and([*same, F.col(bin_) == F.col(of_bin), is_near]), how).drop(value, bin_)


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], *, share: int | None = None) -> DataFrame:
    """For each left row the values of the latest right row of its keys at or before it, else null.

    Both sides meet in one order by keys and time, and one pass carries the last right row forward, so no range join
    multiplies rows; a key with more rows than ``share`` is passed over in ranges. At equal times the right row
    counts; of right rows at one time the largest values win. A null time is no time: such a right row is never found,
    and a left row without a time finds none.
    """
    rights = right.where(F.col(right_time).isNotNull()).groupBy(*keys, right_time).agg(F.max(F.struct(*values)).alias("as_of_pick")).select(
        *keys, F.col(right_time).alias("as_of_at"), F.lit(0).alias("as_of_side"), F.struct(F.col(right_time).alias("as_of_time"), *[F.col(f"as_of_pick.{v}").alias(v) for v in values]).alias("as_of_row")
    )
    others = [c for c in left.columns if c not in keys]
    lefts = left.select(*keys, F.col(left_time).alias("as_of_at"), F.lit(1).alias("as_of_side"), F.struct(*others).alias("as_of_left"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    order = [F.col("as_of_at"), F.col("as_of_side")]
    found = last_known(both, keys, order, F.col("as_of_row"), "as_of_found", share=share).where("as_of_side = 1")
    return found.select(*keys, *[F.col(f"as_of_left.{c}").alias(c) for c in others], "as_of_found.as_of_time", *[f"as_of_found.{v}" for v in values])


def edition_join(rows: DataFrame, keys: list[str], edition: str, offset: int, values: list[str], *, to_rows: DataFrame | None = None, also_equal: tuple[str, ...] = ()) -> DataFrame:
    """Each row beside the row of the same (null-safe) keys ``offset`` editions later: from_* and to_* values."""
    later = rows if to_rows is None else to_rows
    start = rows.select(*keys, F.col(edition).alias("from_edition"), *[F.col(v).alias(f"from_{v}") for v in values], *[F.col(c).alias(f"from_same_{c}") for c in also_equal])
    end = later.select(*keys, F.col(edition).alias("to_edition"), *[F.col(v).alias(f"to_{v}") for v in values], *[F.col(c).alias(f"to_same_{c}") for c in also_equal])
    also = [F.col("to_edition") == F.col("from_edition") + offset, *[F.col(f"to_same_{c}") == F.col(f"from_same_{c}") for c in also_equal]]
    return null_safe_join(start, end, keys, also=_and(also)).drop(*[f"{side}_same_{c}" for side in ("from", "to") for c in also_equal])


def qualified_lookup(rows: DataFrame, table: DataFrame, keys: list[str], qualifier: str, value: str) -> DataFrame:
    """``rows`` with the table's value for their keys and qualifier; a null qualifier takes the keys' only row.

    A qualifier that the table lacks finds nothing, and so do keys without qualifier that have several rows: the value
    of another account is never borrowed.
    """
    exact = table.select(*keys, qualifier, F.col(value).alias("exact_value"))
    only = table.groupBy(*keys).agg(F.count("*").alias("only_rows"), F.max(value).alias("only_value")).where("only_rows = 1").drop("only_rows")
    joined = rows.join(exact, [*keys, qualifier], "left").join(only, keys, "left")
    return joined.select(*rows.columns, F.when(F.col(qualifier).isNull(), F.col("only_value")).otherwise(F.col("exact_value")).alias(value))


def fallback_chain(rows: DataFrame, lookups: list[tuple[DataFrame, list[str], str]], value: str) -> DataFrame:
    """``rows`` with the value of the first lookup (table, keys, column) that knows it, and which one that was, from 1.

    Each table has one row a key. Rows that no lookup knows keep a null; each step is one left join.
    """
    found = rows
    for k, (table, keys, column) in enumerate(lookups):
        found = found.join(table.select(*keys, F.col(column).alias(f"found_{k}")), keys, "left")
    names = [f"found_{k}" for k in range(len(lookups))]
    step = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(k + 1)) for k, n in enumerate(names)])
    return found.select(*rows.columns, F.coalesce(*names).alias(value), step.alias(f"{value}_step"))


def list_member_join(lines: DataFrame, awards: DataFrame, member: str, listed: str, separator: str = ";") -> DataFrame:
    """Rows whose delimited list holds the line's value, as one exploded equi join instead of a scan per line."""
    return lines.join(list_members(awards, member, listed, separator), member)


def list_members(rows: DataFrame, member: str, listed: str, separator: str = ";") -> DataFrame:
    """Each row once a different value of its delimited list."""
    return rows.withColumn(member, F.explode(F.array_distinct(F.transform(F.split(listed, separator), lambda x: F.trim(x)))))


def in_blocks(rows: DataFrame, member: str, size: int = 256) -> DataFrame:
    """Rows that are alike but for ``member``, in blocks of about ``size``: the other columns, and the members as an array."""
    alike = [c for c in rows.columns if c != member]
    keyed = rows.select(F.struct(*alike).alias("alike"), member)
    counted = keyed.groupBy("alike").agg(F.ceil(F.count("*") / size).alias("n_blocks"))
    placed = keyed.join(counted, "alike").withColumn("block", F.pmod(F.xxhash64(member), F.col("n_blocks")))
    return placed.groupBy("alike", "block").agg(F.collect_list(member).alias(member)).select("alike.*", member)


def pairs_of_alike(left: DataFrame, right: DataFrame, on: list[str], left_member: str, right_member: str, made: dict[str, Column], where: Column | None = None) -> DataFrame:
    """All pairs of rows with equal ``on``: on, both members, and what is ``made`` of the other columns.

    Rows that are alike but for their member meet once a block, so what is made costs as much as different rows meet; pairs
    are written out where their blocks meet, and none is shuffled. The columns of both sides but ``on`` must not clash.
    """
    tasks = 4 * partitions_of(left.sparkSession)  # meetings fall to tasks by hash: many small tasks even that out
    slices, meeting = slices_of_pairs(left, right, on, 4 * tasks), [*on, "left_slice", "right_slice"]
    own = lambda member, n: F.pmod(F.xxhash64(F.array_min(member), F.lit(member)), F.col(n))  # noqa: E731  the same in a rerun, however a block is ordered
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    lefts = in_blocks(left, left_member).join(slices, on).withColumn("left_slice", own(left_member, "left_slices")).withColumn("right_slice", every("right_slices"))
    rights = in_blocks(right, right_member).join(slices, on).withColumn("right_slice", own(right_member, "right_slices")).withColumn("left_slice", every("left_slices"))
    dealt = [blocks.drop("left_slices", "right_slices").repartition(tasks, *meeting) for blocks in (lefts, rights)]  # a number, so that tasks aren't merged by size
    met = dealt[0].join(dealt[1], meeting)
    met = (met if where is None else met.where(where)).select(*on, left_member, right_member, *[c.alias(name) for name, c in made.items()])
    # Spark holds all rows of an exploded row until they are read, so a block's pairs are written out piece by piece
    piece = met.withColumn(right_member, F.explode(pieces(right_member)))
    return piece.withColumn(left_member, F.explode(left_member)).withColumn(right_member, F.explode(right_member))


def pieces(members: str, size: int = 16) -> Column:
    """An array cut into arrays of ``size`` elements, the last with fewer."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(members), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda k: F.slice(members, k, size))


def slices_of_pairs(left: DataFrame, right: DataFrame, on: list[str], meetings: int, *, least: int = 1024) -> DataFrame:
    """(on, left_slices, right_slices): into how many slices each side of a key is cut, so that all pairs of all keys
    are about ``meetings`` meetings of two slices, or fewer of ``least`` rows a side.

    A slice has about as many rows as the root of a meeting's pairs, whatever its key's share. That root grows as the input
    does, so how often a row is copied to meet all slices of its key's other side doesn't grow.
    """
    sizes = left.groupBy(*on).agg(F.count("*").alias("n_left")).join(right.groupBy(*on).agg(F.count("*").alias("n_right")), on)
    rows = sizes.agg(F.greatest(F.lit(float(least)), F.sqrt(F.sum(F.col("n_left").cast("double") * F.col("n_right")) / meetings)).alias("rows"))
    cut = lambda n: F.ceil(F.col(n) / F.col("rows"))
    return sizes.join(F.broadcast(rows)).select(*on, cut("n_left").alias("left_slices"), cut("n_right").alias("right_slices"))  # one row


def optional_scope(scope: Column, value: Column) -> Column:
    """A join's residual that holds where the scope is null or equal to the value."""
    return scope.isNull() | (scope == value)


def counted_join(rows: DataFrame, counted: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join to a table with one row a key that says how many of the ``total`` rows hold it.

    Keys held by more rows than a shuffle partition's share would fill a task, so they are broadcast and their rows
    stay in place. As their counts sum to ``total``, there are no more such keys than shuffle partitions.
    """
    limit = max(1, total // partitions_of(rows.sparkSession))
    heavy = counted.where(F.col(count) > limit)
    hot = rows.join(F.broadcast(heavy), keys)
    cold = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(counted.where(F.col(count) <= limit), keys)
    return hot.unionByName(cold)
