"""Entity resolution: families of recipients from transactions and curated events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.scalars import blank_to_null, normalized_name
from tallyspark.operators.picks import pick_first


def pair_pick(tx: DataFrame, entity: str, pair: list[str], amount: str) -> DataFrame:
    """Per entity the whole pair with most money (then most rows, then smallest values), never a mix of two pairs."""
    sums = tx.groupBy(entity, *pair).agg(F.sum(amount).alias("pair_amount"), F.count("*").alias("pair_rows"))
    return pick_first(sums, [entity], [F.desc_nulls_last("pair_amount"), F.desc("pair_rows"), *[F.asc_nulls_last(c) for c in pair]])


def name_table(names: DataFrame, column: str) -> DataFrame:
    """Each distinct name beside its normal form, so the expressions run once a name."""
    return names.select(column).where(F.col(column).isNotNull()).distinct().withColumn("normal_name", normalized_name(F.col(column)))


def entity_crosswalk(tx: DataFrame, *, uei="recipient_uei", name="recipient_name", parent="parent_uei", parent_name="parent_name", amount="obligation") -> DataFrame:
    """One row per recipient id: total, dominant name, parent pair, family, method and confidence.

    The family is the normalised parent name, else the parent id, else the normalised own name, else the id; the
    first two are ``high``. A family that spans several parent ids is ``medium`` throughout.
    """
    rows = tx.where(blank_to_null(F.col(uei)).isNotNull())
    totals = rows.groupBy(uei).agg(F.sum(amount).alias("total_obligation"))
    names = rows.groupBy(uei, name).agg(F.sum(amount).alias("name_amount"))
    best_name = pick_first(names, [uei], [F.desc_nulls_last("name_amount"), F.asc_nulls_last(name)]).select(uei, name)
    pairs = pair_pick(rows.withColumns({parent: blank_to_null(F.col(parent)), parent_name: blank_to_null(F.col(parent_name))}), uei, [parent, parent_name], amount).select(uei, parent, parent_name)
    joined = totals.join(best_name, uei).join(pairs, uei)
    by_parent, by_name = F.nullif(normalized_name(F.col(parent_name)), F.lit("")), F.nullif(normalized_name(F.col(name)), F.lit(""))
    keyed = joined.withColumn(
        "family",
        F.when(by_parent.isNotNull(), F.struct(by_parent.alias("key"), F.lit("parent_name").alias("method")))
        .when(F.col(parent).isNotNull(), F.struct(F.col(parent).alias("key"), F.lit("parent_uei").alias("method")))
        .when(by_name.isNotNull(), F.struct(by_name.alias("key"), F.lit("recipient_name").alias("method")))
        .otherwise(F.struct(F.col(uei).alias("key"), F.lit("uei").alias("method"))),
    ).select("*", F.col("family.key").alias("family_key"), F.col("family.method").alias("method")).drop("family")
    spans = keyed.groupBy("family_key").agg(F.countDistinct(parent).alias("n_parents"))
    strong = F.col("method").isin("parent_name", "parent_uei") & (F.col("n_parents") <= 1)
    return keyed.join(spans, "family_key").withColumn("confidence", F.when(strong, "high").otherwise("medium")).drop("n_parents")


def resolve_families(events: DataFrame, known: DataFrame, *, key: str = "family_key") -> DataFrame:
    """Members (family, key, role) of curated rename and merger events, kept where the key is known."""
    ends = events.select(
        "family", "effective_date", F.explode(F.array(F.struct(F.lit("from").alias("role"), F.col("from_name").alias("name")), F.struct(F.lit("to").alias("role"), F.col("to_name").alias("name")))).alias("e")
    ).select("family", "effective_date", F.col("e.role").alias("role"), normalized_name(F.col("e.name")).alias(key))
    return ends.join(known.select(key).distinct(), key, "left_semi")


def conflicting_members(members: DataFrame, key: str = "family_key") -> DataFrame:
    """Keys that events put into more than one family; must be empty."""
    return members.groupBy(key).agg(F.countDistinct("family").alias("families")).where("families > 1")


def member_arrivals(members: DataFrame, anchors: DataFrame, key: str = "family_key") -> DataFrame:
    """When each member joined: its from-event first, else a to-event unless it is the anchor; earliest date."""
    flagged = members.join(anchors.select("family", F.col(key).alias("anchor")), "family", "left")
    usable = flagged.where((F.col("role") == "from") | (F.col(key) != F.coalesce("anchor", F.lit(""))))
    return pick_first(usable, ["family", key], [F.asc("role"), F.asc_nulls_last("effective_date")]).drop("anchor")


def family_rollup(rows: DataFrame, membership: DataFrame, *, key="family_key", amount="amount", confidence="confidence") -> DataFrame:
    """Members folded into one row a curated family, with the worst confidence by rank and the largest member."""
    named = rows.join(membership.select(key, "family"), key, "left").withColumn("family", F.coalesce("family", key))
    rank = F.when(F.col(confidence) == "high", 1).when(F.col(confidence) == "medium", 2).otherwise(3)
    folded = named.groupBy("family").agg(
        F.sum(amount).alias(amount), F.count("*").alias("members"), F.max(F.struct(rank.alias("r"), confidence)).alias("w"), F.max_by(key, F.struct(amount, key)).alias("largest_member")
    )
    return folded.select("family", amount, "members", F.col(f"w.{confidence}").alias("worst_confidence"), "largest_member")


def display_labels(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities under their curated display name where there is one (aliases: family_key, display_name)."""
    named = entities.join(aliases.select("family_key", F.col("display_name").alias("curated_name")), "family_key", "left")
    return named.withColumn("display_name", F.coalesce("curated_name", "display_name")).drop("curated_name")


def display_alias_defects(aliases: DataFrame, entities: DataFrame, sourced: list[str], unsourced: list[str], least_note: int = 40) -> DataFrame:
    """(family_key, defect) of curated names that can't stand; must be empty.

    aliases: family_key, display_name, evidence, source_url, source_date, measured_on, note. Evidence of the ``sourced``
    kinds has an https source no later than the measurement, that of the ``unsourced`` kinds has none.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = aliases.withColumn("times", F.count("*").over(Window.partitionBy("family_key")))
    known = entities.select("family_key", F.lit(True).alias("is_known")).distinct()
    rows = rows.join(known, "family_key", "left")
    has_source = F.col("evidence").isin(*sourced)
    defects = {
        "blank": blank("family_key") | blank("display_name") | blank("evidence") | blank("note") | blank("measured_on"),
        "unknown evidence": ~F.col("evidence").isin(*sourced, *unsourced),
        "two names": F.col("times") > 1,
        "no lower-case letter": ~F.col("display_name").rlike("[a-z]"),
        "source missing": has_source & (blank("source_url") | ~F.col("source_url").startswith("https://") | blank("source_date")),
        "source without document": ~has_source & ~(blank("source_url") & blank("source_date")),
        "measured before its source": has_source & (F.col("measured_on") < F.col("source_date")),
        "short note": F.char_length("note") < least_note,
        "unknown family": F.col("is_known").isNull(),
    }
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in defects.items()]))
    return rows.select("family_key", F.explode(found).alias("defect")).distinct()


def family_loss(rows: DataFrame, folded: DataFrame, amount: str = "amount") -> DataFrame:
    """What a rollup lost: totals and members before and after, if they differ; must be empty."""
    before = rows.agg(F.sum(amount).alias("total_before"), F.count("*").alias("members_before"))
    after = folded.agg(F.sum(amount).alias("total_after"), F.sum("members").alias("members_after"))
    return before.crossJoin(after).where(~F.col("total_before").eqNullSafe(F.col("total_after")) | ~F.col("members_before").eqNullSafe(F.col("members_after")))  # one row each


def best_claim(claims: DataFrame, filing: str, tier_rank: str, weight: str, family: str) -> DataFrame:
    """One claim a filing: the strongest tier, ties to the larger family, then by name."""
    return pick_first(claims, [filing], [F.asc(tier_rank), F.desc_nulls_last(weight), F.asc(family)])


def top_names(tx: DataFrame, family: str, name: str, amount: str, n: int = 2) -> DataFrame:
    """The ``n`` names with most money per family."""
    sums = tx.groupBy(family, name).agg(F.sum(amount).alias(amount))
    place = F.row_number().over(Window.partitionBy(family).orderBy(F.desc(amount), F.asc(name)))
    return sums.withColumn("place", place).where(F.col("place") <= n)
