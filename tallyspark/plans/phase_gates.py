"""Gates of the build: named tables of violations or figures, and one report over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.functions.lineage import written
from tallyspark.operators import aggregates as A
from tallyspark.operators import assertions as DQ
from tallyspark.operators import chains, gates, ledger, succession
from tallyspark.operators.graph import connected_components
from tallyspark.plans import marts, recompute


def report(spark: SparkSession, violations: dict[str, DataFrame], warnings: tuple[str, ...] = ()) -> DataFrame:
    """(gate, violations, severity, passed): an empty table passes; a warning is reported and never fails."""
    rows = spark.createDataFrame([], "gate string, violations bigint")
    for name, df in violations.items():
        rows = rows.unionByName(df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("gate"), "violations"))
    warns = F.col("gate").isin(*warnings) if warnings else F.lit(False)
    return rows.withColumn("severity", F.when(warns, "warn").otherwise("error")).withColumn("passed", warns | (F.col("violations") == 0))


def entity_gates(tx: DataFrame, xwalk: DataFrame, golden: DataFrame) -> dict[str, DataFrame]:
    """Resolved money at least 95 %, places at least 99 %, each golden company (name, family_key) in one family."""
    joined = tx.join(xwalk.select("recipient_uei", "family_key"), "recipient_uei", "left")
    failed = lambda df: df.where(~F.col("passed"))
    names = golden.select(S.normalized_name(F.col("name")).alias("normal_name")).distinct()
    seen = xwalk.select(S.normalized_name(F.col("recipient_name")).alias("normal_name"), "family_key").join(names, "normal_name", "left_semi")
    return {
        "resolved_money": failed(gates.share_gate(joined, F.col("family_key").isNotNull(), 0.95, weight="obligation")),
        "places": failed(gates.share_gate(tx, F.col("pop_state").isNotNull(), 0.99)),
        "golden_in_one_family": DQ.several_values(seen, ["normal_name"], "family_key"),
    }


def oversight_gates(payments: DataFrame, areas: DataFrame, concentrations: DataFrame, least_rows: int = 1) -> dict[str, DataFrame]:
    """Enough rows, 80 % of areas mapped, every index between 0 and 10,000."""
    floor = payments.agg(F.count("*").alias("n")).where(F.col("n") < least_rows)
    return {
        "payments_floor": floor,
        "areas_mapped": gates.share_gate(areas, F.col("mapped"), 0.8).where(~F.col("passed")),
        "hhi_range": DQ.breaks(concentrations, F.col("hhi").between(0, 10000)),
    }


def influence_gates(influence: DataFrame, families: DataFrame, mentions: DataFrame, filings: DataFrame, retiered: DataFrame, top: int = 50, least: float = 0.85) -> dict[str, DataFrame]:
    """Coverage of the largest families, tiers that still hold, no negative money, no orphan mention."""
    largest = families.orderBy(F.desc("total_obligation"), "family_key").limit(top)
    covered = largest.join(influence.select("family_key").distinct().withColumn("has", F.lit(True)), "family_key", "left")
    return {
        "top_families_covered": gates.share_gate(covered, F.coalesce("has", F.lit(False)), least).where(~F.col("passed")),
        "tier_holds": retiered.where(~F.col("tier").eqNullSafe(F.col("tier_now"))),
        "no_negative": influence.where("lobbying_total_usd < 0"),
        "mentions_have_filings": DQ.orphans(mentions, filings, ["filing_uuid"]),
        "families_known": DQ.orphans(influence, families, ["family_key"]),
    }


def mention_coverage(mentions: DataFrame, programs: DataFrame) -> DataFrame:
    """How many programs are mentioned at all, by evidence, beside all programs; orphaned mentions count as unknown."""
    named = mentions.select("pe_bli", "evidence").distinct().join(programs.select("pe_bli", F.lit(True).alias("is_known")).distinct(), "pe_bli", "left")
    total = programs.agg(F.countDistinct("pe_bli").alias("programs"))
    counts = named.groupBy("evidence").agg(F.count(F.when(F.col("is_known"), 1)).alias("mentioned"), F.count(F.when(F.col("is_known").isNull(), 1)).alias("unknown"))
    return counts.crossJoin(F.broadcast(total))  # one row


def state_gates(rows: DataFrame, categories: DataFrame, jurisdictions: list[str], least: int = 1) -> dict[str, DataFrame]:
    """Every state row has a source, and at least ``least`` (category, year) are comparable in all jurisdictions.

    rows: jurisdiction, category, fiscal_year, source_url; categories: jurisdiction, raw_category, comparable_category.
    """
    mapped = rows.join(categories.withColumnRenamed("raw_category", "category"), ["jurisdiction", "category"])
    both = A.both_present(mapped, ["comparable_category", "fiscal_year"], "jurisdiction", jurisdictions).select("comparable_category", "fiscal_year").distinct()
    return {
        "rows_sourced": rows.where(F.coalesce(F.trim("source_url"), F.lit("")) == ""),
        "comparable": both.agg(F.count("*").alias("n")).where(F.col("n") < least),
    }


def decade_gates(series: DataFrame, recomputed: DataFrame, editions: DataFrame) -> dict[str, DataFrame]:
    """Every edition is there, no year lies outside its edition's reach, and a recompute gives the same rows."""
    key = ["pe_bli", "fy", "edition", "kind", "account", "organization"]
    return {
        "edition_coverage": editions.select("edition").distinct().join(series.select("edition").distinct(), "edition", "left_anti"),
        "edition_leakage": DQ.breaks(series, F.col("fy").between(F.col("edition") - 2, F.col("edition"))),
        "grain_unique": DQ.not_unique(series, key),
        "recompute": DQ.symmetric_difference(series.select(*key, F.col("amount").cast("decimal(20,3)").alias("amount")), recomputed.select(*key, F.col("amount").cast("decimal(20,3)").alias("amount"))),
        "no_line_keys_in_diffs": marts.book_diff(series).where(S.is_line_key(F.col("pe_bli"))),
    }


def decade_gates_from_lake(series: DataFrame, lines: DataFrame, anchor_edition: int) -> dict[str, DataFrame]:
    """The decade gates with the recompute made from the lake by SQL of its own, and the diffs recomputed from that too."""
    # each is read by several gates, and made from all lines once
    series, again = written(series, "gated-series"), written(recompute.series(lines, anchor_edition), "recomputed-series")
    key = ["pe_bli", "account", "organization", "from_edition", "to_edition", "diff_kind", F.col("delta").cast("decimal(20,3)").alias("delta")]
    found = decade_gates(series, again, lines.select(F.col("fiscal_year").alias("edition")).join(again.select("edition").distinct(), "edition", "left_semi"))
    return found | {"diff_recompute": DQ.symmetric_difference(marts.book_diff(series).select(*key), recompute.diffs(again).select(*key))}


def store_gates(edges: DataFrame, chain_edges: DataFrame, narratives: DataFrame, points: DataFrame, facts: DataFrame, verdicts: DataFrame) -> dict[str, DataFrame]:
    """What a published lineage may not hold: forks in chains, money that isn't its fact's, edges that narratives take
    back or turn round later, seeded edges whose evidence is gone.

    points and facts: fact_id, amount; verdicts: fact_id, evidence_sentence, verdict.
    """
    forks = [DQ.not_unique(chain_edges.select(end), [end]).select(F.col(end).cast("string").alias("node")) for end in ("src", "dst")]
    standing = succession.drop_superseded(edges, narratives).select("src", "dst")
    seeded = verdicts.where("verdict = 'y'")
    return {
        "chains_one_to_one": forks[0].unionByName(forks[1]),
        "points_equal_facts": DQ.values_disagree(points, facts, ["fact_id"], "amount"),
        "no_retraction": edges.select("src", "dst").join(standing, ["src", "dst"], "left_anti"),
        "seed_ratified": seeded.join(gates.ratified_edges(seeded, narratives).select("fact_id", "evidence_sentence"), ["fact_id", "evidence_sentence"], "left_anti"),
    }


def badges(details: DataFrame, in_scope: list[str]) -> DataFrame:
    """(pe_bli, badge): reconciled if all of a program's details (pe_bli, scenario, reconciled) of scenarios in scope
    are, partial if one isn't or none is known to be; programs without such details have no badge."""
    own = details.where(F.col("scenario").isin(in_scope)).groupBy("pe_bli").agg(F.bool_and("reconciled").alias("all"))
    return own.select("pe_bli", F.when(F.col("all"), "reconciled").otherwise("partial").alias("badge"))


def site_gates(
    events: DataFrame, recomputed_events: DataFrame, edges: DataFrame, district_totals: DataFrame, district_awards: DataFrame, aliases: DataFrame, volumes: DataFrame, ingested: DataFrame,
    shown: DataFrame, details: DataFrame, in_scope: list[str], excluded: DataFrame, displayed: DataFrame,
) -> dict[str, DataFrame]:
    """What pages claim against recomputes: feed events, rivers, districts, aliases that lead to one program, volumes,
    badges, and the programs that pages leave out.

    district_awards: pop_state, pop_district, award_id_piid, total_obligation; aliases: alias, pe_bli; volumes and
    ingested: document_id, n_rows; shown: pe_bli, badge; details: pe_bli, scenario, reconciled; excluded and displayed:
    pe_bli, where each program of the details must be in just one.
    """
    listed = excluded.select("pe_bli", F.lit(1).alias("n")).distinct().unionByName(displayed.select("pe_bli", F.lit(1).alias("n")).distinct()).groupBy("pe_bli").agg(F.sum("n").alias("n"))
    programs = details.select("pe_bli").distinct().join(listed, "pe_bli", "full_outer")
    return {
        "feed_claims": DQ.symmetric_difference(events, recomputed_events),
        "rivers_conserve": DQ.flow_imbalance(edges),
        "districts_once": DQ.double_counted(district_totals, district_awards, ["pop_state", "pop_district"], "award_id_piid", "total_obligation"),
        "aliases_route": DQ.several_values(aliases, ["alias"], "pe_bli"),
        "volumes_ingested": DQ.values_disagree(volumes, ingested, ["document_id"], "n_rows"),
        "badges_hold": DQ.symmetric_difference(shown.select("pe_bli", "badge"), badges(details, in_scope)),
        "programs_placed_once": programs.where(F.coalesce("n", F.lit(0)) != 1),
    }


def lineage_gates(edges: DataFrame, narratives: DataFrame, families: DataFrame, stored: DataFrame) -> dict[str, DataFrame]:
    """Evidence verbatim, families exactly the components of the edges, store equal to the lake as a multiset."""
    found = connected_components(edges, "src", "dst")
    joined = families.select("node", "family").join(found, "node", "full_outer")
    # partitions are equal if each family meets one component and each component one family
    mixed = joined.groupBy("family").agg(F.countDistinct("component").alias("n"), F.count("component").alias("k")).where("n <> 1 OR family IS NULL")
    spread = joined.groupBy("component").agg(F.countDistinct("family").alias("n")).where("n <> 1")
    return {
        "evidence_verbatim": gates.evidence_breaks(edges, narratives),
        "family_partition": mixed.select(F.col("family").cast("string").alias("what")).unionByName(spread.select(F.col("component").cast("string").alias("what"))),
        "store_equals_lake": DQ.symmetric_difference(edges, stored),
    }


def reconciliation_gaps(lines: DataFrame, details: DataFrame, gaps: DataFrame, checks: DataFrame | None = None) -> dict[str, DataFrame]:
    """Programs neither detailed nor declared a gap, and details that failed a check without saying so."""
    listed = lines.where((F.col("pe_bli") != marts.SUBTOTAL) & F.col("title").isNotNull()).select("pe_bli").distinct()
    silent = details.where(F.col("reconciled").isNull())
    if checks is not None:
        # a detail that isn't reconciled needs a check of its own that failed
        key = ["document_id", "pe_bli", "scenario"]
        failed = checks.where(~F.col("passed")).select(*key).distinct()
        silent = silent.unionByName(details.where(~F.col("reconciled")).join(failed, key, "left_anti"))
    return {"uncovered": listed.join(details.select("pe_bli").unionByName(gaps.select("pe_bli")).distinct(), "pe_bli", "left_anti"), "silent_unreconciled": silent}


def roll_down(details: DataFrame, checks: DataFrame) -> DataFrame:
    """``reconciled`` per detail: true only where no check of its document, program and scenario failed, null where none ran."""
    key = ["document_id", "pe_bli", "scenario"]
    return details.drop("reconciled").join(checks.groupBy(*key).agg(F.bool_and("passed").alias("reconciled")), key, "left")


def chain_sums(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Money along each one-to-one chain: per root and year the sum of its nodes' points (pe_bli, fy, amount).

    The root is the node that nothing leads to; a cycle has none and stands under its smallest node.
    """
    placed = chains.one_to_one_chains(edges).select("node", "root")
    kept = chains.one_to_one_edges(edges).join(placed.select(F.col("node").alias("src")), "src", "left_anti")
    cycles = connected_components(kept, "src", "dst")
    placed = placed.unionByName(cycles.select("node", F.col("component").alias("root")))
    return points.join(placed.select(F.col("node").alias("pe_bli"), "root"), "pe_bli").groupBy("root", "fy").agg(F.sum("amount").alias("amount"), F.count("*").alias("nodes"))


def entity_windows(tx: DataFrame, starts: list[int], last: int) -> DataFrame:
    """Entity totals over each declared window of leading years, to reproduce a published total from its own text."""
    windows = tx.sparkSession.createDataFrame([(s, last) for s in starts], "first_fy int, last_fy int")
    joined = tx.join(F.broadcast(windows), F.col("fiscal_year").between(F.col("first_fy"), F.col("last_fy")))  # a few literal rows
    return joined.groupBy("recipient_uei", "first_fy", "last_fy").agg(F.sum("obligation").alias("obligation"))


def citation_sample(facts: DataFrame, derived: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A repeatable sample of ``n`` derived facts a kind with what recomputing them says."""
    from tallyspark.operators.picks import stratified_sample

    return ledger.verify_derived(stratified_sample(derived, ["operation"], ["fact_id"], n, seed), facts)


def export_disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """Facts (fact_id, value) that two exports both hold and give different values."""
    joined = a.select("fact_id", F.col("value").alias("left_value")).join(b.select("fact_id", F.col("value").alias("right_value")), "fact_id")
    return joined.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def excluded_coverage(lines: DataFrame, programs: DataFrame, top: int = 10) -> DataFrame:
    """The largest programs that a page leaves out, beside the share of money it covers."""
    return A.coverage(lines, programs, ["pe_bli"], "amount_thousands", top)
