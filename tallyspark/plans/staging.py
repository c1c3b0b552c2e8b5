"""Staging of the all-text landing, and the small dimensions over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import aggregates as A
from tallyspark.operators import picks

HARD_CAP = 50_000_000_000.0  # no subaward is larger

# Competition classes by the extent that a contract reports.
COMPETITION = {
    "FULL AND OPEN COMPETITION": "full_and_open",
    "FULL AND OPEN COMPETITION AFTER EXCLUSION OF SOURCES": "set_aside",
    "COMPETED UNDER SAP": "other_than_full",
    "FOLLOW ON TO COMPETED ACTION": "other_than_full",
    "COMPETITIVE DELIVERY ORDER": "other_than_full",
}


def _blank(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _number(name: str) -> Column:
    return F.col(name).try_cast("double")


def award_transactions(contracts: DataFrame, assistance: DataFrame) -> DataFrame:
    """Contracts and assistance under one schema, united by name. A state is a code in one and a name in the other."""

    def typed(rows: DataFrame, kind: str, key: str, state: str, award: Column, unique: str, naics: Column, psc: Column) -> DataFrame:
        return rows.select(
            F.col(key).alias("transaction_key"), F.lit(kind).alias("award_type"), F.col("action_date").try_cast("date").alias("action_date"), F.col("fy").cast("int").alias("fiscal_year"),
            _number("federal_action_obligation").alias("obligation"), _blank("recipient_uei").alias("recipient_uei"), F.upper("recipient_name").alias("recipient_name"),
            _blank("recipient_parent_uei").alias("recipient_parent_uei"), F.upper("recipient_parent_name").alias("recipient_parent_name"), "awarding_agency_name", "awarding_sub_agency_name",
            naics.alias("naics_code"), psc.alias("product_or_service_code"), F.col(state).alias("pop_state"),
            F.col("prime_award_transaction_place_of_performance_cd_current").alias("pop_district"), award.alias("award_id_piid"), "usaspending_permalink", F.col(unique).alias("award_unique_key"),
        )

    none = F.lit(None).cast("string")
    first = typed(contracts, "contract", "contract_transaction_unique_key", "primary_place_of_performance_state_code", _blank("award_id_piid"), "contract_award_unique_key", F.col("naics_code"), F.col("product_or_service_code"))
    second = typed(assistance, "assistance", "assistance_transaction_unique_key", "primary_place_of_performance_state_name", none, "assistance_award_unique_key", none, none)
    return first.unionByName(second)


def flow_contracts(contracts: DataFrame) -> DataFrame:
    """Contracts with competition class, offers bucket and the name to fall back on."""
    return contracts.select(
        F.col("fy").cast("int").alias("fiscal_year"), F.coalesce(_blank("awarding_sub_agency_name"), F.lit("UNKNOWN SUB-AGENCY")).alias("sub_agency"),
        F.coalesce(_blank("awarding_office_name"), F.lit("UNKNOWN OFFICE")).alias("office"), _blank("recipient_uei").alias("recipient_uei"),
        F.upper(F.coalesce(_blank("recipient_parent_name"), _blank("recipient_name"))).alias("recipient_fallback_name"),
        S.recode(F.col("extent_competed"), COMPETITION, F.lit("not_competed")).alias("competed_class"), S.offers_bucket(F.col("number_of_offers_received")).alias("offers_bucket"),
        _number("federal_action_obligation").alias("obligation"),
    )


def subawards(rows: DataFrame) -> DataFrame:
    """Subawards with a suspect flag; rows are kept. An unknown amount leaves the flag unknown."""
    amount, ceiling = _number("subaward_amount"), _number("prime_award_amount")
    suspect = (amount > HARD_CAP) | (amount.isNotNull() & ceiling.isNotNull() & (amount > ceiling))
    return rows.select(
        "prime_award_unique_key", amount.alias("subaward_amount"), ceiling.alias("prime_award_ceiling"), F.col("subaward_action_date").try_cast("date").alias("subaward_action_date"),
        F.col("fy").cast("int").alias("fiscal_year"), _blank("subawardee_uei").alias("subawardee_uei"), F.upper("subawardee_name").alias("subawardee_name"), suspect.alias("is_amount_suspect"),
    )


def budget_lines(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"fiscal_year": F.col("fiscal_year").try_cast("int"), "amount_thousands": _number("amount_thousands"), "source_document_id": F.col("source_document_id").try_cast("int")})


def budget_details(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"fiscal_year": F.col("fiscal_year").try_cast("int"), "amount_millions": _number("amount_millions"), "document_id": F.col("document_id").try_cast("int"), "reconciled": S.is_true(F.col("reconciled"))})


def mts_outlays(rows: DataFrame) -> DataFrame:
    """Monthly outlays as they come."""
    return rows


def entity_xwalk(rows: DataFrame) -> DataFrame:
    """The crosswalk with its money as a number."""
    return rows.select("recipient_uei", "recipient_name", "parent_uei", "parent_name", "family_key", "method", "confidence", _number("total_obligation").alias("total_obligation"))


def family_obligations_by_year(tx: DataFrame, xwalk: DataFrame) -> DataFrame:
    joined = tx.join(xwalk.select("recipient_uei", "family_key"), "recipient_uei")
    return joined.groupBy("family_key", "fiscal_year").agg(F.sum("obligation").alias("total_obligation"), F.count("*").alias("transaction_count"), F.countDistinct("recipient_uei").alias("uei_count"))


def state_budget(rows: DataFrame) -> DataFrame:
    """Budget rows beside their department's total of the year; totals' own rows and rows without department are left out.

    One window serves both, so the rows are shuffled once.
    """
    kept = rows.where((F.coalesce("is_total", F.lit("False")) == "False") & F.col("department").isNotNull() & F.col("fiscal_year").isNotNull())
    total = F.sum("amount_usd").over(Window.partitionBy("department", "fiscal_year"))
    named = kept.withColumn("amount_usd", _number("amount_usd")).withColumn("recomputed_dept_total_usd", total)
    return named.select("department", "agency", "category", "fund", "fiscal_year", "amount_usd", "source_url", "recomputed_dept_total_usd")


def state_checkbook(rows: DataFrame, jurisdiction: str) -> DataFrame:
    """Checkbook payments (all text) summed by department, category and year, to the cent."""
    sums = rows.groupBy("department", "category", "fiscal_year").agg(F.sum(F.col("amount_usd").try_cast("decimal(38,2)")).alias("amount_usd"))
    return sums.select(F.lit(jurisdiction).alias("jurisdiction"), "department", "category", "fiscal_year", F.col("amount_usd").cast("string").alias("amount_usd"))


def dim_recipients(tx: DataFrame) -> DataFrame:
    return tx.where(F.col("recipient_uei").isNotNull()).groupBy("recipient_uei").agg(
        F.max("recipient_name").alias("recipient_name"), F.max("recipient_parent_name").alias("recipient_parent_name"), F.sum("obligation").alias("total_obligation"),
        F.count("*").alias("transactions"), F.min("fiscal_year").alias("first_fy"), F.max("fiscal_year").alias("last_fy"),
    )


def dim_geography(tx: DataFrame) -> DataFrame:
    return tx.groupBy("pop_state", "pop_district").agg(F.sum("obligation").alias("obligation"), F.count("*").alias("transactions"))


def dim_entities(xwalk: DataFrame) -> DataFrame:
    """Families with the name of the member with most money. ``worst_confidence`` is the smallest text, so a mixed
    family reports ``high``; ``entities.family_rollup`` ranks instead."""
    return xwalk.groupBy("family_key").agg(
        F.max_by("recipient_name", F.struct("total_obligation", "recipient_uei")).alias("display_name"), F.count("*").alias("members"), F.sum("total_obligation").alias("total_obligation"), F.min("confidence").alias("worst_confidence")
    )


def dim_lobbyists(lobbyists: DataFrame) -> DataFrame:
    """One row a name: the position most often given, filings, and whether any real position was given."""
    real = F.col("covered_position").isNotNull() & (F.col("covered_position") != "") & (F.upper("covered_position") != "N/A")
    counts = lobbyists.where(F.coalesce("name", F.lit("")) != "").groupBy("name", "covered_position").agg(F.count("*").alias("n")).withColumn("is_real", real)
    best = Window.partitionBy("name").orderBy(F.desc("is_real"), F.desc("n"), F.asc_nulls_last("covered_position"))
    ranked = counts.withColumn("best", F.first("covered_position").over(best))
    return ranked.groupBy("name").agg(F.max("best").alias("covered_position"), F.sum("n").alias("filings_count"), F.bool_or("is_real").alias("revolving_door"))


def dim_program_titles(lines: DataFrame, edition: int, slot: str) -> DataFrame:
    """The title of each program's largest line of a slot, other lines after it."""
    rows = lines.where((F.col("fiscal_year") == edition) & F.col("pe_bli").isNotNull() & F.col("title").isNotNull())
    amount = F.when(F.col("amount_type") == slot, F.col("amount_thousands"))
    return picks.pick_first(rows, ["pe_bli"], [amount.desc_nulls_last(), F.asc("title")]).select("pe_bli", "title")


def improper_exposure(payments: DataFrame) -> DataFrame:
    """Improper payments per agency from each program's latest year, with the outlay-weighted rate."""
    latest = F.max("fiscal_year").over(Window.partitionBy("agency_code", "program"))
    rows = payments.where(F.coalesce("agency_code", F.lit("")) != "").withColumn("latest", latest).where("fiscal_year = latest")
    sums = rows.groupBy("agency_code").agg(
        F.countDistinct("program").alias("program_count"), F.sum("derived_improper_amount_usd").alias("derived_improper_amount_usd"), F.sum("outlays_usd").alias("outlays"), F.max("fiscal_year").alias("latest_fiscal_year")
    )
    return sums.withColumn("weighted_rate_pct", F.when(F.col("outlays") > 0, F.round(100.0 * F.col("derived_improper_amount_usd") / F.col("outlays"), 4))).drop("outlays")


def influence(filings: DataFrame, entities: DataFrame) -> DataFrame:
    """Lobbying money by family and year over matched filings, beside the family's total (which must not be summed)."""
    kept = filings.where((F.coalesce("family_key_guess", F.lit("")) != "") & (F.coalesce("match_method", F.lit("none")) != "none"))
    money = lambda c: F.coalesce(F.sum(_number(c)), F.lit(0.0))
    sums = kept.groupBy(F.col("family_key_guess").alias("family_key"), "filing_year").agg(F.count("*").alias("filings_count"), money("income_usd").alias("lobbying_income_usd"), money("expenses_usd").alias("lobbying_expense_usd"))
    named = sums.join(entities.select("family_key", "display_name", F.col("total_obligation").alias("family_obligations_usd")), "family_key", "left")
    return named.withColumn("lobbying_total_usd", F.col("lobbying_income_usd") + F.col("lobbying_expense_usd"))


def program_lobbying(mentions: DataFrame, filings: DataFrame, activities: DataFrame) -> DataFrame:
    """Mentions beside their filing, taken once (a filing may be listed twice), and its issue areas."""
    once = picks.pick_first(filings, ["filing_uuid"], [F.desc("filing_year"), F.asc_nulls_last("client_name"), F.asc_nulls_last("registrant_name")])
    issues = activities.groupBy("filing_uuid").agg(F.array_join(F.array_sort(F.collect_set("issue_display")), "; ").alias("issues"))
    return mentions.join(once, "filing_uuid", "left").join(issues, "filing_uuid", "left")


def fy26_split(lines: DataFrame, slots: dict[str, str]) -> DataFrame:
    """Base, added and total of a year with the added share and the like-for-like change; null without a base."""
    wide = A.conditional_pivot(lines, ["pe_bli"], "amount_type", slots, "amount_thousands")
    share = F.round(F.try_divide(F.lit(100.0) * F.col("added"), F.nullif(F.col("total"), F.lit(0.0))), 2)
    return wide.withColumn("added_share_pct", share).withColumn("like_for_like_pct", A.pct_change(F.col("base"), F.col("prior")))


def retitle(lines: DataFrame, overrides: DataFrame) -> DataFrame:
    """Curated titles, applied only while the source still has the title they were written for."""
    table = overrides.select("pe_bli", F.col("source_title").alias("title"), "new_title")
    return lines.join(table, ["pe_bli", "title"], "left").withColumn("title", F.coalesce("new_title", "title")).drop("new_title").select(lines.columns)
