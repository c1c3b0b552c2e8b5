"""Marts of the spending model: functions from staged tables to result tables.

Budget lines have: exhibit, fiscal_year (the edition), account, account_title, organization, budget_activity,
budget_activity_title, pe_bli, title, amount_type, amount_thousands, source_document_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.functions.lineage import partitions_of
from tallyspark.operators import aggregates as A
from tallyspark.operators import joins, picks

SUBTOTAL = "9999999999"  # a subtotal row, never a program

# Which amount slugs may hold a scenario, in order, and how many years before the edition they lie.
SCENARIOS = {
    ("PriorYear", 2): ["fy_%d_actuals", "fy_%d_base_oco", "fy_%d_actual"],
    ("CurrentYear", 1): [
        "fy_%d_total", "fy_%d_enacted", "fy_%d_total_enacted", "fy_%d_less_supplementals_enacted", "fy_%d_pb_request_with_cr_amounts",
        "fy_%d_pb_request_with_cr_adjustments", "fy_%d_enactment", "fy_%d_total_enacted_base_emerg_oco",
        "fy_%d_total_pb_requests_with_cr_adj_base_oco", "fy_%d_total_pb_requests_with_cr_adj_base_oco_saa",
        "fy_%d_total_pb_requests_with_cr_adj_base_oco_emergency",
    ],
    ("BudgetYearOne", 0): ["fy_%d_total", "fy_%d_disc_request", "fy_%d_request", "fy_%d_total_base_oco"],
    ("BudgetYearOneBase", 0): ["fy_%d_disc_request", "fy_%d_total", "fy_%d_request", "fy_%d_base"],
}
KINDS = {"PriorYear": "actuals", "CurrentYear": "enacted", "BudgetYearOne": "request"}


def scenario_candidates(editions: DataFrame) -> DataFrame:
    """(edition, scenario, priority, years_back, amount_type) for every edition; the patterns are literal rows."""
    rows = [(scenario, k, back, slug) for (scenario, back), slugs in SCENARIOS.items() for k, slug in enumerate(slugs, 1)]
    patterns = editions.sparkSession.createDataFrame(rows, "scenario string, priority int, years_back int, slug string")
    crossed = editions.select("edition").distinct().crossJoin(F.broadcast(patterns))  # literal rows
    return crossed.withColumn("amount_type", F.replace(F.col("slug"), F.lit("%d"), (F.col("edition") - F.col("years_back")).cast("string"))).drop("slug")


def budget_trajectory(lines: DataFrame, slots: list[str], preferred: DataFrame | None = None) -> DataFrame:
    """Three slots side by side per program and organisation, never summing two accounts in one slot.

    Keys whose newest slot has several accounts are split by account. Keys that collide in an older slot only keep
    the rows of one stable account. All others pass whole under their stable account. The stable account is one
    of ``preferred`` (pe_bli, account) first, then the one with most money. One exchange on the key serves every
    test, since all are windows over it.
    """
    slot = lines.where(F.col("amount_type").isin(*slots) & F.col("title").isNotNull()).groupBy("pe_bli", "organization", "amount_type", "account").agg(F.sum("amount_thousands").alias("amount"))
    known = F.lit(False)
    if preferred is not None:
        slot = slot.join(preferred.select("pe_bli", "account").distinct().withColumn("is_preferred", F.lit(True)), ["pe_bli", "account"], "left")
        known = F.coalesce("is_preferred", F.lit(False))
    key = Window.partitionBy("pe_bli", "organization")
    # the row count of a slot is its account count, as a slot holds one row an account
    counted = slot.withColumn("accounts", F.count("account").over(Window.partitionBy("pe_bli", "organization", "amount_type")))
    flagged = (
        counted.withColumn("splits", F.coalesce(F.max((F.col("amount_type") == slots[-1]) & (F.col("accounts") > 1) & (F.col("pe_bli") != SUBTOTAL)).over(key), F.lit(False)))
        .withColumn("collides", F.coalesce(F.max(F.col("accounts") > 1).over(key), F.lit(False)))
        .withColumn("account_total", F.sum("amount").over(Window.partitionBy("pe_bli", "organization", "account")))
        .withColumn("stable", F.first("account").over(key.orderBy(known.desc(), F.desc_nulls_last("account_total"), F.asc_nulls_last("account"))))
    )
    kept = flagged.where(F.col("splits") | ~F.col("collides") | (F.col("account") == F.col("stable")))
    named = kept.withColumn("account", F.when(F.col("collides"), F.col("account")).otherwise(F.coalesce("stable", "account")))
    wide = A.conditional_pivot(named, ["pe_bli", "organization", "account"], "amount_type", {s: s for s in slots}, "amount")
    titles = lines.where(F.col("account").isNotNull()).groupBy("account").agg(F.max("account_title").alias("account_title"))
    new, base = F.col(slots[-1]), F.col(slots[-2])
    return wide.join(titles, "account", "left").withColumn("change", new - base).withColumn("pct_change", A.pct_change(new, base))


def program_trajectory(trajectory: DataFrame, slots: list[str]) -> DataFrame:
    """Trajectory by program alone: organisations summed, but kept apart where a program has several in the newest slot."""
    several = F.count(F.when(F.col(slots[-1]).isNotNull(), F.col("organization"))).over(Window.partitionBy("pe_bli", "account")) > 1
    grain = trajectory.withColumn("organization", F.when(several, F.col("organization")))
    sums = grain.groupBy("pe_bli", "account", "organization").agg(*[F.sum(s).alias(s) for s in slots])
    return sums.withColumn("change", F.col(slots[-1]) - F.col(slots[-2])).withColumn("pct_change", A.pct_change(F.col(slots[-1]), F.col(slots[-2])))


def decade_series(lines: DataFrame, documents: DataFrame, anchor_edition: int, tolerance: float = 0.5) -> DataFrame:
    """Actuals, enacted and request per program and edition, withheld where the whole lake doesn't bear them out.

    Account and organisation stay in the grain only for programs that collide on them in the anchor edition. Of a
    scenario's candidate slugs the first with rows is taken. A sum of one row carries that row's fact id.
    """
    programs = lines.where(F.col("pe_bli") != SUBTOTAL)
    owners = ["account", "organization"]
    anchor = programs.where((F.col("fiscal_year") == anchor_edition) & F.col("title").isNotNull())
    slots = anchor.groupBy("pe_bli", "amount_type").agg(*[(F.countDistinct(c) > 1).alias(f"by_{c}") for c in owners])
    collides = slots.groupBy("pe_bli").agg(*[F.bool_or(f"by_{c}").alias(f"by_{c}") for c in owners])
    fact = S.fact_id(
        F.col("sha256"), F.col("exhibit"), F.col("fiscal_year"), F.col("account"), F.col("organization"), F.col("budget_activity"), F.col("pe_bli"), F.col("amount_type"), absent_as_empty=(5,)
    )
    # every pattern is a year and a word, so a slug meets its pattern by the word and how far its year lies back
    slug = lambda k: F.regexp_extract("amount_type", r"^fy_(\d{4})_(.+)$", k)
    words = [(w[len("fy_%d_"):], back, scenario, k) for (scenario, back), words in SCENARIOS.items() if scenario in KINDS for k, w in enumerate(words, 1)]
    patterns = lines.sparkSession.createDataFrame(words, "word string, years_back int, scenario string, priority int")
    dated = programs.withColumn("word", slug(2)).withColumn("years_back", F.col("fiscal_year") - slug(1).try_cast("int"))
    matched = dated.join(F.broadcast(patterns), ["word", "years_back"])  # a few literal rows
    hashes = documents.select(F.col("id").alias("source_document_id"), "sha256")
    known = matched.join(hashes, "source_document_id", "left").join(collides, "pe_bli", "left")

    # one aggregate gives each slug's sum in the details and in the whole lake
    is_detail = F.col("exhibit").isin("R-1", "P-1") & F.col("source_document_id").isNotNull()
    detail = lambda value: F.when(is_detail, value)
    sums = known.groupBy("pe_bli", F.col("fiscal_year").alias("edition"), "scenario", "priority", "years_back", "amount_type", *[F.when(F.col(f"by_{c}"), F.col(c)).alias(c) for c in owners]).agg(
        F.sum(detail(F.col("amount_thousands"))).alias("amount"), F.count(detail(F.lit(1))).alias("n_source_rows"), F.min(detail(fact)).alias("fact"),
        F.sum(F.when(F.col("exhibit") != "P-1R", F.col("amount_thousands"))).alias("lake_amount"),
    )
    # windows over one key: the first slug with details, and whether any slug's lake sum bears its amount out
    cell = Window.partitionBy("pe_bli", "account", "organization", "edition", "scenario")
    sums = sums.withColumn("first", F.min(F.when(F.col("n_source_rows") > 0, F.col("priority"))).over(cell))
    sums = sums.withColumn("chosen", F.max(F.when(F.col("priority") == F.col("first"), F.col("amount"))).over(cell))
    sums = sums.withColumn("borne_out", F.max(F.abs(F.col("lake_amount") - F.col("chosen")) <= tolerance).over(cell))
    return sums.where((F.col("priority") == F.col("first")) & F.col("borne_out")).select(
        "pe_bli", (F.col("edition") - F.col("years_back")).alias("fy"), "edition", S.recode(F.col("scenario"), KINDS).alias("kind"), "amount", "amount_type", "account", "organization", "n_source_rows",
        F.when(F.col("n_source_rows") == 1, F.col("fact")).alias("source_fact_id"),
    )


def book_diff(series: DataFrame) -> DataFrame:
    """A request against the next edition's request, and against the actuals of the same year two editions on."""
    usable = series.where(~S.is_line_key(F.col("pe_bli")))
    requests, actuals = (usable.where(F.col("kind") == k) for k in ("request", "actuals"))
    keys, values = ["pe_bli", "account", "organization"], ["fy", "amount", "amount_type", "source_fact_id"]
    next_request = joins.edition_join(requests, keys, "edition", 1, values).withColumn("diff_kind", F.lit("request_vs_request"))
    later_actual = joins.edition_join(requests, keys, "edition", 2, values, to_rows=actuals, also_equal=("fy",)).withColumn("diff_kind", F.lit("request_vs_actuals"))
    return next_request.unionByName(later_actual).withColumn("delta", F.col("to_amount") - F.col("from_amount"))


def gap_events(diffs: DataFrame, least: float = 50_000, pct: float = 25.0) -> DataFrame:
    """Requests whose actuals came out far off."""
    share = A.pct_change(F.col("to_amount"), F.col("from_amount"))
    return diffs.where((F.col("diff_kind") == "request_vs_actuals") & (F.col("from_amount") >= least)).withColumn("pct", share).where(F.abs("pct") >= pct)


def years_matrix(series: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per program and year with a cell per kind (amount and fact id); absent stays absent.

    The newest edition that reports a cell wins; an edition that reports it twice with different amounts is an error.
    """
    told = ["pe_bli", "account", "organization", "fy", "kind", "edition"]
    said_twice = F.raise_error(F.concat_ws(" ", F.lit("two amounts in one edition:"), *[F.col(c).cast("string") for c in told]))
    clash = F.min("amount").over(Window.partitionBy(*told)) != F.max("amount").over(Window.partitionBy(*told))
    series = series.withColumn("amount", F.when(clash, said_twice.cast(series.schema["amount"].dataType)).otherwise(F.col("amount")))
    latest = picks.pick_first(series, ["pe_bli", "account", "organization", "fy", "kind"], [F.desc("edition"), F.desc("amount")])
    cell = F.struct("amount", "source_fact_id", "edition")
    return latest.groupBy("pe_bli", "account", "organization", "fy").agg(*[F.max(F.when(F.col("kind") == k, cell)).alias(k) for k in kinds])


def flow_edges(lines: DataFrame, slot: str, labels: dict[str, str]) -> DataFrame:
    """Total, component, appropriation, budget activity and program as edges, in one pass of grouping sets."""
    rows = lines.where(F.col("title").isNotNull() & (F.col("amount_type") == slot))
    named = rows.select(
        F.coalesce(S.blank_to_null(F.col("organization")), F.lit("CLASSIFIED")).alias("component"), F.col("account").alias("appropriation"),
        F.coalesce("budget_activity", F.lit("?")).alias("budget_activity"), F.col("pe_bli").alias("program"), F.col("amount_thousands").alias("amount"),
    )
    edges = A.hierarchy_edges(named, ["component", "appropriation", "budget_activity", "program"], "amount")
    head = F.split("node_to", r"\|")[0]
    return edges.withColumn("component_label", S.recode(head, labels, head))


def spend_edges(contracts: DataFrame, xwalk: DataFrame) -> DataFrame:
    """The spend river: total, sub-agency, office and family by year, competition class and offers bucket, in one pass.

    contracts as ``staging.flow_contracts`` gives them. A family is the recipient's, else the fallback name, else its
    id. Family nodes are keyed by the family alone, so all offices that pay it meet there.
    """
    named = contracts.join(xwalk.select("recipient_uei", F.col("family_key").alias("known")), "recipient_uei", "left")
    rows = named.select("fiscal_year", "competed_class", "offers_bucket", "sub_agency", "office", F.coalesce("known", "recipient_fallback_name", "recipient_uei", F.lit("UNKNOWN RECIPIENT")).alias("family"), "obligation")
    split, levels = ["fiscal_year", "competed_class", "offers_bucket"], ["sub_agency", "office", "family"]
    sets = [[F.col(c) for c in split + levels[: k + 1]] for k in range(3)]
    sums = rows.groupingSets(sets, *split, *levels).agg(F.sum("obligation").alias("amount"), F.count("*").alias("line_count"), F.grouping_id(*split, *levels).alias("gid"))
    depth = 3 - F.bit_count("gid")
    office = F.concat_ws("|", "sub_agency", "office")
    at = lambda *names: F.element_at(F.array(*names), depth.cast("int"))
    return sums.select(
        "fiscal_year", at(F.lit("total"), F.lit("sub_agency"), F.lit("office")).alias("level_from"), at(F.lit("TOTAL"), F.col("sub_agency"), office).alias("node_from"),
        at(F.lit("sub_agency"), F.lit("office"), F.lit("family")).alias("level_to"), at(F.col("sub_agency"), office, F.col("family")).alias("node_to"), "competed_class", "offers_bucket", "amount", "line_count",
    )


def feed_events(
    trajectory: DataFrame, new: str, base: str, links: DataFrame, tx: DataFrame, xwalk: DataFrame, *,
    least_base: float = 50_000, swing_pct: float = 50.0, least_matched: float = 5_000_000, entrants_since: int = 2024, least_entrant: float = 1_000_000, entrants: int = 25,
) -> DataFrame:
    """Events for the feed: swings, lines set to zero, concentrations and new families, under one schema.

    A line is zeroed only where the newer book says 0, never where it says nothing.
    """
    programs = trajectory.where(F.col("pe_bli") != SUBTOTAL)
    none = F.lit(None).cast("string")
    event = lambda df, kind, pe, org, family, headline, comparison, pct, year: df.select(
        F.lit(kind).alias("event_type"), pe.alias("pe_bli"), org.alias("organization"), family.alias("family_key"), headline.cast("double").alias("headline_value"),
        comparison.cast("double").alias("comparison_value"), pct.cast("double").alias("pct_change"), year.cast("int").alias("fiscal_year"),
    )
    c, year = F.col, F.regexp_extract(F.lit(new), r"(\d{4})", 1).cast("int")
    swings = programs.where((c("organization") != "") & (c(base) >= least_base) & c(new).isNotNull() & (F.abs("pct_change") >= swing_pct))
    zeroed = programs.where((c(base) > 0) & (c(new) == 0))
    paid = tx.where("obligation > 0")
    linked = links.where("confidence = 'high'").select(c("award_piid").alias("award_id_piid"), "pe_bli").distinct()
    known = xwalk.select("recipient_uei", "family_key")
    members = paid.join(linked, "award_id_piid").join(known, "recipient_uei", "left").groupBy("pe_bli", "fiscal_year", F.coalesce("family_key", "recipient_uei").alias("family")).agg(F.sum("obligation").alias("dollars"))
    share = F.lit(100.0) * c("dollars") / F.sum("dollars").over(Window.partitionBy("pe_bli", "fiscal_year"))
    held = members.withColumn("share", share).groupBy("pe_bli", "fiscal_year").agg(F.sum(c("share") * c("share")).alias("hhi"), F.sum("dollars").alias("matched")).where(c("matched") >= least_matched)
    first = paid.join(known, "recipient_uei").groupBy("family_key").agg(F.min("fiscal_year").alias("first_fy"), F.sum("obligation").alias("dollars"))
    fresh = first.where((c("first_fy") >= entrants_since) & (c("dollars") >= least_entrant)).orderBy(F.desc("dollars"), "family_key").limit(entrants)
    return A.union_all(
        event(swings, "swing", c("pe_bli"), c("organization"), none, c(new), c(base), c("pct_change"), year), event(zeroed, "zeroed", c("pe_bli"), c("organization"), none, c(base), F.lit(0.0), none, year),
        event(held, "concentration", c("pe_bli"), none, none, F.round("hhi", 4), c("matched"), none, c("fiscal_year")), event(fresh, "entrant", none, none, c("family_key"), c("dollars"), c("first_fy"), none, c("first_fy")),
    )


def district_program_rows(tx: DataFrame, links: DataFrame) -> DataFrame:
    """A row for each transaction in a district and program that its award is linked to."""
    linked = links.where("confidence = 'high'").groupBy(F.col("award_piid").alias("award_id_piid"), "pe_bli").agg(F.min("program_title").alias("program_title"), F.min("organization").alias("organization"))
    return tx.where(F.col("pop_district").isNotNull()).join(linked, "award_id_piid")


def district_programs(tx: DataFrame, links: DataFrame) -> DataFrame:
    """Linked money by district and program; an award of two programs counts in both, so sums over programs overstate.

    Transactions (t), awards (a) and recipients (r) are told apart as rows of one narrow table, which Spark hashes; three distinct counts
    beside a smallest text would be sorted, with every row written four times. Names and money go with the awards, which are fewest.
    """
    grain = ["pop_state", "pop_district", "pe_bli"]
    text = lambda column, kind: F.col(column).cast("string").alias(kind)
    dealt = tx.repartition(partitions_of(tx.sparkSession), "award_id_piid")  # a number, so that tasks aren't merged by compressed size
    rows = district_program_rows(dealt, links).select(
        *grain, F.struct("program_title", "organization").alias("names"), "obligation", text("transaction_key", "t"), text("award_id_piid", "a"), text("recipient_uei", "r")
    )
    with_award = lambda column: F.when(F.col("kind") == "a", F.col(column)).alias(column)
    told = rows.unpivot([*grain, "names", "obligation"], ["t", "a", "r"], "kind", "key").select(*grain, "kind", "key", with_award("names"), with_award("obligation"))
    once = told.groupBy(*grain, "kind", "key", "names").agg(F.sum("obligation").alias("obligation"))
    counted = once.groupBy(*grain, "kind", "names").agg(F.count("key").alias("n"), F.sum("obligation").alias("obligation"))
    number = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    return counted.groupBy(*grain).agg(
        F.min("names.program_title").alias("program_title"), F.min("names.organization").alias("organization"), number("t").alias("transaction_count"),
        number("a").alias("award_count"), number("r").alias("recipient_count"), F.sum("obligation").alias("total_obligation"),
    )


def district_totals(tx: DataFrame, links: DataFrame) -> DataFrame:
    """Linked money by district, each award once however many programs it is linked to."""
    linked = links.where("confidence = 'high'").select(F.col("award_piid").alias("award_id_piid")).distinct()
    awards = tx.where(F.col("pop_district").isNotNull()).join(linked, "award_id_piid", "left_semi").groupBy("pop_state", "pop_district", "award_id_piid").agg(F.sum("obligation").alias("obligation"))
    return awards.groupBy("pop_state", "pop_district").agg(F.count("award_id_piid").alias("award_count"), F.sum("obligation").alias("total_obligation"))


def top_programs(programs: DataFrame, trajectory: DataFrame, value: str, n: int = 50) -> DataFrame:
    """The ``n`` programs (pe_bli, title, org, account) with most money of a slot, each by its own account's row."""
    named = programs.withColumn("organization", S.workbook_org(F.col("org")))
    found = joins.qualified_lookup(named, trajectory, ["pe_bli", "organization"], "account", value)
    return found.where(F.col(value).isNotNull()).orderBy(F.desc(value), "pe_bli", F.asc_nulls_first("account"), F.asc_nulls_first("title")).limit(n)


def budget_to_awards(links: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Links with their verdicts laid over: unadjudicated account+tokens links fall to medium; only high and medium appear."""
    verdicts = adjudications.select("award_piid", "pe_bli", "adjudicated_confidence")
    joined = links.join(verdicts, ["award_piid", "pe_bli"], "left")
    demoted = F.when((F.col("method") == "account+tokens") & (F.col("confidence") == "high"), "medium").otherwise(F.col("confidence"))
    return joined.withColumn("confidence", F.coalesce("adjudicated_confidence", demoted)).where(F.col("confidence").isin("high", "medium")).drop("adjudicated_confidence")


def program_concentration(links: DataFrame, tx: DataFrame, xwalk: DataFrame) -> DataFrame:
    """Concentration of recipient families over the awards of each program, each award's money once."""
    awards = tx.groupBy("award_id_piid", "recipient_uei").agg(F.sum("obligation").alias("dollars"))
    linked = links.where("confidence = 'high'").select(F.col("award_piid").alias("award_id_piid"), "pe_bli").distinct()
    named = awards.join(linked, "award_id_piid").join(xwalk.select("recipient_uei", "family_key"), "recipient_uei", "left")
    return A.concentration(named.withColumn("family", F.coalesce("family_key", "recipient_uei")), ["pe_bli"], "family", "dollars")


def state_per_capita(spend: DataFrame, categories: DataFrame, population: DataFrame) -> DataFrame:
    """Comparable categories by state and year over the population of the latest year not after it."""
    mapped = spend.join(categories.select("jurisdiction", F.col("raw_category").alias("category"), "comparable_category"), ["jurisdiction", "category"])
    sums = mapped.groupBy("jurisdiction", "comparable_category", "fiscal_year").agg(F.round(F.sum("amount_usd"), 2).alias("amount_usd"))
    people = population.select(F.col("state").alias("jurisdiction"), F.col("year"), "population")
    placed = joins.as_of_join(sums, people, ["jurisdiction"], "fiscal_year", "year", ["population"])
    both = placed.groupBy("comparable_category", "fiscal_year").agg(F.countDistinct("jurisdiction").alias("n")).where("n = 2")
    kept = placed.join(both, ["comparable_category", "fiscal_year"], "left_semi")
    return kept.withColumn("per_capita", F.round(F.try_divide(F.col("amount_usd"), F.nullif(F.col("population"), F.lit(0))), 2)).withColumnRenamed("as_of_time", "population_year")

OUT_OF_SCOPE = ("AllPriorYears", "BudgetYearOneOOC")  # scenarios that no control total covers


def dim_programs(lines: DataFrame, details: DataFrame, narratives: DataFrame, edition: int, current: str, prior: str) -> DataFrame:
    """One row per program, split by account or organisation only where its details or lines collide on them.

    Details reported in two volumes count once. The account comes from the details where these collide, else from
    the line whose prior-year amount equals the details' (within half a thousand dollars). Accounts of a colliding
    program that no detail reaches get a row of their own with the lines' title.
    """
    book = lines.where(F.col("fiscal_year") == edition)
    now = book.where((F.col("amount_type") == current) & F.col("title").isNotNull() & (F.col("pe_bli") != SUBTOTAL))
    several = lambda df, column: df.groupBy("pe_bli").agg((F.countDistinct(column) > 1).alias("hit")).where("hit").select("pe_bli")

    same = ["pe_bli", "project_number", "scenario", "amount_millions", "xml_path", "account"]
    once = details.where(F.col("fiscal_year") == edition).groupBy(*same).agg(F.max("org").alias("org"), F.max("exhibit_family").alias("exhibit_family"), F.bool_and("reconciled").alias("reconciled"))
    slots = now.select("pe_bli", F.col("organization").alias("slot_org")).distinct()
    by_org = several(now, "organization").withColumn("by_org", F.lit(True))
    by_account = several(once.where(F.col("account").isNotNull()), "account").withColumn("by_account", F.lit(True))
    flagged = once.join(by_org, "pe_bli", "left").join(by_account, "pe_bli", "left")
    placed = flagged.join(slots.withColumnRenamed("slot_org", "org").withColumn("slot_org", F.col("org")), ["pe_bli", "org"], "left")
    kept = placed.where(F.col("by_org").isNull() | F.col("slot_org").isNotNull())
    in_scope = ~F.col("scenario").isin(*OUT_OF_SCOPE)
    prior_row = (F.col("scenario") == "PriorYear") & F.col("project_number").isNull()
    programs = kept.groupBy("pe_bli", "slot_org", F.when(F.col("by_account"), F.col("account")).alias("detail_account")).agg(
        F.max("org").alias("org"), F.max("exhibit_family").alias("exhibit_family"), F.countDistinct("project_number").alias("project_count"),
        F.sum(F.when(prior_row, F.col("amount_millions"))).alias("prior_millions"), F.bool_and("reconciled").alias("fully_reconciled"),
        F.bool_and(F.when(in_scope, F.col("reconciled"))).alias("reconciled_in_scope"), F.first("by_org", ignorenulls=True).alias("by_org"),
    ).drop("slot_org")

    def scoped(account: Column, rows: DataFrame, columns: list[str]) -> tuple[DataFrame, Column]:
        renamed = rows.select(F.col("pe_bli").alias("b_pe"), F.col("account").alias("b_account"), F.col("organization").alias("b_org"), *[F.col(c).alias(f"b_{c}") for c in columns])
        on = (F.col("pe_bli") == F.col("b_pe")) & joins.optional_scope(account, F.col("b_account")) & (F.col("by_org").isNull() | (F.col("b_org") == F.col("org")))
        return renamed, on

    line_rows, on = scoped(F.col("detail_account"), book.where(F.col("amount_type") == prior), ["amount_thousands", "account_title"])
    near = F.abs(F.col("b_amount_thousands") / 1000.0 - F.col("prior_millions")) < 0.0005
    key = ["pe_bli", "org", "detail_account"]
    match = picks.pick_first(programs.join(line_rows, on & near), key, [F.asc("b_account"), F.asc("b_account_title")]).select(*key, F.col("b_account").alias("match_account"), F.col("b_account_title").alias("match_title"))
    known = joins.null_safe_join(programs, match, key, "left")
    titles = book.where(F.col("account").isNotNull()).groupBy("pe_bli", F.col("account").alias("detail_account")).agg(F.max("account_title").alias("own_title"))
    known = known.join(titles, ["pe_bli", "detail_account"], "left").select(
        "pe_bli", "org", "exhibit_family", "project_count", "prior_millions", "fully_reconciled", "reconciled_in_scope", "by_org",
        F.coalesce("detail_account", "match_account").alias("account"), F.coalesce("match_title", "own_title").alias("account_title"),
    )
    by_title = now.groupBy("pe_bli", "account", "organization", "title").agg(F.sum("amount_thousands").alias("k"))
    dominant = picks.pick_first(by_title, ["pe_bli", "account", "organization"], [F.desc("k"), F.asc("title")])
    grain = [c for c in known.columns if c != "by_org"]
    for name, rows in (("dominant", dominant), ("any_line", book)):
        found, on = scoped(F.col("account"), rows, ["title"])
        known = known.join(found, on, "left").groupBy(*known.columns).agg(F.max("b_title").alias(name))
    told = narratives.where((F.col("fiscal_year").cast("int") == edition) & F.col("title").isNotNull()).groupBy("pe_bli").agg(F.max("title").alias("told"))
    matched = known.join(told, "pe_bli", "left").select(*grain, F.coalesce("dominant", "any_line", "told").alias("title"))

    split = several(now, "account")
    open_slots = now.join(split, "pe_bli", "left_semi").groupBy("pe_bli", "account").agg(F.max("account_title").alias("account_title")).join(matched.select("pe_bli", "account"), ["pe_bli", "account"], "left_anti")
    own_lines = book.where(F.col("title").isNotNull()).groupBy("pe_bli", "account").agg(F.max("organization").alias("org"), F.max("title").alias("any_line"))
    best = dominant.groupBy("pe_bli", "account").agg(F.max("title").alias("dominant"))
    synthesised = open_slots.join(own_lines, ["pe_bli", "account"], "left").join(best, ["pe_bli", "account"], "left").select(
        "pe_bli", "org", F.lit(None).cast("string").alias("exhibit_family"), F.lit(0).cast("bigint").alias("project_count"), F.lit(None).cast("double").alias("prior_millions"),
        F.lit(None).cast("boolean").alias("fully_reconciled"), F.lit(None).cast("boolean").alias("reconciled_in_scope"), "account", "account_title", F.coalesce("dominant", "any_line").alias("title"),
    ).where(F.col("title").isNotNull())
    return matched.unionByName(synthesised)
