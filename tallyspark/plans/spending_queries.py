"""Queries that run the spending model's own functions over awards, books and states made of the provided tables.

Awards are order lines: the order is the award, the supplier the recipient, the part's brand the program. The SQL says
each rule again by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import assertions as DQ
from tallyspark.plans import marts, phase_gates, staging
from tallyspark.plans.driver_tables import BUDGET_LINES, LINES, ORACLE_SQL, _budget_lines, _lines, _query

c = F.col


def _text(column: str | Column) -> Column:
    return (c(column) if isinstance(column, str) else column).cast("string")


def _tx(t) -> DataFrame:
    """Award transactions made of order lines."""
    orders = t("orders").join(t("customer"), c("o_custkey") == c("c_custkey"))  # first, so that lines aren't shuffled by customer
    rows = _lines(t).join(orders, c("l_orderkey") == c("o_orderkey")).join(t("supplier"), c("l_suppkey") == c("s_suppkey"))
    return rows.select(
        F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber")).alias("transaction_key"), F.concat(F.lit("A"), _text("l_orderkey")).alias("award_id_piid"), _text("l_suppkey").alias("recipient_uei"),
        F.upper("s_name").alias("recipient_name"), F.concat(F.lit("P"), _text(c("c_nationkey") % 4)).alias("recipient_parent_name"), c("ship_year").alias("fiscal_year"), c("cents").alias("obligation"),
        F.concat(F.lit("S"), _text("c_nationkey")).alias("pop_state"), F.when(c("c_custkey") % 10 != 0, F.concat(F.lit("D"), _text(c("c_custkey") % 7))).alias("pop_district"),
    )


TX = f"""(SELECT l_orderkey || '-' || l_linenumber AS transaction_key, 'A' || l_orderkey AS award_id_piid, CAST(l_suppkey AS VARCHAR) AS recipient_uei, upper(s_name) AS recipient_name, 'P' || (c_nationkey % 4) AS recipient_parent_name,
  ship_year AS fiscal_year, cents AS obligation, 'S' || c_nationkey AS pop_state, CASE WHEN c_custkey % 10 <> 0 THEN 'D' || (c_custkey % 7) END AS pop_district
  FROM {LINES} JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def _xwalk(t) -> DataFrame:
    confidence = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (c("s_suppkey") % 3 + 1).cast("int"))
    return t("supplier").where("s_suppkey % 6 <> 0").select(
        _text("s_suppkey").alias("recipient_uei"), c("s_name").alias("recipient_name"), F.concat(F.lit("F"), _text(c("s_suppkey") % 17)).alias("family_key"), confidence.alias("confidence"), S.cents(c("s_acctbal")).alias("total_obligation")
    )


XWALK = """(SELECT CAST(s_suppkey AS VARCHAR) AS recipient_uei, s_name AS recipient_name, 'F' || (s_suppkey % 17) AS family_key, ['high', 'medium', 'low'][s_suppkey % 3 + 1] AS confidence, CAST(round(s_acctbal * 100) AS BIGINT) AS total_obligation FROM supplier WHERE s_suppkey % 6 <> 0)"""


def _award_links(t) -> DataFrame:
    tier = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (c("p_size") % 3 + 1).cast("int"))
    return t("lineitem").join(t("part"), c("l_partkey") == c("p_partkey")).select(
        F.concat(F.lit("A"), _text("l_orderkey")).alias("award_piid"), c("p_brand").alias("pe_bli"), c("p_type").alias("program_title"), F.concat(F.lit("O"), _text(c("p_size") % 4)).alias("organization"),
        tier.alias("confidence"), F.when(c("p_size") % 2 == 0, "account+tokens").otherwise("codes").alias("method"),
    ).distinct()


AWARD_LINKS = """(SELECT DISTINCT 'A' || l_orderkey AS award_piid, p_brand AS pe_bli, p_type AS program_title, 'O' || (p_size % 4) AS organization, ['high', 'medium', 'low'][p_size % 3 + 1] AS confidence,
  CASE WHEN p_size % 2 = 0 THEN 'account+tokens' ELSE 'codes' END AS method FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@_query(f"""SELECT recipient_uei, max(recipient_name) AS recipient_name, max(recipient_parent_name) AS recipient_parent_name, CAST(sum(obligation) AS BIGINT) AS total_obligation, count(*) AS transactions, min(fiscal_year) AS first_fy, max(fiscal_year) AS last_fy FROM {TX} GROUP BY recipient_uei""")
def dim_recipients(t):
    return staging.dim_recipients(_tx(t))


@_query(f"SELECT pop_state, pop_district, CAST(sum(obligation) AS BIGINT) AS obligation, count(*) AS transactions FROM {TX} GROUP BY ALL")
def dim_geography(t):
    return staging.dim_geography(_tx(t))


@_query(f"SELECT family_key, arg_max(recipient_name, (total_obligation, recipient_uei)) AS display_name, count(*) AS members, CAST(sum(total_obligation) AS BIGINT) AS total_obligation, min(confidence) AS worst_confidence FROM {XWALK} GROUP BY family_key")
def dim_entities(t):
    return staging.dim_entities(_xwalk(t))


@_query(f"SELECT family_key, fiscal_year, CAST(sum(obligation) AS BIGINT) AS total_obligation, count(*) AS transaction_count, count(DISTINCT x.recipient_uei) AS uei_count FROM {TX} t JOIN {XWALK} x ON t.recipient_uei = x.recipient_uei GROUP BY ALL")
def family_obligations_by_year(t):
    return staging.family_obligations_by_year(_tx(t), _xwalk(t))


_DISTRICT = f"""b AS (SELECT award_piid, pe_bli, min(program_title) AS program_title, min(organization) AS organization FROM {AWARD_LINKS} WHERE confidence = 'high' GROUP BY ALL),
  p AS (SELECT pop_state, pop_district, pe_bli, min(program_title) AS program_title, min(organization) AS organization, count(DISTINCT transaction_key) AS transaction_count, count(DISTINCT award_id_piid) AS award_count,
    count(DISTINCT recipient_uei) AS recipient_count, CAST(sum(obligation) AS BIGINT) AS total_obligation FROM {TX} JOIN b ON award_id_piid = award_piid WHERE pop_district IS NOT NULL GROUP BY pop_state, pop_district, pe_bli),
  d AS (SELECT pop_state, pop_district, count(DISTINCT award_id_piid) AS award_count, CAST(sum(obligation) AS BIGINT) AS total_obligation FROM {TX} WHERE pop_district IS NOT NULL AND award_id_piid IN (SELECT award_piid FROM b) GROUP BY ALL)"""


@_query(f"WITH {_DISTRICT} SELECT * FROM p")
def district_programs(t):
    return marts.district_programs(_tx(t), _award_links(t))


@_query(f"WITH {_DISTRICT} SELECT * FROM d")
def district_totals(t):
    return marts.district_totals(_tx(t), _award_links(t))


@_query(f"""WITH {_DISTRICT}, s AS (SELECT pop_state, pop_district, CAST(sum(total_obligation) AS BIGINT) AS claimed FROM p GROUP BY ALL)
  SELECT pop_state, pop_district, claimed, total_obligation AS true_value FROM s JOIN d USING (pop_state, pop_district) WHERE claimed <> total_obligation""")
def dq_double_counted(t):
    """Districts whose programs' sum overstates their awards, each award taken once."""
    claimed = marts.district_program_rows(_tx(t), _award_links(t)).groupBy("pop_state", "pop_district").agg(F.sum("obligation").alias("claimed"))
    linked = _award_links(t).where("confidence = 'high'").select(c("award_piid").alias("award_id_piid")).distinct()
    awards = _tx(t).where("pop_district IS NOT NULL").join(linked, "award_id_piid", "left_semi").groupBy("pop_state", "pop_district", "award_id_piid").agg(F.sum("obligation").alias("dollars"))
    return DQ.double_counted(claimed, awards.withColumnRenamed("dollars", "claimed"), ["pop_state", "pop_district"], "award_id_piid", "claimed")


@_query(f"""WITH a AS (SELECT award_id_piid, recipient_uei, sum(obligation) AS v FROM {TX} GROUP BY ALL), l AS (SELECT DISTINCT award_piid, pe_bli FROM {AWARD_LINKS} WHERE confidence = 'high'),
  m AS (SELECT pe_bli, coalesce(family_key, a.recipient_uei) AS family, CAST(sum(v) AS BIGINT) AS v FROM a JOIN l ON award_id_piid = award_piid LEFT JOIN {XWALK} x ON x.recipient_uei = a.recipient_uei GROUP BY ALL),
  s AS (SELECT *, CASE WHEN v > 0 THEN v::DOUBLE END / sum(CASE WHEN v > 0 THEN v END) OVER (PARTITION BY pe_bli) AS share, row_number() OVER (PARTITION BY pe_bli ORDER BY v DESC, family) AS rn FROM m)
  SELECT pe_bli, round(coalesce(sum(share * share), 0) * 10000, 4) AS hhi, count(CASE WHEN v > 0 THEN 1 END) AS members, CAST(sum(v) AS BIGINT) AS net_total, max(family) FILTER (rn = 1) AS top_member, max(v) FILTER (rn = 1) AS top_value FROM s GROUP BY pe_bli""")
def program_concentration(t):
    return marts.program_concentration(_award_links(t), _tx(t), _xwalk(t))


@_query(f"""WITH l AS (SELECT *, CAST(substr(award_piid, 2) AS BIGINT) AS k FROM {AWARD_LINKS}), v AS (SELECT DISTINCT award_piid, pe_bli, CASE WHEN k % 2 = 0 THEN 'high' ELSE 'reject' END AS said FROM l WHERE k % 5 = 0),
  j AS (SELECT l.award_piid, l.pe_bli, program_title, organization, method, coalesce(said, CASE WHEN method = 'account+tokens' AND confidence = 'high' THEN 'medium' ELSE confidence END) AS confidence FROM l LEFT JOIN v ON v.award_piid = l.award_piid AND v.pe_bli = l.pe_bli)
  SELECT * FROM j WHERE confidence IN ('high', 'medium')""")
def budget_to_awards(t):
    """Links with their verdicts laid over them."""
    found = _award_links(t)
    key = F.substring("award_piid", 2, 20).cast("bigint")
    verdicts = found.where(key % 5 == 0).select("award_piid", "pe_bli", F.when(key % 2 == 0, "high").otherwise("reject").alias("adjudicated_confidence")).distinct()
    return marts.budget_to_awards(found, verdicts)


def _contracts(t) -> DataFrame:
    """Contracts as they land, all text, with blanks."""
    rows = _lines(t).join(t("orders"), c("l_orderkey") == c("o_orderkey")).join(t("customer"), c("o_custkey") == c("c_custkey")).join(t("supplier"), c("l_suppkey") == c("s_suppkey"))
    extent = F.when(c("o_orderpriority") == "1-URGENT", "FULL AND OPEN COMPETITION").when(c("o_orderpriority") == "2-HIGH", "COMPETED UNDER SAP").when(c("o_orderpriority") == "3-MEDIUM", "FOLLOW ON TO COMPETED ACTION").otherwise("NOT COMPETED")
    return rows.select(
        _text("ship_year").alias("fy"), F.when(c("l_suppkey") % 9 == 0, "").otherwise(c("c_mktsegment")).alias("awarding_sub_agency_name"), F.concat(F.lit("office "), _text("c_nationkey")).alias("awarding_office_name"),
        _text("l_suppkey").alias("recipient_uei"), F.when(c("l_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("Parent "), _text(c("l_suppkey") % 5))).alias("recipient_parent_name"), c("s_name").alias("recipient_name"),
        extent.alias("extent_competed"), F.when(c("l_linenumber") == 1, "none").otherwise(_text(c("l_quantity").cast("int"))).alias("number_of_offers_received"), _text("cents").alias("federal_action_obligation"),
    )


FLOW_CONTRACTS = f"""(SELECT ship_year AS fiscal_year, CASE WHEN l_suppkey % 9 = 0 THEN 'UNKNOWN SUB-AGENCY' ELSE c_mktsegment END AS sub_agency, 'office ' || c_nationkey AS office, CAST(l_suppkey AS VARCHAR) AS recipient_uei,
  upper(CASE WHEN l_suppkey % 4 = 0 THEN s_name ELSE 'Parent ' || (l_suppkey % 5) END) AS recipient_fallback_name,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'full_and_open' WHEN '2-HIGH' THEN 'other_than_full' WHEN '3-MEDIUM' THEN 'other_than_full' ELSE 'not_competed' END AS competed_class,
  CASE WHEN l_linenumber = 1 THEN 'unknown' WHEN q < 1 THEN 'unknown' WHEN q < 2 THEN '1' WHEN q < 3 THEN '2' WHEN q < 5 THEN '3-4' WHEN q < 10 THEN '5-9' ELSE '10+' END AS offers_bucket, CAST(cents AS DOUBLE) AS obligation
  FROM (SELECT *, CAST(trunc(l_quantity) AS INT) AS q FROM {LINES}) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


@_query(f"SELECT fiscal_year, sub_agency, office, recipient_uei, recipient_fallback_name, competed_class, offers_bucket, obligation FROM {FLOW_CONTRACTS}")
def flow_contracts(t):
    return staging.flow_contracts(_contracts(t))


@_query(f"""WITH b AS (SELECT f.*, coalesce(family_key, recipient_fallback_name, f.recipient_uei, 'UNKNOWN RECIPIENT') AS family FROM {FLOW_CONTRACTS} f LEFT JOIN {XWALK} x ON x.recipient_uei = f.recipient_uei),
  u AS (SELECT fiscal_year, 'total' AS level_from, 'TOTAL' AS node_from, 'sub_agency' AS level_to, sub_agency AS node_to, competed_class, offers_bucket, obligation FROM b
    UNION ALL SELECT fiscal_year, 'sub_agency', sub_agency, 'office', sub_agency || '|' || office, competed_class, offers_bucket, obligation FROM b
    UNION ALL SELECT fiscal_year, 'office', sub_agency || '|' || office, 'family', family, competed_class, offers_bucket, obligation FROM b)
  SELECT fiscal_year, level_from, node_from, level_to, node_to, competed_class, offers_bucket, sum(obligation) AS amount, count(*) AS line_count FROM u GROUP BY ALL""")
def spend_edges(t):
    """The spend river in one pass of grouping sets."""
    return marts.spend_edges(staging.flow_contracts(_contracts(t)), _xwalk(t))


@_query(f"""WITH t AS ({ORACLE_SQL["budget_trajectory"]}), a AS (SELECT * FROM {TX} WHERE obligation > 0), l AS (SELECT DISTINCT award_piid, pe_bli FROM {AWARD_LINKS} WHERE confidence = 'high'), x AS (SELECT * FROM {XWALK}),
  m AS (SELECT pe_bli, fiscal_year, coalesce(family_key, a.recipient_uei) AS family, sum(obligation) AS v FROM a JOIN l ON award_id_piid = award_piid LEFT JOIN x ON x.recipient_uei = a.recipient_uei GROUP BY ALL),
  s AS (SELECT *, 100.0::DOUBLE * v / sum(v) OVER (PARTITION BY pe_bli, fiscal_year) AS share FROM m),
  f AS (SELECT family_key, min(fiscal_year) AS first_fy, sum(obligation) AS v FROM a JOIN x ON x.recipient_uei = a.recipient_uei GROUP BY family_key)
  SELECT 'swing' AS event_type, pe_bli, organization, NULL::VARCHAR AS family_key, fy_2000_total::DOUBLE AS headline_value, fy_1999_total::DOUBLE AS comparison_value, pct_change, 2000 AS fiscal_year FROM t WHERE pe_bli <> '9999999999' AND organization <> '' AND fy_1999_total >= 50000 AND fy_2000_total IS NOT NULL AND abs(pct_change) >= 50
  UNION ALL SELECT 'zeroed', pe_bli, organization, NULL, fy_1999_total, 0, NULL, 2000 FROM t WHERE pe_bli <> '9999999999' AND fy_1999_total > 0 AND fy_2000_total = 0
  UNION ALL SELECT 'concentration', pe_bli, NULL, NULL, round(sum(share * share), 4), sum(v)::DOUBLE, NULL, fiscal_year FROM s GROUP BY pe_bli, fiscal_year HAVING sum(v) >= 5000000
  UNION ALL (SELECT 'entrant', NULL, NULL, family_key, v::DOUBLE, first_fy, NULL, first_fy FROM f WHERE first_fy >= 1992 AND v >= 1000000 ORDER BY v DESC, family_key LIMIT 25)""")
def feed_events_mart(t):
    """Swings, zeroed lines, concentrations and new families under one schema."""
    trajectory = marts.budget_trajectory(_budget_lines(t), ["fy_1998_actuals", "fy_1999_total", "fy_2000_total"])
    return marts.feed_events(trajectory, "fy_2000_total", "fy_1999_total", _award_links(t), _tx(t), _xwalk(t), entrants_since=1992)


def _state_rows(t) -> DataFrame:
    """State payments made of orders: departments of segments, categories of priorities, states of nations."""
    rows = t("orders").join(t("customer"), c("o_custkey") == c("c_custkey"))
    return rows.select(
        F.when(c("c_custkey") % 8 != 0, c("c_mktsegment")).alias("department"), F.concat(F.lit("agency "), _text(c("c_nationkey") % 6)).alias("agency"), c("o_orderpriority").alias("category"), c("o_orderstatus").alias("fund"),
        _text(F.year("o_orderdate")).alias("fiscal_year"), _text(S.cents(c("o_totalprice"))).alias("amount_usd"), F.when(c("o_custkey") % 9 == 0, "True").when(c("o_custkey") % 2 == 0, "False").alias("is_total"),
        F.concat(F.lit("http://x/"), _text("o_orderkey")).alias("source_url"), F.when(c("c_nationkey") % 2 == 0, "CA").otherwise("NY").alias("jurisdiction"),
    )


STATE_ROWS = """(SELECT CASE WHEN c_custkey % 8 <> 0 THEN c_mktsegment END AS department, 'agency ' || (c_nationkey % 6) AS agency, o_orderpriority AS category, o_orderstatus AS fund, CAST(year(o_orderdate) AS VARCHAR) AS fiscal_year,
  CAST(round(o_totalprice * 100) AS BIGINT) AS amount, CASE WHEN o_custkey % 9 = 0 THEN 'True' WHEN o_custkey % 2 = 0 THEN 'False' END AS is_total, 'http://x/' || o_orderkey AS source_url, CASE WHEN c_nationkey % 2 = 0 THEN 'CA' ELSE 'NY' END AS jurisdiction
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


@_query(f"""WITH r AS (SELECT * FROM {STATE_ROWS} WHERE is_total = 'False' OR is_total IS NULL), d AS (SELECT department, fiscal_year, sum(amount)::DOUBLE AS v FROM r GROUP BY ALL)
  SELECT r.department, agency, category, fund, r.fiscal_year, amount::DOUBLE AS amount_usd, source_url, v AS recomputed_dept_total_usd FROM r JOIN d ON d.department = r.department AND d.fiscal_year = r.fiscal_year""")
def state_budget(t):
    """Rows beside their department's total, by one window."""
    return staging.state_budget(_state_rows(t))


@_query(f"SELECT 'CA' AS jurisdiction, department, category, fiscal_year, sum(amount) || '.00' AS amount_usd FROM {STATE_ROWS} GROUP BY department, category, fiscal_year")
def state_checkbook(t):
    return staging.state_checkbook(_state_rows(t), "CA")


_STATE_MAP = "(SELECT DISTINCT jurisdiction, category AS raw_category, CASE WHEN category < '3' THEN 'urgent' ELSE 'other' END AS comparable_category FROM s WHERE category <> '5-LOW')"


@_query(f"""WITH s AS (SELECT jurisdiction, category, CAST(fiscal_year AS INT) AS fiscal_year, amount, department FROM {STATE_ROWS}), m AS {_STATE_MAP},
  g AS (SELECT s.jurisdiction, comparable_category, fiscal_year, sum(amount)::DOUBLE AS amount_usd FROM s JOIN m ON m.jurisdiction = s.jurisdiction AND raw_category = category GROUP BY ALL),
  p AS (SELECT CASE WHEN n_regionkey % 2 = 0 THEN 'CA' ELSE 'NY' END AS jurisdiction, 1990 + n_nationkey % 9 AS y, max(1000 + n_nationkey) AS population FROM nation GROUP BY ALL),
  j AS (SELECT g.*, (SELECT max(y) FROM p WHERE p.jurisdiction = g.jurisdiction AND y <= fiscal_year) AS population_year FROM g)
  SELECT j.jurisdiction, comparable_category, fiscal_year, amount_usd, population_year, population, round(amount_usd / population, 2) AS per_capita FROM j LEFT JOIN p ON p.jurisdiction = j.jurisdiction AND p.y = population_year
  WHERE (comparable_category, fiscal_year) IN (SELECT (comparable_category, fiscal_year) FROM g GROUP BY comparable_category, fiscal_year HAVING count(DISTINCT jurisdiction) = 2)""")
def state_per_capita(t):
    """Comparable categories over the population of the latest year not after theirs."""
    rows = _state_rows(t).select("jurisdiction", "category", c("fiscal_year").cast("int").alias("fiscal_year"), c("amount_usd").cast("double").alias("amount_usd"))
    mapped = rows.where("category <> '5-LOW'").select("jurisdiction", c("category").alias("raw_category"), F.when(c("category") < "3", "urgent").otherwise("other").alias("comparable_category")).distinct()
    people = t("nation").groupBy(F.when(c("n_regionkey") % 2 == 0, "CA").otherwise("NY").alias("state"), (F.lit(1990) + c("n_nationkey") % 9).cast("int").alias("year")).agg(F.max(F.lit(1000) + c("n_nationkey")).alias("population"))
    return marts.state_per_capita(rows, mapped, people)


@_query(f"""WITH s AS (SELECT jurisdiction, category, fiscal_year, CASE WHEN department IS NOT NULL THEN source_url END AS source_url FROM {STATE_ROWS}), m AS {_STATE_MAP},
  b AS (SELECT comparable_category, fiscal_year FROM s JOIN m ON m.jurisdiction = s.jurisdiction AND raw_category = category GROUP BY ALL HAVING count(DISTINCT s.jurisdiction) = 2)
  SELECT 'rows_sourced' AS gate, (SELECT count(*) FROM s WHERE source_url IS NULL) AS violations, 'error' AS severity, (SELECT count(*) FROM s WHERE source_url IS NULL) = 0 AS passed
  UNION ALL SELECT 'comparable', CASE WHEN (SELECT count(*) FROM b) < 5 THEN 1 ELSE 0 END, 'error', (SELECT count(*) FROM b) >= 5""")
def dq_state_gates(t):
    """State rows without a source, and whether enough categories compare."""
    rows = _state_rows(t).withColumn("source_url", F.when(c("department").isNotNull(), c("source_url")))
    mapped = rows.where("category <> '5-LOW'").select("jurisdiction", c("category").alias("raw_category"), F.when(c("category") < "3", "urgent").otherwise("other").alias("comparable_category")).distinct()
    spark = rows.sparkSession
    return phase_gates.report(spark, phase_gates.state_gates(rows, mapped, ["CA", "NY"], least=5))


def _filings(t) -> DataFrame:
    """Lobbying filings made of orders."""
    method = F.when(c("o_orderstatus") == "F", "exact_family").when(c("o_orderstatus") == "O", "none").otherwise("normalized")
    return t("orders").select(
        F.concat(F.lit("U"), _text(c("o_orderkey") % 5000)).alias("filing_uuid"), F.year("o_orderdate").alias("filing_year"), F.concat(F.lit("client "), _text(c("o_custkey") % 100)).alias("client_name"),
        F.concat(F.lit("registrant "), _text(c("o_custkey") % 7)).alias("registrant_name"), F.concat(F.lit("F"), _text(c("o_custkey") % 19)).alias("family_key_guess"), method.alias("match_method"),
        _text(S.cents(c("o_totalprice"))).alias("income_usd"), F.when(c("o_custkey") % 3 == 0, "n/a").otherwise(_text(c("o_custkey"))).alias("expenses_usd"),
    )


FILINGS = """(SELECT 'U' || (o_orderkey % 5000) AS filing_uuid, CAST(year(o_orderdate) AS INT) AS filing_year, 'client ' || (o_custkey % 100) AS client_name, 'registrant ' || (o_custkey % 7) AS registrant_name, 'F' || (o_custkey % 19) AS family_key_guess,
  CASE o_orderstatus WHEN 'F' THEN 'exact_family' WHEN 'O' THEN 'none' ELSE 'normalized' END AS match_method, CAST(round(o_totalprice * 100) AS BIGINT) AS income, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS expense FROM orders)"""


@_query(f"""WITH e AS (SELECT family_key, arg_max(recipient_name, (total_obligation, recipient_uei)) AS display_name, CAST(sum(total_obligation) AS BIGINT) AS v FROM {XWALK} GROUP BY family_key),
  s AS (SELECT family_key_guess AS family_key, filing_year, count(*) AS filings_count, coalesce(sum(income), 0)::DOUBLE AS lobbying_income_usd, coalesce(sum(expense), 0)::DOUBLE AS lobbying_expense_usd FROM {FILINGS} WHERE match_method <> 'none' GROUP BY ALL)
  SELECT s.*, display_name, v AS family_obligations_usd, lobbying_income_usd + lobbying_expense_usd AS lobbying_total_usd FROM s LEFT JOIN e USING (family_key)""")
def influence(t):
    """Lobbying money by family and year beside the family's awards."""
    return staging.influence(_filings(t), staging.dim_entities(_xwalk(t)))


@_query(f"""WITH m AS (SELECT DISTINCT 'U' || (l_orderkey % 5000) AS filing_uuid, p_brand AS pe_bli FROM lineitem JOIN part ON l_partkey = p_partkey),
  f AS (SELECT * FROM {FILINGS} QUALIFY row_number() OVER (PARTITION BY filing_uuid ORDER BY filing_year DESC, client_name, registrant_name) = 1),
  a AS (SELECT filing_uuid, string_agg(issue, '; ' ORDER BY issue) AS issues FROM (SELECT DISTINCT 'U' || (o_orderkey % 5000) AS filing_uuid, o_orderpriority AS issue FROM orders) GROUP BY filing_uuid)
  SELECT m.filing_uuid, pe_bli, filing_year, client_name, registrant_name, issues FROM m LEFT JOIN f ON f.filing_uuid = m.filing_uuid LEFT JOIN a ON a.filing_uuid = m.filing_uuid""")
def program_lobbying(t):
    """Mentions beside their filing, taken once, and its issue areas."""
    found = t("lineitem").join(t("part"), c("l_partkey") == c("p_partkey")).select(F.concat(F.lit("U"), _text(c("l_orderkey") % 5000)).alias("filing_uuid"), c("p_brand").alias("pe_bli")).distinct()
    activities = t("orders").select(F.concat(F.lit("U"), _text(c("o_orderkey") % 5000)).alias("filing_uuid"), c("o_orderpriority").alias("issue_display"))
    return staging.program_lobbying(found, _filings(t), activities).select("filing_uuid", "pe_bli", "filing_year", "client_name", "registrant_name", "issues")


@_query("""WITH l AS (SELECT c_name AS name, CASE WHEN o_orderpriority = '1-URGENT' THEN 'N/A' WHEN o_orderpriority <> '2-HIGH' THEN o_orderpriority END AS p FROM orders JOIN customer ON o_custkey = c_custkey),
  n AS (SELECT name, p, count(*) AS n, coalesce(p <> 'N/A', false) AS r FROM l GROUP BY name, p),
  b AS (SELECT name, p FROM n QUALIFY row_number() OVER (PARTITION BY name ORDER BY r DESC, n DESC, p NULLS LAST) = 1)
  SELECT name, b.p AS covered_position, CAST(sum(n) AS BIGINT) AS filings_count, bool_or(r) AS revolving_door FROM n JOIN b USING (name) GROUP BY name, b.p""")
def dim_lobbyists(t):
    """The position most often given by each name, real ones first."""
    position = F.when(c("o_orderpriority") == "1-URGENT", "N/A").when(c("o_orderpriority") != "2-HIGH", c("o_orderpriority"))
    return staging.dim_lobbyists(t("orders").join(t("customer"), c("o_custkey") == c("c_custkey")).select(c("c_name").alias("name"), position.alias("covered_position")))


@_query("""WITH s AS (SELECT 'A' || o_orderkey AS prime_award_unique_key, CAST(round(l_extendedprice * 100) AS DOUBLE) AS amount, CASE WHEN o_orderkey % 3 = 0 THEN CAST(round(o_totalprice * 50) AS DOUBLE) END AS ceiling, l_shipdate, year(l_shipdate) AS fy, CAST(l_suppkey AS VARCHAR) AS uei FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT prime_award_unique_key, amount AS subaward_amount, ceiling AS prime_award_ceiling, CAST(l_shipdate AS DATE) AS subaward_action_date, CAST(fy AS INT) AS fiscal_year, uei AS subawardee_uei, 'SUB ' || uei AS subawardee_name, amount > 50000000000 OR (ceiling IS NOT NULL AND amount > ceiling) AS is_amount_suspect FROM s""")
def subawards(t):
    """Subawards typed and flagged against a hard cap and their prime award."""
    rows = t("lineitem").join(t("orders"), c("l_orderkey") == c("o_orderkey")).select(
        F.concat(F.lit("A"), _text("o_orderkey")).alias("prime_award_unique_key"), _text(S.cents(c("l_extendedprice"))).alias("subaward_amount"), F.when(c("o_orderkey") % 3 == 0, _text(F.round(c("o_totalprice") * 50))).otherwise("").alias("prime_award_amount"),
        _text(c("l_shipdate").cast("date")).alias("subaward_action_date"), _text(F.year("l_shipdate")).alias("fy"), _text("l_suppkey").alias("subawardee_uei"), F.concat(F.lit("sub "), _text("l_suppkey")).alias("subawardee_name"),
    )
    return staging.subawards(rows)


@_query("""SELECT p_partkey, p_brand || '-' || p_size AS pe_bli, CASE WHEN p_size % 3 = 0 AND p_type = 'STANDARD' THEN 'new ' || p_type ELSE p_type END AS title FROM part""")
def retitle(t):
    """Curated titles only where the source still has the title they were written for."""
    lines = t("part").select("p_partkey", F.concat_ws("-", "p_brand", _text("p_size")).alias("pe_bli"), c("p_type").alias("title"))
    overrides = t("part").where("p_size % 3 = 0").select(F.concat_ws("-", "p_brand", _text("p_size")).alias("pe_bli"), F.lit("STANDARD").alias("source_title"), F.lit("new STANDARD").alias("new_title")).distinct()
    return staging.retitle(lines, overrides)


@_query(f"""WITH w AS (SELECT pe_bli, CAST(sum(amount) FILTER (amount_type = 'fy_2000_total') AS BIGINT) AS total, CAST(sum(amount) FILTER (amount_type = 'fy_2000_request') AS BIGINT) AS added, CAST(sum(amount) FILTER (amount_type = 'fy_1999_enacted') AS BIGINT) AS base, CAST(sum(amount) FILTER (amount_type = 'fy_1999_total') AS BIGINT) AS prior FROM {BUDGET_LINES} GROUP BY pe_bli)
  SELECT *, round(100.0::DOUBLE * added / nullif(total, 0), 2) AS added_share_pct, round(100.0::DOUBLE * (base - prior) / nullif(prior, 0), 2) AS like_for_like_pct FROM w""")
def base_and_added(t):
    """Base, added and total of a year with the like-for-like change."""
    return staging.fy26_split(_budget_lines(t), {"total": "fy_2000_total", "added": "fy_2000_request", "base": "fy_1999_enacted", "prior": "fy_1999_total"})


@_query("""WITH k AS (SELECT p_partkey, lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || ['D', 'N', 'A', 'F', 'X'][p_size % 5 + 1] AS account, CASE WHEN p_size % 7 <> 0 THEN 'NAVY' END AS org, CAST(p_size AS VARCHAR) AS line,
    CASE WHEN p_size % 3 = 0 THEN 'Missile_Defense_Agency' WHEN p_size % 3 = 1 THEN 'Defense_Wide' ELSE p_brand END AS book FROM part)
  SELECT p_partkey, CASE right(account, 1) WHEN 'D' THEN '097' WHEN 'N' THEN '017' WHEN 'A' THEN '021' WHEN 'F' THEN '057' ELSE '097' END || '-' || left(account, 4) AS federal, account || '-' || org || '-L' || line AS key,
    org IS NOT NULL AS is_key, CASE WHEN org IS NOT NULL THEN line END AS anchor, CASE book WHEN 'Missile_Defense_Agency' THEN 'MDA' WHEN 'Defense_Wide' THEN 'DW' ELSE book END AS workbook,
    CASE WHEN book = 'Missile_Defense_Agency' THEN 'MDA,Missile_Defense_Agency' WHEN book = 'Defense_Wide' THEN 'DW,Defense_Wide,Defense-Wide' ELSE book END AS names FROM k""")
def line_codes(t):
    """Account, line and organisation codes both ways."""
    letter = F.element_at(F.array(*map(F.lit, "DNAFX")), (c("p_size") % 5 + 1).cast("int"))
    account = F.concat(F.lpad(_text(c("p_partkey") % 10000), 4, "0"), letter)
    key = S.line_key(account, F.when(c("p_size") % 7 != 0, "NAVY"), c("p_size"))
    book = F.when(c("p_size") % 3 == 0, "Missile_Defense_Agency").when(c("p_size") % 3 == 1, "Defense_Wide").otherwise(c("p_brand"))
    return t("part").select(
        "p_partkey", S.federal_account(account).alias("federal"), key.alias("key"), F.coalesce(S.is_line_key(key), F.lit(False)).alias("is_key"), S.line_anchor(key).alias("anchor"),
        S.workbook_org(book).alias("workbook"), F.array_join(S.book_orgs(S.workbook_org(book)), ",").alias("names"),
    )


@_query("""SELECT p_partkey, p_brand || '''s "part"- ' || p_type AS plain, regexp_replace(regexp_replace(printf('%.4f', p_retailprice / 8), '0+$', ''), '\\.$', '') AS number FROM part""")
def canonical_text(t):
    """Typographic signs evened out, numbers as answers are compared."""
    shown = F.concat("p_brand", F.lit("’s  “part”— "), "p_type", F.lit(" "))
    return t("part").select("p_partkey", S.plain_quotes(shown).alias("plain"), S.canonical_number(c("p_retailprice") / 8).alias("number"))
