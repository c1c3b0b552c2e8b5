"""Queries over the provided tables, one or more an operator, each with its SQL equivalent.

Money is summed as whole cents, so both engines agree to the last digit; ratios are rounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import aggregates as A
from tallyspark.operators import assertions as DQ
from tallyspark.operators import chains, entities, gates, graph, joins, ledger, links, matching, picks
from tallyspark.plans import marts
from tallyspark.sources import html, tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(sql: str | None = None):
    """Register a function of (table reader) under its name, with its SQL where SQL can say it."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(lambda name: tables.read_table(spark, sf_dir, name))

        run.__doc__ = function.__doc__
        QUERIES[function.__name__] = run
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def _lines(t) -> DataFrame:
    return t("lineitem").withColumn("cents", S.cents(F.col("l_extendedprice"))).withColumn("ship_year", F.year("l_shipdate"))


def _sales(t, *, customer_nation: bool = False) -> DataFrame:
    """Lines beside their order and, by choice, the customer's nation."""
    rows = _lines(t).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")) if customer_nation else rows


LINES = "(SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(year(l_shipdate) AS INT) AS ship_year FROM lineitem)"


@_query("""SELECT l_orderkey, l_partkey, l_suppkey, CAST(round(l_quantity) AS INT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
  nullif(trim(l_linestatus), '') AS status, upper(trim(l_returnflag)) AS return_flag,
  CAST(year(l_shipdate) + CASE WHEN month(l_shipdate) >= 10 THEN 1 ELSE 0 END AS INT) AS fiscal_year, 'line' AS source_kind FROM lineitem""")
def staging_lineitem(t):
    """Typed, trimmed staging of an all-text landing, with the federal fiscal year."""
    return t("lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", S.safe_number(F.col("l_quantity").cast("string"), "int").alias("quantity"), S.cents(F.col("l_extendedprice")).alias("cents"),
        S.blank_to_null(F.col("l_linestatus")).alias("status"), F.upper(F.trim("l_returnflag")).alias("return_flag"), S.fiscal_year(F.col("l_shipdate")).alias("fiscal_year"), F.lit("line").alias("source_kind"),
    )


@_query("""SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'full_and_open' WHEN '2-HIGH' THEN 'set_aside' WHEN '3-MEDIUM' THEN 'other_than_full' ELSE 'not_competed' END AS competed_class,
  CASE WHEN l_quantity IS NULL OR l_quantity < 1 THEN 'unknown' WHEN l_quantity < 2 THEN '1' WHEN l_quantity < 3 THEN '2' WHEN l_quantity < 5 THEN '3-4' WHEN l_quantity < 10 THEN '5-9' ELSE '10+' END AS offers_bucket,
  count(*) AS n_lines, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def competition_recode(t):
    """Competition classes and offer bins over lines beside their orders."""
    classed = S.recode(F.col("o_orderpriority"), {"1-URGENT": "full_and_open", "2-HIGH": "set_aside", "3-MEDIUM": "other_than_full"}, F.lit("not_competed"))
    return _sales(t).groupBy(classed.alias("competed_class"), S.offers_bucket(F.col("l_quantity")).alias("offers_bucket")).agg(F.count("*").alias("n_lines"), F.sum("cents").alias("cents"))


@_query("""SELECT l_orderkey, l_linenumber, cents, cents > 9000000 OR cents > CAST(round(o_totalprice * 100) AS BIGINT) AS is_suspect
  FROM """ + LINES + """ JOIN orders ON l_orderkey = o_orderkey""")
def quarantine_flag(t):
    """Lines over a cap or over their order's total are flagged and kept."""
    suspect = (F.col("cents") > 9_000_000) | (F.col("cents") > S.cents(F.col("o_totalprice")))
    return _sales(t).select("l_orderkey", "l_linenumber", "cents", suspect.alias("is_suspect"))


@_query("""SELECT n_nationkey, CASE lower(trim(r_name)) WHEN 'africa' THEN 'AF' WHEN 'america' THEN 'AM' WHEN 'asia' THEN 'AS' ELSE upper(trim(r_name)) END AS code,
  count(*) AS n_customers, CASE WHEN avg(c_acctbal) < 1500 THEN 'unconcentrated' WHEN avg(c_acctbal) < 2500 THEN 'moderate' ELSE 'high' END AS band
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_nationkey, r_name""")
def code_map(t):
    """Case-insensitive code map and bands."""
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    code = S.canonical_code(F.col("r_name"), {"Africa": "AF", "america": "AM", "ASIA": "AS"})
    return rows.groupBy("n_nationkey", code.alias("code")).agg(F.count("*").alias("n_customers"), S.hhi_band(F.avg("c_acctbal")).alias("band"))


@_query("SELECT l_suppkey, max(s_name) AS supplier, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n_lines, min(ship_year) AS first_year, max(ship_year) AS last_year FROM " + LINES + " JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey")
def dim_supplier_totals(t):
    """Recipient totals with first and last year."""
    return _lines(t).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_suppkey").agg(
        F.max("s_name").alias("supplier"), F.sum("cents").alias("cents"), F.count("*").alias("n_lines"), F.min("ship_year").alias("first_year"), F.max("ship_year").alias("last_year")
    )


@_query("SELECT n_regionkey, n_name, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def geo_totals(t):
    """Totals by region and nation."""
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_regionkey", "n_name").agg(F.sum(S.cents(F.col("o_totalprice"))).alias("cents"), F.count("*").alias("n_orders"))


@_query("""WITH s AS (SELECT c_nationkey, c_name, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
  SELECT c_nationkey, arg_max(c_name, (v, c_name)) AS label, CAST(sum(v) AS BIGINT) AS cents, count(*) AS members FROM s GROUP BY c_nationkey""")
def top_label_member(t):
    """The label of the member with most money, per nation."""
    sums = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_name").agg(F.sum(S.cents(F.col("o_totalprice"))).alias("v"))
    return sums.groupBy("c_nationkey").agg(F.max_by("c_name", F.struct("v", "c_name")).alias("label"), F.sum("v").alias("cents"), F.count("*").alias("members"))


@_query("""SELECT c_nationkey, CAST(year(l_shipdate) + CASE WHEN month(l_shipdate) >= 10 THEN 1 ELSE 0 END AS INT) AS fiscal_year, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_suppliers
  FROM """ + LINES + """ JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def yearly_obligations(t):
    """Money, rows and distinct suppliers by nation and fiscal year."""
    return _sales(t, customer_nation=True).groupBy("c_nationkey", S.fiscal_year(F.col("l_shipdate")).alias("fiscal_year")).agg(
        F.sum("cents").alias("cents"), F.count("*").alias("n_lines"), F.countDistinct("l_suppkey").alias("n_suppliers")
    )


@_query("""WITH p AS (SELECT p_brand, CAST(sum(cents) FILTER (ship_year = 1998) AS BIGINT) AS y1998, CAST(sum(cents) FILTER (ship_year = 1999) AS BIGINT) AS y1999, CAST(sum(cents) FILTER (ship_year = 2000) AS BIGINT) AS y2000
    FROM """ + LINES + """ JOIN part ON l_partkey = p_partkey GROUP BY p_brand)
  SELECT *, y2000 - y1999 AS change, CASE WHEN y1999 IS NULL OR y1999 = 0 THEN NULL ELSE round(100.0::DOUBLE * (y2000 - y1999) / y1999, 2) END AS pct FROM p""")
def trajectory_pivot(t):
    """Three years side by side with the change and a guarded per cent."""
    rows = _lines(t).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    wide = A.conditional_pivot(rows, ["p_brand"], "ship_year", {"y1998": 1998, "y1999": 1999, "y2000": 2000}, "cents")
    return wide.withColumn("change", F.col("y2000") - F.col("y1999")).withColumn("pct", A.pct_change(F.col("y2000"), F.col("y1999")))


_HHI = """WITH m AS (SELECT {g} AS g, l_suppkey, sum(cents) AS v FROM """ + LINES + """ {j} GROUP BY ALL),
  s AS (SELECT *, CASE WHEN v > 0 THEN CAST(v AS DOUBLE) / sum(CASE WHEN v > 0 THEN v END) OVER (PARTITION BY g) END AS share, row_number() OVER (PARTITION BY g ORDER BY v DESC, l_suppkey) AS rn FROM m)
  SELECT g AS {g}, round(coalesce(sum(share * share), 0) * 10000, 4) AS hhi, count(share) AS members, CAST(sum(v) AS BIGINT) AS net_total,
    max(CASE WHEN rn = 1 THEN l_suppkey END) AS top_member, CAST(max(CASE WHEN rn = 1 THEN v END) AS BIGINT) AS top_value FROM s GROUP BY g"""


@_query(_HHI.format(g="c_nationkey", j="JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"))
def hhi_by_nation(t):
    """Supplier concentration by customer nation."""
    return A.concentration(_sales(t, customer_nation=True), ["c_nationkey"], "l_suppkey", "cents")


@_query(_HHI.format(g="p_brand", j="JOIN part ON l_partkey = p_partkey"))
def hhi_by_brand(t):
    """Supplier concentration by brand."""
    return A.concentration(_lines(t).join(t("part"), F.col("l_partkey") == F.col("p_partkey")), ["p_brand"], "l_suppkey", "cents")


@_query("""WITH r AS (SELECT l_partkey, ship_year, cents, CASE WHEN l_returnflag = 'R' THEN cents ELSE 0 END AS returned, max(ship_year) OVER (PARTITION BY l_partkey) AS latest FROM """ + LINES + """)
  SELECT l_partkey, latest AS ship_year, CAST(sum(cents) AS BIGINT) AS cents, round(CASE WHEN sum(cents) = 0 THEN NULL ELSE CAST(sum(returned) AS DOUBLE) / CAST(sum(cents) AS DOUBLE) END, 4) AS rate FROM r WHERE ship_year = latest GROUP BY ALL""")
def latest_weighted_rate(t):
    """The return rate of each part's latest year, weighted by money."""
    rows = _lines(t).withColumn("returned", F.when(F.col("l_returnflag") == "R", F.col("cents")).otherwise(F.lit(0)))
    return A.latest_weighted_rate(rows, ["l_partkey"], "ship_year", "returned", "cents")


@_query("SELECT l_orderkey, l_linenumber, cents, CAST(sum(cents) OVER (PARTITION BY l_orderkey) AS BIGINT) AS order_cents FROM " + LINES + " WHERE l_orderkey IS NOT NULL")
def dept_total_beside_row(t):
    """Each row beside its group's total, in one exchange."""
    rows = _lines(t).where(F.col("l_orderkey").isNotNull())
    return rows.select("l_orderkey", "l_linenumber", "cents", F.sum("cents").over(Window.partitionBy("l_orderkey")).alias("order_cents"))


@_query("""WITH s AS (SELECT l_partkey, n_regionkey, sum(cents) AS cents FROM """ + LINES + """ JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
  SELECT l_partkey, n_regionkey, CAST(cents AS BIGINT) AS cents FROM s WHERE n_regionkey IN (1, 2) AND l_partkey IN (SELECT l_partkey FROM s WHERE n_regionkey IN (1, 2) GROUP BY l_partkey HAVING count(DISTINCT n_regionkey) = 2)""")
def both_present(t):
    """Parts bought from both of two regions."""
    rows = _lines(t).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return A.both_present(rows.groupBy("l_partkey", "n_regionkey").agg(F.sum("cents").alias("cents")), ["l_partkey"], "n_regionkey", [1, 2])


@_query("""WITH linked AS (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
  o AS (SELECT o_orderkey, c_nationkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey)
  SELECT c_nationkey, p_type, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n_orders FROM o JOIN linked ON o_orderkey = l_orderkey GROUP BY ALL
  UNION ALL SELECT c_nationkey, 'ALL', CAST(sum(cents) AS BIGINT), count(*) FROM o WHERE o_orderkey IN (SELECT l_orderkey FROM linked) GROUP BY ALL""")
def headline_no_double_count(t):
    """Orders at the grain of their part types, and a headline that counts each once."""
    linked = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_type").distinct()
    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey", S.cents(F.col("o_totalprice")).alias("cents"))
    on = F.col("o_orderkey") == F.col("l_orderkey")
    fine = orders.join(linked, on).groupBy("c_nationkey", "p_type").agg(F.sum("cents").alias("cents"), F.count("*").alias("n_orders"))
    head = orders.join(linked, on, "left_semi").groupBy("c_nationkey").agg(F.sum("cents").alias("cents"), F.count("*").alias("n_orders"))
    return fine.unionByName(head.withColumn("p_type", F.lit("ALL")))


@_query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_linestatus = 'F') AS all_final, bool_and(l_linestatus = 'F') FILTER (l_quantity >= 10) AS large_final FROM lineitem GROUP BY l_orderkey")
def bool_flags(t):
    """Any and all over flags, with and without a filter."""
    final = F.col("l_linestatus") == "F"
    return t("lineitem").groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.bool_and(final).alias("all_final"), F.bool_and(F.when(F.col("l_quantity") >= 10, final)).alias("large_final")
    )


@_query("""WITH r AS (SELECT l_partkey, ship_year, s_nationkey, cents FROM """ + LINES + """ JOIN supplier ON l_suppkey = s_suppkey),
  c AS (SELECT DISTINCT l_partkey FROM (SELECT l_partkey FROM r GROUP BY l_partkey, ship_year HAVING count(DISTINCT s_nationkey) > 1))
  SELECT r.l_partkey, ship_year, CASE WHEN c.l_partkey IS NOT NULL THEN s_nationkey END AS s_nationkey, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS n_rows
  FROM r LEFT JOIN c ON r.l_partkey = c.l_partkey GROUP BY ALL""")
def collision_keys(t):
    """Sums that keep the supplier's nation only for parts that several nations ship in one year."""
    rows = _lines(t).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return A.regrain(rows, ["l_partkey"], ["ship_year"], "s_nationkey", "cents")


_LEVELS = """(SELECT CAST(n_regionkey AS VARCHAR) AS a, n_name AS b, c_mktsegment AS c, o_orderpriority AS d, CAST(round(o_totalprice * 100) AS BIGINT) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@_query(f"""SELECT 'total' AS level_from, 'TOTAL' AS node_from, 'n_regionkey' AS level_to, a AS node_to, CAST(sum(v) AS BIGINT) AS amount, count(*) AS line_count FROM {_LEVELS} GROUP BY a
  UNION ALL SELECT 'n_regionkey', a, 'n_name', a || '|' || b, CAST(sum(v) AS BIGINT), count(*) FROM {_LEVELS} GROUP BY a, b
  UNION ALL SELECT 'n_name', a || '|' || b, 'c_mktsegment', a || '|' || b || '|' || c, CAST(sum(v) AS BIGINT), count(*) FROM {_LEVELS} GROUP BY a, b, c
  UNION ALL SELECT 'c_mktsegment', a || '|' || b || '|' || c, 'o_orderpriority', a || '|' || b || '|' || c || '|' || d, CAST(sum(v) AS BIGINT), count(*) FROM {_LEVELS} GROUP BY a, b, c, d""")
def hierarchy_edges(t):
    """Edges of a four-level hierarchy in one pass."""
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return A.hierarchy_edges(rows.withColumn("v", S.cents(F.col("o_totalprice"))), ["n_regionkey", "n_name", "c_mktsegment", "o_orderpriority"], "v")


@_query(f"""WITH e AS (SELECT 'TOTAL' AS f, a AS t, sum(v) AS v FROM {_LEVELS} GROUP BY a UNION ALL SELECT a, a || '|' || b, sum(v) FROM {_LEVELS} GROUP BY a, b UNION ALL SELECT a || '|' || b, a || '|' || b || '|' || c, sum(v) FROM {_LEVELS} GROUP BY a, b, c
    UNION ALL SELECT a || '|' || b || '|' || c, a || '|' || b || '|' || c || '|' || d, sum(v) FROM {_LEVELS} GROUP BY a, b, c, d), x AS (SELECT f, t, v + CASE WHEN t LIKE '%BUILDING' OR t = '1' THEN 7 ELSE 0 END AS v FROM e)
  SELECT i.node, CAST(i.v AS BIGINT) AS value_in, CAST(o.v AS BIGINT) AS value_out FROM (SELECT t AS node, sum(v) AS v FROM x GROUP BY t) i JOIN (SELECT f AS node, sum(v) AS v FROM x GROUP BY f) o USING (node) WHERE i.v <> o.v""")
def hierarchy_conservation(t):
    """Nodes whose inflow isn't their outflow, after some edges of three levels were overstated."""
    node = F.col("node_to")
    return DQ.flow_imbalance(hierarchy_edges(t).withColumn("amount", F.col("amount") + F.when(node.like("%BUILDING") | (node == "1"), 7).otherwise(0)))


@_query("""WITH y AS (SELECT p_brand, nullif(l_returnflag, 'N') AS flag, ship_year, CAST(sum(cents) AS BIGINT) AS v FROM """ + LINES + """ JOIN part ON l_partkey = p_partkey GROUP BY ALL)
  SELECT f.p_brand, f.flag, f.ship_year AS from_edition, t.ship_year AS to_edition, f.v AS from_v, t.v AS to_v, t.v - f.v AS delta FROM y f JOIN y t
    ON f.p_brand IS NOT DISTINCT FROM t.p_brand AND f.flag IS NOT DISTINCT FROM t.flag AND t.ship_year IN (f.ship_year + 1, f.ship_year + 2)""")
def null_safe_diff(t):
    """A year against the next and the one after, on keys where null equals null."""
    rows = _lines(t).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    yearly = rows.groupBy("p_brand", F.nullif("l_returnflag", F.lit("N")).alias("flag"), "ship_year").agg(F.sum("cents").alias("v"))
    diffs = [joins.edition_join(yearly, ["p_brand", "flag"], "ship_year", k, ["v"]) for k in (1, 2)]
    return A.union_all(*diffs).withColumn("delta", F.col("to_v") - F.col("from_v"))


@_query("""WITH p AS (SELECT p_brand, p_size, CAST(max(round(p_retailprice * 100)) AS BIGINT) AS price FROM part WHERE p_size % 2 = 0 GROUP BY ALL),
  g AS (SELECT p_brand, CAST(min(round(p_retailprice * 100)) AS BIGINT) AS price FROM part GROUP BY ALL)
  SELECT p_partkey, part.p_brand, part.p_size, coalesce(p.price, g.price) AS price, p.price IS NOT NULL AS is_specific FROM part LEFT JOIN p ON part.p_brand = p.p_brand AND part.p_size = p.p_size LEFT JOIN g ON part.p_brand = g.p_brand""")
def specific_then_general(t):
    """A price by brand and size, else by brand."""
    price = S.cents(F.col("p_retailprice"))
    exact = t("part").where(F.col("p_size") % 2 == 0).groupBy("p_brand", "p_size").agg(F.max(price).alias("price"))
    wide = t("part").groupBy("p_brand").agg(F.min(price).alias("price")).withColumn("p_size", F.lit(None).cast("int"))
    return joins.specific_then_general(t("part").select("p_partkey", "p_brand", "p_size"), exact.unionByName(wide), ["p_brand", "p_size"], ["p_brand"], ["price"])


@_query("""WITH m AS (SELECT l_partkey, CAST(sum(cents) AS DOUBLE) / sum(CAST(round(l_quantity) AS BIGINT)) AS unit FROM """ + LINES + """ GROUP BY l_partkey)
  SELECT p_partkey, p_brand, round(unit, 2) AS unit FROM part JOIN m ON p_partkey = l_partkey WHERE abs(unit / 100.0 - p_retailprice) < 700""")
def band_join(t):
    """Parts whose retail price lies near their mean line price."""
    unit = _lines(t).groupBy("l_partkey").agg((F.sum("cents").cast("double") / F.sum(F.round("l_quantity").cast("bigint"))).alias("unit"))
    found = joins.band_join(t("part").withColumnRenamed("p_partkey", "key"), unit.withColumnRenamed("l_partkey", "key"), ["key"], F.col("p_retailprice"), F.col("unit") / 100.0, 700)
    return found.select(F.col("key").alias("p_partkey"), "p_brand", F.round("unit", 2).alias("unit"))


@_query("""SELECT p.p_partkey, count(q.p_partkey) AS n_near, CAST(min(q.p_partkey) AS BIGINT) AS first_near
  FROM part p LEFT JOIN part q ON nullif(p.p_size, 1) IS NOT DISTINCT FROM nullif(q.p_size, 1) AND abs(p.p_retailprice - q.p_retailprice) < 2.5 AND p.p_brand = q.p_brand AND q.p_partkey % 2 = 0 GROUP BY p.p_partkey""")
def band_partners(t):
    """How many even parts of a part's size and brand lie within a price band; a size that is unknown is a size."""
    sized = t("part").select("p_partkey", "p_retailprice", "p_brand", F.nullif(F.col("p_size"), F.lit(1)).alias("size"))
    others = sized.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("near_part"), F.col("p_retailprice").alias("near_price"), "p_brand", "size")
    found = joins.band_join(sized, others, ["size", "p_brand"], F.col("p_retailprice"), F.col("near_price"), 2.5, "left", null_safe=True)
    return found.groupBy("p_partkey").agg(F.count("near_part").alias("n_near"), F.min("near_part").alias("first_near"))


@_query("""WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL)
  SELECT event_id, user_id, o.o_orderkey, o.o_orderdate AS as_of_time FROM events ASOF LEFT JOIN o ON events.user_id = o.o_custkey AND events.ts - INTERVAL 9000 DAY >= o.o_orderdate""")
def asof_orders(t):
    """The latest order of each event's user at or before a moment."""
    events = t("events").select(F.col("user_id").cast("bigint").alias("user_id"), "event_id", (F.col("ts") - F.expr("INTERVAL 9000 DAY")).alias("at"))
    orders = t("orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ordered"), "o_orderkey")
    return joins.as_of_join(events, orders, ["user_id"], "at", "ordered", ["o_orderkey"]).select("event_id", "user_id", "o_orderkey", "as_of_time")


@_query("""WITH s AS (SELECT l_orderkey, sum(cents) AS v FROM """ + LINES + """ GROUP BY l_orderkey)
  SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM s WHERE l_orderkey = o_orderkey AND abs(v - CAST(round(o_totalprice * 100) AS BIGINT)) < 5000000)""")
def semi_tolerance(t):
    """Orders whose total lies within a tolerance of their lines' sum."""
    sums = _lines(t).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("cents").alias("v"))
    return joins.band_join(t("orders"), sums, ["o_orderkey"], S.cents(F.col("o_totalprice")), F.col("v"), 5_000_000, "left_semi").select("o_orderkey", "o_custkey")


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
def anti_gaps(t):
    """Customers without an urgent order."""
    urgent = t("orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return DQ.orphans(t("customer"), urgent, ["c_custkey"]).select("c_custkey", "c_name")


@_query("""WITH d AS (SELECT 'y_' || CAST(year(o_orderdate) AS VARCHAR) || '_' || o_orderstatus AS slug, year(o_orderdate) AS y, o_custkey % 7 AS k, count(*) AS n FROM orders GROUP BY ALL),
  c AS (SELECT y, p, 'y_' || CAST(y - o AS VARCHAR) || '_' || s AS slug FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders), (VALUES (1, 'P', 0), (2, 'O', 0), (3, 'F', 1)) AS v(p, s, o)),
  g AS (SELECT c.y, k, c.slug, p, sum(n) AS n FROM c JOIN d ON c.slug = d.slug WHERE NOT (k = 3 AND p = 1) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY y, k ORDER BY p) AS rn FROM g)
  SELECT CAST(y AS INT) AS edition, k, slug, p AS priority, CAST(n AS BIGINT) AS n FROM r WHERE rn = 1""")
def pattern_cross(t):
    """Editions by candidate patterns; the first candidate that has rows wins."""
    spark = t("orders").sparkSession
    patterns = spark.createDataFrame([(1, "P", 0), (2, "O", 0), (3, "F", 1)], "priority int, status string, years_back int")
    orders = t("orders").select(F.year("o_orderdate").alias("y"), "o_orderstatus", (F.col("o_custkey") % 7).alias("k"))
    rows = orders.groupBy(F.format_string("y_%d_%s", "y", "o_orderstatus").alias("slug"), "k").agg(F.count("*").alias("n"))
    editions = orders.select(F.col("y").alias("edition")).distinct()
    candidates = editions.crossJoin(F.broadcast(patterns)).select("edition", "priority", F.format_string("y_%d_%s", F.col("edition") - F.col("years_back"), F.col("status")).alias("slug"))  # 3 literal rows
    usable = candidates.join(rows, "slug").where(~((F.col("k") == 3) & (F.col("priority") == 1)))
    return picks.pick_first(usable, ["edition", "k"], [F.asc("priority")]).select("edition", "k", "slug", "priority", "n")


@_query("""WITH s AS (SELECT c_nationkey, c_mktsegment, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
  SELECT c_nationkey, c_mktsegment, CAST(v AS BIGINT) AS v, round(CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY c_nationkey) AS DOUBLE), 6) AS share FROM s""")
def share_of_partition(t):
    """Each segment's share of its nation."""
    sums = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_mktsegment").agg(F.sum(S.cents(F.col("o_totalprice"))).alias("v"))
    return sums.withColumn("share", A.share_of("v", ["c_nationkey"]))


@_query("""WITH s AS (SELECT p_brand, l_suppkey, sum(cents) AS v FROM """ + LINES + """ JOIN part ON l_partkey = p_partkey GROUP BY ALL),
  r AS (SELECT *, row_number() OVER w AS rn, lead(v) OVER w AS v2, lead(l_suppkey) OVER w AS s2 FROM s WINDOW w AS (PARTITION BY p_brand ORDER BY v DESC, l_suppkey))
  SELECT p_brand, l_suppkey AS winner, s2 AS runner_up, round(CASE WHEN v = 0 THEN NULL ELSE CAST(v - v2 AS DOUBLE) / CAST(v AS DOUBLE) END, 4) AS margin FROM r WHERE rn = 1""")
def winner_margin(t):
    """First and second supplier of a brand and the margin between them."""
    return picks.winner_margin(_lines(t).join(t("part"), F.col("l_partkey") == F.col("p_partkey")), ["p_brand"], "l_suppkey", "cents")


@_query("""WITH b AS (SELECT p_brand, ship_year, CAST(sum(cents) AS BIGINT) AS v FROM """ + LINES + """ JOIN part ON l_partkey = p_partkey GROUP BY ALL),
  p AS (SELECT p_brand, CAST(sum(v) FILTER (ship_year = 1999) AS BIGINT) AS base, CAST(sum(v) FILTER (ship_year = 2001) AS BIGINT) AS now FROM b GROUP BY p_brand),
  m AS (SELECT p_brand, ship_year, s_nationkey, sum(cents) AS v FROM """ + LINES + """ JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
  h AS (SELECT p_brand, ship_year, sum(share * share) AS hhi, sum(v) AS v FROM (SELECT *, 100.0::DOUBLE * v / sum(v) OVER (PARTITION BY p_brand, ship_year) AS share FROM m) GROUP BY ALL),
  f AS (SELECT l_suppkey, min(ship_year) AS first_year, sum(cents) AS v FROM """ + LINES + """ GROUP BY l_suppkey)
  SELECT 'swing' AS event_type, p_brand AS subject, CAST(now AS DOUBLE) AS headline, CAST(base AS DOUBLE) AS comparison, 2001 AS fiscal_year FROM p WHERE base >= 50000 AND now IS NOT NULL AND abs(round(100.0::DOUBLE * (now - base) / base, 2)) >= 10
  UNION ALL SELECT 'zeroed', p_brand, CAST(base AS DOUBLE), 0.0, 2001 FROM p WHERE base > 0 AND now = 0
  UNION ALL SELECT 'concentration', p_brand, round(hhi, 4), CAST(v AS DOUBLE), ship_year FROM h WHERE v >= 5000000
  UNION ALL (SELECT 'entrant', CAST(l_suppkey AS VARCHAR), CAST(v AS DOUBLE), CAST(first_year AS DOUBLE), first_year FROM f WHERE first_year >= 1995 AND v >= 1000000 ORDER BY v DESC, CAST(l_suppkey AS VARCHAR) LIMIT 25)""")
def feed_events(t):
    """Four detectors in one feed: swings, zeroed lines, concentration, new entrants (top 25)."""
    rows = _lines(t).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    wide = A.conditional_pivot(rows, ["p_brand"], "ship_year", {"base": 1999, "now": 2001}, "cents")
    event = lambda df, kind, subject, headline, comparison, year: df.select(F.lit(kind).alias("event_type"), subject.cast("string").alias("subject"), headline.cast("double").alias("headline"), comparison.cast("double").alias("comparison"), year.cast("int").alias("fiscal_year"))
    swings = wide.where((F.col("base") >= 50_000) & F.col("now").isNotNull() & (F.abs(A.pct_change(F.col("now"), F.col("base"))) >= 10))
    zeroed = wide.where((F.col("base") > 0) & (F.col("now") == 0))
    shares = rows.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("p_brand", "ship_year", "s_nationkey").agg(F.sum("cents").alias("v"))
    shares = shares.withColumn("share", F.lit(100.0) * F.col("v") / F.sum("v").over(Window.partitionBy("p_brand", "ship_year")))
    held = shares.groupBy("p_brand", "ship_year").agg(F.sum(F.col("share") * F.col("share")).alias("hhi"), F.sum("v").alias("v")).where("v >= 5000000")
    first = _lines(t).groupBy("l_suppkey").agg(F.min("ship_year").alias("first_year"), F.sum("cents").alias("v")).where("first_year >= 1995 AND v >= 1000000")
    top = first.orderBy(F.desc("v"), F.col("l_suppkey").cast("string")).limit(25)
    c = F.col
    return A.union_all(
        event(swings, "swing", c("p_brand"), c("now"), c("base"), F.lit(2001)), event(zeroed, "zeroed", c("p_brand"), c("base"), F.lit(0.0), F.lit(2001)),
        event(held, "concentration", c("p_brand"), F.round("hhi", 4), c("v"), c("ship_year")), event(top, "entrant", c("l_suppkey"), c("v"), c("first_year"), c("first_year")),
    )


@_query("""WITH s AS (SELECT l_returnflag, p_brand, sum(cents) AS v FROM """ + LINES + """ JOIN part ON l_partkey = p_partkey GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY v DESC, p_brand) AS rn FROM s)
  SELECT l_returnflag, CASE WHEN rn <= 5 THEN p_brand ELSE 'Other' END AS p_brand, CAST(sum(v) AS BIGINT) AS cents, count(*) AS members FROM r GROUP BY ALL""")
def topn_other(t):
    """Top five brands and the rest, totals conserved."""
    return A.top_n_other(_lines(t).join(t("part"), F.col("l_partkey") == F.col("p_partkey")), ["l_returnflag"], "p_brand", "cents", 5)


@_query("""SELECT o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('0|' || o_orderkey), o_orderkey) <= 10""")
def stratified_pick(t):
    """Up to ten orders a status by a hash; the same ones every run."""
    return picks.stratified_sample(t("orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], ["o_orderkey"], 10)


@_query("""SELECT p_partkey, CASE p_partkey % 9 WHEN 5 THEN 'UNITED GLOBAL' WHEN 6 THEN 'UNITED CAPITAL' WHEN 7 THEN 'US ' || upper(p_name) WHEN 8 THEN upper(p_name) || ' ONE TWO' ELSE upper(p_name) END AS normal_name FROM part""")
def name_normalise(t):
    """Names under legal endings, divisions repeated and behind a generic head, points and articles, in their normal form."""
    name, at = F.col("p_name"), F.col("p_partkey") % 9
    forms = [
        F.concat(F.lit("the "), name, F.lit(", Inc.")), F.concat(name, F.lit(" L.L.C.")), F.concat(F.lit("The "), name, F.lit(" Company, The (Inc)")), F.concat(name, F.lit(" Global Capital Global Capital Corp")),
        F.concat(name, F.lit(" Defense Systems Mission Systems Tactical Systems North American Global Capital Global Capital")), F.lit("United Global Capital"), F.lit("United Capital LLC"),
        F.concat(F.lit("U.S., "), name, F.lit("  CO.")), F.concat(name, F.lit("-one/TWO Ltd")),
    ]
    spelled = t("part").select("p_partkey", F.coalesce(*[F.when(at == k, form) for k, form in enumerate(forms)]).alias("spelled"))
    names = entities.name_table(spelled, "spelled")
    return spelled.join(names, "spelled").select("p_partkey", "normal_name")


@_query("""WITH s AS (SELECT o_custkey, l_suppkey, s_nationkey, sum(cents) AS v, count(*) AS n FROM """ + LINES + """ JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC, n DESC, l_suppkey, s_nationkey) AS rn FROM s)
  SELECT o_custkey, l_suppkey, s_nationkey, CAST(v AS BIGINT) AS pair_amount, n AS pair_rows FROM r WHERE rn = 1""")
def pair_pick(t):
    """The whole (supplier, nation) pair with most money per customer."""
    return entities.pair_pick(_sales(t).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")), "o_custkey", ["l_suppkey", "s_nationkey"], "cents")


@_query("""WITH a AS (SELECT p_partkey, p_brand, list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda x: length(x) > 3 AND x NOT IN ('small'))) AS w, p_size FROM part)
  SELECT a.p_brand, a.p_partkey AS line_key, b.p_partkey AS award_key, len(list_intersect(a.w, b.w)) AS overlap, array_to_string(list_sort(list_intersect(a.w, b.w)), ' ') AS shared,
    CASE WHEN len(list_intersect(a.w, b.w)) >= 2 THEN 'high' WHEN a.p_size % 10 = 0 THEN 'medium' ELSE 'low' END AS tier
  FROM a JOIN a b ON a.p_brand = b.p_brand AND a.p_size % 10 = b.p_size % 10 AND a.p_size < b.p_size""")
def token_overlap_tier(t):
    """Shared telling words of lines and awards under one key, and the tier they give."""
    words = matching.tokens(F.concat_ws(" ", "p_name", "p_type"), longer_than=3, stop=matching.LINK_STOP_WORDS)
    part = t("part").withColumn("k", F.col("p_size") % 10).withColumn("words", words)
    left = part.select("p_brand", "k", F.col("p_partkey").alias("line_key"), F.col("p_size").alias("line_size"), F.col("words").alias("line_words"))
    right = part.select("p_brand", "k", F.col("p_partkey").alias("award_key"), F.col("p_size").alias("award_size"), F.col("words").alias("award_words"))
    tier = matching.overlap_tier(F.size(F.array_intersect("line_words", "award_words")), F.col("line_size") % 10 == 0)
    return matching.token_overlap(left, right, "line_key", "award_key", "line_words", "award_words", ["p_brand", "k"], where=F.col("line_size") < F.col("award_size"), made={"tier": tier}).drop("k")


@_query("""WITH k AS (SELECT DISTINCT p_name AS short_name FROM part), l AS (SELECT p_partkey, lower(p_type || ' ' || p_name || ' ' || p_brand) AS long_name FROM part)
  SELECT short_name, p_partkey, len(string_split(short_name, ' ')) AS n FROM k JOIN l ON contains(' ' || replace(replace(long_name, '#', ' '), '  ', ' ') || ' ', ' ' || lower(short_name) || ' ')""")
def contiguous_containment(t):
    """Names whose words stand in a row inside longer names, by an n-gram join."""
    short = t("part").select(F.col("p_name").alias("short_name")).distinct()
    long = t("part").select("p_partkey", F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("long_name"))
    return matching.contained_in(short, long, "short_name", "p_partkey", "short_name", "long_name")


@_query(r"""WITH w AS (SELECT item_id, regexp_split_to_array(upper(text), '[^A-Z0-9]+') AS a FROM benchmark),
  t AS (SELECT item_id, term, min(place) AS place FROM (SELECT item_id, unnest(a) AS term, generate_subscripts(a, 1) AS place FROM w) WHERE length(term) >= 9 GROUP BY item_id, term),
  d AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(upper(text), '[^A-Z0-9]+'))) AS term FROM documents)
  SELECT doc_id, item_id, 'multi_token' AS evidence, string_agg(term, '|' ORDER BY place) AS matched FROM d JOIN t USING (term) GROUP BY ALL HAVING count(*) >= 2""")
def mention_tiers(t):
    """Documents that mention an item by two telling words or more; a word counts for every item that has it."""
    terms = matching.title_terms(t("benchmark"), "item_id", "text", least=9)
    return matching.mentions(t("documents"), terms, "doc_id", "text", "item_id").drop("snippet")


@_query(r"""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a href="([^"]*)">', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?is)<a href="([^"]*)">', 1), 1) AS pos FROM pages)
  SELECT page_id, CAST(pos - 1 AS INT) AS pos, href FROM p""")
def page_links(t):
    """The links of every page in order."""
    found = F.regexp_extract_all("html", F.lit(r'(?is)<a href="([^"]*)">'), 1)
    return t("pages").select("page_id", F.posexplode(found).alias("pos", "href"))


# The blocks that the provided pages have; any of their tags ends a paragraph.
_BLOCK_TAGS = "</?(?:p|li|ul|nav|div|article|h1|footer|body|html)(?:\\s[^>]*)?>"


@_query(rf"""WITH read AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g') AS html FROM pages),
  p AS (SELECT page_id, regexp_split_to_array(html, '(?i)<p(?:\s[^>]*)?>')[2:] AS all_p FROM read),
  q AS (SELECT page_id, unnest(all_p) AS raw, generate_subscripts(all_p, 1) AS pos FROM p),
  c AS (SELECT page_id, CAST(pos - 1 AS INT) AS pos, regexp_replace(regexp_extract(raw, '(?is)^(.*?)(?:{_BLOCK_TAGS}|$)', 1), '(?s)<[^>]*>', ' ', 'g') AS tagless FROM q),
  d AS (SELECT page_id, pos, replace(replace(replace(replace(replace(tagless, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM c)
  SELECT page_id, pos, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text, CAST(len(regexp_extract_all(t, '\$\s?[0-9][0-9,]*')) AS INT) AS n_amounts FROM d""")
def page_paragraphs(t):
    """Clean paragraphs of every page with the money they name."""
    return html.paragraphs(t("pages"), "page_id", "html").select("page_id", "pos", "text", F.size(matching.money_mentions(F.col("text"))).alias("n_amounts"))


@_query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, m AS b FROM (SELECT o_custkey, min(o_custkey) OVER (PARTITION BY l_partkey, l_shipdate) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE o_custkey <> m),
  u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
  SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a""")
def components(t):
    """Customers who bought the same part shipped on the same day, as connected components."""
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    first = F.min("o_custkey").over(Window.partitionBy("l_partkey", "l_shipdate"))
    return graph.connected_components(rows.select("o_custkey", first.alias("first")).where("o_custkey <> first"), "o_custkey", "first")


@_query("""WITH RECURSIVE n AS (SELECT o_orderkey AS s, lead(o_orderkey) OVER w AS d, o_orderdate AS a, lead(o_orderdate) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
  e AS (SELECT s, d FROM n WHERE d IS NOT NULL AND b <= a + INTERVAL 120 DAY),
  c(node, root, step) AS (SELECT s, s, 0 FROM e WHERE s NOT IN (SELECT d FROM e) UNION ALL SELECT e.d, c.root, c.step + 1 FROM c JOIN e ON e.s = c.node)
  SELECT node, root, CAST(step AS BIGINT) AS step FROM c""")
def chain_one_to_one(t):
    """Runs of a customer's orders with at most 120 days between, as chains from their first order."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    following = t("orders").select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(w).alias("dst"), "o_orderdate", F.lead("o_orderdate").over(w).alias("next_date"))
    return chains.one_to_one_chains(following.where(F.col("dst").isNotNull() & (F.col("next_date") <= F.col("o_orderdate") + F.expr("INTERVAL 120 DAY"))))


@_query("""SELECT o_custkey, substr(sha256(CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus || '|' || ''), 1, 16) AS fact, count(*) AS n_rows, CASE WHEN count(*) = 1 THEN min(o_orderkey) END AS single_source FROM orders GROUP BY o_custkey, o_orderstatus""")
def fact_ids(t):
    """Fact ids over keys with an absent part, and the source where only one row contributed."""
    fact = S.fact_id(F.col("o_custkey"), F.col("o_orderstatus"), F.lit(None), absent_as_empty=(2,))
    return t("orders").groupBy("o_custkey", fact.alias("fact")).agg(F.count("*").alias("n_rows"), ledger.single_source("o_orderkey").alias("single_source"))


@_query("""WITH s AS (SELECT l_orderkey AS o_orderkey, sum(cents) AS gross, sum(CAST(round(l_extendedprice * 100 * (1 - l_discount)) AS BIGINT)) AS net FROM """ + LINES + """ GROUP BY ALL),
  c AS (SELECT o_orderkey, 1 AS p, 'gross' AS c, gross AS v FROM s UNION ALL SELECT o_orderkey, 2, 'net', net FROM s),
  o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
  SELECT o_orderkey, cents, bool_or(coalesce(abs(cents - v) <= 10000000, c IS NULL AND cents = 0)) AS matched, arg_min(c, p) FILTER (abs(cents - v) <= 10000000) AS candidate, count(c) AS candidates
  FROM o LEFT JOIN c USING (o_orderkey) GROUP BY ALL""")
def reconcile_orders(t):
    """Order totals against candidate formulas over their lines; any candidate within tolerance matches."""
    net = F.round(F.col("l_extendedprice") * 100 * (1 - F.col("l_discount"))).cast("bigint")
    sums = _lines(t).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("cents").alias("gross"), F.sum(net).alias("net"))
    controls = sums.unpivot("o_orderkey", ["gross", "net"], "candidate", "control").withColumn("priority", F.when(F.col("candidate") == "gross", 1).otherwise(2))
    orders = t("orders").select("o_orderkey", S.cents(F.col("o_totalprice")).alias("cents"))
    return ledger.reconcile_candidates(orders, controls, ["o_orderkey"], "cents", F.lit(10_000_000))


@_query("""WITH b AS (SELECT o_custkey, 'adjudicated' AS method, max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), n AS (SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 'adjudicated' ELSE 'tokens' END AS method, min(o_orderkey) AS v FROM orders GROUP BY ALL),
  u AS (SELECT *, 0 AS is_new FROM b UNION ALL SELECT *, 1 FROM n)
  SELECT o_custkey, method, v FROM u QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE method WHEN 'adjudicated' THEN 0 ELSE 1 END, is_new DESC) = 1""")
def upsert_guarded(t):
    """A batch over standing rows, where a stronger method isn't overwritten by a weaker one."""
    standing = t("orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("v")).select("o_custkey", F.lit("adjudicated").alias("method"), "v")
    batch = t("orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("v")).select("o_custkey", F.when(F.col("o_custkey") % 2 == 0, "adjudicated").otherwise("tokens").alias("method"), "v")
    return picks.upsert(standing, batch, ["o_custkey"], F.when(F.col("method") == "adjudicated", 0).otherwise(1))


@_query("""WITH s AS (SELECT l_partkey, sum(cents) AS v FROM """ + LINES + """ GROUP BY ALL), k AS (SELECT p_partkey FROM part WHERE p_type = 'PROMO'), a AS (SELECT sum(v) AS a, sum(v) FILTER (l_partkey IN (SELECT p_partkey FROM k)) AS c FROM s)
  SELECT l_partkey, CAST(v AS BIGINT) AS cents, floor(c * 1000::DOUBLE / a) / 10 AS covered_pct FROM s, a WHERE l_partkey NOT IN (SELECT p_partkey FROM k) ORDER BY v DESC, l_partkey LIMIT 10""")
def coverage_dollars(t):
    """The largest parts that a selection leaves out, beside the share of money it covers."""
    covered = t("part").where("p_type = 'PROMO'").select(F.col("p_partkey").alias("l_partkey"))
    return A.coverage(_lines(t), covered, ["l_partkey"], "cents")


@_query("""WITH s AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL)
  SELECT o_custkey, CAST(y AS INT) AS y, n, CASE WHEN lag(y) OVER w = y - 1 THEN lag(n) OVER w END AS before FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY y)""")
def previous_period(t):
    """Each year beside the year just before, null where that is missing."""
    yearly = t("orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return picks.previous_period(yearly, ["o_custkey"], "y", "n", "before")


@_query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM events""")
def header_carry_forward(t):
    """The last header at or before each row of a user's events."""
    rows = t("events").select("user_id", "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("h"))
    return picks.carry_forward(rows, ["user_id"], "event_id", "h", "header").drop("h")


@_query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dq_grain_unique(t):
    """Grains of lineitem that occur more than once."""
    return DQ.not_unique(t("lineitem"), ["l_orderkey", "l_linenumber"])


@_query("""SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, a.v AS left_total, b.v AS right_total FROM (SELECT l_orderkey, CAST(sum(cents) AS BIGINT) AS v FROM """ + LINES + """ GROUP BY ALL) a
  FULL JOIN (SELECT o_orderkey AS l_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v FROM orders GROUP BY ALL) b ON a.l_orderkey = b.l_orderkey
  WHERE a.v IS NULL OR b.v IS NULL OR abs(a.v - b.v) > greatest(1000000, abs(b.v) * 0.25::DOUBLE)""")
def dq_totals_differ(t):
    """Orders whose lines and total differ by more than the larger of two tolerances."""
    totals = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), S.cents(F.col("o_totalprice")).alias("cents"))
    return DQ.totals_differ(_lines(t), totals, ["l_orderkey"], "cents", absolute=1_000_000, relative=0.25)


@_query("SELECT event_type, count(*) AS count FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY ALL")
def dq_accepted_values(t):
    """Event types outside a vocabulary, with their counts."""
    return DQ.not_accepted(t("events"), "event_type", ["view", "click", "purchase"])


@_query("SELECT l_partkey, count(DISTINCT s_nationkey) AS n_values FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL HAVING count(DISTINCT s_nationkey) > 1")
def dq_several_values(t):
    """Parts that resolve to more than one supplier nation."""
    return DQ.several_values(t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")), ["l_partkey"], "s_nationkey")


def _budget_lines(t) -> DataFrame:
    """Budget lines made of order lines: programs of brands, editions of ship years, with every trap the marts know."""
    rows = _lines(t).join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    back, final = F.col("l_linenumber") % 3, F.col("l_linestatus") == "F"
    late = F.when(F.col("p_size") % 7 == 0, "request").otherwise("total")
    slug = F.when(back == 2, "actuals").when((back == 1) & final, "total").when(back == 1, "enacted").otherwise(late)
    return rows.select(
        F.when(F.col("l_returnflag") == "R", "R-1").when(F.col("l_returnflag") == "A", "P-1").otherwise(F.when(F.col("p_size") % 5 == 0, "P-1R").otherwise("R-1")).alias("exhibit"),
        (F.col("ship_year") + back).alias("fiscal_year"),
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("1"), (F.col("s_nationkey") % 4).cast("string"))).otherwise("20").alias("account"),
        F.lit("title").alias("account_title"),
        F.when(F.col("p_size") % 4 == 0, F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("F")), (F.col("s_nationkey") % 3 + 1).cast("int"))).otherwise("D").alias("organization"),
        F.when(F.col("p_size") % 2 == 0, "02").alias("budget_activity"),
        F.when((F.col("p_brand") == "Brand#9") & (F.col("p_size") > 40), "9999999999").otherwise(F.concat_ws("-", "p_brand", F.col("p_size").cast("string"))).alias("pe_bli"),
        F.when(F.col("l_suppkey") % 11 != 0, F.col("p_type")).alias("title"),
        F.concat(F.lit("fy_"), F.col("ship_year").cast("string"), F.lit("_"), slug).alias("amount_type"),
        F.col("cents").alias("amount_thousands"),
        F.when(F.col("l_suppkey") % 13 != 0, F.col("l_suppkey")).alias("source_document_id"),
    )


BUDGET_LINES = """(SELECT CASE WHEN l_returnflag = 'R' THEN 'R-1' WHEN l_returnflag = 'A' THEN 'P-1' WHEN p_size % 5 = 0 THEN 'P-1R' ELSE 'R-1' END AS exhibit,
  ship_year + l_linenumber % 3 AS fiscal_year, CASE WHEN p_size % 3 = 0 THEN '1' || (s_nationkey % 4) ELSE '20' END AS account,
  CASE WHEN p_size % 4 = 0 THEN ['A', 'N', 'F'][s_nationkey % 3 + 1] ELSE 'D' END AS organization, CASE WHEN p_size % 2 = 0 THEN '02' END AS budget_activity,
  CASE WHEN p_brand = 'Brand#9' AND p_size > 40 THEN '9999999999' ELSE p_brand || '-' || p_size END AS pe_bli, CASE WHEN l_suppkey % 11 <> 0 THEN p_type END AS title,
  'fy_' || ship_year || '_' || CASE WHEN l_linenumber % 3 = 2 THEN 'actuals' WHEN l_linenumber % 3 = 1 THEN CASE WHEN l_linestatus = 'F' THEN 'total' ELSE 'enacted' END WHEN p_size % 7 = 0 THEN 'request' ELSE 'total' END AS amount_type,
  cents AS amount, CASE WHEN l_suppkey % 13 <> 0 THEN l_suppkey END AS doc
  FROM """ + LINES + """ JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

_SLOTS = ["fy_1998_actuals", "fy_1999_total", "fy_2000_total"]


@_query(f"""WITH s AS (SELECT pe_bli, organization, amount_type, account, sum(amount) AS v FROM {BUDGET_LINES} WHERE title IS NOT NULL AND amount_type IN ('fy_1998_actuals', 'fy_1999_total', 'fy_2000_total') GROUP BY ALL),
  c AS (SELECT pe_bli, organization, bool_or(n > 1) AS any_hit, bool_or(n > 1 AND amount_type = 'fy_2000_total' AND pe_bli <> '9999999999') AS new_hit FROM (SELECT pe_bli, organization, amount_type, count(DISTINCT account) AS n FROM s GROUP BY ALL) GROUP BY ALL),
  p AS (SELECT pe_bli, organization, account AS stable FROM (SELECT pe_bli, organization, account, row_number() OVER (PARTITION BY pe_bli, organization ORDER BY sum(v) DESC, account) AS rn FROM s GROUP BY pe_bli, organization, account) WHERE rn = 1),
  w AS (SELECT s.pe_bli, s.organization, CASE WHEN any_hit THEN account ELSE stable END AS account, amount_type, v FROM s JOIN c USING (pe_bli, organization) JOIN p USING (pe_bli, organization) WHERE new_hit OR NOT any_hit OR account = stable)
  SELECT pe_bli, organization, account, CAST(sum(v) FILTER (amount_type = 'fy_1998_actuals') AS BIGINT) AS fy_1998_actuals, CAST(sum(v) FILTER (amount_type = 'fy_1999_total') AS BIGINT) AS fy_1999_total,
    CAST(sum(v) FILTER (amount_type = 'fy_2000_total') AS BIGINT) AS fy_2000_total, 'title' AS account_title, CAST(sum(v) FILTER (amount_type = 'fy_2000_total') - sum(v) FILTER (amount_type = 'fy_1999_total') AS BIGINT) AS change,
    round(100.0::DOUBLE * (sum(v) FILTER (amount_type = 'fy_2000_total') - sum(v) FILTER (amount_type = 'fy_1999_total')) / nullif(sum(v) FILTER (amount_type = 'fy_1999_total'), 0), 2) + 0 AS pct_change FROM w GROUP BY ALL""")
def budget_trajectory(t):
    """The trajectory mart over budget lines made of order lines."""
    return marts.budget_trajectory(_budget_lines(t), _SLOTS)


_SERIES = f"""b AS (SELECT * FROM {BUDGET_LINES}),
  ca AS (SELECT DISTINCT pe_bli FROM (SELECT pe_bli FROM b WHERE fiscal_year = 2000 AND title IS NOT NULL AND pe_bli <> '9999999999' GROUP BY pe_bli, amount_type HAVING count(DISTINCT account) > 1)),
  co AS (SELECT DISTINCT pe_bli FROM (SELECT pe_bli FROM b WHERE fiscal_year = 2000 AND title IS NOT NULL AND pe_bli <> '9999999999' GROUP BY pe_bli, amount_type HAVING count(DISTINCT organization) > 1)),
  v AS (SELECT * FROM (VALUES ('PriorYear', 1, 'actuals', 2), ('CurrentYear', 1, 'total', 1), ('CurrentYear', 2, 'enacted', 1), ('BudgetYearOne', 1, 'total', 0), ('BudgetYearOne', 3, 'request', 0)) AS x(scenario, priority, word, back)),
  g AS (SELECT b.*, scenario, priority, back, CASE WHEN ca.pe_bli IS NOT NULL THEN account END AS acc, CASE WHEN co.pe_bli IS NOT NULL THEN organization END AS org,
      substr(sha256(coalesce('h' || doc, '') || '|' || exhibit || '|' || fiscal_year || '|' || account || '|' || organization || '|' || coalesce(budget_activity, '') || '|' || b.pe_bli || '|' || amount_type), 1, 16) AS fact
    FROM b JOIN v ON amount_type = 'fy_' || (fiscal_year - back) || '_' || word LEFT JOIN ca ON ca.pe_bli = b.pe_bli LEFT JOIN co ON co.pe_bli = b.pe_bli),
  s AS (SELECT pe_bli, fiscal_year, scenario, priority, back, amount_type, acc, org, sum(amount) AS v, count(*) AS n, CASE WHEN count(*) = 1 THEN min(fact) END AS f FROM g WHERE exhibit IN ('R-1', 'P-1') AND doc IS NOT NULL AND pe_bli <> '9999999999' GROUP BY ALL),
  l AS (SELECT pe_bli, fiscal_year, scenario, amount_type, acc, org, sum(amount) AS v FROM g WHERE exhibit <> 'P-1R' GROUP BY ALL),
  k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY pe_bli, acc, org, fiscal_year, scenario ORDER BY priority) = 1),
  series AS (SELECT pe_bli, CAST(fiscal_year - back AS INT) AS fy, CAST(fiscal_year AS INT) AS edition, CASE scenario WHEN 'PriorYear' THEN 'actuals' WHEN 'CurrentYear' THEN 'enacted' ELSE 'request' END AS kind, CAST(v AS BIGINT) AS amount, amount_type, acc AS account, org AS organization, n AS n_source_rows, f AS source_fact_id
    FROM k WHERE EXISTS (SELECT 1 FROM l WHERE l.pe_bli = k.pe_bli AND l.fiscal_year = k.fiscal_year AND l.scenario = k.scenario AND l.acc IS NOT DISTINCT FROM k.acc AND l.org IS NOT DISTINCT FROM k.org AND abs(l.v - k.v) <= 0.5))"""


def _series(t) -> DataFrame:
    documents = t("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("h"), F.col("s_suppkey").cast("string")).alias("sha256"))
    return marts.decade_series(_budget_lines(t), documents, 2000)


@_query(f"WITH {_SERIES} SELECT * FROM series")
def decade_series(t):
    """The decade mart over budget lines made of order lines: candidates, collisions, withholding, fact ids."""
    return _series(t)


@_query(f"""WITH {_SERIES}, r AS (SELECT * FROM series WHERE kind = 'request'), a AS (SELECT * FROM series WHERE kind = 'actuals'),
  p AS (SELECT r, t, 'request_vs_request' AS diff_kind FROM r JOIN r AS t ON t.edition = r.edition + 1 AND r.pe_bli = t.pe_bli AND r.account IS NOT DISTINCT FROM t.account AND r.organization IS NOT DISTINCT FROM t.organization
    UNION ALL SELECT r, t, 'request_vs_actuals' FROM r JOIN a AS t ON t.edition = r.edition + 2 AND t.fy = r.fy AND r.pe_bli = t.pe_bli AND r.account IS NOT DISTINCT FROM t.account AND r.organization IS NOT DISTINCT FROM t.organization)
  SELECT r.pe_bli AS pe_bli, r.account AS account, r.organization AS organization, r.edition AS from_edition, r.fy AS from_fy, r.amount AS from_amount, r.amount_type AS from_amount_type, r.source_fact_id AS from_source_fact_id,
    t.edition AS to_edition, t.fy AS to_fy, t.amount AS to_amount, t.amount_type AS to_amount_type, t.source_fact_id AS to_source_fact_id, diff_kind, t.amount - r.amount AS delta FROM p""")
def book_diff(t):
    """Requests against the next edition and against later actuals."""
    return marts.book_diff(_series(t))


@_query(f"""WITH e AS (SELECT organization AS a, account AS b, coalesce(budget_activity, '?') AS c, pe_bli AS d, amount AS v FROM {BUDGET_LINES} WHERE title IS NOT NULL AND amount_type = 'fy_2000_total'),
  u AS (SELECT 'total' AS level_from, 'TOTAL' AS node_from, 'component' AS level_to, a AS node_to, a, v FROM e UNION ALL SELECT 'component', a, 'appropriation', a || '|' || b, a, v FROM e
    UNION ALL SELECT 'appropriation', a || '|' || b, 'budget_activity', a || '|' || b || '|' || c, a, v FROM e UNION ALL SELECT 'budget_activity', a || '|' || b || '|' || c, 'program', a || '|' || b || '|' || c || '|' || d, a, v FROM e)
  SELECT level_from, node_from, level_to, node_to, CAST(sum(v) AS BIGINT) AS amount, count(*) AS line_count, CASE a WHEN 'A' THEN 'Army' WHEN 'N' THEN 'Navy' ELSE a END AS component_label FROM u GROUP BY ALL""")
def flow_edges(t):
    """The budget river as edges of four levels."""
    return marts.flow_edges(_budget_lines(t), "fy_2000_total", {"A": "Army", "N": "Navy"})


@_query("""SELECT w AS word, count(*) AS n_parts, CAST(sum(round(p_retailprice * 100)) AS BIGINT) AS cents FROM (SELECT p_partkey, p_retailprice, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part) WHERE w IN ('red', 'ring', 'bolt', 'blue') GROUP BY w""")
def list_membership(t):
    """Rows whose delimited list holds a value, as one exploded join."""
    spark = t("part").sparkSession
    asked = spark.createDataFrame([("red",), ("ring",), ("bolt",), ("blue",)], "word string")
    joined = joins.list_member_join(asked, t("part"), "word", "p_name", " ")
    return joined.groupBy("word").agg(F.count("*").alias("n_parts"), F.sum(S.cents(F.col("p_retailprice"))).alias("cents"))


@_query("""WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS family_key, CAST(round(s_acctbal * 100) AS BIGINT) AS amount, CASE s_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN s_suppkey % 2 = 0 THEN 'N' || s_nationkey END AS fam FROM supplier),
  n AS (SELECT coalesce(fam, family_key) AS family, * FROM s)
  SELECT family, CAST(sum(amount) AS BIGINT) AS amount, count(*) AS members, CASE max(CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS worst_confidence, arg_max(family_key, (amount, family_key)) AS largest_member FROM n GROUP BY family""")
def family_rollup(t):
    """Suppliers folded into curated families with the worst confidence by rank."""
    confidence = F.when(F.col("s_suppkey") % 3 == 0, "high").when(F.col("s_suppkey") % 3 == 1, "medium").otherwise("low")
    rows = t("supplier").select(F.col("s_suppkey").cast("string").alias("family_key"), S.cents(F.col("s_acctbal")).alias("amount"), confidence.alias("confidence"), "s_suppkey", "s_nationkey")
    members = rows.where("s_suppkey % 2 = 0").select("family_key", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("family"))
    return entities.family_rollup(rows.drop("s_suppkey", "s_nationkey"), members)


@_query("""WITH s AS (SELECT c_nationkey, c_name, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
  SELECT c_nationkey, c_name, CAST(v AS BIGINT) AS cents, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY v DESC, c_name) AS INT) AS place FROM s QUALIFY place <= 2""")
def top_names(t):
    """The two names with most money per nation."""
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("cents", S.cents(F.col("o_totalprice")))
    return entities.top_names(rows, "c_nationkey", "c_name", "cents")


@_query("""SELECT p_brand || p_size AS k, count(*) AS members, count(CASE WHEN p_type <> 'PROMO' THEN p_type END) AS with_account, count(DISTINCT CASE WHEN p_type <> 'PROMO' THEN p_type END) AS accounts,
  count(CASE WHEN p_type <> 'PROMO' THEN p_type END) = count(*) AND count(DISTINCT CASE WHEN p_type <> 'PROMO' THEN p_type END) = count(*) AS resolvable FROM part GROUP BY ALL HAVING count(*) > 1""")
def split_keys(t):
    """Shared keys whose members all have accounts of their own, and those that can't be told apart."""
    rows = t("part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("k"), F.nullif("p_type", F.lit("PROMO")).alias("account"))
    return links.split_keys(rows, "k", "account")


@_query("SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) = 1")
def exactly_one(t):
    """Parts whose evidence names exactly one supplier."""
    return links.exactly_one(t("lineitem").where("l_returnflag = 'R' AND l_quantity > 45"), ["l_partkey"], "l_suppkey")


@_query("""WITH b AS (SELECT l_partkey, l_suppkey, 1 AS n FROM lineitem WHERE l_quantity = 50 UNION ALL SELECT l_partkey, l_suppkey, 0 FROM lineitem WHERE l_quantity = 1)
  SELECT l_partkey, count(DISTINCT l_suppkey) AS values FROM b GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1 AND max(n) = 1""")
def contradictions(t):
    """Keys on which incoming claims disagree with standing ones or with each other."""
    return links.contradictions(t("lineitem").where("l_quantity = 50"), t("lineitem").where("l_quantity = 1"), ["l_partkey"], "l_suppkey")


@_query("""WITH c AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount >= 0.1), v AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'accept' ELSE 'reject' END AS verdict FROM part WHERE p_size <= 30)
  SELECT CASE WHEN c.k IS NULL THEN 'stale' WHEN verdict IS NULL THEN 'unadjudicated' WHEN verdict = 'accept' THEN 'accepted' ELSE 'rejected' END AS state, count(*) AS count FROM c FULL JOIN v ON c.k = v.k GROUP BY ALL""")
def verdict_report(t):
    """Accepted, rejected, unadjudicated and stale candidates."""
    candidates = t("lineitem").where("l_discount >= 0.1D").select(F.col("l_partkey").alias("k"))
    verdicts = t("part").where("p_size <= 30").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 2 == 0, "accept").otherwise("reject").alias("verdict"))
    return links.verdict_report(candidates, verdicts, ["k"])


@_query("""WITH a AS (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v FROM orders GROUP BY ALL), b AS (SELECT o_custkey, CAST(sum(cents) AS BIGINT) AS v FROM """ + LINES + """ JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
  SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.v AS left_total, b.v AS right_total, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN round(CASE WHEN greatest(abs(a.v), abs(b.v)) > 0 THEN abs(a.v - b.v)::DOUBLE / greatest(abs(a.v), abs(b.v)) * 100 ELSE 0 END, 4) END AS difference_pct,
    a.v IS NOT NULL AND b.v IS NOT NULL AND abs(a.v - b.v)::DOUBLE / greatest(abs(a.v), abs(b.v)) * 100 <= 25 AS passed FROM a FULL JOIN b ON a.o_custkey = b.o_custkey""")
def group_reconciliation(t):
    """Customers' order totals against their lines, in per cent of the larger."""
    orders = t("orders").select("o_custkey", S.cents(F.col("o_totalprice")).alias("cents"))
    return gates.group_reconciliation(orders, _sales(t).select("o_custkey", "cents"), "o_custkey", "cents", tolerance_pct=25)


@_query("SELECT count(*) FILTER (l_linestatus = 'F') AS held, count(*) AS total, round(count(*) FILTER (l_linestatus = 'F')::DOUBLE / count(*), 6) AS share, count(*) FILTER (l_linestatus = 'F')::DOUBLE / count(*) >= 0.4 AS passed FROM lineitem")
def share_gate(t):
    """The share of final lines against a floor."""
    return gates.share_gate(t("lineitem"), F.col("l_linestatus") == "F", 0.4)


@_query("""WITH k AS (SELECT text, min((lang, doc_id)) AS m FROM documents GROUP BY text)
  SELECT doc_id, lang, struct_extract_at(m, 2) AS kept_id, doc_id <> struct_extract_at(m, 2) AS superseded FROM documents JOIN k USING (text)""")
def collapse_duplicates(t):
    """Documents of equal content: the lowest title stays, the others are superseded."""
    docs = t("documents").select("doc_id", "lang", F.sha2("text", 256).alias("hash"))
    return ledger.collapse_duplicates(docs, ["hash"], "lang", "doc_id").select("doc_id", "lang", "kept_id", "superseded")


@_query("""WITH d AS (SELECT CAST(o_orderkey AS VARCHAR) AS fact_id, CASE WHEN o_orderkey % 5 = 0 THEN 'difference' ELSE 'sum' END AS operation, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders),
  i AS (SELECT CAST(l_orderkey AS VARCHAR) AS fact_id, l_linenumber, min(cents) AS v FROM """ + LINES + """ WHERE l_linenumber <= 2 GROUP BY ALL),
  s AS (SELECT d.fact_id, d.operation, d.v, sum(CASE WHEN d.operation = 'difference' AND l_linenumber > 1 THEN -i.v ELSE i.v END) AS r, count(i.v) AS n FROM d LEFT JOIN i ON i.fact_id = d.fact_id GROUP BY ALL)
  SELECT fact_id, operation, CAST(r AS BIGINT) AS recomputed, CAST(n AS BIGINT) AS resolved, CASE WHEN n < 2 THEN 'unresolved_input' WHEN r <> v THEN 'mismatch' ELSE 'ok' END AS verdict FROM s""")
def verify_derived(t):
    """Order totals recomputed as facts from two input facts each."""
    key = F.col("o_orderkey").cast("string")
    inputs = F.array(F.concat(key, F.lit("-1")), F.concat(key, F.lit("-2")))
    derived = t("orders").select(key.alias("fact_id"), F.when(F.col("o_orderkey") % 5 == 0, "difference").otherwise("sum").alias("operation"), inputs.alias("inputs"), S.cents(F.col("o_totalprice")).alias("value"))
    facts = _lines(t).groupBy(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("fact_id")).agg(F.min("cents").alias("value"))
    return ledger.verify_derived(derived, facts).select("fact_id", "operation", F.col("recomputed").cast("bigint").alias("recomputed"), "resolved", "verdict")


@_query(f"""WITH {_SERIES}, cells AS (SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY pe_bli, account, organization, fy, kind ORDER BY edition DESC, amount DESC) = 1)
  SELECT pe_bli, account, organization, fy, max(amount) FILTER (kind = 'request') AS request, max(source_fact_id) FILTER (kind = 'request') AS request_fact, max(amount) FILTER (kind = 'enacted') AS enacted, max(amount) FILTER (kind = 'actuals') AS actuals FROM cells GROUP BY ALL""")
def years_matrix(t):
    """Programs by year with a cell for each kind; absent stays absent."""
    wide = marts.years_matrix(_series(t), ["request", "enacted", "actuals"])
    return wide.select("pe_bli", "account", "organization", "fy", F.col("request.amount").alias("request"), F.col("request.source_fact_id").alias("request_fact"), F.col("enacted.amount").alias("enacted"), F.col("actuals.amount").alias("actuals"))


@_query("""WITH tx AS (SELECT CAST(l_suppkey AS VARCHAR) AS uei, s_name || CASE WHEN ship_year % 2 = 0 THEN ', Inc.' ELSE ' LLC' END AS name, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'P' || (c_nationkey % 4) END AS parent_uei,
      CASE WHEN l_suppkey % 5 = 0 OR l_suppkey % 7 = 0 THEN NULL ELSE 'NATION_' || (c_nationkey % 4) || ' Corp' END AS parent_name, cents FROM """ + LINES + """ JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
  t AS (SELECT uei, sum(cents) AS total FROM tx GROUP BY uei),
  n AS (SELECT uei, name FROM (SELECT uei, name, row_number() OVER (PARTITION BY uei ORDER BY sum(cents) DESC, name) AS rn FROM tx GROUP BY uei, name) WHERE rn = 1),
  p AS (SELECT uei, parent_uei, parent_name FROM (SELECT uei, parent_uei, parent_name, row_number() OVER (PARTITION BY uei ORDER BY sum(cents) DESC, count(*) DESC, parent_uei NULLS LAST, parent_name NULLS LAST) AS rn FROM tx GROUP BY uei, parent_uei, parent_name) WHERE rn = 1),
  k AS (SELECT t.uei, total, name, parent_uei, parent_name, CASE WHEN parent_name IS NOT NULL THEN replace(replace(upper(parent_name), '_', ' '), ' CORP', '') WHEN parent_uei IS NOT NULL THEN parent_uei ELSE replace(regexp_replace(upper(name), '(, INC\\.| LLC)$', ''), '#', ' ') END AS family_key,
      CASE WHEN parent_name IS NOT NULL THEN 'parent_name' WHEN parent_uei IS NOT NULL THEN 'parent_uei' ELSE 'recipient_name' END AS method FROM t JOIN n USING (uei) JOIN p USING (uei))
  SELECT family_key, uei AS recipient_uei, CAST(total AS BIGINT) AS total_obligation, name AS recipient_name, parent_uei, parent_name, method,
    CASE WHEN method <> 'recipient_name' AND count(DISTINCT parent_uei) OVER (PARTITION BY family_key) <= 1 THEN 'high' ELSE 'medium' END AS confidence FROM k""")
def entity_xwalk(t):
    """Suppliers as recipients: whole parent pairs by money, name-first families, confidence by family."""
    rows = _sales(t, customer_nation=True).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    nation, none = (F.col("c_nationkey") % 4).cast("string"), F.col("l_suppkey") % 5 == 0
    tx = rows.select(
        F.col("l_suppkey").cast("string").alias("recipient_uei"), F.concat("s_name", F.when(F.col("ship_year") % 2 == 0, ", Inc.").otherwise(" LLC")).alias("recipient_name"),
        F.when(~none, F.concat(F.lit("P"), nation)).alias("parent_uei"), F.when(~none & (F.col("l_suppkey") % 7 != 0), F.concat(F.lit("NATION_"), nation, F.lit(" Corp"))).alias("parent_name"), F.col("cents").alias("obligation"),
    )
    return entities.entity_crosswalk(tx)


@_query("""WITH p AS (SELECT DISTINCT p_partkey % 5 AS kind, p_partkey % 40 AS n, upper(p_name) AS fam, p_type AS t FROM part),
  f AS (SELECT DISTINCT fam AS family_key FROM p UNION SELECT DISTINCT 'LONE ' || fam || ' GROUP' FROM p),
  c AS (SELECT kind, n, fam, CASE kind WHEN 0 THEN fam || ', Inc.' WHEN 1 THEN 'Alias no ' || n WHEN 2 THEN t || ' ' || fam || ' LLC' WHEN 3 THEN 'Raw no ' || n ELSE 'Lone ' || lower(fam) || ' Holdings' END AS client_name, t FROM p),
  m AS (SELECT client_name, fam AS family_key, 0 AS r FROM c WHERE kind = 0 UNION ALL SELECT c.client_name, p.fam, 1 FROM c JOIN p ON p.n = c.n AND p.kind = 1 WHERE c.kind = 1 UNION ALL SELECT client_name, fam, 2 FROM c WHERE kind IN (2, 4)
    UNION ALL SELECT c.client_name, p.fam, 3 FROM c JOIN p ON p.n = c.n AND p.kind = 3 WHERE c.kind = 3 UNION ALL SELECT client_name, 'LONE ' || fam || ' GROUP', 4 FROM c WHERE kind = 4)
  SELECT client_name, family_key, ['exact_family', 'curated_alias', 'normalized', 'family_raw_name', 'suffix_residue'][min(r) + 1] AS tier, min(r) AS tier_rank FROM m GROUP BY client_name, family_key""")
def client_tiers(t):
    """Client names against families by all five tiers: the name, an alias, a word run, a raw name, what endings leave."""
    kind, name = F.col("p_partkey") % 5, F.upper("p_name")
    number = (F.col("p_partkey") % 40).cast("string")
    named = (
        F.when(kind == 0, F.concat(name, F.lit(", Inc."))).when(kind == 1, F.concat(F.lit("Alias no "), number)).when(kind == 2, F.concat_ws(" ", "p_type", name, F.lit("LLC")))
        .when(kind == 3, F.concat(F.lit("Raw no "), number)).otherwise(F.concat(F.lit("Lone "), F.lower("p_name"), F.lit(" Holdings")))
    )
    keyed = t("part").select(kind.alias("kind"), number.alias("n"), name.alias("family_key"), named.alias("client_name")).distinct()
    families = keyed.select("family_key").unionByName(keyed.select(F.concat(F.lit("LONE "), F.col("family_key"), F.lit(" GROUP")).alias("family_key"))).distinct()
    aliases = keyed.where("kind = 1").select(F.concat(F.lit("ALIAS NO "), F.col("n"), F.lit(" Corp")).alias("lda_client_name"), "family_key")
    raw = keyed.where("kind = 3").select(F.concat(F.lit("The Raw No "), F.col("n"), F.lit(" LTD")).alias("raw_name"), "family_key")
    return links.match_clients(keyed.select("client_name").distinct(), families, aliases, raw)
