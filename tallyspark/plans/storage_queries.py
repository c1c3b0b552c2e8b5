"""Queries that write rows of the provided tables in each format and read them back through the library's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import scalars as S
from tallyspark.functions.lineage import new_folder
from tallyspark.operators import gates, ledger, merges
from tallyspark.plans.driver_tables import _query
from tallyspark.sources import budget_xml, tables
from tallyspark.streaming.ingest import ingest_new_files, read_ingested

c = F.col


def _orders(t) -> DataFrame:
    return t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", S.cents(c("o_totalprice")).alias("cents"))


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders"


@_query(_ORDERS)
def lake_round_trip(t):
    """A partitioned lake by column name, with a declared schema."""
    rows = _orders(t)
    path = new_folder(rows.sparkSession, "lake")
    rows.write.partitionBy("o_orderstatus").parquet(path)
    return tables.read_lake(rows.sparkSession, path, rows.schema)


@_query(_ORDERS)
def mart_round_trip(t):
    """A mart written whole and read back."""
    rows = _orders(t)
    path = new_folder(rows.sparkSession, "mart")
    tables.write_mart(rows, path)
    return rows.sparkSession.read.parquet(path)


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_orderpriority || ', \"quoted\"' AS note, CAST(2024 AS INT) AS fy FROM orders")
def csv_landing(t):
    """All-text CSV with quotes and commas into a partition of a lake."""
    rows = t("orders").select(c("o_orderkey").cast("string"), "o_orderstatus", F.concat("o_orderpriority", F.lit(', "quoted"')).alias("note"))
    spark = rows.sparkSession
    landed, lake = new_folder(spark, "landing"), new_folder(spark, "lake")
    rows.write.option("header", True).option("escape", '"').csv(landed)
    tables.csv_to_partition(spark, landed, lake, 2024, ["o_orderkey", "note"])
    return tables.read_lake(spark, lake)


@_query(_ORDERS)
def json_lines(t):
    """JSON lines to a table."""
    rows = _orders(t)
    landed, out = new_folder(rows.sparkSession, "json"), new_folder(rows.sparkSession, "table")
    rows.write.json(landed)
    tables.json_lines_to_table(rows.sparkSession, landed, out)
    return rows.sparkSession.read.parquet(out).select(rows.columns)


@_query("SELECT substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 2) AS shard, count(*) AS n_rows, CAST(sum(o_custkey) AS BIGINT) AS customers FROM orders GROUP BY ALL")
def sharded_facts(t):
    """Facts in one folder a key prefix."""
    rows = t("orders").select(F.sha2(c("o_orderkey").cast("string"), 256).alias("fact_id"), "o_custkey")
    path = new_folder(rows.sparkSession, "shards")
    tables.write_sharded(rows, path, "fact_id")
    read = rows.sparkSession.read.schema("fact_id string, o_custkey bigint, shard string").json(path)
    return read.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("o_custkey").alias("customers"))


@_query("SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name, CASE WHEN n_regionkey % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM nation")
def seed_table(t):
    """A curated seed that passes its checks."""
    rows = t("nation").select(c("n_nationkey").cast("string").alias("code"), c("n_name").alias("name"), F.when(c("n_regionkey") % 2 == 0, "even").otherwise("odd").alias("kind"))
    path = new_folder(rows.sparkSession, "seed")
    rows.coalesce(1).write.option("header", True).csv(path)
    return tables.read_seed(rows.sparkSession, path, T.StructType([T.StructField(n, T.StringType()) for n in rows.columns]), keys=["code"], vocabulary={"kind": ["even", "odd"]})


@_query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(year(o_orderdate) AS VARCHAR) AS fy FROM orders WHERE o_custkey % 10 <> 0")
def ingested_files(t):
    """Landed files taken once, whatever was asked twice, landed again by another name, or forgotten by the stream; rows without an id are set aside."""
    rows = t("orders").select(F.when(c("o_custkey") % 10 != 0, c("o_orderkey").cast("string")).alias("id"), F.year("o_orderdate").cast("string").alias("fy"))
    spark = rows.sparkSession
    landing, out, checkpoint, other = (new_folder(spark, n) for n in ("landing", "ingested", "stream", "stream"))
    schema = tables.text_schema("id", "fy")
    part = lambda k: rows.where(F.pmod(F.xxhash64("id", "fy"), F.lit(2)) == k)
    for k, ledger_of in ((0, checkpoint), (1, checkpoint), (0, other)):
        part(k).orderBy("id").coalesce(1).write.mode("append").option("header", True).csv(landing)
        ingest_new_files(spark, landing, out, ledger_of, schema, ["id"])
    return read_ingested(spark, out, schema)


@_query("""WITH RECURSIVE s AS (SELECT c_custkey, 'tokens' AS method, CAST(round(c_acctbal * 100) AS BIGINT) AS v FROM customer),
  b AS (SELECT o_custkey AS c_custkey, CASE WHEN o_custkey % 3 = 0 THEN 'adjudicated' ELSE 'tokens' END AS method, CAST(max(o_orderkey) AS BIGINT) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
  e AS (SELECT o_custkey AS c_custkey, 'tokens' AS method, CAST(min(o_orderkey) AS BIGINT) AS v FROM orders WHERE o_custkey % 2 = 0 GROUP BY ALL),
  u AS (SELECT *, 0 AS n FROM s UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM e)
  SELECT c_custkey, method, v FROM u QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY CASE method WHEN 'adjudicated' THEN 0 ELSE 1 END, n DESC) = 1""")
def merged_table(t):
    """A table in buckets of its keys after two batches, where a stronger method isn't overwritten by a weaker one."""
    standing = t("customer").select(c("c_custkey").cast("bigint").alias("c_custkey"), F.lit("tokens").alias("method"), S.cents(c("c_acctbal")).alias("v"))
    path, rank = new_folder(standing.sparkSession, "merged"), F.when(c("method") == "adjudicated", 0).otherwise(1)
    merges.write_buckets(standing, path, ["c_custkey"], 16)
    key = c("o_custkey").cast("bigint").alias("c_custkey")
    first = t("orders").where("o_orderstatus = 'F'").groupBy(key).agg(F.max("o_orderkey").cast("bigint").alias("v")).select("c_custkey", F.when(c("c_custkey") % 3 == 0, "adjudicated").otherwise("tokens").alias("method"), "v")
    second = t("orders").where("o_custkey % 2 = 0").groupBy(key).agg(F.min("o_orderkey").cast("bigint").alias("v")).select("c_custkey", F.lit("tokens").alias("method"), "v")
    for batch in (first, second):
        merges.upsert_into(path, batch, ["c_custkey"], 16, rank)
    return merges.read_buckets(standing.sparkSession, path, standing.schema)


@_query("""WITH b AS (SELECT o_custkey AS document_id, o_orderkey AS line, o_orderstatus = 'F' AS early FROM orders), n AS (SELECT DISTINCT document_id FROM b WHERE NOT early)
  SELECT document_id, line, early AND document_id IN (SELECT document_id FROM n) AS superseded FROM b""")
def superseded_table(t):
    """A table in buckets of its documents after a batch: standing lines of the batch's documents are flagged, none is deleted."""
    lines = t("orders").select(c("o_custkey").alias("document_id"), c("o_orderkey").alias("line"), F.lit(False).alias("superseded"), "o_orderstatus")
    path = new_folder(lines.sparkSession, "superseded")
    early = lines.where("o_orderstatus = 'F'").drop("o_orderstatus")
    merges.write_buckets(early, path, ["document_id"], 16)
    merges.supersede_into(path, lines.where("o_orderstatus <> 'F'").drop("o_orderstatus"), "document_id", 16)
    return merges.read_buckets(lines.sparkSession, path, early.schema)


@_query("SELECT p_partkey, p_brand, p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS cents, CASE WHEN p_brand < 'Brand#2' THEN p_name END AS title FROM part")
def reloaded_partitions(t):
    """Editions reloaded with their titles: those whose sums don't drift are swapped in, one that drifts changes nothing."""
    parts = t("part").select("p_partkey", "p_brand", "p_size", S.cents(c("p_retailprice")).alias("cents"), c("p_name").alias("title"))
    spark, bare = parts.sparkSession, parts.withColumn("title", F.lit(None).cast("string"))
    out = new_folder(spark, "editions")
    bare.write.partitionBy("p_brand").parquet(out)
    early = c("p_brand") < "Brand#2"
    gates.reload_partition(bare.where(early), parts.where(early), out, new_folder(spark, "staging"), ["p_brand"], ["p_brand", "p_size"], "cents", ["title"])
    try:
        gates.reload_partition(bare.where(~early), parts.where(~early).withColumn("cents", c("cents") + 1), out, new_folder(spark, "staging"), ["p_brand"], ["p_brand", "p_size"], "cents", ["title"])
    except ValueError:
        return spark.read.schema(parts.schema).parquet(out)
    raise AssertionError("a reload that drifts was taken")


@_query("SELECT 'orders' AS dataset, count(*) AS n_rows, true AS has_bytes, 'All orders.' AS scope, true AS documented FROM orders UNION ALL SELECT 'nations', count(*), true, NULL, false FROM nation")
def dataset_manifest(t):
    """Rows and bytes of exported datasets beside their scope."""
    scopes = t("orders").sparkSession.createDataFrame([("orders", "All orders.")], "dataset string, scope string")
    found = gates.manifest({"orders": t("orders"), "nations": t("nation")}, scopes)
    return found.select("dataset", "n_rows", (c("bytes") > 0).alias("has_bytes"), "scope", "documented")


def _book(t) -> DataFrame:
    """Budget-book XML made of parts: a program a part with two projects, in books of their own."""
    number = F.concat(F.lit("06"), F.lpad(c("p_partkey").cast("string"), 6, "0"), F.lit("A"))
    amount = lambda tag, value: F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))
    project = lambda k: F.concat(
        F.lit("<Project>"), amount("ProjectNumber", F.lit(f"P{k}")), amount("ProjectTitle", F.lit("t")), amount("ProjectFunding", amount("PriorYear", (c("p_size") * k).cast("string"))),
        amount("R2aExhibit", amount("ProjectMissionDescription", F.concat(F.lit(f"Project {k} of "), c("p_brand")))), F.lit("</Project>"),
    )
    body = F.concat(
        F.lit("<ProgramElement>"), amount("ProgramElementNumber", number), amount("ProgramElementTitle", c("p_name")), amount("BudgetYear", F.lit("2026")), amount("ProgramElementMissionDescription", F.when(c("p_size") % 2 == 0, F.lit("Builds it.")).otherwise("")),
        amount("ProgramElementFunding", F.concat(amount("PriorYear", c("p_size").cast("string")), amount("CurrentYear", F.lit("n/a")))), amount("ProjectList", F.concat(project(1), project(2))), F.lit("</ProgramElement>"),
    )
    # a file a book of 500 parts at most, as a document has one root
    rows = t("part").groupBy(F.floor(c("p_partkey") / 500).alias("book")).agg(F.concat(F.lit("<Book>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", body.alias("body")))), lambda x: x["body"]), ""), F.lit("</Book>")).alias("value"))
    path = new_folder(rows.sparkSession, "book")
    rows.write.partitionBy("book").text(path)
    return budget_xml.read_programs(rows.sparkSession, path)


_NUMBER = "'06' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || 'A'"


@_query(f"""SELECT {_NUMBER} AS pe_bli, p AS project_number, CAST(2026 AS INT) AS fiscal_year, 'PriorYear' AS scenario, CAST(p_size * CASE p WHEN 'P2' THEN 2 ELSE 1 END AS DOUBLE) AS amount_millions, 'ProgramElement[' || i || ']' || CASE p WHEN 'P1' THEN '/Project[0]' WHEN 'P2' THEN '/Project[1]' ELSE '' END AS xml_path
  FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey) - 1 AS i FROM part), (VALUES (NULL), ('P1'), ('P2')) AS v(p)""")
def book_funding(t):
    """Amounts of programs and projects from budget XML; text that is no number is left out."""
    return budget_xml.funding(_book(t)).select("pe_bli", "project_number", "fiscal_year", "scenario", c("amount_millions").cast("double").alias("amount_millions"), "xml_path")


@_query(f"""SELECT {_NUMBER} AS pe_bli, NULL AS project_number, 'mission_description' AS kind, 'Builds it.' AS body FROM part WHERE p_size % 2 = 0 UNION ALL SELECT {_NUMBER}, p, 'project_mission_description', 'Project ' || right(p, 1) || ' of ' || p_brand FROM part, (VALUES ('P1'), ('P2')) AS v(p)""")
def book_narratives(t):
    """Descriptions of programs and projects from budget XML."""
    return budget_xml.narratives(_book(t)).select("pe_bli", "project_number", "kind", "body")


@_query("SELECT count(*) AS kept FROM orders WHERE o_custkey % 10 <> 0")
def guarded_overwrite(t):
    """An overwrite that keeps enough rows passes its guard."""
    rows = t("orders").where("o_custkey % 10 <> 0")
    ledger.guard_overwrite(t("orders").count(), rows.count(), 1, 10)
    return rows.agg(F.count("*").alias("kept"))
