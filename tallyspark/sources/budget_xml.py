"""Budget-book XML by Spark's own reader: program, project, funding and narrative rows with a path anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyspark.functions.lineage import written

# The funding columns of a program or project, in millions.
SCENARIOS = ["AllPriorYears", "PriorYear", "CurrentYear", "BudgetYearOne", "BudgetYearOneBase", "BudgetYearOneOOC"]


def _fields(names: list[str], *more: T.StructField) -> T.StructType:
    return T.StructType([*[T.StructField(n, T.StringType()) for n in names], *more])


_FUNDING = _fields(SCENARIOS)
_WORK = _fields(["Title", "Description"])
_R2A = T.StructType([
    T.StructField("ProjectMissionDescription", T.StringType()),
    T.StructField("AccomplishmentPlannedProgramList", T.StructType([T.StructField("AccomplishmentPlannedProgram", T.ArrayType(_WORK))])),
])
_PROJECT = _fields(["ProjectNumber", "ProjectTitle"], T.StructField("ProjectFunding", _FUNDING), T.StructField("R2aExhibit", _R2A))
SCHEMA = _fields(
    ["ProgramElementNumber", "ProgramElementTitle", "R1LineNumber", "AppropriationCode", "AppropriationName", "BudgetActivityNumber", "BudgetActivityTitle", "ServiceAgencyName", "BudgetYear", "ProgramElementMissionDescription"],
    T.StructField("ProgramElementFunding", _FUNDING),
    T.StructField("ProjectList", T.StructType([T.StructField("Project", T.ArrayType(_PROJECT))])),
)


def read_programs(spark: SparkSession, path: str, row_tag: str = "ProgramElement") -> DataFrame:
    """One nested row a program element of every file under ``path``; elements without a number are left out.

    ``xml_path`` holds the element's place among those of its file that have a number, from 0. A file is read in blocks
    of consecutive elements: an element's place is its place in its block after the sum of the blocks before. Rows are
    read and parsed once and stay in the shared folder; files of one name in several folders are told apart.
    """
    reader = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(SCHEMA)
    rows = reader.load(path).where(F.trim("ProgramElementNumber") != "")
    block = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")]
    rows = written(rows.select("*", *block, F.monotonically_increasing_id().alias("_row")), "programs")
    before = F.sum("n").over(Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))  # one row a block
    blocks = rows.groupBy("_path", "_start").agg(F.count("*").alias("n"), F.min("_row").alias("first"))
    blocks = blocks.select("_path", "_start", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    placed = rows.join(blocks, ["_path", "_start"]).withColumn("file", F.element_at(F.split("_path", "/"), -1))
    return placed.withColumn("xml_path", F.format_string("ProgramElement[%d]", F.col("_row") + F.col("shift"))).drop("_path", "_start", "_row", "shift")


def programs(rows: DataFrame) -> DataFrame:
    return rows.select(
        "file", F.trim("ProgramElementNumber").alias("pe_bli"), F.col("ProgramElementTitle").alias("title"), F.col("R1LineNumber").alias("r1_line_number"), F.col("AppropriationCode").alias("appropriation_code"),
        F.col("BudgetActivityNumber").alias("budget_activity"), F.col("BudgetActivityTitle").alias("budget_activity_title"), F.col("ServiceAgencyName").alias("service_agency"),
        F.col("BudgetYear").try_cast("int").alias("fiscal_year"), "xml_path",
    )


def _projects(rows: DataFrame) -> DataFrame:
    return rows.select("file", F.trim("ProgramElementNumber").alias("pe_bli"), F.col("BudgetYear").try_cast("int").alias("fiscal_year"), "xml_path", F.posexplode("ProjectList.Project").alias("place", "p")).withColumn(
        "xml_path", F.concat("xml_path", F.lit("/Project["), F.col("place").cast("string"), F.lit("]"))
    )


def _amounts(funding: Column) -> Column:
    """Scenario and amount of each funding column that holds a number."""
    pairs = F.array(*[F.struct(F.lit(s).alias("scenario"), F.trim(funding[s]).try_cast("decimal(20,3)").alias("amount_millions")) for s in SCENARIOS])
    return F.filter(pairs, lambda p: p["amount_millions"].isNotNull())


def funding(rows: DataFrame) -> DataFrame:
    """Amounts of programs (project_number null) and of their projects, long."""
    top = rows.select("file", F.trim("ProgramElementNumber").alias("pe_bli"), F.lit(None).cast("string").alias("project_number"), F.col("BudgetYear").try_cast("int").alias("fiscal_year"), "xml_path", _amounts(F.col("ProgramElementFunding")).alias("all"))
    own = _projects(rows).select("file", "pe_bli", F.trim("p.ProjectNumber").alias("project_number"), "fiscal_year", "xml_path", _amounts(F.col("p.ProjectFunding")).alias("all"))
    return top.unionByName(own).select("file", "pe_bli", "project_number", "fiscal_year", "xml_path", F.inline("all"))


def narratives(rows: DataFrame) -> DataFrame:
    """Mission descriptions of programs and projects, and accomplishments of projects, with their paths."""
    text = lambda df, project, kind, title, body, path: df.select("file", F.col("pe_bli"), project.alias("project_number"), "fiscal_year", F.lit(kind).alias("kind"), title.alias("title"), F.trim(body).alias("body"), path.alias("xml_path"))
    none, c = F.lit(None).cast("string"), F.col
    named = rows.withColumn("pe_bli", F.trim("ProgramElementNumber")).withColumn("fiscal_year", F.col("BudgetYear").try_cast("int"))
    missions = text(named, none, "mission_description", c("ProgramElementTitle"), c("ProgramElementMissionDescription"), c("xml_path"))
    projects = _projects(rows)
    own = text(projects, F.trim("p.ProjectNumber"), "project_mission_description", c("p.ProjectTitle"), c("p.R2aExhibit.ProjectMissionDescription"), c("xml_path"))
    work = projects.select("*", F.posexplode("p.R2aExhibit.AccomplishmentPlannedProgramList.AccomplishmentPlannedProgram").alias("k", "w"))
    done = text(work, F.trim("p.ProjectNumber"), "accomplishment_planned_program", c("w.Title"), c("w.Description"), F.concat("xml_path", F.lit("/AccomplishmentPlannedProgram["), c("k").cast("string"), F.lit("]")))
    return missions.unionByName(own).unionByName(done).where(F.coalesce("body", F.lit("")) != "")
