"""Reading and writing tables: declared schemas, all-text landing, partitions, seeds, shards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions.lineage import partitions_of


def text_schema(*columns: str) -> T.StructType:
    """The landing contract: every column is text."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_lake(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Hive-partitioned Parquet by column name. A declared schema saves reading every footer."""
    reader = spark.read.option("basePath", path)
    return reader.schema(schema).parquet(path) if schema else reader.option("mergeSchema", True).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    path = f"{folder}/{name}.parquet"
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def csv_to_partition(spark: SparkSession, csv: str, out: str, year: int, required: list[str]) -> DataFrame:
    """All-text CSV into the partition ``fy=year`` of a Parquet lake; other partitions stay.

    A missing required column raises before anything is written.
    """
    rows = spark.read.csv(csv, header=True, inferSchema=False, multiLine=True, escape='"')
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"{csv} lacks {missing}")
    writer = rows.withColumn("fy", F.lit(year)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("compression", "zstd").partitionBy("fy").parquet(out)
    return rows


def json_lines_to_table(spark: SparkSession, path: str, out: str) -> None:
    spark.read.json(path).write.mode("overwrite").option("compression", "zstd").parquet(out)


def read_seed(spark: SparkSession, path: str, schema: T.StructType, *, keys: list[str], vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    """A curated CSV that fails loudly: blank keys, repeated keys, values outside their vocabulary."""
    seed = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")
    blank = reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(k)), F.lit("")) == "" for k in keys])
    checks = {"blank keys": seed.where(blank), "repeated keys": seed.groupBy(*keys).count().where("count > 1")}
    for column, values in (vocabulary or {}).items():
        checks[f"unknown {column}"] = seed.where(~F.col(column).isin(*values))
    for what, bad in checks.items():
        if found := bad.limit(3).collect():
            raise ValueError(f"{path}: {what}: {[tuple(r) for r in found]}")
    return seed


def melt(wide: DataFrame, ids: list[str], *, name: str = "amount_type", value: str = "amount") -> DataFrame:
    """Wide year columns to long rows with slugged names; blanks and text that isn't a number are dropped."""
    years = [c for c in wide.columns if c not in ids]
    long = wide.select(*ids, *[F.col(f"`{c}`").cast("string").alias(_slug(c)) for c in years]).unpivot(ids, [_slug(c) for c in years], name, "melted")
    amount = F.regexp_replace("melted", "[,$]", "").try_cast("double")
    return long.withColumn(value, amount).where(F.col(value).isNotNull() & ~F.isnan(value)).drop("melted")


def _slug(header: str) -> str:
    return "_".join("".join(c if c.isalnum() else " " for c in header.lower()).split())


def nested_filings(filings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested filings to three tables: filings, activities with their entities, lobbyists once a (filing, name, position)."""
    of = lambda name: F.col(name) if name in filings.columns else F.lit(None).cast("string")
    flat = filings.select(
        "filing_uuid", "filing_year", "income", "expenses", F.col("registrant.name").alias("registrant_name"), F.col("client.name").alias("client_name"),
        of("url").alias("url"), of("filing_type").alias("filing_type"), of("filing_period").alias("filing_period"),
    )
    acts = filings.select("filing_uuid", F.posexplode_outer("lobbying_activities").alias("activity", "a"))
    activities = acts.where(F.col("a").isNotNull()).select("filing_uuid", "activity", F.col("a.general_issue_code").alias("issue_code"), (F.col("a.general_issue_code_display") if "general_issue_code_display" in _fields(filings, "lobbying_activities") else F.col("a.general_issue_code")).alias("issue_display"), F.col("a.description").alias("description"), F.to_json(F.col("a.government_entities.name")).alias("agencies_json"))
    people = acts.select("filing_uuid", F.explode_outer("a.lobbyists").alias("l")).where(F.col("l").isNotNull())
    lobbyists = people.select("filing_uuid", F.concat_ws(" ", "l.lobbyist.first_name", "l.lobbyist.last_name").alias("name"), F.col("l.covered_position").alias("covered_position"))
    # dealt by filing first: nearly all rows differ, so a map that drops repeats before the shuffle would hold a task's whole input
    lobbyists = lobbyists.repartition(partitions_of(filings.sparkSession), "filing_uuid").dropDuplicates(["filing_uuid", "name", "covered_position"])
    return flat, activities, lobbyists


def _fields(df: DataFrame, column: str) -> list[str]:
    """The field names of the structs in an array column."""
    return df.schema[column].dataType.elementType.fieldNames()


def unpivot_years(wide: DataFrame, codes: DataFrame, *, level: str = "SUMLEV", wanted: str = "040", code: str = "STATE", prefix: str = "POPESTIMATE", name: str = "population") -> DataFrame:
    """(state, year, value) from a wide all-text table: rows of the wanted level, year columns as rows, codes named.

    ``codes``: code, state. Blank values and codes without a name are left out.
    """
    years = [c for c in wide.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    rows = wide.where(F.col(level) == wanted).select(F.col(code).alias("code"), *[F.col(c).cast("string") for c in years])
    long = rows.unpivot(["code"], years, "slot", name).where(F.coalesce(F.trim(name), F.lit("")) != "")
    named = long.join(codes.select("code", "state"), "code")
    return named.select("state", F.substring("slot", len(prefix) + 1, 4).cast("int").alias("year"), F.col(name).try_cast("bigint").alias(name))


def melt_and_sum(wide: DataFrame, ids: list[str], *, key: str = "pe_bli", add: str | None = None, cell: str = "row_number") -> DataFrame:
    """Rows of a display workbook to sums a line: ``Add`` rows only, ``FY ... Amount`` columns as slugged rows.

    Footnote stars and the ending ``Amount`` go from the headers. A key with ``& / % #`` or white space in it is a
    heading and no line. Amounts that are no numbers are left out. ``cells`` lists the rows (by the column ``cell``)
    whose amounts a sum is made of.
    """
    stripped = {c: c.rstrip("*").strip() for c in wide.columns}
    years = {c: _slug(h[: -len(" Amount")]) for c, h in stripped.items() if h.upper().startswith("FY ") and h.endswith(" Amount")}
    label = F.trim(F.col(key).cast("string"))
    kept = wide.where((F.coalesce(label, F.lit("")) != "") & ~label.rlike(r"[&/%#\s]"))
    kept = kept if add is None else kept.where(F.lower(F.trim(F.col(add))) == "add")
    named = [label.alias(key) if c == key else F.col(c) for c in ids]
    long = kept.select(*named, F.col(cell).alias("cell"), *[F.col(f"`{c}`").cast("string").alias(slug) for c, slug in years.items()]).unpivot([*ids, "cell"], list(years.values()), "amount_type", "melted")
    amount = F.trim("melted").try_cast("decimal(38,6)")
    rows = long.withColumn("amount", amount).where(F.col("amount").isNotNull())
    return rows.groupBy(*ids, "amount_type").agg(F.sum("amount").alias("amount"), F.array_sort(F.collect_list("cell")).alias("cells"))


def write_mart(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_sharded(df: DataFrame, path: str, key: str, digits: int = 2) -> None:
    """One folder a key prefix, so that a reader of one fact opens one shard."""
    df.withColumn("shard", F.substring(key, 1, digits)).repartition("shard").write.mode("overwrite").partitionBy("shard").json(path)
