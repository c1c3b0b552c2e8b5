"""Composite checks: each returns one row a case with a verdict, or one row with figures and ``passed``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.scalars import canonical_number, plain_quotes
from tallyspark.operators.picks import pick_first
from tallyspark.operators.succession import CODE, clauses, has_negation, named_pairs, names_code


def share_gate(df: DataFrame, holds: Column, least: float, *, weight: str | None = None) -> DataFrame:
    """The share of rows (or of a weight) for which a condition holds, against a floor; no rows fail."""
    size = F.lit(1) if weight is None else F.col(weight)
    sums = df.agg(F.coalesce(F.sum(F.when(holds, size)), F.lit(0)).alias("held"), F.coalesce(F.sum(size), F.lit(0)).alias("total"))
    share = F.coalesce(F.try_divide(F.col("held").cast("double"), F.nullif(F.col("total"), F.lit(0)).cast("double")), F.lit(0.0))
    return sums.withColumn("share", F.round(share, 6)).withColumn("passed", share >= least)


def group_reconciliation(a: DataFrame, b: DataFrame, key: str, value: str, *, tolerance_pct: float = 0.5) -> DataFrame:
    """Sums of two tables per group, with the difference in per cent of the larger; a missing side fails."""
    left, right = (df.groupBy(key).agg(F.sum(value).alias(f"{side}_total")) for df, side in ((a, "left"), (b, "right")))
    both = left.join(right, key, "full_outer")
    largest = F.greatest(F.abs("left_total"), F.abs("right_total"))
    difference = F.when(largest > 0, F.abs(F.col("left_total") - F.col("right_total")) / largest * 100).otherwise(0.0)
    one_sided = F.col("left_total").isNull() | F.col("right_total").isNull()
    return both.withColumn("difference_pct", F.when(~one_sided, F.round(difference, 4))).withColumn("passed", ~one_sided & (difference <= tolerance_pct))


def resolution_coverage(facts: DataFrame, datasets: DataFrame) -> DataFrame:
    """Facts by dataset and resolution class; a dataset without any fact is ``uncited``."""
    counts = facts.groupBy("dataset", "resolution").count()
    return datasets.select("dataset").distinct().join(counts, "dataset", "left").select("dataset", F.coalesce("resolution", F.lit("uncited")).alias("resolution"), F.coalesce("count", F.lit(0)).alias("facts"))


def id_sets_agree(a: DataFrame, b: DataFrame, kind: str, key: str) -> DataFrame:
    """Per kind: ids that only one side has, and ids that occur more than once on a side; none may."""
    count = lambda df, name: df.groupBy(kind, key).agg(F.count("*").alias(name))
    both = count(a, "left_n").join(count(b, "right_n"), [kind, key], "full_outer").na.fill(0, ["left_n", "right_n"])
    return both.groupBy(kind).agg(
        F.count(F.when(F.col("right_n") == 0, 1)).alias("only_left"), F.count(F.when(F.col("left_n") == 0, 1)).alias("only_right"), F.count(F.when((F.col("left_n") > 1) | (F.col("right_n") > 1), 1)).alias("repeated")
    )


def drift_check(standing: DataFrame, reloaded: DataFrame, grain: list[str], value: str, required: list[str]) -> DataFrame:
    """What a reload of a partition would change: row count, amounts per grain, and blanks in required columns."""
    sums = lambda df, name: df.groupBy(*grain).agg(F.sum(value).alias(name), F.count("*").alias(f"{name}_rows"))
    renamed = sums(reloaded, "new").select(*[F.col(g).alias(f"new_{g}") for g in grain], "new", "new_rows")
    on = [F.col(g).eqNullSafe(F.col(f"new_{g}")) for g in grain]
    both = sums(standing, "old").join(renamed, on, "full_outer")
    moved = F.count(F.when(~F.col("old").eqNullSafe(F.col("new")), 1)).alias("moved_grains")
    figures = both.agg(F.coalesce(F.sum("old_rows"), F.lit(0)).alias("old_rows"), F.coalesce(F.sum("new_rows"), F.lit(0)).alias("new_rows"), moved)
    blank = F.lit(False)
    for column in required:
        blank = blank | F.col(column).isNull()
    blanks = reloaded.agg(F.count(F.when(blank, 1)).alias("blanks"))
    return figures.crossJoin(blanks).withColumn("passed", (F.col("old_rows") == F.col("new_rows")) & (F.col("moved_grains") == 0) & (F.col("blanks") == 0))  # one row each


def reload_partition(standing: DataFrame, reloaded: DataFrame, out: str, staging: str, partition: list[str], grain: list[str], value: str, required: list[str]) -> DataFrame:
    """Replace the partitions of ``out`` that a reload holds, if it drifts from the standing rows nowhere; else raise.

    The reload is written to ``staging`` and checked as read back from there; only then are its partitions swapped in.
    """
    reloaded.write.mode("overwrite").parquet(staging)
    staged = reloaded.sparkSession.read.schema(reloaded.schema).parquet(staging)
    verdict = drift_check(standing, staged, grain, value, required)
    if not (found := verdict.first()).passed:
        raise ValueError(f"the reload drifts: {found.asDict()}")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(out)
    return verdict


# Relations that an edge may have; words by which a clause calls its own move a passing one.
RELATIONS = ["realigned", "renamed", "split", "merged"]
TRANSIENT = ["one-time", "one time", "onetime", "temporary", "temporarily"]


def verify_proposals(proposals: DataFrame, candidates: DataFrame, existing: DataFrame, known: DataFrame, confirmations: DataFrame | None = None, *, require_confirmation: bool = False) -> DataFrame:
    """Proposed edges (clause_id, src, dst, relation) with the first rule that refuses each, or null.

    candidates: clause_id, pe_bli (the narrating program), clause, codes, following; existing: src, dst; known: pe_bli;
    confirmations: clause_id, src, dst, agrees. The rules' labels are fixed values; they are tried in the order below. A
    pair is a duplicate once an earlier clause's proposal of it stands; one refused confirmation refuses its pair.
    """
    joined = proposals.join(candidates.select("clause_id", "pe_bli", "clause", "codes", "following"), "clause_id", "left")
    ids = known.select("pe_bli").distinct()
    joined = joined.join(ids.select(F.col("pe_bli").alias("src"), F.lit(True).alias("src_known")), "src", "left").join(ids.select(F.col("pe_bli").alias("dst"), F.lit(True).alias("dst_known")), "dst", "left")
    joined = joined.join(existing.select("src", "dst", F.lit(True).alias("is_stated")).distinct(), ["src", "dst"], "left")
    src, dst, own, clause = (F.col(c) for c in ("src", "dst", "pe_bli", "clause"))
    blank = lambda end: F.coalesce(F.trim(end), F.lit("")) == ""
    inside = lambda end: names_code(clause, end)
    supplied = ((src == own) & ~inside(src)) | ((dst == own) & ~inside(dst))
    both = named_pairs(clause)
    taken_back = has_negation(clause) | (has_negation(F.col("following")) & (names_code(F.col("following"), src) | names_code(F.col("following"), dst)))
    rules = [
        ("V0-orphan", clause.isNull()),
        ("V7-self-loop", blank(src) | blank(dst) | (src == dst)),
        ("V3-shape", ~src.rlike(f"^{CODE}$") | ~dst.rlike(f"^{CODE}$")),
        ("V1-fabricated-endpoint", ~((inside(src) | (src == own)) & (inside(dst) | (dst == own)))),
        ("V2-this-pairing-in-multi-code-clause", supplied & (F.size("codes") > 1)),
        ("V4-relation", ~F.coalesce(F.col("relation").isin(*RELATIONS), F.lit(False))),
        ("V9-contradicts-named-pairs", (F.size(both) > 0) & ~F.exists(both, lambda p: (p["src"] == src) & (p["dst"] == dst))),
        ("V5-retracted", taken_back),
        ("V3b-unknown-pe", F.col("src_known").isNull() | F.col("dst_known").isNull()),
        ("V7-already-stated", F.col("is_stated").isNotNull()),
    ]
    first = F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(label)) for label, broken in rules])
    ruled = joined.withColumn("refusal", first)
    if confirmations is not None:
        agreed = confirmations.join(candidates.select("clause_id"), "clause_id", "left_semi").groupBy("src", "dst").agg(F.bool_and("agrees").alias("agrees"))
        ruled = ruled.join(agreed, ["src", "dst"], "left")
    else:
        ruled = ruled.withColumn("agrees", F.lit(None).cast("boolean"))
    passing = F.lower(clause).rlike("|".join(TRANSIENT))
    refused = F.coalesce(~F.col("agrees"), F.lit(require_confirmation))
    late = F.when(passing, "V11-transient").when(refused, "V10-unconfirmed")
    place = F.struct("clause_id", "relation")
    stands = F.min(F.when(F.col("refusal").isNull() & late.isNull(), place)).over(Window.partitionBy("src", "dst"))
    told = ruled.withColumn("stands", stands)
    again = F.when(F.col("stands").isNotNull() & (place > F.col("stands")), "V7-duplicate").otherwise(late)
    return told.select("clause_id", "src", "dst", "relation", F.coalesce("refusal", again).alias("refusal"))


def ratified_edges(verdicts: DataFrame, narratives: DataFrame) -> DataFrame:
    """Edges with verdict ``y`` whose evidence still stands in the current body of its narrative (fact_id, body)."""
    joined = verdicts.where("verdict = 'y'").join(narratives.select("fact_id", "body"), "fact_id")
    return joined.where(F.contains("body", F.trim("evidence_sentence"))).drop("body")


def evidence_breaks(edges: DataFrame, narratives: DataFrame) -> DataFrame:
    """Stated edges whose sentence isn't verbatim in a clause of its narrative, doesn't name an end, or names both ends
    of other pairs by the clause rules and not those of the edge."""
    named = edges.select(F.col("evidence_fact_id").alias("fact_id")).distinct()  # only these narratives are cut into clauses
    spoken = clauses(narratives.join(named, "fact_id", "left_semi").select("fact_id", "pe_bli", "body")).select(F.col("fact_id").alias("evidence_fact_id"), "pe_bli", F.trim("clause").alias("evidence_sentence")).distinct()
    joined = edges.join(spoken, ["evidence_fact_id", "evidence_sentence"], "left")
    sentence, own = F.col("evidence_sentence"), F.col("pe_bli")
    named = lambda end: names_code(sentence, F.col(end)) | (F.col(end) == own)
    told = F.transform(named_pairs(F.coalesce(sentence, F.lit(""))), lambda p: F.struct(p["src"].alias("src"), p["dst"].alias("dst")))
    contradicted = (F.size(told) > 0) & ~F.array_contains(told, F.struct("src", "dst"))
    return joined.where(own.isNull() | ~(named("src") & named("dst")) | contradicted)


def title_map(areas: DataFrame, curated: DataFrame) -> DataFrame:
    """Areas beside a curated map by title, with quotes and white space evened out, and whether one was found."""
    table = curated.select(F.lower(plain_quotes(F.col("area_title"))).alias("even"), "agency_code").dropDuplicates(["even"])
    joined = areas.withColumn("even", F.lower(plain_quotes(F.col("area_title")))).join(table, "even", "left").drop("even")
    return joined.withColumn("mapped", F.col("agency_code").isNotNull())


def stale_answers(expected: DataFrame, actual: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Golden answers (question, value) that differ now: numbers by tolerance, other text as canonical text."""
    both = expected.select("question", F.col("value").alias("expected")).join(actual.select("question", F.col("value").alias("actual")), "question", "left")
    a, b = F.col("expected").try_cast("double"), F.col("actual").try_cast("double")
    numeric = a.isNotNull() & b.isNotNull()
    same = F.when(numeric, (F.abs(a - b) <= tolerance) | (canonical_number(a) == canonical_number(b))).otherwise(F.trim("expected").eqNullSafe(F.trim("actual")))
    return both.where(~F.coalesce(same, F.lit(False)))


def golden_answers(spark: SparkSession, questions: list[tuple[str, str, str]], tolerance: float = 0.0) -> DataFrame:
    """Run each golden question (name, SQL over the session's views, expected value) and list those that differ now.

    The answer of a question is the first column of its first row; a question without rows is answered by null.
    """
    actual = None
    for name, sql, _ in questions:
        answer = spark.sql(sql)
        one = answer.limit(1).agg(F.max(F.col(f"`{answer.columns[0]}`").cast("string")).alias("value")).select(F.lit(name).alias("question"), "value")
        actual = one if actual is None else actual.unionByName(one)
    expected = spark.createDataFrame([(name, value) for name, _, value in questions], "question string, value string")
    return stale_answers(expected, actual if actual is not None else expected, tolerance)


def integrity_gate(exports: dict[str, tuple[DataFrame, DataFrame]], kind: str, key: str) -> DataFrame:
    """Per exported dataset and kind: ids that only the export or only the ledger has or that repeat, and both row counts."""
    found = None
    for name, (export, ledger_rows) in exports.items():
        rows = lambda df, side: df.groupBy(kind).agg(F.count("*").alias(f"{side}_rows"))
        one = id_sets_agree(export, ledger_rows, kind, key).join(rows(export, "export"), kind, "left").join(rows(ledger_rows, "ledger"), kind, "left").na.fill(0, ["export_rows", "ledger_rows"])
        clean = (F.col("only_left") == 0) & (F.col("only_right") == 0) & (F.col("repeated") == 0) & (F.col("export_rows") == F.col("ledger_rows"))
        one = one.select(F.lit(name).alias("dataset"), kind, "only_left", "only_right", "repeated", "export_rows", "ledger_rows", clean.alias("passed"))
        found = one if found is None else found.unionByName(one)
    return found


def first_failing_hop(lines: DataFrame, hops: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Each line with the first of the named tables that doesn't hold it, or null where the chain is whole."""
    state = lines.select(key).distinct()
    for k, (_, table) in enumerate(hops):
        state = state.join(table.select(key).distinct().withColumn(f"hop_{k}", F.lit(True)), key, "left")
    failing = F.coalesce(*[F.when(F.col(f"hop_{k}").isNull(), F.lit(name)) for k, (name, _) in enumerate(hops)])
    return state.select(key, failing.alias("first_failing"))


def manifest(datasets: dict[str, DataFrame], scopes: DataFrame, *, strict: bool = False) -> DataFrame:
    """Rows of each exported dataset, and bytes where it is read from files, beside its scope sentence.

    A dataset without a sentence is flagged, and with ``strict`` an error.
    """
    spark = scopes.sparkSession
    counts = spark.createDataFrame([], "dataset string, n_rows bigint, bytes bigint")
    for name, df in datasets.items():
        if df.inputFiles():
            files = df.groupBy("_metadata.file_path").agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("size"))
            one = files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
        else:
            one = df.agg(F.count("*").alias("n_rows"), F.lit(None).cast("bigint").alias("bytes"))
        counts = counts.unionByName(one.select(F.lit(name).alias("dataset"), "n_rows", "bytes"))
    found = counts.join(scopes.select("dataset", "scope"), "dataset", "left").withColumn("documented", F.coalesce(F.trim("scope") != "", F.lit(False)))
    if strict and (bare := [r.dataset for r in found.where("NOT documented").select("dataset").collect()]):
        raise ValueError(f"datasets without a scope sentence: {bare}")
    return found


def program_bundle(programs: DataFrame, lines: DataFrame, details: DataFrame, ledger: DataFrame, awards: DataFrame, top: int = 5, **others: DataFrame) -> DataFrame:
    """One JSON document a program: its lines, its largest projects whose fact is in the ledger, and its awards.

    ``others`` are further tables with ``pe_bli``, such as narratives, mentions and events, each a list of its other
    columns under its own name. Lists are bounded by what one program has; projects by ``top``.
    """
    projects = details.join(ledger.select("fact_id").distinct(), "fact_id", "left_semi").withColumn("size", F.abs("amount_millions"))
    projects = pick_first(projects, ["pe_bli"], [F.desc("size"), F.asc("project_number"), F.asc("fact_id")], top)
    nested = lambda df, name, *columns: df.groupBy("pe_bli").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    joined = programs.select("pe_bli", "title")
    for part in (
        nested(lines, "lines", "fiscal_year", "amount_type", "amount_thousands"), nested(projects, "projects", "project_number", "amount_millions", "fact_id"), nested(awards, "awards", "award_piid", "confidence"),
        *[nested(df, name, *[c for c in df.columns if c != "pe_bli"]) for name, df in others.items()],
    ):
        joined = joined.join(part, "pe_bli", "left")
    return joined.select("pe_bli", F.to_json(F.struct("pe_bli", "title", "lines", "projects", "awards", *others)).alias("document"))
