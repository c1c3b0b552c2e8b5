"""Fact ledger and reconciliation: derived facts, candidate checks, supersession, gates."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.picks import pick_first


def single_source(column: str) -> Column:
    """The id of the only contributing row; null where several contributed. For use in an aggregate."""
    return F.when(F.count("*") == 1, F.min(column))


def verify_derived(derived: DataFrame, facts: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Recompute derived facts (fact_id, operation sum or difference, inputs array, value) from ``facts`` (fact_id, value).

    A difference subtracts every input after the first. Unresolved inputs and sums of nothing fail.
    """
    parts = derived.select("fact_id", "operation", F.col("value").cast("decimal(38,6)").alias("recorded"), F.size("inputs").alias("n_inputs"), F.posexplode_outer("inputs").alias("pos", "input_id"))
    joined = parts.join(facts.select(F.col("fact_id").alias("input_id"), F.col("value").cast("decimal(38,6)").alias("input_value")), "input_id", "left")
    sign = F.when((F.col("operation") == "difference") & (F.col("pos") > 0), -1).otherwise(1)
    sums = joined.groupBy("fact_id", "operation", "recorded", "n_inputs").agg(F.sum(sign * F.col("input_value")).alias("recomputed"), F.count("input_value").alias("resolved"))
    verdict = (
        F.when(F.greatest("n_inputs", F.lit(0)) == 0, "no_inputs").when(F.col("resolved") < F.col("n_inputs"), "unresolved_input")
        .when(F.abs(F.col("recomputed") - F.col("recorded")) > F.lit(tolerance), "mismatch").otherwise("ok")
    )
    return sums.withColumn("verdict", verdict)


def reconcile_candidates(details: DataFrame, controls: DataFrame, keys: list[str], amount: str, tolerance: Column) -> DataFrame:
    """Detail sums against candidate control sums (keys, candidate, priority, control): matched if any candidate fits.

    The chosen candidate is the matching one of least priority. A key without controls matches only an explicit 0.
    """
    joined = details.join(controls, keys, "left")
    fits = F.coalesce(F.abs(F.col(amount) - F.col("control")) <= tolerance, F.col("candidate").isNull() & (F.col(amount) == 0))
    return joined.groupBy(*keys, amount).agg(
        F.bool_or(fits).alias("matched"), F.min_by("candidate", F.when(fits, F.col("priority"))).alias("candidate"), F.count("candidate").alias("candidates")
    )


def gate_b(details: DataFrame, documents: DataFrame, lines: DataFrame, candidates: DataFrame, *, tolerance: float = 0.001) -> DataFrame:
    """Program amounts of the details against the books' own lines, one row a (document, program, scenario, account).

    details: document_id, pe_bli, scenario, project_number, account, amount_millions, superseded; documents: document_id,
    exhibit, org, fiscal_year, consolidated; lines: exhibit, fiscal_year, organization, account, pe_bli, amount_type,
    amount_thousands; candidates: edition, scenario, priority, amount_type.

    A program without an amount of its own for a scenario is checked by the sum of its projects. Any candidate type
    may match, in a consolidated volume of any one organisation; for the requests of the edition's own year, whole and
    base, the total less the reconciliation counts too, after the others. No line at all matches an explicit 0 only. A
    scenario without candidates gets no verdict.
    """
    live = details.where(~F.coalesce("superseded", F.lit(False)))
    key = ["document_id", "pe_bli", "scenario"]
    own = live.where(F.col("project_number").isNull()).select(*key, "account", F.col("amount_millions").cast("decimal(38,6)").alias("amount"), F.lit("program").alias("basis"))
    projects = live.where(F.col("project_number").isNotNull()).groupBy(*key).agg(F.min("account").alias("account"), F.sum(F.col("amount_millions").cast("decimal(38,6)")).alias("amount"))
    asked = own.unionByName(projects.join(own.select(*key), key, "left_anti").withColumn("basis", F.lit("projects"))).join(documents, "document_id")
    known = candidates.select(F.col("edition").alias("fiscal_year"), "scenario").distinct()
    asked = asked.join(known, ["fiscal_year", "scenario"], "left_semi")

    years = candidates.select("edition").distinct()
    total, less = F.concat(F.lit("fy_"), F.col("edition"), F.lit("_total")), F.concat(F.lit("fy_"), F.col("edition"), F.lit("_reconciliation_request"))
    types = candidates.select("edition", "scenario", "priority", "amount_type", F.lit(1).alias("sign"))
    for request, (amount_type, sign) in product(("BudgetYearOne", "BudgetYearOneBase"), ((total, 1), (less, -1))):
        types = types.unionByName(years.select("edition", F.lit(request).alias("scenario"), F.lit(1 << 20).alias("priority"), amount_type.alias("amount_type"), F.lit(sign).alias("sign")))
    sums = lines.groupBy("exhibit", F.col("fiscal_year").alias("edition"), "organization", F.col("account").alias("line_account"), "pe_bli", "amount_type").agg(F.sum(F.col("amount_thousands").cast("decimal(38,6)")).alias("thousands"))
    typed = sums.join(types, ["edition", "amount_type"]).withColumnsRenamed({"exhibit": "line_exhibit", "pe_bli": "line_pe", "scenario": "line_scenario"})
    of_line = (
        (F.col("fiscal_year") == F.col("edition")) & (F.col("exhibit") == F.col("line_exhibit")) & (F.col("pe_bli") == F.col("line_pe")) & (F.col("scenario") == F.col("line_scenario"))
        & (F.col("account").isNull() | (F.col("account") == F.col("line_account"))) & (F.col("consolidated") | (F.col("organization") == F.col("org")))
    )
    grain = [*key, "account", "amount", "basis"]
    parts = asked.join(typed, of_line, "left").groupBy(*grain, "organization", "priority").agg(
        F.sum(F.col("sign") * F.col("thousands") / 1000).alias("control"), F.countDistinct("sign").alias("signs"), F.max("amount_type").alias("candidate")
    )
    minus = F.col("priority") == 1 << 20  # counts only where both the total and the reconciliation are there
    controls = parts.withColumn("control", F.when(F.coalesce(~minus, F.lit(True)) | (F.col("signs") == 2), F.col("control")))
    controls = controls.withColumn("candidate", F.when(minus, F.lit("total_minus_reconciliation")).otherwise(F.col("candidate")))
    fits = F.col("control").isNotNull() & (F.abs(F.col("control") - F.col("amount")) <= tolerance)
    place = F.struct("priority", "organization")
    judged = controls.groupBy(*grain).agg(
        F.bool_or(fits).alias("fits"), F.count("control").alias("controls"), F.min_by("candidate", F.when(fits, place)).alias("fitting"), F.min_by("candidate", F.when(F.col("control").isNotNull(), place)).alias("nearest")
    )
    passed = F.col("fits") | ((F.col("controls") == 0) & (F.col("amount") == 0))
    return judged.select(*grain, F.coalesce("fitting", "nearest").alias("candidate"), "controls", passed.alias("passed"))


def children_match(parents: DataFrame, children: DataFrame, keys: list[str], amount: str, tolerance: float = 0.001) -> DataFrame:
    """Whether the children's sum equals the parent's amount, per key; parents without children don't appear."""
    sums = children.groupBy(*keys).agg(F.sum(amount).alias("child_sum"))
    return parents.select(*keys, amount).join(sums, keys).withColumn("matches", F.abs(F.col(amount) - F.col("child_sum")) <= tolerance)


def supersede(standing: DataFrame, batch: DataFrame, document: str) -> DataFrame:
    """Standing rows of the batch's documents are flagged, not deleted, and the batch is appended."""
    touched = batch.select(document).distinct().withColumn("in_batch", F.lit(True))
    old = standing.join(touched, document, "left").withColumn("superseded", F.col("superseded") | F.coalesce("in_batch", F.lit(False))).drop("in_batch")
    return old.unionByName(batch.withColumn("superseded", F.lit(False)))


def collapse_duplicates(documents: DataFrame, content: list[str], title: str, key: str) -> DataFrame:
    """Documents of equal content keep the lowest title and are superseded otherwise."""
    first = pick_first(documents, content, [F.asc(title), F.asc(key)]).select(F.col(key).alias("kept_id"), *[F.col(c).alias(f"kept_{c}") for c in content])
    on = [F.col(c).eqNullSafe(F.col(f"kept_{c}")) for c in content]
    joined = documents.join(first, on)
    return joined.withColumn("superseded", F.col(key) != F.col("kept_id")).drop(*[f"kept_{c}" for c in content])


def guarded_delete(table: DataFrame, scope: Column, allowed: DataFrame, key: str) -> DataFrame:
    """The table without the rows in scope; raises if the scope holds a key that the allow-list doesn't."""
    strange = table.where(scope).join(allowed.select(key), key, "left_anti").select(key).limit(5).collect()
    if strange:
        raise ValueError(f"delete would touch keys that are not allowed: {[r[0] for r in strange]}")
    return table.where(~F.coalesce(scope, F.lit(False)))


def guard_overwrite(standing_rows: int, new_rows: int, failed: int, tried: int, *, most_failed: float = 0.2, least_kept: float = 0.8) -> None:
    """Raise when too many inputs failed or too few rows are left to replace the standing table."""
    if tried and failed / tried > most_failed:
        raise ValueError(f"{failed} of {tried} inputs failed")
    if new_rows < least_kept * standing_rows:
        raise ValueError(f"{new_rows} rows would replace {standing_rows}")


def breakdowns(derived: DataFrame, facts: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """The signed inputs of each derived fact that sum exactly to it; facts that don't decompose have no rows."""
    sign = F.when((F.col("operation") == "difference") & (F.col("pos") > 0), -1).otherwise(1)
    parts = derived.select("fact_id", "operation", F.col("value").alias("recorded"), F.size("inputs").alias("n_inputs"), F.posexplode("inputs").alias("pos", "input_id"))
    rows = parts.join(facts.select(F.col("fact_id").alias("input_id"), F.col("value").alias("input_value")), "input_id").withColumn("amount", (sign * F.col("input_value")).cast("decimal(38,6)"))
    whole = rows.groupBy("fact_id", "recorded", "n_inputs").agg(F.sum("amount").alias("total"), F.count("*").alias("n")).where((F.col("n") == F.col("n_inputs")) & (F.abs(F.col("total") - F.col("recorded")) <= tolerance)).select("fact_id")
    return rows.join(whole, "fact_id", "left_semi").select("fact_id", "pos", "input_id", "amount")
