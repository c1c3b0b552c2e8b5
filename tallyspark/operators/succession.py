"""Program succession read from narratives and from money: stated and inferred edges between program codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.lineage import written
from tallyspark.functions.scalars import fact_id
from tallyspark.operators.chains import drop_mirrored
from tallyspark.operators.picks import pick_first

# A program code; a clause, which a point between digits doesn't end; the rules in order of preference;
# the last one holds for codes that stand before the last place where something is handed on.
CODE = r"(\d{7}(?:[A-Z][A-Z0-9]{0,3})?)"
# The quantifiers are possessive, so that a clause of any length is read without a step of recursion a character.
CLAUSE = r"(?:[^.:]|(?<=\d)\.(?=\d))[^.:]*+(?:(?<=\d)\.(?=\d)[^.:]*+)*+(?:[.:]|$)"
_PROGRAM = r"(?:PE|program element)\s+"
HANDED_ON = rf"(?:transferred?|realign\w*)\s+to\s+{_PROGRAM}\d"
RULES = [
    (rf"transferred?\s+from\s+{_PROGRAM}{CODE}", "from", "realigned"),
    (rf"realign\w*\s+from\s+{_PROGRAM}{CODE}", "from", "realigned"),
    (rf"previously\s+(?:funded|budgeted)\s+(?:in|under)\s+{_PROGRAM}{CODE}", "from", "renamed"),
    (rf"formerly\s+{_PROGRAM}{CODE}", "from", "renamed"),
    (rf"transferred?\s+to\s+{_PROGRAM}{CODE}", "to", "realigned"),
    (rf"realign\w*\s+to\s+{_PROGRAM}{CODE}", "to", "realigned"),
    (rf"(?<!to )(?<!from ){_PROGRAM}{CODE}", "before handing on", "realigned"),
]
# Verbs that make a clause worth reading, more of them than the rules know.
VERBS = (
    r"(?i)\b(?:transferr?ed?|transfers?|realign\w*|formerly|previously (?:funded|budgeted)|renamed|migrat\w*|moved|consolidat\w*|merged|split|restructur\w*)\b"
)
NEGATIONS = ["erroneously", "in error", "incorrectly", "realigned back", "transferred back", "will be returned", "rescinded"]


def clauses(narratives: DataFrame, body: str = "body") -> DataFrame:
    """One row a clause with its position and the clause after it, beside the narrative's other columns."""
    others = [c for c in narratives.columns if c != body]
    found = F.array(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(CLAUSE), 0))
    # bound to a variable, a text is cut once; an outer explode brings no filter that would cut it again
    paired = F.flatten(F.transform(found, lambda x: F.transform(x, lambda clause, k: F.struct(clause.alias("clause"), F.get(x, k + 1).alias("following")))))
    return narratives.select(*others, F.posexplode_outer(paired).alias("pos", "x")).where("pos IS NOT NULL").select(*others, "pos", "x.clause", "x.following")


def clause_candidates(narratives: DataFrame) -> DataFrame:
    """Clauses with a verb of change and a program code: a stable id, the codes in order, and the clauses around.

    narratives: pe_bli, fiscal_year, fact_id, body. A clause that a narrative repeats is one candidate, its first.
    """
    read = clauses(narratives).where(F.col("clause").rlike(VERBS))
    codes = F.array_sort(F.array_distinct(F.regexp_extract_all("clause", F.lit(rf"(?<![A-Za-z0-9]){CODE}(?![A-Za-z0-9])"), 1)))
    told = F.trim("clause")
    rows = read.withColumn("codes", codes).where(F.size("codes") > 0).withColumn("clause_id", fact_id(F.col("fact_id"), told))
    first = pick_first(rows, ["clause_id"], [F.asc("pos"), F.asc("pe_bli")])
    return first.select("clause_id", "pe_bli", "fiscal_year", "fact_id", told.alias("clause"), F.trim(F.coalesce("following", F.lit(""))).alias("following"), "codes")


def names_code(text: Column, code: Column) -> Column:
    """Whether the text names the code as a whole token."""
    return F.array_contains(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+"), code)


def has_negation(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(NEGATIONS)), F.lit(False))


def _named_by(clause: Column, rank: int, pattern: str, relation: str) -> Column:
    codes = F.regexp_extract_all(clause, F.lit(f"(?i){pattern}"), 1)
    return F.transform(codes, lambda code: F.struct(F.lit(rank).alias("rank"), code.alias("code"), F.lit(relation).alias("relation")))


def _matches(clause: Column, way: str) -> Column:
    """All codes a clause names in one direction, as (rank of the rule, code, relation).

    Where the clause last hands something on is found once, so its time goes with its length.
    """
    before = F.regexp_extract(clause, rf"(?is)^(.*){HANDED_ON}", 1)
    told = {way: clause} | ({"before handing on": before} if way == "from" else {})
    return F.concat(*[_named_by(told[direction], k, pattern, relation) for k, (pattern, direction, relation) in enumerate(RULES) if direction in told])


def _crossed(froms: Column, tos: Column) -> Column:
    pair = lambda f, t: F.struct(
        f["code"].alias("src"), t["code"].alias("dst"), (f["rank"] * 100 + t["rank"]).alias("rank"), F.when(f["relation"] == "renamed", t["relation"]).otherwise(f["relation"]).alias("relation")
    )
    return F.filter(F.flatten(F.transform(froms, lambda f: F.transform(tos, lambda t: pair(f, t)))), lambda p: p["src"] != p["dst"])


def named_pairs(clause: Column) -> Column:
    """The pairs (src, dst, rank, relation) of a clause that names both ends by itself."""
    # an array of one element gives both lists a name, so the rules read the clause once and not once a pair
    both = F.array(F.struct(_matches(clause, "from").alias("f"), _matches(clause, "to").alias("t")))
    return F.flatten(F.transform(both, lambda x: _crossed(x["f"], x["t"])))


def stated_edges(narratives: DataFrame) -> DataFrame:
    """Edges that narratives (pe_bli, fiscal_year, fact_id, body) state, one a pair, as the latest edition tells it.

    A clause that names both ends is evidence for its own pairs; one that names one end is about the narrating
    program. A renamed from-rule yields to the to-rule's relation. A clause that takes itself back, or whose
    successor takes it back and names an end, states nothing.
    """
    # every rule needs a program's code; the rules read a clause once, as nothing is inlined or pushed below an explode
    telling = clauses(narratives).where(F.col("clause").rlike(rf"(?i){_PROGRAM}{CODE}"))
    both = F.array(F.struct(_matches(F.col("clause"), "from").alias("froms"), _matches(F.col("clause"), "to").alias("tos")))
    read = telling.select("*", F.explode_outer(both).alias("both")).select(*telling.columns, "both.froms", "both.tos")
    read = read.where((F.size("froms") > 0) | (F.size("tos") > 0))
    own = F.col("pe_bli")
    single = F.concat(
        F.transform("froms", lambda f: F.struct(f["code"].alias("src"), own.alias("dst"), f["rank"].alias("rank"), f["relation"].alias("relation"))),
        F.transform("tos", lambda t: F.struct(own.alias("src"), t["code"].alias("dst"), (t["rank"] + 50).alias("rank"), t["relation"].alias("relation"))),
    )
    named = _crossed(F.col("froms"), F.col("tos"))
    pairs = read.withColumn("pairs", F.when(F.size(named) > 0, named).otherwise(F.filter(single, lambda p: p["src"] != p["dst"])))
    # what the next clause names is looked up once a clause, and clauses are found again by their digest: a pair carries no text
    names = F.array_distinct(F.when(has_negation(F.col("following")), F.split("following", "[^A-Za-z0-9]+")).otherwise(F.array().cast("array<string>")))
    kept = pairs.where(~has_negation(F.col("clause"))).withColumn("back", names)
    kept = kept.withColumn("pairs", F.filter("pairs", lambda p: ~F.array_contains("back", p["src"]) & ~F.array_contains("back", p["dst"])))
    read = written(kept.where(F.size("pairs") > 0).select("fiscal_year", "fact_id", "pos", "clause", F.sha2("clause", 256).alias("told"), "pairs"), "stated-clauses")
    rows = read.select("fiscal_year", "fact_id", "pos", "told", F.explode("pairs").alias("p")).select("fiscal_year", "fact_id", "pos", "told", "p.src", "p.dst", "p.rank", "p.relation")
    first = pick_first(rows, ["src", "dst"], [F.desc("fiscal_year"), F.asc_nulls_last("fact_id"), F.asc("pos"), F.asc("rank"), F.asc("told")])
    told = F.trim("clause")
    clause_texts = read.select("told", "clause").dropDuplicates(["told"])
    return first.join(clause_texts, "told").select(
        "src", "dst", "fiscal_year", "relation", F.lit("stated").alias("confidence"), F.col("fact_id").alias("evidence_fact_id"), told.alias("evidence_sentence"),
        fact_id(F.col("src"), F.col("dst"), F.col("fiscal_year"), F.col("relation"), told).alias("edge_fact_id"),
    )


def drop_superseded(edges: DataFrame, narratives: DataFrame) -> DataFrame:
    """Edges that no later edition states the other way round or takes back in a clause naming both ends."""
    standing = drop_mirrored(edges, "src", "dst", "fiscal_year")
    against = clauses(narratives.select("fiscal_year", "body")).where(has_negation(F.col("clause")))
    # codes of each retracting clause, exploded, so that the join is on the pair and not on a scan of texts
    codes = against.select(F.col("fiscal_year").alias("later"), F.array_distinct(F.split("clause", "[^A-Za-z0-9]+")).alias("tokens"))
    codes = codes.withColumn("tokens", F.filter("tokens", lambda t: t.rlike(f"^{CODE}$")))
    named = codes.select("later", F.explode("tokens").alias("src"), "tokens").select("later", "src", F.explode("tokens").alias("dst")).groupBy("src", "dst").agg(F.max("later").alias("later"))
    joined = standing.join(named, ["src", "dst"], "left")
    return joined.where(F.col("later").isNull() | (F.col("later") <= F.col("fiscal_year"))).drop("later")


def inferred_edges(series: DataFrame) -> DataFrame:
    """Maturations: same normalised title and agency suffix, next budget activity, money tapering as the other rises.

    ``series``: pe_bli, title, fy, amount of requests. The first year of such a hand-off dates the edge.
    """
    title = F.trim(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9]+", " "))
    rows = series.select("pe_bli", title.alias("t"), F.regexp_extract("pe_bli", r"^06\d(\d)", 1).try_cast("int").alias("activity"), F.regexp_extract("pe_bli", r"^\d{7}(.*)", 1).alias("suffix"), "fy", "amount")
    rows = rows.where((F.col("t") != "") & F.col("activity").isNotNull())
    key = ["t", "suffix"]
    before = rows.select(*key, F.col("pe_bli").alias("src"), F.col("activity").alias("src_activity"), (F.col("fy") + 1).alias("fy"), F.col("amount").alias("amount_before"))
    same = rows.select(*key, F.col("pe_bli").alias("src"), "fy", F.col("amount").alias("amount_now"))
    tapered = before.join(same, [*key, "src", "fy"], "left").where(F.coalesce("amount_now", F.lit(0.0)) < F.col("amount_before"))
    rising = rows.where("amount > 0").select(*key, F.col("pe_bli").alias("dst"), (F.col("activity") - 1).alias("src_activity"), "fy")
    found = tapered.join(rising, [*key, "src_activity", "fy"])
    return found.groupBy("src", "dst").agg(F.min("fy").alias("fiscal_year")).withColumn("relation", F.lit("matured_ba")).withColumn("confidence", F.lit("inferred"))
