"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

1. Statistics of the whole text, all built-in column functions (shares of character kinds, repeated words and
   lines, lengths).
2. A forest of shallow trees over labelled rows; every path from a root is a rule, a conjunction of bounds.
3. A lasso logistic regression over the rules' truth values keeps few of them.
4. The kept rules and weights become one column: the score is the logistic of their weighted sum.

The fit reads at most ``max_rows`` labelled rows (taken by a hash of the id, so reruns agree); scoring runs over
every row inside generated code, with no Python and no shuffle. Only text statistics enter a score.

Defined cases: null text counts as empty and gets a score like any other; unlabelled ids, labels other than 0
and 1, and null ids train nothing; several labels of one id count as the smallest; with labels of one kind the
score is their smoothed share, and with none it is 1, so nothing is rejected without evidence.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import unused
from tallyspark.functions.lineage import cut_lineage

MAX_ROWS = 20_000
THRESHOLD = 0.7
SEED = 11


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of one text, by name; all are finite for any text."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.char_length(text), F.lit(1)).cast("double")
    words = F.split(text, r"[\x20\x09-\x0D]+")
    n_words = F.size(words).cast("double")
    lines = F.filter(F.split(text, "\n"), lambda line: F.char_length(line) > 0)
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / size
    return {
        "log_size": F.log1p(size),
        "word_length": size / n_words,
        "symbols": share(r"[#$%&*+=<>@^_~\\{}\[\]/]"),
        "symbol_runs": F.regexp_count(text, F.lit(r"[#$%&*=~^_+]{2,}|!{2,}")) / n_words,
        "bars": share(r"\|"),
        "marks": share(r"[!?]"),
        "stops": F.regexp_count(text, F.lit(r"[.,;:]")) / n_words,
        "capitals": share(r"[A-Z]"),
        "digits": share(r"[0-9]"),
        "new_words": F.size(F.array_distinct(words)) / F.sqrt(n_words),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_words": F.log1p(n_words / n_lines),
    }


NAMES = [
    "log_size", "word_length", "symbols", "symbol_runs", "bars", "marks", "stops", "capitals", "digits", "new_words",
    "distinct_words", "distinct_lines", "line_words",
]


def held_out(doc_id: Column) -> Column:
    """The rows whose labels no fit may see: CRC-32 of the id as text leaves 2 by 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def _rules(model) -> list[tuple[tuple[int, float, float], ...]]:
    """Every path from a root of the forest as bounds (statistic, above, up to), each once."""
    found = {}

    def walk(node, bounds: dict) -> None:
        if bounds:
            found[tuple(sorted((k, *v) for k, v in bounds.items()))] = None
        if node.numDescendants() == 0:
            return
        split = node.split()
        at, cut = split.featureIndex(), split.threshold()
        low, high = bounds.get(at, (-math.inf, math.inf))
        walk(node.leftChild(), bounds | {at: (low, min(high, cut))})
        walk(node.rightChild(), bounds | {at: (max(low, cut), high)})

    for tree in model.trees:
        walk(tree._java_obj.rootNode(), {})
    return list(found)


def rule_column(rule: tuple, column=F.col) -> Column:
    """1.0 where all bounds of the rule hold, else 0.0."""
    holds = F.lit(True)
    for at, low, high in rule:
        if low > -math.inf:
            holds &= column(NAMES[at]) > F.lit(low)
        if high < math.inf:
            holds &= column(NAMES[at]) <= F.lit(high)
    return holds.cast("double")


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = MAX_ROWS, trees: int = 24, depth: int = 3, lasso: float = 1e-3) -> dict:
    """The rule ensemble as ``{"bias": float, "rules": [(weight, rule)]}``. ``labels`` must hold no held-out row."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("double").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # at most `max_rows` narrow rows
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", *[c.alias(n) for n, c in statistics(F.col("text")).items()])
    # the same rows in the same places each run; few partitions, as every round of the fits is a job over them
    rows = cut_lineage(rows.repartition(4, "doc_id").sortWithinPartitions("doc_id", *NAMES)).coalesce(4)
    kinds = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n = sum(kinds.values())
    if len(kinds) < 2:
        share = (kinds.get(1.0, 0) + 1) / (n + 2)
        return {"bias": math.log(share / (1 - share)) if n else math.inf, "rules": []}
    assembled = VectorAssembler(inputCols=NAMES, outputCol="stats").transform(rows)
    forest = RandomForestClassifier(featuresCol="stats", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", subsamplingRate=0.8, minInstancesPerNode=3, seed=SEED)
    rules = _rules(forest.fit(assembled))
    truths = rows.select("label", F.array(*[rule_column(r) for r in rules]).alias("truths"))
    from pyspark.ml.functions import array_to_vector

    vectors = truths.select("label", array_to_vector("truths").alias("rules"))
    lasso_fit = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=40, tol=1e-6).fit(vectors)
    weights = lasso_fit.coefficients.toArray().tolist()
    return {"bias": float(lasso_fit.intercept), "rules": [(w, r) for w, r in zip(weights, rules, strict=True) if w]}


def score(docs: DataFrame, ensemble: dict, name: str = "score") -> DataFrame:
    """``docs`` with the score of its column ``text``: between 0 and 1, higher where label 1 is likelier."""
    if math.isinf(ensemble["bias"]):
        return docs.withColumn(name, F.lit(1.0))
    stats = F.struct(*[c.alias(n) for n, c in statistics(F.col("text")).items()])
    held = unused(docs, "stats")
    total = F.lit(ensemble["bias"])
    for weight, rule in ensemble["rules"]:
        total = total + F.lit(weight) * rule_column(rule, lambda n: F.col(held)[n])
    return docs.withColumn(held, stats).withColumn(name, 1 / (1 + F.exp(-total))).drop(held)


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that score at least ``threshold``; the fit leaves held-out labels alone."""
    ensemble = fit(docs, labels.where(~held_out(F.col("doc_id"))), **options)
    name = unused(docs, "score")
    return score(docs, ensemble, name).where(F.col(name) >= threshold).drop(name)


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    scored = score(docs, fit(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
