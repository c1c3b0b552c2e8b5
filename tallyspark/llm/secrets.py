"""Secret scanning with a random forest that removes false positives, in DataFrame and Spark ML functions only.

Candidates are all runs of at least ``MIN_RUN`` letters, digits and ``+ / _ -`` in the white-space separated words of
whole texts, several in a word too, and what is assigned to a name such as ``password``, however short. A key block
over several lines is a candidate a line. Each gets: its length and character mix, the mean log-odds of its character
transitions, how much of it dictionary words cover, its path, and what the neighbouring words say. A random forest
trained from labelled findings turns that into a probability; findings under the threshold are false positives.

The transition table has one entry per pair of five character classes and the dictionary at most ``DICTIONARY``
words in one prefix-tree pattern, so both are of bounded size whatever the corpus, and both take time in proportion
to a token's length. The forest reads at most ``MAX_FINDINGS`` labelled findings, taken by a hash of what they are.

Labels: ``scan`` takes any table of labelled findings and by default reads every feature. The query has no labelled
findings given, so it learns from two views: labels come from what stands *before* a token alone (assigned to a name
such as ``token``: a secret; after a plain word without such a name: not; else none), and the forest that decides reads
the token itself, its path and the word *after* it, none of which the labels look at. ``shape_score`` reads the token
and path only.

Defined cases: null and empty texts hold no candidate; a token found twice in one text is two findings; a null
path counts as an empty path; without labels of both kinds every finding scores 1, so nothing is dismissed
without evidence; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import unused
from tallyspark.functions.lineage import cut_lineage, written

MIN_RUN = 16
DICTIONARY = 4000
CLASSES = "0faA-"
MAX_FINDINGS = 20_000
THRESHOLD = 0.5
SPACE = r"[\x20\x09-\x0D]+"
NAMED = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
# a run with its padding, if that doesn't assign the next run; and such a name with a sign of assignment right before a run
RUN = r"[A-Za-z0-9+/_-]+(?:={1,2}(?=[\"'`]?(?:[,;&)\]}]|[^A-Za-z0-9+/_-]*$)))?"
ASSIGNED_NAME = NAMED + r"[A-Za-z0-9_.-]*(\s+key)?[\"'`\])]*\s*[:=][^A-Za-z0-9]*$"


def candidates(docs: DataFrame, *, path: str = "source", min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, path, word_index, offset (in the word), token, the two words before and one after, for every candidate.

    What the neighbours say is tested on whole words and on the runs before a candidate in its own word; only the
    copies of the neighbours that are kept are cut, to the 64 characters next to the word.
    """
    words = F.split(F.coalesce("text", F.lit("")), SPACE)
    is_long = lambda run: run.rlike(rf"[A-Za-z0-9+/_-]{{{min_run}}}")
    get = lambda k: F.coalesce(F.get("words", k), F.lit(""))
    sign = lambda w: F.contains(w, F.lit("=")) | F.contains(w, F.lit(":"))
    may_hold = lambda p: is_long(p["w"]) | ((sign(p["w"]) | sign(get(p["k"] - 1)) | sign(get(p["k"] - 2))) & F.concat_ws(" ", get(p["k"] - 2), get(p["k"] - 1), p["w"]).rlike(NAMED))
    held = F.filter(F.transform(F.col("words"), lambda w, k: F.struct(k.alias("k"), w.alias("w"))), may_hold)
    found = docs.select("doc_id", F.coalesce(F.col(path), F.lit("")).alias("path"), words.alias("words")).select("doc_id", "path", "words", F.explode(held).alias("c"))
    at = lambda step: get(F.col("c.k") + step)
    # what stands between runs and the runs by turns: every second piece is a run
    pieces = F.split(F.regexp_replace(F.translate("c.w", "\x01", "\x02"), RUN, "\x01$0\x01"), "\x01", -1)
    found = found.select("doc_id", "path", F.col("c.k").cast("bigint").alias("word_index"), F.col("c.w").alias("word"), at(-2).alias("before2"), at(-1).alias("before1"), at(1).alias("after1"), pieces.alias("pieces"))

    def run_at(i: Column) -> Column:
        near = F.concat_ws("", F.slice("pieces", F.greatest(i - 6, F.lit(1)), F.least(i - 1, F.lit(6))))
        lead = F.when(i <= 6, F.concat_ws(" ", "before2", "before1", near)).otherwise(near)
        return F.struct(i.alias("i"), F.element_at("pieces", i).alias("run"), lead.alias("lead"))

    runs = F.when(F.size("pieces") >= 3, F.transform(F.sequence(F.lit(2), F.greatest(F.size("pieces"), F.lit(2)), F.lit(2)), run_at)).otherwise(F.array())
    kept = F.filter(runs, lambda r: is_long(r["run"]) | r["lead"].rlike(ASSIGNED_NAME))
    found = found.withColumn("r", F.explode(kept))
    # a short value goes on to the next delimiter, as passwords hold other characters too
    value = F.regexp_extract(F.concat_ws("", F.slice("pieces", F.col("r.i"), F.size("pieces"))), r"^[^\"'`,;&<>(){}\[\]]+", 0)
    return found.select(
        "doc_id", "path", "word_index", F.aggregate(F.slice("pieces", 1, F.col("r.i") - 1), F.lit(0), lambda n, p: n + F.char_length(p)).alias("offset"),
        F.when(is_long(F.col("r.run")), F.col("r.run")).otherwise(value).alias("token"), "word",
        F.right("before2", F.lit(64)).alias("before2"), F.right("before1", F.lit(64)).alias("before1"), F.substring("after1", 1, 64).alias("after1"),
        F.col("r.lead").rlike(r"[:=][^A-Za-z0-9]*$").alias("is_assigned"), F.col("r.lead").rlike(NAMED).alias("is_named"),
        F.col("r.lead").rlike(ASSIGNED_NAME).alias("has_secret_name"), F.col("after1").rlike("^[a-z]+[.,;]?$").alias("is_before_prose"),
    )


def dictionary(docs: DataFrame, *, most: int = DICTIONARY) -> list[str]:
    """The ``most`` commonest plain words of 4 to 8 letters over all texts, for a pattern of bounded size."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?<![a-z])[a-z]{4,8}(?![a-z])"), 0)).alias("w"))
    return [r.w for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most).collect()]


def _prefix_tree(known: list[str]) -> str:
    """One pattern for all words, longest first, which tries a letter once however many words share it."""
    tree: dict = {}
    for word in known:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [letter + pattern(below) for letter, below in sorted(node.items()) if letter]
        if not ways:
            return ""
        inner = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})"
        return f"{inner}?" if "" in node else inner

    return pattern(tree)


_UPPER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_LOW = "ghijklmnopqrstuvwxyz"


def _classes(token: Column) -> Column:
    """The token with each character replaced by its class: a lower, A upper, 0 digit, f hex letter, - other."""
    kind = F.translate(token, _DIGITS + "abcdef" + _LOW + _UPPER, "0" * 10 + "f" * 6 + "a" * 20 + "A" * 26)
    return F.regexp_replace(kind, r"[^0faA]", "-")


def _pair_counts(kind: Column) -> dict[str, Column]:
    """How often each pair of neighbouring classes occurs, overlapping ones too, by pair."""
    return {x + y: F.regexp_count(kind, F.lit(f"{x}(?={y})")) for x in CLASSES for y in CLASSES}


def transition_odds(labelled: DataFrame) -> dict[str, float]:
    """Log-odds of each of the 25 pairs of character classes between secrets and others."""
    counts = _pair_counts(F.col("kind"))
    sums = labelled.select("label", _classes(F.col("token")).alias("kind")).groupBy("label").agg(*[F.sum(c).alias(f"pair_{k}") for k, c in enumerate(counts.values())])
    found = {r["label"]: [r[f"pair_{k}"] + 1 for k in range(len(counts))] for r in sums.collect()}
    if len(found) < 2:
        return {}
    totals = {label: sum(numbers) for label, numbers in found.items()}
    return {pair: math.log(found[1.0][k] / totals[1.0]) - math.log(found[0.0][k] / totals[0.0]) for k, pair in enumerate(counts)}


def features(found: DataFrame, odds: dict[str, float], known_words: list[str]) -> DataFrame:
    """``found`` with one number a column, SHAPE first and PLACE after."""
    token = F.col("token")
    size = F.greatest(F.char_length(token), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count(token, F.lit(pattern)).cast("double")
    kind = unused(found, "kind")
    odds_sum = F.lit(0.0)
    for pair, number in _pair_counts(F.col(kind)).items():
        odds_sum = odds_sum + number * F.lit(odds.get(pair, 0.0))
    bare = F.regexp_replace(F.lower(token), _prefix_tree(known_words), "") if known_words else F.lower(token)
    return found.withColumn(kind, _classes(token)).withColumns({
        "length": size,
        "digit_share": count("[0-9]") / size,
        "upper_share": count("[A-Z]") / size,
        "switches": count(r"(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z]") / size,
        "distinct": F.size(F.array_distinct(F.split(token, ""))) / size,
        "vowels": count("(?i)[aeiou]") / size,
        "transitions": odds_sum / size,
        "covered": (size - F.char_length(bare)) / size,
        "path_depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "path_example": F.col("path").rlike("(?i)test|example|sample|mock|doc").cast("double"),
        "path_config": F.col("path").rlike(r"(?i)\.(env|ini|cfg|conf|ya?ml|json|toml|properties)$").cast("double"),
        "assigned": F.col("is_assigned").cast("double"),
        "named": F.col("is_named").cast("double"),
        "prose_after": F.col("is_before_prose").cast("double"),
        "after_length": F.char_length("after1").cast("double"),
        "after_letters": F.regexp_count("after1", F.lit("[A-Za-z]")).cast("double"),
    }).drop(kind)


SHAPE = ["length", "digit_share", "upper_share", "switches", "distinct", "vowels", "transitions", "covered", "path_depth", "path_example", "path_config"]
AFTER = ["prose_after", "after_length", "after_letters"]
PLACE = ["assigned", "named", *AFTER]


def place_labels(found: DataFrame) -> DataFrame:
    """Labelled findings by what stands before a token alone: label 1.0 or 0.0, others left out."""
    prose = F.col("before1").rlike(r"^[a-z]+[.,;]?$") & ~F.col("is_named") & ~F.col("is_assigned")
    return found.withColumn("label", F.when(F.col("has_secret_name"), 1.0).when(prose, 0.0)).where(F.col("label").isNotNull())


def scan(found: DataFrame, labelled: DataFrame, known_words: list[str], *, neighbours: list[str] = PLACE, most: int = MAX_FINDINGS, trees: int = 30, depth: int = 6) -> DataFrame:
    """Score candidates with forests trained from ``labelled`` (candidates with a 0.0/1.0 ``label``).

    ``neighbours`` names the features of neighbouring words that the deciding forest reads; labels that were made from
    some of them must leave these out.
    Both kinds get half of ``most`` findings at most, so a rare kind is never crowded out.
    """
    order = [F.xxhash64("doc_id", "word_index", "token"), F.col("doc_id"), F.col("word_index"), F.col("offset")]
    halves = [labelled.where(F.col("label") == kind).orderBy(*order).limit(most // 2) for kind in (0.0, 1.0)]
    sample = cut_lineage(halves[0].unionByName(halves[1])).coalesce(4)
    if sample.select("label").distinct().count() < 2:
        return found.withColumn("shape_score", F.lit(1.0)).withColumn("score", F.lit(1.0))
    odds = transition_odds(sample)
    train = cut_lineage(features(sample, odds, known_words).repartition(4, "doc_id", "word_index").sortWithinPartitions("doc_id", "word_index", "offset")).coalesce(4)
    scored = features(found, odds, known_words)
    for columns, vector, name in ((SHAPE, "shape_vector", "shape_score"), (SHAPE + neighbours, "all_vector", "score")):
        assemble = VectorAssembler(inputCols=columns, outputCol=vector)
        forest = RandomForestClassifier(featuresCol=vector, labelCol="label", numTrees=trees, maxDepth=depth, seed=7, probabilityCol="forest_p", rawPredictionCol="forest_raw", predictionCol="forest_y")
        model = forest.fit(assemble.transform(train))
        scored = model.transform(assemble.transform(scored)).withColumn(name, vector_to_array("forest_p")[1]).drop("forest_p", "forest_raw", "forest_y", vector)
    return scored.drop(*SHAPE, *PLACE)


def op2_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    found = written(candidates(docs), "secret-candidates")
    labelled = place_labels(found).where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    scored = scan(found, labelled, dictionary(docs), neighbours=AFTER)
    return scored.select(
        "doc_id", "word_index", F.length("token").alias("n_chars"), F.sha2("token", 256).alias("token_sha256"),
        F.round("shape_score", 6).alias("shape_score"), F.round("score", 6).alias("score"), (F.col("score") >= THRESHOLD).alias("is_secret"),
    )
