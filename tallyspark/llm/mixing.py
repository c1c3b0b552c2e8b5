"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

1. Targets: per source, a share of ``epochs`` times all sizes by weight; a target stops at ``most`` times its
   source's size and the excess goes to the others by weight (water filling over the per-source totals).
2. Certain copies: a document wanted ``c`` times gets ``floor(c)`` whole copies.
3. The rest ``r = c - floor(c)`` is the share of the source that one more copy of some documents has to bring. Documents
   are not equally likely to give it: the inclusion odds of a document are ``r / (1 - r)`` times its own ``odds``, by
   default ``length_odds``, which favours texts of some length over scraps. Each document draws a uniform ``u`` from a
   hash of its id, and documents are ranked by the Pareto variable ``(u / (1 - u)) / (p / (1 - p))``. The sample is
   fixed in size, measured in ``size`` units: the ranking is cut where it comes nearest below what is left of
   the target (which settles the common factor of the odds), and ``FILL_ROUNDS`` rounds then add the largest unused
   document that still fits.
4. While a source has unused documents that fit its gap, these alone are ranked and cut again, so a document that
   is too long for the gap keeps none behind it out. Each round takes one document at least.

No source is sorted as a whole. Sizes are summed by (source, bin of the Pareto variable), with as many bins as keep a
bin of the largest source at about ``ROWS_A_BIN`` rows (``BINS`` at least); a window over those sums finds the bin that
holds the cut, and only that bin's documents are ranked, so a source with a third of all rows costs no more than any
other. The number of bins doesn't change what is taken. Every draw comes from a hash, so reruns agree.

Defined cases: null text has size 0; a null source is a source of its own, the last; documents of equal id,
size and text share a draw and are taken together or by a fixed order; empty input gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.columns import unused
from tallyspark.functions.lineage import cut_lineage, written

WEIGHTS = (3, 1, 2)
BINS = 4096
ROWS_A_BIN = 100_000
FILL_ROUNDS = 3
FEW_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Runs of anything but the six ASCII white-space characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sized: DataFrame, *, weights=WEIGHTS, epochs: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: source_size and target. The windows run over one row per source, not over documents."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weighed = totals.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    )
    everything = Window.partitionBy()
    fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    return (
        weighed.withColumn("aim", F.sum("source_size").over(everything) * F.lit(epochs))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("capped_size", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("capped_weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("aim") - F.lit(most) * F.col("capped_size")) / (F.col("all_weight") - F.col("capped_weight")))
        .withColumn("is_free", F.col("level") * F.col("weight") <= F.lit(most) * F.col("source_size"))
        .withColumn("level", F.min(F.when(F.col("is_free"), F.struct(F.col("capped_weight"), F.col("level")))).over(everything)["level"])
        .select(
            "source",
            "source_size",
            F.least(F.coalesce(F.col("level") * F.col("weight"), F.lit(most) * F.col("source_size")), F.lit(most) * F.col("source_size")).alias("target"),
        )
    )


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 of the keys: the same in every run and every engine."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(2**52))


def length_odds(size: Column) -> Column:
    """Inclusion odds by length: a text of 200 words or more four times those of one under 50, the rest twice."""
    return F.when(size >= 200, 4.0).when(size >= 50, 2.0).otherwise(1.0)


def pareto_mix(sized: DataFrame, *, seed: int = 0, weights=WEIGHTS, epochs: float = 1.5, most: float = 2.0, odds=length_odds) -> DataFrame:
    """``sized``: doc_id, source, size and mark (tells rows of one id apart). Adds source_size, target, copies.

    ``odds`` gives a document's own inclusion odds, above 0, from its size.
    """
    per_source = targets(sized, weights=weights, epochs=epochs, most=most)
    bins_each = max(BINS, (sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0) // ROWS_A_BIN)
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = (
        per_source.withColumn("wanted", wanted)
        .withColumn("whole", F.floor("wanted"))
        .withColumn("rest", F.col("wanted") - F.col("whole"))
        .withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumnRenamed("source", "of_source")
    )
    sources = cut_lineage(sources)
    # tables of one row a source go to every task while there are few sources; with more, Spark chooses, so that
    # documents move by their source only where the sources are many
    beside = F.broadcast if sources.count() <= FEW_SOURCES else lambda df: df
    same = F.col("source").eqNullSafe(F.col("of_source"))
    drawn = (
        sized.join(beside(sources), same)
        .withColumn("u", uniform(F.lit(seed), F.col("doc_id"), F.col("mark")))
        .withColumn("rank", F.col("u") / (1 - F.col("u")) / (odds(F.col("size")) * F.greatest(F.col("rest"), F.lit(1e-12)) / (1 - F.col("rest"))))
        .withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * bins_each))
        .drop("of_source", "wanted")
    )
    drawn = written(drawn, "mix-drawn")
    # which bin holds the cut: sums by (source, bin), then a window over at most BINS rows a source
    bins = drawn.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = (
        bins.withColumn("upto", F.sum("bin_size").over(upto))
        .join(sources.select("of_source", "need"), same)
        .where(F.col("upto") > F.col("need"))
        .groupBy("source")
        .agg(F.min(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("before"))).alias("cut"))
        .select(F.col("source").alias("of_source"), F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("cut_before"))
    )
    placed = drawn.join(beside(cuts), same, "left").drop("of_source")
    ranked = Window.partitionBy("source", "bin").orderBy("rank", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_cut = F.col("bin") == F.col("cut_bin")
    inside = placed.where(at_cut).withColumn("upto", F.col("cut_before") + F.sum("size").over(ranked))
    outside = placed.where(F.coalesce(~at_cut, F.lit(True))).withColumn("upto", F.lit(None).cast("bigint"))
    before_cut = F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin"))
    chosen = written(
        outside.unionByName(inside)
        .withColumn("extra", (F.col("rest") > 0) & (before_cut | F.coalesce(F.col("upto") <= F.col("need"), F.lit(False))))
        .withColumn("as_fit", F.struct("size", (-F.col("u")).alias("v"), "doc_id", "mark")),
        "mix-chosen",
    )
    # one row a source from here on: what is still missing, and the largest unused document that fits it
    gaps = cut_lineage(
        chosen.groupBy(F.col("source").alias("of_source"), "need")
        .agg(F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0)).alias("got"))
        .select("of_source", (F.col("need") - F.col("got")).alias("gap"), F.lit(None).cast(chosen.schema["as_fit"].dataType).alias("fit"))
    )
    unused = chosen.where(~F.col("extra") & (F.col("rest") > 0) & (F.col("size") > 0)).select("source", "as_fit")
    rounds = []
    for _ in range(FILL_ROUNDS):
        found = (
            unused.join(beside(gaps), same)
            .where((F.col("as_fit.size") <= F.col("gap")) & (F.col("fit").isNull() | (F.col("as_fit") < F.col("fit"))))
            .groupBy(F.col("of_source"), "gap")
            .agg(F.max("as_fit").alias("fit"))
        )
        gaps = cut_lineage(found.select("of_source", (F.col("gap") - F.col("fit.size")).alias("gap"), "fit"))
        rounds.append(gaps.select("of_source", "fit"))
    fits = reduce(DataFrame.unionByName, rounds).groupBy("of_source").agg(F.collect_list("fit").alias("fits"))
    taken = chosen.join(beside(fits), same, "left").withColumn("extra", F.col("extra") | F.coalesce(F.array_contains("fits", F.col("as_fit")), F.lit(False)))
    taken = _filled(taken.drop("of_source"), beside)
    return taken.select("doc_id", "source", "size", "mark", "source_size", "target", (F.col("whole") + F.col("extra").cast("int")).cast("bigint").alias("copies"))


def _filled(taken: DataFrame, beside) -> DataFrame:
    """``taken`` with more rows marked ``extra``, until no source has an unused document that fits its gap."""
    same = F.col("source").eqNullSafe(F.col("of_source"))
    got = F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0))
    gaps = cut_lineage(taken.groupBy(F.col("source").alias("of_source"), "need").agg(got.alias("got")).select("of_source", (F.col("need") - F.col("got")).alias("gap")))
    left = taken.where(~F.col("extra") & (F.col("rest") > 0) & (F.col("size") > 0)).join(beside(gaps), same).where("size <= gap")
    # equal rows are taken together, so they count as one
    left = written(left.groupBy("source", "bin", "rank", "doc_id", "mark").agg(F.sum("size").alias("size")), "mix-left")
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = Window.partitionBy("source", "bin").orderBy("rank", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rounds = []
    while True:
        left = written(left.join(beside(gaps), same).where("size <= gap").drop("of_source"), "mix-fitting")
        if left.isEmpty():
            break
        bins = left.groupBy("source", "bin", "gap").agg(F.sum("size").alias("bin_size")).withColumn("upto", F.sum("bin_size").over(upto))
        cuts = bins.where("upto > gap").groupBy(F.col("source").alias("of_source")).agg(F.min(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("before"))).alias("cut"))
        placed = left.join(beside(cuts), same, "left").drop("of_source")
        at_cut = F.coalesce(F.col("bin") == F.col("cut.bin"), F.lit(False))
        inside = placed.where(at_cut).withColumn("now", F.col("cut.before") + F.sum("size").over(ranked) <= F.col("gap"))
        outside = placed.where(~at_cut).withColumn("now", F.coalesce(F.col("bin") < F.col("cut.bin"), F.lit(True)))
        placed = written(inside.unionByName(outside).drop("cut"), "mix-round")
        now = F.sum(F.when(F.col("now"), F.col("size")).otherwise(0))
        gaps = cut_lineage(placed.groupBy(F.col("source").alias("of_source"), "gap").agg(now.alias("got")).select("of_source", (F.col("gap") - F.col("got")).alias("gap")))
        rounds.append(placed.where("now").select(F.col("source").alias("of_source"), F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark")))
        left = placed.where("NOT now").drop("now", "gap")
    if not rounds:
        return taken
    more = reduce(DataFrame.unionByName, rounds)
    more = F.broadcast(more) if more.count() <= FEW_SOURCES else more
    on = same & F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("mark") == F.col("of_mark"))
    return taken.join(more, on, "left").withColumn("extra", F.col("extra") | F.col("of_mark").isNotNull())


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: one row for each copy taken."""
    mark, of_id, of_source, of_mark, copies = (unused(docs, stem) for stem in ("mark", "of_id", "of_source", "of_mark", "copies"))
    marked = docs.withColumn(mark, F.md5(F.coalesce(F.col("text"), F.lit(""))))
    sized = marked.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.col(mark).alias("mark"))
    taken = pareto_mix(sized, **options).groupBy(F.col("doc_id").alias(of_id), F.col("source").alias(of_source), F.col("mark").alias(of_mark)).agg(F.max("copies").alias(copies))
    on = F.col("doc_id").eqNullSafe(F.col(of_id)) & F.col("source").eqNullSafe(F.col(of_source)) & (F.col(mark) == F.col(of_mark))
    joined = marked.join(taken.where(F.col(copies) > 0), on)
    return joined.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).select(docs.columns)


def op5_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("mark"))
    return pareto_mix(sized).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP5_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS mark
  FROM documents
), totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM totals
), filling AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS aim, sum(weight) OVER () AS all_weight,
         coalesce(sum(source_size) OVER before, 0)::DOUBLE AS capped_size, coalesce(sum(weight) OVER before, 0.0) AS capped_weight
  FROM weighed
  WINDOW before AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (aim - 2.0::DOUBLE * capped_size) / (all_weight - capped_weight) AS own_level FROM filling
), level AS (SELECT arg_min(own_level, capped_weight) AS level FROM levels WHERE own_level * weight <= 2.0::DOUBLE * source_size),
targets AS (
  SELECT source, source_size, least(coalesce(level * weight, 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size) AS target
  FROM levels LEFT JOIN level ON true
), wanted AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS wanted FROM targets
), split AS (
  SELECT source, source_size, target, floor(wanted) AS whole, wanted - floor(wanted) AS rest, target - floor(wanted) * source_size AS need FROM wanted
), drawn AS (
  SELECT d.*, s.source_size, s.target, s.whole, s.rest, s.need,
         (('0x' || substr(md5(concat_ws(':', '0', coalesce(doc_id::VARCHAR, 'null'), mark)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN split s ON d.source IS NOT DISTINCT FROM s.source
), ranked AS (
  SELECT *, u / (1 - u) / ((CASE WHEN size >= 200 THEN 4 WHEN size >= 50 THEN 2 ELSE 1 END)::DOUBLE * greatest(rest, 1e-12::DOUBLE) / (1 - rest)) AS rank FROM drawn
), running AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY floor(rank / (1 + rank) * 4096), rank, doc_id, mark ROWS UNBOUNDED PRECEDING) AS upto FROM ranked
), binned AS (
  SELECT *, floor(rank / (1 + rank) * 4096) AS bin FROM running
), cut AS (
  SELECT source, min(bin) AS cut_bin FROM binned WHERE upto > need GROUP BY source
), chosen AS (
  SELECT b.*, rest > 0 AND (cut_bin IS NULL OR bin < cut_bin OR (bin = cut_bin AND upto <= need)) AS extra
  FROM binned b LEFT JOIN cut c ON b.source IS NOT DISTINCT FROM c.source
), gap0 AS (
  SELECT source, need - coalesce(sum(size) FILTER (extra), 0) AS gap FROM chosen GROUP BY source, need
), unused AS (
  SELECT source, size, -u AS v, doc_id, mark FROM chosen WHERE NOT extra AND rest > 0 AND size > 0
), fit1 AS (
  SELECT source, gap, size, v, doc_id, mark FROM (SELECT u.*, gap FROM unused u JOIN gap0 g ON u.source IS NOT DISTINCT FROM g.source) WHERE size <= gap
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY size DESC, v DESC, doc_id DESC, mark DESC) = 1
), fit2 AS (
  SELECT u.source, f.gap - f.size AS gap, u.size, u.v, u.doc_id, u.mark FROM unused u JOIN fit1 f ON u.source IS NOT DISTINCT FROM f.source
  WHERE u.size <= f.gap - f.size AND (u.size, u.v, u.doc_id, u.mark) < (f.size, f.v, f.doc_id, f.mark)
  QUALIFY row_number() OVER (PARTITION BY u.source ORDER BY u.size DESC, u.v DESC, u.doc_id DESC, u.mark DESC) = 1
), fit3 AS (
  SELECT u.source, f.gap - f.size AS gap, u.size, u.v, u.doc_id, u.mark FROM unused u JOIN fit2 f ON u.source IS NOT DISTINCT FROM f.source
  WHERE u.size <= f.gap - f.size AND (u.size, u.v, u.doc_id, u.mark) < (f.size, f.v, f.doc_id, f.mark)
  QUALIFY row_number() OVER (PARTITION BY u.source ORDER BY u.size DESC, u.v DESC, u.doc_id DESC, u.mark DESC) = 1
), fits AS (SELECT doc_id, mark FROM fit1 UNION ALL SELECT doc_id, mark FROM fit2 UNION ALL SELECT doc_id, mark FROM fit3
), taken AS (
  SELECT * EXCLUDE (extra), extra OR (doc_id, mark) IN (SELECT (doc_id, mark) FROM fits) AS extra FROM chosen
), gap3 AS (
  SELECT source, need - coalesce(sum(size) FILTER (extra), 0) AS gap FROM taken GROUP BY source, need
), left_over AS (  -- one pass over these in rank order, each taken if it fits what is still missing
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, doc_id, mark) AS pos FROM (
    SELECT t.source, rank, doc_id, mark, sum(size) AS size FROM taken t JOIN gap3 g ON t.source IS NOT DISTINCT FROM g.source
    WHERE NOT extra AND rest > 0 AND size > 0 AND size <= gap GROUP BY ALL)
), filling_up AS (
  SELECT source, gap, 0::BIGINT AS pos FROM gap3
  UNION ALL
  SELECT source, gap - size, pos FROM (
    SELECT f.source, f.gap, l.size, l.pos, row_number() OVER (PARTITION BY f.source ORDER BY l.pos) AS k
    FROM filling_up f JOIN left_over l ON l.source IS NOT DISTINCT FROM f.source AND l.pos > f.pos AND l.size <= f.gap) WHERE k = 1
), more AS (
  SELECT doc_id, mark, l.source FROM filling_up f JOIN left_over l ON l.source IS NOT DISTINCT FROM f.source AND l.pos = f.pos
)
SELECT t.doc_id, size, source_size, target, (size * (whole::BIGINT + (extra OR m.mark IS NOT NULL)::BIGINT))::BIGINT AS taken
FROM taken t LEFT JOIN more m ON m.source IS NOT DISTINCT FROM t.source AND m.doc_id IS NOT DISTINCT FROM t.doc_id AND m.mark = t.mark
"""
