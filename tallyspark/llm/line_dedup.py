"""Dropping repeated lines, in DataFrame functions only; the decisions travel as bitmaps, never as text.

Each eligible line becomes a 128-bit key hash with its document and position. The hashes are range-partitioned
and sorted by hash, document and position, and a window streams over that order: the first row of a key is its
owner, and rows of later documents are dropped. Drops are folded into a bitmap per document, of which only the
63-bit words that have a bit set are kept, and the bitmap alone is joined back to the text.

A key with more rows than a shuffle partition's share would fill a range partition. There are no more such keys than
shuffle partitions (``heavy``), so they are found by an exact count (combined before the shuffle, which also gives each
its smallest document), broadcast, and decided without moving their rows. The share follows the session's number of
shuffle partitions, which should follow the data.

Defined cases: null text is one empty line; rows with a null id come last, and hold a line only where no row
with an id does; rows of one id are one document, told apart by their text; empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.columns import unused
from tallyspark.functions.lineage import partitions_of, written

MIN_KEY = 10
WORD_BITS = 63
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """White space stripped at both ends and A-Z lower-cased; plain lower() where the line is all ASCII."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_bitmaps(docs: DataFrame, *, min_key: int = MIN_KEY, heavy: int | None = None) -> DataFrame:
    """Per document with a dropped line: doc_id, text_hash and ``dropped``, the bitmap's words (index, bits) in order."""
    placed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keyed = placed.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_key)
    rows = keyed.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("2"), "key").alias("h2"))
    rows = written(rows, "line-hashes")
    limit = max(1, rows.count() // (heavy or partitions_of(docs.sparkSession)))
    frequent = (
        rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"))
        .where(F.col("n") > limit)  # so at most `heavy` rows
        .select("h1", "h2", "owner")
    )
    hot = rows.join(F.broadcast(frequent), ["h1", "h2"])
    order = Window.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "pos")
    cold = (
        rows.join(F.broadcast(frequent), ["h1", "h2"], "left_anti")
        .repartitionByRange("h1", "h2")
        .withColumn("owner", F.first("doc_id").over(order))
    )
    later = F.col("owner").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("owner")))
    dropped = hot.select(cold.columns).unionByName(cold).where(later)
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos") % WORD_BITS))
    words = dropped.groupBy("doc_id", "text_hash", F.floor(F.col("pos") / WORD_BITS).cast("int").alias("index")).agg(bits.alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("index", "bits"))).alias("dropped"))


def _dense(bitmap: Column) -> Column:
    """All words up to the last one set, in one pass over the sparse ones."""
    gap = lambda word, k: F.array_repeat(F.lit(0).cast("bigint"), (word["index"] - F.coalesce(F.get(bitmap, k - 1)["index"], F.lit(-1)) - 1).cast("int"))
    return F.flatten(F.transform(bitmap, lambda word, k: F.concat(gap(word, k), F.array(word["bits"]))))


def kept_text(text: Column, dense: Column) -> Column:
    """The lines whose bit isn't set, joined again."""
    bit = lambda k: F.getbit(F.coalesce(F.get(dense, F.floor(k / WORD_BITS).cast("int")), F.lit(0).cast("bigint")), k % WORD_BITS)
    return F.array_join(F.filter(_lines(text), lambda line, k: bit(k) == 0), "\n")


def with_bitmaps(docs: DataFrame, name: str = "dropped", **options) -> DataFrame:
    """``docs`` with one more column: words (index, bits) of the line bitmap, null where nothing is dropped."""
    of_id, of_hash = unused(docs, "of_id"), unused(docs, "of_hash")
    bitmaps = drop_bitmaps(docs, **options).select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash), F.col("dropped").alias(name))
    on = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.xxhash64("text") == F.col(of_hash))
    return docs.join(bitmaps, on, "left").drop(of_id, of_hash)


def op10_query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and the bitmap of dropped lines as ``index:bits`` of its words that aren't 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_bitmaps(docs).withColumn("dense", _dense(F.col("dropped")))
    n_dropped = F.aggregate("dropped", F.lit(0).cast("bigint"), lambda n, word: n + F.bit_count(word["bits"]))
    kept = F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept_text(F.col("text"), F.col("dense")))
    bitmap = F.array_join(F.transform("dropped", lambda word: F.concat_ws(":", word["index"], word["bits"])), ",")
    return found.select(
        "doc_id",
        F.size(_lines(F.col("text"))).cast("bigint").alias("n_lines"),
        F.coalesce(n_dropped, F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"),
        F.coalesce(bitmap, F.lit("")).alias("dropped_bits"),
    )


OP10_SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line
), owner AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), found AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id > owner) AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (owner IS NULL OR doc_id = owner), '')) AS kept_sha256
  FROM keyed LEFT JOIN owner USING (key) GROUP BY doc_id
), word AS (
  SELECT doc_id, (pos - 1) // 63 AS index, bit_or(1::BIGINT << ((pos - 1) % 63)::INT) AS bits
  FROM keyed JOIN owner USING (key) WHERE doc_id > owner GROUP BY ALL
), bitmap AS (
  SELECT doc_id, string_agg(index || ':' || bits, ',' ORDER BY index) AS dropped_bits FROM word GROUP BY doc_id
)
SELECT doc_id, n_lines, n_dropped, kept_sha256, coalesce(dropped_bits, '') AS dropped_bits FROM found LEFT JOIN bitmap USING (doc_id)
"""
