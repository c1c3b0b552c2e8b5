"""Merkle manifest of a dataset: one digest for the whole table, a subtree a language, and a proof for every row.

A leaf is the SHA-256 of a row's fields, each by its byte count and value, so no two different rows are written alike.
Leaves of a language stand in the order of their ids; every two neighbours become the digest of both, a last lone one the
digest of itself, until one is left. The languages' roots, in the order of the languages, become the manifest's root in
the same way.

Witnesses grow as leaves are appended: ``Appender`` keeps the open subtrees, and each row's siblings so far; when a
subtree gets its sibling, the rows on either side get the other side's root, and both become one open subtree. Blocks of
``2 ** BLOCK_BITS`` leaves, aligned by position, are grown by one task each; a block's root is then appended to the
next tree up in the same way, so rows of any number take one round a ``BLOCK_BITS`` levels, and no group is larger than a
block. Whether a sibling is there, and on which side, follows from a row's position and the number of rows, so a witness
is nothing but digests.

Only ids, digests and witnesses move: each row's text is read once, where it lies. Rows are range-partitioned by language,
id, leaf and place, so a language, an id or a row that is repeated any number of times is split over partitions.

Defined cases: a null field is written ``-``; null is a language of its own, the first; a row with a null id stands after
the others of its language; rows of one id stand by leaf; rows that are alike in all fields have the same leaf. A lone
leaf is its own root. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.lineage import written

BLOCK_BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A field as a leaf takes it: its UTF-8 byte count, a colon and the value; null is a dash."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_of(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def node(*digests: str) -> str:
    """The digest above one or two digests, all in lowercase hexadecimal."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_above(size: int) -> int:
    """How many times ``size`` nodes are halved, rounding up, until one is left."""
    return (size - 1).bit_length()


class Appender:
    """Appends nodes from left to right and grows the witness of each.

    ``open`` holds the subtrees that wait for a sibling, from left to right: (levels, first node, root).
    """

    def __init__(self):
        self.open: list[tuple[int, int, str]] = []
        self.witnesses: list[bytearray] = []

    def append(self, digest: str) -> None:
        self.witnesses.append(bytearray())
        self._settle((0, len(self.witnesses) - 1, digest))

    def _settle(self, right: tuple[int, int, str]) -> None:
        """Join a complete subtree to the open ones of its height before it, then leave it open."""
        while self.open and self.open[-1][0] == right[0]:
            right = self._joined(self.open.pop(), right)
        self.open.append(right)

    def _joined(self, left: tuple[int, int, str], right: tuple[int, int, str]) -> tuple[int, int, str]:
        for witnesses, sibling in ((self.witnesses[left[1] : right[1]], right[2]), (self.witnesses[right[1] :], left[2])):
            raw = bytes.fromhex(sibling)
            for witness in witnesses:
                witness += raw
        return left[0] + 1, left[1], node(left[2], right[2])

    def close(self, levels: int) -> str:
        """The root ``levels`` above the nodes once no more come: the last subtree climbs alone where it has no sibling."""
        height, first, root = self.open.pop()
        while height < levels:
            if self.open and self.open[-1][0] == height:
                height, first, root = self._joined(self.open.pop(), (height, first, root))
            else:
                height, root = height + 1, node(root)
        return root


def fold(leaf: str, path: list[tuple[int, int]], siblings: bytes) -> str:
    """The root that a leaf and its siblings give; ``path`` has (position, number of nodes) for each tree on the way up."""
    at, digest = 0, leaf
    for position, size in path:
        for level in range(levels_above(size)):
            here = position >> level
            if here ^ 1 < -(-size >> level):
                sibling = siblings[at : at + 32].hex()
                at += 32
                digest = node(sibling, digest) if here & 1 else node(digest, sibling)
            else:
                digest = node(digest)
    return digest if at == len(siblings) else ""


GROWN = "key string, pos bigint, size bigint, block bigint, witness binary, root string"


def _grow(nodes: DataFrame, bits: int, extra: list[str]) -> DataFrame:
    """``nodes`` (key, pos, size, digest and ``extra``) with each one's block, its witness there, and the root beside the first."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree, size = Appender(), table.column("size")[0].as_py()
        for digest in table.column("digest").to_pylist():
            tree.append(digest)
        root = tree.close(min(bits, levels_above(size)))
        witnesses = pa.array(map(bytes, tree.witnesses), pa.binary())
        roots = pa.array([root] + [None] * (len(table) - 1), pa.string())
        columns = {name: table.column(name) for name in ("key", "pos", "size", "block", *extra)}
        return pa.table({**columns, "witness": witnesses, "root": roots}).select([*GROWN_NAMES, *extra])

    kinds = "".join(f", {name} {nodes.schema[name].dataType.simpleString()}" for name in extra)
    blocks = nodes.withColumn("block", F.shiftright("pos", bits))
    return blocks.groupBy("key", "block").applyInArrow(run, GROWN + kinds)


GROWN_NAMES = [x.split()[0] for x in GROWN.split(", ")]


def _placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` (key, row) with pos and size in their key, and the largest size.

    ``row`` is ascending in the order of the key's rows, and its bits from 33 on name a range of rows that is written
    together, without gaps for one key.
    """
    part = F.shiftright("row", 33)
    starts = rows.groupBy("key", part.alias("part")).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    by_key = Window.partitionBy("key")  # a row a range and key
    before = F.coalesce(F.sum("n").over(by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(starts.select("key", "part", "first", before.alias("before"), F.sum("n").over(by_key).alias("size")), "manifest-starts")
    most = starts.agg(F.max("size")).first()[0] or 0
    placed = rows.withColumn("part", part).join(starts, ["key", "part"])
    return placed.withColumn("pos", F.col("before") + F.col("row") - F.col("first")).drop("part", "first", "before", "row"), most


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` written in order, each with its place in ``row``; equal rows are dealt by where they come from.

    They are written before they are ordered, as the ranges take a look at all of them first.
    """
    numbered = written(rows.withColumn("came_from", F.monotonically_increasing_id()), "manifest-rows")
    ordered = numbered.repartitionByRange(*order, "came_from").sortWithinPartitions(*order, "came_from").drop("came_from")
    return written(ordered.withColumn("row", F.monotonically_increasing_id()), "manifest-order")


def _rounds(nodes: DataFrame, most: int, bits: int, extra: list[str]) -> list[DataFrame]:
    """The trees of blocks from the bottom up, until each key has one root."""
    found = [written(_grow(nodes, bits, extra), "manifest-blocks")]
    while most > 1 << bits:
        most = -(-most >> bits)
        size = -F.shiftright(-F.col("size"), bits)
        roots = found[-1].where(F.col("root").isNotNull()).select("key", F.col("block").alias("pos"), size.alias("size"), F.col("root").alias("digest"))
        found.append(written(_grow(roots, bits, []), "manifest-blocks"))
    return found


def _above(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """For each block of the lowest round: the siblings above it. ``tops`` has those above each key's root."""
    found = tops
    for grown in reversed(rounds[1:]):
        carried = [c for c in tops.columns if c not in ("key", "pos", "above")]
        upper = found.withColumnRenamed("pos", "block")
        found = grown.select("key", "pos", "block", "witness").join(upper, ["key", "block"]).select("key", "pos", F.concat("witness", "above").alias("above"), *carried)
    return found


def manifest(docs: DataFrame, *, block_bits: int = BLOCK_BITS, tampered: Column | None = None) -> DataFrame:
    """A row for each of ``docs``: doc_id, leaf, tampered_leaf, pos, size, top_pos, top_size, subroot, root, siblings.

    ``tampered`` says whose ``n_chars`` a second leaf counts one more for; without it, or where it isn't true, that leaf is
    null. ``siblings`` are the digests from the leaf up to the root.
    """
    fields = [F.col(c) for c in FIELDS]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")  # any whole number has one more
    changed = [more if c == "n_chars" else F.col(c) for c in FIELDS]
    second = F.when(F.lit(False) if tampered is None else tampered, leaf_of(changed))
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"),
        leaf_of(fields).alias("leaf"), second.alias("tampered_leaf"),
    )
    ordered = _ranked(leaves, [F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("leaf")])
    placed, most = _placed(ordered)
    rounds = _rounds(placed.withColumn("digest", F.col("leaf")), most, block_bits, ["doc_id", "leaf", "tampered_leaf"])
    subroots = rounds[-1].where(F.col("root").isNotNull()).select(F.col("key").alias("lang_key"), F.col("root").alias("digest"))
    ordered = _ranked(subroots, [F.col("lang_key")])
    placed, most = _placed(ordered.withColumn("key", F.lit("")))
    tops = _rounds(placed, most, block_bits, ["lang_key", "digest"])
    whole = tops[-1].where(F.col("root").isNotNull()).select("key", F.lit(0).cast("bigint").alias("pos"), F.lit(b"").alias("above"), F.col("root").alias("whole_root"))
    above = _above(tops, whole)
    languages = tops[0].join(above.withColumnRenamed("pos", "block"), ["key", "block"]).select(
        F.col("lang_key").alias("key"), F.lit(0).cast("bigint").alias("pos"), F.concat("witness", "above").alias("above"),
        F.col("digest").alias("subroot"), F.col("whole_root"), F.col("pos").alias("top_pos"), F.col("size").alias("top_size"),
    )
    above = written(_above(rounds, languages).withColumnRenamed("pos", "block"), "manifest-above")
    joined = rounds[0].join(above, ["key", "block"])
    siblings = F.concat("witness", "above").alias("siblings")
    return joined.select("doc_id", "leaf", "tampered_leaf", "pos", "size", "top_pos", "top_size", "subroot", F.col("whole_root").alias("root"), siblings)


PROVED = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(rows: DataFrame) -> DataFrame:
    """Fold the second leaf of each row of ``manifest``, or the first where there is none, and compare with the root."""

    def run(batches):
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            proofs, folded = [], []
            paths = zip(columns["pos"], columns["size"], columns["top_pos"], columns["top_size"], strict=True)
            for leaf, other, siblings, (pos, size, top_pos, top_size) in zip(columns["leaf"], columns["tampered_leaf"], columns["siblings"], paths, strict=True):
                proofs.append(node(siblings.hex()))
                folded.append(fold(other or leaf, [(pos, size), (top_pos, top_size)], siblings))
            verified = [a == b for a, b in zip(folded, columns["root"], strict=True)]
            kept = {name: batch.column(name) for name in ("doc_id", "leaf", "subroot", "root")}
            yield pa.RecordBatch.from_pydict({**kept, "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array(verified, pa.bool_())})

    return rows.mapInArrow(run, PROVED)


def op12_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return prove(manifest(docs, tampered=tampered))


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
_SECOND = "sha256(" + " || ".join(_FIELD.format("(n_chars::HUGEINT + 1)" if c == "n_chars" else c) for c in FIELDS) + ")"

OP12_SQL = f"""
WITH RECURSIVE numbered AS (
  SELECT row_number() OVER () AS id, doc_id, lang, {_LEAF} AS leaf, {_SECOND} AS second,
    xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT) AS crc
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size
  FROM numbered
), tree AS (
  SELECT lang, 0 AS level, pos, size AS m, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE m > 1 GROUP BY lang, level, pos // 2, m
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM tree WHERE m = 1
), top AS (
  SELECT 0 AS level, pos, size AS m, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE m > 1 GROUP BY level, pos // 2, m
), heights AS (
  SELECT lang, max(level) AS height FROM tree GROUP BY lang
), steps AS (
  SELECT l.id, t.level AS step, (l.pos >> t.level) & 1 AS is_right, s.h AS sibling
  FROM leaves l JOIN (SELECT DISTINCT lang, level FROM tree WHERE m > 1) t ON l.lang IS NOT DISTINCT FROM t.lang
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = t.level AND s.pos = xor(l.pos >> t.level, 1)
  UNION ALL
  SELECT l.id, h.height + t.level, (r.pos >> t.level) & 1, s.h
  FROM leaves l JOIN heights h ON l.lang IS NOT DISTINCT FROM h.lang JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang
  CROSS JOIN (SELECT DISTINCT level FROM top WHERE m > 1) t
  LEFT JOIN top s ON s.level = t.level AND s.pos = xor(r.pos >> t.level, 1)
), proofs AS (
  SELECT id, string_agg(sibling, '' ORDER BY step) AS siblings FROM steps GROUP BY id
), folded AS (
  SELECT id, 0 AS step, CASE WHEN crc % 7 = 0 THEN second ELSE leaf END AS h FROM leaves
  UNION ALL
  SELECT f.id, f.step + 1, sha256(CASE WHEN s.sibling IS NULL THEN f.h WHEN s.is_right = 1 THEN s.sibling || f.h ELSE f.h || s.sibling END)
  FROM folded f JOIN steps s ON s.id = f.id AND s.step = f.step
), ends AS (
  SELECT id, arg_max(h, step) AS folded_root FROM folded GROUP BY id
)
SELECT l.doc_id, l.leaf, r.subroot, w.h AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256, e.folded_root, e.folded_root = w.h AS verified
FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang JOIN ends e ON e.id = l.id LEFT JOIN proofs p ON p.id = l.id
CROSS JOIN (SELECT h FROM top WHERE m = 1) w
"""
