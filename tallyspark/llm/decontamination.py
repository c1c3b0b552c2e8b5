"""Benchmark decontamination: a hash set of normalised benchmark n-grams against every training window.

The benchmark's windows form a hash set that is broadcast once to the scan of the texts. It takes about five bytes for a
byte of benchmark text, on the driver and in every Python worker, so ``block_bytes`` of text (or one item, if that is
longer) bound what they hold: a benchmark whose text is longer is cut into blocks of about that size, and one block after the other is collected, broadcast, scanned with and given up. Such a
scan keeps only the texts that it hits, by two hashes of the text, so equal texts share their hits; the blocks' hits
are merged by those hashes and joined back. The number of scans grows with the benchmark, the memory doesn't. Every
hash match is verified word by word before it counts.

Defined cases: a null or empty text has no words and no hits; an item without words is never found; an item
with a null id still marks words but is not listed; repeated items are listed once; an empty benchmark leaves
every document clean. Other columns, whatever their names, pass through.
"""

from __future__ import annotations

import re
from array import array
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.columns import unused
from tallyspark.functions.lineage import written
from tallyspark.llm.words import WORD, WordHashes, words

HITS = "struct<n_words:bigint,items:array<string>,hit_from:array<int>,hit_to:array<int>>"
_PRIME = 0x9E3779B97F4A7C15
TOGETHER = 1 << 16


class NgramSet:
    """Every window of ``window`` words (or a whole shorter item) of some items, in flat arrays.

    A word is its rank among the items' words by hash; a window is a place in the items' words one after the other, under
    the hash of its ranks. That is 16 bytes a window, beside each different word once. What matches by hash is compared
    rank by rank, and the words themselves byte by byte.
    """

    def __init__(self, items: list[tuple], window: int):
        self.known = None  # the scanning worker's memory of words, gone with the set
        numbers, sizes, names, seen = array("i"), [], [], {}
        for item_id, text in items:
            found = words(text)
            if found:
                numbers.extend([seen.setdefault(w, len(seen)) for w in found])
                sizes.append(len(found))
                names.append(None if item_id is None else str(item_id))
        hashes, self.seed = self._words_hashed(seen, 0), 0
        while len(np.unique(hashes)) < len(seen):  # two words of one hash: another seed keeps them apart
            self.seed += 1
            hashes = self._words_hashed(seen, self.seed)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        by_number = list(seen)
        kept = [by_number[k] for k in order.tolist()]
        self.word_hashes, self.letters, self.ends = hashes[order], b"".join(kept), np.cumsum([0, *map(len, kept)])
        self.names, self.tokens = names, rank[np.frombuffer(numbers, np.int32)] if len(numbers) else np.empty(0, np.int32)
        self.first = np.cumsum([0, *sizes])
        self.windows = {}
        lengths = np.minimum(sizes, window)
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            places = np.concatenate([np.arange(self.first[k], self.first[k + 1] - length + 1, dtype=np.int32) for k in own])
            hashed = self._hash([self.tokens[places + k] for k in range(length)])
            order = np.argsort(hashed, kind="stable")
            self.windows[length] = hashed[order], places[order]

    @staticmethod
    def _words_hashed(found, seed: int) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in found), np.uint64, len(found))

    @staticmethod
    def _hash(columns: list[np.ndarray]) -> np.ndarray:
        total = np.zeros(len(columns[0]), np.uint64)
        for column in columns:
            total = total * np.uint64(_PRIME) + column.astype(np.uint64) + np.uint64(1)
        return total

    def _ranks(self, found: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for words that no item has."""
        if self.known is None:
            self.known = WordHashes()
        hashed = self.known.of(found) if self.seed == 0 else self._words_hashed(found, self.seed)
        if not len(self.word_hashes):
            return np.full(len(found), -1, np.int32)
        place = np.minimum(np.searchsorted(self.word_hashes, hashed), len(self.word_hashes) - 1).astype(np.int32)
        return np.where(self.word_hashes[place] == hashed, place, np.int32(-1))

    def scan(self, found: list[bytes], hit: np.ndarray, items: set) -> None:
        """Mark the words of each occurring window in ``hit`` and add the items it belongs to."""
        ranks = self._ranks(found)
        unknown = np.concatenate([[0], np.cumsum(ranks < 0)])
        for length, (hashes, places) in self.windows.items():
            starts = np.flatnonzero(unknown[length:] == unknown[:-length]) if len(ranks) >= length else ()
            if not len(starts):
                continue
            hashed = self._hash([ranks[starts + k] for k in range(length)])
            low = np.searchsorted(hashes, hashed)
            starts, low, hashed = (x[hashes[np.minimum(low, len(hashes) - 1)] == hashed] for x in (starts, low, hashed))
            if len(starts):
                self._verify(found, ranks, length, starts, low, np.searchsorted(hashes, hashed, side="right"), places, hit, items)

    def _verify(self, found, ranks, length, starts, low, high, places, hit, items) -> None:
        """Compare each start with every window of its hash; runs of equal windows are taken ``TOGETHER`` at a time."""
        span = np.arange(length)
        same_word = np.array([self.letters[self.ends[r] : self.ends[r + 1]] == w if r >= 0 else False for r, w in zip(ranks.tolist(), found, strict=True)])
        wrong = np.concatenate([[0], np.cumsum(~same_word)])
        right = wrong[starts + length] == wrong[starts]
        for at, a, b in zip(starts[right].tolist(), low[right].tolist(), high[right].tolist(), strict=True):
            for part in range(a, b, TOGETHER):
                here = places[part : min(b, part + TOGETHER)]
                here = here[(self.tokens[here[:, None] + span] == ranks[at : at + length]).all(axis=1)]
                if len(here):
                    hit[at : at + length] = True
                    owners = np.unique(np.searchsorted(self.first, here, side="right") - 1).tolist()
                    items.update(self.names[k] for k in owners if self.names[k] is not None)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """How many blocks there are, and a function that collects one of them."""
    narrow = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).distinct()
    size = narrow.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    count = max(1, -(-size // block_bytes))
    return count, lambda k: [(r.i, r.t) for r in narrow.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k).collect()]


def _scan(text: Column, ngrams) -> Column:
    """The hits struct of each text against one broadcast set."""

    @F.pandas_udf(HITS)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = words(text)
            hit, items = np.zeros(len(found), bool), set()
            ngrams.value.scan(found, hit, items)
            edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            rows.append((len(found), sorted(items), edges[::2].tolist(), edges[1::2].tolist()))
        return pd.DataFrame(rows, columns=["n_words", "items", "hit_from", "hit_to"])

    return scan.asNondeterministic()(text)


def _merged(hits: Column) -> Column:
    """One hits struct from the structs of several blocks."""

    @F.pandas_udf(HITS)
    def merge(lists: pd.Series) -> pd.DataFrame:
        rows = []
        for parts in lists:
            n_words, items = int(parts[0]["n_words"]), sorted({i for part in parts for i in part["items"]})
            hit = np.zeros(n_words, bool)
            for part in parts:
                for start, end in zip(part["hit_from"], part["hit_to"], strict=True):
                    hit[start:end] = True
            edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            rows.append((n_words, items, edges[::2].tolist(), edges[1::2].tolist()))
        return pd.DataFrame(rows, columns=["n_words", "items", "hit_from", "hit_to"])

    return merge(hits)


def with_hits(
    docs: DataFrame, benchmark: DataFrame, name: str = "hits", *, text: str = "text", id_col: str = "item_id", text_col: str = "text", window: int = 10, block_bytes: int = 32 << 20
) -> DataFrame:
    """``docs`` with a struct per text: its words, the items that occur, and the runs ``[hit_from, hit_to)`` of hit words."""
    count, block = _blocks(benchmark, id_col, text_col, block_bytes)
    context = docs.sparkSession.sparkContext
    if count == 1:
        return docs.withColumn(name, _scan(F.col(text), context.broadcast(NgramSet(block(0), window))))
    h1, h2 = unused(docs, "h1"), unused(docs, "h2")
    marked = docs.withColumns({h1: F.xxhash64(text), h2: F.xxhash64(F.lit("2"), F.col(text))})
    found = []
    for k in range(count):
        ngrams = context.broadcast(NgramSet(block(k), window))
        part = marked.where(F.col(text).isNotNull()).select(h1, h2, _scan(F.col(text), ngrams).alias(name)).where(F.size(F.col(name)["hit_from"]) > 0)
        found.append(written(part.dropDuplicates([h1, h2]), "hits-of-block"))
        ngrams.destroy()
    # a text has at most one row a block
    hits = reduce(DataFrame.unionByName, found).groupBy(h1, h2).agg(F.collect_list(name).alias(name)).withColumn(name, _merged(F.col(name)))
    n_words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
    none = F.struct(n_words.alias("n_words"), F.array().cast("array<string>").alias("items"), F.array().cast("array<int>").alias("hit_from"), F.array().cast("array<int>").alias("hit_to"))
    joined = marked.join(hits, [h1, h2], "left")
    return joined.select(*docs.columns, F.coalesce(name, none).alias(name))


def hit_words(hits: Column) -> Column:
    """How many words the runs of a hits struct cover."""
    pairs = F.zip_with(hits["hit_from"], hits["hit_to"], lambda a, b: (b - a).cast("bigint"))
    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda total, n: total + n)


_RUN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # the words before lower-casing


def _cut_words(text: str | None, begin, end) -> str | None:
    if text is None or not len(begin):
        return text
    spans = [m.span() for m in _RUN.finditer(text)]
    kept, at = [], 0
    for a, b in zip(begin, end, strict=True):
        kept.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "".join([*kept, text[at:]])


def cut_hits(text: Column, hits: Column) -> Column:
    """The text without its hit words and what stands between them."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([_cut_words(*row) for row in zip(texts, starts, ends, strict=True)], dtype=object)

    return cut(text, hits["hit_from"], hits["hit_to"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", text: str = "text", **options) -> DataFrame:
    """Drop contaminated documents (``mode="documents"``) or cut their hit words out (``mode="spans"``)."""
    hits = unused(docs, "hits")
    scanned = with_hits(docs, benchmark, hits, text=text, **options)
    if mode == "documents":
        return scanned.where(F.size(F.col(hits)["hit_from"]) == 0).drop(hits)
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode}")
    return scanned.withColumn(text, cut_hits(F.col(text), F.col(hits))).drop(hits)


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "h").select(
        "doc_id",
        F.col("h.n_words"),
        hit_words(F.col("h")).alias("n_hit"),
        F.size("h.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("h.items"), ","), 256).alias("items_sha256"),
        (F.size("h.hit_from") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), item_window AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
  FROM documents
), place AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM doc),
gram AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM place, (SELECT DISTINCT n FROM item_window) WHERE p + n - 1 <= len(w)
), found AS (SELECT doc_id, p, g.n, item_id FROM gram g JOIN item_window i ON g.gram = i.gram AND g.n = i.n),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN hit h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""
