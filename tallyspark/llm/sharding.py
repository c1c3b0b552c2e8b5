"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. Rows are keyed (id, bytes, CRC-32), numbered and written once; the writer's partitions, folded into at most
   ``blocks`` of them, are the senders. The number is part of both hashes, so equal rows are dealt like any others.
2. For sender and shard the matrix draws how many rows go across: the exact multivariate hypergeometric law
   given the senders' row counts and the shards' sizes, which differ by one at most. The matrix holds
   ``blocks x shards`` counts whatever the input's size; only it is drawn outside Spark.
3. Each sender ranks its rows by a hash and cuts the ranking by its row of the matrix: the local permutation.
4. After the exchange each shard orders its rows by a second hash: the second permutation.

Both orders are found in bins of the hash of about ``ROWS_A_BIN`` rows, so no sender and no shard is sorted by one task,
however many rows it has.

Any row lands in any shard and slot with equal probability, every shard's size is exact, and reruns over the
same written partitions agree. Law: ``rows``.

Defined cases: a null text has no bytes (size 8) and the CRC-32 of an empty string; null or repeated ids are
ordinary rows; with fewer rows than shards some stay empty; no rows give none. Other
columns pass through, whatever their names but ``shard`` and ``slot``, which are set.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.columns import unused
from tallyspark.functions.lineage import cut_lineage, written

SHARDS = 24
BLOCKS = 1024
ROWS_A_BIN = 200_000


def _log_growth(a: int, d: int) -> float:
    """log((a + d)! / a!) without the cancellation of two large logarithms."""
    if a + min(d, 0) < 1000:
        return math.lgamma(a + d + 1) - math.lgamma(a + 1)
    tail = lambda n: 1 / (12 * n) - 1 / (360 * n**3)  # noqa: E731  what Stirling's formula adds
    return d * (math.log(a) - 1) + (a + d + 0.5) * math.log1p(d / a) + tail(a + d) - tail(a)


def hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """How many of ``draws`` from ``good + bad`` are good; any size of numbers.

    Where the law is narrow by inversion outwards from the mode, else by rejection with a ratio of uniforms
    (Stadlober), whose expected number of trials is bounded whatever the numbers.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    total = good + bad
    at = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))

    def log_ratio(d: int) -> float:
        """log of the law at ``at + d`` over the law at ``at``."""
        return -_log_growth(at, d) - _log_growth(good - at, -d) - _log_growth(draws - at, -d) - _log_growth(bad - draws + at, d)

    mean = draws * good / total
    variance = mean * (bad / total) * ((total - draws) / (total - 1))
    if variance > 400:
        # The hat's constants, 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e)
        width = 1.7155277699214135 * math.sqrt(variance + 0.5) + 0.8989161620588988
        while True:
            u = 1 - rng.random()
            k = math.floor(mean + 0.5 + width * (rng.random() - 0.5) / u)
            if low <= k <= high and 2 * math.log(u) <= log_ratio(k - at):
                return k
    weights = {at: 1.0}
    for step in (1, -1):
        k = at + step
        while low <= k <= high and (weight := math.exp(log_ratio(k - at))) > 1e-18:
            weights[k] = weight
            k += step
    point = rng.random() * sum(weights.values())
    for k, weight in weights.items():
        point -= weight
        if point <= 0:
            return k
    return at


def communication_matrix(counts: list[int], sizes: list[int], rng: random.Random) -> list[list[int]]:
    """Counts by sender and shard with the given row and column sums, under the uniform shuffle's law."""
    left, matrix = list(sizes), []
    for count in counts:
        row, draws, rest = [], count, sum(left)
        for size in left:
            rest -= size
            took = hypergeometric(size, rest, draws, rng)
            row.append(took)
            draws -= took
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def _ranked(rows: DataFrame, group: str, seed: int, key: list[str], largest: int, name: str) -> DataFrame:
    """``rows`` with their place in their group, from 0, in the order of a seeded hash.

    The order is that of (bin, hash): a window over one narrow row a bin gives where each bin starts, and one over each
    bin's rows the place in it.
    """
    order, bin_, place, of_group, of_bin, offset = (unused(rows, stem) for stem in ("order", "bin", "place", "of_group", "of_bin", "offset"))
    bins = max(1, min(1 << 17, -(-largest // ROWS_A_BIN)))
    hashed = rows.withColumn(order, F.xxhash64(F.lit(seed), *[F.col(c) for c in key]))
    hashed = cut_lineage(hashed.withColumn(bin_, F.floor(F.shiftrightunsigned(order, 47) * bins / F.lit(1 << 17)).cast("int")))
    before = Window.partitionBy(group).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = hashed.groupBy(group, bin_).count().select(F.col(group).alias(of_group), F.col(bin_).alias(of_bin), F.coalesce(F.sum("count").over(before), F.lit(0)).alias(offset))
    within = Window.partitionBy(group, bin_).orderBy(order, *key)
    placed = hashed.withColumn(place, F.row_number().over(within) - 1).join(offsets, (F.col(group) == F.col(of_group)) & (F.col(bin_) == F.col(of_bin)))
    return placed.withColumn(name, (F.col(offset) + F.col(place)).cast("bigint")).drop(order, bin_, place, of_group, of_bin, offset)


def shard(rows: DataFrame, key: list[str], *, shards: int = SHARDS, seed: int = 0, blocks: int = BLOCKS) -> DataFrame:
    """Add ``shard`` and ``slot`` to narrow rows. ``key``: columns for the hashes, beside the row's number."""
    sender, of_sender, upto, local, number = (unused(rows, stem) for stem in ("sender", "of_sender", "upto", "local", "number"))
    numbered = rows.withColumns({sender: F.pmod(F.spark_partition_id(), F.lit(blocks)), number: F.monotonically_increasing_id()})
    sent, key = written(numbered, "shard-rows"), [*key, number]
    counts = {r[0]: r[1] for r in sent.groupBy(sender).count().collect()}  # at most `blocks` rows
    senders, total = sorted(counts), sum(counts.values())
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    matrix = communication_matrix([counts[s] for s in senders], sizes, random.Random(seed))
    cuts = [(s, [sum(row[: k + 1]) for k in range(shards)]) for s, row in zip(senders, matrix, strict=True)]
    table = rows.sparkSession.createDataFrame(cuts, f"{of_sender} int, {upto} array<bigint>")
    first = _ranked(sent, sender, 2 * seed + 1, key, max(counts.values(), default=0), local)
    dealt = (
        first.join(F.broadcast(table), F.col(sender) == F.col(of_sender))  # blocks x shards numbers
        .withColumn("shard", F.size(F.filter(upto, lambda n: n <= F.col(local))))
        .drop(sender, of_sender, upto, local)
    )
    return _ranked(dealt, "shard", 2 * seed + 2, key, sizes[0], "slot").drop(number)


def op7_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(rows, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
