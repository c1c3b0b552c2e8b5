"""Keys that hold most rows: scans in ranges, joins in bands, terms by their rarest word, openings by an index."""

import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.operators import joins, picks, scans


def events(spark, n=3000):
    """Half of the rows are one key's, another part has no key; every seventh row has a value."""
    x = F.col("id")
    key = F.when(x % 2 == 0, "hot").when(x % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("k"), (x % 11).cast("string")))
    return spark.range(n).select(key.alias("k"), ((x * 7919) % n).alias("at"), F.when(x % 7 == 0, x).alias("v"), x.alias("row"))


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("share", [1, 200, None])
def test_scans_in_ranges_equal_the_window(spark, share, before):
    df = events(spark)
    over = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    want = df.withColumn("held", F.last("v", ignorenulls=True).over(over))
    got = scans.last_known(df, ["k"], [F.col("at")], F.col("v"), "held", before=before, share=share)
    assert got.columns == want.columns and collected(got) == collected(want)


def test_one_key_with_all_rows_uses_every_task(spark):
    df = events(spark).withColumn("k", F.lit("one"))
    hot, any_hot = scans.hot_keys(df, ["k"], 100)
    assert any_hot and [r.k for r in hot.collect()] == ["one"]
    got = picks.carry_forward(df, ["k"], "at", "v", "held", share=100)
    placed = df.repartitionByRange(4, "k", "at").groupBy(F.spark_partition_id()).count().collect()
    assert len(placed) == 4 and max(r[1] for r in placed) < 2 * min(r[1] for r in placed)
    assert collected(got) == collected(picks.carry_forward(df, ["k"], "at", "v", "held"))


def test_as_of_and_previous_period_in_ranges(spark):
    left = events(spark).select("k", F.when(F.col("row") % 13 != 0, F.col("at")).alias("t"), "row")
    right = events(spark, 2000).select("k", F.col("at").alias("t"), F.col("row").alias("p"))
    assert collected(joins.as_of_join(left, right, ["k"], "t", "t", ["p"], share=50)) == collected(joins.as_of_join(left, right, ["k"], "t", "t", ["p"]))
    yearly = events(spark).where("at % 3 <> 1").select("k", "at", F.col("row").alias("n"))
    over = Window.partitionBy("k").orderBy("at")
    want = yearly.withColumn("before", F.when(F.lag("at").over(over) == F.col("at") - 1, F.lag("n").over(over)))
    assert collected(picks.previous_period(yearly, ["k"], "at", "n", "before", share=50)) == collected(want)


def test_scans_of_nothing_and_of_a_column_that_is_there(spark):
    empty = events(spark).limit(0)
    assert scans.last_known(empty, ["k"], [F.col("at")], F.col("v"), "held").collect() == []
    got = scans.last_known(events(spark), ["k"], [F.col("at")], F.col("v"), "v", share=10)
    assert collected(got.select("k", "at", "row", "v")) == collected(scans.last_known(events(spark), ["k"], [F.col("at")], F.col("v"), "v").select("k", "at", "row", "v"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_band_join_equals_all_pairs(spark, how, null_safe):
    x = F.col("id")
    key = F.when(x % 3 == 0, F.lit(None).cast("int")).otherwise((x % 2).cast("int"))
    left = spark.range(120).select(key.alias("k"), F.when(x % 17 != 0, (x * 37 % 101) / 4.0 - 9).alias("a"), x.alias("i"))
    right = spark.range(90).select(key.alias("k"), F.when(x % 19 != 0, (x * 53 % 97) / 4.0 - 9).alias("b"), x.alias("j"))
    same = (F.col("l.k").eqNullSafe(F.col("r.k"))) if null_safe else (F.col("l.k") == F.col("r.k"))
    pairs = left.alias("l").join(right.alias("r"), same & (F.abs(F.col("a") - F.col("b")) < 1.5), how)
    want = pairs.select("l.k", "a", "i", *(["b", "j"] if how in ("inner", "left") else []))
    got = joins.band_join(left, right, ["k"], F.col("a"), F.col("b"), 1.5, how, null_safe=null_safe)
    assert got.columns == want.columns and collected(got) == collected(want)


def test_band_join_of_a_key_with_all_rows_makes_no_product(spark):
    """A product of 300,000 rows a side would be 9e10 pairs; near pairs are three a row, and of equal values none is made."""
    n, began = 300_000, time.time()
    left = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("a"))
    right = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("b"))
    assert joins.band_join(left, right, ["k"], F.col("a"), F.col("b"), 1.5).count() == 3 * n - 2
    same = left.withColumn("a", F.lit(5.0))
    assert joins.band_join(same, same.withColumnRenamed("a", "b"), ["k"], F.col("a"), F.col("b"), 1.5, "left_semi").count() == n
    assert time.time() - began < 120


def test_terms_that_begin_alike_meet_by_their_rarest_word(spark):
    """Ten thousand terms that begin with NAVY, and five thousand texts with NAVY AIR in them: fifty million pairs by the first word."""
    from tallyspark.operators import matching

    began = time.time()
    words = F.concat(F.lit("NAVY AIR item"), F.col("id").cast("string"))
    terms = spark.range(10_000).select(words.alias("term")).union(spark.createDataFrame([("navy",), ("AN/APG-81",), ("Air  Navy",), ("NAVY nothing",), ("--",)], "term string"))
    texts = spark.range(5000).select(F.col("id").alias("i"), F.concat(F.lit("The Navy air item"), (F.col("id") * 3).cast("string"), F.lit(", the AN/APG-81's. Navy Air")).alias("t"))
    got = matching.term_hits(texts, terms, "i", "t")
    by_term = {r[0]: r[1] for r in got.groupBy(F.when(F.col("term").contains("item"), "items").otherwise(F.col("term")).alias("k")).count().collect()}
    assert by_term == {"items": 3334, "navy": 5000, "AN/APG-81": 5000} and time.time() - began < 60


def test_term_hits_equal_a_search_for_each_term(spark):
    import re

    from tallyspark.operators import matching

    terms = ["F-35", "joint strike", "STRIKE", "a.b", "é", "\\Q", "x y", "Joint", "35"]
    texts = ["the F-35 joint  strike", "f-35a Joint strike fighter", "a.b aXb", "x y", "x  y", "", None, "STRIKE-35", "xjoint", "a b a.b."]
    want = {(k, t) for k, text in enumerate(texts) for t in terms if text and re.search(r"[A-Z0-9]", t.upper()) and re.search(rf"(?<![A-Z0-9]){re.escape(t.upper())}(?![A-Z0-9])", text.upper())}
    got = matching.term_hits(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), spark.createDataFrame([(t,) for t in [*terms, "strike", None]], "term string"), "i", "t")
    assert {(r.i, r.term) for r in got.collect()} == want | {(i, "strike") for i, t in want if t == "STRIKE"}


def test_a_document_of_many_pages_and_narratives_is_no_product(spark):
    """Ten thousand pages and as many narratives of one document would be a hundred million pairs."""
    from tallyspark.operators import pages

    began, x = time.time(), F.col("id")
    body = lambda n, gap: F.concat_ws(gap, F.lit("This line number"), n.cast("string"), F.lit("tells what the money of the year is for in this book"))
    book = spark.range(10_000).select(F.lit(1).alias("document_id"), x.cast("int").alias("page"), F.concat(F.lit("Head. "), body(x, "\n ")).alias("text"))
    told = spark.range(10_000).select(x.alias("narrative_id"), F.lit(1).alias("document_id"), body(x * 2, " ").alias("body"))
    got = {r.narrative_id: (r.page, r.resolution) for r in pages.narrative_pages(told, book).collect()}
    assert got[7] == (14, "unique") and got[6000] == (None, "unresolved") and sum(p is not None for p, _ in got.values()) == 5000
    assert time.time() - began < 90


def test_short_and_odd_openings(spark):
    from tallyspark.operators import pages

    book = spark.createDataFrame([(1, 1, "One two three."), (1, 2, "zero one two\n\nthree four"), (1, 3, None), (2, 1, "one two")], "document_id int, page int, text string")
    told = spark.createDataFrame([(1, 1, "one  two"), (2, 1, "two three four five"), (3, 1, None), (4, 1, "  "), (5, 2, "one"), (6, 2, "One"), (7, 1, "two three.")], "narrative_id int, document_id int, body string")
    got = {r.narrative_id: (r.page, r.resolution, r.candidate_pages) for r in pages.narrative_pages(told, book).collect()}
    nothing = (None, "unresolved", 0)
    assert got == {1: (2, "unique", 1), 2: nothing, 3: nothing, 4: nothing, 5: (1, "unique", 1), 6: nothing, 7: (1, "unique", 1)}
    assert {r.resolution for r in pages.narrative_pages(told.where("narrative_id = 3"), book).collect()} == {"unresolved"}


def steps_by_hand(edges):
    """Layers by removing free nodes one layer after another; components by reachability."""
    nodes = {n for e in edges for n in e if n is not None}
    left, steps, k = {(a, b) for a, b in edges if a is not None and b is not None and a != b}, {}, 0
    links = set(left)
    while free := [n for n in nodes - set(steps) if not any(b == n for _, b in left)]:
        steps |= {n: k for n in free}
        left = {(a, b) for a, b in left if a not in steps}
        k += 1
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in links:
            reach[a] |= reach[b]
    on_cycle = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if any(m != n and m in reach[n] and n in reach[m] for m in nodes)}
    return {n: (steps.get(n, k), n not in steps) for n in nodes}, on_cycle


GRAPHS = [
    [], [("a", "b")], [("a", "a")], [("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("b", "d")],
    [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("x", "e"), ("e", "f"), ("f", "e"), ("q", "r"), (None, "z")],
    [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("a", "f"), ("f", "g"), ("g", "h"), ("h", "f"), ("g", "i")],
]


@pytest.mark.parametrize("k", range(len(GRAPHS) + 3))
def test_layers_and_cycles_equal_plain_loops(spark, k):
    import random

    from tallyspark.operators import chains

    rng = random.Random(k)
    edges = GRAPHS[k] if k < len(GRAPHS) else [(f"n{rng.randint(0, 25)}", f"n{rng.randint(0, 25)}") for _ in range(8 + 12 * (k - len(GRAPHS)))]
    steps, components = steps_by_hand(edges)
    df = spark.createDataFrame(edges, "src string, dst string")
    assert {r.node: (r.step, r.cyclic) for r in chains.longest_path_steps(df).collect()} == steps
    assert {r.node: r.component for r in chains.cycle_components(df).collect()} == components


def test_a_long_path_and_a_long_ring_take_few_rounds(spark):
    from tallyspark.operators import chains

    n, began = 10_000, time.time()
    path = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = chains.longest_path_steps(path).agg(F.max("step"), F.count("*"), F.sum(F.abs(F.col("step") - F.col("node")))).first()
    assert tuple(got) == (n, n + 1, 0) and time.time() - began < 120
    ring = path.withColumn("dst", F.col("dst") % n)
    assert [tuple(r) for r in chains.cycle_components(ring).groupBy("component").count().collect()] == [(0, n)]


def test_clause_rules_take_time_by_the_clause(spark):
    from tallyspark.operators import succession

    names = " and ".join(f"PE {1000000 + k}A" for k in range(12_000))
    df = spark.createDataFrame([(f"{names} were transferred to PE 0601102A as planned.",)], "clause string").coalesce(1)
    began = time.time()
    assert df.select(F.size(succession.named_pairs(F.col("clause"))).alias("n")).first().n == 12_000
    assert time.time() - began < 10
