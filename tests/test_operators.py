"""Operators of the spending library on hand-computed micro tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import scalars as S
from tallyspark.operators import aggregates as A
from tallyspark.operators import assertions as DQ
from tallyspark.operators import chains, entities, graph, joins, ledger, links, matching, picks
from tallyspark.sources import html, tables
from tallyspark.streaming.ingest import ingest_new_files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    "name,normal",
    [
        ("THE BOEING COMPANY", "BOEING"), ("BOEING COMPANY, THE (INC)", "BOEING"), ("Huntington Ingalls Industries, Inc", "HUNTINGTON INGALLS INDUSTRIES"),
        ("ACME RESEARCH, L.L.C.", "ACME RESEARCH"), ("BOEING AEROSPACE OPERATIONS, I", "BOEING"), ("BOEING NORTH AMERICAN INC", "BOEING"),
        ("BOEING CAPITAL CORPORATION", "BOEING"), ("UNITED DEFENSE SYSTEMS INC", "UNITED DEFENSE SYSTEMS"), ("UNITED CAPITAL CORP.", "UNITED CAPITAL"),
        ("DELTA INFORMATION SYSTEMS", "DELTA INFORMATION SYSTEMS"), ("DELTA FOUNDATION", "DELTA"), (None, ""), ("THE INC", ""),
    ],
)
def test_normalized_name(spark, name, normal):
    df = spark.createDataFrame([(name,)], "n string").select(S.normalized_name(F.col("n")).alias("a"))
    once = df.first()[0]
    again = spark.createDataFrame([(once,)], "n string").select(S.normalized_name(F.col("n"))).first()[0]
    assert once == normal and again == normal


def test_scalars(spark):
    df = spark.createDataFrame([("", "x", "0", "1", "1.5", "4", "9", "10")], [f"c{k}" for k in range(8)])
    assert list(df.select(*[S.offers_bucket(F.col(c)) for c in df.columns]).first()) == ["unknown", "unknown", "unknown", "1", "2", "3-4", "5-9", "10+"]
    one = spark.range(1)
    day = lambda d: S.fiscal_year(F.to_date(F.lit(d)))
    assert tuple(one.select(day("2024-09-30"), day("2024-10-01")).first()) == (2024, 2025)
    assert tuple(one.select(S.federal_account(F.lit("1319N")), S.federal_account(F.lit("0400D")), S.federal_account(F.lit("0100"))).first()) == ("017-1319", "097-0400", "097-0100")
    assert tuple(one.select(S.canonical_number(F.lit(1.5)), S.canonical_number(F.lit(100.0)), S.canonical_number(F.lit(0.00004))).first()) == ("1.5", "100", "0")
    import hashlib

    want = hashlib.sha256(b"a||7").hexdigest()[:16]
    null = F.lit(None).cast("string")
    assert tuple(one.select(S.fact_id(F.lit("a"), null, F.lit(7), absent_as_empty=(1,)), S.fact_id(F.lit("a"), null)).first()) == (want, None)
    assert tuple(one.select(S.line_key(F.lit("1319N"), F.lit("N"), F.lit(12)), S.line_key(null, F.lit("N"), F.lit(1))).first()) == ("1319N-N-L12", None)
    assert one.select(S.plain_quotes(F.lit("DoD’s  “plan”"))).first()[0] == "DoD's \"plan\""


def test_concentration_counts_only_positive_members(spark):
    df = spark.createDataFrame([("g", "a", 60), ("g", "b", 40), ("g", "c", -10), ("z", "a", -5)], "g string, m string, v bigint")
    got = {r.g: r for r in A.concentration(df, ["g"], "m", "v").collect()}
    assert (got["g"].hhi, got["g"].members, got["g"].net_total, got["g"].top_member) == (5200.0, 2, 90, "a")
    assert (got["z"].hhi, got["z"].members) == (0.0, 0)


def test_regrain_keeps_the_owner_only_where_keys_collide(spark):
    df = spark.createDataFrame([("p", 1, "a", 5), ("p", 1, "b", 6), ("q", 1, "a", 7), ("q", 2, "b", 8)], "k string, s int, o string, v bigint")
    assert rows(A.regrain(df, ["k"], ["s"], "o", "v")) == sorted([("p", 1, "a", 5, 1), ("p", 1, "b", 6, 1), ("q", 1, None, 7, 1), ("q", 2, None, 8, 1)], key=repr)


def test_hierarchy_conserves_and_top_n_conserves(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", None, 3)], "l1 string, l2 string, v bigint")
    edges = A.hierarchy_edges(df, ["l1", "l2"], "v")
    assert ("l1", "b", "l2", "b|?", 3, 1) in rows(edges) and DQ.flow_imbalance(edges).count() == 0
    top = A.top_n_other(df.withColumn("g", F.lit(1)), ["g"], "l2", "v", 1)
    assert rows(top) == sorted([(1, "Other", 3, 2), (1, None, 3, 1)], key=repr) or top.agg(F.sum("v")).first()[0] == 6


def test_pct_change_is_null_without_a_base(spark):
    df = spark.createDataFrame([(3, 2), (3, 0), (3, None)], "n int, b int")
    assert [r[0] for r in df.select(A.pct_change(F.col("n"), F.col("b"))).collect()] == [50.0, None, None]


def test_joins(spark):
    left = spark.createDataFrame([("k", "a", 1), ("k", "c", 2), ("q", "a", 3)], "k string, s string, i int")
    table = spark.createDataFrame([("k", "a", "exact"), ("k", None, "wide")], "k string, s string, v string")
    assert {r.i: (r.v, r.is_specific) for r in joins.specific_then_general(left, table, ["k", "s"], ["k"], ["v"]).collect()} == {1: ("exact", True), 2: ("wide", False), 3: (None, False)}
    events = spark.createDataFrame([("u", 5), ("u", 1), ("w", 9)], "u string, at int")
    prices = spark.createDataFrame([("u", 2, "p2"), ("u", 5, "p5"), ("u", 7, "p7")], "u string, t int, p string")
    assert {(r.u, r["at"]): r.p for r in joins.as_of_join(events, prices, ["u"], "at", "t", ["p"]).collect()} == {("u", 5): "p5", ("u", 1): None, ("w", 9): None}
    ed = spark.createDataFrame([("p", None, 2020, 1), ("p", None, 2021, 4), ("p", "o", 2021, 9)], "k string, o string, e int, v int")
    assert [(r.from_v, r.to_v) for r in joins.edition_join(ed, ["k", "o"], "e", 1, ["v"]).collect()] == [(1, 4)]
    awards = spark.createDataFrame([(1, "017-1319; 021-2040"), (2, "017-13190")], "a int, accounts string")
    lines = spark.createDataFrame([("017-1319",)], "account string")
    assert [r.a for r in joins.list_member_join(lines, awards, "account", "accounts").collect()] == [1]


def test_entity_crosswalk_takes_whole_pairs_and_downgrades_mixed_families(spark):
    tx = spark.createDataFrame(
        [("u1", "Acme Inc", "P1", "ACME CORP", 100.0), ("u1", "Acme Inc", "P9", "ZZZ", 40.0), ("u1", "Acme", "P1", "ACME CORP", 30.0), ("u2", "Beta LLC", "", "", 5.0), ("u3", "Acme X", "P2", "Acme Corporation", 9.0), ("", "no id", None, None, 1.0)],
        "recipient_uei string, recipient_name string, parent_uei string, parent_name string, obligation double",
    )
    got = {r.recipient_uei: r for r in entities.entity_crosswalk(tx).collect()}
    assert sorted(got) == ["u1", "u2", "u3"]
    assert (got["u1"].parent_uei, got["u1"].parent_name, got["u1"].family_key, got["u1"].total_obligation) == ("P1", "ACME CORP", "ACME", 170.0)
    assert (got["u1"].confidence, got["u3"].confidence, got["u2"].confidence) == ("medium", "medium", "medium")
    assert (got["u2"].family_key, got["u2"].method) == ("BETA", "recipient_name")


def test_family_rollup_ranks_confidence(spark):
    data = spark.createDataFrame([("A", 5, "high"), ("B", 9, "low"), ("C", 1, "high")], "family_key string, amount bigint, confidence string")
    members = spark.createDataFrame([("A", "fam"), ("B", "fam")], "family_key string, family string")
    assert rows(entities.family_rollup(data, members)) == [("C", 1, 1, "high", "C"), ("fam", 14, 2, "low", "B")]


def test_family_events(spark):
    events = spark.createDataFrame([("F", "Old Inc", "New Corp", "2020"), ("G", "Other", "New Corp", "2021")], "family string, from_name string, to_name string, effective_date string")
    known = spark.createDataFrame([("OLD",), ("NEW",)], "family_key string")
    members = entities.resolve_families(events, known)
    assert [r.family_key for r in entities.conflicting_members(members).collect()] == ["NEW"]
    anchors = spark.createDataFrame([("F", "NEW")], "family string, family_key string")
    assert {(r.family, r.family_key) for r in entities.member_arrivals(members, anchors).collect()} == {("F", "OLD"), ("G", "NEW")}


def test_matching(spark):
    keys = spark.createDataFrame([(1, "KC-46A tanker"), (2, "tanker"), (3, "x")], "k int, s string")
    texts = spark.createDataFrame([(9, "The KC 46A Tanker buy"), (8, "a kc-46 plan")], "t int, s2 string")
    assert rows(matching.contained_in(keys, texts, "k", "t", "s", "s2").select("k", "t")) == [(1, 9), (2, 9)]
    terms = spark.createDataFrame([(7, "ALPHA", "title"), (7, "BRAVO", "title"), (5, "0601153N", "code")], "p int, term string, kind string")
    filings = spark.createDataFrame([("f1", "alpha only"), ("f2", "bravo and alpha!"), ("f3", "pe 0601153n")], "f string, d string")
    assert rows(matching.mentions(filings, terms, "f", "d", "p").select("f", "p", "evidence")) == [("f2", 7, "multi_token"), ("f3", 5, "pe_literal")]
    one = spark.range(1)
    assert one.select(matching.money_mentions(F.lit("was awarded a $12,345,678 contract and $1.5 billion, $20 million more"))).first()[0] == [12345678, 1500000000, 20000000]
    guard = lambda a, b: one.select(matching.array_guard(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>"))).first()[0]
    assert (guard([], ["a"]), guard(["a"], []), guard(["a"], ["a"]), guard(["a"], ["b"])) == (True, False, True, False)


def test_components_and_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (7, 7), (200, 200), (None, 3)], "src bigint, dst bigint")
    got = dict(rows(graph.connected_components(edges)))
    assert all(got[k] == 1 for k in range(1, 41)) and got[101] == 100 and got[200] == 200 and len(got) == 43
    assert graph.connected_components(edges.limit(0)).count() == 0
    line = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("x", "z"), ("m", "n"), ("n", "m")], "src string, dst string")
    assert rows(chains.one_to_one_chains(line)) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2), ("d", "a", 3)]
    timed = spark.createDataFrame([("a", "b", 2020), ("b", "a", 2021), ("c", "d", 2020)], "s string, t string, y int")
    assert rows(chains.drop_mirrored(timed, "s", "t", "y")) == [("b", "a", 2021), ("c", "d", 2020)]


def test_ledger(spark):
    facts = spark.createDataFrame([("f1", 10.0), ("f2", 4.0)], "fact_id string, value double")
    derived = spark.createDataFrame([("d1", "sum", ["f1", "f2"], 14.0), ("d2", "difference", ["f1", "f2"], 6.0), ("d3", "sum", ["f1", "f9"], 10.0), ("d4", "sum", [], 0.0), ("d5", "sum", ["f1"], 9.0)], "fact_id string, operation string, inputs array<string>, value double")
    assert {r.fact_id: r.verdict for r in ledger.verify_derived(derived, facts).collect()} == {"d1": "ok", "d2": "ok", "d3": "unresolved_input", "d4": "no_inputs", "d5": "mismatch"}
    details = spark.createDataFrame([("a", 5), ("b", 0), ("c", 3)], "k string, v int")
    controls = spark.createDataFrame([("a", "x", 1, 9), ("a", "y", 2, 5)], "k string, candidate string, priority int, control int")
    assert {r.k: (r.matched, r.candidate) for r in ledger.reconcile_candidates(details, controls, ["k"], "v", F.lit(0)).collect()} == {"a": (True, "y"), "b": (True, None), "c": (False, None)}
    standing = spark.createDataFrame([("d1", 1, False), ("d2", 2, False)], "doc string, v int, superseded boolean")
    batch = spark.createDataFrame([("d1", 3)], "doc string, v int")
    assert rows(ledger.supersede(standing, batch, "doc")) == [("d1", 1, True), ("d1", 3, False), ("d2", 2, False)]
    docs = spark.createDataFrame([(1, "h", "b"), (2, "h", "a"), (3, None, "c")], "id int, hash string, title string")
    assert {r.id: r.superseded for r in ledger.collapse_duplicates(docs, ["hash"], "title", "id").collect()} == {1: True, 2: False, 3: False}
    with pytest.raises(ValueError):
        ledger.guarded_delete(docs, F.col("id") < 3, docs.where("id = 1"), "id")
    assert ledger.guarded_delete(docs, F.col("id") < 3, docs, "id").count() == 1
    with pytest.raises(ValueError):
        ledger.guard_overwrite(100, 50, 0, 10)
    both = picks.upsert(spark.createDataFrame([("k", "m1", 1), ("q", "m2", 2)], "k string, method string, v int"), spark.createDataFrame([("k", "m2", 9), ("q", "m2", 8)], "k string, method string, v int"), ["k"], F.when(F.col("method") == "m1", 0).otherwise(1))
    assert rows(both) == [("k", "m1", 1), ("q", "m2", 8)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,amount\n1,"1,5"\n2,\n')
    tables.csv_to_partition(spark, str(tmp_path / "a.csv"), str(tmp_path / "lake"), 2024, ["id", "amount"])
    tables.csv_to_partition(spark, str(tmp_path / "a.csv"), str(tmp_path / "lake"), 2025, ["id"])
    lake = tables.read_lake(spark, str(tmp_path / "lake"))
    assert lake.where("fy = 2024").count() == 2 and lake.count() == 4 and dict(lake.dtypes)["amount"] == "string"
    with pytest.raises(ValueError):
        tables.csv_to_partition(spark, str(tmp_path / "a.csv"), str(tmp_path / "lake"), 2026, ["missing"])
    wide = spark.createDataFrame([("x", "1,000", "n/a")], ["id", "FY 2024 Total", "FY 2025 Total"])
    assert rows(tables.melt(wide, ["id"])) == [("x", "fy_2024_total", 1000.0)]
    (tmp_path / "seed.csv").write_text("key,kind\na,x\na,y\n")
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("kind", T.StringType())])
    with pytest.raises(ValueError):
        tables.read_seed(spark, str(tmp_path / "seed.csv"), schema, keys=["key"])
    assert tables.read_seed(spark, str(tmp_path / "seed.csv"), schema, keys=["key", "kind"], vocabulary={"kind": ["x", "y"]}).count() == 2
    pages = spark.createDataFrame([(1, "<p>A &amp; B<br><p>c</p>")], "k int, html string")
    assert [r.text for r in html.paragraphs(pages, "k", "html").orderBy("pos").collect()] == ["A & B", "c"]


def test_ingest_takes_each_file_once(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "one.csv").write_text("id,fy\n1,2024\n,2024\n")
    schema = tables.text_schema("id", "fy")
    run = lambda: ingest_new_files(spark, str(landing), str(tmp_path / "out"), str(tmp_path / "ck"), schema, ["id"])
    run()
    (landing / "two.csv").write_text("id,fy\n2,2025\n")
    run()
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out/data")).collect()) == ["1", "2"]
    assert spark.read.parquet(str(tmp_path / "out/_rejected")).count() == 1


def test_assertions(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (2, "b", None)], "k int, s string, v int")
    assert rows(DQ.not_unique(df, ["k", "s"])) == [(1, "a", 2)]
    assert DQ.is_null(df, ["v"]).count() == 1 and rows(DQ.not_accepted(df, "s", ["a"])) == [("b", 1)]
    assert rows(DQ.breaks(df, F.col("v") > 5).select("k")) == [(1,), (2,)]
    pins = spark.createDataFrame([(2, 7), (3, 1)], "k int, v int")
    assert DQ.differs_from_pins(df.where("k = 2"), pins, ["k"], "v").count() == 2
    assert rows(DQ.symmetric_difference(df.select("k"), df.select("k").distinct())) == [(1, "left")]


def test_names_of_ten_words_are_contained(spark):
    name = "one two three four five six seven eight nine ten"
    short = spark.createDataFrame([(1, name), (2, "four five")], "k int, s string")
    long = spark.createDataFrame([(9, f"before {name} after"), (8, name[:-4])], "t int, s2 string")
    assert sorted(map(tuple, matching.contained_in(short, long, "k", "t", "s", "s2").collect())) == [(1, 9, 10), (2, 8, 2), (2, 9, 2)]
    assert matching.contained_in(short.limit(0), long, "k", "t", "s", "s2").count() == 0
    none = spark.createDataFrame([], "lda_client_name string, raw_name string, family_key string")
    clients, families = spark.createDataFrame([(f"Old {name}",)], "client_name string"), spark.createDataFrame([(name.upper(),)], "family_key string")
    assert [r.tier for r in links.match_clients(clients, families, none, none).collect()] == ["normalized"]
