"""Long clauses, names of any length, null times, markup, batch retries and other edges of the spending operators."""

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import aggregates as A
from tallyspark.operators import gates, joins, links, matching, succession
from tallyspark.operators.graph import connected_components
from tallyspark.plans import marts
from tallyspark.sources import html, tables
from tallyspark.streaming.ingest import ingest_new_files, read_ingested


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_clauses_of_any_length(spark):
    far = "word 1.5 " * 6000
    told = spark.createDataFrame([("0601000A", 2026, "f", f"{far}was transferred from PE 0602000B {far}"), ("0601000A", 2026, "g", f"PE 0603000C {far} transferred to PE 0604000D.")], "pe_bli string, fiscal_year int, fact_id string, body string")
    assert succession.clauses(told).count() == 2
    assert rows(succession.stated_edges(told).select("src", "dst")) == [("0602000B", "0601000A"), ("0603000C", "0604000D")]


def test_names_lose_divisions_to_a_fixed_point(spark):
    names = {
        "Acme Global Capital Global Capital": "ACME", "United Global Capital": "UNITED GLOBAL", "United Capital": "UNITED CAPITAL", "Acme Defense Systems": "ACME",
        "The Acme Aerospace Operations I, Inc.": "ACME", "National Global Information Systems": "NATIONAL GLOBAL", "Global": "GLOBAL", "": "", None: "",
    }
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", S.normalized_name(F.col("n")).alias("norm"))
    assert {r.n: r.norm for r in df.collect()} == names


def test_a_null_time_is_never_the_latest(spark):
    left = spark.createDataFrame([("k", 5), ("k", None), ("j", 1)], "k string, t int")
    right = spark.createDataFrame([("k", None, 99), ("k", 6, 1), ("j", 1, 7)], "k string, t int, v int")
    assert rows(joins.as_of_join(left, right, ["k"], "t", "t", ["v"]).select("k", "t", "v")) == [("j", 1, 7), ("k", 5, None), ("k", None, None)]


def test_paragraphs_with_attributes(spark):
    pages = spark.createDataFrame([(1, '<P class="x">One &amp; two<br/><pre>no</pre><p>three<p id=4>four</p>')], "k int, html string")
    assert [r.text for r in html.paragraphs(pages, "k", "html").orderBy("pos").collect()] == ["One & two", "three", "four"]


def test_a_batch_tried_again_adds_nothing(spark, tmp_path):
    landing, out, ck = (tmp_path / n for n in ("landing", "out", "ck"))
    landing.mkdir()
    (landing / "a.csv").write_text("id,fy\n1,2024\n")
    schema = tables.text_schema("id", "fy")
    run = lambda: ingest_new_files(spark, str(landing), str(out), str(ck), schema, ["id"])
    run()
    for commit in (ck / "commits").glob("*0*"):  # the batch was written, and its commit lost
        commit.unlink()
    run()
    assert rows(read_ingested(spark, str(out), schema)) == [("1", "2024")]
    (landing / "b.csv").write_text("other,fy\n2,2024\n")
    with pytest.raises(Exception, match="(?i)header|column"):
        run()


def test_terms_of_several_words_and_signs(spark):
    titles = spark.createDataFrame([("P1", "Ground Midcourse"), ("P2", "Ground Station")], "p string, title string")
    aliases = spark.createDataFrame([("P1", "Joint Strike Fighter"), ("P1", "F-35"), ("P2", "Station"), ("P9", "gone")], "p string, alias string")
    terms = matching.title_terms(titles, "p", "title", aliases=aliases, codes=True)
    assert rows(terms.select("p", "term", "kind")) == [
        ("P1", "F-35", "alias"), ("P1", "GROUND", "title"), ("P1", "JOINT STRIKE FIGHTER", "alias"), ("P1", "MIDCOURSE", "title"), ("P1", "P1", "code"), ("P2", "GROUND", "title"), ("P2", "P2", "code"), ("P2", "STATION", "alias"),
    ]
    texts = [("a", "the joint strike fighter\nand more"), ("b", "XF-35 or F-352"), ("c", "an f-35, yes"), ("d", "ground"), ("d", "midcourse"), ("e", "ground only"), ("f", None), ("g", "a station p1")]
    filings = spark.createDataFrame(texts, "f string, d string")
    found = {(r.f, r.p): (r.evidence, r.matched, r.snippet) for r in matching.mentions(filings, terms, "f", "d", "p").collect()}
    assert found == {
        ("a", "P1"): ("alias", "JOINT STRIKE FIGHTER", "the joint strike fighter and more"), ("c", "P1"): ("alias", "F-35", "an f-35, yes"), ("d", "P1"): ("multi_token", "GROUND|MIDCOURSE", "ground"),
        ("g", "P2"): ("alias", "STATION", "a station p1"), ("g", "P1"): ("pe_literal", "P1", "a station p1"),
    }


def test_oversight_names_both_ways(spark):
    reports = spark.createDataFrame([(1, "Navy", "ship x", "Ship X of many parts (SX)"), (2, "Army", "ship x", "")], "report_id int, service string, name string, full_name string")
    programs = spark.createDataFrame([("s1", "N", "New Ship X Build"), ("s2", "N", "of many parts"), ("s3", "N", "many parts"), ("s4", "A", "SHIP-X")], "slug string, org string, title string")
    services = spark.createDataFrame([("Navy", "N"), ("Army", "A")], "service string, org string")
    assert rows(matching.oversight_candidates(reports, programs, services)) == [(1, "s1", "ship x", "A"), (1, "s2", "Ship X of many parts", "B"), (2, "s4", "ship x", "A")]


def test_river_conserves_money_through_rests(spark):
    leaves = spark.createDataFrame([(f"a{k % 7}", f"b{k % 5}", k) for k in range(1, 60)] + [(None, "b1", 3)], "x string, y string, v bigint")
    nodes, edges = A.top_n_levels(leaves, ["x", "y"], "v", 2, shown=1)
    total = sum(range(1, 60)) + 3
    for level in ("x", "y"):
        assert sum(r.value for r in nodes.where(F.col("level") == level).collect()) == total
        assert sum(r.amount for r in edges.where(F.col("level_to") == level).collect()) == total
    rest = nodes.where("node = 'Other' AND level = 'x'").first()
    assert rest.members == 6 and rest.omitted_value < rest.value and ";" not in rest.listed
    empty_nodes, empty_edges = A.top_n_levels(leaves.limit(0), ["x", "y"], "v", 2)
    assert empty_nodes.count() == 0 and empty_edges.count() == 0


def test_lookups_borrow_no_other_accounts_value(spark):
    table = spark.createDataFrame([("p", "a1", 5), ("q", "a1", 1), ("q", "a2", 2)], "k string, account string, v int")
    asked = spark.createDataFrame([("p", None), ("p", "a9"), ("q", None), ("q", "a2")], "k string, account string")
    assert rows(joins.qualified_lookup(asked, table, ["k"], "account", "v")) == [("p", "a9", None), ("p", None, 5), ("q", "a2", 2), ("q", None, None)]


def test_an_edition_with_two_amounts_is_an_error(spark):
    series = spark.createDataFrame([("p", None, None, 2024, "request", 2024, 5.0, None), ("p", None, None, 2024, "request", 2024, 6.0, None)], "pe_bli string, account string, organization string, fy int, kind string, edition int, amount double, source_fact_id string")
    with pytest.raises(Exception, match="two amounts"):
        marts.years_matrix(series, ["request"]).collect()


def test_reload_swaps_only_what_doesnt_drift(spark, tmp_path):
    out, staging = str(tmp_path / "out"), str(tmp_path / "staging")
    old = spark.createDataFrame([("e1", "g", 1.0, None), ("e2", "h", 2.0, "t")], "edition string, g string, v double, title string")
    old.write.partitionBy("edition").parquet(out)
    again = spark.createDataFrame([("e1", "g", 1.0, "named")], old.schema)
    gates.reload_partition(old.where("edition = 'e1'"), again, out, staging, ["edition"], ["g"], "v", ["title"])
    assert rows(spark.read.parquet(out).select("edition", "title")) == [("e1", "named"), ("e2", "t")]
    with pytest.raises(ValueError, match="drifts"):
        gates.reload_partition(again, again.withColumn("v", F.lit(9.0)), out, staging, ["edition"], ["g"], "v", ["title"])


def test_a_manifest_counts_bytes_and_can_refuse(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "a"))
    read = spark.read.parquet(str(tmp_path / "a"))
    scopes = spark.createDataFrame([("a", "All of it."), ("b", " ")], "dataset string, scope string")
    row = gates.manifest({"a": read}, scopes, strict=True).first()
    assert row.n_rows == 10 and row.bytes == sum(f.stat().st_size for f in (tmp_path / "a").glob("*.parquet"))
    with pytest.raises(ValueError, match="scope"):
        gates.manifest({"a": read, "b": read}, scopes, strict=True)


def test_components_with_hubs_above_and_below(spark):
    edges = [(0, k) for k in range(2, 300)] + [(1000, k) for k in range(400, 700)] + [(700 + k, 701 + k) for k in range(50)] + [(5, 5), (None, 3), (1000, 299)]
    df = spark.createDataFrame(edges, "a int, b int")
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    assert {v for k, v in got.items() if k < 700 or k == 1000} == {0} and {v for k, v in got.items() if 700 <= k < 1000} == {700}


def test_tier_precision_and_catch_alls(spark):
    found = spark.createDataFrame([("A", "p", "high"), ("A", "q", "high"), ("B", "p", "low")], "award_piid string, pe_bli string, confidence string")
    tags = spark.createDataFrame([("A", "p", "high"), ("A", "q", "low"), ("B", "p", "high")], "award_piid string, pe_bli string, adjudicated_confidence string")
    assert rows(links.tier_precision(tags, found)) == [(2, 1, 0.5)]
    titles = spark.createDataFrame([("Items Less Than $5 Million",), ("other support",), ("Brother",), (None,), ("x <$5M",)], "t string")
    assert [r[0] for r in titles.select(matching.is_catch_all(F.col("t"))).collect()] == [True, True, False, False, True]


def test_elements_of_odd_pages():
    read = lambda page, *tags: [e["text"] for e in html.elements_of(page, frozenset(tags))]
    assert read("<p><b>Lockheed</b>Martin Corp., Fort Worth<br>is awarded\n $5,000,000 contract (N00019-24-C-0001).</p>", "p") == ["Lockheed Martin Corp., Fort Worth is awarded $5,000,000 contract (N00019-24-C-0001)."]
    assert read("<p title='a > b </p>'>x<!-- </p><p>no --> y &amp; z&nbsp;!</p>", "p") == ["x y & z !"]
    assert read("<p>a<script>'<p>b</p>'</script>c<style>p{}</style><div>d<p>e</div>f</p>", "p", "div") == ["a c", "d", "e"]
    assert read("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>", "li", "td") == ["a", "b", "c", "d", "e", "f", "g"]
    assert read("<p>a<b>b<p>c</b>d</p></i></p>", "p", "b") == ["a b", "b", "c d"]
    assert read(None, "p") == read("", "p") == read("no tags", "p") == [] and read("<p", "p") == []
    nodes = [(e["tag"], e["node"], e["last"], e["nth"], e["attributes"]) for e in html.elements_of('<div A="1" a=2><p>x<br></p></div><p hidden>')]
    assert nodes == [("div", 0, 2, 0, {"a": "1"}), ("p", 1, 2, 0, {}), ("br", 2, 2, 0, {}), ("p", 3, 3, 1, {"hidden": ""})]


def test_deep_and_long_pages_take_time_by_their_length():
    import time

    began = time.time()
    for page in ("<b>" * 60_000 + "x", "<div>" * 60_000 + "</x>" * 60_000, "<div>" * 60_000 + "x" + "</div>" * 60_000, "<p>word <i>a</i>" * 60_000, "<li>" * 60_000):
        assert html.elements_of(page, frozenset(["p"])) is not None
    assert time.time() - began < 30


def test_records_after_line_breaks_and_roles_by_occurrence(spark):
    from tallyspark.operators import pages

    text = "<p><b>Lockheed</b>Martin Corp., Fort Worth<br>is awarded a $5,000,000 contract (N00019-24-C-0001). It modifies <i>to contract</i> N00019-20-D-0002 and again (N00019-24-C-0001), contract N00019-24-C-0001.</p>"
    rows = spark.createDataFrame([("a", "<p>NAVY<br></p>" + text), ("b", None)], "article_id string, html string")
    (row,) = pages.contract_records(rows, ["NAVY"]).collect()
    assert (row.service, row.contractor, row.amounts) == ("NAVY", "Lockheed Martin Corp.", [5000000])
    assert [(n.piid, n.role) for n in row.numbers] == [("N0001924C0001", "referenced"), ("N0001920D0002", "referenced"), ("N0001924C0001", "award"), ("N0001924C0001", "referenced")]
    assert row.piids == row.referenced == ["N0001924C0001", "N0001920D0002"]


def test_letters_with_an_upper_case_of_several_letters_stay_one(spark):
    texts = spark.createDataFrame([(1, "verschlossene und großzügig"), (2, "GROSSZÜGIG verschlossene"), (3, "die straße, ﬁnal")], "d int, text string")
    titles = spark.createDataFrame([(7, "verschlossene großzügigkeiten")], "item int, title string")
    assert {r.term for r in matching.title_terms(titles, "item", "title", least=3).collect()} == {"VERSCHLOSSENE", "GRO", "GIGKEITEN"}
    terms = spark.createDataFrame([("GROSSZ",), ("VERSCHLOSSENE",), ("straße",), ("NAL",)], "term string")
    assert sorted((r.d, r.term) for r in matching.term_hits(texts, terms, "d", "text").collect()) == [(1, "VERSCHLOSSENE"), (2, "GROSSZ"), (2, "VERSCHLOSSENE"), (3, "NAL"), (3, "straße")]
