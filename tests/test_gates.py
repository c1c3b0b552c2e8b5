"""Composite checks on micro tables."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import chains, gates, succession


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_longest_path_steps_park_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "c"), ("m", "n"), ("n", "m"), ("n", "o")], "src string, dst string")
    assert rows(chains.longest_path_steps(edges)) == [("a", 0, False), ("b", 1, False), ("c", 2, False), ("m", 3, True), ("n", 3, True), ("o", 3, True), ("x", 0, False)]
    assert chains.longest_path_steps(edges.limit(0)).count() == 0


def test_share_and_groups(spark):
    df = spark.createDataFrame([(1, 10), (2, 30), (None, 60)], "k int, w int")
    assert rows(gates.share_gate(df, F.col("k").isNotNull(), 0.5, weight="w"))[0] == (40, 100, 0.4, False)
    assert gates.share_gate(df.limit(0), F.lit(True), 0.0).first().passed is True and gates.share_gate(df.limit(0), F.lit(True), 0.1).first().passed is False
    a = spark.createDataFrame([("x", 100.0), ("y", 10.0), ("z", 1.0)], "d string, v double")
    b = spark.createDataFrame([("x", 100.4), ("y", 11.0)], "d string, v double")
    assert {r.d: r.passed for r in gates.group_reconciliation(a, b, "d", "v").collect()} == {"x": True, "y": False, "z": False}


def test_id_sets_drift_and_answers(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2), ("k", 2)], "kind string, id int")
    b = spark.createDataFrame([("k", 2), ("k", 3)], "kind string, id int")
    assert rows(gates.id_sets_agree(a, b, "kind", "id")) == [("k", 1, 1, 1)]
    old = spark.createDataFrame([("g", None, 1.0, "t"), ("h", "o", 2.0, "t")], "k string, o string, v double, title string")
    assert gates.drift_check(old, old, ["k", "o"], "v", ["title"]).first().passed
    changed = spark.createDataFrame([("g", None, 1.0, None), ("h", "o", 3.0, "t")], "k string, o string, v double, title string")
    got = gates.drift_check(old, changed, ["k", "o"], "v", ["title"]).first()
    assert (got.moved_grains, got.blanks, got.passed) == (1, 1, False)
    want = spark.createDataFrame([("q1", "1.50"), ("q2", "abc"), ("q3", "5"), ("q4", "x")], "question string, value string")
    now = spark.createDataFrame([("q1", "1.5"), ("q2", "abc "), ("q3", "6")], "question string, value string")
    assert [r.question for r in gates.stale_answers(want, now).orderBy("question").collect()] == ["q3", "q4"]


def test_proposals_get_their_first_refusal(spark):
    text = "Work of 0601000A was transferred to PE 0602000A."
    clauses = spark.createDataFrame([("c1", "0603000A", text, ["0601000A", "0602000A"], "Next."), ("c2", "0604000A", "It was erroneously moved to 0605000A.", ["0605000A"], None)], "clause_id string, pe_bli string, clause string, codes array<string>, following string")
    known = spark.createDataFrame([("0601000A",), ("0602000A",), ("0603000A",), ("0604000A",), ("0605000A",)], "pe_bli string")
    stated = spark.createDataFrame([("0602000A", "0601000A")], "src string, dst string")
    data = [
        ("c9", "0601000A", "0602000A", "realigned", "V0-orphan"), ("c1", "0601000A", "0601000A", "realigned", "V7-self-loop"), ("c1", "3010", "0602000A", "realigned", "V3-shape"),
        ("c1", "0609000A", "0602000A", "realigned", "V1-fabricated-endpoint"), ("c1", "0603000A", "0602000A", "realigned", "V2-this-pairing-in-multi-code-clause"),
        ("c1", "0601000A", "0602000A", "eaten", "V4-relation"), ("c2", "0604000A", "0605000A", "realigned", "V5-retracted"), ("c3", "0602000A", "0601000A", "merged", "V7-already-stated"),
        ("c3", "0601000A", "0602000A", "realigned", None), ("c4", "0601000A", "0602000A", "realigned", "V7-duplicate"), ("c5", "0603000A", "0602000A", "split", "V9-contradicts-named-pairs"),
        ("c3", "0603000A", "0606000A", "split", "V1-fabricated-endpoint"), ("c6", "0603000A", "0605000A", "split", "V11-transient"), ("c7", "0603000A", "0604000A", "split", "V10-unconfirmed"),
        ("c7", "0603000A", "0606000A", "split", "V3b-unknown-pe"),
    ]
    texts = {"c3": "0601000A was merged into 0602000A.", "c4": "0601000A was merged into 0602000A.", "c5": "Moved: transferred from PE 0601000A and transferred to PE 0602000A by 0603000A.", "c6": "A one-time move of 0603000A to 0605000A.", "c7": "0603000A, 0604000A and 0606000A were split."}
    more = spark.createDataFrame([(k, "0603000A", v, ["0601000A"], None) for k, v in texts.items()], clauses.schema)
    schema = "clause_id string, src string, dst string, relation string"
    confirmed = spark.createDataFrame([("c7", "0603000A", "0604000A", True), ("c6", "0603000A", "0604000A", False), ("c3", "0601000A", "0602000A", True)], "clause_id string, src string, dst string, agrees boolean")
    found = gates.verify_proposals(spark.createDataFrame([d[:4] for d in data], schema), clauses.unionByName(more), stated, known, confirmed)
    assert {tuple(r)[:4]: r.refusal for r in found.collect()} == {d[:4]: d[4] for d in data}


def test_evidence_and_ratified(spark):
    told = spark.createDataFrame([("0604000A", 2026, "f", "It was transferred to PE 0605000A. Done.")], "pe_bli string, fiscal_year int, fact_id string, body string")
    edges = succession.stated_edges(told)
    assert gates.evidence_breaks(edges, told).count() == 0
    assert gates.evidence_breaks(edges.withColumn("evidence_sentence", F.lit("made up")), told).count() == 1
    assert gates.evidence_breaks(edges.withColumn("dst", F.lit("0699999A")), told).count() == 1
    both = spark.createDataFrame([("0604000A", 2026, "f", "It was transferred from PE 0601000A and transferred to PE 0602000A by 0604000A.")], told.schema)
    pair = succession.stated_edges(both)
    assert [(r.src, r.dst) for r in pair.collect()] == [("0601000A", "0602000A")] and gates.evidence_breaks(pair, both).count() == 0
    for src, dst in (("0602000A", "0601000A"), ("0601000A", "0604000A")):  # both named, but not as the rules read the sentence
        assert gates.evidence_breaks(pair.withColumn("src", F.lit(src)).withColumn("dst", F.lit(dst)), both).count() == 1
    verdicts = spark.createDataFrame([("f", "It was transferred", "y"), ("f", "gone", "y"), ("f", "Done", "n")], "fact_id string, evidence_sentence string, verdict string")
    assert gates.ratified_edges(verdicts, told).count() == 1


def test_maps_hops_manifest_and_bundles(spark):
    areas = spark.createDataFrame([("DoD’s  plan",), ("Other",)], "area_title string")
    curated = spark.createDataFrame([("dod's plan", "097")], "area_title string, agency_code string")
    assert {r.area_title: r.mapped for r in gates.title_map(areas, curated).collect()} == {"DoD’s  plan": True, "Other": False}
    one = spark.createDataFrame([("p",), ("q",)], "k string")
    assert rows(gates.first_failing_hop(one, [("detail", one), ("award", one.where("k = 'p'"))], "k")) == [("p", None), ("q", "award")]
    scopes = spark.createDataFrame([("a", "All of it.")], "dataset string, scope string")
    assert rows(gates.manifest({"a": one, "b": one.limit(1)}, scopes).select("dataset", "n_rows", "documented")) == [("a", 2, True), ("b", 1, False)]
    assert rows(gates.resolution_coverage(spark.createDataFrame([("a", "unique"), ("a", "unique")], "dataset string, resolution string"), spark.createDataFrame([("a",), ("z",)], "dataset string"))) == [("a", "unique", 2), ("z", "uncited", 0)]
    programs = spark.createDataFrame([("p", "t")], "pe_bli string, title string")
    lines = spark.createDataFrame([("p", 2026, "s", 1.0)], "pe_bli string, fiscal_year int, amount_type string, amount_thousands double")
    details = spark.createDataFrame([("p", "1", -9.0, "f1"), ("p", "2", 5.0, "f2"), ("p", "3", 99.0, "gone")], "pe_bli string, project_number string, amount_millions double, fact_id string")
    ledger = spark.createDataFrame([("f1",), ("f2",)], "fact_id string")
    awards = spark.createDataFrame([("p", "w", "high")], "pe_bli string, award_piid string, confidence string")
    document = json.loads(gates.program_bundle(programs, lines, details, ledger, awards, top=1).first().document)
    assert [x["fact_id"] for x in document["projects"]] == ["f1"] and document["awards"][0]["award_piid"] == "w"


def test_pair_tags_sources_and_restamp(spark):
    from tallyspark.operators import links

    pairs = spark.createDataFrame([("a", "p"), ("a", "q"), ("a", "r"), ("b", "p"), ("c", "p"), ("d", "p"), ("e", "p")], "award_piid string, pe_bli string")
    verdicts = spark.createDataFrame([("a", "pinned", ["p", "q"], False), ("b", "pinned", ["p"], True), ("c", "pinned", ["p"], False), ("d", "contradicted", None, None), ("e", "insufficient", None, True)], "award_piid string, verdict string, best_pes array<string>, is_own_agency boolean")
    surviving = spark.createDataFrame([("a", "p")], "award_piid string, pe_bli string")
    got = {(r.award_piid, r.pe_bli): (r.adjudicated_confidence, r.pair_reason) for r in links.pair_tags(pairs, verdicts, surviving).collect()}
    assert got == {
        ("a", "p"): ("high", "pinned-here"), ("a", "q"): ("low", "pin-refuted"), ("a", "r"): ("low", "pinned-elsewhere:p"), ("b", "p"): ("medium", "unpinned-pool"),
        ("c", "p"): ("low", "account-only"), ("d", "p"): ("reject", "contradicted"), ("e", "p"): ("low", "insufficient-evidence"),
    }
    evidence = spark.createDataFrame([("a", "announcement", "u1"), ("a", "subaward", "u0")], "award_piid string, source_kind string, source_url string")
    snapshots = spark.createDataFrame([("u1", "w", "h", "2025-01-02T00:00:00Z")], "source_url string, archived_url string, sha256 string, fetched_at string")
    sources = {r.award_piid: (r.source_url, r.archived_url) for r in links.link_sources(pairs.where("pe_bli = 'p'"), evidence, snapshots).collect()}
    assert sources["a"] == ("u1", "w") and sources["b"] == (None, None)
    stored = spark.createDataFrame([("x", "normalized"), ("y", "normalized")], "k string, tier string")
    rowset, counts = links.restamp(stored, spark.createDataFrame([("x", "exact_family")], "k string, tier string"), ["k"])
    assert rows(rowset) == [("x", "exact_family"), ("y", "none")] and rows(counts) == [("normalized", "exact_family", 1), ("normalized", "none", 1)]


def test_breakdowns_and_payment_rates(spark):
    from tallyspark.operators import ledger, pages

    facts = spark.createDataFrame([("f1", 10.0), ("f2", 4.0)], "fact_id string, value double")
    derived = spark.createDataFrame([("d1", "difference", ["f1", "f2"], 6.0), ("d2", "sum", ["f1", "f2"], 15.0), ("d3", "sum", ["f1", "f9"], 10.0)], "fact_id string, operation string, inputs array<string>, value double")
    assert [(r.fact_id, r.input_id, float(r.amount)) for r in ledger.breakdowns(derived, facts).orderBy("pos").collect()] == [("d1", "f1", 10.0), ("d1", "f2", -4.0)]
    html = '<div class="metrics-summary" data-year="2024"><p>$2,000.5 M</p><p>FY 2024 outlays</p></div><div class="metrics-summary" data-year="2023"><p>none</p></div><h2>FY 2024 improper payment estimates</h2><canvas class="c" data-improper="2.5" data-unknown=""></canvas><h2>FY 2023 estimates</h2><canvas data-improper="9"></canvas>'
    page = spark.createDataFrame([(1, "Program", "Agency", html)], "page_id int, program string, agency string, html string")
    got = [(r.fy, r.rate_pct, r.unknown_rate_pct, r.outlays_usd, r.derived_improper_amount_usd) for r in pages.payment_rates(page).collect()]
    assert got == [(2024, 2.5, None, 2000500000, 50012500.0)]


def test_longest_path_steps_flag_no_path_as_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert rows(chains.longest_path_steps(edges)) == [("a", 0, False), ("b", 1, False), ("c", 2, False)]
