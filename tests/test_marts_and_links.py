"""Marts, succession and links on micro tables with a planted trap each."""

from pyspark.sql import functions as F

from tallyspark.operators import links, succession
from tallyspark.plans import marts

LINES = "exhibit string, fiscal_year int, account string, account_title string, organization string, budget_activity string, budget_activity_title string, pe_bli string, title string, amount_type string, amount_thousands double, source_document_id int"
SLOTS = ["fy_2024_actuals", "fy_2025_total", "fy_2026_total"]


def line(pe, slot, amount, *, account="A1", org="A", edition=2026, title="t", doc=1, exhibit="R-1"):
    return (exhibit, edition, account, f"title {account}", org, "02", None, pe, title, slot, float(amount), doc)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_trajectory_splits_filters_and_relabels(spark):
    data = [
        line("split", SLOTS[2], 5), line("split", SLOTS[2], 7, account="A2"), line("split", SLOTS[1], 4),
        line("old", SLOTS[0], 1), line("old", SLOTS[0], 9, account="A2"), line("old", SLOTS[2], 3, account="A2"),
        line("moved", SLOTS[1], 2), line("moved", SLOTS[2], 8, account="A2"),
        line("rollup", SLOTS[2], 99, title=None),
    ]
    got = {(r.pe_bli, r.account): (r[SLOTS[0]], r[SLOTS[1]], r[SLOTS[2]], r.pct_change) for r in marts.budget_trajectory(spark.createDataFrame(data, LINES), SLOTS).collect()}
    assert got == {("split", "A1"): (None, 4.0, 5.0, 25.0), ("split", "A2"): (None, None, 7.0, None), ("old", "A2"): (9.0, None, 3.0, None), ("moved", "A2"): (None, 2.0, 8.0, 300.0)}
    preferred = spark.createDataFrame([("moved", "A1")], "pe_bli string, account string")
    assert ("moved", "A1") in {(r.pe_bli, r.account) for r in marts.budget_trajectory(spark.createDataFrame(data, LINES), SLOTS, preferred).collect()}


def test_decade_series_takes_the_first_slug_with_rows_and_withholds_what_the_lake_denies(spark):
    data = [
        line("p", "fy_2025_enacted", 4), line("p", "fy_2025_total", 6), line("p", "fy_2026_request", 5), line("p", "fy_2024_actuals", 1), line("p", "fy_2024_actuals", 2),
        line("denied", "fy_2026_total", 5), line("denied", "fy_2026_total", 70, doc=None), line("9999999999", "fy_2026_total", 1), line("p", "fy_2026_total", 50, exhibit="P-1R", doc=None),
    ]
    documents = spark.createDataFrame([(1, "h")], "id int, sha256 string")
    got = {(r.pe_bli, r.kind): (r.fy, r.amount, r.n_source_rows, r.source_fact_id is not None) for r in marts.decade_series(spark.createDataFrame(data, LINES), documents, 2026).collect()}
    assert got == {("p", "enacted"): (2025, 6.0, 1, True), ("p", "request"): (2026, 5.0, 1, True), ("p", "actuals"): (2024, 3.0, 2, False)}


def test_book_diff_and_matrix(spark):
    series = spark.createDataFrame(
        [("p", 2024, 2024, "request", 10.0, "a", None, None, 1, "f1"), ("p", 2025, 2025, "request", 12.0, "b", None, None, 1, "f2"), ("p", 2024, 2026, "actuals", 7.0, "c", None, None, 1, "f3"), ("1319N-N-L4", 2024, 2024, "request", 1.0, "a", None, None, 1, "f4")],
        "pe_bli string, fy int, edition int, kind string, amount double, amount_type string, account string, organization string, n_source_rows int, source_fact_id string",
    )
    diffs = marts.book_diff(series)
    assert {(r.diff_kind, r.delta) for r in diffs.collect()} == {("request_vs_request", 2.0), ("request_vs_actuals", -3.0)}
    assert [r.pct for r in marts.gap_events(diffs, least=5).collect()] == [-30.0]
    cells = {(r.pe_bli, r.fy): (r.request and r.request.amount, r.actuals and r.actuals.amount) for r in marts.years_matrix(series, ["request", "actuals"]).collect()}
    assert cells[("p", 2024)] == (10.0, 7.0) and cells[("p", 2025)] == (12.0, None)


def narrative(spark, *told):
    return spark.createDataFrame([(pe, year, f"f{k}", body) for k, (pe, year, body) in enumerate(told)], "pe_bli string, fiscal_year int, fact_id string, body string")


def test_stated_edges(spark):
    edges = succession.stated_edges(
        narrative(
            spark,
            ("0601000A", 2026, "Summary: $62.4M was transferred from PE 0602000A. Nothing else"),
            ("0603000A", 2026, "In FY26 efforts in PE 0207436F were transferred to PE 0303004F"),
            ("0604000A", 2026, "This work was transferred to PE 0604000A."),
            ("0605000A", 2026, "Funds were erroneously transferred to PE 0606000A."),
            ("0607000A", 2026, "It moved: realigned to PE 0608000A. The move of 0608000A was rescinded."),
            ("0609000A", 2025, "Previously funded in PE 0610000A."),
            ("0609000A", 2026, "Previously funded in program element 0610000A, as told later."),
            ("0611000A", 2026, "It was transferred to PE 0612000A. Another matter was rescinded."),
        )
    )
    got = {(r.src, r.dst): (r.relation, r.fiscal_year) for r in edges.collect()}
    assert got == {
        ("0602000A", "0601000A"): ("realigned", 2026), ("0207436F", "0303004F"): ("realigned", 2026),
        ("0610000A", "0609000A"): ("renamed", 2026), ("0611000A", "0612000A"): ("realigned", 2026),
    }
    decimal = edges.where("src = '0602000A'").first()
    assert decimal.evidence_sentence == "$62.4M was transferred from PE 0602000A." and len(decimal.edge_fact_id) == 16


def test_superseded_and_inferred_edges(spark):
    told = narrative(spark, ("0601000A", 2024, "It was transferred to PE 0602000A."), ("0603000A", 2024, "It was transferred to PE 0604000A."), ("0605000A", 2024, "It was transferred to PE 0606000A."), ("0602000A", 2025, "It was transferred to PE 0601000A."), ("x", 2026, "The move from 0603000A to 0604000A was made in error."))
    kept = succession.drop_superseded(succession.stated_edges(told), told)
    assert {(r.src, r.dst) for r in kept.collect()} == {("0602000A", "0601000A"), ("0605000A", "0606000A")}
    series = spark.createDataFrame(
        [("0602111A", "Laser Work", 2024, 9.0), ("0602111A", "Laser work", 2025, 4.0), ("0603222A", "LASER-WORK", 2025, 3.0), ("0603222N", "laser work", 2025, 3.0), ("0604333A", "laser work", 2025, 3.0)],
        "pe_bli string, title string, fy int, amount double",
    )
    assert [(r.src, r.dst, r.fiscal_year) for r in succession.inferred_edges(series).collect()] == [("0602111A", "0603222A", 2025)]


def test_client_tiers(spark):
    clients = spark.createDataFrame([("Lockheed Martin Corp",), ("LOCKHEED MARTIN SPACE SYSTEMS",), ("Jamestown BPU",), ("V2X Inc",), ("Old Trading Name",), ("Leonardo Holdings USA",), ("Martin Marietta",)], "client_name string")
    families = spark.createDataFrame([("LOCKHEED MARTIN",), ("BP",), ("VECTRUS",), ("LEONARDO SPA",)], "family_key string")
    aliases = spark.createDataFrame([("V2X, Inc.", "VECTRUS")], "lda_client_name string, family_key string")
    raw = spark.createDataFrame([("Old Trading Name LLC", "BP")], "raw_name string, family_key string")
    assert rows(links.match_clients(clients, families, aliases, raw).select("client_name", "family_key", "tier")) == [
        ("LOCKHEED MARTIN SPACE SYSTEMS", "LOCKHEED MARTIN", "normalized"), ("Leonardo Holdings USA", "LEONARDO SPA", "suffix_residue"),
        ("Lockheed Martin Corp", "LOCKHEED MARTIN", "exact_family"), ("Old Trading Name", "BP", "family_raw_name"), ("V2X Inc", "VECTRUS", "curated_alias"),
    ]


def test_crosswalk_and_reports(spark):
    lines = spark.createDataFrame([(1, "017-1319", "Advanced Radar Antenna Program", "N")], "line_id int, account string, title string, organization string")
    awards = spark.createDataFrame(
        [("a", "017-1319;097-0400", "radar antenna work", "x", 5.0), ("a", "017-1319;097-0400", "radar antenna work", "x", 6.0), ("b", "017-1319", "boots", "Department of the Navy", 1.0), ("c", "017-13199", "radar antenna", "y", 1.0), ("d", "017-1319", "boots", "z", 1.0)],
        "award_piid string, accounts string, description string, sub_agency string, obligation double",
    )
    aliases = spark.createDataFrame([("N", "navy")], "organization string, alias string")
    got = {r.award_piid: (r.confidence, r.matched_obligation) for r in links.crosswalk_awards(lines, awards, aliases).collect()}
    assert got == {"a": ("high", 11.0), "b": ("medium", 1.0), "d": ("low", 1.0)}
    published = marts.budget_to_awards(
        spark.createDataFrame([("a", "p", "account+tokens", "high"), ("b", "p", "account+tokens", "high"), ("c", "p", "pin", "high")], "award_piid string, pe_bli string, method string, confidence string"),
        spark.createDataFrame([("a", "p", "high"), ("c", "p", "reject")], "award_piid string, pe_bli string, adjudicated_confidence string"),
    )
    assert {r.award_piid: r.confidence for r in published.collect()} == {"a": "high", "b": "medium"}
    found = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    verdicts = spark.createDataFrame([(1, "accept"), (2, "reject"), (9, "accept")], "k int, verdict string")
    assert dict(rows(links.verdict_report(found, verdicts, ["k"]))) == {"accepted": 1, "rejected": 1, "stale": 1, "unadjudicated": 1}
    keys = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a"), ("q", None), ("r", "a")], "pe_bli string, account string")
    assert {r.pe_bli: r.resolvable for r in links.split_keys(keys).collect()} == {"p": True, "q": False}


def test_state_per_capita_uses_the_latest_population(spark):
    spend = spark.createDataFrame([("CA", "k12", 2026, 100.0), ("CT", "ed", 2026, 30.0), ("CA", "solo", 2026, 1.0)], "jurisdiction string, category string, fiscal_year int, amount_usd double")
    table = spark.createDataFrame([("CA", "k12", "education"), ("CT", "ed", "education"), ("CA", "solo", "other")], "jurisdiction string, raw_category string, comparable_category string")
    people = spark.createDataFrame([("CA", 2023, 9), ("CA", 2024, 10), ("CT", 2024, 3)], "state string, year int, population int")
    got = {r.jurisdiction: (r.per_capita, r.population_year) for r in marts.state_per_capita(spend, table, people).collect()}
    assert got == {"CA": (10.0, 2024), "CT": (10.0, 2024)}


def test_program_concentration_counts_an_award_once(spark):
    pins = spark.createDataFrame([("a", "p", "high"), ("a", "p", "high"), ("b", "p", "high"), ("c", "p", "medium")], "award_piid string, pe_bli string, confidence string")
    tx = spark.createDataFrame([("a", "u1", 60.0), ("b", "u2", 40.0), ("c", "u3", 99.0)], "award_id_piid string, recipient_uei string, obligation double")
    xwalk = spark.createDataFrame([("u1", "F1")], "recipient_uei string, family_key string")
    got = marts.program_concentration(pins, tx, xwalk).first()
    assert (got.hhi, got.members, got.top_member) == (5200.0, 2, "F1")
    assert marts.program_trajectory(spark.createDataFrame([("p", "A1", "A", 1.0, 2.0), ("p", "A1", "N", 3.0, None)], "pe_bli string, account string, organization string, s1 double, s2 double"), ["s1", "s2"]).where(F.col("s1") == 4.0).count() == 1


def test_dim_programs(spark):
    now, prior = "fy_2026_total", "fy_2024_actuals"
    data = [
        line("plain", now, 5, title="Plain"), line("plain", prior, 1500, title="Plain"), line("plain", now, 9, title="Larger name"),
        line("split", now, 5, account="A1", title="Split one"), line("split", now, 6, account="A2", title="Split two"),
        line("orgs", now, 5, org="A", title="Army side"), line("orgs", now, 6, org="N", title="Navy side"), line("plain", now, 1, edition=2025, title="AAA old"),
    ]
    schema = "pe_bli string, project_number string, project_title string, scenario string, amount_millions double, xml_path string, reconciled boolean, org string, exhibit_family string, fiscal_year int, document_id int, account string"
    detail = lambda pe, project, scenario, amount, ok, org="A", doc=1, account=None, year=2026: (pe, project, "t", scenario, amount, f"/{pe}/{project}/{scenario}", ok, org, "rdte", year, doc, account)
    details = [
        detail("plain", None, "PriorYear", 1.5, True), detail("plain", None, "PriorYear", 1.5, True, doc=2), detail("plain", "p1", "PriorYear", 1.5, True), detail("plain", None, "AllPriorYears", 9.0, False),
        detail("split", "p1", "PriorYear", 2.0, True, account="A1"), detail("orgs", "p1", "PriorYear", 1.0, True, org="A"), detail("orgs", "p2", "PriorYear", 1.0, False, org="N"), detail("orgs", "p3", "PriorYear", 1.0, True, org="X"),
        detail("told", "p1", "PriorYear", 1.0, True), detail("plain", "p9", "PriorYear", 1.0, True, year=2025),
    ]
    narratives = spark.createDataFrame([("told", "Told title", "2026"), ("told", "Zold", "2025")], "pe_bli string, title string, fiscal_year string")
    got = {(r.pe_bli, r.org, r.account): r for r in marts.dim_programs(spark.createDataFrame(data, LINES), spark.createDataFrame(details, schema), narratives, 2026, now, prior).collect()}
    plain = got.pop(("plain", "A", "A1"))
    assert (plain.prior_millions, plain.project_count, plain.fully_reconciled, plain.reconciled_in_scope, plain.title, plain.account_title) == (1.5, 1, False, True, "Larger name", "title A1")
    assert {k: (r.title, r.project_count, r.reconciled_in_scope) for k, r in got.items()} == {
        ("split", "A", None): ("Split two", 1, True), ("split", "A", "A1"): ("Split one", 0, None), ("split", "A", "A2"): ("Split two", 0, None),
        ("orgs", "A", None): ("Army side", 1, True), ("orgs", "N", None): ("Navy side", 1, False), ("told", "A", None): ("Told title", 1, True),
    }
