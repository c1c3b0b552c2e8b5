"""Gates pass on clean micro tables and name what a planted fault breaks."""

from tallyspark.operators import succession
from tallyspark.plans import phase_gates as G


def verdicts(spark, found, **more):
    return {r.gate: r.passed for r in G.report(spark, found, **more).collect()}


def test_entity_and_oversight(spark):
    tx = spark.createDataFrame([("u1", 96.0, "CA"), ("u2", 4.0, None)], "recipient_uei string, obligation double, pop_state string")
    xwalk = spark.createDataFrame([("u1", "Boeing Co", "BOEING"), ("u9", "The Boeing Company", "OTHER")], "recipient_uei string, recipient_name string, family_key string")
    golden = spark.createDataFrame([("BOEING",)], "name string")
    assert verdicts(spark, G.entity_gates(tx, xwalk, golden), warnings=("places",)) == {"resolved_money": True, "places": True, "golden_in_one_family": False}
    areas = spark.createDataFrame([(True,), (False,)], "mapped boolean")
    assert verdicts(spark, G.oversight_gates(tx, areas, spark.createDataFrame([(10001.0,)], "hhi double"))) == {"payments_floor": True, "areas_mapped": False, "hhi_range": False}


def test_decade_and_influence(spark):
    series = spark.createDataFrame([("p", 2024, 2026, "actuals", None, None, 1.0, "s", None), ("p", 2020, 2026, "request", None, None, 1.0, "s", None)], "pe_bli string, fy int, edition int, kind string, account string, organization string, amount double, amount_type string, source_fact_id string")
    editions = spark.createDataFrame([(2026,), (2025,)], "edition int")
    assert verdicts(spark, G.decade_gates(series, series.limit(1), editions)) == {"edition_coverage": False, "edition_leakage": False, "grain_unique": True, "recompute": False, "no_line_keys_in_diffs": True}
    money = spark.createDataFrame([("F", 5.0)], "family_key string, lobbying_total_usd double")
    families = spark.createDataFrame([("F", 9.0), ("G", 1.0)], "family_key string, total_obligation double")
    mentions = spark.createDataFrame([("x",)], "filing_uuid string")
    tiers = spark.createDataFrame([("a", "a")], "tier string, tier_now string")
    assert verdicts(spark, G.influence_gates(money, families, mentions, mentions.limit(0), tiers, top=1)) == {"top_families_covered": True, "tier_holds": True, "no_negative": True, "mentions_have_filings": False, "families_known": True}


def test_lineage_partition_is_compared_without_labels(spark):
    told = spark.createDataFrame([("0604000A", 2026, "f", "It was transferred to PE 0605000A. Done.")], "pe_bli string, fiscal_year int, fact_id string, body string")
    edges = succession.stated_edges(told)
    same = spark.createDataFrame([("0604000A", 7), ("0605000A", 7)], "node string, family int")
    assert verdicts(spark, G.lineage_gates(edges, told, same, edges)) == {"evidence_verbatim": True, "family_partition": True, "store_equals_lake": True}
    apart = spark.createDataFrame([("0604000A", 7), ("0605000A", 8)], "node string, family int")
    assert verdicts(spark, G.lineage_gates(edges, told, apart, edges.limit(0))) == {"evidence_verbatim": True, "family_partition": False, "store_equals_lake": False}
    points = spark.createDataFrame([("0604000A", 2025, 3.0), ("0605000A", 2026, 4.0), ("0605000A", 2025, 1.0)], "pe_bli string, fy int, amount double")
    assert sorted(map(tuple, G.chain_sums(edges, points).collect())) == [("0604000A", 2025, 4.0, 2), ("0604000A", 2026, 4.0, 1)]


def test_gaps_roll_down_and_windows(spark):
    lines = spark.createDataFrame([("p", "t"), ("q", "t"), ("z", None), ("9999999999", "t")], "pe_bli string, title string")
    details = spark.createDataFrame([("p", True)], "pe_bli string, reconciled boolean")
    gaps = spark.createDataFrame([("x",)], "pe_bli string")
    assert [r.pe_bli for r in G.reconciliation_gaps(lines, details, gaps)["uncovered"].collect()] == ["q"]
    facts = spark.createDataFrame([(1, "p", "s"), (1, "p", "t"), (1, "q", "s")], "document_id int, pe_bli string, scenario string")
    checks = spark.createDataFrame([(1, "p", "s", True), (1, "p", "s", False), (1, "p", "t", True)], "document_id int, pe_bli string, scenario string, passed boolean")
    assert {(r.pe_bli, r.scenario): r.reconciled for r in G.roll_down(facts, checks).collect()} == {("p", "s"): False, ("p", "t"): True, ("q", "s"): None}
    tx = spark.createDataFrame([("u", 2024, 1.0), ("u", 2025, 2.0)], "recipient_uei string, fiscal_year int, obligation double")
    assert {r.first_fy: r.obligation for r in G.entity_windows(tx, [2024, 2025], 2025).collect()} == {2024: 3.0, 2025: 2.0}
    derived = spark.createDataFrame([("d", "sum", ["f"], 1.0)], "fact_id string, operation string, inputs array<string>, value double")
    assert G.citation_sample(spark.createDataFrame([("f", 1.0)], "fact_id string, value double"), derived, 5).first().verdict == "ok"
    assert G.excluded_coverage(spark.createDataFrame([("p", 9), ("q", 1)], "pe_bli string, amount_thousands int"), spark.createDataFrame([("p",)], "pe_bli string")).first().covered_pct == 90.0


def test_a_fault_in_the_decade_mart_turns_its_recompute_red(spark, monkeypatch):
    from tallyspark.plans import marts

    columns = "pe_bli string, title string, fiscal_year int, exhibit string, account string, organization string, budget_activity string, amount_type string, amount_thousands double, source_document_id int"
    row = lambda code, year, kind, amount, account="1": (code, "t", year, "R-1", account, "D", "02", kind, amount, 1)
    lines = spark.createDataFrame([
        row("p", 2026, "fy_2026_total", 5.0), row("p", 2026, "fy_2026_request", 7.0), row("p", 2025, "fy_2025_total", 4.0), row("p", 2026, "fy_2024_actuals", 3.0),
        row("q", 2026, "fy_2026_total", 1.0), row("q", 2026, "fy_2026_total", 2.0, "2"), row("p", 2027, "fy_2025_actuals", 9.0),
    ], columns)
    documents = spark.createDataFrame([(1, "h")], "id int, sha256 string")
    good = verdicts(spark, G.decade_gates_from_lake(marts.decade_series(lines, documents, 2026), lines, 2026))
    assert good["recompute"] and good["diff_recompute"] and good["grain_unique"]
    turned = {key: slugs[::-1] for key, slugs in marts.SCENARIOS.items()}  # the last candidate first
    monkeypatch.setattr(marts, "SCENARIOS", turned)
    bad = verdicts(spark, G.decade_gates_from_lake(marts.decade_series(lines, documents, 2026), lines, 2026))
    assert not bad["recompute"] and not bad["diff_recompute"]


def test_badges(spark):
    rows = [("a", "PriorYear", True), ("a", "AllPriorYears", False), ("b", "PriorYear", False), ("c", "AllPriorYears", True), ("d", "PriorYear", None), ("e", "PriorYear", True), ("e", "PriorYear", None)]
    details = spark.createDataFrame(rows, "pe_bli string, scenario string, reconciled boolean")
    got = {r.pe_bli: r.badge for r in G.badges(details, ["PriorYear"]).collect()}
    assert got == {"a": "reconciled", "b": "partial", "d": "partial", "e": "reconciled"}
