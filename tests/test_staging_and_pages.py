"""Staging traps and text finders on micro tables."""


from tallyspark.operators import pages
from tallyspark.plans import staging


def test_subaward_flag_is_three_valued(spark):
    data = [("a", "10", "5", "2024-01-01", "", "x", "2024"), ("b", "5", "5", None, "u", "x", "2024"), ("c", "50000000000", None, None, "u", "x", "2024"), ("d", "50000000001", None, None, "u", "x", "2024"), ("e", None, "5", None, "u", "x", "2024"), ("f", "junk", "5", None, "u", "x", "2024")]
    schema = ["prime_award_unique_key", "subaward_amount", "prime_award_amount", "subaward_action_date", "subawardee_uei", "subawardee_name", "fy"]
    got = {r[0]: r.is_amount_suspect for r in staging.subawards(spark.createDataFrame(data, ", ".join(f"{c} string" for c in schema))).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": True, "e": None, "f": None}


def test_award_transactions_unite_by_name(spark):
    shared = {"action_date": "2024-10-01", "fy": "2025", "federal_action_obligation": "-3.5", "recipient_uei": "", "recipient_name": "a", "recipient_parent_uei": "", "recipient_parent_name": "p", "awarding_agency_name": "g", "awarding_sub_agency_name": "s", "prime_award_transaction_place_of_performance_cd_current": "d", "usaspending_permalink": "l"}
    contract = shared | {"contract_transaction_unique_key": "k", "primary_place_of_performance_state_code": "CA", "award_id_piid": "", "contract_award_unique_key": "c", "naics_code": "n", "product_or_service_code": "q"}
    grant = shared | {"assistance_transaction_unique_key": "k2", "primary_place_of_performance_state_name": "California", "assistance_award_unique_key": "c2"}
    frame = lambda row: spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))
    got = {r.transaction_key: r for r in staging.award_transactions(frame(contract), frame(grant)).collect()}
    assert got["k"].obligation == -3.5 and got["k"].recipient_uei is None and got["k"].award_id_piid is None and got["k"].pop_state == "CA"
    assert got["k2"].award_type == "assistance" and got["k2"].naics_code is None and got["k2"].pop_state == "California"


def test_dimensions(spark):
    people = spark.createDataFrame([("Ann", "N/A"), ("Ann", "Chief of Staff"), ("Ann", "N/A"), ("Bob", ""), (None, "x")], "name string, covered_position string")
    assert {r.name: (r.covered_position, r.filings_count, r.revolving_door) for r in staging.dim_lobbyists(people).collect()} == {"Ann": ("Chief of Staff", 3, True), "Bob": ("", 1, False)}
    xwalk = spark.createDataFrame([("F", "u1", "Small", 1.0, "high"), ("F", "u2", "Big", 9.0, "medium")], "family_key string, recipient_uei string, recipient_name string, total_obligation double, confidence string")
    row = staging.dim_entities(xwalk).first()
    assert (row.display_name, row.members, row.worst_confidence) == ("Big", 2, "high")
    paid = spark.createDataFrame([("p", "A", 2023, 9.0, 10.0), ("p", "A", 2024, 1.0, 10.0), ("q", "A", 2022, 3.0, 30.0), ("r", "", 2024, 1.0, 1.0)], "program string, agency_code string, fiscal_year int, derived_improper_amount_usd double, outlays_usd double")
    row = staging.improper_exposure(paid).first()
    assert (row.program_count, row.derived_improper_amount_usd, row.weighted_rate_pct, row.latest_fiscal_year) == (2, 4.0, 10.0, 2024)
    filings = spark.createDataFrame([("F", "2024", "10", "", "exact_family"), ("F", "2024", "x", "5", "normalized"), ("F", "2024", "99", "", "none")], "family_key_guess string, filing_year string, income_usd string, expenses_usd string, match_method string")
    row = staging.influence(filings, staging.dim_entities(xwalk)).first()
    assert (row.filings_count, row.lobbying_income_usd, row.lobbying_expense_usd, row.lobbying_total_usd, row.family_obligations_usd) == (2, 10.0, 5.0, 15.0, 10.0)
    lines = spark.createDataFrame([("p", "Old", 1), ("q", "New source", 2)], "pe_bli string, title string, v int")
    table = spark.createDataFrame([("p", "Old", "Better"), ("q", "Gone", "Never")], "pe_bli string, source_title string, new_title string")
    assert {r.pe_bli: r.title for r in staging.retitle(lines, table).collect()} == {"p": "Better", "q": "New source"}


def test_fact_pages_narrow_but_never_to_none(spark):
    facts = spark.createDataFrame(
        [(1, 1, "0601102A", None, "R-2", 280.494), (2, 1, "0601102A", "AB1", "R-2A", 16.0), (3, 1, "0601102A", None, "R-2", 0.0), (4, 1, "0601102A", None, "R-2", 5.555), (5, 1, "0601102A", None, "P-40", 1234.5)],
        "fact_id int, document_id int, pe_bli string, project_number string, exhibit string, amount_millions double",
    )
    book = spark.createDataFrame(
        [(1, 1, "contents 0601102A 280.494"), (1, 2, "Exhibit R-2 0601102A total 280.494 and 1,234.500"), (1, 3, "Exhibit R-2A 0601102A project AB1 16,000"), (1, 4, "Exhibit R-2A 0601102A project AB2 16.000"), (1, 5, "0601102A 15.555"), (1, 6, "0601102A 1234.500")],
        "document_id int, page int, text string",
    )
    got = {r.fact_id: (r.page, r.resolution, r.candidate_pages) for r in pages.fact_pages(facts, book).collect()}
    assert got == {1: (2, "unique", 2), 2: (3, "unique", 2), 3: (None, "zero_amount", 0), 4: (None, "unresolved", 0), 5: (2, "ambiguous_first", 2)}
    narratives = spark.createDataFrame([(1, 1, "Exhibit  R-2A\n0601102A project AB2 more")], "narrative_id int, document_id int, body string")
    assert [r.page for r in pages.narrative_pages(narratives, book, 5).collect()] == [4]


def test_articles_lexicon_and_aliases(spark):
    html = "<p>ARMY</p><p>Acme Corp., Reston, Virginia, was awarded a $12,345,678 contract (W58RGZ-24-C-0001).</p><p>Nothing.</p><p>NAVY</p><p>Beta LLC, X, gets $1.5 million (N0001924C0002).</p>"
    got = pages.contract_records(spark.createDataFrame([("a", html)], "article_id string, html string"), ["ARMY", "NAVY"]).orderBy("pos").collect()
    assert [(r.service, r.contractor, r.piids, r.amounts) for r in got] == [("ARMY", "Acme Corp.", ["W58RGZ24C0001"], [12345678]), ("NAVY", "Beta LLC", ["N0001924C0002"], [1500000])]
    told = spark.createDataFrame([("p", "F-35 upgrade", "The Next Generation Jammer (NGJ) flies on the EA-18G and the EA-18G.")], "pe_bli string, title string, body string")
    names = {r.key for r in pages.lexicon_candidates(told).collect()}
    assert names == {"f-35 upgrade", "f-35", "ea-18g", "the next generation jammer (ngj)", "ngj"}
    more = told.unionByName(spark.createDataFrame([("q", "Plans and N/A", "No NGJ-12 here."), ("r-L3", "B-21", ""), ("", "B-21", ""), ("s", "B-21", None), ("q", None, None), (None, "B-21", "x")], told.schema))
    programs = spark.createDataFrame([("p",), ("q",), ("q",), ("r-L3",), (None,)], "pe_bli string")  # s is no program; q is two
    found = {(r.pe_bli, r.key): (r.shared, r.ambiguous_key) for r in pages.lexicon_candidates(more, programs).collect()}
    assert found == {("p", k): (False, False) for k in names} | {("q", "ngj-12"): (False, True)}
    titles = spark.createDataFrame([("p", "Joint Strike Fighter"), ("q", "Strike Wing")], "pe_bli string, title string")
    aliases = spark.createDataFrame([("Joint Strike",), ("strike",), ("nope",), ("rike",)], "alias string")
    assert {r.alias: (r.candidates, r.tier) for r in pages.alias_candidates(aliases, titles).collect()} == {"JOINT STRIKE": (1, "sole"), "STRIKE": (2, "ambiguous"), "NOPE": (0, "none"), "RIKE": (2, "ambiguous")}  # anywhere in a title
    assert staging.fy26_split(spark.createDataFrame([("p", "b", 12.0), ("p", "a", 3.0), ("p", "t", 15.0), ("p", "o", 10.0)], "pe_bli string, amount_type string, amount_thousands double"), {"base": "b", "added": "a", "total": "t", "prior": "o"}).select("added_share_pct", "like_for_like_pct").first() == (20.0, 20.0)
