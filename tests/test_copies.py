"""Questions and texts that repeat: one question, one place, and results as without copies."""

from tallyspark.operators import links, matching, pages


def rows_of_plan(df, node):
    """Output rows that the executed nodes of this name made in all."""
    df.collect()
    made, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
            continue
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(plan.plan())
        if node in plan.nodeName() and plan.metrics().contains("numOutputRows"):
            made += plan.metrics().apply("numOutputRows").value()
        children = plan.children()
        todo += [children.apply(k) for k in range(children.size())]
    return made


def test_fact_pages_ask_alike_facts_once(spark):
    facts = spark.createDataFrame([(f"f{k}", 1, "0601A", None if k % 2 else "7", "R-2", 1234.5) for k in range(60)], "fact_id string, document_id int, pe_bli string, project_number string, exhibit string, amount_millions double")
    page = "Exhibit R-2 of 0601A costs 1,234.500"
    book = spark.createDataFrame([(1, 10 + k, page) for k in range(60)] + [(1, 90, page + " for 7"), (1, 90, page + " for 7"), (2, 5, page), (1, 4, None)], "document_id int, page int, text string")
    found = pages.fact_pages(facts, book)
    got = {(r.fact_id[1:], r.page, r.resolution, r.candidate_pages) for r in found.collect()}
    assert got == {(str(k), 10, "ambiguous_first", 62) if k % 2 else (str(k), 90, "ambiguous_first", 62) for k in range(60)}
    assert rows_of_plan(found, "Join") < 500  # 60 facts by 62 pages are 3,720 pairs


def test_narrative_pages_look_alike_openings_up_once(spark):
    told = spark.createDataFrame([(k, 1, "A1" if k % 2 else None, "The work  goes on in many parts of the yard as it did " + str(k)) for k in range(60)] + [(99, 1, "A1", " ")], "narrative_id int, document_id int, pe_bli string, body string")
    page = "The work goes on in many parts\nof the yard as it did"
    book = spark.createDataFrame([(1, 10 + k, page) for k in range(60)] + [(1, 90, "A1: " + page), (1, 91, "No" + page)], "document_id int, page int, text string")
    found = pages.narrative_pages(told, book)
    got = {(r.narrative_id, r.page, r.resolution, r.candidate_pages) for r in found.collect()}
    assert got == {(k, 90, "unique", 61) if k % 2 else (k, 10, "ambiguous_first", 61) for k in range(60)} | {(99, None, "unresolved", 0)}
    assert rows_of_plan(found, "Join") < 500


def test_token_overlap_compares_alike_rows_once(spark):
    left = spark.createDataFrame([(k, "a", ["x", "y"]) for k in range(60)] + [(90, None, ["x"])], "l int, g string, lw array<string>")
    right = spark.createDataFrame([(k, "a", ["y", "x", "z"]) for k in range(60)] + [(91, "a", None)], "r int, g string, rw array<string>")
    found = matching.token_overlap(left, right, "l", "r", "lw", "rw", ["g"])
    assert sorted((r.l, r.r, r.overlap, r.shared) for r in found.where("r < 90").collect()) == [(i, j, 2, "x y") for i in range(60) for j in range(60)]
    assert found.where("r = 91").count() == 60
    assert rows_of_plan(found, "Join") < 500  # not 3,600


def test_crosswalk_compares_alike_lines_once(spark):
    lines = spark.createDataFrame([(k, "7", "radar upgrade kit", None) for k in range(60)], "line_id int, account string, title string, organization string")
    awards = spark.createDataFrame([(f"A{k}", "7; 8;7", "radar upgrade", "army", k) for k in range(60)], "award_piid string, accounts string, description string, sub_agency string, obligation long")
    aliases = spark.createDataFrame([("N", "navy")], "organization string, alias string")
    found = links.crosswalk_awards(lines, awards, aliases)
    got = sorted((r.line_id, r.matched_obligation, r.score, r.rationale, r.confidence) for r in found.collect())
    assert got == [(i, j, 2, "radar upgrade", "high") for i in range(60) for j in range(60)]
    assert rows_of_plan(found, "Join") < 700


def records_shuffled(df):
    """Records that the executed exchanges wrote in all, each exchange once however often it is read."""
    df.collect()
    written, todo = {}, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
            continue
        if plan.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(plan.plan())
        if plan.nodeName() == "Exchange" and plan.metrics().contains("shuffleRecordsWritten"):
            written[plan.id()] = plan.metrics().apply("shuffleRecordsWritten").value()
        children = plan.children()
        todo += [children.apply(k) for k in range(children.size())]
    return sum(written.values())


def test_pairs_of_unlike_rows_are_not_shuffled(spark):
    lines = spark.createDataFrame([(k, "7", f"radar kit{k:05d}", "N") for k in range(200)], "line_id int, account string, title string, organization string")
    awards = spark.createDataFrame([(f"A{k}", "7;8", f"radar kit{k:05d}", "navy", k) for k in range(200)], "award_piid string, accounts string, description string, sub_agency string, obligation long")
    aliases = spark.createDataFrame([("N", "navy")], "organization string, alias string")
    found = links.crosswalk_awards(lines, awards, aliases)
    assert sorted((r.line_id, r.matched_obligation, r.confidence) for r in found.collect()) == [(i, j, "high" if i == j else "medium") for i in range(200) for j in range(200)]
    assert records_shuffled(found) < 5000  # not 40,000


def test_pairs_of_a_key_in_several_slices_are_whole(spark):
    from pyspark.sql import functions as F

    from tallyspark.operators import joins

    rows = lambda n, member, own: spark.range(n).select(F.lit("a").alias("g"), F.col("id").alias(member), (F.col("id") % 7).alias(own))
    few = lambda keys, member, own: spark.createDataFrame([(g, 1, 1) for g in keys], f"g string, {member} long, {own} long")
    left, right = rows(2500, "l", "x").unionByName(few(["b", "c", None], "l", "x")), rows(1500, "r", "y").unionByName(few(["b", "d", None], "r", "y"))
    cut = {r.g: (r.left_slices, r.right_slices) for r in joins.slices_of_pairs(left, right, ["g"], 64).collect()}
    assert cut == {"a": (3, 2), "b": (1, 1)}
    pairs = joins.pairs_of_alike(left, right, ["g"], "l", "r", {"z": F.col("x") * 10 + F.col("y")})
    told = pairs.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("l") * F.col("r")).alias("s"), F.count(F.when(F.col("z") != F.col("l") % 7 * 10 + F.col("r") % 7, 1)).alias("wrong"))
    assert {tuple(r) for r in told.collect()} == {("a", 2500 * 1500, sum(range(2500)) * sum(range(1500)), 0), ("b", 1, 1, 0)}


def test_pairs_are_written_out_in_pieces(spark):
    from pyspark.sql import functions as F

    from tallyspark.operators import joins

    side = lambda member, own: spark.range(200).select(F.lit("a").alias("g"), F.col("id").alias(member), F.lit(1).alias(own)).unionByName(spark.createDataFrame([("a", None, 2)], f"g string, {member} long, {own} int"))
    pairs = joins.pairs_of_alike(side("l", "x"), side("r", "y"), ["g"], "l", "r", {"z": F.col("x") + F.col("y")})
    assert {(r.l, r.r, r.z) for r in pairs.collect()} == {(i, j, 2) for i in range(200) for j in range(200)}
    assert pairs.count() == 40000
    # pieces (one of 16 for each 16 of 200 rights, and one of none), their lefts, the pairs: no row becomes 40,000 rows at once
    assert rows_of_plan(pairs, "Generate") - 40000 > 13 * 200
    cut = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [1, 2]), (3, [])], "k int, m array<int>").select("k", joins.pieces("m", 2).alias("m"))
    assert {r.k: r.m for r in cut.collect()} == {1: [[1, 2], [3, 4], [5]], 2: [[1, 2]], 3: [[]]}


def test_oversight_candidates_match_alike_names_once(spark):
    reports = spark.createDataFrame([(k, "S", "ship x", "Ship X (NEW)") for k in range(60)], "report_id int, service string, name string, full_name string")
    programs = spark.createDataFrame([(f"p{k}", "O", "the ship x program") for k in range(60)] + [("p0", "O", "ship x"), ("q", "P", "ship x")], "slug string, org string, title string")
    services = spark.createDataFrame([("S", "O")], "service string, org string")
    found = matching.oversight_candidates(reports, programs, services)
    assert sorted((r.report_id, int(r.slug[1:]), r.matched_on, r.rule) for r in found.collect()) == [(i, j, "Ship X", "A") for i in range(60) for j in range(60)]
    assert rows_of_plan(found, "Join") < 900


def test_link_rows_are_found_once_for_alike_awards(spark):
    awards = spark.createDataFrame([(f"A{k}", "G", [1, 2] if k % 2 else [2, 1, 2], k) for k in range(60)] + [("B", "G", [9], 70), ("B", "H", [3], 80)], "award_piid string, program_code string, accounts array<int>, obligation long")
    candidates = spark.createDataFrame([(g, f"{g}{k}", "exact") for g in "GH" for k in range(9)], "program_code string, pe_bli string, match_kind string")
    lines = spark.createDataFrame([(f"{g}{k}", "P-1", "N", None, [k]) for g in "GH" for k in range(9)], "pe_bli string, exhibit string, organization string, account string, fed_accounts array<int>")
    found = links.link_rows_for_awards(awards, candidates, lines)
    got = sorted((r.award_piid, r.pe_bli, r.obligation, r.matched_lines, r.confidence) for r in found.collect())
    assert got == sorted([(f"A{k}", f"G{j}", k, 2, "medium") for k in range(60) for j in (1, 2)] + [("B", "H3", 80, 1, "medium")])
    assert rows_of_plan(found, "Join") < 350  # not 540 candidate lines and more


def test_alias_candidates_read_a_title_once(spark):
    titles = spark.createDataFrame([("p1", "red ring")] * 60 + [("p2", "red bolt")], "pe_bli string, title string")
    found = pages.alias_candidates(spark.createDataFrame([("red",), ("ring",)], "alias string"), titles)
    assert sorted((r.alias, r.candidates, r.tier) for r in found.collect()) == [("RED", 2, "ambiguous"), ("RING", 1, "sole")]
    assert rows_of_plan(found, "Generate") < 80


def test_awards_of_an_article_need_no_shuffle(spark):
    html = "<title>Contracts For May 3, 2024</title><p>Firm A, Town (W912AB-24-C-0001) $1<p>NAVY *</p><p>Firm B, Town (W912AB-24-C-0002) $2 million</p><p></p><p>Firm C (N00019-20-D-0003)<p>ARMY.</p><p>none</p>"
    rows = spark.createDataFrame([("a", html), ("b", "<p>ARMY</p>"), ("c", None), ("d", "<p>Firm D, (W912AB-24-C-0004)</p>")], "article_id string, html string")
    found = pages.contract_records(rows, ["NAVY", "ARMY"])
    got = sorted((r.article_id, r.pos, r.service or "", r.contractor, str(r.announced)) for r in found.collect())
    assert got == [("a", 0, "", "Firm A", "2024-05-03"), ("a", 2, "NAVY", "Firm B", "2024-05-03"), ("a", 4, "NAVY", "Firm C (N00019-20-D-0003)", "2024-05-03"), ("d", 0, "", "Firm D", "None")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_rates_of_a_page_need_no_shuffle(spark):
    card = lambda year, amount: f"<div class='card metrics-summary' data-year='{year}'><p>of ${amount} M</p></div>"
    chart = lambda head, rate: f"<div class='usa-card__body'>{head}<canvas data-improper='{rate}'></canvas></div>"
    html = card(2022, 5) + card(2023, 7) + card(2023, 6) + chart("<h2>FY 2023</h2>", 10) + chart("", 50) + chart("<h2>Rates</h2><h2>FY 2022</h2><h2>no year</h2>", 20) + chart("<h2>FY 2021</h2>", 1) + "<h2>FY 2022</h2>" + chart("", 3)
    rows = spark.createDataFrame([(1, "p", "a", html), (2, "p", "a", None), (3, "p", "a", card("soon", 1) + chart("<h2>FY 2022</h2>", 1))], "page_id int, program string, agency string, html string")
    found = pages.payment_rates(rows)
    assert sorted((r.page_id, r.fy, r.rate_pct, r.outlays_usd, r.derived_improper_amount_usd) for r in found.collect()) == [(1, 2022, 20.0, 5e6, 1e6), (1, 2023, 10.0, 7e6, 7e5)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_plain_pages_are_read_as_by_the_parser():
    import random

    from tallyspark.sources import html

    bits = ["<p>", "</p>", "<div class='a' ID=\"b\" hidden>", "</div>", "<b>", "</b>", "<br/>", "a & b &amp;", "<script>x='</p>'</script>", "<STYLE>p{}</style>", "<!-- <p> -->", "<!doctype html>", "<!-->", "<a href=x>", "<", "<li>", "<ul>", "</ul>", "<p a='<'>"]
    dealt, plain = random.Random(5), 0
    for _ in range(2000):
        page = "".join(dealt.choices(bits, k=dealt.randint(0, 8)))
        parsed = html.Reader()
        parsed.feed(page)
        parsed.close()
        told = [(e["node"], e["last"], e["tag"], e["nth"], e["attributes"], " ".join("".join(e["parts"][e["from"] : e["to"]]).split())) for e in parsed.found]
        assert [(e["node"], e["last"], e["tag"], e["nth"], e["attributes"], e["text"]) for e in html.elements_of(page)] == told
        plain += html.Reader().read_plain(page)
    assert plain > 500


def operators_before_exchanges(df, names):
    """How many nodes of these names the plan has below an exchange."""
    below, todo = 0, [(df._jdf.queryExecution().executedPlan(), False)]
    while todo:
        plan, is_below = todo.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            todo.append((plan.inputPlan(), is_below))
            continue
        below += is_below and plan.nodeName() in names
        children = plan.children()
        todo += [(children.apply(k), is_below or "Exchange" in plan.nodeName()) for k in range(children.size())]
    return below


def test_grains_are_dealt_before_they_are_summed(spark):
    from tallyspark.operators import aggregates

    rows = spark.createDataFrame([("p", 1, "a", 5), ("p", 1, "b", 6), ("p", 2, "a", 1), ("q", 1, "a", 7), ("q", 2, "b", 8), ("q", 2, None, 1), (None, 1, "a", 1), (None, 1, "b", 2)], "k string, s int, o string, v long")
    found = aggregates.regrain(rows, ["k"], ["s"], "o", "v")
    got = {tuple(r) for r in found.collect()}
    assert got == {("p", 1, "a", 5, 1), ("p", 1, "b", 6, 1), ("p", 2, "a", 1, 1), ("q", 1, None, 7, 1), ("q", 2, None, 9, 2), (None, 1, None, 3, 2)}
    assert operators_before_exchanges(found, ["HashAggregate"]) == 0


def test_lobbyists_are_dealt_before_repeats_are_dropped(spark):
    from tallyspark.sources import tables

    person = {"lobbyist": {"first_name": "A", "last_name": "B"}, "covered_position": None}
    rows = spark.createDataFrame(
        [(u, 2024, "1", "2", {"name": "r"}, {"name": "k"}, [{"general_issue_code": "X", "description": "d", "government_entities": [{"name": "N"}], "lobbyists": [person, person]}] * 2) for u in ("u1", "u2", "u2", None, None)],
        "filing_uuid string, filing_year int, income string, expenses string, registrant struct<name:string>, client struct<name:string>, lobbying_activities array<struct<general_issue_code:string,description:string,government_entities:array<struct<name:string>>,lobbyists:array<struct<lobbyist:struct<first_name:string,last_name:string>,covered_position:string>>>>",
    )
    found = tables.nested_filings(rows)[2]
    assert sorted(map(str, (r.filing_uuid for r in found.collect()))) == ["None", "u1", "u2"]
    assert operators_before_exchanges(found, ["HashAggregate"]) == 0


def test_clauses_are_cut_and_read_once(spark):
    from tallyspark.operators import succession

    told = spark.createDataFrame([("0000009E", 2024, "f1", "Formerly PE 0000001E. Left as is. Transferred from PE 0000002E to PE 0000003E in 1.5 steps"), ("0000008E", 2024, "f2", None), ("0000007E", 2024, "f3", "")], "pe_bli string, fiscal_year int, fact_id string, body string")
    cut = succession.clauses(told)
    assert [(r.fact_id, r.pos, r.following) for r in cut.orderBy("pos").collect()] == [("f1", 0, " Left as is."), ("f1", 1, " Transferred from PE 0000002E to PE 0000003E in 1.5 steps"), ("f1", 2, None)]
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted((r.src, r.dst, r.relation) for r in succession.stated_edges(told).collect()) == [("0000001E", "0000009E", "renamed"), ("0000002E", "0000009E", "realigned")]


def test_gates_read_a_series_that_was_made_once(spark):
    from tallyspark.plans import marts, phase_gates

    columns = "pe_bli string, title string, fiscal_year int, exhibit string, account string, organization string, budget_activity string, amount_type string, amount_thousands double, source_document_id int"
    lines = spark.createDataFrame([("p", "t", 2026, "R-1", "1", "D", "02", "fy_2026_total", 5.0, 1)], columns)
    series = marts.decade_series(lines, spark.createDataFrame([(1, "h")], "id int, sha256 string"), 2026)
    found = phase_gates.decade_gates_from_lake(series, lines, 2026)
    assert all(found[gate].inputFiles() for gate in ("edition_leakage", "grain_unique", "recompute", "diff_recompute"))
