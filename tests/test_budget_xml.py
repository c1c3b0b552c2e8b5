"""The XML reader on one small book."""

from decimal import Decimal

from tallyspark.sources import budget_xml

BOOK = """<?xml version="1.0"?><Book xmlns:r2="urn:x"><r2:ProgramElementList>
<ProgramElement><ProgramElementNumber>0601000A</ProgramElementNumber><ProgramElementTitle>Radar</ProgramElementTitle><BudgetYear>2026</BudgetYear>
<ProgramElementMissionDescription> Builds radars. </ProgramElementMissionDescription>
<ProgramElementFunding><PriorYear>1.500</PriorYear><CurrentYear>n/a</CurrentYear><BudgetYearOne>0.000</BudgetYearOne></ProgramElementFunding>
<ProjectList><Project><ProjectNumber>AB1</ProjectNumber><ProjectTitle>Antenna</ProjectTitle><ProjectFunding><PriorYear>1.5</PriorYear></ProjectFunding>
<R2aExhibit><ProjectMissionDescription>Makes antennas.</ProjectMissionDescription><AccomplishmentPlannedProgramList>
<AccomplishmentPlannedProgram><Title>Test</Title><Description>It was tested.</Description></AccomplishmentPlannedProgram>
<AccomplishmentPlannedProgram><Title>Blank</Title><Description></Description></AccomplishmentPlannedProgram></AccomplishmentPlannedProgramList></R2aExhibit></Project></ProjectList>
</ProgramElement><ProgramElement><ProgramElementTitle>No number</ProgramElementTitle></ProgramElement></r2:ProgramElementList></Book>"""


def test_book(spark, tmp_path):
    (tmp_path / "book.xml").write_text(BOOK)
    rows = budget_xml.read_programs(spark, str(tmp_path))
    assert [(r.file, r.pe_bli, r.title, r.fiscal_year, r.xml_path) for r in budget_xml.programs(rows).collect()] == [("book.xml", "0601000A", "Radar", 2026, "ProgramElement[0]")]
    got = {(r.project_number, r.scenario): r.amount_millions for r in budget_xml.funding(rows).collect()}
    assert got == {(None, "PriorYear"): Decimal("1.500"), (None, "BudgetYearOne"): Decimal("0.000"), ("AB1", "PriorYear"): Decimal("1.500")}
    told = {(r.kind, r.body, r.xml_path) for r in budget_xml.narratives(rows).collect()}
    assert told == {
        ("mission_description", "Builds radars.", "ProgramElement[0]"), ("project_mission_description", "Makes antennas.", "ProgramElement[0]/Project[0]"),
        ("accomplishment_planned_program", "It was tested.", "ProgramElement[0]/Project[0]/AccomplishmentPlannedProgram[0]"),
    }


def test_places_in_files_read_in_small_pieces(spark, tmp_path):
    """Elements are numbered within their file, those without a number aside, however the files are cut and packed."""
    element = lambda number: f"<r2:ProgramElement><ProgramElementNumber>{number}</ProgramElementNumber></r2:ProgramElement>"
    want = set()
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        for book, n in (("a.xml", 400), ("b.xml", 1), ("c.xml", 0)):
            numbers = [f"{folder}{book[0]}{k}" if k % 5 else "" for k in range(n)] or [""]
            (tmp_path / folder / book).write_text(f"<Book xmlns:r2='urn:x'>{''.join(map(element, numbers))}</Book>")
            want |= {(book, number, f"ProgramElement[{k}]") for k, number in enumerate(filter(None, numbers))}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = budget_xml.read_programs(spark, str(tmp_path / "*")).cache()
        got = budget_xml.programs(rows).select("file", "pe_bli", "xml_path").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
