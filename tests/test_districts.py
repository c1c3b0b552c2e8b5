"""Linked money by district: what is counted, and what its plan sorts."""

from itertools import product

from tallyspark.plans import marts
from tests.test_copies import rows_of_plan

TX = "transaction_key string, award_id_piid string, recipient_uei {}, pop_state string, pop_district string, obligation bigint"
LINKS = "award_piid string, pe_bli string, program_title string, organization string, confidence string"
COLUMNS = ["program_title", "organization", "transaction_count", "award_count", "recipient_count", "total_obligation"]


def test_district_programs_count_each_once(spark):
    tx = [
        ("1", "A", "r1", "S", "D", 5), ("1", "A", "r1", "S", "D", 7), ("1", "B", "r2", "S", "D", 11), ("2", "A", None, "S", "D", None), (None, "A", "r2", "S", "D", 13),
        ("3", "A", "r1", "S", "E", 17), ("3", "B", "r1", None, "D", 19), ("4", "B", "A", "S", "D", 23), ("5", "A", "r1", "S", None, 29), ("6", "C", "r9", "S", "D", 31),
        ("7", None, "r1", "S", "D", 37), ("8", "D", None, "S", "F", None), (None, "E", None, "S", "G", 41),
    ]
    links = [
        ("A", "p", "zeta", "o2", "high"), ("A", "p", "beta", "o3", "high"), ("A", "q", None, "o1", "high"), ("B", "p", "delta", "o1", "high"), ("B", "p", "delta", "o1", "high"), ("B", None, "x", None, "high"),
        ("C", "p", "alpha", "o0", "low"), ("D", "q", "t", "o", "high"), ("E", "q", None, None, "high"), (None, "q", "a", "a", "high"), ("Z", "q", "a", "a", "high"),
    ]
    found = marts.district_programs(spark.createDataFrame(tx, TX.format("string")), spark.createDataFrame(links, LINKS))
    pairs = {(a, pe) for a, pe, _, _, tier in links if tier == "high" and a}
    joined = [((t[3], t[4], pe), t) for t, (a, pe) in product(tx, pairs) if t[1] == a and t[4]]
    want = {}
    for grain in {g for g, _ in joined}:
        rows = [t for g, t in joined if g == grain]
        named = [x for x in links if x[4] == "high" and x[1] == grain[2] and x[0] in {t[1] for t in rows}]
        least = lambda k: min((x[k] for x in named if x[k] is not None), default=None)
        money = [t[5] for t in rows if t[5] is not None]
        want[grain] = (least(2), least(3), *(len({t[k] for t in rows} - {None}) for k in range(3)), sum(money) if money else None)
    got = [((r.pop_state, r.pop_district, r.pe_bli), tuple(r[c] for c in COLUMNS)) for r in found.collect()]
    assert len(got) == len(want) and dict(got) == want
    assert want["S", "D", "p"] == ("beta", "o1", 3, 2, 3, 59)  # transaction 1 belongs to two awards
    assert dict(found.dtypes)["transaction_count"] == dict(found.dtypes)["total_obligation"] == "bigint"


def test_district_programs_take_keys_of_any_type(spark):
    tx = spark.createDataFrame([("x-1", "A", 7, "S", "D", 1), ("x-2", "A", 7, "S", "D", 1)], TX.format("bigint"))
    found = marts.district_programs(tx, spark.createDataFrame([("A", "p", "t", "o", "high")], LINKS)).first()
    assert tuple(found[c] for c in COLUMNS) == ("t", "o", 2, 1, 1, 2)


def test_district_programs_sort_no_transactions(spark):
    tx = spark.createDataFrame([(f"t{k}", f"A{k % 10}", f"r{k % 900}", "S", f"D{k % 3}", k) for k in range(3000)], TX.format("string"))
    links = spark.createDataFrame([(f"A{k % 10}", f"p{k % 4}", f"title {k % 4}", "o", "high") for k in range(20)], LINKS)
    found = marts.district_programs(tx, links)
    joined = sum(r.transaction_count for r in found.collect())
    assert joined == 6000
    assert rows_of_plan(found, "SortAggregate") < 3000  # links and results only; transactions are hashed
    assert rows_of_plan(found, "Expand") == 3 * joined
