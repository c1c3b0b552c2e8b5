"""Queries that run the linking, text, succession, ledger and source functions over inputs made of the provided tables.

The SQL says each rule again by itself, mostly from how the inputs are made and not by the function's own steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.functions.lineage import written
from tallyspark.operators import aggregates as A
from tallyspark.operators import assertions as DQ
from tallyspark.operators import chains, entities, gates, joins, ledger, links, matching, pages, succession
from tallyspark.plans import marts, phase_gates, staging
from tallyspark.plans.driver_tables import _SERIES, BUDGET_LINES, LINES, ORACLE_SQL, _budget_lines, _lines, _query, _series
from tallyspark.plans.spending_queries import AWARD_LINKS, TX, XWALK, _award_links, _text, _tx, _xwalk
from tallyspark.sources import tables

c = F.col


def _code(number: Column) -> Column:
    """A program code of a number."""
    return F.concat(_text(F.lit(1_000_000) + number), F.lit("E"))


def _narratives(t) -> DataFrame:
    """Narratives made of orders: each states, retracts or only mentions a transfer between customers' codes."""
    k, own = c("o_custkey"), _code(c("o_custkey"))
    body = (
        F.when(c("o_orderstatus") == "P", F.concat(F.lit("It was incorrectly said that PE "), _code(k + 1), F.lit(" became PE "), own, F.lit(".")))
        .when(c("o_orderpriority") == "1-URGENT", F.concat(F.lit("Effort transferred from PE "), _code(k + 1), F.lit(" in 1.5 steps. The rest stays")))
        .when(c("o_orderpriority") == "2-HIGH", F.concat(F.lit("Formerly PE "), _code(k + 2), F.lit(".")))
        .when(c("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("Funds realigned to program element "), _code(k + 3), F.lit(": see note. Stated erroneously for "), _code(k + 3), F.lit(".")))
        .when(c("o_orderpriority") == "4-NOT SPECIFIED", F.concat(F.lit("Transferred to PE "), own, F.lit(".")))
        .otherwise("Nothing new. Costs rose 2.5 percent")
    )
    return t("orders").select(own.alias("pe_bli"), F.year("o_orderdate").alias("fiscal_year"), F.concat(F.lit("f"), _text("o_orderkey")).alias("fact_id"), body.alias("body"))


_NARRATIVES = """o AS (SELECT 'f' || o_orderkey AS fact_id, CAST(year(o_orderdate) AS INT) AS fiscal_year, o_orderstatus = 'P' AS taken_back, left(o_orderpriority, 1) AS p, (1000000 + o_custkey) || 'E' AS own,
    (1000001 + o_custkey) || 'E' AS one, (1000002 + o_custkey) || 'E' AS two, (1000003 + o_custkey) || 'E' AS three FROM orders),
  n AS (SELECT *, CASE WHEN taken_back THEN ['It was incorrectly said that PE ' || one || ' became PE ' || own || '.'] WHEN p = '1' THEN ['Effort transferred from PE ' || one || ' in 1.5 steps.', ' The rest stays'] WHEN p = '2' THEN ['Formerly PE ' || two || '.']
    WHEN p = '3' THEN ['Funds realigned to program element ' || three || ':', ' see note.', ' Stated erroneously for ' || three || '.'] WHEN p = '4' THEN ['Transferred to PE ' || own || '.'] ELSE ['Nothing new.', ' Costs rose 2.5 percent'] END AS said FROM o)"""
_EDGES = f"""{_NARRATIVES},
  e AS (SELECT CASE WHEN p = '1' THEN one ELSE two END AS src, own AS dst, fiscal_year, CASE WHEN p = '1' THEN 'realigned' ELSE 'renamed' END AS relation, fact_id, said[1] AS told FROM n WHERE NOT taken_back AND p IN ('1', '2')
    UNION ALL SELECT own, three, fiscal_year, 'realigned', fact_id, said[1] FROM n WHERE NOT taken_back AND p = '3'),
  s AS (SELECT src, dst, fiscal_year, relation, 'stated' AS confidence, fact_id AS evidence_fact_id, told AS evidence_sentence, left(sha256(src || '|' || dst || '|' || fiscal_year || '|' || relation || '|' || told), 16) AS edge_fact_id
    FROM e QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY fiscal_year DESC, fact_id) = 1)"""


@_query(f"WITH {_NARRATIVES} SELECT fact_id, CAST(i - 1 AS INT) AS pos, said[i] AS clause, CASE WHEN i < len(said) THEN said[i + 1] END AS following FROM (SELECT *, unnest(range(1, len(said) + 1)) AS i FROM n)")
def clauses(t):
    """Clauses of every narrative; a point between digits and a colon are told apart."""
    return succession.clauses(_narratives(t)).select("fact_id", "pos", "clause", "following")


@_query(f"WITH {_EDGES} SELECT * FROM s")
def stated_edges(t):
    """Edges that narratives state, as the latest edition tells them; a taken-back colon clause is read with what follows it."""
    return succession.stated_edges(_narratives(t))


@_query(f"""WITH {_EDGES}, r AS (SELECT one AS src, own AS dst, max(fiscal_year) AS later FROM n WHERE taken_back GROUP BY ALL)
  SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM r WHERE least(r.src, r.dst) = least(s.src, s.dst) AND greatest(r.src, r.dst) = greatest(s.src, s.dst) AND later > s.fiscal_year)
    AND NOT EXISTS (SELECT 1 FROM s b WHERE b.src = s.dst AND b.dst = s.src AND b.fiscal_year > s.fiscal_year)""")
def drop_superseded(t):
    """Stated edges that no later edition takes back or turns round."""
    told = _narratives(t)
    return succession.drop_superseded(succession.stated_edges(told), told)


@_query(f"""WITH {_NARRATIVES}, k AS (SELECT own, fiscal_year, fact_id, said[1] AS clause, coalesce(trim(said[2]), '') AS following, CASE p WHEN '1' THEN one WHEN '2' THEN two WHEN '3' THEN three ELSE own END AS code FROM n WHERE NOT taken_back AND p IN ('1', '2', '3', '4'))
  SELECT left(sha256(fact_id || '|' || clause), 16) AS clause_id, own AS pe_bli, fiscal_year, fact_id, clause, following, code AS codes FROM k""")
def clause_candidates(t):
    """Clauses with a verb of change and a code."""
    return succession.clause_candidates(_narratives(t)).withColumn("codes", F.array_join("codes", ","))


@_query(f"""WITH {_NARRATIVES}, k AS (SELECT left(sha256(fact_id || '|' || said[1]), 16) AS clause_id, * FROM n WHERE NOT taken_back AND p IN ('1', '2', '3', '4')),
  known AS (SELECT DISTINCT own AS pe FROM n), q AS (SELECT clause_id, CASE p WHEN '1' THEN one WHEN '2' THEN two ELSE own END AS src, CASE p WHEN '3' THEN three ELSE own END AS dst, CASE WHEN p = '2' THEN 'renamed' ELSE 'realigned' END AS relation, p, said FROM k),
  r AS (SELECT *, CASE WHEN src = dst THEN 'V7-self-loop' WHEN p = '3' AND false THEN '' WHEN src NOT IN (FROM known) OR dst NOT IN (FROM known) THEN 'V3b-unknown-pe' END AS early FROM q),
  f AS (SELECT *, min(CASE WHEN early IS NULL THEN clause_id || relation END) OVER (PARTITION BY src, dst) AS stands FROM r)
  SELECT clause_id, src, dst, relation, coalesce(early, CASE WHEN clause_id || relation > stands THEN 'V7-duplicate' END) AS refusal FROM f""")
def verify_proposals(t):
    """Proposed edges with the first rule that refuses each."""
    told = _narratives(t)
    asked = succession.clause_candidates(told)
    first = F.get("codes", F.lit(0))
    kind = F.substring("clause", 1, 3)
    ends = F.when(kind == "Fun", F.struct(c("pe_bli").alias("src"), first.alias("dst"))).otherwise(F.struct(first.alias("src"), c("pe_bli").alias("dst")))
    proposals = asked.select("clause_id", ends.alias("e"), F.when(kind == "For", "renamed").otherwise("realigned").alias("relation")).select("clause_id", "e.src", "e.dst", "relation")
    nothing = told.select(c("pe_bli").alias("src"), c("pe_bli").alias("dst")).where("false")
    return gates.verify_proposals(proposals, asked, nothing, told.select("pe_bli"))


@_query(f"""WITH {_EDGES}, d AS (SELECT *, CASE WHEN relation = 'renamed' THEN 'made up' ELSE evidence_sentence END AS sentence FROM s) SELECT src, dst, sentence AS evidence_sentence FROM d WHERE relation = 'renamed'""")
def dq_evidence_breaks(t):
    """Edges whose sentence isn't in the narrative it names."""
    told = _narratives(t)
    edges = succession.stated_edges(told).withColumn("evidence_sentence", F.when(c("relation") == "renamed", "made up").otherwise(c("evidence_sentence")))
    return gates.evidence_breaks(edges, told).select("src", "dst", "evidence_sentence")


@_query("""WITH s AS (SELECT '060' || (p_size % 3 + 1) || lpad(CAST(p_partkey % 50 AS VARCHAR), 3, '0') || 'E' AS pe, trim(regexp_replace(lower(p_type || ', ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS t, ship_year AS fy, CAST(sum(cents) AS DOUBLE) AS v FROM LINES JOIN part ON l_partkey = p_partkey GROUP BY ALL),
  r AS (SELECT pe, t, fy, v, CAST(substr(pe, 4, 1) AS INT) AS a FROM s), b AS (SELECT x.pe, x.t, x.a, x.fy + 1 AS fy FROM r x LEFT JOIN r n ON n.pe = x.pe AND n.t = x.t AND n.fy = x.fy + 1 WHERE coalesce(n.v, 0) < x.v)
  SELECT b.pe AS src, d.pe AS dst, min(d.fy) AS fiscal_year, 'matured_ba' AS relation, 'inferred' AS confidence FROM b JOIN r d ON d.t = b.t AND d.a = b.a + 1 AND d.fy = b.fy AND d.v > 0 GROUP BY ALL""".replace("LINES", LINES))
def inferred_edges(t):
    """Maturations: one title a budget activity on, the one's money tapering as the other has some."""
    rows = _lines(t).join(t("part"), c("l_partkey") == c("p_partkey"))
    code = F.concat(F.lit("060"), _text(c("p_size") % 3 + 1), F.lpad(_text(c("p_partkey") % 50), 3, "0"), F.lit("E"))
    series = rows.groupBy(code.alias("pe_bli"), F.concat_ws(", ", "p_type", "p_brand").alias("title"), c("ship_year").alias("fy")).agg(F.sum("cents").cast("double").alias("amount"))
    return succession.inferred_edges(series)


@_query("""WITH s AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_quantity > 40), w AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_quantity <= 40)
  SELECT src, dst, 'stated' AS tier FROM s UNION ALL SELECT src, dst, 'inferred' FROM w WHERE (src, dst) NOT IN (SELECT (src, dst) FROM s)""")
def merge_tiers(t):
    """Strong edges and the weak ones whose pair none has."""
    pairs = lambda condition, tier: t("lineitem").where(condition).select(c("l_partkey").alias("src"), c("l_suppkey").alias("dst"), F.lit(tier).alias("tier")).distinct()
    return chains.merge_tiers(pairs("l_quantity > 40", "stated"), pairs("l_quantity <= 40", "inferred"), ["src", "dst"])


@_query("""WITH RECURSIVE e AS (SELECT DISTINCT 'n' || n_nationkey AS src, 'n' || (n_nationkey + 1 + n_regionkey) AS dst FROM nation UNION SELECT DISTINCT 's' || c_nationkey, 'n' || (c_nationkey % 5) FROM customer),
  p(node, step) AS (SELECT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT dst, step + 1 FROM p JOIN e ON src = node)
  SELECT node, max(step) AS step, false AS cyclic FROM p GROUP BY node""")
def longest_path_steps(t):
    """The longest path to each node of a layered graph."""
    by_nation = t("nation").select(F.concat(F.lit("n"), _text("n_nationkey")).alias("src"), F.concat(F.lit("n"), _text(c("n_nationkey") + 1 + c("n_regionkey"))).alias("dst"))
    by_customer = t("customer").select(F.concat(F.lit("s"), _text("c_nationkey")).alias("src"), F.concat(F.lit("n"), _text(c("c_nationkey") % 5)).alias("dst"))
    return chains.longest_path_steps(by_nation.unionByName(by_customer).distinct())


@_query("""WITH RECURSIVE k AS (SELECT DISTINCT s_suppkey AS src, (s_suppkey * 17 + s_nationkey) % 97 AS dst FROM supplier WHERE s_suppkey <> (s_suppkey * 17 + s_nationkey) % 97),
  nodes AS (SELECT s_suppkey AS node FROM supplier UNION SELECT (s_suppkey * 17 + s_nationkey) % 97 FROM supplier),
  r(a, b) AS (SELECT src, dst FROM k UNION SELECT a, dst FROM r JOIN k ON b = src),
  cycles AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
  held AS (SELECT node FROM cycles UNION SELECT r.b FROM r JOIN cycles ON r.a = node),
  p(node, step) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT dst FROM k) UNION SELECT dst, step + 1 FROM p JOIN k ON src = node WHERE dst NOT IN (SELECT node FROM held)),
  s AS (SELECT node, max(step) AS step FROM p GROUP BY node)
  SELECT CAST(nodes.node AS BIGINT) AS node, CAST(coalesce(s.step, (SELECT coalesce(max(step), -1) + 1 FROM s)) AS INT) AS step, s.step IS NULL AS cyclic, CAST(component AS BIGINT) AS component
  FROM nodes LEFT JOIN s USING (node) LEFT JOIN cycles USING (node)""")
def layers_over_cycles(t):
    """Layers of a graph with cycles: what lies on or behind one is parked, and each cycle is named by its smallest node."""
    edges = t("supplier").select(c("s_suppkey").cast("bigint").alias("src"), ((c("s_suppkey") * 17 + c("s_nationkey")) % 97).cast("bigint").alias("dst"))
    return chains.longest_path_steps(edges).join(chains.cycle_components(edges), "node", "left")


@_query("""WITH RECURSIVE e AS (SELECT n_nationkey AS src, CASE WHEN n_nationkey % 5 = 4 THEN CASE WHEN n_regionkey = 4 THEN n_nationkey - 4 END ELSE n_nationkey + 1 END AS dst FROM nation), k AS (SELECT * FROM e WHERE dst IS NOT NULL AND src <> dst),
  o AS (SELECT * FROM k WHERE src IN (SELECT src FROM k GROUP BY src HAVING count(*) = 1) AND dst IN (SELECT dst FROM k GROUP BY dst HAVING count(*) = 1)),
  u AS (SELECT src AS a, dst AS b FROM o UNION SELECT dst, src FROM o), r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
  g AS (SELECT a AS node, min(least(a, b)) AS low, list(DISTINCT a) || list(DISTINCT b) AS members FROM r GROUP BY a),
  root AS (SELECT node, coalesce((SELECT min(m) FROM (SELECT unnest(g.members) AS m) WHERE m NOT IN (SELECT dst FROM o)), low) AS root FROM g)
  SELECT root, CAST(year(o_orderdate) AS INT) AS fy, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS amount, count(*) AS nodes FROM root JOIN customer ON c_nationkey = node JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def chain_sums(t):
    """Money along chains of nations; one closed ring stands under its smallest nation."""
    last = F.when(c("n_regionkey") == 4, c("n_nationkey") - 4)
    edges = t("nation").select(c("n_nationkey").alias("src"), F.when(c("n_nationkey") % 5 == 4, last).otherwise(c("n_nationkey") + 1).alias("dst")).where("dst IS NOT NULL")
    points = t("orders").join(t("customer"), c("o_custkey") == c("c_custkey")).select(c("c_nationkey").alias("pe_bli"), F.year("o_orderdate").alias("fy"), S.cents(c("o_totalprice")).alias("amount"))
    return phase_gates.chain_sums(edges, points)


# links ----------------------------------------------------------------------------------------------------------


def _claims(t) -> DataFrame:
    tier = c("o_orderkey") % 3
    return t("orders").select(_text("o_custkey").alias("filing"), _text(c("o_orderkey") % 11).alias("family"), tier.alias("tier_rank"), S.cents(c("o_totalprice")).alias("weight"))


@_query("""SELECT CAST(o_custkey AS VARCHAR) AS filing, CAST(o_orderkey % 11 AS VARCHAR) AS family, o_orderkey % 3 AS tier_rank, CAST(round(o_totalprice * 100) AS BIGINT) AS weight FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3, round(o_totalprice * 100) DESC, CAST(o_orderkey % 11 AS VARCHAR)) = 1""")
def best_claim(t):
    """One claim a filing: the strongest tier, then the larger family."""
    return entities.best_claim(_claims(t), "filing", "tier_rank", "weight", "family")


@_query("""WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'exact' ELSE 'loose' END AS tier FROM orders), f AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 2 = 0 THEN 'exact' ELSE 'alias' END AS now FROM orders WHERE o_custkey % 5 <> 0)
  SELECT tier, coalesce(now, 'none') AS tier_now, count(*) AS count FROM s LEFT JOIN f USING (k) GROUP BY ALL""")
def restamp_counts(t):
    """How stored tiers move when the matcher runs again."""
    stored = t("orders").select(c("o_orderkey").alias("k"), F.when(c("o_orderkey") % 3 == 0, "exact").otherwise("loose").alias("tier"))
    fresh = t("orders").where("o_custkey % 5 <> 0").select(c("o_orderkey").alias("k"), F.when(c("o_custkey") % 2 == 0, "exact").otherwise("alias").alias("tier"))
    return links.restamp(stored, fresh, ["k"])[1]


@_query("""WITH l AS (SELECT p_partkey AS line_id, CAST(p_size AS VARCHAR) AS account, p_type || ' ' || p_name AS title, 'O' || (p_size % 5) AS organization FROM part),
  a AS (SELECT 'A' || l_orderkey AS award_piid, (l_linenumber * 7 % 50) || ';' || (l_partkey % 50) AS accounts, max(p_name || ' ' || p_brand) AS description, max('agency ' || (p_size % 5)) AS sub_agency, CAST(sum(cents) AS BIGINT) AS v FROM LINES JOIN part ON p_partkey = l_partkey WHERE l_quantity > 48 GROUP BY ALL),
  x AS (SELECT a.*, unnest(list_distinct(string_split(accounts, ';'))) AS account FROM a),
  w AS (SELECT line_id, award_piid, account, v, list_sort(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda q: length(q) > 3 AND q <> 'small')), list_distinct(list_filter(regexp_split_to_array(lower(description), '[^a-z0-9]+'), lambda q: length(q) > 3 AND q <> 'small')))) AS shared,
      contains(sub_agency, 'agency ' || right(organization, 1)) AS own FROM l JOIN x USING (account))
  SELECT line_id, award_piid, account, v AS matched_obligation, len(shared) AS score, array_to_string(shared, ' ') AS rationale, CASE WHEN len(shared) >= 2 THEN 'high' WHEN own THEN 'medium' ELSE 'low' END AS confidence FROM w""".replace("LINES", LINES))
def crosswalk_awards(t):
    """Budget lines linked to awards through a shared account, with shared words and tiers."""
    lines = t("part").select(c("p_partkey").alias("line_id"), _text("p_size").alias("account"), F.concat_ws(" ", "p_type", "p_name").alias("title"), F.concat(F.lit("O"), _text(c("p_size") % 5)).alias("organization"))
    awards = _lines(t).where("l_quantity > 48").join(t("part"), c("l_partkey") == c("p_partkey")).select(
        F.concat(F.lit("A"), _text("l_orderkey")).alias("award_piid"), F.concat_ws(";", _text(c("l_linenumber") * 7 % 50), _text(c("l_partkey") % 50)).alias("accounts"), F.concat_ws(" ", "p_name", "p_brand").alias("description"),
        F.concat(F.lit("agency "), _text(c("p_size") % 5)).alias("sub_agency"), c("cents").alias("obligation"),
    )
    aliases = t("nation").select(F.concat(F.lit("O"), _text(c("n_nationkey") % 5)).alias("organization"), F.concat(F.lit("Agency "), _text(c("n_nationkey") % 5)).alias("alias")).distinct()
    return links.crosswalk_awards(lines, awards, aliases)


@_query("""WITH p AS (SELECT DISTINCT 'A' || l_orderkey AS award_piid, 'B' || (l_partkey % 7) AS pe_bli FROM lineitem), v AS (SELECT 'A' || o_orderkey AS award_piid, ['pinned', 'contradicted', 'unsure'][o_orderkey % 3 + 1] AS verdict, 'B' || (o_custkey % 7) AS best, o_custkey % 2 = 0 AS own, o_orderkey % 4 <> 0 AS stood FROM orders)
  SELECT award_piid, pe_bli, verdict, CASE WHEN verdict = 'pinned' AND stood THEN CASE WHEN pe_bli = best THEN 'high' ELSE 'low' END WHEN verdict = 'pinned' AND own THEN 'medium' WHEN verdict = 'contradicted' THEN 'reject' ELSE 'low' END AS adjudicated_confidence,
    CASE WHEN verdict = 'pinned' AND stood THEN CASE WHEN pe_bli = best THEN 'pinned-here' ELSE 'pinned-elsewhere:' || best END WHEN verdict = 'pinned' AND own THEN 'unpinned-pool' WHEN verdict = 'pinned' THEN 'account-only' WHEN verdict = 'contradicted' THEN 'contradicted' ELSE 'insufficient-evidence' END AS pair_reason
  FROM p JOIN v USING (award_piid)""")
def pair_tags(t):
    """Award verdicts spread to pairs."""
    award = F.concat(F.lit("A"), _text("o_orderkey"))
    pairs = t("lineitem").select(F.concat(F.lit("A"), _text("l_orderkey")).alias("award_piid"), F.concat(F.lit("B"), _text(c("l_partkey") % 7)).alias("pe_bli")).distinct()
    best = F.concat(F.lit("B"), _text(c("o_custkey") % 7))
    verdict = F.element_at(F.array(F.lit("pinned"), F.lit("contradicted"), F.lit("unsure")), (c("o_orderkey") % 3 + 1).cast("int"))
    verdicts = t("orders").select(award.alias("award_piid"), verdict.alias("verdict"), F.array(best).alias("best_pes"), (c("o_custkey") % 2 == 0).alias("is_own_agency"))
    surviving = t("orders").where("o_orderkey % 4 <> 0").select(award.alias("award_piid"), best.alias("pe_bli"))
    return links.pair_tags(pairs, verdicts, surviving)


@_query("""WITH a AS (SELECT 'A' || o_orderkey AS award_piid, 'G' || (o_custkey % 20) AS program_code, o_custkey % 6 AS a1, o_orderkey % 6 AS a2, CAST(round(o_totalprice * 100) AS BIGINT) AS obligation FROM orders),
  k AS (SELECT DISTINCT 'G' || (p_size % 20) AS program_code, 'L' || (p_partkey % 40) AS pe_bli FROM part), l AS (SELECT DISTINCT 'L' || (p_partkey % 40) AS pe_bli, CASE WHEN p_partkey % 40 < 10 THEN 'acc' || (p_partkey % 3) END AS account, CASE WHEN p_partkey % 40 < 10 THEN p_partkey % 3 ELSE p_partkey % 5 END AS fed FROM part WHERE p_partkey % 40 < 10 OR p_partkey < 41),
  j AS (SELECT *, CAST(fed IN (a1, a2) AS INT) AS hit FROM a JOIN k USING (program_code) JOIN l USING (pe_bli)), n AS (SELECT *, sum(hit) OVER (PARTITION BY award_piid, pe_bli) AS named FROM j),
  r AS (SELECT *, sum(hit) OVER (PARTITION BY award_piid) AS matched, count(*) OVER (PARTITION BY award_piid) AS resolved FROM (SELECT * FROM n WHERE account IS NULL OR (named = 1 AND hit = 1)))
  SELECT award_piid, pe_bli, 'P-1' AS exhibit, 'N' AS organization, account, obligation, CAST(matched AS BIGINT) AS matched_lines, CASE WHEN matched > 0 THEN 'medium' ELSE 'low' END AS confidence,
    'program ' || program_code || '; mapping exact; accounts narrow ' || matched || '/' || resolved || ' lines' || CASE WHEN account IS NULL THEN '' ELSE '; shared key resolved to account ' || account END AS rationale FROM r WHERE hit = 1 OR matched = 0""")
def link_rows_for_awards(t):
    """Links through acquisition programs, narrowed by accounts; shared keys only where one member is named."""
    awards = t("orders").select(
        F.concat(F.lit("A"), _text("o_orderkey")).alias("award_piid"), F.concat(F.lit("G"), _text(c("o_custkey") % 20)).alias("program_code"), F.array(c("o_custkey") % 6, c("o_orderkey") % 6).alias("accounts"), S.cents(c("o_totalprice")).alias("obligation")
    )
    key = F.concat(F.lit("L"), _text(c("p_partkey") % 40))
    candidates = t("part").select(F.concat(F.lit("G"), _text(c("p_size") % 20)).alias("program_code"), key.alias("pe_bli"), F.lit("exact").alias("match_kind")).distinct()
    split = c("p_partkey") % 40 < 10
    lines = t("part").where(split | (c("p_partkey") < 41)).select(
        key.alias("pe_bli"), F.lit("P-1").alias("exhibit"), F.lit("N").alias("organization"), F.when(split, F.concat(F.lit("acc"), _text(c("p_partkey") % 3))).alias("account"),
        F.array(F.when(split, c("p_partkey") % 3).otherwise(c("p_partkey") % 5)).alias("fed_accounts"),
    ).distinct()
    return links.link_rows_for_awards(awards, candidates, lines)


@_query("""WITH l AS (SELECT DISTINCT 'A' || l_orderkey AS award_piid, 'B' || (l_partkey % 7) AS pe_bli FROM lineitem), e AS (SELECT 'A' || o_orderkey AS award_piid, min(('k' || (o_custkey % 3), 'u' || (o_custkey % 50))) AS m FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL),
  x AS (SELECT 'u' || c_custkey % 50 AS source_url, max((CAST('2020-01-01' AS DATE) + CAST(c_custkey % 300 AS INT), 'w' || c_custkey, 'h' || c_custkey)) AS s FROM customer WHERE c_custkey % 50 < 30 GROUP BY ALL)
  SELECT l.award_piid, pe_bli, struct_extract_at(m, 1) AS source_kind, struct_extract_at(m, 2) AS source_url, struct_extract_at(s, 2) AS archived_url, struct_extract_at(s, 3) AS sha256, strftime(struct_extract_at(s, 1), '%Y-%m-%d') AS fetched_on FROM l LEFT JOIN e ON e.award_piid = l.award_piid LEFT JOIN x ON x.source_url = struct_extract_at(m, 2)""")
def link_sources(t):
    """One evidence row a link, with its latest archive."""
    found = t("lineitem").select(F.concat(F.lit("A"), _text("l_orderkey")).alias("award_piid"), F.concat(F.lit("B"), _text(c("l_partkey") % 7)).alias("pe_bli"))
    evidence = t("orders").where("o_orderkey % 3 <> 0").select(F.concat(F.lit("A"), _text("o_orderkey")).alias("award_piid"), F.concat(F.lit("k"), _text(c("o_custkey") % 3)).alias("source_kind"), F.concat(F.lit("u"), _text(c("o_custkey") % 50)).alias("source_url"))
    day = F.date_add(F.lit("2020-01-01").cast("date"), (c("c_custkey") % 300).cast("int"))
    snapshots = t("customer").where("c_custkey % 50 < 30").select(
        F.concat(F.lit("u"), _text(c("c_custkey") % 50)).alias("source_url"), F.concat(F.lit("w"), _text("c_custkey")).alias("archived_url"), F.concat(F.lit("h"), _text("c_custkey")).alias("sha256"), _text(day).alias("fetched_at")
    )
    return links.link_sources(found, evidence, snapshots).withColumn("fetched_on", F.date_format("fetched_at", "yyyy-MM-dd")).drop("fetched_at")


@_query(f"""WITH j AS (SELECT 'A' || o_orderkey AS award_piid, CAST(o_custkey % 3 AS INT) AS sample, o_orderstatus = 'F' AS ok FROM orders), l AS (SELECT award_piid, pe_bli, min(confidence) AS confidence FROM {AWARD_LINKS} GROUP BY ALL), f AS (SELECT award_piid, min(pe_bli) AS pe_bli FROM l GROUP BY award_piid)
  SELECT confidence, count(*) AS judged, count(*) FILTER (ok) AS confirmed, round(count(*) FILTER (ok) / count(*), 4) AS precision FROM j JOIN f USING (award_piid) JOIN l USING (award_piid, pe_bli) WHERE sample = 2 GROUP BY confidence""")
def precision_by_tier(t):
    """Confirmed and judged links of the latest sample by the tier they have today."""
    tiers = _award_links(t).groupBy("award_piid", "pe_bli").agg(F.min("confidence").alias("confidence"))
    first = tiers.groupBy("award_piid").agg(F.min("pe_bli").alias("pe_bli"))
    judged = t("orders").select(F.concat(F.lit("A"), _text("o_orderkey")).alias("award_piid"), (c("o_custkey") % 3).cast("int").alias("sample"), F.when(c("o_orderstatus") == "F", "confirmed").otherwise("refuted").alias("verdict")).join(first, "award_piid")
    return links.precision_by_tier(judged, tiers)


@_query("""SELECT p_partkey, p_size % 4 = 0 OR (p_size % 3 <> 0 AND p_size % 5 = p_size % 2) AS agrees_or_unknown, p_type = 'PROMO' OR p_size = 3 AS catch_all FROM part""")
def link_guards(t):
    """The three-valued account guard and catch-all titles."""
    mine = F.when(c("p_size") % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array((c("p_size") % 5).cast("bigint")))
    theirs = F.when(c("p_size") % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array((c("p_size") % 2).cast("bigint")))
    title = F.when(c("p_type") == "PROMO", F.lit("Items less than $5 million")).when(c("p_size") == 3, F.lit("Other support")).otherwise(F.concat(F.lit("Another "), c("p_type")))
    return t("part").select("p_partkey", F.coalesce(matching.array_guard(mine, theirs), F.lit(False)).alias("agrees_or_unknown"), matching.is_catch_all(title).alias("catch_all"))


# texts ----------------------------------------------------------------------------------------------------------


_TERMS = """(SELECT p_brand AS pe, 'title' AS kind, upper(w) AS term, i AS place FROM (SELECT p_brand, unnest(string_split(title, ' ')) AS w, generate_subscripts(string_split(title, ' '), 1) AS i FROM (SELECT p_brand, min(p_name || ' frobber quuxly') AS title FROM part GROUP BY p_brand)) WHERE length(w) >= 5
  UNION ALL SELECT DISTINCT p_brand, 'code', upper(p_brand), 100 FROM part UNION ALL SELECT DISTINCT p_brand, 'alias', 'JOINT F-' || CAST(substr(p_brand, 7) AS INT) || ' FIGHTER', 101 FROM part)"""


def _mention_terms(t) -> DataFrame:
    titles = t("part").groupBy("p_brand").agg(F.min(F.concat("p_name", F.lit(" frobber quuxly"))).alias("title"))
    aliases = titles.select("p_brand", F.concat(F.lit("Joint F-"), _text(F.substring("p_brand", 7, 9).cast("int")), F.lit(" Fighter")).alias("alias"))
    return matching.title_terms(titles, "p_brand", "title", aliases=aliases, codes=True)


def _mention_texts(t) -> DataFrame:
    """Filings' texts that name programs by code, by an alias of several words, by one title word or by two."""
    brand, number = c("p_brand"), _text(F.substring("p_brand", 7, 9).cast("int"))
    text = (
        F.when(c("l_linenumber") == 1, F.concat(F.lit("about "), F.lower(brand), F.lit(", and more")))
        .when(c("l_linenumber") == 2, F.concat(F.lit("the joint f-"), number, F.lit(" fighter; not XJOINT F-1 FIGHTER")))
        .when(c("l_linenumber") == 3, F.lit("a Quuxly alone")).otherwise(F.lit("the frobber, with a quuxly"))
    )
    rows = t("lineitem").join(t("part"), c("l_partkey") == c("p_partkey")).where("l_orderkey % 40 < 2")
    return rows.select(_text("l_orderkey").alias("filing"), text.alias("description")).distinct()


@_query(f"""WITH t AS {_TERMS}, f AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS filing, l_linenumber AS n, p_brand, CAST(substr(p_brand, 7) AS INT) AS b FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 40 < 2),
  b AS (SELECT DISTINCT p_brand AS pe, CAST(substr(p_brand, 7) AS INT) AS b FROM part), h AS (SELECT DISTINCT filing, pe, 'code' AS kind, upper(pe) AS term FROM f JOIN b ON f.p_brand = b.pe WHERE n = 1
    UNION SELECT filing, pe, 'alias', 'JOINT F-' || b.b || ' FIGHTER' FROM f JOIN b ON b.b = f.b WHERE n = 2 UNION SELECT filing, pe, 'title', 'QUUXLY' FROM f, b WHERE n = 3 OR n > 3 UNION SELECT filing, pe, 'title', 'FROBBER' FROM f, b WHERE n > 3),
  g AS (SELECT filing, pe, bool_or(kind = 'code') AS c, max(term) FILTER (kind = 'alias') AS a, count(DISTINCT term) FILTER (kind = 'title') AS k FROM h GROUP BY ALL)
  SELECT filing, pe AS p_brand, CASE WHEN c THEN 'pe_literal' WHEN a IS NOT NULL THEN 'alias' ELSE 'multi_token' END AS evidence, CASE WHEN c THEN upper(pe) WHEN a IS NOT NULL THEN a ELSE 'FROBBER|QUUXLY' END AS matched FROM g WHERE c OR a IS NOT NULL OR k >= 2""")
def program_mentions(t):
    """Filings that name programs: by code, by an alias of several words, or by two title words that programs share."""
    return matching.mentions(_mention_texts(t), _mention_terms(t), "filing", "description", "p_brand").drop("snippet")


@_query("""WITH f AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS filing, l_linenumber AS n, p_brand, CAST(substr(p_brand, 7) AS INT) AS b FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 40 < 2), b AS (SELECT DISTINCT p_brand AS pe, CAST(substr(p_brand, 7) AS INT) AS b FROM part),
  h AS (SELECT filing, pe, lower(pe) AS term FROM f JOIN b ON f.p_brand = b.pe WHERE n = 1 UNION SELECT filing, pe, 'joint f-' || b.b || ' fighter' FROM f JOIN b ON b.b = f.b WHERE n = 2 UNION SELECT filing, pe, 'quuxly' FROM f, b WHERE n >= 3 UNION SELECT filing, pe, 'frobber' FROM f, b WHERE n > 3)
  SELECT filing, pe AS p_brand, min(term) AS matched_term FROM h GROUP BY ALL""")
def match_articles(t):
    """The alphabetically first term of each program in each item."""
    items = _mention_texts(t).groupBy("filing").agg(F.array_join(F.array_sort(F.collect_set("description")), " . ").alias("text"))  # a filing's few lines
    return matching.match_articles(items, _mention_terms(t), "filing", "text", "p_brand")


@_query("""SELECT p_brand, CASE WHEN l_linenumber = 4 THEN 'hunch' ELSE 'multi_token' END AS evidence, CASE WHEN l_linenumber = 3 THEN 'QUUXLY' ELSE 'FROBBER|FRIGATE' END AS matched, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber IN (3, 4) GROUP BY ALL""")
def dq_weak_evidence(t):
    """Mentions of one stop word or of no accepted kind, which no gate may let through."""
    rows = t("lineitem").join(t("part"), c("l_partkey") == c("p_partkey"))
    matched = F.when(c("l_linenumber") == 3, "QUUXLY").otherwise("FROBBER|FRIGATE")
    marked = rows.select("p_brand", F.when(c("l_linenumber") == 4, "hunch").otherwise("multi_token").alias("evidence"), matched.alias("matched"))
    return DQ.weak_evidence(marked, ["pe_literal", "alias", "multi_token"], ["QUUXLY"]).groupBy("p_brand", "evidence", "matched").agg(F.count("*").alias("n"))


@_query(r"""WITH r AS (SELECT s_suppkey AS report_id, 'S' || (s_nationkey % 4) AS service, CASE WHEN s_suppkey % 2 = 0 THEN lower(p.p_name) ELSE p.p_name || ' program of the future' END AS name, p.p_name || ' (NEW)' AS full_name FROM supplier JOIN part p ON p_partkey = s_suppkey),
  p AS (SELECT 'x' || p_partkey AS slug, 'O' || (p_size % 6) AS org, CASE WHEN p_size % 2 = 0 THEN p_name || ' block 40' ELSE p_name || ' program' END AS title, p_name, p_size FROM part), v AS (SELECT DISTINCT 'S' || (n_nationkey % 4) AS service, 'O' || (n_nationkey % 6) AS org FROM nation),
  j AS (SELECT report_id, slug, CASE WHEN report_id % 2 = 0 AND r.lname = lower(p_name) THEN 'A' WHEN report_id % 2 = 1 AND r.lname = lower(p_name) THEN 'A' END AS rule, p_size, name, full_name FROM (SELECT *, lower(regexp_replace(full_name, ' \(NEW\)$', '')) AS lname FROM r) r JOIN v USING (service) JOIN p USING (org) WHERE contains(' ' || lower(title) || ' ', ' ' || lname || ' '))
  SELECT report_id, slug, CASE WHEN report_id % 2 = 0 THEN least(name, regexp_replace(full_name, ' \(NEW\)$', '')) ELSE regexp_replace(full_name, ' \(NEW\)$', '') END AS matched_on, rule FROM j""")
def oversight_candidates(t):
    """Programs that a report's names may mean, within its service's organisations."""
    joined = t("supplier").join(t("part"), c("s_suppkey") == c("p_partkey"))
    name = F.when(c("s_suppkey") % 2 == 0, F.lower("p_name")).otherwise(F.concat("p_name", F.lit(" program of the future")))
    reports = joined.select(c("s_suppkey").alias("report_id"), F.concat(F.lit("S"), _text(c("s_nationkey") % 4)).alias("service"), name.alias("name"), F.concat("p_name", F.lit(" (NEW)")).alias("full_name"))
    title = F.concat("p_name", F.when(c("p_size") % 2 == 0, " block 40").otherwise(" program"))
    programs = t("part").select(F.concat(F.lit("x"), _text("p_partkey")).alias("slug"), F.concat(F.lit("O"), _text(c("p_size") % 6)).alias("org"), title.alias("title"))
    services = t("nation").select(F.concat(F.lit("S"), _text(c("n_nationkey") % 4)).alias("service"), F.concat(F.lit("O"), _text(c("n_nationkey") % 6)).alias("org")).distinct()
    return matching.oversight_candidates(reports, programs, services)


# ledger and checks ------------------------------------------------------------------------------------------------


def _facts(t) -> DataFrame:
    return _lines(t).groupBy(F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber")).alias("fact_id")).agg(F.sum("cents").alias("value"))


def _derived(t) -> DataFrame:
    """Facts that sum or subtract an order's first lines; every fifth is off by one."""
    sums = _lines(t).where("l_linenumber <= 2").groupBy("l_orderkey").agg(F.sum(F.when(c("l_linenumber") == 1, c("cents"))).alias("a"), F.sum(F.when(c("l_linenumber") == 2, c("cents"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    minus = c("l_orderkey") % 2 == 0
    value = F.when(minus, c("a") - c("b")).otherwise(c("a") + c("b")) + F.when(c("l_orderkey") % 5 == 0, 1).otherwise(0)
    return sums.select(_text("l_orderkey").alias("fact_id"), F.when(minus, "difference").otherwise("sum").alias("operation"), F.array(F.concat(_text("l_orderkey"), F.lit("-1")), F.concat(_text("l_orderkey"), F.lit("-2"))).alias("inputs"), value.alias("value"))


_DERIVED = f"""i AS (SELECT l_orderkey, l_linenumber AS n, CAST(sum(cents) AS BIGINT) AS v FROM {LINES} WHERE l_linenumber <= 2 GROUP BY ALL), d AS (SELECT l_orderkey FROM i GROUP BY l_orderkey HAVING count(*) = 2)"""


@_query(f"""WITH {_DERIVED} SELECT CAST(l_orderkey AS VARCHAR) AS fact_id, CAST(n - 1 AS INT) AS pos, l_orderkey || '-' || n AS input_id, CASE WHEN n = 2 AND l_orderkey % 2 = 0 THEN -v ELSE v END AS amount FROM i JOIN d USING (l_orderkey) WHERE l_orderkey % 5 <> 0""")
def fact_breakdowns(t):
    """Signed inputs of the facts that add up exactly."""
    return ledger.breakdowns(_derived(t), _facts(t)).withColumn("amount", c("amount").cast("bigint"))


@_query("""WITH f AS (SELECT p_brand AS dataset, CASE WHEN p_size % 3 = 0 THEN 'cell' ELSE 'page' END AS resolution FROM part WHERE p_size > 10), d AS (SELECT DISTINCT p_brand AS dataset FROM part UNION SELECT DISTINCT p_type FROM part)
  SELECT d.dataset, coalesce(resolution, 'uncited') AS resolution, count(resolution) AS facts FROM d LEFT JOIN f ON f.dataset = d.dataset GROUP BY ALL""")
def resolution_coverage(t):
    """Facts by dataset and resolution; a dataset without facts is uncited."""
    facts = t("part").where("p_size > 10").select(c("p_brand").alias("dataset"), F.when(c("p_size") % 3 == 0, "cell").otherwise("page").alias("resolution"))
    return gates.resolution_coverage(facts, t("part").select(F.explode(F.array("p_brand", "p_type")).alias("dataset")))


@_query("""WITH c AS (SELECT l_orderkey AS k, CAST(sum(cents) AS BIGINT) AS v FROM LINES GROUP BY ALL) SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS amount, v AS child_sum, abs(round(o_totalprice * 100) - v) <= 5000000 AS matches FROM orders JOIN c ON k = o_orderkey""".replace("LINES", LINES))
def children_match(t):
    """Order totals against their lines' sums."""
    parents = t("orders").select(c("o_orderkey").alias("k"), S.cents(c("o_totalprice")).alias("amount"))
    return ledger.children_match(parents, _lines(t).select(c("l_orderkey").alias("k"), c("cents").alias("amount")), ["k"], "amount", 5_000_000)


@_query("""SELECT o_orderkey, o_custkey AS doc, o_orderstatus = 'P' OR o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS superseded FROM orders
  UNION ALL SELECT -o_orderkey, o_custkey, false FROM orders WHERE o_orderpriority = '1-URGENT'""")
def supersede(t):
    """Standing rows of the documents that a batch brings are flagged and stay."""
    standing = t("orders").select("o_orderkey", c("o_custkey").alias("doc"), (c("o_orderstatus") == "P").alias("superseded"))
    batch = t("orders").where("o_orderpriority = '1-URGENT'").select((-c("o_orderkey")).alias("o_orderkey"), c("o_custkey").alias("doc"))
    return ledger.supersede(standing, batch, "doc")


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' OR o_orderstatus IS NULL")
def guarded_delete(t):
    """A delete whose scope the allow-list covers."""
    rows = t("orders").select("o_orderkey", "o_orderstatus")
    return ledger.guarded_delete(rows, c("o_orderstatus") == "P", rows.where("o_orderstatus = 'P'"), "o_orderkey")


@_query("""WITH a AS (SELECT o_orderpriority AS kind, o_custkey AS id FROM orders WHERE o_orderstatus <> 'P'), b AS (SELECT o_orderpriority AS kind, o_custkey AS id FROM orders WHERE o_orderstatus <> 'F'),
  j AS (SELECT coalesce(a.kind, b.kind) AS kind, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM (SELECT kind, id, count(*) AS n FROM a GROUP BY ALL) a FULL JOIN (SELECT kind, id, count(*) AS m FROM b GROUP BY ALL) b ON a.kind = b.kind AND a.id = b.id)
  SELECT kind, count(*) FILTER (m = 0) AS only_left, count(*) FILTER (n = 0) AS only_right, count(*) FILTER (n > 1 OR m > 1) AS repeated FROM j GROUP BY kind""")
def id_sets_agree(t):
    """Ids that only one of two exports has, by kind."""
    side = lambda condition: t("orders").where(condition).select(c("o_orderpriority").alias("kind"), c("o_custkey").alias("id"))
    return gates.id_sets_agree(side("o_orderstatus <> 'P'"), side("o_orderstatus <> 'F'"), "kind", "id")


@_query("""WITH o AS (SELECT o_custkey % 50 AS g, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS v FROM orders GROUP BY ALL), n AS (SELECT o_custkey % 50 AS g, sum(CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_custkey % 50 < 7 THEN 1 ELSE 0 END) AS v FROM orders GROUP BY ALL)
  SELECT (SELECT count(*) FROM orders) AS old_rows, (SELECT count(*) FROM orders) AS new_rows, count(*) FILTER (o.v IS DISTINCT FROM n.v) AS moved_grains, (SELECT count(*) FROM orders WHERE o_custkey % 11 = 0) AS blanks, false AS passed FROM o FULL JOIN n USING (g)""")
def drift_check(t):
    """What a reload would change."""
    rows = t("orders").select((c("o_custkey") % 50).alias("g"), S.cents(c("o_totalprice")).alias("v"), F.when(c("o_custkey") % 11 != 0, "title").alias("title"))
    return gates.drift_check(rows, rows.withColumn("v", c("v") + (c("g") < 7).cast("int")), ["g"], "v", ["title"])


@_query("""SELECT p_partkey, CASE WHEN p_size <= 20 THEN NULL WHEN p_size % 2 = 0 THEN 'lines' ELSE 'awards' END AS first_failing FROM part""")
def first_failing_hop(t):
    """The first table of a chain that lacks each line."""
    rows = t("part")
    found = rows.where("p_size <= 20 OR p_size % 2 = 1"), rows.where("p_size <= 20 OR p_size % 2 = 0")
    return gates.first_failing_hop(rows, [("lines", found[0]), ("awards", found[1])], "p_partkey")


@_query("""SELECT CAST(o_orderkey AS VARCHAR) AS question, CAST(o_custkey AS VARCHAR) || '.50' AS expected, CASE WHEN o_orderkey % 7 = 0 THEN 'none' ELSE CAST(o_custkey + 1 AS VARCHAR) END AS actual FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 3 = 0""")
def stale_answers(t):
    """Golden answers that differ now; 1.50 and 1.5 are one."""
    key = _text("o_orderkey")
    expected = t("orders").select(key.alias("question"), F.concat(_text("o_custkey"), F.lit(".50")).alias("value"))
    now = F.when(c("o_orderkey") % 7 == 0, "none").when(c("o_orderkey") % 3 == 0, _text(c("o_custkey") + 1)).otherwise(F.concat(_text("o_custkey"), F.lit(".5")))
    return gates.stale_answers(expected, t("orders").select(key.alias("question"), now.alias("value")))


@_query("""SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) + o_orderkey % 3 END AS parent_value FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey % 3 <> 0""")
def dq_values_disagree(t):
    """Rows whose parent is missing or says something else."""
    rows = t("orders").select("o_orderkey", "o_custkey", S.cents(c("o_totalprice")).alias("v"))
    parent = rows.where("o_orderkey % 6 <> 0").select("o_orderkey", (c("v") + c("o_orderkey") % 3).alias("v"))
    return DQ.values_disagree(rows, parent, ["o_orderkey"], "v")


@_query("""WITH d AS (SELECT p_brand, CAST(sum(cents) AS BIGINT) AS v FROM LINES JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT p_brand, CAST(v + 3 AS BIGINT) AS pinned, v FROM d WHERE p_brand > 'Brand#2' UNION ALL SELECT 'gone', 5, NULL""".replace("LINES", LINES))
def dq_pins(t):
    """Pinned totals that the table lacks or holds differently."""
    sums = _lines(t).join(t("part"), c("l_partkey") == c("p_partkey")).groupBy("p_brand").agg(F.sum("cents").alias("v"))
    gone = t("part").sparkSession.createDataFrame([("gone", 5)], "p_brand string, v bigint")
    pins = sums.withColumn("v", c("v") + F.when(c("p_brand") > "Brand#2", 3).otherwise(0)).unionByName(gone)
    return DQ.differs_from_pins(sums, pins, ["p_brand"], "v")


@_query("""WITH a AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 9 <> 0), x AS (SELECT o_custkey, o_orderstatus, 1 AS s FROM a UNION ALL SELECT o_custkey, o_orderstatus, -1 FROM b),
  d AS (SELECT o_custkey, o_orderstatus, sum(s) AS n FROM x GROUP BY ALL HAVING sum(s) <> 0) SELECT o_custkey, o_orderstatus, CASE WHEN n > 0 THEN 'left' ELSE 'right' END AS side, CAST(abs(n) AS BIGINT) AS times FROM d""")
def dq_recompute(t):
    """A mart and its recompute as multisets."""
    side = lambda n: t("orders").where(f"o_orderkey % {n} <> 0").select("o_custkey", "o_orderstatus")
    return DQ.symmetric_difference(side(10), side(9)).groupBy("o_custkey", "o_orderstatus", "side").agg(F.count("*").alias("times"))


@_query(f"""WITH w AS (SELECT * FROM (VALUES (1993, 1998), (1996, 1998)) AS v(first_fy, last_fy)) SELECT recipient_uei, first_fy, last_fy, CAST(sum(obligation) AS BIGINT) AS obligation FROM {TX} JOIN w ON fiscal_year BETWEEN first_fy AND last_fy GROUP BY ALL""")
def entity_windows(t):
    """Entity totals over declared windows of years."""
    return phase_gates.entity_windows(_tx(t), [1993, 1996], 1998)


@_query(f"""WITH a AS (SELECT pe_bli, CAST(sum(amount) AS BIGINT) AS v FROM {BUDGET_LINES} GROUP BY ALL), t AS (SELECT sum(v) AS a, sum(v) FILTER (pe_bli LIKE 'Brand#1%') AS c FROM a)
  SELECT pe_bli, v AS amount_thousands, floor(c * 1000::DOUBLE / a) / 10 AS covered_pct FROM a, t WHERE pe_bli NOT LIKE 'Brand#1%' ORDER BY v DESC, pe_bli LIMIT 10""")
def excluded_coverage(t):
    """The largest programs that a page leaves out."""
    lines = _budget_lines(t)
    return phase_gates.excluded_coverage(lines, lines.where("pe_bli LIKE 'Brand#1%'").select("pe_bli"))


@_query("""WITH p AS (SELECT o_orderkey AS document_id, o_custkey % 20 AS pe_bli, o_orderpriority AS scenario, o_totalprice FROM orders), k AS (SELECT document_id % 500 AS d, pe_bli, scenario, bool_and(o_totalprice > 50000) AS ok FROM p GROUP BY ALL)
  SELECT p.document_id % 500 AS document_id, p.pe_bli, p.scenario, ok AS reconciled, count(*) AS n FROM p LEFT JOIN k ON k.d = p.document_id % 500 AND k.pe_bli = p.pe_bli AND k.scenario = p.scenario GROUP BY ALL""")
def roll_down(t):
    """A detail is reconciled only where no check of its program and scenario failed."""
    details = t("orders").select((c("o_orderkey") % 500).alias("document_id"), (c("o_custkey") % 20).alias("pe_bli"), c("o_orderpriority").alias("scenario"), (c("o_totalprice") > 50000).alias("passed"))
    return phase_gates.roll_down(details.drop("passed").withColumn("reconciled", F.lit(True)), details).groupBy("document_id", "pe_bli", "scenario", "reconciled").agg(F.count("*").alias("n"))


# rivers, lookups, sources -----------------------------------------------------------------------------------------


_RIVER = """s AS (SELECT p_type AS a, p_brand AS b, CAST(sum(cents) AS BIGINT) AS v FROM LINES JOIN part ON l_partkey = p_partkey GROUP BY ALL), l1 AS (SELECT a, sum(v) AS v, row_number() OVER (ORDER BY sum(v) DESC, a) AS rn FROM s GROUP BY a),
  l2 AS (SELECT a || '|' || b AS k, v, row_number() OVER (ORDER BY v DESC, a || '|' || b) AS rn FROM s)""".replace("LINES", LINES)


@_query(f"""WITH {_RIVER} SELECT 'p_type' AS level, CASE WHEN rn <= 4 THEN a ELSE 'Other' END AS node, CAST(sum(v) AS BIGINT) AS value, count(*) AS members, CASE WHEN max(rn) > 4 THEN string_agg(a, ';' ORDER BY rn) FILTER (rn <= 6) END AS listed, CASE WHEN max(rn) > 4 THEN CAST(coalesce(sum(v) FILTER (rn > 6), 0) AS BIGINT) ELSE 0 END AS omitted_value FROM l1 GROUP BY 2
  UNION ALL SELECT 'p_brand', CASE WHEN rn <= 4 THEN k ELSE 'Other' END, CAST(sum(v) AS BIGINT), count(*), CASE WHEN max(rn) > 4 THEN string_agg(k, ';' ORDER BY rn) FILTER (rn <= 6) END, CASE WHEN max(rn) > 4 THEN CAST(coalesce(sum(v) FILTER (rn > 6), 0) AS BIGINT) ELSE 0 END FROM l2 GROUP BY 2""")
def river_nodes(t):
    """Nodes of a two-level river with a rest a level."""
    return A.top_n_levels(_lines(t).join(t("part"), c("l_partkey") == c("p_partkey")), ["p_type", "p_brand"], "cents", 4, shown=2)[0]


@_query(f"""WITH {_RIVER}, r AS (SELECT CASE WHEN l1.rn <= 4 THEN s.a ELSE 'Other' END AS x, CASE WHEN l2.rn <= 4 THEN k ELSE 'Other' END AS y, s.v FROM s JOIN l1 ON l1.a = s.a JOIN l2 ON l2.k = s.a || '|' || s.b)
  SELECT 'total' AS level_from, 'TOTAL' AS node_from, 'p_type' AS level_to, x AS node_to, CAST(sum(v) AS BIGINT) AS amount FROM r GROUP BY x UNION ALL SELECT 'p_type', x, 'p_brand', y, CAST(sum(v) AS BIGINT) FROM r GROUP BY x, y""")
def river_edges(t):
    """Edges of the same river, through the rest nodes."""
    return A.top_n_levels(_lines(t).join(t("part"), c("l_partkey") == c("p_partkey")), ["p_type", "p_brand"], "cents", 4, shown=2)[1]


@_query("""WITH q AS (SELECT DISTINCT 'x' || (p_partkey % 60) AS pe_bli, p_type AS title, 'N' || (p_partkey % 2) AS org, CASE WHEN p_partkey % 60 < 30 THEN 'a' || (p_size % 2) END AS account FROM part), r AS (SELECT 'x' || (l_partkey % 60) AS pe_bli, 'N' || (l_partkey % 2) AS organization, CASE WHEN l_partkey % 60 < 45 THEN 'a' || (l_suppkey % 2) ELSE 'a0' END AS account, CAST(sum(cents) AS BIGINT) AS v FROM LINES GROUP BY ALL),
  u AS (SELECT pe_bli, organization, max(v) AS v FROM r GROUP BY ALL HAVING count(*) = 1) SELECT q.pe_bli, q.title, q.org, q.account, q.org AS organization, CASE WHEN q.account IS NULL THEN u.v ELSE r.v END AS total FROM q LEFT JOIN r ON r.pe_bli = q.pe_bli AND r.organization = q.org AND r.account = q.account LEFT JOIN u ON u.pe_bli = q.pe_bli AND u.organization = q.org
  WHERE CASE WHEN q.account IS NULL THEN u.v ELSE r.v END IS NOT NULL ORDER BY total DESC, q.pe_bli, q.account NULLS FIRST, q.title NULLS FIRST LIMIT 50""".replace("LINES", LINES))
def top_programs(t):
    """The 50 programs with most money, each by its own account's row or its only one."""
    key = F.concat(F.lit("x"), _text(c("p_partkey") % 60))
    programs = t("part").select(key.alias("pe_bli"), c("p_type").alias("title"), F.concat(F.lit("N"), _text(c("p_partkey") % 2)).alias("org"), F.when(c("p_partkey") % 60 < 30, F.concat(F.lit("a"), _text(c("p_size") % 2))).alias("account")).distinct()
    account = F.when(c("l_partkey") % 60 < 45, F.concat(F.lit("a"), _text(c("l_suppkey") % 2))).otherwise("a0")
    rows = _lines(t).groupBy(F.concat(F.lit("x"), _text(c("l_partkey") % 60)).alias("pe_bli"), F.concat(F.lit("N"), _text(c("l_partkey") % 2)).alias("organization"), account.alias("account")).agg(F.sum("cents").alias("total"))
    return marts.top_programs(programs, rows, "total")


@_query("""SELECT 'N' || c_nationkey AS state, CAST(y AS INT) AS year, CAST(sum(c_custkey + y) AS BIGINT) AS population FROM customer, (VALUES (2022), (2023), (2024)) AS v(y) WHERE c_nationkey < 20 AND NOT (y = 2023 AND c_nationkey = 3) GROUP BY ALL""")
def unpivot_years(t):
    """Year columns of a wide text table as rows; blanks, totals and unnamed codes are left out."""
    year = lambda y: _text(F.sum(c("c_custkey") + y))
    by_nation = t("customer").groupBy("c_nationkey").agg(year(2022).alias("POPESTIMATE2022"), year(2023).alias("POPESTIMATE2023"), year(2024).alias("POPESTIMATE2024"))
    wide = by_nation.select(F.lit("040").alias("SUMLEV"), _text("c_nationkey").alias("STATE"), "POPESTIMATE2022", F.when(c("c_nationkey") == 3, " ").otherwise(c("POPESTIMATE2023")).alias("POPESTIMATE2023"), "POPESTIMATE2024")
    totals = wide.withColumn("SUMLEV", F.lit("010"))
    return tables.unpivot_years(wide.unionByName(totals), t("nation").where("n_nationkey < 20").select(_text("n_nationkey").alias("code"), F.concat(F.lit("N"), _text("n_nationkey")).alias("state")))


@_query("""WITH s AS (SELECT 'L' || (p_partkey % 30) AS pe_bli, p_type AS title, p_partkey AS n, CAST(round(p_retailprice * 100) AS BIGINT) AS a, p_size AS b FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 30 <> 4)
  SELECT pe_bli, title, 'fy_2024_actuals' AS amount_type, CAST(sum(a) AS BIGINT) AS amount, string_agg(n, ',' ORDER BY n) AS cells FROM s GROUP BY pe_bli, title UNION ALL SELECT pe_bli, title, 'fy_2025_total', CAST(sum(b) AS BIGINT), string_agg(n, ',' ORDER BY n) FROM s WHERE b % 2 = 0 GROUP BY pe_bli, title""")
def melt_and_sum(t):
    """A display workbook's Add rows melted and summed to lines, with the rows that each sum is made of."""
    wide = t("part").select(
        F.when(c("p_partkey") % 30 == 4, "RDT&E").otherwise(F.concat(F.lit("L"), _text(c("p_partkey") % 30))).alias("pe_bli"), c("p_type").alias("title"), c("p_partkey").alias("row_number"), F.when(c("p_partkey") % 7 == 0, "Non-Add").otherwise("Add ").alias("Add/Non-Add"),
        _text(S.cents(c("p_retailprice"))).alias("FY 2024 Actuals Amount"), F.when(c("p_size") % 2 == 0, _text("p_size")).otherwise("n/a").alias("FY 2025 Total Amount*"), F.lit("9").alias("FY 2025 Quantity"),
    )
    found = tables.melt_and_sum(wide, ["pe_bli", "title"], add="`Add/Non-Add`")
    return found.select("pe_bli", "title", "amount_type", c("amount").cast("bigint").alias("amount"), F.array_join(F.transform("cells", lambda x: x.cast("string")), ",").alias("cells"))


@_query("""SELECT o_custkey AS id, 'fy_' || y || '_total' AS amount_type, CASE y WHEN 2024 THEN CAST(round(o_totalprice * 100) AS DOUBLE) ELSE CAST(o_orderkey AS DOUBLE) END AS amount, o_orderkey FROM orders, (VALUES (2024), (2025)) AS v(y) WHERE y = 2024 OR o_orderkey % 3 <> 0""")
def melt_years(t):
    """Wide year columns to long rows; text that is no number is dropped."""
    wide = t("orders").select(c("o_custkey").alias("id"), "o_orderkey", F.concat(F.lit("$"), _text(S.cents(c("o_totalprice")))).alias("FY 2024 Total"), F.when(c("o_orderkey") % 3 == 0, "TBD").otherwise(_text("o_orderkey")).alias("FY-2025 (Total)"))
    return tables.melt(wide, ["id", "o_orderkey"])


@_query("""WITH a AS (SELECT 'U' || o_orderkey AS filing_uuid, CAST(l_linenumber AS INT) AS n, 'P' || (l_suppkey % 5) AS name, l_returnflag AS position FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
  SELECT DISTINCT filing_uuid, name || ' Q' AS name, position AS covered_position FROM a""")
def nested_filings(t):
    """Lobbyists of nested filings, once a (filing, name, position)."""
    person = F.array(F.struct(F.struct(F.concat(F.lit("P"), _text(c("l_suppkey") % 5)).alias("first_name"), F.lit("Q").alias("last_name")).alias("lobbyist"), c("l_returnflag").alias("covered_position")))
    activity = F.struct(_text("l_linenumber").alias("general_issue_code"), F.lit("d").alias("description"), F.array(F.struct(F.lit("Navy").alias("name"))).alias("government_entities"), person.alias("lobbyists"))
    rows = t("orders").join(t("lineitem"), c("o_orderkey") == c("l_orderkey")).groupBy("o_orderkey").agg(F.collect_list(activity).alias("lobbying_activities"))  # an order's few lines
    filings = rows.select(F.concat(F.lit("U"), _text("o_orderkey")).alias("filing_uuid"), F.lit(2024).alias("filing_year"), F.lit("1").alias("income"), F.lit("2").alias("expenses"), F.struct(F.lit("r").alias("name")).alias("registrant"), F.struct(F.lit("k").alias("name")).alias("client"), "lobbying_activities")
    return tables.nested_filings(filings)[2]


@_query("""WITH e AS (SELECT family_key, arg_max(recipient_name, (total_obligation, recipient_uei)) AS display_name, CAST(sum(total_obligation) AS BIGINT) AS v FROM XWALK GROUP BY family_key)
  SELECT family_key, CASE WHEN CAST(substr(family_key, 2) AS INT) % 4 = 0 THEN 'The ' || family_key || ' company' ELSE display_name END AS display_name, v AS total_obligation FROM e""".replace("XWALK", XWALK))
def display_labels(t):
    """Entities under their curated names."""
    named = staging.dim_entities(_xwalk(t))
    aliases = t("nation").select(F.concat(F.lit("F"), _text(c("n_nationkey") * 4)).alias("family_key"), F.concat(F.lit("The F"), _text(c("n_nationkey") * 4), F.lit(" company")).alias("display_name"))
    return entities.display_labels(named, aliases).select("family_key", "display_name", "total_obligation")


@_query("""SELECT 'F' || n_nationkey AS family_key, d AS defect FROM nation, (VALUES ('unknown family'), ('no lower-case letter'), ('source missing')) AS v(d) WHERE (d = 'unknown family' AND 'F' || n_nationkey NOT IN (SELECT family_key FROM XWALK)) OR (d = 'no lower-case letter' AND n_regionkey = 1) OR (d = 'source missing' AND n_regionkey = 2)""".replace("XWALK", XWALK))
def display_alias_defects(t):
    """Curated names that can't stand."""
    rows = t("nation").select(
        F.concat(F.lit("F"), _text("n_nationkey")).alias("family_key"), F.when(c("n_regionkey") == 1, "LOUD").otherwise("Quiet name").alias("display_name"), F.lit("sourced").alias("evidence"), F.when(c("n_regionkey") == 2, "ftp://x").otherwise("https://x").alias("source_url"),
        F.lit("2024-01-01").alias("source_date"), F.lit("2024-02-01").alias("measured_on"), F.lit("a note that is long enough to say what was measured and why").alias("note"),
    )
    return entities.display_alias_defects(rows, _xwalk(t), ["sourced"], ["measured", "pin"])


@_query("""WITH l AS (
    SELECT p_brand AS pe_bli, p_size % 2 AS org, CAST(sum(p_size) AS BIGINT) AS total, CAST(sum(CASE WHEN p_size % 7 = 0 THEN p_size ELSE 0 END) AS BIGINT) AS less,
      count(*) FILTER (p_size % 7 = 0) AS m, CAST(sum(p_size) FILTER (p_size % 4 = 0) AS BIGINT) AS base FROM part GROUP BY ALL
  ), d AS (
    SELECT p_partkey AS document_id, p_brand AS pe_bli, CASE WHEN p_size % 5 = 0 THEN 'projects' ELSE 'program' END AS basis, l.*,
      CASE p_size % 3 WHEN 0 THEN total WHEN 1 THEN total - less ELSE total + 1 END AS whole, CASE p_size % 3 WHEN 0 THEN coalesce(base, 0) WHEN 1 THEN total - less ELSE total + 1 END AS part_of_it
    FROM part JOIN l ON l.pe_bli = p_brand AND l.org = p_size % 2
  ), a AS (
    SELECT document_id, pe_bli, basis, 'BudgetYearOne' AS scenario, whole AS amount, total, less, m, CAST(NULL AS BIGINT) AS base FROM d
    UNION ALL SELECT document_id, pe_bli, basis, 'BudgetYearOneBase', part_of_it, total, less, m, base FROM d
  ), j AS (SELECT *, CASE WHEN amount = total THEN 'fy_2026_total' WHEN amount = base THEN 'fy_2026_base' WHEN m > 0 AND amount = total - less THEN 'total_minus_reconciliation' END AS fitting FROM a)
  SELECT document_id, pe_bli, scenario, basis, CAST(amount AS BIGINT) AS amount, coalesce(fitting, 'fy_2026_total') AS candidate, fitting IS NOT NULL AS passed FROM j""")
def gate_b(t):
    """Program amounts against the books: any candidate type of either request, or the total less the reconciliation, project sums where a program has no row."""
    part = t("part")
    of = lambda divisor: F.sum(F.when(c("p_size") % divisor == 0, c("p_size")).otherwise(0))
    sums = part.groupBy("p_brand", (c("p_size") % 2).alias("side")).agg(F.sum("p_size").alias("total"), of(7).alias("less"), of(4).alias("base"))
    keyed = part.withColumn("side", c("p_size") % 2).join(sums, ["p_brand", "side"])

    def detail(scenario, first):
        amount = F.when(c("p_size") % 3 == 0, c(first)).when(c("p_size") % 3 == 1, c("total") - c("less")).otherwise(c("total") + 1)
        project = F.when(c("p_size") % 5 == 0, "1").alias("project_number")
        return keyed.select(c("p_partkey").alias("document_id"), c("p_brand").alias("pe_bli"), F.lit(scenario).alias("scenario"), project, F.lit(None).cast("string").alias("account"), amount.alias("amount_millions"), F.lit(False).alias("superseded"))

    details = detail("BudgetYearOne", "total").unionByName(detail("BudgetYearOneBase", "base")).unionByName(detail("AllPriorYears", "total"))
    org = F.concat(F.lit("O"), _text(c("p_size") % 2))
    documents = part.select(c("p_partkey").alias("document_id"), F.lit("R-1").alias("exhibit"), org.alias("org"), F.lit(2026).alias("fiscal_year"), F.lit(False).alias("consolidated"))

    def row(amount_type, condition):
        return part.where(condition).select(
            F.lit("R-1").alias("exhibit"), F.lit(2026).alias("fiscal_year"), org.alias("organization"), F.lit("1").alias("account"),
            c("p_brand").alias("pe_bli"), F.lit(amount_type).alias("amount_type"), (c("p_size") * 1000).alias("amount_thousands"),
        )

    lines = row("fy_2026_total", "true").unionByName(row("fy_2026_reconciliation_request", "p_size % 7 = 0")).unionByName(row("fy_2026_base", "p_size % 4 = 0"))
    candidates = marts.scenario_candidates(part.sparkSession.createDataFrame([(2026,)], "edition int"))
    return ledger.gate_b(details, documents, lines, candidates).select("document_id", "pe_bli", "scenario", "basis", c("amount").cast("bigint").alias("amount"), "candidate", "passed")


# pages and gates --------------------------------------------------------------------------------------------------


def _articles(t) -> DataFrame:
    """Announcement articles made of orders: a title with its day, a service header, award paragraphs with marks and breaks.

    A quarter of the awards names the same number twice, awarded and referred to; paragraphs may stay open.
    """
    lead = F.concat(
        F.lit("<!DOCTYPE html><title>Contracts For "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("</title><script>var a = '<p>$1 (X00000-11-C-2222)</p>';</script><!-- <p>NAVY</p> -->"),
        F.lit('<p class="h" title="a > b"><strong>'), F.when(c("o_orderstatus") == "F", "NAVY").otherwise("ARMY"), F.lit("</strong> *</p>"),
    )
    number = F.lpad(_text(c("o_orderkey") % 10000), 4, "0")
    award = F.concat(
        F.lit("<p><b>Firm</b>"), _text("o_custkey"), F.lit(", Town<br>was awarded a $1.5 million order (<i>W912AB-24-C-"), number, F.lit("</i>)"),
        F.when(c("o_custkey") % 2 == 0, F.concat(F.lit("<br/>under contract<span> N00019-20-D-"), number, F.lit("</span>"))).otherwise(F.lit("")), F.lit(" and $20,000 more."),
        F.when(c("o_custkey") % 4 == 0, F.concat(F.lit("<br>It adds to contract W912AB-24-C-"), number)).otherwise(F.lit("</p>")),
    )
    orders = t("orders").repartition("o_orderkey")  # pages cost more than rows: they are dealt to all tasks before their texts are made
    return orders.select(c("o_orderkey").alias("article_id"), F.concat(lead, award, F.lit("<p>No number here.<div>W912AB-24-C-0000 stands in no paragraph</div>")).alias("html"))


@_query("""WITH o AS (SELECT *, lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS n, o_custkey % 2 = 0 AS two, o_custkey % 4 = 0 AS four FROM orders)
  SELECT o_orderkey AS article_id, CASE WHEN o_orderstatus = 'F' THEN 'NAVY' ELSE 'ARMY' END AS service, 'Firm ' || o_custkey AS contractor,
    'W912AB24C' || n || ':award' || CASE WHEN two THEN ',N0001920D' || n || ':referenced' ELSE '' END || CASE WHEN four THEN ',W912AB24C' || n || ':referenced' ELSE '' END AS numbers,
    'W912AB24C' || n || CASE WHEN two THEN ',N0001920D' || n ELSE '' END AS piids,
    CASE WHEN two THEN 'N0001920D' || n ELSE '' END || CASE WHEN four THEN ',W912AB24C' || n ELSE '' END AS referenced,
    '1500000,20000' AS amounts, strftime(o_orderdate, '%Y-%m-%d') AS announced FROM o""")
def contract_records(t):
    """Award paragraphs of articles with their day, service, numbers (awarded and referred to) and money."""
    found = pages.contract_records(_articles(t), ["NAVY", "ARMY"])
    roles = F.transform("numbers", lambda n: F.concat(n["piid"], F.lit(":"), n["role"]))
    lists = {"numbers": roles, "piids": c("piids"), "referenced": c("referenced"), "amounts": c("amounts")}
    joined = [F.array_join(value, ",").alias(name) for name, value in lists.items()]
    return found.select("article_id", "service", "contractor", *joined, F.date_format("announced", "yyyy-MM-dd").alias("announced"))


def _fact_rows(t) -> DataFrame:
    return t("part").select(
        F.concat(F.lit("f"), _text("p_partkey")).alias("fact_id"), (c("p_partkey") % 20).alias("document_id"), F.concat(F.lit("06"), _text(c("p_partkey") % 7 + 10000), F.lit("A")).alias("pe_bli"), F.when(c("p_size") % 2 == 0, _text(c("p_partkey") % 10 + 100)).alias("project_number"),
        F.when(c("p_size") % 3 == 0, "R-2").otherwise("R-3").alias("exhibit"), (c("p_partkey") % 300 + 1000).cast("double").alias("amount_millions"),
    )


@_query("""WITH f AS (SELECT 'f' || p_partkey AS fact_id, p_partkey % 20 AS d, p_partkey % 7 AS pe, CASE WHEN p_size % 2 = 0 THEN p_partkey % 10 + 100 END AS project, CASE WHEN p_size % 3 = 0 THEN 'R-2' ELSE 'R-3' END AS exhibit, p_partkey % 300 AS v FROM part),
  g AS (SELECT p_partkey % 20 AS d, p_partkey AS page, p_partkey % 7 AS pe, p_partkey % 10 + 100 AS project, CASE WHEN p_partkey % 4 = 0 THEN 'R-2' ELSE 'R-3' END AS exhibit, p_partkey % 300 AS v FROM part WHERE p_partkey % 3 <> 0),
  j AS (SELECT fact_id, page, g.exhibit = f.exhibit AS on_exhibit, coalesce(g.project = f.project, false) AS on_project FROM f JOIN g ON f.d = g.d AND f.v = g.v AND f.pe = g.pe),
  k AS (SELECT *, bool_or(on_exhibit) OVER (PARTITION BY fact_id) AS any_exhibit, count(*) OVER (PARTITION BY fact_id) AS n FROM j), l AS (SELECT *, bool_or(on_project) OVER (PARTITION BY fact_id) AS any_project FROM k WHERE on_exhibit OR NOT any_exhibit),
  p AS (SELECT fact_id, min(page) AS page, count(*) AS kept, max(n) AS n FROM l WHERE on_project OR NOT any_project GROUP BY fact_id)
  SELECT f.fact_id, page, CASE WHEN page IS NULL THEN 'unresolved' WHEN kept = 1 THEN 'unique' ELSE 'ambiguous_first' END AS resolution, coalesce(n, 0) AS candidate_pages FROM f LEFT JOIN p ON p.fact_id = f.fact_id""")
def fact_pages(t):
    """The page that prints each fact: by code and amount, narrowed to its exhibit and project."""
    text = F.concat(F.lit("Exhibit "), F.when(c("p_partkey") % 4 == 0, "R-2").otherwise("R-3"), F.lit(" of 06"), _text(c("p_partkey") % 7 + 10000), F.lit("A project "), _text(c("p_partkey") % 10 + 100), F.lit(" costs "), F.format_number((c("p_partkey") % 300 + 1000).cast("double"), 3), F.lit(" now, not 5"))
    book = t("part").where("p_partkey % 3 <> 0").select((c("p_partkey") % 20).alias("document_id"), c("p_partkey").alias("page"), text.alias("text"))
    return pages.fact_pages(_fact_rows(t), book)


@_query("""WITH n AS (SELECT 'n' || p_partkey AS narrative_id, p_partkey % 9 AS d, p_partkey % 50 AS k, p_partkey % 2 AS pe, p_size % 3 AS pr FROM part),
  j AS (SELECT narrative_id, p_partkey AS page, p_size % 2 = pe AS on_code, p_partkey % 3 = pr AS on_project FROM n JOIN part g ON g.p_partkey % 9 = n.d AND g.p_partkey % 50 = n.k AND g.p_size <> 7),
  c AS (SELECT *, count(*) OVER w AS n_pages, bool_or(on_code) OVER w AS any_code FROM j WINDOW w AS (PARTITION BY narrative_id)),
  e AS (SELECT *, bool_or(on_project) OVER (PARTITION BY narrative_id) AS any_project FROM c WHERE on_code OR NOT any_code),
  p AS (SELECT narrative_id, min(page) AS page, count(*) AS kept, max(n_pages) AS n_pages FROM e WHERE on_project OR NOT any_project GROUP BY narrative_id)
  SELECT n.narrative_id, page, CASE WHEN page IS NULL THEN 'unresolved' WHEN kept = 1 THEN 'unique' ELSE 'ambiguous_first' END AS resolution, coalesce(n_pages, 0) AS candidate_pages
  FROM n LEFT JOIN p USING (narrative_id)""")
def narrative_pages(t):
    """The page with a narrative's opening words, white space evened out, narrowed to its code and project."""
    opening = lambda gap: F.concat(F.lit("This"), F.lit(gap), F.lit("effort number "), _text(c("p_partkey") % 50), F.lit(" funds the work on many"), F.lit(gap), F.lit("parts of it"))
    code, project = (lambda n: F.concat(F.lit("060"), _text(n), F.lit("A"))), (lambda n: F.concat(F.lit("P"), _text(n)))
    told = t("part").select(
        F.concat(F.lit("n"), _text("p_partkey")).alias("narrative_id"), (c("p_partkey") % 9).alias("document_id"), code(c("p_partkey") % 2).alias("pe_bli"), project(c("p_size") % 3).alias("project_number"),
        F.lit("R-2").alias("exhibit"), F.concat(opening(" "), F.lit(" and what follows "), _text("p_partkey")).alias("body"),
    )
    head = F.concat(F.lit("Page of "), code(c("p_size") % 2), F.lit(", project "), project(c("p_partkey") % 3), F.lit(". "))
    shown = F.when(c("p_size") == 7, F.concat(F.lit("No"), opening(" "))).otherwise(F.concat(opening("\n  "), F.lit(" and what else"))) # a word that only ends in the first one is another word
    book = t("part").select((c("p_partkey") % 9).alias("document_id"), c("p_partkey").alias("page"), F.concat(head, shown, F.lit(" and more")).alias("text"))
    return pages.narrative_pages(told, book)


@_query("""WITH n AS (SELECT p_name, p_name || ' ' || (p_size % 3) AS pe, p_size FROM part), a AS (SELECT DISTINCT upper(unnest([split_part(p_name, ' ', 1), p_name, pe])) AS alias FROM n UNION SELECT 'NOWHERE'),
  m AS (SELECT pe, sum(p_size) AS v FROM n GROUP BY pe), g AS (SELECT alias, count(*) AS n, list_sort(list(pe)) AS l, CAST(sum(v) AS DOUBLE) AS amount FROM a JOIN m ON contains(upper(pe), alias) GROUP BY alias)
  SELECT a.alias, coalesce(n, 0) AS candidates, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'sole' WHEN n <= 8 THEN 'ambiguous' ELSE 'too_many' END AS tier, CASE WHEN n <= 8 THEN array_to_string(l, ',') END AS programs, amount, CASE WHEN length(a.alias) = 3 THEN 'red ring 1' END AS seeded, length(a.alias) = 3 AND NOT coalesce(list_contains(l, 'red ring 1'), false) AS seed_conflict FROM a LEFT JOIN g USING (alias)""")
def alias_candidates(t):
    """Programs whose title contains an alias, with their money and what a seed says already: a title is a program's, a name several programs', a first word many's."""
    title = F.concat("p_name", F.lit(" "), _text(c("p_size") % 3))
    parts = t("part").select("p_name", title.alias("pe_bli"), c("p_size").alias("amount"))
    aliases = parts.select(F.explode(F.array(F.substring_index("p_name", " ", 1), c("p_name"), c("pe_bli"))).alias("alias"))
    aliases = aliases.unionByName(parts.sparkSession.createDataFrame([("nowhere",)], "alias string")).distinct()
    seeded = aliases.where(F.char_length("alias") == 3).select("alias", F.lit("red ring 1").alias("pe_bli"))
    found = pages.alias_candidates(aliases, parts.select("pe_bli", c("pe_bli").alias("title")), money=parts.select("pe_bli", "amount"), seeded=seeded)
    return found.withColumn("programs", F.array_join("programs", ",")).drop("mentions")


@_query("""WITH n AS (SELECT DISTINCT p_brand AS pe, CASE WHEN p_size % 10 = 9 THEN 'Plans for 2026' ELSE 'Improved KC-' || (p_size % 10 + 10) || ' Tanker' END AS title, 'RDS' || (p_size % 4) AS acronym FROM part WHERE p_brand <> 'Brand#5'),
  d AS (SELECT pe, title AS name FROM n WHERE title NOT LIKE 'Plans%' UNION SELECT pe, regexp_extract(title, 'KC-[0-9]+') FROM n WHERE title NOT LIKE 'Plans%' UNION SELECT pe, acronym FROM n UNION SELECT pe, 'Rapid Data Stream (' || acronym || ')' FROM n)
  SELECT pe AS pe_bli, lower(name) AS key, name, count(*) OVER (PARTITION BY lower(name)) > 1 AS shared, pe IN ('Brand#1', 'Brand#2') AS ambiguous_key FROM d""")
def lexicon_candidates(t):
    """Names that titles use or are and acronyms that bodies define, whether several programs have them and whether the key is that of several."""
    title = F.when(c("p_size") % 10 == 9, F.lit("Plans for 2026")).otherwise(F.concat(F.lit("Improved KC-"), _text(c("p_size") % 10 + 10), F.lit(" Tanker")))
    body = F.concat(F.lit("the work extends Rapid Data Stream (RDS"), _text(c("p_size") % 4), F.lit(") to more sites"))
    made = F.when(c("p_brand") == "Brand#5", F.concat("p_brand", F.lit("-L12"))).otherwise(c("p_brand"))  # a made key names nothing
    told = t("part").select(made.alias("pe_bli"), title.alias("title"), body.alias("body")).distinct()
    twice = F.when(c("p_brand").isin("Brand#1", "Brand#2"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    programs = t("part").select(c("p_brand").alias("pe_bli"), twice.alias("orgs")).distinct().select("pe_bli", F.explode("orgs"))
    return pages.lexicon_candidates(told, programs).drop("quotes")


@_query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(round(o_totalprice) AS BIGINT) AS v FROM orders WHERE o_orderkey % 3 <> 0)
  SELECT o_orderkey AS page_id, 'program ' || o_custkey AS program, CAST(2023 AS INT) AS fy, CAST(5.25 AS DOUBLE) AS rate_pct, v * 1000000 AS outlays_usd, CAST(round(v * 1000000 * 5.25 / 100) AS BIGINT) AS derived_improper_amount_usd FROM o""")
def payment_rates(t):
    """Improper-payment pages to yearly rates; a year needs both its outlays and its rate."""
    year = F.when(c("o_orderkey") % 2 == 0, F.lit(" data-year='2023' title='5 > 4'>")).otherwise(F.lit("><p>FY 2023 outlays"))
    card = F.concat(F.lit('<!-- $7 M --><div\n class="card metrics-summary"'), year, F.lit("<p>Outlays <b>$"), _text(F.round("o_totalprice").cast("bigint")), F.lit("</b> M</div><div>$8 M</div>"))
    chart = F.when(c("o_orderkey") % 3 != 0, F.lit('<div class="usa-card__body"><h2>Rates <em>FY</em> 2023</h2><canvas data-note="a>b" data-improper="5.25" data-unknown="1.0"></canvas></div>')).otherwise("")
    later = F.lit('<div class="usa-card__body"><h2>Rates FY 2024</h2><canvas data-improper="9.9"></div><div class="usa-card__body"><canvas data-improper="1.1"></div>')
    orders = t("orders").repartition("o_orderkey")  # as the articles are
    rows = orders.select(c("o_orderkey").alias("page_id"), F.concat(F.lit("program "), _text("o_custkey")).alias("program"), F.lit("agency").alias("agency"), F.concat(card, chart, later).alias("html"))
    found = pages.payment_rates(rows)
    return found.select("page_id", "program", "fy", "rate_pct", c("outlays_usd").cast("bigint").alias("outlays_usd"), c("derived_improper_amount_usd").cast("bigint").alias("derived_improper_amount_usd"))


@_query("""SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN '097' WHEN page_id % 3 = 1 THEN '017' END AS agency_code, page_id % 3 <> 2 AS mapped FROM pages""")
def title_map(t):
    """Areas beside a curated map, with typographic signs and case evened out."""
    shown = F.concat(F.lit("DoD’s  “area”  "), _text(c("page_id") % 3))
    areas = t("pages").select("page_id", "url", shown.alias("area_title"))
    curated = t("region").where("r_regionkey < 2").select(F.concat(F.lit("dod's \"AREA\" "), _text("r_regionkey")).alias("area_title"), F.when(c("r_regionkey") == 0, "097").otherwise("017").alias("agency_code"))
    return gates.title_map(areas, curated).select("page_id", "url", "agency_code", "mapped")


@_query(f"""WITH {_DERIVED}, f AS (SELECT l_orderkey AS k, CAST(l_orderkey AS VARCHAR) AS fact_id, CASE WHEN l_orderkey % 2 = 0 THEN 'difference' ELSE 'sum' END AS operation FROM d),
  p AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY operation ORDER BY md5('0|' || fact_id), fact_id) <= 40) SELECT fact_id, operation, CASE WHEN k % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS verdict FROM p""")
def citation_sample(t):
    """A repeatable sample of derived facts, recomputed."""
    return phase_gates.citation_sample(_facts(t), _derived(t), 40).select("fact_id", "operation", "verdict")


@_query("""SELECT CAST(o_orderkey AS VARCHAR) AS fact_id, CAST(round(o_totalprice * 100) AS BIGINT) AS left_value, CAST(round(o_totalprice * 100) AS BIGINT) + 1 AS right_value FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0""")
def export_disagreements(t):
    """Facts that two exports give differently."""
    rows = t("orders").select("o_orderkey", _text("o_orderkey").alias("fact_id"), S.cents(c("o_totalprice")).alias("value"))
    return phase_gates.export_disagreements(rows, rows.where("o_orderkey % 3 <> 0").withColumn("value", c("value") + F.when(c("o_orderkey") % 4 == 0, 1).otherwise(0)))


@_query("""WITH r AS (SELECT * FROM (VALUES ('feed_claims', 2), ('rivers_conserve', 1), ('districts_once', 0), ('aliases_route', 1), ('volumes_ingested', 1), ('badges_hold', 1), ('programs_placed_once', 1)) AS v(gate, k)), b AS (SELECT count(*) AS n FROM (SELECT DISTINCT p_brand FROM part)),
  a AS (SELECT count(*) AS n FROM (SELECT p_type FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) > 1)), v AS (SELECT count(DISTINCT p_size) AS n FROM part WHERE p_size % 4 = 0), e AS (SELECT count(*) AS n FROM (SELECT DISTINCT p_type FROM part)),
  g AS (SELECT gate, CASE gate WHEN 'feed_claims' THEN 2 * (SELECT n FROM b) WHEN 'rivers_conserve' THEN (SELECT n FROM e) WHEN 'districts_once' THEN 0 WHEN 'aliases_route' THEN (SELECT n FROM a) WHEN 'volumes_ingested' THEN (SELECT n FROM v)
    WHEN 'badges_hold' THEN (SELECT 2 * count(*) FROM (SELECT p_brand FROM part GROUP BY p_brand HAVING min(p_size) FILTER (WHERE p_partkey % 3 <> 0) > 1 AND count(*) FILTER (WHERE p_partkey % 3 = 0) > 0)) ELSE (SELECT count(DISTINCT p_brand) FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')) END AS violations FROM r)
  SELECT gate, violations, CASE WHEN gate = 'feed_claims' THEN 'warn' ELSE 'error' END AS severity, violations = 0 OR gate = 'feed_claims' AS passed FROM g""")
def site_gates(t):
    """What pages claim against recomputes, with planted faults, as one report."""
    part = t("part")
    events = part.groupBy("p_brand").agg(F.sum("p_size").alias("v"))
    edges = part.groupBy("p_type").agg(F.sum("p_size").alias("v")).select(F.explode(F.array(
        F.struct(F.lit("TOTAL").alias("node_from"), c("p_type").alias("node_to"), c("v").alias("amount")), F.struct(c("p_type").alias("node_from"), F.concat(c("p_type"), F.lit("|x")).alias("node_to"), (c("v") + 1).alias("amount")))).alias("e")).select("e.*")
    awards = part.select(c("p_type").alias("pop_state"), c("p_brand").alias("pop_district"), c("p_partkey").alias("award_id_piid"), c("p_size").alias("total_obligation"))
    totals = awards.groupBy("pop_state", "pop_district").agg(F.sum("total_obligation").alias("total_obligation"))
    volumes = part.groupBy(c("p_size").alias("document_id")).agg(F.count("*").alias("n_rows"))
    # pages that take scenarios out of scope into their badge call programs partial that aren't; one program is on no list, one on both
    brand, scope = c("p_brand").alias("pe_bli"), F.when(c("p_partkey") % 3 == 0, "AllPriorYears").otherwise("PriorYear")
    details = part.select(brand, scope.alias("scenario"), ((c("p_partkey") % 3 != 0) & (c("p_size") > 1)).alias("reconciled"))
    brands = details.select("pe_bli").distinct()
    found = phase_gates.site_gates(
        events, events.withColumn("v", c("v") + 1), edges, totals, awards.unionByName(awards), part.select(c("p_type").alias("alias"), c("p_brand").alias("pe_bli")), volumes, volumes.withColumn("n_rows", c("n_rows") + F.when(c("document_id") % 4 == 0, 1).otherwise(0)),
        phase_gates.badges(details, ["PriorYear", "AllPriorYears"]), details, ["PriorYear"], brands.where("pe_bli = 'Brand#1'"), brands.where("pe_bli <> 'Brand#2'"),
    )
    return phase_gates.report(part.sparkSession, found, ("feed_claims",))


@_query(f"""WITH {_EDGES}, r AS (SELECT one AS src, own AS dst, max(fiscal_year) AS later FROM n WHERE taken_back GROUP BY ALL),
  x AS (SELECT src, dst FROM s WHERE EXISTS (SELECT 1 FROM r WHERE least(r.src, r.dst) = least(s.src, s.dst) AND greatest(r.src, r.dst) = greatest(s.src, s.dst) AND later > s.fiscal_year) OR EXISTS (SELECT 1 FROM s b WHERE b.src = s.dst AND b.dst = s.src AND b.fiscal_year > s.fiscal_year)),
  g AS (SELECT 'chains_one_to_one' AS gate, (SELECT count(*) FROM (SELECT src FROM s GROUP BY src HAVING count(*) > 1)) + (SELECT count(*) FROM (SELECT dst FROM s GROUP BY dst HAVING count(*) > 1)) AS violations
    UNION ALL SELECT 'points_equal_facts', (SELECT count(*) FROM orders WHERE o_orderkey % 8 = 0) UNION ALL SELECT 'no_retraction', (SELECT count(*) FROM x) UNION ALL SELECT 'seed_ratified', (SELECT count(*) FROM s WHERE relation = 'renamed'))
  SELECT gate, violations, 'error' AS severity, violations = 0 AS passed FROM g""")
def store_gates(t):
    """A published lineage with forks, money off its facts, retracted edges and a seed without evidence."""
    told = _narratives(t)
    edges = succession.stated_edges(told)
    points = t("orders").select(_text("o_orderkey").alias("fact_id"), S.cents(c("o_totalprice")).alias("amount"), "o_orderkey")
    facts = points.select("fact_id", (c("amount") + F.when(c("o_orderkey") % 8 == 0, 1).otherwise(0)).alias("amount"))
    seeded = edges.select(c("evidence_fact_id").alias("fact_id"), F.when(c("relation") == "renamed", "gone").otherwise(c("evidence_sentence")).alias("evidence_sentence"), F.lit("y").alias("verdict"), "src", "dst")
    return phase_gates.report(told.sparkSession, phase_gates.store_gates(edges, edges, told, points.drop("o_orderkey"), facts, seeded))


@_query("""SELECT 'orders' AS dataset, kind, only_left, only_right, repeated, l AS export_rows, r AS ledger_rows, only_left = 0 AND only_right = 0 AND repeated = 0 AND l = r AS passed FROM (
  SELECT o_orderpriority AS kind, count(*) FILTER (o_orderkey % 7 = 0 AND o_orderpriority = '1-URGENT') AS only_left, count(*) FILTER (o_orderkey % 5 = 0 AND o_orderpriority <> '2-HIGH') AS only_right, CAST(0 AS BIGINT) AS repeated,
    count(*) FILTER (o_orderkey % 5 <> 0 OR o_orderpriority = '2-HIGH') AS l, count(*) FILTER (o_orderkey % 7 <> 0 OR o_orderpriority <> '1-URGENT') AS r FROM (SELECT DISTINCT o_orderkey, o_orderpriority FROM orders WHERE NOT (o_orderkey % 35 = 0)) GROUP BY ALL)""")
def integrity_gate(t):
    """Ids of an export against the ledger's, with both row counts."""
    rows = t("orders").where("o_orderkey % 35 <> 0").select(c("o_orderpriority").alias("kind"), "o_orderkey").distinct()
    export = rows.where("o_orderkey % 5 <> 0 OR kind = '2-HIGH'")
    return gates.integrity_gate({"orders": (export, rows.where("o_orderkey % 7 <> 0 OR kind <> '1-URGENT'"))}, "kind", "o_orderkey")


# staging, families and phase gates --------------------------------------------------------------------------------


def _landed(t, condition: str, prefix: str, state: str) -> DataFrame:
    """Award rows as they land, all text, under one source's column names."""
    rows = _lines(t).where(condition).join(t("supplier"), c("l_suppkey") == c("s_suppkey"))
    return rows.select(
        F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber")).alias(f"{prefix}_transaction_unique_key"), F.when(c("l_linenumber") == 7, "soon").otherwise(_text(c("l_shipdate").cast("date"))).alias("action_date"), _text("ship_year").alias("fy"),
        F.when(c("l_linenumber") == 6, "").otherwise(_text("cents")).alias("federal_action_obligation"), F.when(c("l_suppkey") % 5 == 0, "").otherwise(_text("l_suppkey")).alias("recipient_uei"), F.lower("s_name").alias("recipient_name"),
        F.when(c("l_suppkey") % 3 == 0, "").otherwise("PU").alias("recipient_parent_uei"), F.lit("parent").alias("recipient_parent_name"), F.lit("agency").alias("awarding_agency_name"), F.lit("sub").alias("awarding_sub_agency_name"), F.lit("336411").alias("naics_code"),
        F.lit("1510").alias("product_or_service_code"), F.concat(F.lit("S"), _text("s_nationkey")).alias(f"primary_place_of_performance_state_{state}"), F.lit("90").alias("prime_award_transaction_place_of_performance_cd_current"),
        F.when(c("l_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("A"), _text("l_orderkey"))).alias("award_id_piid"), F.lit("http://x").alias("usaspending_permalink"), F.concat(F.lit("K"), _text("l_orderkey")).alias(f"{prefix}_award_unique_key"),
    )


@_query(f"""SELECT l_orderkey || '-' || l_linenumber AS transaction_key, CASE WHEN l_returnflag = 'R' THEN 'assistance' ELSE 'contract' END AS award_type, CASE WHEN l_linenumber <> 7 THEN strftime(l_shipdate, '%Y-%m-%d') END AS action_date, ship_year AS fiscal_year, CASE WHEN l_linenumber <> 6 THEN CAST(cents AS DOUBLE) END AS obligation,
  CASE WHEN l_suppkey % 5 <> 0 THEN CAST(l_suppkey AS VARCHAR) END AS recipient_uei, upper(s_name) AS recipient_name, CASE WHEN l_suppkey % 3 <> 0 THEN 'PU' END AS recipient_parent_uei, 'PARENT' AS recipient_parent_name, 'agency' AS awarding_agency_name, 'sub' AS awarding_sub_agency_name,
  CASE WHEN l_returnflag <> 'R' THEN '336411' END AS naics_code, CASE WHEN l_returnflag <> 'R' THEN '1510' END AS product_or_service_code, 'S' || s_nationkey AS pop_state, '90' AS pop_district, CASE WHEN l_returnflag <> 'R' AND l_orderkey % 4 <> 0 THEN 'A' || l_orderkey END AS award_id_piid, 'http://x' AS usaspending_permalink, 'K' || l_orderkey AS award_unique_key
  FROM {LINES} JOIN supplier ON l_suppkey = s_suppkey""")
def award_transactions(t):
    """Contracts and assistance under one schema."""
    both = staging.award_transactions(_landed(t, "l_returnflag <> 'R'", "contract", "code"), _landed(t, "l_returnflag = 'R'", "assistance", "name"))
    return both.withColumn("action_date", F.date_format("action_date", "yyyy-MM-dd"))


@_query("""SELECT p_brand AS pe_bli, CASE WHEN p_size % 6 <> 0 THEN CAST(2000 + p_size AS INT) END AS fiscal_year, CAST(round(p_retailprice * 100) AS DOUBLE) AS amount_thousands, CASE WHEN p_size % 4 <> 0 THEN CAST(p_size AS INT) END AS source_document_id FROM part""")
def budget_lines_typed(t):
    """Budget lines from text; what is no number is null."""
    rows = t("part").select(c("p_brand").alias("pe_bli"), F.when(c("p_size") % 6 == 0, "FY").otherwise(_text(c("p_size") + 2000)).alias("fiscal_year"), _text(S.cents(c("p_retailprice"))).alias("amount_thousands"), F.when(c("p_size") % 4 == 0, "").otherwise(_text("p_size")).alias("source_document_id"))
    return staging.budget_lines(rows)


@_query("""SELECT p_brand AS pe_bli, CAST(2000 + p_size AS INT) AS fiscal_year, CASE WHEN p_size % 5 <> 0 THEN p_size::DOUBLE END AS amount_millions, CAST(p_size AS INT) AS document_id, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 2 = 0 END AS reconciled FROM part""")
def budget_details_typed(t):
    """Budget details from text; an unknown check stays unknown."""
    told = F.when(c("p_size") % 7 == 0, F.lit(None)).when(c("p_size") % 2 == 0, " True ").otherwise("no")
    rows = t("part").select(c("p_brand").alias("pe_bli"), _text(c("p_size") + 2000).alias("fiscal_year"), F.when(c("p_size") % 5 == 0, "n/a").otherwise(_text("p_size")).alias("amount_millions"), _text("p_size").alias("document_id"), told.alias("reconciled"))
    return staging.budget_details(rows)


@_query(f"""WITH t AS ({ORACLE_SQL["budget_trajectory"]}), g AS (SELECT *, CASE WHEN count(CASE WHEN fy_2000_total IS NOT NULL THEN organization END) OVER (PARTITION BY pe_bli, account) > 1 THEN organization END AS org FROM t),
  s AS (SELECT pe_bli, account, org AS organization, CAST(sum(fy_1998_actuals) AS BIGINT) AS fy_1998_actuals, CAST(sum(fy_1999_total) AS BIGINT) AS fy_1999_total, CAST(sum(fy_2000_total) AS BIGINT) AS fy_2000_total FROM g GROUP BY pe_bli, account, org)
  SELECT *, fy_2000_total - fy_1999_total AS change, round(100.0::DOUBLE * (fy_2000_total - fy_1999_total) / nullif(fy_1999_total, 0), 2) + 0 AS pct_change FROM s""")
def program_trajectory(t):
    """Trajectory by program, organisations kept apart where a program has several in the newest slot."""
    slots = ["fy_1998_actuals", "fy_1999_total", "fy_2000_total"]
    return marts.program_trajectory(marts.budget_trajectory(_budget_lines(t), slots), slots)


@_query(f"""WITH d AS ({ORACLE_SQL["book_diff"]}), p AS (SELECT *, round(100.0::DOUBLE * (to_amount - from_amount) / nullif(from_amount, 0), 2) AS pct FROM d WHERE diff_kind = 'request_vs_actuals' AND from_amount >= 50000) SELECT * FROM p WHERE abs(pct) >= 25""")
def gap_events(t):
    """Requests whose actuals came out far off."""
    return marts.gap_events(marts.book_diff(_series(t)))


@_query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'uei' WHEN s_suppkey % 4 = 3 THEN 'uei' ELSE 'name' END AS method, CASE s_suppkey % 4 WHEN 0 THEN 'P' || s_nationkey WHEN 1 THEN 'PARENT ' || s_nationkey WHEN 2 THEN 'OWN ' || s_suppkey ELSE CASE WHEN s_suppkey % 8 = 3 THEN 'UNKNOWN' ELSE 'U' || s_suppkey END END AS key FROM supplier""")
def family_keys(t):
    """The family of a recipient: the parent's id, a normalised name, its own id."""
    kind = c("s_suppkey") % 4
    parent_id, parent_name = F.when(kind == 0, F.concat(F.lit("P"), _text("s_nationkey"))).otherwise(" "), F.when(kind == 1, F.concat(F.lit("The Parent "), _text("s_nationkey"), F.lit(" Inc.")))
    own_id, own_name = F.when(c("s_suppkey") % 8 != 3, F.concat(F.lit("U"), _text("s_suppkey"))), F.when(kind == 2, F.concat(F.lit("Own "), _text("s_suppkey"), F.lit(" Capital"))).otherwise("LLC")
    return t("supplier").select("s_suppkey", S.family_of(parent_id, parent_name, own_id, own_name).alias("f")).select("s_suppkey", "f.method", "f.key")


_MEMBERS = """e AS (SELECT 'FAM' || n_regionkey AS family, replace(upper(n_name), '_', ' ') AS a, replace(upper(n_name), '_', ' ') || ' NEXT ' || (n_nationkey % 3) AS b, '20' || (10 + n_nationkey) AS effective_date, n_nationkey FROM nation),
  known AS (SELECT a AS k FROM e WHERE n_nationkey % 4 <> 0 UNION SELECT b FROM e WHERE n_nationkey % 6 <> 0), m AS (SELECT family, effective_date, 'from' AS role, a AS family_key FROM e WHERE a IN (FROM known) UNION ALL SELECT family, effective_date, 'to', b FROM e WHERE b IN (FROM known)
    UNION ALL SELECT 'OTHER', effective_date, 'from', a FROM e WHERE n_nationkey % 7 = 1 AND a IN (FROM known) UNION ALL SELECT 'OTHER', effective_date, 'to', b FROM e WHERE n_nationkey % 7 = 1 AND b IN (FROM known))"""


def _members(t) -> DataFrame:
    old, new = F.concat("n_name", F.lit(", Inc.")), F.concat("n_name", F.lit(" Next "), _text(c("n_nationkey") % 3), F.lit(" Corp"))
    events = t("nation").select(F.concat(F.lit("FAM"), _text("n_regionkey")).alias("family"), old.alias("from_name"), new.alias("to_name"), F.concat(F.lit("20"), _text(c("n_nationkey") + 10)).alias("effective_date"), "n_nationkey")
    known = events.where("n_nationkey % 4 <> 0").select(S.normalized_name(c("from_name")).alias("family_key")).unionByName(events.where("n_nationkey % 6 <> 0").select(S.normalized_name(c("to_name")).alias("family_key")))
    twice = events.where("n_nationkey % 7 = 1").withColumn("family", F.lit("OTHER"))
    return entities.resolve_families(events.unionByName(twice), known)


@_query(f"WITH {_MEMBERS} SELECT * FROM m")
def family_members(t):
    """Members of curated events that the warehouse knows."""
    return _members(t)


@_query(f"WITH {_MEMBERS} SELECT family_key, count(DISTINCT family) AS families FROM m GROUP BY family_key HAVING count(DISTINCT family) > 1")
def conflicting_members(t):
    """Keys that events put into several families."""
    return entities.conflicting_members(_members(t))


@_query(f"""WITH {_MEMBERS}, a AS (SELECT family, min(family_key) AS anchor FROM m GROUP BY family) SELECT m.family, family_key, role, effective_date FROM m JOIN a USING (family) WHERE role = 'from' OR family_key <> anchor QUALIFY row_number() OVER (PARTITION BY m.family, family_key ORDER BY role, effective_date) = 1""")
def member_arrivals(t):
    """When each member joined its family."""
    found = _members(t)
    return entities.member_arrivals(found, found.groupBy("family").agg(F.min("family_key").alias("family_key")))


@_query(f"WITH {_EDGES} SELECT evidence_fact_id AS fact_id, evidence_sentence FROM s WHERE relation = 'realigned'")
def ratified_edges(t):
    """Edges judged true whose evidence still stands in its narrative."""
    told = _narratives(t)
    verdicts = succession.stated_edges(told).select(c("evidence_fact_id").alias("fact_id"), "evidence_sentence", F.when(c("relation") == "renamed", "n").otherwise("y").alias("verdict"))
    return gates.ratified_edges(verdicts, told).select("fact_id", "evidence_sentence")


@_query("""SELECT p_partkey, r_name FROM part JOIN region ON p_size % 5 = r_regionkey AND (r_regionkey % 2 = 0 OR p_brand = 'Brand#1' || r_regionkey)""")
def optional_scope(t):
    """A rule without a scope holds for all rows of its key, one with a scope for that alone."""
    rules = t("region").select("r_name", "r_regionkey", F.when(c("r_regionkey") % 2 == 1, F.concat(F.lit("Brand#1"), _text("r_regionkey"))).alias("scope"))
    return t("part").join(rules, (c("p_size") % 5 == c("r_regionkey")) & joins.optional_scope(c("scope"), c("p_brand"))).select("p_partkey", "r_name")


@_query("""WITH a AS (SELECT p_brand, p_size, max(p_partkey) AS v FROM part WHERE p_size < 10 GROUP BY ALL), b AS (SELECT p_brand, min(p_partkey) AS v FROM part WHERE p_brand < 'Brand#2' GROUP BY ALL), d AS (SELECT p_type, count(*) AS v FROM part WHERE p_type < 'P' GROUP BY ALL)
  SELECT p_partkey, coalesce(a.v, b.v, d.v) AS v, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 WHEN d.v IS NOT NULL THEN 3 END AS v_step FROM part p LEFT JOIN a ON a.p_brand = p.p_brand AND a.p_size = p.p_size LEFT JOIN b ON b.p_brand = p.p_brand LEFT JOIN d ON d.p_type = p.p_type""")
def fallback_chain(t):
    """The first of three lookups that knows a row."""
    part = t("part")
    by_both = part.where("p_size < 10").groupBy("p_brand", "p_size").agg(F.max("p_partkey").alias("v"))
    by_brand = part.where("p_brand < 'Brand#2'").groupBy("p_brand").agg(F.min("p_partkey").alias("v"))
    by_type = part.where("p_type < 'P'").groupBy("p_type").agg(F.count("*").alias("v"))
    found = joins.fallback_chain(part.select("p_partkey", "p_brand", "p_size", "p_type"), [(by_both, ["p_brand", "p_size"], "v"), (by_brand, ["p_brand"], "v"), (by_type, ["p_type"], "v")], "v")
    return found.select("p_partkey", "v", "v_step")


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' OR NOT o_totalprice > 10000 OR year(o_orderdate) NOT BETWEEN 1993 AND 1999")
def dq_breaks(t):
    """Rows where a span, a floor or a state doesn't hold."""
    holds = (c("o_orderstatus") != "P") & (c("o_totalprice") > 10000) & F.year("o_orderdate").between(1993, 1999)
    return DQ.breaks(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"), holds).select("o_orderkey", "o_orderstatus")


@_query("SELECT 'lowest status' AS question, 'Z' AS expected, min(o_orderstatus) AS actual FROM orders UNION ALL SELECT 'no rows', 'x', NULL")
def golden_answers(t):
    """Golden questions asked in SQL; two of them are stale."""
    orders = t("orders")
    orders.createOrReplaceTempView("golden_orders")
    return gates.golden_answers(orders.sparkSession, [
        ("lowest status", "SELECT min(o_orderstatus) AS v FROM golden_orders", "Z"), ("some orders", "SELECT count(*) > 0 AS v FROM golden_orders", "true"),
        ("a price", "SELECT max(1.50D) AS v FROM golden_orders", "1.5"), ("no rows", "SELECT o_orderkey FROM golden_orders WHERE false", "x"),
    ])


def _reported(t, found: dict[str, DataFrame]) -> DataFrame:
    return phase_gates.report(t("region").sparkSession, found).select("gate", "violations", "passed")


@_query(f"""WITH j AS (SELECT t.obligation, x.family_key FROM {TX} t LEFT JOIN {XWALK} x ON x.recipient_uei = t.recipient_uei), g AS (SELECT 'resolved_money' AS gate, CASE WHEN (SELECT sum(CASE WHEN family_key IS NOT NULL THEN obligation ELSE 0 END)::DOUBLE / sum(obligation) FROM j) < 0.95 THEN 1 ELSE 0 END AS violations UNION ALL SELECT 'places', 0
  UNION ALL SELECT 'golden_in_one_family', (SELECT count(*) FROM (SELECT s_nationkey % 3 FROM supplier WHERE s_suppkey % 6 <> 0 GROUP BY ALL HAVING count(DISTINCT s_suppkey % 17) > 1))) SELECT gate, violations, violations = 0 AS passed FROM g""")
def entity_gates(t):
    """Resolved money, places, and golden companies in one family."""
    named = _xwalk(t).join(t("supplier").select(_text("s_suppkey").alias("recipient_uei"), F.concat(F.lit("Golden "), _text(c("s_nationkey") % 3), F.lit(" Inc")).alias("golden")), "recipient_uei").withColumn("recipient_name", c("golden"))
    golden = t("region").select(F.concat(F.lit("GOLDEN "), _text("r_regionkey")).alias("name"))
    return _reported(t, phase_gates.entity_gates(_tx(t), named, golden))


@_query(f"""WITH h AS (SELECT * FROM ({ORACLE_SQL["hhi_by_brand"]})), g AS (SELECT 'payments_floor' AS gate, CASE WHEN (SELECT count(*) FROM part) < 50 THEN 1 ELSE 0 END AS violations UNION ALL SELECT 'areas_mapped', CASE WHEN (SELECT count(*) FILTER (p_size % 4 <> 0)::DOUBLE / count(*) FROM part) < 0.8 THEN 1 ELSE 0 END UNION ALL SELECT 'hhi_range', (SELECT count(*) FROM h WHERE hhi NOT BETWEEN 0 AND 10000)) SELECT gate, violations, violations = 0 AS passed FROM g""")
def oversight_gates(t):
    """A floor of rows, mapped areas, the range of the concentration index."""
    held = A.concentration(_lines(t).join(t("part"), c("l_partkey") == c("p_partkey")), ["p_brand"], "l_suppkey", "cents")
    return _reported(t, phase_gates.oversight_gates(t("part"), t("part").select((c("p_size") % 4 != 0).alias("mapped")), held, 50))


@_query("""WITH f AS (SELECT s_suppkey AS k, row_number() OVER (ORDER BY round(s_acctbal * 100) DESC, CAST(s_suppkey AS VARCHAR)) AS rn FROM supplier), g AS (SELECT 'top_families_covered' AS gate, CASE WHEN (SELECT count(*) FILTER (k % 7 <> 0)::DOUBLE / count(*) FROM f WHERE rn <= 50) < 0.85 THEN 1 ELSE 0 END AS violations
  UNION ALL SELECT 'tier_holds', (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 0) UNION ALL SELECT 'no_negative', (SELECT count(*) FROM supplier WHERE s_suppkey % 7 <> 0 AND round(s_acctbal * 100) < 0) UNION ALL SELECT 'mentions_have_filings', (SELECT count(*) FROM orders WHERE o_orderkey % 9 = 0) UNION ALL SELECT 'families_known', 0)
  SELECT gate, violations, violations = 0 AS passed FROM g""")
def influence_gates(t):
    """Coverage of the largest families, tiers, signs and orphans."""
    families = t("supplier").select(_text("s_suppkey").alias("family_key"), S.cents(c("s_acctbal")).alias("total_obligation"), "s_suppkey")
    influence = families.where("s_suppkey % 7 <> 0").select("family_key", c("total_obligation").alias("lobbying_total_usd"))
    mentions = t("orders").select(_text("o_orderkey").alias("filing_uuid"))
    tiers = t("supplier").select(F.lit("exact").alias("tier"), F.when(c("s_suppkey") % 5 == 0, "alias").otherwise("exact").alias("tier_now"))
    return _reported(t, phase_gates.influence_gates(influence, families.drop("s_suppkey"), mentions, t("orders").where("o_orderkey % 9 <> 0").select(_text("o_orderkey").alias("filing_uuid")), tiers))


@_query(f"""WITH {_SERIES}, gates AS (SELECT 'edition_coverage' AS gate, (SELECT count(*) FROM (SELECT DISTINCT fiscal_year FROM b WHERE fiscal_year IN (SELECT edition FROM series) EXCEPT SELECT DISTINCT edition FROM series WHERE edition <> 1997)) AS violations UNION ALL SELECT 'edition_leakage', 0 UNION ALL SELECT 'grain_unique', 0
  UNION ALL SELECT 'recompute', (SELECT count(*) FROM series WHERE edition = 1997) UNION ALL SELECT 'no_line_keys_in_diffs', 0 UNION ALL SELECT 'diff_recompute', (SELECT count(*) FROM ({ORACLE_SQL["book_diff"]}) WHERE from_edition = 1997 OR to_edition = 1997)) SELECT gate, violations, violations = 0 AS passed FROM gates""")
def decade_gates(t):
    """A series that lost an edition, against the recompute from the lake."""
    return _reported(t, phase_gates.decade_gates_from_lake(_series(t).where("edition <> 1997"), _budget_lines(t), 2000))


@_query("""WITH d AS (SELECT * FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2')), g AS (
    SELECT 'uncovered' AS gate, (SELECT count(DISTINCT p_brand) FROM part WHERE p_brand = 'Brand#2') AS violations
    UNION ALL SELECT 'silent_unreconciled', (SELECT count(*) FROM d WHERE p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_partkey % 2 = 0)))
  SELECT gate, violations, violations = 0 AS passed FROM g""")
def reconciliation_gaps(t):
    """Programs without details or a declared gap, and details that are unreconciled without a failed check."""
    lines = t("part").select(c("p_brand").alias("pe_bli"), c("p_name").alias("title"))
    state = F.when(c("p_partkey") % 3 == 0, F.lit(None)).when(c("p_partkey") % 3 == 1, F.lit(False)).otherwise(F.lit(True))
    detailed = t("part").where(~c("p_brand").isin("Brand#1", "Brand#2"))  # one brand is a declared gap, one is uncovered
    details = detailed.select(c("p_brand").alias("pe_bli"), c("p_partkey").alias("document_id"), F.lit("PriorYear").alias("scenario"), state.alias("reconciled"))
    checks = details.select("document_id", "pe_bli", "scenario", (c("document_id") % 2 == 0).alias("passed"))
    gaps = lines.sparkSession.createDataFrame([("Brand#1",)], "pe_bli string")
    return _reported(t, phase_gates.reconciliation_gaps(lines, details, gaps, checks))


@_query(f"""WITH {_EDGES}, u AS (SELECT DISTINCT * FROM (SELECT src AS node, dst AS other FROM s UNION ALL SELECT dst, src FROM s)), g AS (SELECT 'evidence_verbatim' AS gate, 0 AS violations UNION ALL SELECT 'family_partition', 0 UNION ALL SELECT 'store_equals_lake', (SELECT count(*) FROM s WHERE relation = 'renamed')) SELECT gate, violations, violations = 0 AS passed FROM g""")
def lineage_gates(t):
    """Evidence, families as components, and a store that lost edges."""
    from tallyspark.operators.graph import connected_components

    told = _narratives(t)
    edges = written(succession.stated_edges(told), "lineage-gates")  # every gate reads them
    families = connected_components(edges, "src", "dst").select("node", F.xxhash64("component").alias("family"))
    return _reported(t, phase_gates.lineage_gates(edges, told, families, edges.where("relation <> 'renamed'")))


@_query("""WITH l AS (SELECT p_brand, count(*) AS n FROM part GROUP BY ALL), d AS (SELECT p_brand, least(5, count(*)) AS n FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL), e AS (SELECT p_brand, count(DISTINCT p_type) AS n FROM part GROUP BY ALL)
  SELECT b.p_brand AS pe_bli, coalesce(l.n, 0) AS n_lines, coalesce(d.n, 0) AS n_projects, coalesce(e.n, 0) AS n_events FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN l USING (p_brand) LEFT JOIN d USING (p_brand) LEFT JOIN e USING (p_brand)""")
def program_bundle(t):
    """One document a program: its lines, its largest projects in the ledger, its events."""
    part = t("part")
    brand = c("p_brand").alias("pe_bli")
    lines = part.select(brand, c("p_size").alias("fiscal_year"), c("p_type").alias("amount_type"), c("p_partkey").alias("amount_thousands"))
    details = part.select(brand, _text("p_partkey").alias("project_number"), c("p_retailprice").alias("amount_millions"), _text("p_partkey").alias("fact_id"))
    found = gates.program_bundle(
        part.select(brand).distinct().withColumn("title", F.lit("t")), lines, details, part.where("p_partkey % 3 <> 0").select(_text("p_partkey").alias("fact_id")), lines.where("false").select("pe_bli", F.lit("a").alias("award_piid"), F.lit("high").alias("confidence")),
        events=part.select(brand, c("p_type").alias("event")).distinct(),
    )
    size = lambda name: F.coalesce(F.json_array_length(F.get_json_object("document", f"$.{name}")), F.lit(0))
    return found.select("pe_bli", size("lines").cast("bigint").alias("n_lines"), size("projects").cast("bigint").alias("n_projects"), size("events").cast("bigint").alias("n_events"))


@_query("""WITH p AS (SELECT 'x' || p_partkey AS pe_bli, p_partkey % 4 AS kind, p_name, p_size FROM part)
  SELECT pe_bli, 'N' AS org, 'R-2' AS exhibit_family, 2 AS project_count, p_size::DOUBLE AS prior_millions, p_size % 2 = 0 AND p_size % 3 <> 0 AS fully_reconciled, p_size % 2 = 0 AS reconciled_in_scope, 'A1' AS account, 'title A1' AS account_title, 'T1 ' || p_name AS title FROM p WHERE kind <> 2
  UNION ALL SELECT pe_bli, 'N', NULL, 0, NULL, NULL, NULL, 'A2', 'title A2', 'T2 ' || p_name FROM p WHERE kind = 1""")
def dim_programs(t):
    """The program dimension: details counted once over two volumes, the account by the prior amount, a row of its own for an account no detail reaches."""
    key, kind = F.concat(F.lit("x"), _text("p_partkey")), c("p_partkey") % 4
    row = lambda condition, account, slot, amount, title: t("part").where(condition).select(
        F.lit(2026).alias("fiscal_year"), key.alias("pe_bli"), F.lit(account).alias("account"), F.lit(f"title {account}").alias("account_title"), F.lit("N").alias("organization"), F.lit(slot).alias("amount_type"), amount.alias("amount_thousands"), F.concat(F.lit(title), c("p_name")).alias("title")
    )
    lines = row("true", "A1", "fy_2026_total", F.lit(5.0), "T1 ")
    for more in (row("true", "A1", "fy_2024_actuals", c("p_size") * 1000.0, "T1 "), row("p_partkey % 4 = 1", "A2", "fy_2026_total", F.lit(9.0), "T2 "), row("p_partkey % 4 = 1", "A2", "fy_2024_actuals", F.lit(0.5), "T2 ")):
        lines = lines.unionByName(more)
    even = c("p_size") % 2 == 0
    facts = F.array(
        F.struct(F.lit(None).cast("string").alias("project_number"), F.lit("PriorYear").alias("scenario"), c("p_size").cast("double").alias("amount_millions"), F.lit("x").alias("xml_path"), F.lit(True).alias("reconciled")),
        *[F.struct(F.lit(k).alias("project_number"), F.lit("PriorYear").alias("scenario"), (c("p_size") / 2).alias("amount_millions"), F.lit(f"x{k}").alias("xml_path"), even.alias("reconciled")) for k in ("1", "2")],
        F.struct(F.lit(None).cast("string").alias("project_number"), F.lit("AllPriorYears").alias("scenario"), F.lit(9.0).alias("amount_millions"), F.lit("x").alias("xml_path"), (c("p_size") % 3 != 0).alias("reconciled")),
    )
    details = t("part").where(kind != 2).select(key.alias("pe_bli"), F.lit(2026).alias("fiscal_year"), F.lit(None).cast("string").alias("account"), F.lit("N").alias("org"), F.lit("R-2").alias("exhibit_family"), F.inline(facts))
    told = t("part").where("false").select(key.alias("pe_bli"), F.lit(2026).alias("fiscal_year"), c("p_name").alias("title"))
    return marts.dim_programs(lines, details.unionByName(details), told, 2026, "fy_2026_total", "fy_2024_actuals")
