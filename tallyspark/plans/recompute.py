"""Second evaluations of published marts from the lake, in plain SQL that shares nothing with the marts themselves.

A gate that compares a mart with these turns red when the mart's code is wrong, not only when its table is stale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# The slugs that may hold each kind of amount, how many years before the edition they lie, and which comes first.
SLUGS = """
  VALUES ('actuals', 2, 1, 'actuals'), ('actuals', 2, 2, 'base_oco'), ('actuals', 2, 3, 'actual'),
    ('enacted', 1, 1, 'total'), ('enacted', 1, 2, 'enacted'), ('enacted', 1, 3, 'total_enacted'), ('enacted', 1, 4, 'less_supplementals_enacted'),
    ('enacted', 1, 5, 'pb_request_with_cr_amounts'), ('enacted', 1, 6, 'pb_request_with_cr_adjustments'), ('enacted', 1, 7, 'enactment'),
    ('enacted', 1, 8, 'total_enacted_base_emerg_oco'), ('enacted', 1, 9, 'total_pb_requests_with_cr_adj_base_oco'),
    ('enacted', 1, 10, 'total_pb_requests_with_cr_adj_base_oco_saa'), ('enacted', 1, 11, 'total_pb_requests_with_cr_adj_base_oco_emergency'),
    ('request', 0, 1, 'total'), ('request', 0, 2, 'disc_request'), ('request', 0, 3, 'request'), ('request', 0, 4, 'total_base_oco')
  AS s(kind, back, priority, word)
"""

SERIES = """
WITH slugs AS (SELECT * FROM (""" + SLUGS + """)),
programs AS (SELECT * FROM {lines} WHERE pe_bli <> '9999999999'),
slots AS (
  SELECT pe_bli, count(DISTINCT account) > 1 AS accounts, count(DISTINCT organization) > 1 AS organizations
  FROM programs WHERE fiscal_year = {anchor} AND title IS NOT NULL GROUP BY pe_bli, amount_type
),
collides AS (SELECT pe_bli, bool_or(accounts) AS accounts, bool_or(organizations) AS organizations FROM slots GROUP BY pe_bli),
cells AS (
  SELECT p.pe_bli, p.fiscal_year AS edition, s.kind, s.back, s.priority, CASE WHEN c.accounts THEN p.account END AS account,
    CASE WHEN c.organizations THEN p.organization END AS organization, p.exhibit, p.source_document_id, p.amount_thousands
  FROM programs p JOIN slugs s ON s.word = regexp_extract(p.amount_type, '^fy_[0-9]{{4}}_(.+)$', 1) AND s.back = p.fiscal_year - try_cast(substr(p.amount_type, 4, 4) AS INT)
  LEFT JOIN collides c ON c.pe_bli = p.pe_bli
),
detailed AS (
  SELECT pe_bli, edition, kind, back, account, organization, priority, sum(amount_thousands) AS amount
  FROM cells WHERE exhibit IN ('R-1', 'P-1') AND source_document_id IS NOT NULL GROUP BY ALL
),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pe_bli, edition, kind, account, organization ORDER BY priority) AS place FROM detailed) WHERE place = 1
),
lake AS (
  SELECT pe_bli, edition, kind, account, organization, priority, sum(amount_thousands) AS amount
  FROM cells WHERE exhibit <> 'P-1R' GROUP BY ALL
)
SELECT f.pe_bli, f.edition - f.back AS fy, f.edition, f.kind, f.account, f.organization, f.amount
FROM firsts f LEFT SEMI JOIN lake l
  ON f.pe_bli = l.pe_bli AND f.edition = l.edition AND f.kind = l.kind AND f.account <=> l.account AND f.organization <=> l.organization AND abs(l.amount - f.amount) <= {tolerance}
"""

DIFFS = """
WITH usable AS (SELECT * FROM {series} WHERE NOT coalesce(pe_bli RLIKE '^[0-9]{{4}}[A-Z]-[A-Z]+-L', false)),
pairs AS (
  SELECT r.pe_bli, r.account, r.organization, r.edition AS from_edition, t.edition AS to_edition, 'request_vs_request' AS diff_kind, t.amount - r.amount AS delta
  FROM usable r JOIN usable t ON r.pe_bli <=> t.pe_bli AND r.account <=> t.account AND r.organization <=> t.organization AND t.edition = r.edition + 1
  WHERE r.kind = 'request' AND t.kind = 'request'
  UNION ALL
  SELECT r.pe_bli, r.account, r.organization, r.edition, t.edition, 'request_vs_actuals', t.amount - r.amount
  FROM usable r JOIN usable t ON r.pe_bli <=> t.pe_bli AND r.account <=> t.account AND r.organization <=> t.organization AND t.edition = r.edition + 2 AND t.fy = r.fy
  WHERE r.kind = 'request' AND t.kind = 'actuals'
)
SELECT * FROM pairs
"""


def series(lines: DataFrame, anchor_edition: int, tolerance: float = 0.5) -> DataFrame:
    """pe_bli, fy, edition, kind, account, organization and amount of the decade series, from budget lines."""
    return lines.sparkSession.sql(SERIES, lines=lines, anchor=anchor_edition, tolerance=tolerance)


def diffs(found: DataFrame) -> DataFrame:
    """pe_bli, account, organization, editions, kind and delta of the book diffs, from a decade series."""
    return found.sparkSession.sql(DIFFS, series=found)
