"""Column functions: safe casts, codes, fiscal calendar, ids, names and canonical text."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that end a company's legal name.
LEGAL_SUFFIXES = [
    "INC", "INCORPORATED", "LLC", "LLP", "LP", "LTD", "LIMITED", "CORP", "CORPORATION",
    "CO", "COMPANY", "PLC", "GMBH", "SA", "AG", "PTY", "JV", "TRUST",
    "FOUNDATION", "REALTY",
]
# Word sequences that name a division, in order of preference.
DIVISIONS = [
    "AEROSPACE OPERATIONS I", "AEROSPACE OPERATIONS", "NORTH AMERICAN", "CAPITAL", "SYSTEMS CORPORATION", "SYSTEMS CORP",
    "DEFENSE SYSTEMS", "GOVERNMENT SYSTEMS", "INFORMATION TECHNOLOGY", "INFORMATION SYSTEMS", "MISSION SYSTEMS", "GLOBAL",
    "TACTICAL SYSTEMS",
]
# Heads too general to stand for a company alone.
GENERIC_HEADS = [
    "UNITED", "GENERAL", "NATIONAL", "AMERICAN", "GLOBAL", "FIRST", "ADVANCED", "INTERNATIONAL", "DELTA",
    "APEX", "ALPHA", "OMEGA", "PRECISION", "MARITIME",
]
# Agency prefix by the service letter that ends an account.
ACCOUNT_AGENCIES = {"D": "097", "N": "017", "A": "021", "F": "057"}


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def safe_number(text: Column, kind: str = "double") -> Column:
    """A number where the text is one, else null. Whole kinds go through double and round half up."""
    number = F.trim(text.cast("string")).try_cast("double")
    return number if kind == "double" else F.round(number).try_cast(kind)


def is_true(text: Column) -> Column:
    return F.lower(F.trim(text)) == "true"


def cents(amount: Column) -> Column:
    """Money as whole cents, so that sums are exact."""
    return F.round(amount * 100).cast("bigint")


def fiscal_year(day: Column) -> Column:
    """October to December belong to the next year."""
    return F.year(day) + (F.month(day) >= 10).cast("int")


def recode(value: Column, table: dict, otherwise: Column | None = None) -> Column:
    """Values by a small literal map; others become ``otherwise``."""
    mapped = F.element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), value)
    return mapped if otherwise is None else F.coalesce(mapped, otherwise)


def canonical_code(code: Column, table: dict[str, str]) -> Column:
    """Case-insensitive code map; unknown codes in upper case."""
    return recode(F.lower(F.trim(code)), {k.lower(): v for k, v in table.items()}, F.upper(F.trim(code)))


def banded(value: Column, cuts: list[float], labels: list[str], missing: str | None = None) -> Column:
    """The label of the half-open band that holds ``value``: below cuts[0], below cuts[1], and so on."""
    band = F.when(value.isNull(), F.lit(missing))
    for cut, label in zip(cuts, labels, strict=False):
        band = band.when(value < cut, label)
    return band.otherwise(labels[-1])


def hhi_band(value: Column) -> Column:
    return banded(value, [1500, 2500], ["unconcentrated", "moderate", "high"])


def offers_bucket(offers: Column) -> Column:
    """Number of offers in six classes; unknown for null, non-numbers and less than 1."""
    return banded(F.coalesce(safe_number(offers, "int"), F.lit(0)), [1, 2, 3, 5, 10], ["unknown", "1", "2", "3-4", "5-9", "10+"])


def fact_id(*parts: Column, absent_as_empty: tuple[int, ...] = ()) -> Column:
    """16 hex digits of the SHA-256 over the parts joined by ``|``; a null part gives null, but for the named ones."""
    text = [F.coalesce(p.cast("string"), F.lit("")) if k in absent_as_empty else p.cast("string") for k, p in enumerate(parts)]
    joined = F.concat(*list(chain(*[(F.lit("|"), t) for t in text]))[1:])
    return F.substring(F.sha2(joined, 256), 1, 16)


def federal_account(account: Column, fallback: str = "097") -> Column:
    """``1319N`` to ``017-1319``: the closing service letter names the agency."""
    letter = F.regexp_extract(account, r"^(\d{4})([A-Z])$", 2)
    agency = F.coalesce(recode(F.nullif(letter, F.lit("")), ACCOUNT_AGENCIES), F.lit(fallback))
    return F.concat(agency, F.lit("-"), F.regexp_extract(account, r"^(\d{4})", 1))


def line_key(account: Column, organization: Column, line: Column) -> Column:
    """``account-organization-Lline``; null where a part is null or blank."""
    parts = [blank_to_null(c.cast("string")) for c in (account, organization, line)]
    return F.concat(parts[0], F.lit("-"), parts[1], F.lit("-L"), parts[2])


def is_line_key(key: Column) -> Column:
    return key.rlike(r"^[0-9]{4}[A-Z]-[A-Z]+-L")


def line_anchor(key: Column) -> Column:
    """The line number that a line key stands for, null for other keys: what a book prints beside the line."""
    return F.nullif(F.regexp_extract(key, r"^[0-9]{4}[A-Z]-[A-Z]+-L(.+)$", 1), F.lit(""))


# What books call an organisation, and its workbook code.
ORG_ALIASES = {
    "Joint_Urgent_Operational_Needs_Fund": "DEFW", "Missile_Defense_Agency": "MDA", "Office_of_Secretary_Of_Defense": "OSD", "Operational_Test_Evaluation_Defense": "OTE",
    "United_States_Special_Operations_Command": "SOCOM", "Washington_Headquarters_Service": "WHS", "Defense_Wide": "DW", "Defense-Wide": "DW",
}


def workbook_org(org: Column, aliases: dict[str, str] = ORG_ALIASES) -> Column:
    """The workbook code of an organisation as its book calls it; other names stay."""
    return recode(org, aliases, org)


def book_orgs(workbook: Column, aliases: dict[str, str] = ORG_ALIASES) -> Column:
    """All names under which books may list a workbook code, the code itself first: ``workbook_org`` the other way round."""
    names: dict[str, list[str]] = {}
    for name, code in aliases.items():
        names.setdefault(code, []).append(name)
    table = F.create_map(*[x for code, found in names.items() for x in (F.lit(code), F.array(*map(F.lit, found)))])
    return F.concat(F.array(workbook), F.coalesce(F.element_at(table, workbook), F.array().cast("array<string>")))


def plain_quotes(text: Column) -> Column:
    """Typographic quotes and dashes to ASCII, white space runs to one space."""
    return F.trim(F.regexp_replace(F.translate(text, "‘’“”–—", "''\"\"--"), r"\s+", " "))


def canonical_number(value: Column) -> Column:
    """Four decimals without closing zeros, as answers are compared."""
    return F.regexp_replace(F.format_string("%.4f", value.cast("double")), r"\.?0+$", "")


def normalized_name(name: Column) -> Column:
    """A company's name without case, punctuation, THE, legal endings and division endings.

    A division ending stays where only one generic head would be left. Null is an empty name. Costs a few
    regular expressions a row: run it over distinct names.
    """
    suffix, division, generic = "|".join(LEGAL_SUFFIXES), "|".join(DIVISIONS), "|".join(GENERIC_HEADS)
    text = F.upper(F.coalesce(name, F.lit("")))
    text = F.regexp_replace(text, r"(?<=[A-Z])\.(?=[A-Z])", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, "[^A-Z0-9 ]+", " "), " +", " "))
    text = F.regexp_replace(text, "^(?:THE(?: |$))+", "")
    text = F.trim(F.regexp_replace(text, f"(?:(?:^| )(?:{suffix}|THE))+$", ""))
    # all division endings at once; a generic head keeps the first of several
    return F.regexp_replace(text, f"^(?!(?:{generic}) (?:{division})$)((?:{generic}) (?:{division})(?= )|.+?)(?: (?:{division}))+$", "$1")


def family_of(parent_id: Column, parent_name: Column, own_id: Column, own_name: Column) -> Column:
    """struct(method, key): the parent's id, else a normalised name, else the recipient's id."""
    name = lambda c: F.nullif(normalized_name(c), F.lit(""))
    keyed = lambda method, key: F.when(key.isNotNull(), F.struct(F.lit(method).alias("method"), key.alias("key")))
    return F.coalesce(
        keyed("uei", blank_to_null(parent_id)), keyed("name", name(parent_name)), keyed("name", name(own_name)),
        keyed("uei", F.coalesce(blank_to_null(own_id), F.lit("UNKNOWN"))),
    )
