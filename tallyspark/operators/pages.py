"""Finding facts, candidates and articles in page and narrative texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.matching import money_mentions
from tallyspark.sources.html import elements_of_pages

# Exhibit markers on budget-book pages.
EXHIBIT = r"Exhibit\s+(R-2A|R-2|R-1|R-3|R-4A|R-4|P-40A|P-40|P-1|P-5|P-3A|P-21|P-10)\b"
# What a contract number, a defined acronym, a title that is a heading and a designator look like in announcements and narratives; how many
# characters before a number may name it as one that is referred to.
CONTRACT_NUMBER = r"\b([A-Z][A-Z0-9]{4,5}[- ]?\d{2}[- ]?[A-Z][- ]?[A-Z0-9]{4})\b"
LOOK_BACK, LOOK_BACK_NEAR = 30, 12
ACRONYM = r"\b([A-Z][A-Za-z0-9&/.-]*(?:[ -][A-Z0-9][A-Za-z0-9&/.-]*){1,7}\s+\([A-Z]{2,10}[0-9]{0,3}\))"
TITLE_JUNK = r"(?i)^(accomplishments|plans|title|description|articulat|congressional|program change|other program funding|acquisition strategy|performance metrics|n/a|none)\b"
DESIGNATOR = r"\b((?:AN/[A-Z]{3}-\d{1,3}[A-Z]?|[A-Z]{1,4}-\d{1,4}[A-Z]?|(?:DDG|CVN|SSN|SSBN|LPD|LHA|LCS|FFG|T-AO)\s?\d{2,4}))\b"


def renderings(millions: Column) -> Column:
    """How a page may print an amount: millions with three decimals, whole thousands, each with and without commas."""
    thousands = F.round(millions * 1000).cast("bigint")
    texts = F.array(F.format_number(millions, 3), F.format_string("%.3f", millions.cast("double")), F.format_number(thousands, 0), thousands.cast("string"))
    return F.array_distinct(texts)


def numbers(text: Column) -> Column:
    """The distinct printed numbers of a text, whole: ``1,234.500`` is one, and ``34.500`` isn't in it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![\d,.])(\d[\d,]*(?:\.\d+)?)(?!\d)"), 1))


def _classes(pages: DataFrame, made: Column, name: str) -> DataFrame:
    """Each different text of a document once: text_key, its first page, how many pages have it (n_pages), what is ``made`` of it.

    Arrays made are exploded with ``explode_outer``: the filter that an ``explode`` brings is pushed below the grouping, and
    would make them of every page.
    """
    # grouped by the text itself, so that the costly part is done after the shuffle, once a text and by all tasks
    texts = pages.groupBy("document_id", "text").agg(F.min("page").alias("page"), F.count("*").alias("n_pages"))
    return texts.select("document_id", "page", _text_key().alias("text_key"), "n_pages", made.alias(name))


def _text_key() -> Column:
    return F.sha2("text", 256)


def _judged(met: DataFrame, pages: DataFrame, item: str, checks: dict[str, Column]) -> DataFrame:
    """Each candidate text of an item with ``checks`` of what was asked for against it: item, page, n_pages, the checks.

    met: document_id, page, text_key, n_pages (of ``_classes``), and the item, a struct whose fields the checks read as
    ``asked``. All that is asked of a text is gathered first, so it moves and is read once, whatever the number of candidates;
    the checks may use ``text``, ``even``, ``words``, ``page_exhibit`` and the fields of ``asked``.
    """
    key = ["document_id", "page", "text_key"]
    gathered = met.groupBy(*key, "n_pages").agg(F.collect_list(item).alias("asked"))
    told = pages.select("document_id", "page", _text_key().alias("text_key"), "text").join(gathered, key).withColumns({
        "even": _evened(F.col("text")), "words": F.array_distinct(F.split("text", "[^A-Za-z0-9]+")), "page_exhibit": F.regexp_extract("text", EXHIBIT, 1),
    })
    each = F.transform("asked", lambda a: F.struct(a.alias(item), *[F.coalesce(check(a), F.lit(False)).alias(name) for name, check in checks.items()]))
    judged = told.select("page", "text_key", "n_pages", F.explode(each).alias("x")).select("page", "text_key", "n_pages", "x.*")
    return judged.distinct()  # a page may be given twice


def _narrowed(found: DataFrame, item: str, ties: list[str]) -> DataFrame:
    """The first page of each item after narrowing by one tie-break after another, never to none: page, left, candidate_pages.

    Candidates are first summed up by what they hold, so the windows see a few rows an item.
    """
    one = Window.partitionBy(item)
    kept = found.groupBy(item, *ties).agg(F.min("page").alias("page"), F.sum("n_pages").alias("n_pages")).withColumn("candidate_pages", F.sum("n_pages").over(one))
    for tie in ties:
        kept = kept.withColumn("any_left", F.max(tie).over(one)).where(F.col(tie) | ~F.col("any_left"))
    return kept.groupBy(item).agg(F.min("page").alias("page"), F.sum("n_pages").alias("left"), F.max("candidate_pages").alias("candidate_pages"))


def _evened(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def fact_pages(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """The page of each fact (fact_id, document_id, pe_bli, project_number, exhibit, amount_millions).

    pages: document_id, page, text. Candidates name the code and print the amount: printed numbers and renderings
    meet in an equi join. They are narrowed to the fact's exhibit, then to its project, never to none; the first
    remaining page is taken, ``unique`` if it is the only one. Facts that ask for the same are looked up once, and so are
    pages of the same text.
    """
    amount = F.col("amount_millions")
    # facts that ask for the same are one question, and pages of one text one place, so copies make no pairs
    keyed = facts.withColumn("fact", F.struct("document_id", "pe_bli", "project_number", "exhibit", "amount_millions"))
    asked = keyed.where(amount.isNotNull() & (amount != 0)).select("fact").distinct().select("fact", "fact.document_id", F.explode(renderings(F.col("fact.amount_millions"))).alias("number"))
    # numbers meet without the text they are in; only texts that print a wanted number are read for the rest
    printed = _classes(pages, numbers(F.col("text")), "printed").select("document_id", "page", "text_key", "n_pages", F.explode_outer("printed").alias("number"))
    met = asked.join(printed, ["document_id", "number"]).drop("number").distinct()
    found = _judged(met, pages, "fact", {
        "names": lambda a: F.contains(F.col("text"), a["pe_bli"]), "on_exhibit": lambda a: F.col("page_exhibit") == a["exhibit"],
        "on_project": lambda a: F.array_contains(F.col("words"), a["project_number"]),
    }).where("names")
    joined = keyed.select("fact_id", "amount_millions", "fact").join(_narrowed(found, "fact", ["on_exhibit", "on_project"]), "fact", "left")
    state = F.when(amount == 0, "zero_amount").when(F.col("page").isNull(), "unresolved").when(F.col("left") == 1, "unique").otherwise("ambiguous_first")
    return joined.select("fact_id", "page", state.alias("resolution"), F.coalesce("candidate_pages", F.lit(0)).alias("candidate_pages"))


SHINGLE = 8
OPENING = 12  # fixed value: how many words of a narrative are looked for


def _shingles(words: Column, lengths: list[int]) -> Column:
    """Hashes of all runs of each of ``lengths`` words, each once."""
    none = F.array().cast("array<bigint>")

    def runs(w: Column, n: int) -> Column:
        run = lambda k: F.xxhash64(F.lit(n), F.array_join(F.slice(w, k, n), " "))
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), run)).otherwise(none)

    # bound to a variable, the words are split once a text and not once a run
    return F.array_distinct(F.flatten(F.flatten(F.transform(F.array(words), lambda w: F.array(*[runs(w, n) for n in lengths])))))


def narrative_pages(narratives: DataFrame, pages: DataFrame, words: int = OPENING) -> DataFrame:
    """The page of each narrative (narrative_id, document_id, body; by choice pe_bli, project_number, exhibit).

    A page is a candidate where the narrative's opening words stand, white space evened out. Pages are indexed by hashes
    of their runs of ``SHINGLE`` words (and of as many as shorter openings have), which openings meet in an equi join by
    their first run; only then is a page read for the whole opening. Candidates are narrowed to pages that name the
    code, then to the exhibit and the project, never to none. Narratives that open alike are looked up once, and so are
    pages of the same text.
    """
    given = [c for c in ("pe_bli", "project_number", "exhibit") if c in narratives.columns]
    opening = F.slice(F.split(_evened(F.col("body")), " "), 1, words)
    # narratives that open alike and ask for the same are one question, and pages of one text one place, so copies make no pairs
    keyed = narratives.withColumn("told", F.when(_evened(F.col("body")) != "", F.struct("document_id", *given, opening.alias("opening"))))
    short = [r.n for r in keyed.where("told IS NOT NULL").select(F.least(F.size("told.opening"), F.lit(SHINGLE)).alias("n")).distinct().collect()]  # 8 lengths at most
    lengths = sorted(short)
    if not lengths:
        return narratives.select("narrative_id", F.lit(None).cast("int").alias("page"), F.lit("unresolved").alias("resolution"), F.lit(0).cast("bigint").alias("candidate_pages"))
    size = F.least(F.size("told.opening"), F.lit(SHINGLE))
    first = F.xxhash64(size, F.array_join(F.slice("told.opening", F.lit(1), size), " "))
    asked = keyed.where("told IS NOT NULL").select("told").distinct().select("told", "told.document_id", first.alias("shingle"))
    index = _classes(pages, _shingles(F.split(_evened(F.col("text")), " "), lengths), "shingles").select("document_id", "page", "text_key", "n_pages", F.explode_outer("shingles").alias("shingle"))
    index = index.join(asked.select("document_id", "shingle").distinct(), ["document_id", "shingle"], "left_semi")
    met = index.join(asked, ["document_id", "shingle"]).drop("shingle")
    spaced = lambda text: F.concat(F.lit(" "), text, F.lit(" "))
    checks = {"names": lambda a: F.contains(spaced(F.col("even")), spaced(F.array_join(a["opening"], " ")))}
    ties = {
        "pe_bli": ("on_code", lambda a: F.contains(F.col("even"), a["pe_bli"])), "exhibit": ("on_exhibit", lambda a: F.col("page_exhibit") == a["exhibit"]),
        "project_number": ("on_project", lambda a: F.array_contains(F.col("words"), a["project_number"])),
    }
    checks |= {name: check for column, (name, check) in ties.items() if column in given}
    found = _judged(met, pages, "told", checks).where("names")
    joined = keyed.select("narrative_id", "told").join(_narrowed(found, "told", [n for n in checks if n != "names"]), "told", "left")
    state = F.when(F.col("page").isNull(), "unresolved").when(F.col("left") == 1, "unique").otherwise("ambiguous_first")
    return joined.select("narrative_id", "page", state.alias("resolution"), F.coalesce("candidate_pages", F.lit(0)).alias("candidate_pages"))


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def announcement_date(html: Column) -> Column:
    """The day that an announcement's title or address names (``Contracts For May 3, 2024``), null where neither does."""
    named = r"(?i)contracts?[\s-]+for[\s-]+([a-z]{3})[a-z]*\.?[\s-]*(\d{1,2})(?:,?\s+|-)(\d{4})"
    part = lambda k: F.regexp_extract(html, named, k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(1)))
    return F.when(month > 0, F.try_to_date(F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(2), 2, "0")), "yyyy-MM-dd"))


def contract_numbers(text: Column) -> Column:
    """Every contract number of a text in order: as it is written, bare, and whether the text refers to it or awards it.

    A number that ``contract`` stands right before, or ``to contract`` shortly before, is referred to. Each occurrence is
    judged by what stands before it.
    """

    def one(written: Column, between: Column, number: Column, k: Column) -> Column:
        # a number takes 13 characters at least, so what stands up to LOOK_BACK before lies in the last three stretches
        near = [F.coalesce(F.concat(F.get(between, k - back), F.get(written, k - back)), F.lit("")) for back in (2, 1)]
        before = F.lower(F.right(F.concat(*near, F.get(between, k)), F.lit(LOOK_BACK)))
        refers = F.contains(F.right(before, F.lit(LOOK_BACK_NEAR)), F.lit("contract ")) | F.contains(before, F.lit("to contract"))
        bare = F.regexp_replace(number, "[- ]", "")
        return F.struct(number.alias("raw"), bare.alias("piid"), F.when(refers, "referenced").otherwise("award").alias("role"))

    # bound to a variable, the text is read once and not once a number
    read = F.struct(F.regexp_extract_all(text, F.lit(CONTRACT_NUMBER), 1).alias("written"), F.split(text, CONTRACT_NUMBER).alias("between"))
    return _bound(read, lambda x: F.transform(x["written"], lambda number, k: one(x["written"], x["between"], number, k)))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _stretches(rows: Column, marks: Column, no_mark: Column) -> Column:
    """A list cut at its marks: (mark, rows) of what lies before the first (``no_mark``) and of each mark with what follows it.

    marks: structs (at, mark) in order, ``at`` counting the list from 0. The stretches together are as long as the list.
    """
    all_marks = F.concat(F.array(F.struct(F.lit(0).alias("at"), no_mark.alias("mark"))), marks)

    def cut(found):
        after = lambda k: F.coalesce(F.get(found, k + 1)["at"], F.size(rows))
        return F.transform(found, lambda m, k: F.struct(m["mark"].alias("mark"), F.slice(rows, m["at"] + 1, after(k) - m["at"]).alias("rows")))

    return _bound(all_marks, cut)


def contract_records(articles: DataFrame, services: list[str]) -> DataFrame:
    """Award paragraphs of announcement articles (article_id, html): day, service header carried forward, numbers, amounts.

    ``numbers`` has every number with its role, ``piids`` the different ones, ``referenced`` those that are referred to
    at least once. A header is short, begins with a service and names no money; it holds up to the next one. An article is
    read once and stays one row until its awards are listed, so nothing is shuffled.
    """
    text = F.col("text")
    # explodes are outer ones, as the filter that another brings would make the lists a second time
    read = elements_of_pages(articles.select("article_id", announcement_date(F.col("html")).alias("announced"), "html"), "html", ["p"], ("nth", "text"))

    def header(told: Column) -> Column:
        head = F.upper(F.regexp_replace(told, r"[ *]+$", ""))
        is_head = head.rlike("^(" + "|".join(services) + ")") & (F.char_length(head) < 60) & ~F.contains(told, F.lit("$"))
        return F.when(is_head, F.regexp_replace(head, r"\.+$", ""))

    rows = F.filter("elements", lambda e: e["text"] != "")
    heads = lambda r: F.filter(F.transform(r, lambda e, k: F.struct(k.alias("at"), header(e["text"]).alias("mark"))), lambda m: m["mark"].isNotNull())
    sections = _bound(rows, lambda r: _stretches(r, heads(r), F.lit(None).cast("string")))
    placed = read.select("article_id", "announced", F.explode_outer(sections).alias("section"))
    paragraphs = F.when(F.col("section.mark").isNull(), F.col("section.rows")).otherwise(F.slice("section.rows", 2, F.greatest(F.size("section.rows"), F.lit(1))))
    placed = placed.select("article_id", "announced", F.col("section.mark").alias("service"), F.explode_outer(paragraphs).alias("p")).select("article_id", "announced", "service", F.col("p.nth").alias("pos"), "p.text")
    contractor = F.regexp_replace(F.substring_index("text", ",", 1), r"^[ *]+|[ *]+$", "")
    found = placed.where(text.rlike(CONTRACT_NUMBER)).withColumn("numbers", contract_numbers(text))
    piids = F.array_distinct(F.transform("numbers", lambda n: n["piid"]))
    referenced = F.array_distinct(F.transform(F.filter("numbers", lambda n: n["role"] == "referenced"), lambda n: n["piid"]))
    amounts = F.slice(money_mentions(text), 1, 4)
    return found.select("article_id", "pos", "service", contractor.alias("contractor"), "numbers", piids.alias("piids"), referenced.alias("referenced"), amounts.alias("amounts"), "text", "announced")


def lexicon_candidates(narratives: DataFrame, programs: DataFrame | None = None, *, quotes: int = 3, around: int = 60, designator_around: int = 90, longest_quote: int = 220) -> DataFrame:
    """Names that narratives (pe_bli, title, body) define or use, per program, with a few quotes each.

    A defined acronym is a name with and without its words. Titles that are a form's headings name nothing, nor do
    made keys (ending in -L and a number) or, if ``programs`` (pe_bli) is given, keys that aren't among it.
    ``shared``: several programs have the name; ``ambiguous_key``: ``programs`` has the key more than once.
    """
    told = narratives.where((F.col("pe_bli") != "") & ~F.col("pe_bli").rlike(r"-L\d+$"))
    keys = told.select("pe_bli", F.lit(False).alias("ambiguous_key")).distinct() if programs is None else programs.groupBy("pe_bli").agg((F.count("*") > 1).alias("ambiguous_key"))
    if programs is not None:
        told = told.join(keys, "pe_bli", "left_semi")
    told = told.withColumn("title", F.when(~F.trim("title").rlike(TITLE_JUNK), F.trim("title")))

    def found(column: str, pattern: str, source: str, around: int) -> DataFrame:
        names = told.select("pe_bli", F.coalesce(column, F.lit("")).alias("t"), F.explode(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(pattern), 1)).alias("name"))
        at = F.greatest(F.call_function("instr", F.col("t"), F.col("name")) - around, F.lit(1))
        return names.select("pe_bli", F.trim(F.regexp_replace("name", r"\s+", " ")).alias("name"), F.lit(source).alias("source"), F.substring(F.col("t"), at, F.char_length("name") + 2 * around).alias("quote"))

    titles = told.where(F.col("title") != "").select("pe_bli", F.regexp_replace("title", r"\s+", " ").alias("name"), F.lit("title").alias("source"), F.col("title").alias("quote"))
    defined = found("body", ACRONYM, "acronym-def", around)
    alone = defined.select("pe_bli", F.regexp_extract("name", r"\(([A-Z]+[0-9]*)\)$", 1).alias("name"), F.lit("acronym").alias("source"), "quote")
    whole = told.select("pe_bli", "title").where("title IS NOT NULL").select("pe_bli", F.explode(F.regexp_extract_all("title", F.lit(DESIGNATOR), 1)).alias("name"), F.lit("designator-title").alias("source"), F.col("title").alias("quote"))
    rows = titles.unionByName(defined).unionByName(alone).unionByName(whole).unionByName(found("body", DESIGNATOR, "designator-body", designator_around))
    rows = rows.where(F.char_length("name").between(3, 90)).withColumn("key", F.lower("name")).withColumn("quote", F.substring("quote", 1, longest_quote))
    place = F.row_number().over(Window.partitionBy("pe_bli", "key").orderBy("source", "quote"))
    kept = rows.withColumn("place", place).where(F.col("place") <= quotes)
    named = kept.groupBy("pe_bli", "key").agg(F.min("name").alias("name"), F.array_sort(F.collect_list(F.struct("source", "quote"))).alias("quotes"))
    spread = named.groupBy("key").agg((F.count("*") > 1).alias("shared"))
    return named.join(spread, "key").join(keys, "pe_bli").select("pe_bli", "key", "name", "quotes", "shared", "ambiguous_key")


def alias_candidates(aliases: DataFrame, titles: DataFrame, most: int = 8, *, money: DataFrame | None = None, mentions: DataFrame | None = None, seeded: DataFrame | None = None) -> DataFrame:
    """Programs whose title contains an alias anywhere, with how many there are and what that allows.

    An alias meets the titles that hold its first three letters (or all of a shorter one) in an equi join, and is then looked
    for whole. By choice beside each: the money (pe_bli, amount) and mentions (pe_bli, n) of its programs, the
    program that the alias is ``seeded`` for (alias, pe_bli), and whether that isn't among the candidates.
    """
    terms = aliases.select(F.upper(F.trim("alias")).alias("alias")).where("alias <> ''").distinct()
    shown = titles.select("pe_bli", F.upper("title").alias("shown")).distinct()
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("shown") - n + 1, F.lit(1))), lambda k: F.substring(F.col("shown"), k, F.lit(n)))
    begun = shown.where("shown IS NOT NULL").select("pe_bli", "shown", F.explode(F.array_distinct(F.flatten(F.array(*map(runs, (1, 2, 3)))))).alias("begin"))
    keyed = terms.select("alias", F.substring("alias", 1, 3).alias("begin"))
    hits = begun.join(keyed, "begin").where(F.contains("shown", F.col("alias"))).select("pe_bli", "alias").distinct()
    beside = hits
    for table, column in ((money, "amount"), (mentions, "n")):
        beside = beside.withColumn(column, F.lit(None).cast("double")) if table is None else beside.join(table.groupBy("pe_bli").agg(F.sum(column).cast("double").alias(column)), "pe_bli", "left")
    counts = beside.groupBy("alias").agg(F.count("*").alias("candidates"), F.array_sort(F.collect_set("pe_bli")).alias("programs"), F.sum("amount").alias("amount"), F.sum("n").alias("mentions"))
    joined = terms.join(counts, "alias", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    seeds = terms.withColumn("seeded", F.lit(None).cast("string")) if seeded is None else seeded.groupBy(F.upper(F.trim("alias")).alias("alias")).agg(F.min("pe_bli").alias("seeded"))
    tier = F.when(F.col("candidates") == 0, "none").when(F.col("candidates") == 1, "sole").when(F.col("candidates") <= most, "ambiguous").otherwise("too_many")
    conflict = F.col("seeded").isNotNull() & ~F.coalesce(F.array_contains("programs", F.col("seeded")), F.lit(False))
    return joined.join(seeds, "alias", "left").select("alias", "candidates", tier.alias("tier"), F.when(F.col("candidates") <= most, F.col("programs")).alias("programs"), "amount", "mentions", "seeded", conflict.alias("seed_conflict"))


def payment_rates(pages: DataFrame) -> DataFrame:
    """Improper-payment pages (page_id, program, agency, html) to yearly rates with the amount they imply.

    The pages' elements are read once, and a page stays one row until its rates are listed, so nothing is shuffled. Outlays
    are the first amount in a summary card, whose year is its ``data-year`` or the year it names; exact rates are attributes
    of a chart, whose year is that of the heading before it, in its own card where there are cards. A year needs both. The
    amount is the rounded share of the outlays.
    """
    read = elements_of_pages(pages.select("page_id", "program", "agency", "html"), "html", columns=("node", "last", "tag", "attributes", "text"))
    has = lambda e, name: F.coalesce(F.array_contains(F.split(e["attributes"]["class"], r"\s+"), name), F.lit(False))
    named = lambda e: F.get(F.regexp_extract_all(e["text"], F.lit(r"FY\s*(\d{4})"), 1), F.lit(0)).cast("int")  # noqa: E731  four digits: a failed cast costs an exception
    first = lambda found: F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))
    elements = F.col("elements")

    # a summary card holds what stands in it, up to the next one
    is_summary = lambda e: (e["tag"] == "div") & has(e, "metrics-summary")
    summaries = F.transform(F.filter(elements, is_summary), lambda e: F.struct(e["node"].alias("at"), e.alias("mark")))
    nothing = F.lit(None).cast(read.schema["elements"].dataType.elementType)

    def card(s):
        inside = F.filter(s["rows"], lambda e: e["node"] <= s["mark"]["last"])
        amount = first(F.transform(inside, lambda e: F.get(money_mentions(_spelled(e["text"])), F.lit(0))))
        return F.struct(F.coalesce(s["mark"]["attributes"]["data-year"].try_cast("int"), first(F.transform(inside, named))).alias("fy"), amount.alias("outlays_usd"))

    cards = F.transform(F.filter(_stretches(elements, summaries, nothing), lambda s: s["mark"].isNotNull()), card)
    # a heading's year holds up to the next heading with a year or the next card
    marks = F.transform(
        F.filter(elements, lambda e: has(e, "usa-card__body") | ((e["tag"] == "h2") & named(e).isNotNull())), lambda e: F.struct(e["node"].alias("at"), F.when(e["tag"] == "h2", named(e)).alias("mark"))
    )
    attribute = lambda e, name: e["attributes"][name].try_cast("double")
    chart = lambda s: F.transform(
        F.filter(s["rows"], lambda e: e["tag"] == "canvas"), lambda e: F.struct(s["mark"].alias("fy"), attribute(e, "data-improper").alias("rate_pct"), attribute(e, "data-unknown").alias("unknown_rate_pct"))
    )
    charts = F.filter(F.flatten(F.transform(_stretches(elements, marks, F.lit(None).cast("int")), chart)), lambda x: x["rate_pct"].isNotNull() & x["fy"].isNotNull())
    outlays = lambda cards, fy: F.array_max(F.transform(F.filter(cards, lambda x: x["fy"] == fy), lambda x: x["outlays_usd"]))
    rates = _bound(cards, lambda found: F.transform(charts, lambda x: F.struct(x["fy"].alias("fy"), x["rate_pct"].alias("rate_pct"), x["unknown_rate_pct"].alias("unknown_rate_pct"), outlays(found, x["fy"]).alias("outlays_usd"))))
    found = read.select("page_id", "program", "agency", F.inline_outer(rates)).where("outlays_usd IS NOT NULL")  # an outer one brings no filter that makes the list again
    amount = F.round(F.col("outlays_usd") * F.col("rate_pct") / 100)
    return found.select("page_id", "fy", "program", "agency", "rate_pct", "unknown_rate_pct", "outlays_usd", amount.alias("derived_improper_amount_usd"))


def _spelled(text: Column) -> Column:
    """``$1,234.5 M`` as ``$1,234.5 million``, and B as billion, so that one reader of money serves both."""
    return F.regexp_replace(F.regexp_replace(text, r"(\$\s?[0-9][0-9,.]*)\s*M\b", "$1 million"), r"(\$\s?[0-9][0-9,.]*)\s*B\b", "$1 billion")
