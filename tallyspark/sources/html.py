"""Web pages as tables of their elements.

A page is read once, tag by tag: the reader keeps the stack of open elements, so text goes to the element that it
stands in, whatever tags, comments, scripts or quoted signs lie between. Each page is read by one task in the place
where its row is; memory follows a page.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that stand in a line of text, elements that never hold anything, elements whose content isn't text.
INLINE = frozenset([
    "a", "abbr", "acronym", "audio", "b", "bdi", "bdo", "big", "br", "button", "canvas", "cite", "code", "data", "del", "dfn", "em", "font", "i", "iframe", "img",
    "input", "ins", "kbd", "label", "map", "mark", "meter", "nobr", "noscript", "object", "output", "picture", "progress", "q", "rp", "rt", "ruby", "s", "samp",
    "select", "small", "span", "strike", "strong", "sub", "sup", "svg", "textarea", "time", "tt", "u", "var", "video", "wbr",
])
EMPTY = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
UNREAD = frozenset(["script", "style", "template"])
# Elements that a start tag of the same row of this table ends, unless an element named in the last column is between.
ENDED_BY = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
NONE_ENDED = (frozenset(), frozenset())

_NAME, _SPACE = r"[A-Za-z][A-Za-z0-9-]*+", r"[ \t\n\r\f]"
_ATTRIBUTE = rf"""{_SPACE}++([A-Za-z][A-Za-z0-9_:-]*+)(?:="([^"]*+)"|='([^']*+)')?+"""
_ATTRIBUTES = "(?:" + re.sub(r"\((?!\?)", "(?:", _ATTRIBUTE) + ")*+"
_ATTRIBUTE_AT = re.compile(_ATTRIBUTE)
# One well-formed piece of markup and the text after it: an end tag, a start tag, a script or style with its content, a comment or a doctype.
_PIECE = re.compile(rf"""(?:
  </({_NAME})>
  |<(?!(?i:script|style)[^A-Za-z0-9-])({_NAME})({_ATTRIBUTES}){_SPACE}*+/?>
  |<((?i:script|style))({_ATTRIBUTES}){_SPACE}*+>[^<]*+(?:<(?!/\s*(?i:script|style))[^<]*+)*+</((?i:script|style))>
  |<!--(?!-?>)[^-]*+(?:-[^-]++)*+-->
  |<!(?i:doctype)[^>]*+>
)([^<]*+)""".replace("\n  ", "").replace("\n)", ")"))


def _attributes(written: str) -> list:
    return [(name.lower(), unescape(double or single)) for name, double, single in _ATTRIBUTE_AT.findall(written)]


class Reader(HTMLParser):
    """Elements of one page in the order of their start tags.

    The text of a block is a list of parts; an element of its line has a stretch of them. Each tag costs as much as it
    closes, however deep it stands.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self._unread = 0
        self.found: list[dict] = []
        self._open: list[dict] = []
        self._blocks: list[dict] = [{"parts": []}]  # the page itself holds what stands in no element
        self._count: dict[str, int] = {}
        self._seen: dict[str, int] = {}

    def read_plain(self, page: str) -> bool:
        """Read a page whose markup is well formed throughout; False, and to be read by ``feed`` anew, if it isn't."""
        at, size = page.find("<"), len(page)
        at = size if at < 0 else at
        self.handle_data(unescape(page[:at]))
        while at < size:
            piece = _PIECE.match(page, at)
            if piece is None:
                return False
            end, start, attrs, raw, raw_attrs, raw_end, text = piece.groups()
            if end:
                self.handle_endtag(end.lower())
            elif start:
                self.handle_starttag(start.lower(), _attributes(attrs) if attrs else [])
            elif raw:
                if raw.lower() != raw_end.lower():
                    return False
                self.handle_starttag(raw.lower(), _attributes(raw_attrs))
                self.handle_endtag(raw.lower())
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
            at = piece.end()
        return True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        inline = tag in INLINE
        if not inline and tag not in UNREAD and (tag not in EMPTY or tag == "hr"):
            self._end_before(tag)
        found, parts = self.found, self._blocks[-1]["parts"]
        parts.append(" ")  # a tag separates words
        nth = self._seen[tag] = self._seen.get(tag, -1) + 1
        attributes = {name: value or "" for name, value in reversed(attrs)} if attrs else {}
        held, begin = (parts, len(parts)) if inline else ([], 0)
        element = {"node": len(found), "last": None, "tag": tag, "nth": nth, "attributes": attributes, "parts": held, "from": begin, "to": None}
        found.append(element)
        if tag in EMPTY:
            self._closed(element)
            return
        self._open.append(element)
        self._count[tag] = self._count.get(tag, 0) + 1
        self._unread += tag in UNREAD
        if not inline:
            self._blocks.append(element)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing but elements that are empty anyway

    def _closed(self, element: dict) -> None:
        element["last"], element["to"] = len(self.found) - 1, len(element["parts"])

    def _close(self, first: int, end: int | None = None) -> None:
        """Close the open elements from ``first`` on, or up to ``end``."""
        last = len(self.found) - 1
        for element in reversed(self._open[first:end]):
            tag = element["tag"]
            element["last"], element["to"] = last, len(element["parts"])
            self._count[tag] -= 1
            self._unread -= tag in UNREAD
            if element is self._blocks[-1]:
                self._blocks.pop()
        del self._open[first:end]

    def _end_before(self, tag: str) -> None:
        """A block ends an open paragraph; items, cells and options end those before them."""
        ended, within = ENDED_BY.get(tag, NONE_ENDED)
        if not self._count.get("p") and not (ended and any(self._count.get(name) for name in ended)):
            return
        for at in range(len(self._open) - 1, -1, -1):
            name = self._open[at]["tag"]
            if name in ended or name == "p":
                self._close(at)
                if name in ended:
                    return
            elif name not in INLINE and (name in within or not ended):
                return

    def handle_endtag(self, tag: str) -> None:
        self._blocks[-1]["parts"].append(" ")
        if not self._count.get(tag):
            return
        if self._open[-1]["tag"] == tag:
            self._close(len(self._open) - 1)
            return
        for at in range(len(self._open) - 1, -1, -1):
            name = self._open[at]["tag"]
            if name == tag:
                self._close(at, at + 1 if tag in INLINE else None)  # what an element of a line holds stays open
                return
            if tag in INLINE and name not in INLINE:
                return  # it would close what stands around this block

    def handle_data(self, data: str) -> None:
        if not self._unread:
            self._blocks[-1]["parts"].append(data)

    def close(self) -> None:
        super().close()
        self._close(0)


def elements_of(html: str | None, tags: frozenset[str] | None = None) -> list[dict]:
    """The elements of one page, with ``text``; a page of well-formed markup is read piece by piece, any other by ``HTMLParser``."""
    reader = Reader()
    if not reader.read_plain(html or ""):
        reader = Reader()
        reader.feed(html or "")
    reader.close()
    rows = reader.found if tags is None else [e for e in reader.found if e["tag"] in tags]
    for e in rows:
        e["text"] = " ".join("".join(e["parts"][e["from"] : e["to"]]).split())
    return rows


COLUMNS = {"node": pa.int32(), "last": pa.int32(), "tag": pa.string(), "nth": pa.int32(), "attributes": pa.map_(pa.string(), pa.string()), "text": pa.string()}
COLUMNS_SQL = {"node": "int", "last": "int", "tag": "string", "nth": "int", "attributes": "map<string,string>", "text": "string"}
BATCH_BYTES = 4 << 20


def elements_of_pages(pages: DataFrame, html: str, tags: list[str] | None = None, columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """Every page as it is, with the list ``elements`` instead of ``html``: see ``elements``, by choice some ``columns`` only.

    A page stays one row, so what is asked of its elements needs no shuffle.
    """
    wanted = None if tags is None else frozenset(tags)
    others = [c for c in pages.columns if c != html]
    kept = len(others)
    fields = [pa.field(name, COLUMNS[name]) for name in columns]

    def read(batches):
        for batch in batches:
            begun, size = 0, 0
            values: dict[str, list] = {name: [] for name in columns}
            ends = [0]

            def frame(to):
                parts = [pa.array(values[name], COLUMNS[name]) for name in columns]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=fields))
                told = batch.slice(begun, to - begun)
                return pa.RecordBatch.from_arrays([*told.columns[:kept], lists], names=[*told.schema.names[:kept], "elements"])

            first = values[columns[0]]
            for k, page in enumerate(batch.column(kept).to_pylist()):
                found = elements_of(page, wanted)
                for name in columns:
                    values[name] += [list(e[name].items()) for e in found] if name == "attributes" else [e[name] for e in found]
                ends.append(len(first))
                size += sum([len(e["text"]) for e in found]) + 100 * len(found)
                if size >= BATCH_BYTES:
                    yield frame(k + 1)
                    begun, size = k + 1, 0
                    values, ends = {name: [] for name in columns}, [0]
                    first = values[columns[0]]
            yield frame(batch.num_rows)

    element = ",".join(f"{name}:{COLUMNS_SQL[name]}" for name in columns)
    schema = ",".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*others).schema] + [f"elements array<struct<{element}>>"])
    return pages.select(*others, F.col(html).cast("string")).mapInArrow(read, schema)


def elements(pages: DataFrame, key: str, html: str, tags: list[str] | None = None, columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """A row an element of every page, by choice of some ``tags`` only: the key, and ``columns``.

    ``text`` is what stands in an element and in elements of its line; blocks within it have their own. A tag separates
    words like a space, white space is evened out, entities are resolved; scripts, styles, templates and comments are no
    text. A paragraph ends at its end tag, at the next block or with what holds it. ``nth`` counts a page's elements of a
    kind from 0, ``node`` all of them; those up to ``last`` stand in the element. A null page has no elements.
    """
    return elements_of_pages(pages.select(key, html), html, tags, columns).select(key, F.inline("elements"))


def paragraphs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, text) of every paragraph of every page, in order from 0."""
    return elements(pages, key, html, ["p"], ("nth", "text")).withColumnRenamed("nth", "pos")
