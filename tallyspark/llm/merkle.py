"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

Leaves are pieces of a paragraph (runs up to a sentence end, 96 code points at most, so that a long line has
branches too), as BLAKE2 digests of 16 bytes; a paragraph is a line; sections are runs of paragraphs cut after one
whose hash ends in three zero bits, so an inserted paragraph moves no later boundary, or after 64 paragraphs. Every
inner node is the SHA-256 of its level and its children, and the root also takes the number of code points. Equal
roots mean equal texts; where roots differ, walking down the branches that differ finds the edits.

A stored tree (column ``tree``) holds the sections and paragraphs with 12 bytes of each paragraph's hash, and 4 bytes
and the size of each leaf. ``likeness`` and ``locate_edits`` need nothing but two stored trees, no text. Two different
leaves of one size look alike there by chance once in 2 ** 32, so two texts of 10 ** 5 leaves each share about two leaves
by chance: an error of ``likeness`` of about 0.00002. Roots are whole digests and have no such error.

Likeness: the code points under leaves in common (as multisets), twice, over both texts' code points; 1 for two
empty texts. It is symmetric and 1 for equal roots.

The next document is needed beside each document. Texts are range-partitioned and sorted by id once, so the
next document is the next row; the last row of a partition waits, and those few rows are joined to the first
row of the following partition afterwards. No other exchange moves text.

Defined cases: null is an empty text; rows with a null id come last, rows of one id stand in the order of a hash of
their text; a lone document follows itself; an empty table gives no rows; ids of any size are kept exactly.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.lineage import written
from tallyspark.llm.token_output import in_order

PIECE = re.compile(r"[^.!?]{1,96}[.!?]{0,32}|[.!?]{1,128}")
SECTION_MASK, SECTION_MOST = 7, 64
LEAF = 4
PARAGRAPH = struct.Struct("<?I12s")  # whether it closes a section, its leaves, its hash


def _node(level: bytes, children: list[bytes]) -> bytes:
    return hashlib.sha256(level + b"".join(children)).digest()


def fingerprint(text: str | None) -> tuple[bytes, bytes]:
    """(root, stored tree) of one text."""
    text = text or ""
    stored, tops, section = [], [], []
    lines = text.split("\n") if text else []
    for k, line in enumerate(lines):
        pieces = PIECE.findall(line)
        if k < len(lines) - 1:
            pieces.append("\n")
        leaves = [hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=16).digest() for p in pieces]
        top = _node(b"p", leaves)
        section.append(top)
        closes = not top[-1] & SECTION_MASK or len(section) == SECTION_MOST or k == len(lines) - 1
        stored += [PARAGRAPH.pack(closes, len(leaves), top[:12]), b"".join([leaf[:LEAF] for leaf in leaves]), bytes(map(len, pieces))]
        if closes:
            tops.append(_node(b"s", section))
            section = []
    return _node(b"r%d:" % len(text), tops), b"".join(stored)


def sections_of(tree: bytes) -> list[list[tuple[bytes, list[tuple[bytes, int]]]]]:
    """The sections of a stored tree; a section is a list of paragraphs (hash, leaves), a leaf is (hash, code points)."""
    sections, section, at = [], [], 0
    while at < len(tree):
        closes, n, top = PARAGRAPH.unpack_from(tree, at)
        at += PARAGRAPH.size
        sizes = tree[at + LEAF * n : at + LEAF * n + n]
        section.append((top, [(tree[at + LEAF * k : at + LEAF * k + LEAF], size) for k, size in enumerate(sizes)]))
        at += LEAF * n + n
        if closes:
            sections.append(section)
            section = []
    return sections


def leaf_counts(tree: bytes) -> Counter:
    """Leaves of a stored tree with how often each occurs; the key holds its code points."""
    return Counter(leaf for section in sections_of(tree) for _, leaves in section for leaf in leaves)


def _likeness(a: Counter, b: Counter) -> float:
    size = lambda c: sum(leaf[1] * n for leaf, n in c.items())
    both = size(a) + size(b)
    if not both:
        return 1.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    common = sum(leaf[1] * min(n, large[leaf]) for leaf, n in small.items() if leaf in large)
    return 2.0 * common / both


def likeness(a: bytes, b: bytes) -> float:
    """Likeness of two stored trees, 0 to 1."""
    return _likeness(leaf_counts(a), leaf_counts(b))


def locate_edits(old: bytes, new: bytes) -> list[tuple[int, int]]:
    """(section, paragraph) of each paragraph of the stored tree ``new`` whose branch does not occur in ``old``.

    Sections whose paragraphs are those of an old one are passed over whole.
    """
    branch = lambda section: b"".join([top for top, _ in section])
    old_sections = sections_of(old)
    known_sections = set(map(branch, old_sections))
    known = {top for section in old_sections for top, _ in section}
    return [
        (i, j)
        for i, section in enumerate(sections_of(new))
        if branch(section) not in known_sections
        for j, (top, _) in enumerate(section)
        if top not in known
    ]


KEPT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "tree"]
SCANNED = "doc_id string, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, tree binary"


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, tree) of every row of ``docs`` (doc_id, text), without a shuffle."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(text) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fingerprint": [root.hex() for root, _ in found], "tree": [tree for _, tree in found]})

    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "doc_id string, fingerprint string, tree binary")
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _edited(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _compare(doc_id, text: str, known: tuple, following: str, known_next: tuple) -> tuple:
    edited = _edited(text, following)
    edited_root, edited_tree = fingerprint(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest()
    return (doc_id, len(text), sha, known[0], edited_root, _likeness(known[2], leaf_counts(edited_tree)), _likeness(known[2], known_next[2]), known[1])


def _known(text: str) -> tuple:
    root, tree = fingerprint(text)
    return root, tree, leaf_counts(tree)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document (doc_id, text) beside its edited text and the document after it in ascending doc_id.

    Digests are hexadecimal; ``tree`` is the stored tree of the document.
    """
    placed = in_order(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))

    def scan(batches):
        """Finished rows, then the partition's first and last text for the seams."""
        part, first, held, rows = TaskContext.get().partitionId(), None, None, []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                known = _known(text)
                if held is None:
                    first = text
                else:
                    rows.append((*_compare(*held, text, known), part, None, None))
                held = (doc_id, text, known)
                if len(rows) == 2000:
                    yield _frame(rows)
                    rows = []
        if held is not None:
            rows.append((held[0], *[None] * 7, part, first, held[1]))
        yield _frame(rows)

    scanned = placed.select(F.col("doc_id").cast("string"), "text").mapInPandas(scan, SCANNED + ", part int, first_text string, last_text string")
    scanned = written(scanned, "fingerprints")
    # one row a partition: each seam takes the first text of the next partition, the last one that of the first;
    # only partition numbers meet in the window, the texts are joined to them
    seams = scanned.where(F.col("first_text").isNotNull())
    ahead, whole = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = seams.select("part", F.coalesce(F.lead("part").over(ahead), F.first("part").over(whole)).alias("after"))
    seams = seams.join(following, "part").join(seams.select(F.col("part").alias("after"), F.col("first_text").alias("next_text")), "after")

    def close(batches):
        for batch in batches:
            rows = []
            for doc_id, text, following in zip(batch["doc_id"].tolist(), batch["last_text"].tolist(), batch["next_text"].tolist(), strict=True):
                rows.append(_compare(doc_id, text, _known(text), following, _known(following)))
            yield pd.DataFrame(rows, columns=KEPT)

    closed = seams.select("doc_id", "last_text", "next_text").mapInPandas(close, SCANNED)
    both = scanned.where(F.col("first_text").isNull()).select(*KEPT).unionByName(closed)
    digests = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return both.withColumns({"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), **digests})


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[*KEPT, "part", "first_text", "last_text"])
    return out.astype({"n_chars": "Int64", "near_edited": "float64", "near_next": "float64"})


def op9_query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and the stored tree of each document as ``tree``."""
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
