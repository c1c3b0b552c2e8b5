"""Alignment of two tokenizers over one text, and which of their ids go together across the corpus.

Both token sequences spell the same bytes, so a text is two ascending lists of byte ends. Offsets where tokens of both
sides end cut them into groups. The lists are intersected by galloping: each end of the shorter list looks in the
longer one from where it would stand if tokens were equally long (its finger), in steps that double until it is
passed, then by halving the last step; all ends of a block of texts take each step together. Between two common
ends, the differences of the ranks on either side give the ranges of tokens that overlap.

Encoding remembers the tokens of chunks. A chunk ends before a space or line break that follows no white space; the
byte-level rule never matches across such a place, and no piece of the other vocabulary holds a space or line
break after another sign (both are checked in the vocabularies' files; if it isn't so, whole texts are encoded).

Links are the pairs of an A and a B token of one group. A pair's count is the number of documents that hold it. Texts
never move for it: a task turns about ``BLOCK_CHARS`` characters of documents into a block, which lists its different
pairs once, with the documents that hold each; documents refer to that list by position. Counts are summed over
the lists, joined back to the lists and meet the block's documents by block. So what is shuffled for the counts is
a row for each different pair of a block, not for each link.

Defined cases: a null or empty text, and one whose tokens don't spell ``" " + text`` on both sides, has no tokens: all
numbers are 0 and the digest is an empty string. Special tokens' strings inside a text are plain text. Rows with a null
id or a repeated id are rows of their own, and each counts as a document. An empty table gives no rows. A text of any
length is one unit: memory follows a block, or the longest text where that is longer. A group of very many tokens gives
its pairs by different ids, not by occurrences.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.lineage import written

ID_BITS, SIDE = 20, 1 << 31  # ids stay below 2 ** 20, and tokens below 2 ** 11 bytes
BLOCK_CHARS = 1 << 20
LARGE_GROUP = 1 << 14
# The white space that the byte-level rule's \s knows.
WHITE = "\t-\r \x85\xa0  -     　"


def default_tokenizers() -> tuple[str, str]:
    """Paths of the byte-level (A) and the piece (B) vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_of_letter() -> dict[str, int]:
    """How a byte-level vocabulary writes bytes: printable ones as they are, the others by the letters from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(others)}


class Sides:
    """Both tokenizers: the tokens of texts as ``length << ID_BITS | id``, and the bytes of each id."""

    REMEMBERED = 500_000  # chunks in each of two generations
    LONG = 64  # longer chunks aren't remembered
    CUT, MARK = f"([^{WHITE}])([ \n])", "\x01"

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a, self._b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self._a.encode_special_tokens = True
        letters, vocabulary = _byte_of_letter(), self._a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            plain = all(letter in letters for letter in entry)
            self.bytes_a[k] = bytes(letters[letter] for letter in entry) if plain else entry.encode()
        self.bytes_b = [self._piece_bytes(k) for k in range(self._b.get_piece_size())]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << ID_BITS or max(map(len, self.bytes_a + self.bytes_b)) >= SIDE >> ID_BITS:
            raise ValueError("the vocabulary is too large")
        self._code_a, self._code_b = (np.array([mark | len(x) << ID_BITS | k for k, x in enumerate(side)], np.uint32) for side, mark in ((self.bytes_a, SIDE), (self.bytes_b, 0)))
        self._start = self._b.piece_to_id("▁")
        self._cuts = self._chunks_stand_alone(path_a)
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _piece_bytes(self, k: int) -> bytes:
        piece = self._b.id_to_piece(k)
        if self._b.is_byte(k):
            return bytes([int(piece[3:5], 16)])
        return b"" if self._b.is_control(k) or self._b.is_unknown(k) else piece.replace("▁", " ").encode()

    def _chunks_stand_alone(self, path_a: str) -> bool:
        with open(path_a, encoding="utf-8") as file:
            rules = json.load(file)
        cutter = rules["pre_tokenizer"] or {}
        byte_level = cutter.get("type") == "ByteLevel" and cutter.get("use_regex") and not cutter.get("add_prefix_space") and rules["normalizer"] is None
        crossing = re.compile("\n|[^▁]▁")
        return bool(byte_level) and not any(crossing.search(self._b.id_to_piece(k)) for k in range(self._b.get_piece_size()))

    def _encoded(self, chunks: list[str]) -> tuple[list[bytes], set[str]]:
        """The tokens of strings that begin with a space or line break, first A's and then B's; those that a side spells otherwise.

        In one string of codes, A's have the bit ``SIDE`` set.
        """
        ids_a = [e.ids for e in self._a.encode_batch_fast(chunks, add_special_tokens=False)]
        # the library puts a space before what it gets, if it gets anything: that is the string's own, or a token alone
        # before a line break
        found = self._b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        ids_b = [[self._start] if c == " " else ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, found, strict=True)]
        raw, odd, sides = [c.encode() for c in chunks], set(), []
        bytes_of = list(map(len, raw))
        for ids, codes, names in ((ids_a, self._code_a, self.bytes_a), (ids_b, self._code_b, self.bytes_b)):
            flat = list(chain.from_iterable(ids))
            ends = [0, *accumulate(map(len, ids))]
            spelled = list(map(names.__getitem__, flat))
            sizes = np.concatenate([[0], np.cumsum(list(map(len, spelled)), dtype=np.int64)])[ends]
            if b"".join(spelled) != b"".join(raw) or not np.array_equal(np.diff(sizes), bytes_of):
                odd.update(c for c, x, (i, j) in zip(chunks, raw, pairwise(ends), strict=True) if b"".join(spelled[i:j]) != x)
            sides.append((codes[flat].tobytes(), ends))
        (a, ends_a), (b, ends_b) = sides
        cuts = zip(pairwise(ends_a), pairwise(ends_b), strict=True)
        return [a[4 * i : 4 * j] + b[4 * k : 4 * m] for (i, j), (k, m) in cuts], odd

    def _chunks(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Where each text's chunks begin, the different chunks, and which of them stand there."""
        strings = pa.array([" " + text for text in texts], pa.large_string())
        if not self._cuts:
            lists = pa.LargeListArray.from_arrays(np.arange(len(texts) + 1), strings)
        elif any(self.MARK in text for text in texts):
            lists = pa.array([re.split(f"(?<=[^{WHITE}])(?=[ \n])", text) for text in strings.to_pylist()], pa.large_list(pa.large_string()))
        else:
            lists = pc.split_pattern(pc.replace_substring_regex(strings, self.CUT, "\\1" + self.MARK + "\\2"), self.MARK)
        coded = lists.flatten().dictionary_encode()
        return np.asarray(lists.offsets), coded.dictionary.to_pylist(), np.asarray(coded.indices)

    def tokens(self, texts: list[str]) -> tuple[list[int], "Tokens", "Tokens"]:
        """Which texts both sides spell, and their tokens on either side."""
        first, chunks, place = self._chunks(texts)
        known = [self._new.get(c) or self._old.get(c) for c in chunks]
        missing = [k for k, found in enumerate(known) if found is None]
        odd = np.zeros(len(chunks), bool)
        if missing:
            asked = [chunks[k] for k in missing]
            found, strange = self._encoded(asked)
            self._new.update((c, x) for c, x in zip(asked, found, strict=True) if len(c) <= self.LONG and c not in strange)
            for k, x in zip(missing, found, strict=True):
                known[k] = x
            if strange:
                odd[missing] = [c in strange for c in asked]
        if self._old:
            self._new.update((c, x) for c, x in zip(chunks, known, strict=True) if c in self._old)
        if len(self._new) > self.REMEMBERED:
            self._new, self._old = {}, self._new
        # chunks spell one after the other, so a text with a chunk that is spelled otherwise is spelled otherwise
        bad = np.zeros(len(place) + 1, np.int64)
        np.cumsum(odd[place], out=bad[1:])
        fits = bad[first[1:]] == bad[first[:-1]]
        kept = np.flatnonzero(fits)
        chosen = np.repeat(fits, np.diff(first))
        place, counts = place[chosen], np.diff(first)[kept]
        return kept.tolist(), *(Tokens(known, mark, place, counts) for mark in (SIDE, 0))


class Tokens:
    """Codes of texts one after the other, and where each text begins, with the end of the last."""

    def __init__(self, chunks: list[bytes], mark: int, place: np.ndarray, counts: np.ndarray):
        content, ends = np.frombuffer(b"".join(chunks), np.uint32), np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) // 4)
        mine = (content & SIDE) == mark
        before = np.concatenate([[0], np.cumsum(mine)])
        content, sizes = content[mine] & ~np.uint32(SIDE), np.diff(before[np.concatenate([[0], ends])])
        starts = np.cumsum(sizes) - sizes
        own = sizes[place]
        ends = np.cumsum(own)
        self.codes = content[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[place] - (ends - own), own)]
        self.first = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]


def gallop(short: np.ndarray, long: np.ndarray, finger: np.ndarray) -> np.ndarray:
    """For each value of ``short`` the first place in the ascending ``long`` whose value is not below it.

    ``finger`` says where each value starts to look. Values that are still looking take each step together.
    """
    n = len(long)
    low, high = np.zeros(len(short), np.int64), np.full(len(short), n, np.int64)
    if not n or not len(short):
        return low
    at = np.clip(finger, 0, n - 1)
    below = long[at] < short
    for upward in (True, False):
        looking = np.flatnonzero(below == upward)
        place, step = at[looking], 1
        while len(looking):
            if upward:
                low[looking] = place + 1
                place = place + step
                inside = place < n
                passed = np.ones(len(looking), bool)
                passed[inside] = long[place[inside]] >= short[looking[inside]]
                high[looking[passed]] = np.minimum(place[passed], n)
            else:
                high[looking] = place
                place = place - step
                inside = place >= 0
                passed = np.ones(len(looking), bool)
                passed[inside] = long[place[inside]] < short[looking[inside]]
                low[looking[passed]] = np.maximum(place[passed] + 1, 0)
            looking, place, step = looking[~passed], place[~passed], step * 2
    looking = np.flatnonzero(low < high)
    while len(looking):
        middle = (low[looking] + high[looking]) // 2
        less = long[middle] < short[looking]
        low[looking[less]] = middle[less] + 1
        high[looking[~less]] = middle[~less]
        looking = looking[low[looking] < high[looking]]
    return low


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in both lists of the ends that they share.

    The lists run over texts one after the other; ``first_*`` say at which rank each text begins, and the end of the last.
    """
    turned = len(ends_a) > len(ends_b)
    (short, first), (long, other) = ((ends_b, first_b), (ends_a, first_a)) if turned else ((ends_a, first_a), (ends_b, first_b))
    sizes, others = np.diff(first), np.diff(other)
    rank = np.arange(len(short)) - np.repeat(first[:-1], sizes)
    finger = np.repeat(other[:-1], sizes) + rank * np.repeat(others, sizes) // np.maximum(np.repeat(sizes, sizes), 1)
    found = gallop(short, long, finger)
    same = found < len(long)
    same[same] = long[found[same]] == short[same]
    here, there = np.flatnonzero(same), found[same]
    return (there, here) if turned else (here, there)


class Block:
    """Groups and links of some texts, given their codes on both sides."""

    def __init__(self, side_a: Tokens, side_b: Tokens):
        mask = (1 << ID_BITS) - 1
        a, b, self.first_a, self.first_b = side_a.codes, side_b.codes, side_a.first, side_b.first
        self.a, self.b = (a & mask).astype(np.int64), (b & mask).astype(np.int64)
        ends_a, ends_b = (np.cumsum(x >> ID_BITS, dtype=np.int64) for x in (a, b))
        last_a, last_b = common_ends(ends_a, ends_b, self.first_a, self.first_b)
        self.from_a, self.from_b = np.concatenate([[0], last_a[:-1] + 1]), np.concatenate([[0], last_b[:-1] + 1])
        self.size_a, self.size_b = last_a + 1 - self.from_a, last_b + 1 - self.from_b
        # a text ends where both sides end, so no group crosses into the next text
        self.first_group = np.searchsorted(last_a, self.first_a - 1, side="right")
        self.text = np.repeat(np.arange(len(self.first_a) - 1), np.diff(self.first_group))
        self.last_a, self.last_b = last_a, last_b

    def digests(self, names: tuple[list[str], list[str]]) -> list[str]:
        """SHA-256 of every text's groups as ``a1,a2|b1;a3|b2,b3``; ``names`` hold each id with either of its endings."""
        closes_a, closes_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        closes_a[self.last_a], closes_b[self.last_b] = 1, 1
        place_a = np.arange(len(self.a)) + np.repeat(self.from_b, self.size_a)
        place_b = np.arange(len(self.b)) + np.repeat(self.last_a + 1, self.size_b)
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[place_a], order[place_b] = 2 * self.a + closes_a, 2 * self.b + closes_b + len(names[0])
        written_out, found = list(map((names[0] + names[1]).__getitem__, order.tolist())), []
        for first, last in zip((self.first_a + self.first_b)[:-1].tolist(), (self.first_a + self.first_b)[1:].tolist(), strict=True):
            found.append(hashlib.sha256("".join(written_out[first:last])[:-1].encode()).hexdigest())
        return found

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links) for each different pair of each text, ordered; a pair is ``a << ID_BITS | b``."""
        sizes = self.size_a * self.size_b
        texts, found, times = [], [], []
        for group in np.flatnonzero(sizes > LARGE_GROUP).tolist():
            a, n_a = np.unique(self.a[self.from_a[group] : self.last_a[group] + 1], return_counts=True)
            b, n_b = np.unique(self.b[self.from_b[group] : self.last_b[group] + 1], return_counts=True)
            found.append((a[:, None] << ID_BITS | b[None, :]).ravel())
            times.append((n_a[:, None] * n_b[None, :]).ravel())
            texts.append(np.full(len(found[-1]), self.text[group]))
        some = np.flatnonzero(sizes <= LARGE_GROUP)
        sizes = sizes[some]
        group = np.repeat(some, sizes)
        rank = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found.append(self.a[self.from_a[group] + rank // self.size_b[group]] << ID_BITS | self.b[self.from_b[group] + rank % self.size_b[group]])
        times.append(np.ones(len(group), np.int64))
        texts.append(self.text[group])
        text, pair, n = (np.concatenate(x) for x in (texts, found, times))
        order = np.lexsort((pair, text))
        text, pair, n = text[order], pair[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])])) if len(text) else np.empty(0, np.int64)
        return text[starts], pair[starts], np.add.reduceat(n, starts) if len(starts) else n


_SIDES: dict = {}


def sides_of(path_a: str, path_b: str) -> Sides:
    """Both tokenizers once a Python worker, so that what they remember serves every task the worker runs."""
    if (path_a, path_b) not in _SIDES:
        _SIDES[path_a, path_b] = Sides(path_a, path_b)
    return _SIDES[path_a, path_b]


def _names(sides: Sides) -> tuple[list[str], list[str]]:
    """Each A id before another one or before its group's B ids; each B id before another one or before the next group."""
    return tuple([f"{k}{end}" for k in range(len(side)) for end in ends] for side, ends in ((sides.bytes_a, ",|"), (sides.bytes_b, ",;")))


ALIGNED = pa.schema([
    ("block", pa.int64()), ("is_list", pa.bool_()), ("doc_id", pa.int64()),
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("places", pa.binary()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64())),
])
ALIGNED_SQL = (
    "block bigint, is_list boolean, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "places binary, links binary, pairs array<bigint>, holders array<bigint>"
)


def _aligned(sides: Sides, names, block: int, doc_ids: list, texts: list[str | None]) -> pa.RecordBatch:
    """One row a document, and one with the block's different pairs and how many of its documents hold each."""
    filled = [k for k, t in enumerate(texts) if t]
    kept, *both = sides.tokens([texts[k] for k in filled])
    kept = [filled[k] for k in kept]
    rows = {name: [None] * len(texts) for name in ALIGNED.names}
    rows |= {"block": [block] * len(texts), "is_list": [False] * len(texts), "doc_id": list(doc_ids)}
    rows |= {name: [0] * len(texts) for name in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * len(texts)}
    if kept:
        cut = Block(*both)
        text, pair, n = cut.pairs()
        different, place, holders = np.unique(pair, return_inverse=True, return_counts=True)
        ends, digests = np.searchsorted(text, np.arange(len(kept) + 1)), cut.digests(names)
        links = np.add.reduceat(cut.size_a * cut.size_b, cut.first_group[:-1])
        for i, k in enumerate(kept):
            own = place[ends[i] : ends[i + 1]]  # ascending: gaps are small numbers, which files keep short
            rows["places"][k] = np.diff(own, prepend=0).astype("<u4").tobytes()
            rows["links"][k] = n[ends[i] : ends[i + 1]].astype("<u4").tobytes()
            rows["n_a"][k], rows["n_b"][k] = int(cut.first_a[i + 1] - cut.first_a[i]), int(cut.first_b[i + 1] - cut.first_b[i])
            rows["n_groups"][k], rows["n_links"][k] = int(cut.first_group[i + 1] - cut.first_group[i]), int(links[i])
            rows["groups_sha256"][k] = digests[i]
        listed = {"block": block, "is_list": True, "pairs": different, "holders": holders}
        for name in ALIGNED.names:
            rows[name].append(listed.get(name))
    return pa.RecordBatch.from_pydict(rows, schema=ALIGNED)


def align(docs: DataFrame, *, tokenizers: tuple[str, str] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Blocks of aligned documents (doc_id, text), see ``ALIGNED_SQL``; one scan without a shuffle."""
    paths = tokenizers or default_tokenizers()

    def run(batches):
        sides, partition, number, doc_ids, texts, size = sides_of(*paths), TaskContext.get().partitionId(), 0, [], [], 0
        names = _names(sides)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                doc_ids.append(doc_id)
                texts.append(text)
                size += len(text or "") + 64
                if size >= block_chars:
                    yield _aligned(sides, names, partition << 32 | number, doc_ids, texts)
                    number, doc_ids, texts, size = number + 1, [], [], 0
        if doc_ids:
            yield _aligned(sides, names, partition << 32 | number, doc_ids, texts)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, ALIGNED_SQL)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, is_best): documents that hold each pair, and whether no pair of its A id has more.

    An A id has no more rows in a window than the B vocabulary has ids.
    """
    lists = aligned.where("is_list").select(F.explode(F.arrays_zip("pairs", "holders")).alias("x"))
    counts = lists.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.shiftright("pair", ID_BITS)))
    return counts.select("pair", "count", (F.col("count") == most).alias("is_best"))


RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def align_tokenizers(docs: DataFrame, *, tokenizers: tuple[str, str] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each document's tokens, groups and links, with the links' corpus-wide counts; see ``RESULT``."""
    aligned = written(align(docs, tokenizers=tokenizers, block_chars=block_chars), "aligned")
    lists = aligned.where("is_list").select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("place", "pair"))
    counted = lists.join(pair_counts(aligned), "pair").select("of_block", "place", "count", "is_best")
    rows = aligned.where("not is_list").drop("is_list", "pairs", "holders")

    def score(docs: pa.Table, counts: pa.Table) -> pa.Table:
        place = counts.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = counts.column("count").to_numpy(), counts.column("is_best").to_numpy()
        sums = []
        for places, links in zip(docs.column("places").to_pylist(), docs.column("links").to_pylist(), strict=True):
            own = np.cumsum(np.frombuffer(places or b"", "<u4"), dtype=np.int64)
            n = np.frombuffer(links or b"", "<u4").astype(np.int64)
            sums.append((int(n @ best[own]), int(n @ count[own])))
        columns = {name: docs.column(name) for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        columns |= {"n_best": pa.array([x[0] for x in sums], pa.int64()), "count_sum": pa.array([x[1] for x in sums], pa.int64())}
        return pa.table({name.split()[0]: columns[name.split()[0]] for name in RESULT.split(", ")})

    return rows.groupBy("block").cogroup(counted.groupBy("of_block")).applyInArrow(score, RESULT)


def op11_query(spark, sf_dir: str) -> DataFrame:
    return align_tokenizers(spark.read.parquet(f"{sf_dir}/documents.parquet"))
