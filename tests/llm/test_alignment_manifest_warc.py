"""Tokenizer alignment, Merkle manifest and WARC archives against plain loops, with odd rows."""

import gzip
import hashlib
import io
import random
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import alignment, manifest, warc

ODD = [
    "", None, " ", "  ", "a  b", "\n", "\n\n a", "a\n \nb", "a \n b", "x\t y\r\n z", "▁x y", "a<|endoftext|>b </s> <s> <0x41>", "é😀漢字　 a", "\u0085 a",
    "a\x1c b\x1f c", "a\x01 b", " lead", "trail ", "trail\n", "\x00 a", "don't we'll  'tis 's", "a\xa0 b", "a" * 5000, "=-" * 3000 + " b", "é ﬁ ½ ™", "plain words, again and again.",
]


@pytest.fixture(scope="module")
def sides():
    return alignment.Sides(*alignment.default_tokenizers())


def groups_of(sides, text):
    """The groups of one text by whole-text encoding and set intersection; None where a side doesn't spell the text."""
    if not text:
        return None
    a, b = sides._a.encode(" " + text, add_special_tokens=False).ids, sides._b.encode(text)
    spelled = [[side[k] for k in ids] for side, ids in ((sides.bytes_a, a), (sides.bytes_b, b))]
    if any(b"".join(x) != (" " + text).encode() for x in spelled):
        return None
    ends = [np.cumsum(list(map(len, x))).tolist() for x in spelled]
    found, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        i2, j2 = ends[0].index(end) + 1, ends[1].index(end) + 1
        found.append((a[i:i2], b[j:j2]))
        i, j = i2, j2
    return found


def aligned_by_hand(sides, rows):
    groups = [(doc_id, groups_of(sides, text)) for doc_id, text in rows]
    links = [Counter((x, y) for a, b in found or () for x in a for y in b) for _, found in groups]
    holders = Counter(pair for found in links for pair in found)
    best = defaultdict(int)
    for (a, _), n in holders.items():
        best[a] = max(best[a], n)
    out = []
    for (doc_id, found), own in zip(groups, links, strict=True):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found or ())
        out.append((
            doc_id, sum(len(a) for a, _ in found or ()), sum(len(b) for _, b in found or ()), len(found or ()), own.total(),
            sum(n for pair, n in own.items() if holders[pair] == best[pair[0]]), sum(n * holders[pair] for pair, n in own.items()),
            hashlib.sha256(said.encode()).hexdigest() if found else "",
        ))
    return out


def by_text(rows):
    return sorted(rows, key=str)


def test_alignment_of_odd_texts(spark, sides):
    texts = [*ODD, ODD[-1], None]
    rows = [(None if k == 3 else k // 2, text) for k, text in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, block string, pairs int").repartition(3)
    for size in (200, 1 << 21):
        got = [tuple(r) for r in alignment.align_tokenizers(docs, block_chars=size).collect()]
        assert by_text(got) == by_text(aligned_by_hand(sides, rows))


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align_tokenizers(docs).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabé'.1漢▁<>😀\xa0\x1c\x01\r", max_size=30), min_size=1, max_size=6))
def test_chunks_encode_like_whole_texts(sides, texts):
    block = alignment._aligned(sides, alignment._names(sides), 0, list(range(len(texts))), texts).to_pylist()
    for text, row in zip(texts, block, strict=False):
        found = groups_of(sides, text)
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found or ())
        assert row["groups_sha256"] == (hashlib.sha256(said.encode()).hexdigest() if found else "")


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 300)), st.integers(0, 5))
def test_gallop_from_any_finger(short, long, seed):
    short, long = np.array(sorted(short), np.int64), np.array(sorted(long), np.int64)
    finger = np.random.default_rng(seed).integers(0, len(long) + 2, len(short))
    assert alignment.gallop(short, long, finger).tolist() == np.searchsorted(long, short).tolist()


def test_large_groups_count_every_link(sides, monkeypatch):
    tokens = sides.tokens(["some ordinary words, and more of them", "héé 漢字漢字 aab"])
    expected = [x.tolist() for x in alignment.Block(*tokens[1:]).pairs()]
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)
    assert [x.tolist() for x in alignment.Block(*tokens[1:]).pairs()] == expected


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_by_hand(leaves):
    """Every level of a tree; and for each leaf its siblings with their side (None where it has none)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    paths = []
    for k in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            other = k ^ 1
            path.append((level[other], bool(k & 1)) if other < len(level) else None)
            k //= 2
        paths.append(path)
    return levels[-1][0] if leaves else None, paths


def manifest_by_hand(rows):
    def leaf(doc_id, source, lang, n_chars, text):
        return digest(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])

    by_lang = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        more = None if n_chars is None else n_chars + 1
        by_lang[lang].append((doc_id, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, more, text) if changed else None))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    trees = [tree_by_hand([r[1] for r in by_lang[lang]]) for lang in langs]
    root, tops = tree_by_hand([tree[0] for tree in trees])
    out = []
    for lang, (subroot, paths), top in zip(langs, trees, tops, strict=True):
        for (doc_id, own, other), path in zip(by_lang[lang], paths, strict=True):
            folded = other or own
            for step in path + top:
                folded = digest(folded) if step is None else digest(step[0], folded) if step[1] else digest(folded, step[0])
            proof = digest(*[step[0] for step in path + top if step])
            out.append((doc_id, own, subroot, root, proof, folded, folded == root))
    return out


def proved(rows):
    return manifest.prove(rows)


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_manifest(spark, bits):
    rng = random.Random(bits)
    rows = [(k * 3 if k % 9 else None, rng.choice(["a", None, "ü"]), rng.choice(["de", "en", "en", "en", None]), rng.choice([None, 5, 2**63 - 1]), rng.choice(["", None, "é😀", "x" * 999])) for k in range(90)]
    rows += [(1, "s", "lone", 1, "t"), (7, "s", "", 1, "t")] + [(14, "s", "en", 3, "same")] * 40
    docs = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, pos int, key string").repartition(5)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = [tuple(r) for r in proved(manifest.manifest(docs, block_bits=bits, tampered=tampered)).collect()]
    assert by_text(got) == by_text(manifest_by_hand(rows))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("rows", [[], [(5, "s", "en", 1, "t")], [(None, None, None, None, None)]])
def test_manifest_of_hardly_anything(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    assert [tuple(r) for r in proved(manifest.manifest(docs, tampered=tampered)).collect()] == manifest_by_hand(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70))
def test_appends_grow_the_witnesses_of_a_whole_tree(n):
    leaves, tree = [digest(str(k)) for k in range(n)], manifest.Appender()
    for leaf in leaves:
        tree.append(leaf)
    root, paths = tree_by_hand(leaves)
    assert tree.close(manifest.levels_above(n)) == root
    assert [bytes(w).hex() for w in tree.witnesses] == ["".join(step[0] for step in path if step) for path in paths]
    assert all(manifest.fold(leaf, [(k, n)], bytes(tree.witnesses[k])) == root for k, leaf in enumerate(leaves))


PAGES = "page_id bigint, url string, html string, data int, chunk string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], PAGES).repartition(3)


def by_hand(rows):
    first = {}
    for page_id, _, html in rows:
        raw = (html or "").encode()
        key = (page_id is None, page_id or 0)
        first[raw] = min(first.get(raw, key), key)
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        revisits = len(raw) >= 100 and (page_id is None, page_id or 0) != first[raw]
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisits else "response", first[raw][1] if revisits else None))
    return out


ROWS = [
    (1, "http://a/ b\r\nWARC-Type: x", "p" * 100), (2, None, "p" * 100), (3, "http://a/é", "p" * 99), (4, "u", "p" * 99), (5, "u", None), (6, "u", ""), (None, "u", "p" * 100), (None, "u", "q" * 200),
    (7, "u", "é" * 20000), (8, "u", "é" * 20000 + "\r\n\r\nWARC/1.1\r\n"), (9, "u", "é" * 20000), (9, "u", "é" * 20000), (7, "v", "é" * 20000), (2**60 + 1, "u", "z" * 150), (-5, "u", "z" * 150),
] + [(1000 + k, "u", "many copies " * 20) for k in range(200)]


@pytest.mark.parametrize("compress", [True, False])
def test_archives_hold_what_was_written(spark, compress):
    folder = "file://" + tempfile.mkdtemp(prefix="spark-warc-")
    archives = warc.write_archives(pages_of(spark, ROWS), folder, chunk_bytes=777, file_bytes=20_000, compress=compress)
    assert archives.count() > 1 and archives.agg(F.sum("n_records")).first()[0] == len(ROWS)
    got = warc.read_records(spark, archives)
    assert got.where("not intact").count() == 0
    assert by_text(tuple(r) for r in got.drop("intact").collect()) == by_text(by_hand(ROWS))
    texts = {hashlib.sha256((html or "").encode()).hexdigest(): (html or "").encode() for _, _, html in ROWS}
    chunks = defaultdict(list)
    for row in warc.read_chunks(archives, chunk_bytes=500).where("record_type = 'response'").orderBy("path", "record_id", "chunk").collect():
        chunks[row.declared_digest, row.page_id, row.path].append(row)
    for (declared, *_), rows in chunks.items():
        copies = sum(r.chunk == 0 for r in rows)
        rows = rows[::copies]
        so_far = b""
        for row in rows:
            so_far += row.data
            assert len(row.data) <= 500 and row.bytes_so_far == len(so_far) and row.digest_so_far == hashlib.sha256(so_far).hexdigest()
        assert so_far == texts[declared] and [r.is_last for r in rows] == [False] * (len(rows) - 1) + [True]


def test_archives_of_no_pages(spark):
    archives = warc.write_archives(pages_of(spark, []), "file://" + tempfile.mkdtemp(prefix="spark-warc-"))
    assert archives.collect() == [] and warc.read_records(spark, archives).collect() == []


def test_archives_of_others_are_read():
    record = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:x>\r\ncontent-length: 5\r\n\r\nhello\r\n\r\n"
    for raw in (record * 2, gzip.compress(record) + gzip.compress(record)):
        rows = list(warc.read_stream(io.BufferedReader(io.BytesIO(raw)), chunk_bytes=3))
        assert [(r["record_type"], r["chunk"], r["is_last"], r["data"]) for r in rows] == [("metadata", 0, False, b"hel"), ("metadata", 1, True, b"lo")] * 2
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_stream(io.BufferedReader(io.BytesIO(record[:-7]))))
    with pytest.raises(ValueError, match="not a WARC record"):
        list(warc.read_stream(io.BufferedReader(io.BytesIO(b"HTTP/1.1 200 OK\r\n"))))


def test_an_id_that_most_rows_have_is_split_and_stays_in_order(spark):
    from tallyspark.llm import token_output

    rows = spark.range(2000).select(F.when(F.col("id") % 10 < 6, F.lit(500)).when(F.col("id") % 10 == 6, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 10 < 4, "same").otherwise(F.col("id").cast("string")).alias("text"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, False)  # else so few rows become one partition
    try:
        placed = token_output.in_order(rows.repartition(3)).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()).collect()
    finally:
        spark.conf.unset(coalesce)
    sizes = Counter(r.part for r in placed)
    assert len(sizes) == 4 and max(sizes.values()) < 700 and len({r.part for r in placed if r.doc_id == 500 and r.text == "same"}) > 1
    ids = [r.doc_id for r in sorted(placed, key=lambda r: r.row)]
    assert ids == sorted(ids, key=lambda k: (k is None, k or 0)) and Counter((r.doc_id, r.text) for r in placed) == Counter(map(tuple, rows.collect()))
