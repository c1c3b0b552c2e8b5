"""Token ids in binary files: every id in the fewest bits the vocabulary needs, in blocks that unpack with numpy.

File format (little-endian), one file per range of documents:

    magic "TLYPACK2" | bits u32 | block u32 | n_docs u64 | n_ids u64
    doc_ids   i64[n_docs]      0 where the id is null
    doc_ends  u64[n_docs]      running count of ids, so any document can be found
    no_id     u8[n_docs]       1 where the id is null
    offsets   u64[n_blocks+1]  byte offset of each block in the payload
    payload   blocks of ``block`` ids, ``bits`` bits each, low bit first, each block padded to a byte

Any block is read alone: ``np.unpackbits`` to rows of ``bits`` bits (or a plain reshape where ids fill bytes).

Writing: documents are range-partitioned and sorted by id, so the files in order of (partition, part) hold all
documents in ascending order. A task closes a file at ``file_ids`` ids, so its memory is bounded. A file is
written under a name of its own for each attempt, and only the names that successful attempts return enter the
manifest: a lost executor leaves an unlisted file, never a wrong result. Files go through ``pyarrow.fs``, so
any file system it knows works; the folder must be shared.

Encoding remembers the ids of words (see ``Encoder``), which saves most of the tokenizer's work.

Defined cases: null and empty texts hold only the end id; rows with a null id come last; rows of one id stand in
the order of a hash of their text; an empty table writes no file and returns no rows. Ids of any size are kept exactly: they reach
the Python functions as text, since a batch with a null would turn whole numbers into floating ones.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.lineage import cut_lineage, new_folder

MAGIC = b"TLYPACK2"
END_ID = 1
BLOCK = 4096
FILE_IDS = 8 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# How byte-level vocabularies write bytes, printable ones as they are and the rest from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _PRINTED)}


class Encoder:
    """Ids of whole texts by the tokenizers library, with the ids of chunks and words remembered up to a bound.

    The vocabulary's rules lower-case a text, cut it into words (letters, single digits, runs of other signs; none
    over white space) and encode each word alone. Texts of plain Latin characters are cut here by the same rule,
    and only words not yet known go to the library's model; any other text, or one with a special token's mark,
    goes to the library whole.
    """

    LIMIT = 600_000
    PLAIN = re.compile("[\t-\r -~\xa1-\u012f\u0131-\u024f]*")
    _LETTERS, _DIGITS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
    WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
    RULE = (["NFC", "Replace", "Lowercase"], "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")

    def __init__(self, path: str, *, special_as_text: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = self._special_as_text = special_as_text
        self._by_word = self._word_rule(path) == self.RULE
        self._known: dict[str, bytes] = {}
        self.bits = max(1, max(self._tokenizer.get_vocab().values()).bit_length())

    @staticmethod
    def _word_rule(path: str):
        """What the file says about normalising and cutting; words are only remembered under the rule above."""
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        try:
            return [n["type"] for n in rules["normalizer"]["normalizers"]], rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        except (KeyError, TypeError, IndexError):
            return None

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text as uint32."""
        if not text:
            return np.empty(0, np.uint32)
        if not self._by_word or not self.PLAIN.fullmatch(text) or ("<|" in text and not self._special_as_text):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        chunks, step = text.lower().split(), self.LIMIT // 4
        if len(chunks) <= step:
            return np.frombuffer(self._of(chunks), np.uint32)
        return np.frombuffer(b"".join(self._of(chunks[k : k + step]) for k in range(0, len(chunks), step)), np.uint32)

    def _of(self, chunks: list[str]) -> bytes:
        known = self._known
        try:
            return b"".join(map(known.__getitem__, chunks))
        except KeyError:
            if len(known) > self.LIMIT:
                known.clear()
        for chunk in set(chunks).difference(known):
            known[chunk] = b"".join([known.get(w) or self._word(w) for w in self.WORDS.findall(chunk)])
        return b"".join(map(known.__getitem__, chunks))

    def _word(self, word: str) -> bytes:
        written = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(_BYTES)
        ids = array("I", [t.id for t in self._tokenizer.model.tokenize(written)]).tobytes()
        self._known[word] = ids
        return ids


_ENCODERS: dict = {}


def encoder_of(path: str, *, special_as_text: bool = False) -> Encoder:
    """One encoder a Python worker, so that what it remembers serves every task the worker runs."""
    if (path, special_as_text) not in _ENCODERS:
        _ENCODERS[path, special_as_text] = Encoder(path, special_as_text=special_as_text)
    return _ENCODERS[path, special_as_text]


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below ``2 ** bits`` in ``bits`` bits each, low bit first, padded to a byte."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return rows[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(rows, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a packed payload."""
    raw = np.frombuffer(payload, np.uint8)
    rows = np.zeros((n, 4), np.uint8)
    if bits % 8 == 0:
        rows[:, : bits // 8] = raw[: n * bits // 8].reshape(n, -1)
    else:
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :bits] = np.unpackbits(raw, bitorder="little")[: n * bits].reshape(n, bits)
        rows = np.packbits(wide, axis=1, bitorder="little")
    return rows.reshape(-1).view("<u4")


def whole_number(text) -> int | None:
    """An id that came as text, exactly; None for null."""
    return None if pd.isna(text) else int(text)


def file_bytes(doc_ids: list[int | None], ids: list[np.ndarray], bits: int, block: int = BLOCK) -> bytes:
    """One file's content for documents in order."""
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    blocks = [pack(flat[k : k + block], bits) for k in range(0, len(flat), block)]
    head = MAGIC + np.array([bits, block], "<u4").tobytes() + np.array([len(ids), len(flat)], "<u8").tobytes()
    ends, offsets = np.cumsum([len(x) for x in ids], dtype="<u8"), np.cumsum([0, *map(len, blocks)], dtype="<u8")
    numbers, missing = np.array([i or 0 for i in doc_ids], "<i8"), np.array([i is None for i in doc_ids], np.uint8)
    return b"".join([head, numbers.tobytes(), ends.tobytes(), missing.tobytes(), offsets.tobytes(), *blocks])


class PackedFile:
    """Random access to one file's content: ``ids(first, last)`` touches only the blocks that hold them."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a packed token file")
        self.bits, self.block = (int(x) for x in np.frombuffer(content, "<u4", 2, 8))
        self.n_docs, self.n_ids = (int(x) for x in np.frombuffer(content, "<u8", 2, 16))
        missing = np.frombuffer(content, np.uint8, self.n_docs, 32 + 16 * self.n_docs).tolist()
        numbers = np.frombuffer(content, "<i8", self.n_docs, 32).tolist()
        self.doc_ids = [None if gone else number for number, gone in zip(numbers, missing, strict=True)]
        self.doc_ends = np.frombuffer(content, "<u8", self.n_docs, 32 + 8 * self.n_docs)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(content, "<u8", n_blocks + 1, 32 + 17 * self.n_docs)
        self._content, self._start = content, 32 + 17 * self.n_docs + 8 * (n_blocks + 1)

    def ids(self, first: int, last: int) -> np.ndarray:
        if first >= last:
            return np.empty(0, np.uint32)
        a, b = first // self.block, -(-last // self.block)
        parts = []
        for k in range(a, b):
            n = min(self.block, self.n_ids - k * self.block)
            parts.append(unpack(self._content[self._start + int(self.offsets[k]) : self._start + int(self.offsets[k + 1])], self.bits, n))
        return np.concatenate(parts)[first - a * self.block : last - a * self.block]


def store_of(uri: str):
    """The pyarrow file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def save(folder: str, name: str, content: bytes) -> str:
    """Write one file whole; a reader never sees a part of it."""
    store, path = store_of(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/_{name}") as out:
        out.write(content)
    store.move(f"{path}/_{name}", f"{path}/{name}")
    return f"{folder}/{name}"


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ranges of ascending id, null last; rows of one id by a hash of their text, equal ones by where they come from.

    So an id, or a row, that is there any number of times is split over partitions.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash"), F.col("came_from")]
    rows = docs.select("doc_id", "text").withColumns({"hash": F.xxhash64("text"), "came_from": F.monotonically_increasing_id()})
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


MANIFEST = "path string, partition int, part int, n_docs bigint, n_ids bigint"


def write_tokens(docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = END_ID, block: int = BLOCK, file_ids: int = FILE_IDS) -> DataFrame:
    """Write ``docs`` (doc_id, text) as packed files in ascending doc_id; returns the manifest, written once."""
    path = tokenizer or default_tokenizer()

    def write(batches):
        encoder, partition, part, doc_ids, ids, n = encoder_of(path), TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([end_id], np.uint32)

        def close():
            name = f"tokens-{partition:06d}-{part:06d}-{uuid.uuid4().hex}.bin"
            saved = save(folder, name, file_bytes(doc_ids, ids, max(encoder.bits, int(end_id).bit_length()), block))
            return pd.DataFrame([(saved, partition, part, len(doc_ids), n)], columns=["path", "partition", "part", "n_docs", "n_ids"])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                doc_ids.append(whole_number(doc_id))
                ids.append(np.concatenate([encoder.encode(text), end]))
                n += len(ids[-1])
                if n >= file_ids:
                    yield close()
                    part, doc_ids, ids, n = part + 1, [], [], 0
        if doc_ids:
            yield close()

    sorted_docs = in_order(docs)
    return cut_lineage(sorted_docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(write, MANIFEST))


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all before it), n_tokens, ids_crc32."""
    order = Window.orderBy("partition", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = manifest.select(F.substring_index("path", "/", -1).alias("name"), "path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))
    one = placed.first()
    if one is None:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    files = spark.read.format("binaryFile").load(one.path[: -len(one.name) - 1])

    def read(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                packed, first, rows = PackedFile(content), 0, []
                flat, name = packed.ids(0, packed.n_ids), path.rsplit("/", 1)[-1]
                for doc_id, last in zip(packed.doc_ids, packed.doc_ends.tolist(), strict=True):
                    rows.append((name, None if doc_id is None else str(doc_id), first, last - first, zlib.crc32(flat[first:last])))
                    first = last
                yield pd.DataFrame(rows, columns=["file", "doc_id", "first", "n_tokens", "ids_crc32"])

    # the files' contents stay where they are read; only their narrow rows meet the manifest, which also leaves
    # out files that no successful attempt has listed
    rows = files.select("path", "content").mapInPandas(read, "file string, doc_id string, first bigint, n_tokens bigint, ids_crc32 bigint")
    joined = rows.join(placed.select("name", "before"), F.col("file") == F.col("name"))
    return joined.select(F.col("doc_id").cast("bigint"), (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op8_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(spark, write_tokens(docs, new_folder(spark, "packed-tokens")))
