"""WARC archives of pages, written and read as a table of chunks.

A payload is never one cell of a Python worker: it travels as rows (record, chunk number, bytes) of at most
``CHUNK_BYTES``. The writer streams a record's chunks into a compressed archive and carries their digest along, which
must end as the record's header says; the reader streams archives back into chunks, each with the bytes and the SHA-256
of its payload so far, so the last chunk of a record has the whole payload's. Either side holds one batch of chunks,
whatever a payload's size. The table's own cell of a page is cut into chunks in the JVM.

Archives are WARC 1.1, a gzip member a record (``compress=False``: none), at most about ``file_bytes`` each, and named by
the manifest that ``write_archives`` returns; files of attempts that failed are in no manifest. ``read_chunks`` also
takes archives of others, plain or compressed, with any record types.

Of records with equal payloads of at least ``REVISIT_FROM`` bytes that with the smallest page_id is a response, the others
are revisits that name it and hold no payload; smaller ones are responses. Which payloads repeat is found from their
digests; pages meet that narrow table, which Spark broadcasts or splits where one payload has many pages.

Defined cases: a null page_id is larger than any other, a null html is an empty payload, a null url is written as the
record's own id. Pages that repeat both the smallest page_id and its payload are all responses, and, like any repeated
page, share a record id. A payload that differs from its digest, or an archive that ends inside a record, is an error. An
empty table writes no archive and gives no rows. Other columns play no part.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.lineage import new_folder, partitions_of, written
from tallyspark.llm.token_output import store_of

REVISIT_FROM = 100
CHUNK_BYTES = 1 << 14
FILE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"  # a page has no time of its own, and reruns give equal archives
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(*parts: Column) -> Column:
    """A URN made of a digest of the parts."""
    raw = F.sha2(F.concat_ws(" ", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]), 256)
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(raw, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def records(pages: DataFrame, *, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """A row a page: record_id, record_type, page_id, url, payload, payload_bytes, payload_digest, refers_to, refers_to_id."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    sized = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), payload.alias("payload"))
    sized = sized.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha2("payload", 256)})
    smallest = F.min(F.struct(F.col("page_id").isNull(), "page_id"))
    repeated = sized.where(F.col("payload_bytes") >= revisit_from).groupBy(F.col("payload_digest").alias("digest")).agg(F.count("*").alias("n"), smallest["page_id"].alias("first_id"))
    # written first, so that Spark knows its size: where little repeats, it is broadcast and no payload moves
    repeated = written(repeated.where("n > 1"), "repeated-payloads")
    joined = sized.join(repeated, F.col("payload_digest") == F.col("digest"), "left")
    revisits = F.col("digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    response_id, revisit_id = (_record_id(F.lit(kind), F.col(c), F.col("payload_digest")) for kind, c in (("response", "page_id"), ("revisit", "page_id")))
    return joined.select(
        F.when(revisits, revisit_id).otherwise(response_id).alias("record_id"), F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        "page_id", "url", F.when(~revisits, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisits, F.col("first_id")).alias("refers_to"), F.when(revisits, _record_id(F.lit("response"), F.col("first_id"), F.col("payload_digest"))).alias("refers_to_id"),
    )


def chunks_of(found: DataFrame, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``records`` with chunk, n_chunks and data in place of the payload; a record's rows follow one another in order."""
    held = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("bigint")
    n = F.greatest(F.ceil(held / chunk_bytes), F.lit(1))
    numbered = found.withColumn("n_chunks", n).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_chunks") - 1)))
    data = F.substring(F.coalesce("payload", F.lit(b"")), (F.col("chunk") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    return numbered.select("record_id", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to_id", "chunk", "n_chunks", data.alias("data"))


class Archive:
    """One archive file that is written record by record, in parts of any size."""

    def __init__(self, folder: str, name: str, compress: bool):
        self._store, path = store_of(folder)
        self._store.create_dir(path, recursive=True)
        self._name, self._at, self._compress, self.records = f"{path}/{name}", f"{path}/_{name}", compress, 0
        self._out, self.path, self.bytes = self._store.open_output_stream(self._at), f"{folder}/{name}", 0
        self.begin([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, name).urn}>"), ("Content-Type", "application/warc-fields"), ("Content-Length", "0")])
        self.end()

    def begin(self, headers: list[tuple[str, str]], http: str = "") -> None:
        self._packer = zlib.compressobj(6, zlib.DEFLATED, 31) if self._compress else None
        lines = ["WARC/1.1", *[f"{name}: {value}" for name, value in headers], f"WARC-Date: {DATE}", "", ""]
        self.add("\r\n".join(lines).encode() + http.encode())

    def add(self, data: bytes) -> None:
        raw = self._packer.compress(data) if self._packer else data
        self._out.write(raw)
        self.bytes += len(raw)

    def end(self) -> None:
        self.add(b"\r\n\r\n")
        if self._packer:
            raw = self._packer.flush()
            self._out.write(raw)
            self.bytes += len(raw)
        self.records += 1

    def close(self) -> None:
        """The file gets its name once it is whole."""
        self._out.close()
        self._store.move(self._at, self._name)


def _headers(row: dict) -> tuple[list[tuple[str, str]], str]:
    """A record's WARC headers and the HTTP headers that begin its block; a revisit's block is these alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    held = 0 if row["record_type"] == "revisit" else row["payload_bytes"]
    target = row["record_id"] if row["url"] is None else urllib.parse.quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~")
    headers = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + held)),
    ]
    if row["page_id"] is not None:
        headers.append(("Page-ID", str(row["page_id"])))
    if row["record_type"] == "revisit":
        headers += [("WARC-Refers-To", f"<{row['refers_to_id']}>"), ("WARC-Profile", SAME_PAYLOAD)]
    return headers, http


def write_archives(pages: DataFrame, folder: str, *, revisit_from: int = REVISIT_FROM, chunk_bytes: int = CHUNK_BYTES, file_bytes: int = FILE_BYTES, compress: bool = True) -> DataFrame:
    """Write a record for each of ``pages`` (page_id, url, html); returns the archives: path, n_records, n_bytes."""

    def write(batches):
        archive, digest, partition = None, None, TaskContext.get().partitionId()

        def closed() -> pa.RecordBatch:
            archive.close()
            return pa.RecordBatch.from_pydict({"path": [archive.path], "n_records": pa.array([archive.records - 1], pa.int64()), "n_bytes": pa.array([archive.bytes], pa.int64())})

        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                if row["chunk"] == 0:
                    if archive is not None and archive.bytes >= file_bytes:
                        yield closed()
                        archive = None
                    archive = archive or Archive(folder, f"pages-{partition:06d}-{uuid.uuid4().hex}.warc{'.gz' if compress else ''}", compress)
                    archive.begin(*_headers(row))
                    digest = hashlib.sha256()
                digest.update(row["data"])
                archive.add(row["data"])
                if row["chunk"] == row["n_chunks"] - 1:
                    archive.end()
                    if row["record_type"] == "response" and digest.hexdigest() != row["payload_digest"]:
                        raise ValueError(f"the payload of {row['record_id']} is not what its digest says")
        if archive is not None:
            yield closed()

    chunks = chunks_of(records(pages, revisit_from=revisit_from), chunk_bytes=chunk_bytes)
    return written(chunks.mapInArrow(write, "path string, n_records bigint, n_bytes bigint"), "archives")


def _fields(stream: io.BufferedReader) -> tuple[dict[str, str], int]:
    """Header lines up to the empty one, by lower-case name, and how many bytes they took."""
    found, size = {}, 0
    while line := stream.readline():
        size += len(line)
        if not line.strip():
            break
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found, size


def _unpacked(raw: io.BufferedReader) -> io.BufferedReader:
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def read_stream(raw: io.BufferedReader, *, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """The chunks of every record of an archive, in order; each has what ``CHUNK`` names."""
    stream = _unpacked(raw)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields, _ = _fields(stream)
        left = int(fields["content-length"])
        if fields.get("content-type", "").startswith("application/http") and left:
            _, size = _fields(stream)  # the status line counts among the headers
            left -= size
        page_id, refers = fields.get("page-id"), fields.get("warc-refers-to")
        row = {
            "record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": fields.get("warc-type"), "page_id": int(page_id) if page_id else None,
            "target_uri": fields.get("warc-target-uri"), "refers_to_id": refers and refers.strip("<>"),
            "declared_digest": fields.get("warc-payload-digest", "").rpartition(":")[2] or None,
        }
        digest, chunk, size = hashlib.sha256(), 0, 0
        while True:
            data = stream.read(min(left, chunk_bytes))
            if len(data) < min(left, chunk_bytes):
                raise ValueError(f"the archive ends inside {row['record_id']}")
            left, size = left - len(data), size + len(data)
            digest.update(data)
            yield row | {"chunk": chunk, "is_last": not left, "bytes_so_far": size, "digest_so_far": digest.copy().hexdigest(), "data": data}
            chunk += 1
            if not left:
                break


CHUNK = pa.schema([
    ("path", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("refers_to_id", pa.string()),
    ("declared_digest", pa.string()), ("chunk", pa.int64()), ("is_last", pa.bool_()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("data", pa.binary()),
])
CHUNK_SQL = (
    "path string, record_id string, record_type string, page_id bigint, target_uri string, refers_to_id string, "
    "declared_digest string, chunk bigint, is_last boolean, bytes_so_far bigint, digest_so_far string, data binary"
)


def read_chunks(files: DataFrame, *, chunk_bytes: int = CHUNK_BYTES, data: bool = True) -> DataFrame:
    """The chunk table of archives (path), see ``CHUNK_SQL``; without ``data`` that column is null, and only last chunks are rows.

    Digests are taken of whole payloads either way.
    """

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = store_of(path)
                rows, size = [], 0
                with store.open_input_stream(name) as file:
                    for row in read_stream(io.BufferedReader(file, 1 << 18), chunk_bytes=chunk_bytes):
                        if data or row["is_last"]:
                            rows.append(row | {"path": path, "data": row["data"] if data else None})
                            size += 500 + (len(row["data"]) if data else 0)
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=CHUNK)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=CHUNK)

    spread = files.select("path").repartition(partitions_of(files.sparkSession), "path")
    return spread.mapInArrow(read, CHUNK_SQL)


def read_records(spark: SparkSession, files: DataFrame) -> DataFrame:
    """A row a response or revisit of archives: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    A revisit has the payload of the record that it names. ``intact``: the payload's digest is what the record declares.
    """
    ends = written(read_chunks(files, data=False).where(F.col("is_last") & F.col("record_type").isin("response", "revisit")), "archive-records")
    kept = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "declared_digest"]
    responses = ends.where("record_type = 'response'")
    whole = [F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest")]
    first = responses.select("page_id", *whole, "record_type", F.lit(None).cast("bigint").alias("refers_to"), "declared_digest")
    named = responses.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.first(F.struct(F.col("page_id").alias("refers_to"), *whole)).alias("named"))
    revisits = ends.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to_id", "declared_digest")
    found = revisits.join(named, "refers_to_id", "left").select("page_id", "named.*", "record_type", "declared_digest").select(*kept)
    both = first.select(*kept).unionByName(found)
    return both.select(*kept[:-1], F.col("payload_digest").eqNullSafe(F.col("declared_digest")).alias("intact"))


def op13_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = write_archives(pages, new_folder(spark, "warc"))
    return read_records(spark, archives).drop("intact")


OP13_SQL = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), grouped AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM sized
), typed AS (
  SELECT *, payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AS revisits FROM grouped
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisits THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN revisits THEN first_id END AS refers_to
FROM typed
"""
