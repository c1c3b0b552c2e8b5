"""Token counts of flat, unindexed token files by a scan for separators.

A flat file is nothing but little-endian ids of a fixed width, each document closed by an end-of-document id;
no index says where documents start. Files are cut into blocks of ``block_ids`` ids whatever they hold. A task
reads one block and finds the separators with one vectorised comparison. Documents that end inside a block
where another document ended before are finished there; what a block leaves open at its front and its end is
stitched by a prefix scan over the per-block summaries: a window per file in block order, which carries the
ids since the last separator. A document may run over any number of blocks.

Defined cases: an empty file holds no document; two separators in a row close an empty document of one id (the
separator counts as a token of its document); ids after a file's last separator are one last, unclosed
document; a null or empty text writes only its separator. Ids are two bytes wide where the vocabulary allows, else
four; a width that is given and can't hold the vocabulary is an error. Document ids of any size are kept exactly.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.lineage import new_folder, written
from tallyspark.llm.token_output import default_tokenizer, encoder_of, save, store_of

END_ID = 49407  # the vocabulary's own end of text; no text encodes to it, as special tokens' names count as text
BLOCK_IDS = 1 << 20
FILE_IDS = 32 << 20


def id_type(tokenizer: str | None = None, end_id: int = END_ID, dtype: str | None = None) -> str:
    """The numpy type of the files' ids: what the vocabulary and the separator need, or the given one if it suffices."""
    bits = max(encoder_of(tokenizer or default_tokenizer(), special_as_text=True).bits, int(end_id).bit_length())
    if dtype is not None and np.iinfo(dtype).max < 2**bits - 1:
        raise ValueError(f"{dtype} can't hold ids of {bits} bits")
    return dtype or ("<u2" if bits <= 16 else "<u4")


def write_flat(docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = END_ID, dtype: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Write (doc_id, text) as flat files, in the order and tasks of the scan, so no text moves.

    Returns one row a document: path, ordinal, doc_id. The files don't hold the ids; only this table does.
    """
    path = tokenizer or default_tokenizer()
    dtype = id_type(path, end_id, dtype)

    def write(batches):
        encoder, partition, part = encoder_of(path, special_as_text=True), TaskContext.get().partitionId(), 0
        chunks, doc_ids, n = [], [], 0

        def close():
            saved = save(folder, f"flat-{partition:06d}-{part:06d}-{uuid.uuid4().hex}.ids", b"".join(chunks))
            return pd.DataFrame({"path": saved, "partition": partition, "part": part, "ordinal": range(len(doc_ids)), "doc_id": doc_ids, "file_ids": n})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                ids = encoder.encode(text)
                chunks += [ids.astype(dtype).tobytes(), np.array([end_id], dtype).tobytes()]
                doc_ids.append(doc_id)  # as text, so that a null beside it doesn't round it
                n += len(ids) + 1
                if n >= file_ids:
                    yield close()
                    part, chunks, doc_ids, n = part + 1, [], [], 0
        if doc_ids:
            yield close()

    listed = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(write, "path string, partition int, part int, ordinal bigint, doc_id string, file_ids bigint")
    return written(listed.withColumn("doc_id", F.col("doc_id").cast("bigint")), "flat-manifest")


def count_tokens(spark: SparkSession, files: DataFrame, *, end_id: int = END_ID, dtype: str = "<u2", block_ids: int = BLOCK_IDS) -> DataFrame:
    """``files``: path and file_ids (their length). One row a document: path, ordinal, start, n_tokens."""
    width = np.dtype(dtype).itemsize
    blocks = files.select("path", "file_ids", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("file_ids") / block_ids) - 1).cast("bigint"))).alias("block"))
    blocks = blocks.where(F.col("block") * block_ids < F.col("file_ids"))

    def search(batches):
        for batch in batches:
            for path, total, block in zip(batch["path"], batch["file_ids"].tolist(), batch["block"].tolist(), strict=True):
                store, inner = store_of(path)
                first, n = block * block_ids, min(block_ids, total - block * block_ids)
                with store.open_input_file(inner) as source:
                    ids = np.frombuffer(source.read_at(n * width, first * width), dtype)
                ends = (np.flatnonzero(ids == end_id) + 1).tolist()
                yield pd.DataFrame({"path": [path], "block": [block], "first": [first], "n": [n], "ends": [ends]})

    found = blocks.repartition("path", "block").mapInPandas(search, "path string, block bigint, first bigint, n bigint, ends array<bigint>")
    found = written(found, "separators")
    # prefix scan over one narrow row a block: documents before it, and where the document that is open began
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("path").orderBy("block")
    some = F.size("ends") > 0
    scan = found.select("path", "block", "n", F.size("ends").alias("closed"), F.when(some, F.col("first") + F.element_at("ends", -1)).alias("last_end"), (F.col("first") + F.col("n")).alias("upto"))
    scan = scan.select(
        F.col("path").alias("of_path"), F.col("block").alias("of_block"),
        F.coalesce(F.sum("closed").over(before), F.lit(0)).alias("ordinal0"),
        F.coalesce(F.last("last_end", ignorenulls=True).over(before), F.lit(0)).alias("open_at"),
        "last_end", "upto", F.lead("block").over(after).isNull().alias("is_last"),
    )
    ends = F.transform("ends", lambda e: F.col("first") + e)
    starts = F.concat(F.array(F.col("open_at")), F.slice(ends, 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    joined = found.join(scan, (F.col("path") == F.col("of_path")) & (F.col("block") == F.col("of_block")))
    closed = joined.where(some).select("path", "ordinal0", F.posexplode(F.arrays_zip(starts.alias("start"), ends.alias("until"))).alias("k", "d"))
    closed = closed.select("path", (F.col("ordinal0") + F.col("k")).alias("ordinal"), F.col("d.start").alias("start"), (F.col("d.until") - F.col("d.start")).alias("n_tokens"))
    begun = F.coalesce("last_end", "open_at")
    tail = joined.where(F.col("is_last") & (F.col("upto") > begun)).select("path", (F.col("ordinal0") + F.size("ends")).alias("ordinal"), begun.alias("start"), (F.col("upto") - begun).alias("n_tokens"))
    return closed.unionByName(tail)


def op6_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_flat(docs, new_folder(spark, "flat-tokens"))
    files = manifest.groupBy("path").agg(F.first("file_ids").alias("file_ids"))
    counted = count_tokens(spark, files, dtype=id_type())
    return counted.join(manifest.select("path", "ordinal", "doc_id"), ["path", "ordinal"]).select("doc_id", "ordinal", F.col("start"), "n_tokens")
