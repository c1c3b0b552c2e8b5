"""Tables in buckets, and the ledger of landed files."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import merges
from tallyspark.sources import tables
from tallyspark.streaming.ingest import ingest_new_files, read_ingested, read_ledger

SCHEMA = "k string, method string, v int"
RANK = "CASE WHEN method = 'strong' THEN 0 ELSE 1 END"


def files(path):
    return set(glob.glob(f"{path}/bucket=*/*.parquet"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    standing = spark.createDataFrame([(f"k{k}", "strong" if k % 2 else "weak", k) for k in range(40)] + [(None, "weak", -1)], SCHEMA)
    merges.write_buckets(standing, path, ["k"], 8)
    before = files(path)
    batch = spark.createDataFrame([("k2", "weak", 100), ("k3", "weak", 100), (None, "weak", 5)], SCHEMA)
    touched = merges.upsert_into(path, batch, ["k"], 8, F.expr(RANK))
    expected = {r[0] for r in batch.select(merges.bucket_of(["k"], 8)).collect()}
    assert set(touched) == expected
    untouched = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in expected}
    assert untouched and untouched <= files(path)  # their files keep their names
    want = {**{f"k{k}": k for k in range(40)}, "k2": 100, None: 5}
    assert {r.k: r.v for r in merges.read_buckets(spark, path, SCHEMA).collect()} == want
    merges.upsert_into(path, spark.createDataFrame([("new", "weak", 1)], SCHEMA), ["k"], 8, F.expr(RANK))
    assert merges.read_buckets(spark, path, SCHEMA).count() == 42
    assert merges.upsert_into(path, batch.limit(0), ["k"], 8, F.expr(RANK)) == []


def test_a_failed_check_leaves_all_as_it_was(spark, tmp_path):
    path = str(tmp_path / "t")
    merges.write_buckets(spark.createDataFrame([("a", "weak", 1), ("b", "weak", 2)], SCHEMA), path, ["k"], 4)
    before, content = files(path), rows(merges.read_buckets(spark, path, SCHEMA))
    twice = spark.createDataFrame([("a", "weak", 3)], SCHEMA)
    with pytest.raises(ValueError, match="stands twice"):
        merges.merge_batch(path, twice, ["k"], 4, lambda standing, batch: standing.unionByName(batch), check=merges.unique_keys(["k"]))
    with pytest.raises(ValueError, match="doesn't touch"):
        merges.merge_batch(path, twice, ["k"], 4, lambda standing, batch: batch.unionByName(batch.sparkSession.range(50).select(F.col("id").cast("string").alias("k"), F.lit("weak").alias("method"), F.lit(0).alias("v"))))
    assert files(path) == before and rows(merges.read_buckets(spark, path, SCHEMA)) == content


def test_superseded_rows_stay(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "d string, line int, superseded boolean"
    merges.write_buckets(spark.createDataFrame([("a", 1, False), ("b", 1, False)], schema), path, ["d"], 4)
    for line in (2, 3):
        merges.supersede_into(path, spark.createDataFrame([("a", line, False)], schema), "d", 4)
    assert rows(merges.read_buckets(spark, path, schema)) == [("a", 1, True), ("a", 2, True), ("a", 3, False), ("b", 1, False)]


def landed(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    schema = tables.text_schema("id", "fy")
    run = lambda checkpoint="ck": ingest_new_files(spark, str(landing), out, str(tmp_path / checkpoint), schema, ["id"])
    return landing, out, run, lambda: rows(read_ingested(spark, out, schema))


def test_a_copy_by_another_name_and_a_lost_checkpoint_add_nothing(spark, tmp_path):
    landing, out, run, read = landed(spark, tmp_path)
    (landing / "a.csv").write_text("id,fy\n1,2024\n2,2025\n,2025\n")
    run()
    (landing / "copy.csv").write_text("id,fy\n2,2025\n1,2024\n,2025\n")  # the same rows in another order
    run()
    assert read() == [("1", "2024"), ("2", "2025")]
    shutil.rmtree(tmp_path / "ck")
    (landing / "b.csv").write_text("id,fy\n1,2024\n")
    (landing / "b2.csv").write_text("id,fy\n1,2024\n")
    run("another")
    assert read() == [("1", "2024"), ("1", "2024"), ("2", "2025")]
    assert [(r.file_name, r.n_rows, r.n_rejected) for r in read_ledger(spark, out).orderBy("file_name").collect()] == [("a.csv", 2, 1), ("b.csv", 1, 0)]


def test_rows_of_a_batch_that_broke_off_are_not_read_and_are_made_good(spark, tmp_path):
    landing, out, run, read = landed(spark, tmp_path)
    (landing / "a.csv").write_text("id,fy\n1,2024\n")
    run()
    (landing / "b.csv").write_text("id,fy\n5,2024\n")
    run()
    ledger = sorted(glob.glob(f"{out}/_ledger/*.parquet"), key=os.path.getmtime)
    os.remove(ledger[-1])  # as if the last batch had ended between its rows and its ledger row
    assert read() == [("1", "2024")]
    run("another")
    assert read() == [("1", "2024"), ("5", "2024")]
