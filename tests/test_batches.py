"""Appends that survive retries, and what is kept up to date from batches."""
import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators.classify import merged_pending, pending_snapshots
from vitrine.operators.records import latest_open, merged_latest
from vitrine.sources import batches

SCHEMA = "id int, name string"


def _rows(spark, *ids):
    return spark.createDataFrame([(i, f"n{i}") for i in ids], SCHEMA)


def test_a_batch_that_is_added_again_replaces_itself_only(spark, tmp_path):
    path = str(tmp_path / "table")
    assert batches.read_batches(spark, path, SCHEMA).count() == 0 and batches.manifest(spark, path).count() == 0
    assert batches.append_batch(_rows(spark, 1, 2), path, "one") == 1
    assert batches.append_batch(_rows(spark, 3), path, "two") == 1
    before = batches.read_batches(spark, path, SCHEMA)
    assert batches.append_batch(_rows(spark, 1, 4), path, "one") == 2
    assert sorted(r["id"] for r in before.collect()) == [1, 2, 3]  # a reader that has begun is not disturbed
    now = batches.read_batches(spark, path, SCHEMA, name="batch").collect()
    assert sorted((r["id"], r["batch"]) for r in now) == [(1, "one"), (3, "two"), (4, "one")]
    assert [r["id"] for r in batches.read_batches(spark, path, SCHEMA, ["two"]).collect()] == [3]
    assert [tuple(r)[:2] for r in batches.superseded(spark, path).collect()] == [("one", 1)]


def test_a_run_that_fails_before_its_commit_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "table")
    batches.append_batch(_rows(spark, 1), path, "one")
    broken = _rows(spark, 2, 3).withColumn("name", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        batches.append_batch(broken, path, "one")
    _rows(spark, 9).write.parquet(f"{path}/left-behind")
    assert [r["id"] for r in batches.read_batches(spark, path, SCHEMA).collect()] == [1]


def test_empty_batches_and_new_columns(spark, tmp_path):
    path = str(tmp_path / "table")
    batches.append_batch(_rows(spark, 1).drop("name"), path, "old")
    batches.append_batch(_rows(spark), path, "none")
    batches.append_batch(_rows(spark, 2), path, "new")
    assert sorted(map(tuple, batches.read_batches(spark, path, SCHEMA).collect())) == [(1, None), (2, "n2")]
    assert {r["batch"]: r["n"] for r in batches.manifest(spark, path).collect()} == {"old": 1, "none": 0, "new": 1}


def test_compaction_keeps_every_row_once_and_can_run_again(spark, tmp_path):
    path = str(tmp_path / "table")
    for i in range(4):
        batches.append_batch(_rows(spark, i), path, f"b{i}")
    for _ in range(2):
        batches.compact(spark, path, SCHEMA, ["b0", "b1", "all"], "all")
        assert sorted(r["id"] for r in batches.read_batches(spark, path, SCHEMA).collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="rows of its own"):
        batches.compact(spark, path, SCHEMA, ["b2"], "b3")
    assert {r["batch"]: r["n"] for r in batches.manifest(spark, path).collect()} == {"b0": 0, "b1": 0, "b2": 1, "b3": 1, "all": 2}


def test_merged_state_is_that_of_all_rows(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, r.randrange(12), f"2024-0{r.randint(1, 9)}-01", r.random() < 0.6, f"k{i}") for i in range(200)]
    snaps = spark.createDataFrame(rows, "snapshot_id long, candidate_id int, day string, is_open_dir boolean, server_kind string")
    snaps = snaps.select("*", F.to_timestamp("day").alias("fetched_at")).drop("day")
    verdicts = snaps.where("snapshot_id % 3 = 0").select("snapshot_id", F.lit("1.1.0").alias("ruleset_version"))
    whole = {tuple(x) for x in latest_open(snaps, "server_kind").collect()}
    path, state, pending = str(tmp_path / "snaps"), None, snaps.limit(0)
    for i in (2, 0, 1, 0):  # out of order, and one twice
        part = snaps.where(F.col("snapshot_id") % 3 == i)
        batches.append_batch(part, path, f"part{i}")
        new = batches.read_batches(spark, path, snaps.schema, [f"part{i}"])
        state = latest_open(new, "server_kind") if state is None else merged_latest(state, new, "server_kind")
        state = spark.createDataFrame(state.collect(), state.schema)
        pending = merged_pending(pending, new, verdicts.where(F.col("snapshot_id") % 3 == i))
        pending = spark.createDataFrame(pending.collect(), pending.schema)
    assert {tuple(x) for x in state.collect()} == whole
    assert {x["snapshot_id"] for x in pending.collect()} == {x["snapshot_id"] for x in pending_snapshots(snaps, verdicts).collect()}


def test_a_merge_reads_the_batch_and_the_state_only(spark, tmp_path):
    path = str(tmp_path / "snaps")
    snaps = spark.createDataFrame([(1, 1, True), (2, 1, True)], "snapshot_id long, candidate_id int, is_open_dir boolean").withColumn("fetched_at", F.timestamp_seconds("snapshot_id"))
    for i in (1, 2):
        batches.append_batch(snaps.where(F.col("snapshot_id") == i), path, f"b{i}")
    latest_open(snaps.where("snapshot_id = 1")).write.parquet(str(tmp_path / "state"))
    merged = merged_latest(spark.read.parquet(str(tmp_path / "state")), batches.read_batches(spark, path, snaps.schema, ["b2"]))
    old = batches.manifest(spark, path).where("batch = 'b1'").first()["folder"]
    read = merged.inputFiles()
    assert len(read) >= 2 and not any(old in f for f in read) and merged.first()["snapshot_id"] == 2
