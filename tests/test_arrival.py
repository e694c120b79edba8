"""Numbers in the order of arrival and places in groups, over many ranges."""
import json
import random

from pyspark.sql import functions as F

from vitrine.operators import host_files, payloads
from vitrine.operators.arrival import _ranged, file_lines, located, with_place, with_sequence
from vitrine.sources import captures


def test_sequence_is_dense_and_in_order(spark):
    r = random.Random(2)
    rows = [(r.choice([None, *range(40)]), r.choice("ab")) for _ in range(500)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(7)
    found = with_sequence(df, "k", name="n", start=11).collect()
    assert sorted(x["n"] for x in found) == list(range(11, 511))
    keys = [-1 if x["k"] is None else x["k"] for x in sorted(found, key=lambda x: x["n"])]
    assert keys == sorted(keys) and sorted((x["k"] or -1, x["v"]) for x in found) == sorted((k or -1, v) for k, v in rows)
    assert with_sequence(df.limit(0), "k").count() == 0
    assert [x["n"] for x in with_sequence(spark.range(5, 50, 1, 6), name="n").orderBy("id").collect()] == list(range(1, 46))


def test_places_of_a_group_that_fills_many_ranges(spark):
    r = random.Random(3)
    rows = [("hub" if i % 3 else r.choice([None, "a", "b"]), r.randrange(10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, size int, i int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    placed = with_place(df, "g", F.desc("size"), "i").collect()
    by = {}
    for x in placed:
        by.setdefault(x["g"], []).append(x)
    for g, found in by.items():
        found.sort(key=lambda x: x["place"])
        assert [x["place"] for x in found] == list(range(1, len(found) + 1)), g
        assert [(-x["size"], x["i"]) for x in found] == sorted((-x["size"], x["i"]) for x in found)
    assert _ranged(df, [F.col("g"), F.col("i")]).where("g = 'hub'").select("_range").distinct().count() > 2
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines_are_numbered_by_file_and_place(spark, tmp_path):
    r = random.Random(4)
    texts = {f"f{i}.txt": [r.choice(["same", "same", f"line {j}"]) for j in range(r.randint(0, 400))] for i in range(4)}
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("256", "1000000"):  # many splits of one file, several files in one partition
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            found = file_lines(located(spark.read.text(str(tmp_path)))).orderBy("line").collect()
            assert [x["value"] for x in found] == [x for name in sorted(texts) for x in texts[name]]
            assert [x["line"] for x in found] == list(range(1, len(found) + 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_equal_capture_lines_are_two_snapshots(spark, tmp_path):
    line = json.dumps({"url": "http://roggen.test/", "error": "zu langsam"})
    (tmp_path / "a.jsonl").write_text(f"{line}\n{line}\n")
    owners = spark.createDataFrame([(1, "http://roggen.test/")], "candidate_id int, url string")
    ids = [[r["snapshot_id"] for r in captures.ingest_captures(captures.read_captures(spark, str(tmp_path), 70), owners)[0].collect()] for _ in range(2)]
    assert sorted(ids[0]) == sorted(ids[1]) == [71, 72]


def test_the_last_result_wins_and_the_oldest_waits_first(spark):
    results = [(5, "http://h.test/a.exe", "first", 1), (5, "http://h.test/b.exe", "b", 2), (5, "http://h.test/a.exe", "last", 3), (5, "http://h.test/a.exe", None, 4)]
    results = spark.createDataFrame(results, "snapshot_id int, url string, sha256 string, line int").withColumns(
        {c: F.lit(None).cast(t) for c, t in (("md5", "string"), ("tlsh", "string"), ("size", "long"), ("error", "string"))})
    names = spark.createDataFrame([(5, "http://h.test/a.exe", "a.exe", 0), (5, "http://h.test/b.exe", "b.exe", 1)], "snapshot_id int, url string, name string, pos int")
    loaded = payloads.load_hashes(results.repartition(3), names, order=("line",), above=100)
    loaded = spark.createDataFrame(loaded.collect(), loaded.schema)
    assert [r["sha256"] for r in loaded.orderBy("hash_id").collect()] == ["first", "b", "last", ""]
    assert {r["name"]: r["hash"]["sha256"] for r in host_files.hashes_by_file(loaded).collect()} == {"a.exe": "last", "b.exe": "b"}
    assert [r["hash_id"] for r in payloads.vt_pending(loaded, 2).collect()] == [101, 102]
