"""Objects of one array in a JSON document, found from pieces of it."""
import json
import random

from vitrine.sources import exports
from vitrine.sources.split_json import read_array_objects


def _value(r, depth=0):
    kind = r.randrange(8 if depth < 3 else 5)
    if kind < 2:
        return "".join(r.choice('a"\\{}[],:ü \n') for _ in range(r.randrange(8)))
    if kind < 5:
        return [r.randrange(10**6), None, True][kind - 2]
    if kind == 5:
        return [_value(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice(["matches", "b", "c}", "[d"]): _value(r, depth + 1) for _ in range(r.randrange(4))}


def _documents(r):
    match = lambda: {r.choice("xyz"): _value(r) for _ in range(r.randrange(4))}
    for i in range(8):
        yield {"total": i, "facets": [{"n": 1}, {"n": {"m": 2}}], "note": '}],"matches":[{"no":1}', "matches": [match() for _ in range(r.randrange(30))], "last": [{"z": 1}]}
    yield {"matches": [{}, {}, {"a": {}}]}
    yield {"matches": []}
    yield {"x": {"matches": [{"deep": 1}]}, "matches": [3, "text", {"a": 1}, {"b": [{"matches": [{"c": 1}]}]}], "y": {"matches": [{"deep": 2}]}}
    yield {"other": [{"a": 1}]}


def test_objects_are_those_of_a_json_parser(spark, tmp_path):
    r = random.Random(8)
    documents = list(_documents(r))
    for i, d in enumerate(documents):
        (tmp_path / f"{i:02}.json").write_text(json.dumps(d, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5) + r.choice(["", "\n"]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("150", "1000000"):  # a split of some pieces, and several files in one task
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            rows = read_array_objects(spark, str(tmp_path), "matches").orderBy("file", "number").collect()
            for i, d in enumerate(documents):
                found = [json.loads(x["value"]) for x in rows if x["file"].endswith(f"/{i:02}.json")]
                assert found == [m for m in d.get("matches", []) if isinstance(m, dict)], i
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_large_page_gives_the_rows_of_a_whole_one(spark, tmp_path):
    matches = [{"ip_str": f"192.0.2.{i % 250}", "port": 80 + i % 3, "org": 'Halm "}" Netz', "location": {"country_code": "AT"}, **({"ssl": {"x": {}}} if i % 4 == 0 else {})} for i in range(3000)]
    (tmp_path / "page.json").write_text(json.dumps({"total": 3000, "matches": matches}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        large = exports.read_large_host_search(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 5
        assert sorted(map(str, large.collect())) == sorted(map(str, exports.read_host_search(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
