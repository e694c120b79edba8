"""Substring search by trigrams against reading every text."""
import random

from vitrine.operators.candidates import browse
from vitrine.operators.text_index import build_index, holding, save_index, search_indexed


def test_indexed_search_finds_what_a_scan_finds(spark, tmp_path):
    r = random.Random(5)
    texts = ["".join(r.choice("abAB ü\n") for _ in range(r.randint(0, 30))) for _ in range(300)] + [None, "", "ab", "İstanbul straße", "aaaa"]
    rows = spark.createDataFrame([(i, t, r.choice([None, "Nginx", "apache"])) for i, t in enumerate(texts)], "id int, text string, kind string")
    save_index(build_index(rows.repartition(3), "id", ("text", "kind")), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for term in ("abab", "ABA", "b\na", "ginx", "ü", "ab", "aaa", "nirgends", "i̇stanbul", "straße", "ache"):
        plain = browse(rows, search=term, search_columns=("text", "kind"))
        found = browse(rows, search=term, search_columns=("text", "kind"), index=(index, "id"))
        assert sorted(x["id"] for x in found.collect()) == sorted(x["id"] for x in plain.collect()), term


def test_a_rare_term_reads_the_index_first(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id", "concat('text number ', id) AS text")
    index = build_index(rows, "id", ("text",))
    save_index(index, str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert [r["key"] for r in holding(stored, "text", "1234").collect()] == [1234]
    plan = search_indexed(rows, stored, "id", ("text",), "r 1234")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan and "PartitionFilters: [isnotnull(field" in plan
    assert search_indexed(rows, stored, "id", ("text",), "r 1234").count() == 1


def test_an_index_is_built_without_a_shuffle_and_keys_may_repeat(spark, tmp_path):
    texts = [(1, "aaab"), (1, "aaab"), (1, "bcd"), (2, "aab𝄞x𝄞𝄞y"), (3, "𝄞"), (None, "aaab"), (4, None), (5, "İaİ\n\nx"), (6, "ab")]
    rows = spark.createDataFrame(texts, "id int, text string")
    index = build_index(rows, "id", ("text",))
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    found = sorted({(r["key"], r["gram"]) for r in index.collect()})
    assert found == sorted({(k, t.lower()[i:i + 3]) for k, t in texts if k and t for i in range(len(t.lower()) - 2)})
    save_index(index, str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert sorted(r["key"] for r in holding(stored, "text", "aaab").collect()) == [1]
    assert search_indexed(rows, stored, "id", ("text",), "aaab").count() == 2
