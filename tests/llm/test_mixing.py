"""Curriculum mixing against SQL, and what holds for every mix."""
import random

import duckdb
import numpy as np
import pandas as pd

from vitrine.llm.mixing import FALLING, FLAT, RISING, curriculum, reached_at
from vitrine.llm.sql import OP7


def _rows(seed, n, sources):
    r = random.Random(seed)
    return [(i, r.choice([None, "", " \n", "ein wort " * r.randrange(1, 60), "w\x0bx\fy é"]), r.choice(sources)) for i in range(n)]


def _both(spark, rows):
    docs = spark.createDataFrame([(*r, 7, 7) for r in rows], "doc_id long, text string, source string, size int, copies int").repartition(3)
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"])  # noqa: F841
    want = duckdb.connect().sql(OP7).df()
    return curriculum(docs).toPandas(), want


def test_mix_agrees_with_sql(spark):
    for seed, sources in ((1, ["b", "a", None, "Z", "ä"]), (2, ["only"]), (3, ["tiny"] + ["big"] * 60 + [None] * 3)):
        got, want = _both(spark, _rows(seed, 400, sources))
        key = ["doc_id", "source", "size", "source_size", "copies", "taken"]
        assert got[key].sort_values(key).fillna("~").values.tolist() == want[key].sort_values(key).fillna("~").values.tolist()
        assert np.allclose(got.sort_values("doc_id")["target"], want.sort_values("doc_id")["target"])
        assert abs(got.groupby("source", dropna=False)["target"].first().sum() - 1.5 * got["size"].sum()) < 1e-6
        taken = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
        assert ((taken["taken"] - taken["target"]).abs() <= taken["most"] / 2 + 1e-9).all()
        assert (got["taken"] <= 2 * got["size"]).all() and (got["target"] <= 2 * got["source_size"] + 1e-9).all()


def test_positions_follow_the_schedules(spark):
    docs = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(900)], "doc_id long, text string, source string")
    rows = curriculum(docs, weights=(1.0,), total_share=1.0, schedules=(FALLING, FLAT, RISING)).toPandas()
    assert rows["position"].is_monotonic_increasing
    means = rows.groupby("source")["position"].mean()
    # of a rate 1.5 - t, 1 and 0.5 + t the mean times are 5/12, 1/2 and 7/12
    assert np.allclose(means.loc[["s0", "s1", "s2"]], [5 / 12, 1 / 2, 7 / 12], atol=0.01)
    again = curriculum(docs.repartition(7), weights=(1.0,), total_share=1.0).toPandas()
    assert again[["doc_id", "position"]].values.tolist() == rows[["doc_id", "position"]].values.tolist()


def test_inverted_integrals(spark):
    points = ((0.0, 0.0), (0.4, 2.0), (0.5, 0.0), (1.0, 0.6))
    t = np.linspace(0, 1, 200_001)
    rate = np.interp(t, *zip(*points))
    area = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2 * np.diff(t))])
    shares = spark.range(0, 101).selectExpr("id / 100.0D as u")
    got = shares.select("u", reached_at(shares.u, points).alias("t")).collect()
    for row in got[1:]:
        assert abs(np.interp(row["t"], t, area) / area[-1] - row["u"]) < 1e-5


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s"), (2, None, None)], "doc_id long, text string, source string")
    rows = curriculum(docs).collect()
    assert len(rows) == 4 and {r["copies"] for r in rows if r["size"] == 0} == {0}
    assert curriculum(docs.limit(0)).count() == 0
