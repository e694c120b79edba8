"""Exact dedup, substring dedup and the n-gram join, against plain versions and edge cases."""
import hashlib
import itertools
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from vitrine.llm import ngram_join
from vitrine.llm.components import components
from vitrine.llm.exact_dedup import exact_dedup
from vitrine.llm.ngram_join import levels, ngram_components
from vitrine.llm.sql import OP8
from vitrine.llm.substring_dedup import repeated_spans, substring_dedup

SCHEMA = "doc_id long, text string, keep_id string, least string, id string, n int, component int"


def _docs(spark, rows, parts=4):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "x", "x", 1, 2) for i, t in rows], SCHEMA).repartition(parts)


def _varied(seed, n, sizes):
    """Texts cut from few sources with small changes, so that many share passages and some are near copies."""
    r = random.Random(seed)
    names = "the of and to in it was für é日 Aa Bb cc dd".split() + [str(r.randrange(9999)) for _ in range(60)]
    sources = [[r.choice(names) for _ in range(r.choice(sizes))] for _ in range(25)] + [["the"] * 40, ["a", "b"] * 20]
    rows = []
    for i in range(n):
        w = list(r.choice(sources))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            j = r.randrange(len(w) + 1)
            w[j:j + r.randrange(3)] = [f"x{r.randrange(9)}"] * r.randrange(3) or ["q"]
        if r.random() < 0.3:
            w = w + r.choice(sources)[: r.randrange(60)]
        rows.append((i, r.choice(["", " \n"]) + r.choice([" ", "  ", "\t\v"]).join(w) + r.choice(["", "\f"])))
    return rows


ODD = [(10_000, None), (10_001, ""), (10_002, " \n\t "), (10_003, "One two"), (10_004, "one TWO"), (10_005, "ÉÉ éé"), (10_006, "éé éé")]


def test_exact_dedup(spark):
    rows = [(i, ["b", "a", "a ", "", None, "a", "x" * 300_000, "x" * 300_000][i % 8]) for i in range(40)] + [(99, "a"), (99, "a")]
    docs = _docs(spark, rows)
    got = exact_dedup(docs, digest="text_sha256").toPandas()
    con = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = con.sql(OP8).df()
    key = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert got[key].sort_values(key).values.tolist() == want[key].sort_values(key).values.tolist()
    assert got.set_index("doc_id").loc[0, "text_sha256"] == hashlib.sha256(b"b").hexdigest()
    plain = exact_dedup(docs).toPandas()
    key = key[:4]
    assert sorted(plain[key].values.tolist()) == sorted(got[key].values.tolist())
    assert exact_dedup(docs.limit(0)).count() == 0
    nulls = {r["doc_id"]: r for r in exact_dedup(_docs(spark, [(None, "z"), (5, "z"), (6, "y")])).collect()}
    assert [(nulls[i]["keep_id"], nulls[i]["group_size"], nulls[i]["kept"]) for i in (5, None)] == [(5, 2, True), (5, 2, False)]


@pytest.mark.parametrize("k", [13, 4])
def test_substring_dedup(spark, k):
    rows = _varied(3, 250, [5, 13, 14, 30, 120]) + ODD + [(20_000, "lang " * 30_000)]
    docs = _docs(spark, rows)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup(docs, k).collect()}
    want = brute.substring(rows, k)
    assert {i: v for i, v in got.items() if want[i] != v} == {} and set(got) == set(want)
    assert sum(v[1] for v in want.values()) > 1000
    text = {i: brute.words(t) for i, t in rows}
    for r in repeated_spans(docs, k).limit(500).collect():
        length = r["n"] + k - 1
        assert r["source_id"] < r["id"]
        assert text[r["source_id"]][r["source_start"]:][:length] == text[r["id"]][r["start"]:][:length]


def test_substring_dedup_of_odd_tables(spark):
    assert substring_dedup(_docs(spark, [])).count() == 0
    long = "wort " * 20
    rows = {(r["doc_id"], r["n_removed"]) for r in substring_dedup(_docs(spark, [(None, long), (2, long), (1, long), (1, long)])).collect()}
    assert rows == {(None, 0), (1, 0), (2, 20)}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_ngram_components(spark, width, percent):
    rows = _varied(7, 220, [1, 3, 4, 6, 9, 20, 60, 200]) + ODD
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(_docs(spark, rows), width, percent).collect()}
    assert got == brute.near(rows, width, percent)


def test_ngram_components_of_odd_tables(spark):
    assert ngram_components(_docs(spark, [])).count() == 0
    got = [tuple(r) for r in ngram_components(_docs(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "A B c d e f")])).collect()]
    assert sorted(got, key=str) == [(3, 2, 3), (3, 2, 3), (4, 2, 3), (None, 2, 3)]


def test_a_null_id_takes_no_links_from_others(spark):
    """Three near copies, of which each in turn has no id, so once the one with the smallest hash of its set."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join([*words[:-1], "y"])]
    for none in range(3):
        rows = [(None if i == none else i, t) for i, t in enumerate(texts)]
        got = {r["doc_id"]: r["component_id"] for r in ngram_components(_docs(spark, rows), 4, 85).collect()}
        least = min(i for i, _ in rows if i is not None)
        assert got == {i: None if i is None else least for i, _ in rows}


def test_a_chain_of_near_copies_is_one_component(spark):
    """Neighbours in the chain link, its ends share nothing: found through verified links only."""
    names = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(names[i * 4:i * 4 + 100])) for i in range(60)]
    got = {r["component_id"] for r in ngram_components(_docs(spark, rows), 4, 85).collect()}
    assert got == {0}


def test_groups_of_a_level_suffice():
    for percent in (60, 80, 85, 95):
        bounds, apart, _ = levels(percent, 3000)
        for low, high, h in zip(bounds, bounds[1:], apart):
            for a in range(low, min(high, low + 60)):
                b = a * 100 // percent
                common = -(-percent * (a + b) // (100 + percent))
                assert a + b - 2 * common <= h


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(500, 640)] + [(900, x) for x in range(901, 990)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    links = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}
    assert components(links.where(F.lit(False))).count() == 0


def test_pairs_of_a_large_group_below_the_threshold_are_not_verified():
    rng = np.random.default_rng(3)
    base, sets = rng.integers(0, 2**64, 146, np.uint64), []
    for i in range(300):
        kept = base[rng.random(146) < (0.98 if i % 15 == 0 else rng.uniform(0.8, 0.88))]
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**64, 146 - len(kept), np.uint64)])))
    points = [ngram_join._point((s >> np.uint64(48)).astype(np.uint16)) for s in sets]
    nodes, none = list(range(300)), [None] * 300
    got = set(ngram_join._likely(0, nodes, nodes, np.zeros(300, np.int64), points, none, [[]] * 300, 80, True))
    links = set()
    for i, j in itertools.combinations(nodes, 2):
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
            links.add((i, j))
    assert len(links) > 100 and links <= got and len(got) < 2 * len(links)


def test_parities_of_sets_of_unlike_sizes_fold():
    rng = np.random.default_rng(4)
    for n, m in ((0, 5), (1, 2), (3, 900), (146, 611), (20_000, 23_000)):
        shared = rng.integers(0, 2**64, min(n, m), np.uint64)
        x, y = shared[: n // 2], np.concatenate([shared, rng.integers(0, 2**64, m - min(n, m), np.uint64)])
        parities = ngram_join._parities([ngram_join._point((s >> np.uint64(48)).astype(np.uint16)) for s in (x, y)])
        apart = len(np.setxor1d(x, y))
        assert 0 <= ngram_join._unlike(parities[:1], parities[1:])[0] <= apart
        assert ngram_join._unlike(parities[:1], parities[1:])[0] % 2 == apart % 2
