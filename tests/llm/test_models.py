"""Learned operators: held-out accuracy, recall against brute force, gradients, and odd rows."""
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitrine.llm import html_text, toxicity
from vitrine.llm.html_blocks import parse
from vitrine.llm.labelled import held_out
from vitrine.llm.neighbours import nearest
from vitrine.llm.page_examples import Maker
from vitrine.llm.quality import fit_quality, quality_scores
from vitrine.llm.queries import op3_main_text, op5_nearest, op9_toxicity, op10_quality
from vitrine.llm.tables import read

DATA = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "wort"), (4, "wort"), (5, "x " * 100_000), (None, "é" * 50)]


def _accuracy(spark, scores, label):
    labels = read(spark, DATA, "labels").select("doc_id", label)
    rows = scores.where("held_out").join(labels, "doc_id").where(F.col(label).isNotNull()).toPandas()
    good, bad = rows[rows[label] == 1], rows[rows[label] == 0]
    return (good["predicted"] == 1).mean(), (bad["predicted"] == 0).mean(), len(rows)


def test_quality_on_the_held_out_fold(spark):
    scores = op10_quality(spark, DATA)
    kept, rejected, n = _accuracy(spark, scores, "quality")
    assert n > 1000 and kept > 0.99 and rejected > 0.97
    assert scores.where("score is null or score < 0 or score > 1").count() == 0


def test_toxicity_on_the_held_out_fold(spark):
    caught, spared, n = _accuracy(spark, op9_toxicity(spark, DATA), "toxic")
    assert n > 700 and caught > 0.85 and spared > 0.98


def test_scores_of_odd_rows_and_tables(spark):
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in ODD], "doc_id long, text string, score double")
    labels = read(spark, "/root/testdata/sf0.01", "labels")
    real = read(spark, "/root/testdata/sf0.01", "documents")
    model = fit_quality(real, labels, ~held_out("doc_id", 3, 1))
    rows = quality_scores(docs, model, ["doc_id"]).toPandas()
    assert len(rows) == len(ODD) and rows["score"].between(0, 1).all()
    same = rows[rows["doc_id"] == 4]["score"]
    assert same.nunique() == 1
    assert quality_scores(docs.limit(0), model, ["doc_id"]).count() == 0
    prior = fit_quality(real, labels.limit(0), F.lit(True))
    assert quality_scores(docs, prior, ["doc_id"]).toPandas()["score"].tolist() == [0.5] * len(ODD)
    weights = toxicity.fit(pa.array([], pa.string()), np.zeros(0, np.float32))
    assert toxicity.toxicity_scores(docs, weights, ["doc_id"]).toPandas()["score"].between(0, 1).all()


def _labelled(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, v) for i, _, v in rows], "doc_id long, toxic int")


def test_a_long_text_leaves_the_others_to_learn_from(spark):
    """The smallest id alone is over the bytes: clean it gives a piece, marked it is passed over."""
    for long in (0, 1):
        rows = [(0, "é lang " * 9_000, long)] + [(i, f"wort {i} " + ("fies " if i % 4 == 0 else "nett ") * 3, int(i % 4 == 0)) for i in range(1, 41)]
        docs, labels = _labelled(spark, rows)
        got = toxicity.chosen_texts(docs.unionByName(docs.limit(5)), labels, F.lit(True), most_bytes=20_000)
        assert sorted(got["_id"]) == list(range(long, 41)) and got["_text"].str.encode("utf-8").str.len().sum() <= 20_000
        assert got[got["_id"] > 0]["_text"].tolist() == [t for _, t, _ in rows[1:]]
        few = toxicity.chosen_texts(docs, labels, F.lit(True), most=12)
        assert (few["_label"] == 1).sum() == 6 and abs(few["_weight"].sum() - 41) < 1e-9
        scores = toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, labels, F.lit(True), most_bytes=20_000), ["doc_id"]).toPandas().set_index("doc_id")["score"]
        assert all((scores[i] >= toxicity.THRESHOLD) == (v == 1) for i, _, v in rows[1:])


def test_a_missing_label_is_told(spark):
    docs, labels = _labelled(spark, [(1, "gut", 0), (2, "nett", 0)])
    with pytest.warns(UserWarning, match="0 marked and 2 clean"):
        toxicity.fit_toxicity(docs, labels, F.lit(True))


def _numeric(loss, p, g, names, eps=1e-3):
    r = np.random.default_rng(0)
    for name in names:
        flat = np.flatnonzero(np.abs(g[name]).ravel() > 1e-4)
        for i in r.choice(flat, min(4, len(flat)), replace=False):
            at = np.unravel_index(i, p[name].shape)
            old = p[name][at]
            p[name][at] = old + eps
            up = loss()
            p[name][at] = old - eps
            down = loss()
            p[name][at] = old
            assert (up - down) / (2 * eps) == pytest.approx(g[name][at], rel=0.05, abs=2e-4), name


def test_gradients_of_both_networks():
    r = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in toxicity._start(2).items()}
    w = toxicity.cut(pa.array([" ".join(r.choice(["aa", "bb", "ccc", "dd!"], 50)), "aa bb", ""]))
    toxicity.placed(w, np.sort(w.keys[:2]))
    y = r.integers(0, 2, len(w.at)).astype(np.float64)

    def toxic_loss():
        z = toxicity.window_logits(p, w).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    _numeric(toxic_loss, p, toxicity._gradients(p, w, w.at, y), list(p), 3e-3)
    q = {k: v.astype(np.float64) for k, v in html_text._start(3).items()}
    x = r.standard_normal((6, 3, html_text.PATH + html_text.WORD + html_text.COUNTS))
    mask = np.arange(6)[:, None] < np.array([6, 4, 1])
    t = r.integers(0, 2, mask.shape).astype(np.float64)

    def block_loss():
        states = np.concatenate([html_text._lstm(q, side, x, mask) for side in "fb"], axis=2)
        z = states @ q["out"] + x @ q["skip"] + q["bias"]
        return float(((np.log1p(np.exp(z)) - t * z) * mask).sum() / mask.sum())

    _numeric(block_loss, q, html_text._gradients(q, x, mask, t), list(q), 3e-3)


def test_windows_overlap_and_cover_every_word():
    text = " ".join(f"w{i}" for i in range(200))
    w = toxicity.cut(pa.array([text, None, "a"]))
    assert np.diff(w.rows).tolist()[1:] == [1, 1]
    own = w.at[: w.rows[1]]
    assert len(np.unique(own[own >= 0])) == 200 and own[0][toxicity.STRIDE] == own[1][0]
    parts = toxicity.cut_all(pa.array([text, None, "a"]))
    assert (np.sort(parts.keys) == np.sort(w.keys)).all() and (parts.at == w.at).all()


def test_main_text_of_given_and_unseen_pages(spark):
    pages = read(spark, "/root/testdata/sf0.01", "pages")
    got = {r["page_id"]: r["text"] for r in op3_main_text(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == pages.count()
    model = html_text.fit([r["html"] for r in pages.limit(100).collect()])
    maker = Maker(4242, [])
    examples = [html_text._made(maker) for _ in range(200)]
    x, bounds = html_text.vectors([e for e, _ in examples])
    y = np.concatenate([e for _, e in examples])
    assert ((html_text.judge(model, x, bounds) >= 0) == y).mean() > 0.98
    odd = [None, "", "<p", "<<<>>>", "a < b", "<script>x", "<div>" * 3000 + "tief", "<p>x</p>" * 5000]
    assert len(html_text.main_texts(model, odd)) == len(odd)
    frame = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "", "x")], "page_id long, url string, html string, text string")
    assert [tuple(r) for r in html_text.extract_main_text(frame, model, ["page_id"]).collect()] == [(1, ""), (1, "")]
    assert html_text.extract_main_text(frame.limit(0), model, ["page_id"]).count() == 0


def test_blocks():
    page = parse("<title>T</title><p class='Kopf-zeile'>a <b>b</b>c<br>d<p>e&nbsp;&amp;<!-- x --> f<ul><li>g<li><a href=#>h</a></ul><script>var t='</p>'</script>i", {})
    assert page.texts == ["T", "a bc d", "e & f", "g", "h", "i"]
    assert page.linked == [0, 0, 0, 0, 1, 0] and {"p", ".kopf", ".zeile"} <= set(page.paths[1])


def test_all_words_of_a_class_count_and_deep_nests_are_linear():
    page = parse("<div class='col col-md-4 col-lg-3 order-2 d-none d-lg-block widget-area sidebar'>x</div>", {})
    assert {".widget", ".area", ".sidebar"} <= set(page.paths[0])
    start = time.time()
    page = parse("<div class=a><span><section>" * 50_000 + "tief" + "</section></div>" * 20_000 + "flach" + "<ul><li>" * 20_000, {})
    assert page.texts == ["tief", "flach"] and page.paths[0] == ("div", ".a", "section") and time.time() - start < 20
    nested = parse("<div id=x><p id=y>a<div id=z>b</div>c</div>d", {})
    assert nested.paths == [("div", ".x", "p", ".y"), ("div", ".x", ".z"), ("div", ".x"), ()]


def _recall(spark, x, k=20, step=20):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = nearest(frame, F.col("vec_id") % step == 0, k).toPandas()
    x = x.astype(np.float32).astype(np.float64)
    hits = total = 0
    for q, part in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -score))[:k]
        hits += np.isin(part["id"], best).sum()
        total += len(best)
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, len(part) + 1))
        assert np.allclose(part["score"], score[part["id"]], rtol=1e-12, atol=1e-12)
        assert part[["score", "id"]].apply(lambda r: (-r["score"], r["id"]), axis=1).is_monotonic_increasing
    assert got["query_id"].nunique() == -(-len(x) // step)
    return hits / total


def test_recall_of_neighbours(spark):
    r = np.random.default_rng(5)
    centres = r.standard_normal((40, 24))
    near = centres[r.integers(0, 40, 3000)] + 0.3 * r.standard_normal((3000, 24))
    assert _recall(spark, near / np.linalg.norm(near, axis=1, keepdims=True)) > 0.95
    apart = r.standard_normal((2500, 24))
    assert _recall(spark, apart / np.linalg.norm(apart, axis=1, keepdims=True)) > 0.9


def test_the_query_finds_the_largest_inner_products_of_mixed_lengths(spark, tmp_path):
    r = np.random.default_rng(6)
    lengths = np.exp(0.5 * r.standard_normal((4000, 1)))
    centres = r.standard_normal((60, 24))
    for x in (centres[r.integers(0, 60, 4000)] + 0.3 * r.standard_normal((4000, 24)), r.standard_normal((4000, 24))):
        x = x / np.linalg.norm(x, axis=1, keepdims=True) * lengths
        path = str(tmp_path / f"{x[0, 0]}")
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
        got = op5_nearest(spark, path).toPandas()
        hits = 0
        for q, part in got.groupby("query_id"):
            score = x @ x[q]
            score[q] = -np.inf
            hits += np.isin(part["vec_id"], np.argsort(-score)[:20]).sum()
        assert len(got) == 200 * 20 and hits / len(got) > 0.9


def test_neighbours_of_odd_vectors(spark):
    odd = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
           (7, [1.0, None]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (10, [0.5, 0.5]), (10, [0.5, 0.5])]
    frame = spark.createDataFrame([(i, v, 1, 1) for i, v in odd], "vec_id long, embedding array<float>, rank int, score int")
    got = [(r["query_id"], r["rank"], r["id"]) for r in nearest(frame, F.col("vec_id") >= 0, 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 0), (2, 2, 1), (10, 1, 0), (10, 2, 1)]
    assert nearest(frame.limit(0), F.lit(True)).count() == 0
    one = nearest(frame.where("vec_id = 0"), F.lit(True)).toPandas()
    assert isinstance(one, pd.DataFrame) and not len(one)
