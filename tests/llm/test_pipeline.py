"""The pipeline against a plain version of its stages, and its contract."""
import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm import brute
from vitrine.llm.bpe import load_ranks
from vitrine.llm.labelled import held_out
from vitrine.llm.quality import fit_quality
from vitrine.llm.sql import OP7
from vitrine.llm.tables import read

DATA = "/root/testdata/sf0.01"


def _plain(spark):
    docs = read(spark, DATA, "documents").toPandas().sort_values("doc_id", ignore_index=True)
    model = fit_quality(read(spark, DATA, "documents"), read(spark, DATA, "labels"), ~held_out("doc_id", 3, 1))
    docs = docs[model.score(pa.array(docs["text"], pa.string())) >= 0.5]
    yield docs
    docs = docs.groupby(docs["text"].fillna("")).tail(1)
    yield docs
    found = brute.near(list(zip(docs["doc_id"], docs["text"])), 5, 80)
    docs = docs[[found[i][1] == i for i in docs["doc_id"]]]
    yield docs
    documents = docs  # noqa: F841
    mixed = duckdb.connect().sql(OP7).df().set_index("doc_id")
    docs = docs.loc[docs.index.repeat(mixed.loc[docs["doc_id"], "copies"])]
    yield docs
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    yield pd.DataFrame({"doc_id": docs["doc_id"], "ids": [coder.encode_ordinary(t or "") for t in docs["text"]]})


def test_every_stage_agrees_with_the_plain_version(spark):
    docs = read(spark, DATA, "documents")
    sizes = []
    for (_, stage), want in zip(pipeline.STAGES, _plain(spark), strict=True):
        docs = pipeline.written(stage(spark, docs, DATA))
        got = docs.toPandas()
        sizes.append(len(got))
        assert sorted(got["doc_id"]) == sorted(want["doc_id"])
        if "ids" in got:
            key = lambda f: sorted((i, tuple(int(x) for x in ids)) for i, ids in zip(f["doc_id"], f["ids"]))
            assert key(got) == key(want) and (got["n_tokens"] == got["ids"].map(len)).all()
        else:
            assert docs.columns == pipeline.COLUMNS
    assert sizes[0] > sizes[1] >= sizes[2]


def test_stages_take_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "wort " * 40, "en", None, 9), (3, "wort " * 40, "en", None, 9), (None, "x y z", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, copies int, _score double")
    for _, stage in pipeline.STAGES:
        stage(spark, docs, DATA).collect()
        assert stage(spark, docs.where(F.lit(False)), DATA).count() == 0


def test_rows_are_told_apart_where_ids_are_not(spark):
    """Repeated rows, null ids, and ids of two texts: one row of each group stays, and no other text goes."""
    words = [f"w{i}" for i in range(60)]
    a, a2, a3, b, c = " ".join(words), " ".join([*words[:-1], "x"]), " ".join([*words[:-1], "y"]), "ganz anderer text " * 3, "nur ohne nummer hier"
    rows = [(7, a), (9, a), (7, b), (3, "drei"), (3, "drei"), (None, c), (None, c), (None, a), (5, a2), (None, a3), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda frame: sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=str)
    kept = [(9, a), (7, b), (3, "drei"), (None, c), (5, a2), (None, a3), (8, "")]
    one = pipeline.written(pipeline.exact(spark, docs, DATA))
    assert key(one) == sorted(kept, key=str)
    want = sorted([(7, b), (3, "drei"), (None, c), (5, a2), (8, "")], key=str)
    assert key(pipeline.near(spark, one, DATA)) == want
    alone = sorted([(7, b), (3, "drei"), (None, c), (5, a2), (8, ""), (None, None)], key=str)
    assert key(pipeline.near(spark, docs, DATA)) == alone


def test_mixing_gives_each_repeated_row_its_own_copies(spark):
    docs = spark.createDataFrame([(i, f"wort {i}", "en", "s", 1) for i in (1, 1, 1, 2, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    want = {r["doc_id"]: r["n"] for r in pipeline.curriculum(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect()}
    got = {r["doc_id"]: r["n"] for r in pipeline.mix(spark, docs, DATA).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {i: n for i, n in want.items() if n}


def test_run_is_registered_and_repeatable(spark):
    from __spark_entry__ import queries

    assert queries()["pipeline"] is pipeline.run and len(pipeline.STAGES) in (4, 5)
    one, two = (pipeline.run(spark, "/root/testdata/sf0.001").toPandas() for _ in range(2))
    assert sorted(one["doc_id"]) == sorted(two["doc_id"]) and len(one)
    assert np.issubdtype(one["n_tokens"].dtype, np.integer)
