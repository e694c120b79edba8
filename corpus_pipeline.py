"""The corpus pipeline: filter, dedup, near-dedup, mix, encode; each stage works on all that the last one kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from vitrine.llm.bpe import bpe_encode
from vitrine.llm.exact_dedup import exact_dedup
from vitrine.llm.labelled import held_out
from vitrine.llm.mixing import curriculum
from vitrine.llm.ngram_join import ngram_components
from vitrine.llm.quality import fit_quality, quality_scores
from vitrine.llm.tables import read, sent, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` by id, null or not, and ``_key``; ``keys`` is a written table of both."""
    keys = sent(keys.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")))
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")), how)


def _once(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with one row for all rows of each id and ``_key`` in ``repeated``, a written table."""
    if repeated.isEmpty():
        return docs
    one = _matched(docs, repeated, "left_semi").groupBy("doc_id", "_key").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("_one"))
    one = one.select("doc_id", "_key", "_one.text", "_one.lang", "_one.source", "_one.n_chars")
    return _matched(docs, repeated, "left_anti").select(*COLUMNS, "_key").unionByName(one.select(*COLUMNS, "_key"))


def _repeated(rows: DataFrame) -> DataFrame:
    """Ids and keys of more than one row, written."""
    return written(rows.groupBy("doc_id", "_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id", "_key"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more stay; the model is fitted on labelled documents outside the held-out fold.

    Null and empty texts score by their zero features, as any other text.
    """
    model = fit_quality(docs, read(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    scores = quality_scores(docs, model, COLUMNS, name="_score")
    return scores.where("_score >= 0.5").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: of the largest id, of null only if no row has an id.

    A row is known by its id and text, so another text of the same id is not touched.
    """
    groups = exact_dedup(docs, digest="_sha").where("group_size > 1")
    marks = written(groups.select("doc_id", "kept", F.xxhash64("_sha").alias("_key")))
    rows = docs.select(*COLUMNS, F.xxhash64(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("_key"))
    rest = _matched(rows, written(marks.where("not kept").select("doc_id", "_key").distinct()), "left_anti")
    return _once(rest, _repeated(marks.where("kept"))).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies stays: of the smallest id, of null only if no row has an id.

    Five-word shingles, similarity 0.8 or more. Rows whose id is null or not theirs alone are
    numbered by a hash of id and text; where all ids are single, ids are the numbers.
    """
    shared = written(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 or doc_id is null").select("doc_id"))
    if shared.isEmpty():
        dropped = written(ngram_components(docs).where("component_id <> doc_id").select("doc_id"))
        return docs.select(*COLUMNS).join(sent(dropped), "doc_id", "left_anti").select(*COLUMNS)
    known = sent(shared.select(F.col("doc_id").alias("_id"), F.lit(True).alias("_odd")))
    rows = docs.join(known, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        *COLUMNS, F.when(F.col("_odd"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long")).alias("_key"), "_odd"
    )
    names = written(rows.where("_odd").select(F.col("_key").alias("_k"), "doc_id", F.lit(True).alias("_odd")).distinct())
    found = written(ngram_components(rows, id_col="_key").select("_key", "component_id").distinct())
    many = written(found.groupBy("component_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("component_id"))
    members = found.join(sent(many), "component_id").join(sent(names), F.col("_key") == F.col("_k"), "left").select(
        "component_id", "_key", F.when(F.col("_odd"), F.col("doc_id")).otherwise(F.col("_key")).alias("doc_id")
    )
    order = F.struct(F.col("doc_id").isNull().alias("_none"), F.col("doc_id").alias("_least"), "_key")
    stays = written(members.groupBy("component_id").agg(F.min(order).alias("_s")).select("_s._key"))
    dropped = members.join(sent(stays), "_key", "left_anti").select("doc_id", "_key")
    rest = _matched(rows, written(dropped), "left_anti")
    return _once(rest, _repeated(rows.where("_odd"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the curriculum takes, in the order of their positions.

    Positions are found on narrow rows; texts move once, for the sort by position. Rows alike in
    all columns are one row here, with the positions of all.
    """
    rows = docs.select(*COLUMNS, F.xxhash64("text", "lang", "source", "n_chars").alias("_key"))
    mixed = curriculum(rows.select("doc_id", "source", "text", "_key"), keep=("_key",), ordered=False)
    places = mixed.groupBy("doc_id", "_key").agg(F.flatten(F.collect_list("positions")).alias("_places"), F.count(F.lit(1)).alias("_n"))
    places = written(places.where(F.size("_places") > 0))
    rows = _once(rows, places.where("_n > 1"))
    places = sent(places.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "_places"))
    placed = rows.join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")))
    copies = placed.select(*COLUMNS, F.explode("_places").alias("_at"))
    return copies.orderBy("_at", "doc_id").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy: doc_id, source, n_tokens, ids; null and empty texts have none."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe_encode(docs, path, pattern, ["doc_id", "source"])
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mix), ("byte_bpe", encode),
]
#: Learned scores and token ids have no SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
