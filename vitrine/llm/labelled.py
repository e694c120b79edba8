"""A bounded sample of labelled documents to fit on, and scoring of whole tables by a fitted model."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.shipping import shipped
from vitrine.llm.words import release, slices


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, fit_on: Column, most: int, id_col: str, text_col: str) -> DataFrame:
    """At most ``most`` labelled documents that may be learned from, the same ones in every run.

    Of several labels of one id the largest counts; null ids and labels are left out.
    The chosen ids are a bounded table, so they are broadcast to one scan of the texts.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & fit_on)
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(most)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(chosen), "_id").select("_id", "_text", "_label")


def scored(docs: DataFrame, text_col: str, columns: list[str], score: Callable[[pa.Array], np.ndarray], name: str = "score") -> DataFrame:
    """``columns`` of every row, and the score of its whole text; map-only, slice by slice.

    Only texts and scores pass through Python; the columns stay in the JVM.
    """
    if name in columns:
        raise ValueError(f"a column to keep has the name of the score: {name}")

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        parts = slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text")
        scores = pa.array(np.concatenate([np.zeros(0), *(np.asarray(score(p.column("text")), np.float64) for p in parts)]))
        release()
        return scores

    return shipped(docs).select(*columns, run(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias(name))
