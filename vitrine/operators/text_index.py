"""Substring search without reading the texts: a table of trigrams.

Each row of the index says that a trigram occurs in a row of a text column. A search
takes the rows that hold all trigrams of its term, then checks those rows alone; only
terms shorter than a trigram have to read the whole column.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of an index entry.
N = 3


def trigrams(text: Column) -> Column:
    """The distinct runs of three code points of a lower-cased text, in linear time; null and shorter texts have none."""
    # each match takes one code point and looks ahead at the run that begins with it
    runs = F.regexp_extract_all(F.lower(text), F.lit(rf"(?s)(?=(.{{{N}}}))."), F.lit(1))
    return F.coalesce(F.array_distinct(runs), F.array().cast("array<string>"))


def build_index(rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """``field, gram, key``: one row per text column, trigram and row; rows without a key are left out.

    Map-only: nothing is shuffled. Rows that share a key repeat its entries, which searches allow for. Store it partitioned by ``field`` and sorted by ``gram`` (``save_index``), so that a
    search reads the row groups of its trigrams only.
    """
    texts = [F.struct(F.lit(c).alias("field"), trigrams(F.col(c)).alias("grams")) for c in columns]
    fields = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(F.array(*texts)).alias("_t"))
    return fields.select(F.col("_t.field").alias("field"), F.explode("_t.grams").alias("gram"), "key")


def save_index(index: DataFrame, path: str) -> None:
    """Write an index, each task's entries sorted by (gram, key) in files of its own.

    A search reads the row groups of its trigrams in each file; a trigram that nearly every
    row has lies in all files, and nothing is shuffled or drawn as ranges to write them.
    """
    index.sortWithinPartitions("field", "gram", "key").write.mode("overwrite").partitionBy("field").parquet(path)


def _grams(term: str) -> list[str]:
    low = term.lower()
    return sorted({low[i:i + N] for i in range(len(low) - N + 1)})


def holding(index: DataFrame, field: str, term: str) -> DataFrame:
    """Keys whose trigrams include all of the term's; a superset of the rows that contain it.

    Entries that repeat count once. The list of trigrams reaches the scan.
    """
    grams = _grams(term)
    hits = index.where((F.col("field") == field) & F.col("gram").isin(*grams)).select("key", "gram").distinct()
    counted = hits.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    return counted.where(F.col("_n") == len(grams)).select("key")


def search_indexed(rows: DataFrame, index: DataFrame, key: str, columns: tuple[str, ...], term: str) -> DataFrame:
    """Rows of which some column contains ``term``, upper or lower case alike, as a scan would find them.

    ``index`` is ``build_index`` of the same rows. A term shorter than a trigram is
    looked for in the texts themselves.
    """
    found = F.lit(False)
    for column in columns:
        found = found | F.coalesce(F.contains(F.lower(column), F.lit(term.lower())), F.lit(False))
    if len(term.lower()) < N:
        return rows.where(found)
    keys = None
    for column in columns:
        part = holding(index, column, term)
        keys = part if keys is None else keys.unionByName(part)
    candidates = rows.join(keys.distinct().withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left_semi")
    return candidates.where(found)
