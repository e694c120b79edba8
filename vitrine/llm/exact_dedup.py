"""Exact dedup by progressive refinement: length, then a hash of the prefix, then the full hash."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_CHARS = 64


def _surviving(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The key values that more than one row has, counted before the shuffle."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").drop("_rows")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: str | None = None,
    prefix_chars: int = PREFIX_CHARS,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept (and ``digest``: the SHA-256 of its text).

    Texts are equal when their bytes are; null counts as empty, so empty and null
    texts form one group. Of equal texts the largest id stays. Rows that share both
    id and text count twice in group_size and are both kept. Extra columns are not
    read. An empty table gives an empty result.

    Each level only counts rows that survived the one before, on narrow rows with
    map-side sums; the full hash is taken of rows whose length and prefix repeat.
    With ``digest`` the hash is wanted of every row, so it is taken in the scan.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    full: Column = F.unhex(F.sha2(text, 256))
    narrow = docs.select(
        F.col(id_col).alias("_id"),
        F.octet_length(text).alias("_len"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_prefix"),
        *([full.alias("_full")] if digest else []),
    )
    same_length = _surviving(narrow, ["_len"])
    same_prefix = _surviving(narrow.join(same_length, "_len", "left_semi"), ["_len", "_prefix"])
    keys = ["_len", "_prefix", "_full"]
    if digest:
        hashed = narrow.join(same_prefix, ["_len", "_prefix"], "left_semi")
    else:
        hashed = (
            docs.select(
                F.col(id_col).alias("_id"), F.octet_length(text).alias("_len"),
                F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_prefix"), text.alias("_text"),
            )
            .join(same_prefix, ["_len", "_prefix"], "left_semi")
            .select("_id", "_len", "_prefix", F.unhex(F.sha2("_text", 256)).alias("_full"))
        )
    groups = hashed.groupBy(*keys).agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    if digest:
        marked = narrow.join(groups, keys, "left")
    else:
        alone = narrow.join(same_prefix, ["_len", "_prefix"], "left_anti")
        marked = hashed.join(groups, keys, "left").select("_id", "keep_id", "group_size").unionByName(alone.select("_id"), allowMissingColumns=True)
    return marked.select(
        F.col("_id").alias(id_col),
        F.coalesce("keep_id", "_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.coalesce("keep_id", "_id").eqNullSafe(F.col("_id"))).alias("kept"),
        *([F.lower(F.hex("_full")).alias(digest)] if digest else []),
    )
