"""Substring dedup: repeated windows of words as paths of a compacted De Bruijn graph.

Every window of k words is an edge between its first and last k - 1 words. Runs of
windows that share their smallest inner word sequence (the minimizer) are cut at
places that only depend on the words, so the same passage is cut alike in every
document: each run is a path, named by the hash of its words. Equal paths are one path
of the graph, found by a shuffle on the minimizer; where paths of one minimizer differ, the graph
branches there, and the first path of each kind is opened into its single edges.
Coordinates of the first source stay with every removed span.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.llm.shipping import shipped
from vitrine.llm.tables import written
from vitrine.llm.words import Words, odd, mix, slices, split_words, text_bytes, windows

#: Words of the sequence that names a run.
INNER = 4
#: Rows that are settled among themselves before the shuffle.
GROUP = 150_000


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, by doubling."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - span:]) if span < width else out


def paths(words: Words, k: int) -> tuple[np.ndarray, ...]:
    """row, first word in the row, number of windows, minimizer and name of each path of each text."""
    hashes, rows = words.hashes(), words.rows
    edges, whole = windows(hashes, rows, k, 3)
    at = np.flatnonzero(whole)
    if not len(at):
        return (at, at, at, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    inner = min(INNER, k)
    least = _least(windows(hashes, rows, inner, 5)[0], k - inner + 1)[at]
    row = words.row_of()[at]
    first = np.ones(len(at), bool)
    first[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(first)
    n = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, n)
    names = mix(np.add.reduceat(edges[at] * odd(int(n.max()), 7)[place], starts) + n.astype(np.uint64))
    return row[starts], at[starts] - rows[row[starts]], n, least[starts], names


def _settle(one: np.ndarray, two: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Source of every row whose two keys an earlier document has among these rows, else null.

    A settled row needs no partner from elsewhere: its keys are replaced by its own
    coordinates, so a passage that a third of all documents share is not one group of the shuffle.
    """
    order = np.lexsort((starts, ids, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    at = np.flatnonzero(new)
    leader = np.empty(len(order), np.int64)
    leader[order] = np.repeat(order[at], np.diff(np.append(at, len(order))))
    settled = ids > ids[leader]
    one[settled] = mix(ids[settled].astype(np.uint64) ^ mix(starts[settled].astype(np.uint64)))
    two[settled] = ~one[settled]
    return pa.array(ids[leader], mask=~settled), pa.array(starts[leader].astype(np.int32), mask=~settled)


def _settled(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    one, two, ids, starts, *rest = (np.concatenate(c) for c in zip(*parts))
    source = _settle(one, two, ids, starts)
    values = [one.view(np.int64), two.view(np.int64), ids, starts.astype(np.int32), *(r.astype(np.int32) for r in rest)]
    return pa.RecordBatch.from_arrays([*map(pa.array, values), *source], names=[*names, "known_id", "known_start"])


def _in_groups(batches: Iterator[pa.RecordBatch], rows_of, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of many texts settled among themselves, ``GROUP`` or so at a time."""
    parts, n = [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            parts.append(rows_of(part))
            n += len(parts[-1][0])
            if n >= GROUP:
                yield _settled(parts, names)
                parts, n = [], 0
    if n:
        yield _settled(parts, names)


def _path_table(docs: DataFrame, k: int) -> DataFrame:
    def rows_of(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        row, start, n, least, name = paths(split_words(*text_bytes(part.column("text"))), k)
        return least, name, part.column("id").to_numpy()[row], start, n

    names = ["least", "name", "id", "start", "n"]
    return shipped(docs).mapInArrow(
        lambda batches: _in_groups(batches, rows_of, names), "least long, name long, id long, start int, n int, known_id long, known_start int"
    )


def _edge_table(opened: DataFrame, k: int) -> DataFrame:
    """The single windows of paths: two hashes of each, its document and place."""

    def rows_of(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        words = split_words(*text_bytes(part.column("text")))
        hashes = words.hashes()
        one, two = windows(hashes, words.rows, k, 3)[0], windows(hashes, words.rows, k, 13)[0]
        column = part.column("paths")
        flat = column.flatten()
        start, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
        row = np.repeat(np.repeat(np.arange(len(part)), np.diff(column.offsets.to_numpy())), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
        at = place + words.rows[row]
        return one[at], two[at], part.column("id").to_numpy()[row], place

    names = ["one", "two", "id", "start"]
    return shipped(opened).mapInArrow(
        lambda batches: _in_groups(batches, rows_of, names), "one long, two long, id long, start int, known_id long, known_start int"
    )


def repeated_spans(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, start, n, source_id, source_start: paths whose n windows from word ``start`` on also start in a document with a smaller id."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    source = F.struct("id", "start")
    known = F.col("known_id").isNotNull()
    origin = lambda field: F.coalesce(f"known_{field}", f"_source.{field}").alias(f"source_{field}")
    same, near = W.partitionBy("least", "name"), W.partitionBy("least")
    # One shuffle on the minimizer serves both windows: those of a path, and those of all paths that share it.
    marked = written(
        _path_table(texts, k).repartition("least")
        .withColumn("_source", F.min(source).over(same))
        .withColumn("_low", F.min("id").over(near)).withColumn("_high", F.max("id").over(near))
        .where(known | (F.col("_low") < F.col("_high")))
        .withColumn("_other", ~known & (F.min("name").over(near) != F.max("name").over(near)) & (F.col("id") == F.col("_source.id")))
        .where(known | F.col("_other") | (F.col("id") > F.col("_source.id")))
        .select("id", "start", "n", "_other", origin("id"), origin("start"))
    )
    alike = marked.where("not _other").drop("_other")
    opened = marked.where("_other").groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("paths"))
    edges = _edge_table(opened.hint("shuffle_hash").join(texts, "id").select("id", "text", "paths"), k)
    first = F.min(source).over(W.partitionBy("one", "two"))
    branching = edges.withColumn("_source", first).where(known | (F.col("id") > F.col("_source.id"))).select(
        "id", "start", F.lit(1).alias("n"), origin("id"), origin("start")
    )
    return alike.unionByName(branching)


def kept_words(column: pa.Array, spans: pa.Array, k: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Each text without the words that its spans cover, words joined by one space; words before, words removed."""
    data, offsets = text_bytes(column)
    words = split_words(data, offsets)
    total = len(words.starts)
    bounds = spans.offsets.to_numpy()
    flat = spans.flatten()
    start, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
    begin = start + words.rows[np.repeat(np.arange(len(column)), np.diff(bounds))]
    depth = np.zeros(total + 1, np.int64)
    np.add.at(depth, begin, 1)
    np.add.at(depth, begin + n + k - 1, -1)
    kept = np.cumsum(depth)[:total] == 0
    count = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    so_far = count(kept)
    left = so_far[words.rows[1:]] - so_far[words.rows[:-1]]
    stay = np.flatnonzero(kept)
    row = words.row_of()[stay]
    inner = np.zeros(len(stay), bool)
    inner[:-1] = row[:-1] == row[1:]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[words.starts[stay]] += 1
    edge[words.ends[stay]] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
    gap = words.ends[stay[inner]]
    out = data.copy()
    out[gap], mask[gap] = 32, True
    at = count(mask)[offsets].astype(np.int32)
    text = pa.StringArray.from_buffers(len(column), pa.py_buffer(at.tobytes()), pa.py_buffer(out[mask].tobytes()))
    return text, np.diff(words.rows), np.diff(words.rows) - left


def substring_dedup(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text", out: str = "text") -> DataFrame:
    """id, ``out`` (the words that stay, joined by one space), n_words, n_removed per document.

    A word goes if any window of ``k`` words over it also starts in a document with a smaller
    id; windows are those of the input. Words are runs of bytes other than the six ASCII blanks,
    unchanged. Texts of fewer than ``k`` words keep all; null and empty texts give an
    empty text. Rows with a null id are kept whole and are no source. Rows that share
    an id are one document for the comparison of ids: no source for each other; a span found
    in one is only removed where the row has the same words, so ids should be unique.
    Extra columns are not read. An empty table gives an empty result.
    """
    spans = repeated_spans(docs, k, id_col, text_col).groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("_spans"))
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(spans.hint("shuffle_hash"), "id", "left").select(
        "_doc", "text", F.coalesce("_spans", F.array().cast("array<struct<start:int,n:int>>")).alias("_spans")
    )
    kind = rows.schema["_doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, n, removed = kept_words(part.column("text"), part.column("_spans"), k)
                yield pa.RecordBatch.from_arrays([part.column("_doc"), text, pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64))], names=["_doc", "_kept", "n_words", "n_removed"])

    return shipped(rows).mapInArrow(run, f"_doc {kind}, _kept string, n_words long, n_removed long").select(
        F.col("_doc").alias(id_col), F.col("_kept").alias(out), "n_words", "n_removed"
    )
