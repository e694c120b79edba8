"""Spelling variants: words one code point apart, found by pairs of trie node numbers.

All distinct words are numbered in two tries, one over prefixes and one over suffixes.
A node's number is its place in the order in which sorted words open nodes, so numbers
of ranges of words are made apart and joined at the borders. A word that misses or
replaces the symbol at a place keeps the node before it and the node behind it: equal
integer pairs (prefix node, suffix node) are equal neighbours, with nothing to verify.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.shipping import shipped
from vitrine.llm.tables import written
from vitrine.llm.words import release, slices

#: Runs of letters of the Latin blocks.
LETTERS = "A-Za-zÀ-ÿ"
_RUN = re.compile(f"[{LETTERS}]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Distinct words, and their characters, that a task counts before it passes them on.
MOST_WORDS, MOST_CHARS = 200_000, 8_000_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = None) -> DataFrame:
    """word, n: maximal runs of letters of all whole texts with A-Z lowered, and their occurrences.

    Where ``every`` divides h, the unsigned crc32 of ``<id>:<run>``, the run loses its code
    point h % length. Null and empty texts have no runs; a null id is written as nothing.
    Counts are combined within tasks, in bounded tables, and again by the shuffle.
    """
    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text"))

    def out(counts: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        chars = 0
        for batch in batches:
            for part in slices(batch, "text"):
                for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    if not text:
                        continue
                    found = Counter(_RUN.findall(text.translate(_LOWER)))
                    head = zlib.crc32(f"{key or ''}:".encode())
                    for word, n in found.items():
                        if every:
                            h = zlib.crc32(word.encode(), head)
                            if h % every == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1:]
                        if word not in counts:
                            chars += len(word)
                        counts[word] += n
                    if len(counts) > MOST_WORDS or chars > MOST_CHARS:
                        yield out(counts)
                        counts, chars = Counter(), 0
        if counts:
            yield out(counts)
        release()

    parts = shipped(rows).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _shared_start(a: str, b: str) -> int:
    """The number of code points with which both begin."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low if a[low:high] != b[low:high] else high


def _numbered(words: DataFrame, text: str, nodes: str) -> DataFrame:
    """``words`` and the numbers of the trie nodes on each path of ``text``, the root first, as ``nodes``.

    Ranges of sorted words number their own nodes; the first word of a range takes the first
    numbers, by depth. A range shares nodes with an earlier one only on that first path, as
    far as its first word begins like the last word before: one row per range says where to.
    """
    ordered = words.repartitionByRange(text).sortWithinPartitions(text)
    schema = T.StructType([*words.schema, T.StructField("_range", T.IntegerType()), T.StructField("_nodes", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        before, path, opened = "", np.zeros(1, np.int64), 1
        for batch in batches:
            for part in slices(batch, text):
                values, ends = [], [0]
                for word in part.column(text).to_pylist():
                    same = _shared_start(before, word)
                    more = len(word) - same
                    path = np.concatenate([path[:same + 1], np.arange(opened, opened + more)])
                    opened += more
                    before = word
                    values.append(path)
                    ends.append(ends[-1] + len(path))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([piece] * len(values), pa.int32()), lists], names=schema.names)
        release()

    found = written(shipped(ordered).mapInArrow(run, schema))
    last = F.max(F.struct(text, "_nodes")).alias("_last")
    borders = found.groupBy("_range").agg(F.min(text).alias("_first"), last, (F.max(F.array_max("_nodes")) + 1).alias("_n"))
    shifts, offset, before, path = [], 0, "", []
    for row in borders.orderBy("_range").collect():  # one row per range
        shared = path[:_shared_start(before, row["_first"]) + 1] if path else []
        shifts.append((row["_range"], offset, shared))
        before = row["_last"][text]
        path = [shared[x] if x < len(shared) else offset + x for x in row["_last"]["_nodes"]]
        offset += row["_n"]
    spark = words.sparkSession
    shift = F.broadcast(spark.createDataFrame(shifts, "_range int, _offset long, _shared array<long>"))
    number = F.transform("_nodes", lambda x: F.when(x < F.size("_shared"), F.get("_shared", x.cast("int"))).otherwise(x + F.col("_offset")))
    return found.join(shift, "_range").select(*words.columns, number.alias(nodes))


def _pairs(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Integer pairs around each left-out symbol, and around each place between symbols; linear in each word."""
    symbols, length, back = F.split("word", ""), F.size("_fore") - 1, F.reverse("_back")
    around = F.arrays_zip(F.slice("_fore", 1, length), F.slice(back, 2, length), symbols, F.slice(symbols, 2, length))
    skipped = words.select("id", "n", F.explode(around).alias("_x")).select(
        # where a run of equal symbols loses one, only the last place counts: all places give one word
        "id", "n", F.col("_x.0").alias("p"), F.col("_x.1").alias("s"), (~F.col("_x.2").eqNullSafe(F.col("_x.3"))).alias("last")
    )
    between = words.select("id", "n", F.explode(F.arrays_zip("_fore", back)).alias("_x")).select(
        "id", "n", F.col("_x._fore").alias("p"), F.col("_x.1").alias("s")
    )
    return skipped, between


def near_words(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words: id, word, n; links: id, near, near_n), every pair of words one code point apart in both directions.

    ``counts`` has distinct words, none of them null; ids are in code-point order. A pair of
    nodes holds at most one word per letter that can fill its place, so no group grows with
    the number of words, however common a prefix or suffix is.
    """
    fore = _numbered(counts.select("word", "n"), "word", "_fore")
    turned = fore.withColumn("_turned", F.reverse("word"))
    both = _numbered(turned, "_turned", "_back").drop("_turned")
    words = written(both.withColumn("id", F.element_at("_fore", -1)))
    skipped, between = _pairs(words)
    other = skipped.select(F.col("id").alias("near"), F.col("n").alias("near_n"), "p", "s")
    replaced = skipped.join(other, ["p", "s"]).where("id <> near").select("id", "n", "near", "near_n")
    longer = skipped.where("last").drop("last").join(between.select(F.col("id").alias("near"), F.col("n").alias("near_n"), "p", "s"), ["p", "s"])
    longer = longer.select("id", "n", "near", "near_n")
    shorter = longer.select(F.col("near").alias("id"), F.col("near_n").alias("n"), F.col("id").alias("near"), F.col("n").alias("near_n"))
    links = replaced.unionByName(written(longer.unionByName(shorter)))
    return words.select("id", "word", "n"), links.select("id", "near", "near_n")


def _followed(forms: DataFrame) -> DataFrame:
    """id, root: the last of the forms that each id leads to; paths are halved until none is left.

    A form has a multiple of its word's occurrences, so paths are as short as their logarithm.
    """
    roots = written(forms.select("id", F.col("form").alias("root")))
    while True:
        step = roots.select(F.col("id").alias("_id"), F.col("root").alias("_next"))
        moved = written(roots.join(step, F.col("root") == F.col("_id"), "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_on")))
        roots = moved.select("id", "root")
        if moved.where("_on").isEmpty():
            return roots


def spelling_forms(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5, ratio: int = 5, every: int | None = None
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``shortest`` code points and ``least`` occurrences.

    Two words are near that differ by one inserted, deleted or replaced code point. A word's
    form is its near word of most occurrences, of equals the smallest, if it has ``ratio``
    times its own; else null. ``root`` is where forms lead, the word itself without a form.
    Null and empty texts and null ids: see ``word_counts``. Repeated rows count each; an
    empty table has no words; other columns are not read.
    """
    counts = word_counts(docs, id_col, text_col, every).where((F.length("word") >= shortest) & (F.col("n") >= least))
    words, links = near_words(counts)
    best: Column = F.max(F.struct(F.col("near_n"), (-F.col("near")).alias("_order"))).alias("_best")
    about = written(links.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), best))
    full = words.join(about, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("_best.near_n") >= ratio * F.col("n"), -F.col("_best._order")).alias("form"),
    )
    full = written(full)
    roots = _followed(full.where("form is not null"))
    ends = full.where("form is not null").join(roots, "id").select("id", "form", "root")
    names = words.select(F.col("id").alias("_id"), F.col("word").alias("_word"), F.col("n").alias("_n"))
    ends = ends.join(names, F.col("form") == F.col("_id")).select("id", F.col("_word").alias("form"), F.col("_n").alias("form_n"), "root")
    ends = ends.join(names, F.col("root") == F.col("_id")).select("id", "form", "form_n", F.col("_word").alias("root"))
    return full.drop("form").join(ends, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
