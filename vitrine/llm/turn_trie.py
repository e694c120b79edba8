"""Prefix trie of conversations: nodes by hashes of turn prefixes, subtree totals by time-forward processing.

A node is a distinct sequence of first turns. The hash of a prefix is the XOR of hashes
of (turn, depth), 128 bits wide, so that prefixes of one conversation are made in many
tasks and joined by offsets, however long it is. After grouping, a node is named by its
smallest conversation and its depth.

Totals move up in reverse level order: sorted nodes are read once, each takes the
messages of its children from a priority queue and sends one to its parent. Subtrees
of a bounded number of turns are the shards; what they send to nodes above is summed
by Spark, and the nodes above, which are few or long bare paths, are processed across
shards, in bands of levels where they are many.
"""
from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator
from heapq import heappop, heappush
from struct import Struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.llm.shipping import shipped
from vitrine.llm.tables import written
from vitrine.llm.words import release

#: Turns below a node up to which its subtree is worked on in one shard, and levels of a band above.
SHARD_TURNS, BAND = 200_000, 256
#: Messages that a queue holds in memory, and conversation ids of one text to be hashed.
MOST_MESSAGES, CHUNK = 200_000, 8192
EMPTY_SHA = hashlib.sha256().hexdigest()


class Messages:
    """A priority queue of (key, children, leaves, saved) that writes its larger half to disk beyond ``most``.

    Runs lie in unnamed files of the folders that Spark itself spills to, private to the
    task: they vanish with it, and a repeated task makes its own.
    """

    _row = Struct("<qqqqqq")

    def __init__(self, most: int = MOST_MESSAGES):
        self.most, self.heap, self.runs, self.spills = most, [], [], 0

    def push(self, depth: int, key: tuple[int, int], children: int, leaves: int, saved: int) -> None:
        heappush(self.heap, (-depth, *key, children, leaves, saved))
        if len(self.heap) > self.most:
            self.heap.sort()
            half = self.most // 2
            self.spills += 1
            run = self._read(self._kept(self.heap[half:]))
            heappush(self.runs, (next(run), self.spills, run))
            del self.heap[half:]

    def _kept(self, rows: list[tuple]):
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        file = tempfile.TemporaryFile(dir=folder)
        file.writelines(self._row.pack(*row) for row in rows)
        file.seek(0)
        return file

    def _read(self, file) -> Iterator[tuple]:
        with file:
            while data := file.read(self._row.size * 1024):
                yield from self._row.iter_unpack(data)

    def take(self, depth: int, key: tuple[int, int]) -> tuple[int, int, int]:
        """Sums of all messages to one node; nodes ask in the order of the queue."""
        place, total = (-depth, *key), [0, 0, 0]
        while self.heap and self.heap[0][:3] == place:
            for i, x in enumerate(heappop(self.heap)[3:]):
                total[i] += x
        while self.runs and self.runs[0][0][:3] == place:
            row, number, run = heappop(self.runs)
            for i, x in enumerate(row[3:]):
                total[i] += x
            if (following := next(run, None)) is not None:
                heappush(self.runs, (following, number, run))
        return tuple(total)


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """c, part, i, t, chars: each conversation's turns in order, numbered within ranges of sorted turns; written."""
    role_, text_ = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text))
    narrow = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), role_.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_))).alias("t"), F.length(text_).alias("chars"),
    )
    keys = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("t")]
    ordered = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys).select("c", "t", "chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            c = batch.column("c").to_numpy()
            if not len(c):
                continue
            starts = np.flatnonzero(np.diff(c, prepend=c[0] - 1))
            i = np.arange(1, len(c) + 1) - np.repeat(starts, np.diff(starts, append=len(c)))
            if c[0] == last:
                i[:starts[1] if len(starts) > 1 else len(c)] += count
            last, count = c[-1], i[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(c), part, np.int32)), pa.array(i)], names=["c", "t", "chars", "part", "i"])

    return written(shipped(ordered).mapInArrow(run, "c long, t binary, chars int, part int, i long"))


def _rebuilt(turns: DataFrame, shared: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """(rows: c, part, depth, t, chars, size of each rebuilt turn; conversations: c, size); see ``turn_trie``.

    What is known of a conversation reaches its turns by (part, c), so a huge one is not one group.
    """
    before = W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = turns.groupBy("part", "c").agg(F.max("i").alias("n")).select(
        "part", "c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(W.partitionBy("c")).alias("n_own")
    )
    runs = written(runs)
    convs = runs.where("offset = 0").select(
        "c", "n_own", (F.crc32(F.col("c").cast("string")) % heads).alias("h"), (F.col("c") - F.col("c") % shared).alias("base")
    )
    sizes = convs.select(F.col("c").alias("base"), F.col("n_own").alias("n_base"))
    convs = convs.join(sizes, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = written(convs.select("c", "base", "h", "k", (F.col("k") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("size")))
    is_base = F.col("c") % shared == 0
    first = turns.where(is_base & (F.col("i") < heads)).join(runs.where(is_base & (F.col("offset") < heads)), ["part", "c"])
    first = first.select(F.col("c").alias("base"), (F.col("offset") + F.col("i")).alias("depth"), "t", "chars")
    taken = convs.join(first, "base").where("depth <= h").select("c", F.lit(-1).alias("part"), "depth", "t", "chars", "size")
    known = runs.join(convs, "c").select("part", "c", "offset", "h", "k", "size")
    own = turns.join(known, ["part", "c"]).where("i + offset > h").select(
        "c", "part", F.expr("i + offset - h + k").alias("depth"), "t", "chars", "size"
    )
    return taken.unionByName(own), convs.select("c", "size")


def _prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """c, depth, x1, x2, p1, p2, chars, size: hashes of the turns up to each, and up to the one before; written.

    The root of every conversation is the row of depth 0, with hashes of no turn.
    """
    hashed = rows.select(
        "c", "part", "depth", "chars", "size",
        F.xxhash64("t", "depth", F.lit(1)).alias("g1"), F.xxhash64("t", "depth", F.lit(2)).alias("g2"),
    )
    before = W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = hashed.groupBy("part", "c").agg(F.bit_xor("g1").alias("a1"), F.bit_xor("g2").alias("a2")).select(
        "part", "c", *(F.coalesce(F.bit_xor(a).over(before), F.lit(0)).alias(a) for a in ("a1", "a2"))
    )
    within = W.partitionBy("part", "c").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = hashed.withColumn("s1", F.bit_xor("g1").over(within)).withColumn("s2", F.bit_xor("g2").over(within))
    summed = summed.join(carried, ["part", "c"])
    x1, x2 = F.col("s1").bitwiseXOR(F.col("a1")), F.col("s2").bitwiseXOR(F.col("a2"))
    full = summed.select("c", "depth", x1.alias("x1"), x2.alias("x2"), x1.bitwiseXOR(F.col("g1")).alias("p1"), x2.bitwiseXOR(F.col("g2")).alias("p2"), "chars", "size")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    roots = convs.select("c", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), none.alias("p1"), none.alias("p2"), F.lit(0).alias("chars"), "size")
    return written(full.unionByName(roots))


def _forward(nodes: DataFrame, *shard: str) -> DataFrame:
    """x1, x2, children, leaves, saved of each node: its own ``leaf`` and ``own``, its inbox, and its subtree in its shard.

    ``top`` nodes send nothing within their shard. Sorting is Spark's, queues spill: memory is bounded.
    """
    ordered = nodes.repartition(*shard) if shard else nodes.coalesce(1)
    columns = ["depth", "x1", "x2", "p1", "p2", "leaf", "own", "top", "in_children", "in_leaves", "in_saved"]
    ordered = ordered.sortWithinPartitions(F.desc("depth"), "x1", "x2").select(*columns)
    names = ["x1", "x2", "children", "leaves", "saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = Messages()
        for batch in batches:
            out: list[tuple] = []
            for depth, x1, x2, p1, p2, leaf, own, top, *inbox in zip(*(batch.column(c).to_pylist() for c in columns)):
                got = queue.take(depth, (x1, x2))
                children, leaves, saved = (a + b for a, b in zip(got, inbox))
                leaves, saved = leaves + leaf, saved + own
                out.append((x1, x2, children, leaves, saved))
                if not top:
                    queue.push(depth - 1, (p1, p2), 1, leaves, saved)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] or [pa.array([], pa.int64())] * 5, names=names)
        release()

    return shipped(ordered).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _sent(tops: DataFrame) -> DataFrame:
    """What the parents of ``tops`` (p1, p2, leaves, saved) hear from them together."""
    heard = tops.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("in_children"), F.sum("leaves").alias("in_leaves"), F.sum("saved").alias("in_saved"))
    return heard.withColumnsRenamed({"p1": "x1", "p2": "x2"})


def _hearing(nodes: DataFrame, heard: DataFrame) -> DataFrame:
    """``nodes`` with what they hear added to their inboxes."""
    new = heard.withColumnsRenamed({f"in_{c}": f"_{c}" for c in ("children", "leaves", "saved")})
    return nodes.join(new, ["x1", "x2"], "left").select(
        *(c for c in nodes.columns if not c.startswith("in_")),
        *((F.col(f"in_{c}") + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(f"in_{c}") for c in ("children", "leaves", "saved")),
    )


def _across(nodes: DataFrame, rows: DataFrame, most: int, band: int, stride: int = 1) -> DataFrame:
    """Totals of the nodes above all shards; ``nodes`` is written, at depths that ``stride`` divides.

    Beyond ``most`` nodes a shard is a band of levels. Its top nodes first sum what lies in
    their band; these sums are the nodes of a tree that is smaller by the height of a band,
    whose totals, found in the same way, are then sent to the bands above.
    """
    if nodes.limit(most + 1).count() <= most:
        return written(_forward(nodes.withColumn("depth", (F.col("depth") / stride).cast("long")).withColumn("top", F.col("depth") == 0)))
    level = (F.col("depth") / stride).cast("long")
    banded = nodes.withColumn("top", level % band == 0).withColumn("_band", (level / band).cast("long")).withColumn("_level", level)
    local = banded.withColumn("depth", F.col("_level"))
    own = _forward(local, "_band").select("x1", "x2", "leaves", "saved")
    tops = banded.where("top").select("x1", "x2", "conv_id", "depth").join(own, ["x1", "x2"])
    above = rows.where(F.col("depth") % (stride * band) == 0).select(F.col("c").alias("conv_id"), (F.col("depth") + stride * band).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"))
    zeros = [F.lit(0).cast("long").alias(c) for c in ("in_children", "in_leaves", "in_saved")]
    upper = tops.join(above, ["conv_id", "depth"], "left").select("x1", "x2", "p1", "p2", "conv_id", "depth", F.col("leaves").alias("leaf"), F.col("saved").alias("own"), *zeros)
    totals = _across(written(upper), rows, most, band, stride * band)
    parents = banded.where("top and depth > 0").select("x1", "x2", "p1", "p2")
    heard = _sent(parents.join(totals, ["x1", "x2"]))
    return written(_forward(_hearing(local, heard), "_band"))


def _ends(rows: DataFrame) -> DataFrame:
    """x1, x2, ends_sha256: hash of the ascending ids of the conversations that end at a node.

    Ids become chunks of text in sorted ranges, so that the hash of a node that very many
    share, one running computation by its nature, reads few rows and holds one chunk.
    """
    ids = rows.where("depth = size").select("x1", "x2", "c")
    ordered = ids.repartitionByRange("x1", "x2", "c").sortWithinPartitions("x1", "x2", "c")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x1, x2, c = (batch.column(n).to_numpy() for n in ("x1", "x2", "c"))
            if not len(c):
                continue
            cuts = np.flatnonzero((np.diff(x1, prepend=~x1[0]) != 0) | (np.diff(x2, prepend=~x2[0]) != 0))
            starts = np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(cuts, [*cuts[1:], len(c)])])
            words = c.astype(str).tolist()
            texts = [",".join(words[a:b]) for a, b in zip(starts, [*starts[1:], len(c)])]
            yield pa.RecordBatch.from_arrays([pa.array(x1[starts]), pa.array(x2[starts]), pa.array(c[starts]), pa.array(texts)], names=["x1", "x2", "c", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for x1, x2, text in zip(*(batch.column(n).to_pylist() for n in ("x1", "x2", "ids"))):
                if (x1, x2) == node:
                    state.update(b",")
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (x1, x2), hashlib.sha256()
                state.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["x1", "x2", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=["x1", "x2", "ends_sha256"])

    parts = shipped(ordered).mapInArrow(chunks, "x1 long, x2 long, c long, ids string")
    parts = parts.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "c")
    return parts.mapInArrow(hashed, "x1 long, x2 long, ends_sha256 string")


def turn_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    shared: int = 100, heads: int = 6, shard_turns: int = SHARD_TURNS, band: int = BAND,
) -> DataFrame:
    """One row per node of the prefix trie of all rebuilt conversations.

    Conversation c is the first h turns of conversation c - c % ``shared`` (all if fewer,
    none if absent), then its own turns after its first h; h is crc32(c) % ``heads``. Turns
    are in the order of their numbers, null first, of equal numbers by role, then by the md5
    of ``<length of role>:<role><text>``. Null roles and texts are empty; rows without a
    conversation take no part; repeated rows are turns of their own; an empty table has no
    nodes, not even a root; other columns are not read.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    as in the contract: a node is named by its smallest conversation and its depth, and
    subtrees include their top.
    """
    turns = _turns(conversations, conv_col, turn_col, role_col, text_col)
    rows = _prefixes(*_rebuilt(turns, shared, heads))
    nodes = written(rows.groupBy("x1", "x2").agg(
        F.min("c").alias("conv_id"), F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.count(F.lit(1)).alias("n_convs"), F.sum(F.when(F.col("depth") == F.col("size"), 1).otherwise(0)).alias("n_ends"),
        F.max("chars").alias("chars"), F.sum(F.col("size") - F.col("depth") + 1).alias("below"),
    ))
    above = nodes.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), (F.col("below") > shard_turns).alias("above_heavy"))
    zeros = [F.lit(0).cast("long").alias(c) for c in ("in_children", "in_leaves", "in_saved")]
    nodes = written(nodes.join(above, ["p1", "p2"], "left").select(
        "x1", "x2", "p1", "p2", "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), (F.col("below") > shard_turns).alias("heavy"), F.coalesce("above_heavy", F.lit(True)).alias("top"), *zeros,
    ))
    light = nodes.where("not heavy")
    tops = rows.join(light.where("top").select("x1", "x2"), ["x1", "x2"]).select(F.col("c").alias("conv_id"), F.col("x1").alias("r1"), F.col("x2").alias("r2"))
    below = written(_forward(light.join(tops, "conv_id"), "r1", "r2"))
    heard = _sent(light.where("top and depth > 0").select("x1", "x2", "p1", "p2").join(below, ["x1", "x2"]))
    heavy = written(_hearing(nodes.where("heavy"), heard))
    totals = below.unionByName(_across(heavy, rows, shard_turns, band))
    return nodes.join(totals, ["x1", "x2"]).join(_ends(rows), ["x1", "x2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
