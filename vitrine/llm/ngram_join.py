"""N-gram Jaccard join over count vectors: every link of at least a similarity, and its components.

Shingles are hashed into groups. Two sets that link differ in at most h shingles, so
of more than h filled groups one is the same in both: such groups are the buckets
in which links are looked for, and no link is lost. A set's counts of hashes by
group are a point; the summed minima of two points bound the overlap, for two boxes of an
R-tree likewise. The parities of its counts over more coordinates differ between two sets in no
more places than the sets have different members. Each bucket whose sets are not one component yet has a tree, descended
from pairs of its top boxes, and only pairs that the bound leaves are verified on whole sets.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.llm.components import components
from vitrine.llm.shipping import shipped
from vitrine.llm.tables import sent, written
from vitrine.llm.words import LOWER, mix, odd, release, slices, split_words, text_bytes, windows
from vitrine.operators.arrival import with_place

#: Coordinates of the boxes of an R-tree; a point has one for two to four shingles of its set.
AXES = 64
#: Children of a box, members of a verified group, and of a block of a large bucket.
FAN, GROUP, BLOCK = 16, 256, 1024
#: Coordinates compared at once.
STEP = 4_000_000
#: Smallest buckets that a row names, so that a pair is told once and not in each bucket it shares.
NAMED = 8
#: Size classes grow by this factor.
LEVEL = 1.4


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, and where each text's begin.

    With fewer than ``width`` words the whole sequence is one shingle; no words, no shingle.
    """
    data, offsets = text_bytes(column)
    words = split_words(LOWER[data], offsets)
    hashes, rows = words.hashes(), words.rows
    values, whole = windows(hashes, rows, width, 71)
    found, owner = [values[whole]], [words.row_of()[: len(values)][whole]]
    counts = np.diff(rows)
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        if len(short):
            first, factors = rows[:-1][short], odd(n, 71 + n)
            found.append(mix(sum(hashes[first + j] * factors[j] for j in range(n)) + np.uint64(n)))
            owner.append(short)
    value, row = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(offsets)))


def most_apart(sizes: int, percent: int) -> int:
    """Elements by which two linked sets of ``sizes`` elements together can differ."""
    return sizes * (100 - percent) // (100 + percent)


@lru_cache
def levels(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size classes of the smaller set of a pair: bounds, differences h, and spare groups."""
    bounds = [1]
    while bounds[-1] <= largest:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * LEVEL)))
    low, top = np.array(bounds[:-1]), np.array(bounds[1:]) - 1
    apart = np.array([most_apart(int(t) + int(t) * 100 // percent, percent) for t in top])
    empty = (apart + 1) * np.exp(-low / (apart + 1))
    return np.array(bounds), apart, np.ceil(empty + 2 * np.sqrt(empty)).astype(np.int64)


def signatures(value: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every filled group of every set, and where each set's begin.

    A set takes part in the level of its size and in each lower one that holds smaller
    partners. Within a level it is dealt into h + 1 and some spare groups; while that fills
    no more than h groups, it is dealt into more groups as well. Of two linked sets the one
    that stops first fills more than h groups there, of which one is the same in the other.
    """
    sizes = np.diff(bounds)
    if not len(value):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    edges, apart, spare = levels(percent, 1 << int(sizes.max()).bit_length())
    own = np.searchsorted(edges, sizes, side="right") - 1
    lowest = np.searchsorted(edges, -(-sizes * percent // 100), side="right") - 1
    outs, rows_of = [], []
    for down in range(int((own - lowest).max()) + 1):
        level = own - down
        rows = np.flatnonzero((sizes > 0) & (level >= lowest) & (level >= 0))
        rows = rows[apart[level[rows]] > 0]
        more = 0
        while len(rows):
            h = apart[level[rows]]
            groups = h + 1 + spare[level[rows]] + more * (1 + h // 4)
            base = np.concatenate([[0], np.cumsum(groups)])
            n = sizes[rows]
            take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1][rows], n)
            salt = mix(level[rows].astype(np.uint64) * np.uint64(1009) + np.uint64(more))
            mixed = mix(value[take] ^ np.repeat(salt, n))
            at = (((mixed >> np.uint64(32)) * np.repeat(groups, n).astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            at += np.repeat(base[:-1], n)
            sums = np.zeros(base[-1], np.uint64)
            np.add.at(sums, at, mixed)
            filled = np.bincount(at, minlength=base[-1]) > 0
            place = np.arange(base[-1]) - np.repeat(base[:-1], groups)
            hashed = mix(sums + np.repeat(salt, groups) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            outs.append(hashed[filled])
            rows_of.append(np.repeat(rows, groups)[filled])
            rows = rows[np.add.reduceat(filled, base[:-1]) <= h]
            more += 1
    if not outs:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    row = np.concatenate(rows_of)
    order = np.argsort(row, kind="stable")
    return np.concatenate(outs)[order], np.searchsorted(row[order], np.arange(len(bounds)))


def _point(codes: np.ndarray) -> bytes:
    """Counts of a set's 16-bit groups over 2 ** k coordinates: a byte for k, then half a byte each, or four where one is larger.

    Behind them are the parities of its counts over finer coordinates, two to four bits for a member.
    """
    k = min(16, max(0, len(codes).bit_length() - 2))
    counts = np.bincount(codes >> np.uint16(16 - k) if k else np.zeros(len(codes), np.int64), minlength=max(2, 1 << k))
    fine = min(16, max(3, len(codes).bit_length() + 1))
    parity = np.packbits((np.bincount(codes >> np.uint16(16 - fine), minlength=1 << fine) & 1).astype(np.uint8)).tobytes()
    if counts.max(initial=0) < 16:
        return bytes([k]) + (counts[0::2] << 4 | counts[1::2]).astype(np.uint8).tobytes() + parity
    return bytes([k | 128]) + counts.astype("<u4").tobytes() + parity


def _width(point: bytes) -> int:
    """Bytes of a point's counts."""
    n = max(2, 1 << (point[0] & 127))
    return 4 * n if point[0] & 128 else n // 2


def _counts(points: list[bytes]) -> np.ndarray:
    """Points as rows of counts, folded to the fewest coordinates among them."""
    ks = [p[0] & 127 for p in points]
    k = min(ks)
    out = np.zeros((len(points), 1 << k), np.uint32)
    for row, (p, own) in enumerate(zip(points, ks)):
        raw = np.frombuffer(p, np.uint8, count=_width(p), offset=1)
        if p[0] & 128:
            counts = raw.view("<u4")
        else:
            counts = np.empty(2 * len(raw), np.uint8)
            counts[0::2], counts[1::2] = raw >> 4, raw & 15
        out[row] = counts[: 1 << own].reshape(1 << k, -1).sum(1)
    return out if out.max(initial=0) > 65_535 else out.astype(np.uint16)


def _parities(points: list[bytes]) -> np.ndarray:
    """Parities of points as rows of packed bits, folded to the fewest among them."""
    rows = [np.frombuffer(p, np.uint8, offset=1 + _width(p)) for p in points]
    least = min(len(r) for r in rows)
    return np.stack([r if len(r) == least else np.packbits(np.bitwise_xor.reduce(np.unpackbits(r).reshape(8 * least, -1), axis=1)) for r in rows])


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed minima of the rows of two tables, a step of rows at a time."""
    step = max(1, STEP // max(1, x.shape[1]))
    parts = [np.minimum(x[i:i + step], y[i:i + step]).sum(1, dtype=np.int64) for i in range(0, len(x), step)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _unlike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places in which the rows of two tables of parities differ: at most the members that only one of two sets has."""
    step = max(1, STEP // max(1, x.shape[1]))
    parts = [np.bitwise_count(x[i:i + step] ^ y[i:i + step]).sum(1, dtype=np.int64) for i in range(0, len(x), step)]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _same(value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _firsts(same: np.ndarray, told: set[int]) -> np.ndarray:
    """Which sets come for the first time in this task."""
    first = np.zeros(len(same), bool)
    for i, key in enumerate(same.tolist()):
        if key not in told:
            told.add(key)
            first[i] = True
    return first


def set_table(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, same (hash of the set) and, once per set and task, its point."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                value, bounds = shingle_sets(part.column("text"), width)
                sizes, same = np.diff(bounds), _same(value, bounds)
                codes = (value >> np.uint64(48)).astype(np.uint16)
                points = [_point(codes[a:b]) if f else None for a, b, f in zip(bounds[:-1], bounds[1:], _firsts(same, told))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sizes.astype(np.int64)), pa.array(same, mask=sizes == 0), pa.array(points, pa.binary())],
                    names=["id", "n_shingles", "same", "point"],
                )
        release()

    return shipped(kept).mapInArrow(run, f"id {kind}, n_shingles long, same long, point binary")


def signature_table(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """signature, same: the buckets of every set of a row with an id, once per set and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                value, bounds = shingle_sets(part.column("text"), width)
                sizes, same = np.diff(bounds), _same(value, bounds)
                first = _firsts(same, told) & (sizes > 0)
                signed, rows = signatures(value[np.repeat(first, sizes)], np.concatenate([[0], np.cumsum(sizes[first])]), percent)
                yield pa.RecordBatch.from_arrays([pa.array(signed.view(np.int64)), pa.array(np.repeat(same[first], np.diff(rows)))], names=["signature", "same"])
        release()

    return shipped(docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"))).mapInArrow(run, "signature long, same long")


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes, summed minima and parities still allow a link."""
    points = sets.select(F.col("node").alias("_node"), "point")
    rows = (
        pairs.join(points.select(F.col("_node").alias("a"), F.col("point").alias("p")), "a")
        .join(points.select(F.col("_node").alias("b"), F.col("point").alias("q")), "b")
        .select("a", "b", "p", "q")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            fits = []
            for p, q in zip(batch.column("p").to_pylist(), batch.column("q").to_pylist()):
                both, parity = _counts([p, q]), _parities([p, q])
                sizes = int(both.sum(dtype=np.int64))
                fits.append(bool(
                    (100 + percent) * _unlike(parity[:1], parity[1:])[0] <= (100 - percent) * sizes
                    and (100 + percent) * _common(both[:1], both[1:])[0] >= percent * sizes
                ))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(fits))

    return shipped(rows).mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a written table) that link, checked on the whole sets; at most ``GROUP`` or so partners of a document meet in one run of rows."""
    count = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("a", "_a")
    salted = pairs.join(count, F.col("a") == F.col("_a")).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("_n") / GROUP)).cast("int").alias("part"))
    both = F.array(*[F.struct(F.lit(role).alias("role"), F.col(node).alias("node")) for role, node in ((0, "a"), (1, "b"))])
    asked = salted.select("a", "part", F.explode(both).alias("_r")).select("a", "part", "_r.*").distinct()
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = (
        sent(written(asked)).join(texts, "node")
        .repartition("a", "part").sortWithinPartitions("a", "part", "role", "node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                value, bounds = shingle_sets(part.column("text"), width)
                a, role, node = (part.column(c).to_pylist() for c in ("a", "role", "node"))
                links: list[tuple[int, int]] = []
                for i, (x, r) in enumerate(zip(a, role)):
                    own = value[bounds[i]:bounds[i + 1]]
                    if r == 0:
                        of, held = x, own
                    elif of == x and len(own) and len(held):
                        at = np.searchsorted(held, own)
                        at[at == len(held)] = 0
                        common = int((held[at] == own).sum())
                        if 100 * common >= percent * (len(own) + len(held) - common):
                            links.append((x, node[i]))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])
        release()

    return shipped(rows.select("a", "role", "node", "text")).mapInArrow(run, "a long, b long").distinct()


class Tree:
    """An R-tree over points: level 0 holds the points and parities, each box above the maxima of up to ``FAN`` boxes below."""

    def __init__(self, points: np.ndarray, parities: np.ndarray):
        self.sizes = [points.sum(1, dtype=np.int64)]
        coarse = points.reshape(len(points), min(AXES, points.shape[1]), -1).sum(2, dtype=np.uint32)
        self.order = np.lexsort((coarse.argmax(1), self.sizes[0]))
        self.points, self.parities, self.boxes = points[self.order], parities[self.order], [coarse[self.order]]
        self.sizes[0] = self.sizes[0][self.order]
        while len(self.boxes[-1]) > FAN:
            starts = np.arange(0, len(self.boxes[-1]), FAN)
            self.sizes.append(np.minimum.reduceat(self.sizes[-1], starts))
            self.boxes.append(np.maximum.reduceat(self.boxes[-1], starts))


def _below(x: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the children of boxes, one row each; those beyond the last are -1."""
    children = x[:, None] * FAN + np.arange(FAN)
    return np.where(children < n, children, -1)


def tree_pairs(left: Tree, right: Tree, of_left: np.ndarray, of_right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (of the tables the trees are made of) of different components whose bounds allow a link, and their likeness.

    Pairs of boxes are descended from the top of both trees; a pair is dropped as soon as the
    summed minima of its boxes are too small for the smallest sets in them, a pair of points also
    where their parities differ in too many places. A tree with itself gives each pair once.
    """
    itself = left is right
    level = max(len(left.boxes), len(right.boxes)) - 1
    height = [min(level, len(t.boxes) - 1) for t in (left, right)]
    x, y = (g.ravel() for g in np.meshgrid(*(np.arange(len(t.boxes[-1])) for t in (left, right)), indexing="ij"))
    while True:
        if itself:
            x, y = x[x <= y], y[x <= y]
        if height == [0, 0]:
            apart = (of_left[left.order[x]] != of_right[right.order[y]]) & ((x < y) | (not itself))
            x, y = x[apart], y[apart]
        l, r = height
        least = left.sizes[l][x] + right.sizes[r][y]
        keep = []
        for i in range(0, len(x), STEP // AXES):
            a, b = left.boxes[l][x[i:i + STEP // AXES]], right.boxes[r][y[i:i + STEP // AXES]]
            keep.append(_common(a, b) * (100 + percent) >= percent * least[i:i + STEP // AXES])
        keep = np.concatenate([np.zeros(0, bool), *keep])
        x, y = x[keep], y[keep]
        if height == [0, 0]:
            break
        down = [l >= r and l > 0, r >= l and r > 0]
        if down[0]:
            children = _below(x, len(left.boxes[l - 1]))
            x, y = children.ravel(), np.repeat(y, FAN)
            x, y = x[x >= 0], y[x >= 0]
        if down[1]:
            children = _below(y, len(right.boxes[r - 1]))
            x, y = np.repeat(x, FAN), children.ravel()
            x, y = x[y >= 0], y[y >= 0]
        height = [l - down[0], r - down[1]]
    step = max(1, STEP // left.parities.shape[1])
    unlike = np.concatenate([np.zeros(0, np.int64), *(_unlike(left.parities[x[i:i + step]], right.parities[y[i:i + step]]) for i in range(0, len(x), step))])
    sizes = left.sizes[0][x] + right.sizes[0][y]
    near = unlike * (100 + percent) <= (100 - percent) * sizes
    x, y, unlike, sizes = x[near], y[near], unlike[near], sizes[near]
    step = max(1, STEP // left.points.shape[1])
    common = np.concatenate([np.zeros(0, np.int64), *(_common(left.points[x[i:i + step]], right.points[y[i:i + step]]) for i in range(0, len(x), step))])
    fits = common * (100 + percent) >= percent * sizes
    return left.order[x[fits]], right.order[y[fits]], 1 - unlike[fits] / sizes[fits]


def _likely(
    signature: int, node: list[int], component: list[int], own: np.ndarray, points: list[bytes], told: list[list[int] | None],
    named: list[list[int]], percent: int, every: bool,
) -> list[tuple[int, int]]:
    """The likeliest links that would join the components of a block, or of two blocks, each joined once; or ``every`` likely one.

    ``told`` has, for a node, larger nodes that it is known not to link with. ``named`` has some of
    its buckets: a pair whose nodes both name a smaller one than this is left to that one.
    """
    smaller = [{s for s in names if s < signature} for names in named]
    counts, parities, comp = _counts(points), _parities(points), np.array(component)
    left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
    tree = Tree(counts[left], parities[left])
    other = tree if own.min() == own.max() else Tree(counts[right], parities[right])
    a, b, share = tree_pairs(tree, other, comp[left], comp[right], percent)
    a, b = left[a], right[b]
    parent = {c: c for c in component}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    known = {(node[i], x) for i, others in enumerate(told) for x in others or ()}
    out = []
    for k in np.argsort(-share, kind="stable").tolist():
        i, j = int(a[k]), int(b[k])
        x, y = root(component[i]), root(component[j])
        pair = (min(node[i], node[j]), max(node[i], node[j]))
        if x != y and pair not in known and smaller[i].isdisjoint(smaller[j]):
            out.append(pair)
            if not every:
                parent[max(x, y)] = min(x, y)
    return out


def _blocks(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` (signature, node, size, _m: the bucket's members) with i, j, own: the blocks to be compared, and whose a row is.

    A bucket of up to ``BLOCK`` members is one block. A larger one is parted into ranges of set
    sizes, in sorted ranges of the whole table, so no task holds it; two of its blocks meet, as
    (i, j), i <= j, only if their sizes allow a link.
    """
    zero = [F.lit(0).cast("long").alias(c) for c in ("i", "j", "own")]
    small = rows.where(F.col("_m") <= BLOCK).select("signature", "node", "size", *zero)
    large = rows.where(F.col("_m") > BLOCK).select("signature", "node", "size")
    if large.isEmpty():
        return small
    placed = written(with_place(large, "signature", "size", "node").withColumn("block", F.floor((F.col("place") - 1) / BLOCK)))
    blocks = placed.groupBy("signature", "block").agg(F.min("size").alias("_low"), F.max("size").alias("_high"))
    smaller = blocks.select(F.col("signature").alias("_s"), F.col("block").alias("i"), F.col("_high").alias("_most"))
    meet = blocks.join(smaller, (F.col("signature") == F.col("_s")) & (F.col("i") <= F.col("block")) & (F.col("_low") * percent <= F.col("_most") * 100))
    meet = meet.select("_s", "i", F.col("block").alias("j"))
    side = lambda own, only: placed.join(only, (F.col("signature") == F.col("_s")) & (F.col("block") == F.col(own))).select(
        "signature", "node", "size", "i", "j", F.col("block").alias("own"))
    return small.unionByName(side("i", meet)).unionByName(side("j", meet.where("i < j")))


def _to_check(rows: DataFrame, label: DataFrame, sets: DataFrame, failed: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs to verify next: per bucket, or two blocks of one, a forest over the components that are left, or ``every`` likely pair.

    ``rows``: signature, node, size, _m; ``failed``: pairs a < b that do not link.
    """
    by = W.partitionBy("node").orderBy("signature")
    names = rows.select("node", "signature").withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= NAMED)
    names = names.groupBy(F.col("node").alias("_n")).agg(F.collect_list("signature").alias("named"))
    told = failed.groupBy(F.col("a").alias("_n")).agg(F.collect_list("b").alias("told"))
    about = sets.select(F.col("node").alias("_n"), "point").join(label.select(F.col("node").alias("_n"), "component"), "_n", "left").join(told, "_n", "left").join(names, "_n")
    full = _blocks(rows, percent).join(about, F.col("node") == F.col("_n")).select(
        "signature", "i", "j", "own", "node", F.coalesce("component", "node").alias("component"), "point", "told", "named"
    )
    ordered = full.repartition("signature", "i", "j").sortWithinPartitions("signature", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def pairs() -> list[tuple[int, int]]:
            if len({x[2] for x in held}) < 2:
                return []
            own, node, component, points, told, named = zip(*held)
            return _likely(key[0], list(node), list(component), np.array(own), list(points), list(told), list(named), percent, every)

        found: list[tuple[int, int]] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("signature", "i", "j", "own", "node", "component", "point", "told", "named")]
            for signature, i, j, *row in zip(*columns):
                if (signature, i, j) != key:
                    found += pairs()
                    key, held = (signature, i, j), []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            found = []
        found += pairs()
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        release()

    return shipped(ordered).mapInArrow(run, "a long, b long").distinct()


def ngram_components(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """id, n_shingles, component_id per document: the smallest id reachable by links, itself included.

    Two documents link when 100 * overlap >= percent * union of their sets of distinct
    ``width``-word shingles (A-Z lower-cased; the whole text if shorter). Documents with null
    or empty texts, or blanks only, have no shingle and stand alone. Equal sets are one node.
    Ids are integers; a null id stands alone with a null component. Repeated rows are
    returned each. An empty table gives an empty result; other columns are not read.

    Copies share a node, so groups of copies cost nothing more. A bucket has one reference;
    every node is first checked against one reference, and against the other one of a bucket of two.
    In each larger bucket whose members are still in different components after that, the likeliest
    pairs over its R-tree that would join what is apart are checked; where some of them do not
    link, all other pairs of their buckets that the bound leaves and that are still apart are
    checked too. Pairs of sets that share no bucket are never compared.
    """
    table = written(set_table(docs, width, id_col, text_col))
    filled = table.where("same is not null")
    nodes = filled.where("id is not null").groupBy("same").agg(F.min(F.col("id").cast("long")).alias("node"), F.first("n_shingles").alias("size"))
    by = W.partitionBy("signature")
    shared = (
        signature_table(docs, width, percent, id_col, text_col).withColumn("_least", F.min("same").over(by)).withColumn("_most", F.max("same").over(by))
        .where("_least <> _most").select("signature", "same", "_least").distinct()
    )
    refs = nodes.select(F.col("same").alias("_least"), F.col("node").alias("ref"), F.col("size").alias("ref_size"))
    buckets = written(
        shared.join(nodes, "same").join(refs, "_least")
        .select("signature", "node", "ref", "_least", "size", "ref_size")
    )
    # points of the nodes that share a bucket with another one only
    shown = sent(written(nodes.select("same", "node").join(buckets.select("node").distinct(), "node", "left_semi")))
    sets = written(filled.where("point is not null").join(shown, "same").select("node", "point").dropDuplicates(["node"]))
    first = buckets.where("node <> ref").groupBy("node").agg(F.min(F.struct("_least", "ref")).alias("_f")).select(F.col("_f.ref").alias("a"), F.col("node").alias("b"))
    # Two sets alone in a bucket are a pair to check as well; more than two may make up clusters.
    counted = buckets.join(buckets.groupBy("signature").agg(F.count(F.lit(1)).alias("_m")), "signature")
    sized = F.least("size", "ref_size") * 100 >= F.greatest("size", "ref_size") * percent
    lone = counted.where((F.col("node") != F.col("ref")) & (F.col("_m") == 2) & sized).select(F.col("ref").alias("a"), F.col("node").alias("b"))
    likely = written(_bounded(first.unionByName(lone).distinct(), sets, percent))
    links = written(verified(likely, docs, width, percent, id_col, text_col))
    ordered = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    failed = written(ordered(likely.join(links, ["a", "b"], "left_anti")))
    joined, again = components(links), None
    members = buckets.select("signature", "node", "size")
    for every in (False, True):
        open_ = (members if again is None else members.join(again, "signature", "left_semi")).join(
            joined.select(F.col("node").alias("_n"), "component"), F.col("node") == F.col("_n"), "left"
        ).groupBy("signature").agg(
            F.count(F.lit(1)).alias("_m"), F.min(F.coalesce("component", "node")).alias("_x"), F.max(F.coalesce("component", "node")).alias("_y"),
            F.bit_xor(F.xxhash64("node")).alias("_nodes"),
        ).where("_x <> _y and _m > 2")
        # buckets of the same members are one
        chosen = open_.groupBy("_m", "_nodes").agg(F.min("signature").alias("signature")).select("signature", "_m")
        tried = written(_to_check(written(members.join(chosen, "signature")), joined, sets, failed, percent, every))
        if tried.isEmpty():
            break
        found = written(ordered(verified(tried, docs, width, percent, id_col, text_col)))
        if not found.isEmpty():
            joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))
        missed = written(tried.join(found, ["a", "b"], "left_anti"))
        if every or missed.isEmpty():
            break  # every likely pair of the buckets that were left has been checked
        failed = written(failed.unionByName(missed))
        with_a = members.select("signature", F.col("node").alias("a")).join(missed, "a")
        again = written(with_a.join(members.select("signature", F.col("node").alias("b")), ["signature", "b"]).select("signature").distinct())
    label = joined.select(F.col("node").alias("_n"), "component")
    return (
        table.select("id", "n_shingles", "same").join(nodes, "same", "left").join(label, F.col("node") == F.col("_n"), "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "node", F.col("id").cast("long")).alias("component_id"))
    )
