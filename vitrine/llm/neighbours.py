"""Approximate nearest neighbours over learned partitions.

A neighbour graph of a bounded sample is cut into balanced partitions; a small network
learns to name the partition of a vector. All vectors are filed by its first choice. A
second one learns in which partitions the nearest of a query are filed; queries are sent
to several of the most probable ones and ranked there on the original vectors in double
precision. The measure is the inner product, so candidates are filed with one coordinate
more, sqrt(longest ** 2 - length ** 2), which makes nearness of directions out of it.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.llm.shipping import shipped
from vitrine.llm.tables import written

#: Vectors that the graph and the network are fitted on, at most; all vectors are indexed.
MOST_ROWS = 10_000
#: Neighbours in the graph, hidden units, and steps of the fit.
DEGREE, HIDDEN, STEPS, BATCH, RATE = 20, 128, 1500, 256, 0.01
#: A query is sent to its most probable partitions until they hold this share of its neighbours by the network's word.
SHARE = 0.95
#: Candidates and queries that meet in one task at most, or nearly.
BLOCK, QUERY_BLOCK = 20_000, 2_000


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


    def choices(self, x: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Partitions from the most probable on, and how many of them reach ``share``."""
        logits = self.logits(x)
        order = np.argsort(-logits, axis=1, kind="stable").astype(np.int32)
        p = np.exp(logits - logits.max(1, keepdims=True))
        p = np.take_along_axis(p / p.sum(1, keepdims=True), order, 1).cumsum(1)
        return order, np.minimum(1 + (p < share).sum(1), p.shape[1])


def _levelled(x: np.ndarray, longest: float) -> np.ndarray:
    """Candidates of one length: one coordinate more holds what each lacks of the longest."""
    x = x / max(longest, 1e-300)
    return np.hstack([x, np.sqrt(np.maximum(1 - (x * x).sum(1, keepdims=True), 0))])


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).astype(np.float32)


def neighbour_graph(x: np.ndarray, degree: int, asked: np.ndarray | None = None) -> np.ndarray:
    """The nearest rows of ``x`` of each row (or of what it asks for) by inner product, never the row itself, block by block."""
    asked = x if asked is None else asked
    out = np.empty((len(x), min(degree, max(len(x) - 1, 0))), np.int64)
    for i in range(0, len(x), 1024):
        near = asked[i:i + 1024] @ x.T
        near[np.arange(len(near)), i + np.arange(len(near))] = -np.inf
        out[i:i + 1024] = np.argpartition(-near, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else 0
    return out


def balanced_partitions(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.2, seed: int = 3) -> np.ndarray:
    """A partition per row: seeded by balanced bisection, then moved to where most neighbours are, within a limit of size."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        halves = []
        for g in groups:
            # halve along the direction between two far rows of the group
            a = g[rng.integers(len(g))]
            b = g[np.argmin(x[g] @ x[a])]
            order = g[np.argsort(x[g] @ (x[a] - x[b]), kind="stable")]
            halves += [order[: len(g) // 2], order[len(g) // 2:]]
        groups = halves
    for k, g in enumerate(groups):
        part[g] = k
    most = int(np.ceil(slack * len(x) / parts))
    back = [[] for _ in range(len(x))]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    near = [np.concatenate([graph[i], np.array(b, np.int64)]) for i, b in enumerate(back)]
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(part[near[i]], minlength=parts)
            votes[(sizes >= most)] = -1
            votes[part[i]] = max(votes[part[i]], (part[near[i]] == part[i]).sum())
            k = int(np.argmax(votes))
            if votes[k] > votes[part[i]]:
                sizes[part[i]] -= 1
                sizes[k] += 1
                part[i] = k
                moved += 1
        if moved < len(x) // 200:
            break
    return part


def _learned(x: np.ndarray, near: np.ndarray, own: np.ndarray | None, parts: int, seed: int) -> Router:
    """A network with one hidden layer that learns each row's shares of partitions in ``near``, with a double weight for ``own``."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    p = {"w1": rng.standard_normal((width, HIDDEN)) / np.sqrt(width) * 2, "b1": np.zeros(HIDDEN), "w2": rng.standard_normal((HIDDEN, parts)) * 0.1, "b2": np.zeros(parts)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, STEPS + 1 if parts > 1 and len(x) > parts else 1):
        i = rng.integers(0, len(x), BATCH)
        target = np.zeros((BATCH, parts), np.float32)
        np.add.at(target, (np.arange(BATCH)[:, None], near[i]), 1)
        if own is not None:
            np.add.at(target, (np.arange(BATCH), own[i]), 2)
        target /= target.sum(1, keepdims=True)
        z = x[i] @ p["w1"] + p["b1"]
        h = np.maximum(z, 0)
        logits = h @ p["w2"] + p["b2"]
        q = np.exp(logits - logits.max(1, keepdims=True))
        d = (q / q.sum(1, keepdims=True) - target) / BATCH
        dz = (d @ p["w2"].T) * (z > 0)
        g = {"w2": h.T @ d, "b2": d.sum(0), "w1": x[i].T @ dz, "b1": dz.sum(0)}
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
            p[k] -= RATE * (1 - step / (STEPS + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    return Router(**p)


def fit_routers(x: np.ndarray, parts: int, longest: float, seed: int = 3) -> tuple[Router, Router]:
    """The network that files candidates, from their graph and its partitions, and the one that sends queries."""
    level = _unit(_levelled(x, longest))
    small = parts < 2 or len(x) <= parts
    graph = np.zeros((len(x), 1), np.int64) if small else neighbour_graph(level, DEGREE)
    part = np.zeros(len(x), np.int64) if small else balanced_partitions(level, graph, parts)
    filing = _learned(level, part[graph], part, parts, seed)
    filed = filing.logits(level).argmax(1)
    sought = graph if small else neighbour_graph(x.astype(np.float32), DEGREE, _unit(x))
    return filing, _learned(_unit(x), filed[sought], None, parts, seed)


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not all zero, and of finite components only."""
    return F.coalesce(
        F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(vector, lambda v: v != 0), F.lit(False)
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    parts: int | None = None, share: float = SHARE, most: int = MOST_ROWS,
) -> DataFrame:
    """query_id, rank, id, score: the ``k`` nearest found of each query by inner product, ties to the smaller id.

    ``queries`` selects the query rows; every other usable row is a candidate, never the query's
    own. Vectors that are null, zero, or hold null or non-finite components take no
    part; neither do null ids, nor rows whose number of components is not the commonest one.
    Of rows that share an id the smallest vector counts. With at most ``k`` candidates all are returned. An
    empty table gives an empty result. Extra columns are not read.

    ``parts`` grows with the square root of the number of vectors unless given, so work per query does
    too where neighbours lie close together. A query among neighbours is sent to one or two partitions; one without
    near neighbours, whose nearest are scattered, to most of them. A large partition is cut into blocks of candidates and of queries, each block pair one group; their best
    ``k`` are merged. ``most`` rows of the smallest hashed ids are the sample for the fit.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.min(F.col(vector_col).cast("array<double>")).alias("v"), F.max(queries).alias("asked")
    )
    rows = written(rows)
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "w").first()
    if widths is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score")).limit(0)
    rows, total = rows.where(F.size("v") == widths["w"]), widths["n"]
    if parts is None:
        parts = 1 << max(0, round(np.log2(max(np.sqrt(total) / 4, 1))))
    sample = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(most).toPandas()["v"])
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    longest = float(rows.agg(F.max(length)).first()[0])
    filing, sending = fit_routers(sample, parts, longest)

    def route(batches):
        for frame in batches:
            x = _matrix(frame["v"])
            if len(x):
                order, n = sending.choices(_unit(x), share)
                home = filing.logits(_unit(_levelled(x, longest))).argmax(1).astype(np.int32)
                yield frame.assign(home=home, order=[o[:m] if a else None for o, m, a in zip(order, n, frame["asked"])])

    routed = written(shipped(rows).mapInPandas(route, "id long, v array<double>, asked boolean, home int, order array<int>"))
    sizes = routed.groupBy(F.col("home").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    blocks = F.broadcast(sizes.select("part", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))  # one row per partition
    filed = routed.select(F.col("home").alias("part"), "id", "v").join(blocks, "part").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    sent = routed.where("asked").select("id", "v", F.explode("order").alias("part")).join(blocks, "part")
    turns = F.broadcast(sent.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("turns")))
    sent = sent.join(turns, "part").withColumn("turn", F.pmod(F.xxhash64("id", F.lit(1)), "turns").cast("int"))
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    filed = filed.join(turns, "part").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))

    keys = ["part", "block", "turn"]
    filed = filed.select(*[F.col(c).alias(f"in_{c}") for c in keys], F.col("id").alias("in_id"), F.col("v").alias("in_v"))
    sent = sent.select(*[F.col(c).alias(f"to_{c}") for c in keys], F.col("id").alias("to_id"), F.col("v").alias("to_v"))

    def rank(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})
        if not len(asked) or not len(found):
            return empty
        found = found.sort_values("in_id")
        ids, x = found["in_id"].to_numpy(), _matrix(found["in_v"])
        out = []
        for i in range(0, len(asked), 256):
            part = asked.iloc[i:i + 256]
            own = part["to_id"].to_numpy()
            score = _matrix(part["to_v"]) @ x.T
            score[own[:, None] == ids] = -np.inf
            least = -np.partition(-score, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
            # Sums may differ in the last places between blocks of work: keep what is near the limit too.
            q, c = np.nonzero((score >= least[:, None] - 1e-9 * np.abs(least[:, None])) & (score > -np.inf))
            exact = np.array([float(np.dot(a, b)) for a, b in zip(_matrix(part["to_v"])[q], x[c])])
            frame = pd.DataFrame({"query_id": own[q], "id": ids[c], "score": exact})
            out.append(frame.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id").head(k))
        return pd.concat(out) if out else empty

    scored = sent.groupBy(*[f"to_{c}" for c in keys]).cogroup(filed.groupBy(*[f"in_{c}" for c in keys])).applyInPandas(rank, "query_id long, id long, score double")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
