"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of its own vector and the mean of the hashed vectors of its
four-byte sequences; words that few of the fitted texts hold share one vector. Every text is cut into overlapping windows of words; the
score of a text is the largest score of its windows.
"""
from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.labelled import scored
from vitrine.llm.words import LOWER, MARKS, mix, odd, slices, split_words, text_bytes

#: Labelled documents to fit on, at most, and bytes of their text.
MOST_ROWS, MOST_BYTES = 6_000, 14_000_000
#: Words of a window and between starts of windows: up to 17 words in a row always lie in one.
WINDOW, STRIDE = 32, 16
WORDS, GRAMS, WIDTH, HIDDEN = 1 << 14, 1 << 14, 12, 8
#: Fitted texts that hold a word with a vector of its own, at least.
SEEN_IN = 12
STEPS, BATCH, RATE = 700, 192, 0.01
#: Shrinking of the hashed vectors at each step, times the rate: rare words stay near zero.
DECAY = 0.1
#: Where a text counts as toxic; the fit puts its best cut there.
THRESHOLD = 0.3
#: Input of a place behind the end: it keeps the state as it is.
HOLD = 60.0


@dataclass
class Windows:
    """``at``: index of each word into ``words``/``grams``, -1 behind the end; ``rows``: first window of each text."""

    at: np.ndarray
    keys: np.ndarray
    words: np.ndarray
    grams: np.ndarray
    gram_rows: np.ndarray
    rows: np.ndarray


def cut(column: pa.Array) -> Windows:
    """Overlapping windows of all texts, one every ``STRIDE`` words; a text without words has one empty window."""
    data, offsets = text_bytes(column)
    words = split_words(LOWER[data], offsets, MARKS)
    keys, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
    starts, ends = words.starts[first], words.ends[first]
    # Four-byte sequences of each different word, with one mark before and two behind it.
    sizes = ends - starts + 3
    gram_rows = np.concatenate([[0], np.cumsum(sizes - 3)])
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = (place > 0) & (place < np.repeat(sizes, sizes) - 2)
    letters = np.zeros(len(place), np.uint64)
    letters[inside] = words.data[(np.repeat(starts, sizes) + place - 1)[inside]] + np.uint64(1)
    factors = odd(4, 41)
    grams = np.zeros(0, np.int64)
    if len(letters):
        sums = sum(letters[k:len(letters) - 3 + k] * factors[k] for k in range(4))
        whole = place[:-3] < np.repeat(sizes, sizes)[:-3] - 3
        grams = (mix(sums[whole]) >> np.uint64(64 - 14)).astype(np.int32)
    counts = np.diff(words.rows)
    windows = np.maximum(1, -(-np.maximum(counts - (WINDOW - STRIDE), 1) // STRIDE))
    rows = np.concatenate([[0], np.cumsum(windows)])
    begin = (np.arange(rows[-1]) - np.repeat(rows[:-1], windows)) * STRIDE + np.repeat(words.rows[:-1], windows)
    where = begin[:, None] + np.arange(WINDOW)
    past = where >= np.repeat(words.rows[1:], windows)[:, None]
    at = np.where(past, -1, back[np.where(past, 0, where)] if len(back) else -1).astype(np.int32)
    return Windows(at, keys, np.zeros(len(keys), np.int64), grams, gram_rows, rows)


def cut_all(texts: pa.Array) -> Windows:
    """``cut`` slice by slice, with each different word once in the whole."""
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    parts = [cut(part.column("text")) for part in slices(batch, "text", 500_000)]
    if not parts:
        return cut(texts)
    keys, first, back = np.unique(np.concatenate([w.keys for w in parts]), return_index=True, return_inverse=True)
    shift = np.cumsum([0, *(len(w.keys) for w in parts)])
    at = np.concatenate([np.where(w.at < 0, -1, back[np.maximum(w.at, 0) + shift[i]] if len(back) else -1).astype(np.int32) for i, w in enumerate(parts)])
    gram_rows = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(w.gram_rows) for w in parts]))])
    joined = Windows(at[:0], np.concatenate([w.keys for w in parts]), np.concatenate([w.words for w in parts]), np.concatenate([w.grams for w in parts]), gram_rows, gram_rows[:1])
    whole = _only(joined, first)
    rows = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(w.rows) for w in parts]))])
    return Windows(at, keys, whole.words, whole.grams, whole.gram_rows, rows)


def common_words(w: Windows) -> np.ndarray:
    """Hashes, in order, of the words that most texts hold."""
    held = np.zeros(len(w.keys), np.int64)
    for a, b in zip(w.rows[:-1], w.rows[1:]):
        own = np.unique(w.at[a:b])
        held[own[own >= 0]] += 1
    often = np.flatnonzero(held >= SEEN_IN)
    often = often[np.lexsort((w.keys[often], -held[often]))[: WORDS - 1]]
    return np.sort(w.keys[often])


def placed(w: Windows, vocabulary: np.ndarray) -> Windows:
    """With the row of each different word: 0 for all that have no vector of their own."""
    if len(vocabulary):
        i = np.minimum(np.searchsorted(vocabulary, w.keys), len(vocabulary) - 1)
        w.words = np.where(vocabulary[i] == w.keys, i + 1, 0)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _start(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f = lambda *shape, scale=0.1: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "word": f(WORDS, WIDTH), "gram": f(GRAMS, WIDTH),
        **{f"{side}{k}": v for side in "fb" for k, v in (("W", f(WIDTH, 3 * HIDDEN, scale=0.4)), ("U", f(HIDDEN, 3 * HIDDEN, scale=0.3)), ("c", np.zeros(3 * HIDDEN, np.float32)))},
        "A": f(2 * HIDDEN, HIDDEN, scale=0.4), "v": f(HIDDEN, scale=0.4), "out": f(2 * HIDDEN, scale=0.4), "bias": np.full(1, -1.0, np.float32),
    }


def _vectors(p: dict, w: Windows) -> np.ndarray:
    """The vector of each different word, with a row of zeros for -1 at the end."""
    out = np.zeros((len(w.words) + 1, WIDTH), np.float32)
    for i in range(0, len(w.words), 20_000):
        rows = w.gram_rows[i:i + 20_001]
        sums = np.add.reduceat(p["gram"][w.grams[rows[0]:rows[-1]]], rows[:-1] - rows[0])
        out[i:i + len(sums)] = p["word"][w.words[i:i + len(sums)]] + sums / np.sqrt(np.diff(rows)[:, None])
    return out


def _run(p: dict, side: str, inputs: np.ndarray, at: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each place of each window, in the order of places."""
    h = np.zeros((len(at), HIDDEN), np.float32)
    states = np.empty((WINDOW, len(at), HIDDEN), np.float32)
    order = range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1)
    for t in order:
        x, u = inputs[at[:, t]], h @ p[side + "U"]
        gates = _sigmoid(x[:, :2 * HIDDEN] + u[:, :2 * HIDDEN])
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:])
        if keep is not None:
            keep.append((t, h, r, z, n, u[:, 2 * HIDDEN:]))
        h = n + z * (h - n)
        states[t] = h
    return states


def _inputs(p: dict, side: str, vectors: np.ndarray) -> np.ndarray:
    x = vectors @ p[side + "W"] + p[side + "c"]
    x[-1] = 0
    x[-1, HIDDEN:2 * HIDDEN] = HOLD
    return x


def _pool(p: dict, states: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seen = np.tanh(states @ p["A"])
    e = seen @ p["v"]
    e[at.T < 0] = -1e9
    e -= e.max(0)
    a = np.exp(e)
    a /= a.sum(0)
    return seen, a, np.einsum("tn,tnh->nh", a, states)


def window_logits(p: dict, w: Windows, at: np.ndarray | None = None) -> np.ndarray:
    at = w.at if at is None else at
    vectors = _vectors(p, w)
    inputs = {side: _inputs(p, side, vectors) for side in "fb"}
    out = np.empty(len(at), np.float32)
    for i in range(0, len(at), 4096):
        part = at[i:i + 4096]
        states = np.concatenate([_run(p, side, inputs[side], part) for side in "fb"], axis=2)
        out[i:i + 4096] = _pool(p, states, part)[2] @ p["out"] + p["bias"]
    return out


def _gradients(p: dict, w: Windows, at: np.ndarray, y: np.ndarray, drop=None) -> dict[str, np.ndarray]:
    used, local = np.unique(at, return_inverse=True)
    local = local.reshape(at.shape)
    sub = _only(w, used)
    if drop is not None:
        sub.words = np.where(drop.random(len(sub.words)) < 0.5, 0, sub.words)
    if used[0] == -1:
        local = np.where(at < 0, -1, local - 1)
    vectors = _vectors(p, sub)
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([_run(p, s, _inputs(p, s, vectors), local, kept[s]) for s in "fb"], axis=2)
    seen, a, pooled = _pool(p, states, local)
    q = _sigmoid(pooled @ p["out"] + p["bias"])
    d = ((q - y) / len(y)).astype(np.float32)
    g = {"bias": d.sum(keepdims=True), "out": pooled.T @ d}
    d_pool = d[:, None] * p["out"]
    d_states = a[:, :, None] * d_pool
    d_a = np.einsum("tnh,nh->tn", states, d_pool)
    d_e = a * (d_a - (a * d_a).sum(0))
    d_seen = d_e[:, :, None] * p["v"] * (1 - seen**2)
    g["v"] = np.einsum("tn,tnh->h", d_e, seen)
    g["A"] = np.einsum("tni,tnj->ij", states, d_seen)
    d_states += d_seen @ p["A"].T
    d_vectors = np.zeros_like(vectors)
    for k, side in enumerate("fb"):
        part = d_states[:, :, k * HIDDEN:(k + 1) * HIDDEN]
        U, d_h = p[side + "U"], np.zeros((len(at), HIDDEN), np.float32)
        d_in = np.zeros((len(vectors), 3 * HIDDEN), np.float32)
        g[side + "U"] = np.zeros_like(U)
        for t, h, r, z, n, un in reversed(kept[side]):
            d_h = d_h + part[t]
            d_n = d_h * (1 - z) * (1 - n**2)
            d_z = d_h * (h - n) * z * (1 - z)
            d_r = d_n * un * r * (1 - r)
            d_x = np.concatenate([d_r, d_z, d_n], axis=1)
            d_u = np.concatenate([d_r, d_z, d_n * r], axis=1)
            g[side + "U"] += h.T @ d_u
            np.add.at(d_in, local[:, t], d_x)
            d_h = d_h * z + d_u @ U.T
        d_in[-1] = 0
        g[side + "W"], g[side + "c"] = vectors.T @ d_in, d_in.sum(0)
        d_vectors += d_in @ p[side + "W"].T
    g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
    if len(sub.words):
        np.add.at(g["word"], sub.words, d_vectors[:-1])
        n = np.diff(sub.gram_rows)
        np.add.at(g["gram"], sub.grams, np.repeat(d_vectors[:-1] / np.sqrt(n)[:, None], n, axis=0))
    return g


def _only(w: Windows, used: np.ndarray) -> Windows:
    """The different words that ``used`` names, and their trigrams."""
    used = used[used >= 0]
    sizes = np.diff(w.gram_rows)[used]
    rows = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(rows[-1], dtype=np.int32) + np.repeat((w.gram_rows[used] - rows[:-1]).astype(np.int32), sizes)
    return Windows(w.at[:0], w.keys[used], w.words[used], w.grams[place], rows, w.rows[:1])


def fit(texts: pa.Array, y: np.ndarray, steps: int = STEPS, seed: int = 5, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Adam on batches of windows, half of them from marked texts.

    Only the text is labelled, so a batch takes, of a marked text, the window that
    scores highest so far (any, to begin with), and of clean texts half any window,
    half one of the highest so far. ``weight``: documents that a text stands for where the cut is put.
    """
    p = _start(seed)
    rng = np.random.default_rng(seed)
    w = cut_all(texts)
    p["vocabulary"] = common_words(w)
    placed(w, p["vocabulary"])
    first, n = w.rows[:-1], np.diff(w.rows)
    marked, clean = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(marked) or not len(clean):
        p["out"][:] = 0
        p["bias"][:] = np.log((len(marked) + 1) / (len(clean) + 1))
        return p
    owner = np.repeat(np.arange(len(y)), n)
    best = hard = None
    weights = [k for k in p if k != "vocabulary"]
    m = {k: np.zeros_like(p[k]) for k in weights}
    s = {k: np.zeros_like(p[k]) for k in weights}
    for step in range(1, steps + 1):
        if step > steps // 4 and step % (steps // 8 or 1) == 0:
            logits = window_logits(p, w)
            order = np.lexsort((-logits, owner))
            top = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
            best, hard = top[marked], top[clean]
            hard = hard[np.argsort(-logits[hard])[: max(BATCH, len(hard) // 8)]]
        i = rng.integers(0, len(marked), BATCH // 2)
        from_marked = best[i] if best is not None else first[marked[i]] + (rng.random(len(i)) * n[marked[i]]).astype(int)
        j = clean[rng.integers(0, len(clean), BATCH - len(i))]
        from_clean = first[j] + (rng.random(len(j)) * n[j]).astype(int)
        if hard is not None:
            from_clean[::2] = hard[rng.integers(0, len(hard), len(from_clean[::2]))]
        target = np.concatenate([np.ones(len(i), np.float32), np.zeros(len(j), np.float32)])
        g = _gradients(p, w, w.at[np.concatenate([from_marked, from_clean])], target, rng)
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for k in weights:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
            if k in ("word", "gram"):
                p[k] *= 1 - rate * DECAY
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
    p["bias"] += np.float32(np.log(THRESHOLD / (1 - THRESHOLD))) - _best_cut(np.maximum.reduceat(window_logits(p, w), first), y, np.ones(len(y)) if weight is None else weight)
    return p


def _best_cut(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.float32:
    """The cut with the best F1 over the fitted texts, in the middle between its neighbours."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum((weight * y)[order])
    f1 = 2 * hits / (np.cumsum(weight[order]) + (weight * y).sum())
    k = int(np.argmax(f1))
    below = logits[order[min(k + 1, len(y) - 1)]]
    return np.float32((logits[order[k]] + below) / 2)


def score_texts(p: dict[str, np.ndarray], column: pa.Array) -> np.ndarray:
    """The largest window score of each text."""
    if not len(column):
        return np.zeros(0)
    w = placed(cut(column), p["vocabulary"])
    return _sigmoid(np.maximum.reduceat(window_logits(p, w), w.rows[:-1]).astype(np.float64))


def _share(sizes: np.ndarray, most_bytes: int) -> int:
    """The largest bound for which all sizes, each cut to it, come to ``most_bytes`` at most."""
    order = np.sort(sizes)
    before = np.cumsum(order) - order
    bounds = (most_bytes - before) // np.arange(len(order), 0, -1)
    over = np.flatnonzero(bounds < order)
    return int(max(0, bounds[over[0]])) if len(over) else int(sizes.max(initial=0))


def chosen_texts(
    docs: DataFrame, labels: DataFrame, fit_on: Column, label: str = "toxic", most: int = MOST_ROWS,
    most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text",
) -> pd.DataFrame:
    """_id, _text, _label, _weight: labelled texts to fit on, the same ones in every run.

    Half of ``most`` rows for each label, in the order of a hash of the id; what one label
    leaves goes to the other. Sizes are collected first, and of the texts only what is chosen.
    A marked text is taken whole or not at all, since its mark need not hold for a part: the
    shorter ones, within half of ``most_bytes`` or what the clean ones leave. Every clean text
    is taken, a long one with a piece at a place that its hash gives. ``_weight``: labelled
    documents of its label that a row stands for.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & fit_on)
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_label")).where("_label in (0, 1)")
    )
    total = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    first = [known.where(F.col("_label") == v).orderBy(F.xxhash64("_id"), "_id").limit(most) for v in (0, 1)]
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sized = (
        texts.join(F.broadcast(first[0].unionByName(first[1])), "_id")
        .groupBy("_id", "_label").agg(F.min(F.struct(F.xxhash64("_text").alias("_hash"), F.octet_length("_text").cast("long").alias("_bytes"))).alias("_s"))
        .select("_id", "_label", "_s._hash", "_s._bytes", F.xxhash64("_id").alias("_order")).toPandas()
    ).sort_values(["_order", "_id"])
    clean, marked = (sized[sized["_label"] == v] for v in (0, 1))
    marked_rows = min(len(marked), max(most // 2, most - len(clean)))
    clean, marked = clean[: most - marked_rows], marked[:marked_rows].sort_values("_bytes", kind="stable")
    marked = marked[marked["_bytes"].cumsum() <= max(most_bytes // 2, most_bytes - int(clean["_bytes"].sum()))]
    bound = _share(clean["_bytes"].to_numpy(np.int64), most_bytes - int(marked["_bytes"].sum()))
    rows = [(*r, len_ if label_ else min(len_, bound), total[label_] / n) for part in (clean, marked) for n in [len(part)]
            for *r, label_, len_ in part[["_id", "_hash", "_label", "_bytes"]].itertuples(index=False)]
    spark, kind = docs.sparkSession, texts.schema["_id"].dataType.simpleString()
    taken = spark.createDataFrame([(i, int(h), int(n), float(w)) for i, h, n, w in rows], f"_id {kind}, _hash long, _take long, _weight double")
    data = F.col("_text").cast("binary")
    start = F.pmod(F.col("_hash"), F.octet_length("_text") - F.col("_take") + 1) + 1
    found = (
        texts.withColumn("_hash", F.xxhash64("_text")).join(F.broadcast(taken), ["_id", "_hash"])
        .select("_id", F.substring(data, start.cast("int"), F.col("_take").cast("int")).alias("_text"), "_weight").dropDuplicates(["_id"]).toPandas()
    )
    found["_text"] = [bytes(t).decode("utf-8", "ignore") for t in found["_text"]]
    return found.merge(sized[["_id", "_label"]], on="_id").sort_values("_id", ignore_index=True)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, fit_on: Column, label: str = "toxic", most: int = MOST_ROWS,
    most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text",
) -> dict[str, np.ndarray]:
    """Fit on the driver on at most ``most`` labelled documents, of ``most_bytes`` together; warns if a label has none."""
    rows = chosen_texts(docs, labels, fit_on, label, most, most_bytes, id_col, text_col)
    y = rows["_label"].to_numpy(np.float32)
    if len(np.unique(y)) < 2:
        warnings.warn(f"{int((y == 1).sum())} marked and {int((y == 0).sum())} clean texts to fit {label} on: all documents score the same", stacklevel=2)
    return fit(pa.array(rows["_text"], pa.string()), y, weight=rows["_weight"].to_numpy(np.float64))


def toxicity_scores(docs: DataFrame, model: dict[str, np.ndarray], columns: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """``columns`` of every document and its score, from all windows of its whole text.

    Null and empty texts score as one empty window. Repeated rows are scored each;
    other columns are not read. An empty table gives an empty result. ``name`` must not
    be one of ``columns``.
    """
    return scored(docs, text_col, columns, lambda column: score_texts(model, column), name)
