"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees on one feature at a time, boosted in cycles, add up to one lookup table
per feature; then trees on pairs of features add up to one table per chosen pair. A
score is a sum of bin lookups.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.labelled import sample, scored
from vitrine.llm.shipping import shipped
from vitrine.llm.words import release, slices, split_words, text_bytes

#: Labelled documents to fit on, at most.
MOST_ROWS = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 80, 40, 6
RATE = 0.1
#: Words of one block; the worst block of a text is a feature beside the mean.
BLOCK = 24

FEATURES = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "stop", "newline", "other",
    "distinct", "line_words", "symbol_mean", "symbol_max", "repeat_mean", "repeat_max", "upper_mean",
    "upper_max", "bar_mean", "bar_max", "seen_mean", "seen_max", "numeric_mean", "numeric_max",
]


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.float32)
    table[list(chars)] = 1
    return table


UPPER = _class(bytes(range(65, 91)))
DIGIT = _class(b"0123456789")
STOP = _class(b".,;:?!")
LINE = _class(b"\n")
OTHER = _class(bytes(range(128, 256)))
SYMBOL = np.ones(256, np.float32) - _class(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]) + b" \t\n\v\f\r.,;:?'\"-()")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def features(column: pa.Array) -> np.ndarray:
    """One row of features per text, each from the whole text; all zero for an empty one."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)), np.float64)
    if not len(data):
        return out
    words = split_words(data, offsets)
    hashes, rows = words.hashes(), words.rows
    sizes, counts = np.diff(offsets), np.diff(rows)
    per_byte, per_word = 1 / np.maximum(sizes, 1), 1 / np.maximum(counts, 1)
    out[:, 0], out[:, 1] = np.log1p(sizes), np.log1p(counts)
    lengths = (words.ends - words.starts).astype(np.float64)
    out[:, 2] = _sums(lengths, rows) * per_word
    for i, table in enumerate((UPPER, DIGIT, SYMBOL, STOP, LINE, OTHER)):
        out[:, 3 + i] = _sums(table[data], offsets) * per_byte
    if not len(hashes):
        return out
    row = words.row_of()
    order = np.lexsort((hashes, row))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    seen = np.ones(len(order))
    seen[order[new]] = 0  # lexsort is stable: the first of equal words is the first in the text
    out[:, 9] = _sums(1 - seen, rows) * per_word
    out[:, 10] = counts / (1 + _sums(LINE[data], offsets))
    last = data[words.ends - 1]
    repeat = np.zeros(len(hashes))
    repeat[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    letters = np.add.reduceat(UPPER[data], words.starts)
    digits = np.add.reduceat(DIGIT[data], words.starts)
    shares = [
        SYMBOL[last].astype(np.float64), repeat, ((letters >= 2) & (letters * 2 >= lengths)).astype(np.float64),
        ((lengths == 1) & (data[words.starts] == ord("|"))).astype(np.float64), seen, (digits * 2 > lengths).astype(np.float64),
    ]
    # Blocks of words: a new one starts at each text and after every BLOCK words of it.
    place = np.arange(len(hashes)) - np.repeat(rows[:-1], counts)
    starts = np.flatnonzero(place % BLOCK == 0)
    block_rows = np.searchsorted(starts, rows)
    filled = counts > 0
    in_block = np.diff(np.append(starts, len(hashes)))
    for i, share in enumerate(shares):
        out[:, 11 + 2 * i] = _sums(share, rows) * per_word
        block = np.add.reduceat(share, starts) / np.maximum(in_block, BLOCK // 2)
        out[filled, 12 + 2 * i] = np.maximum.reduceat(block, block_rows[:-1][filled])
    return out


@dataclass
class AdditiveModel:
    base: float
    cuts: list[np.ndarray]
    tables: np.ndarray
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, cuts in enumerate(self.cuts):
            out += self.tables[j][np.searchsorted(cuts, x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            out += table[_bin(self.pair_cuts[a], x[:, a]), _bin(self.pair_cuts[b], x[:, b])]
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(features(column)), -30, 30)))


def _bin(cuts: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, values, side="right")


def _quantiles(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if len(values) else np.zeros(0)


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(left_h < 0.5) | (right_h < 0.5)] = 0
    i = int(np.argmax(gain))
    return float(gain[i]), i + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values by bin of a tree on one feature."""
    gain, cut = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree that splits the first feature once, then each side by the second one."""
    best, value = 0.0, np.full(g.shape, _leaf(g.sum(), h.sum()))
    for cut in range(1, g.shape[0]):
        halves, gain = [], 0.0
        for part in (slice(None, cut), slice(cut, None)):
            pg, ph = g[part].sum(0), h[part].sum(0)
            won, _ = _best_cut(pg, ph)
            gain += won + pg.sum() ** 2 / (ph.sum() + 1)
            halves.append(np.broadcast_to(_tree(pg, ph, 1), g[part].shape))
        gain -= g.sum() ** 2 / (h.sum() + 1)
        if gain > best:
            best, value = gain, np.concatenate(halves)
    return best, value


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fit by Newton steps; without rows, or with one class, every text gets the prior score."""
    p = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    width = len(FEATURES)
    cuts = [_quantiles(x[:, j], BINS) for j in range(width)]
    pair_cuts = [_quantiles(x[:, j], PAIR_BINS) for j in range(width)]
    model = AdditiveModel(base, cuts, np.zeros((width, BINS)), pair_cuts, [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    if len(y) == 0 or y.min() == y.max():
        return model
    bins = [_bin(cuts[j], x[:, j]) for j in range(width)]
    total = np.full(len(y), base)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = gradients()
            step = RATE * _tree(np.bincount(bins[j], g, BINS), np.bincount(bins[j], h, BINS), 2)
            model.tables[j] += step
            total += step[bins[j]]
    small = [_bin(pair_cuts[j], x[:, j]) for j in range(width)]
    cell = lambda a, b: small[a] * PAIR_BINS + small[b]
    grid = lambda a, b, v: np.bincount(cell(a, b), v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = gradients()
    ranked = sorted(combinations(range(width), 2), key=lambda ab: -_pair_tree(grid(*ab, g), grid(*ab, h))[0])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = np.zeros((len(model.pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for i, (a, b) in enumerate(model.pairs):
            g, h = gradients()
            step = RATE * _pair_tree(grid(a, b, g), grid(a, b, h))[1]
            model.pair_tables[i] += step
            total += step[small[a], small[b]]
    return model


def fit_quality(
    docs: DataFrame, labels: DataFrame, fit_on: Column, label: str = "quality", most: int = MOST_ROWS,
    id_col: str = "doc_id", text_col: str = "text",
) -> AdditiveModel:
    """Fit on at most ``most`` labelled documents; only their feature rows reach the driver."""
    chosen = sample(docs, labels, label, fit_on, most, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                rows = pa.array(list(features(part.column("_text"))), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("_id"), rows, part.column("_label")], names=["_id", "x", "y"])

    kind = chosen.schema["_id"].dataType.simpleString()
    rows: pd.DataFrame = shipped(chosen).mapInArrow(run, f"_id {kind}, x array<double>, y int").toPandas().sort_values("_id")
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    model = fit(x, rows["y"].to_numpy(np.float64))
    del rows, x
    release()
    return model


def quality_scores(docs: DataFrame, model: AdditiveModel, columns: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """``columns`` of every document and its score, from its whole text.

    Null and empty texts score by their zero features. Repeated rows are scored
    each; other columns are not read. An empty table gives an empty result. ``name`` must
    not be one of ``columns``.
    """
    return scored(docs, text_col, columns, model.score, name)
