"""HTML extraction: a bidirectional LSTM labels the blocks of a page as main text or not, in numpy.

A page is a sequence of blocks. Each enters as a vector of its tag path, a hashed
vector of its words and a few counts; the network reads the whole sequence in both
directions before it judges any block.
"""
from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.html_blocks import Page, parse
from vitrine.llm.page_examples import Maker
from vitrine.llm.shipping import shipped
from vitrine.llm.words import LOWER, MARKS, slices, split_words, text_bytes

#: Vector sizes: tokens of the path, words, counts.
PATH, WORD, COUNTS = 128, 64, 9
HIDDEN = 20
#: Pages made up, and given pages read, to fit on; their markup is bounded too.
MADE, GIVEN, GIVEN_BYTES = 1600, 200, 3_000_000
STEPS, BATCH, RATE = 900, 24, 0.01
#: Blocks of a made-up or given page that is learned from, at most; all blocks of a page are judged.
LEARNED_BLOCKS = 120
#: Blocks judged together: pages of like length side by side.
GROUP = 20_000
_BOILERPLATE = frozenset("nav footer aside form header dialog menu button".split())


@lru_cache(maxsize=50_000)
def _path_slots(path: tuple[str, ...]) -> np.ndarray:
    return np.unique([zlib.crc32(t.encode()) % PATH for t in path])


def vectors(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """One row per block of all pages, and where each page's begin."""
    texts = [t for p in pages for t in p.texts]
    bounds = np.cumsum([0, *(len(p.texts) for p in pages)])
    n = len(texts)
    out = np.zeros((n, PATH + WORD + COUNTS), np.float32)
    if not n:
        return out, bounds
    slots = [_path_slots(path) for p in pages for path in p.paths]
    out[np.repeat(np.arange(n), [len(s) for s in slots]), np.concatenate(slots).astype(np.int64)] = 1
    data, offsets = text_bytes(pa.array(texts, pa.large_string() if sum(map(len, texts)) > 1 << 29 else pa.string()))
    words = split_words(LOWER[data], offsets, MARKS)
    row = words.row_of()
    at = row * WORD + (words.hashes() >> np.uint64(58)).astype(np.int64)
    counts = np.bincount(at, minlength=n * WORD).reshape(n, WORD)
    total = np.diff(words.rows)
    out[:, PATH:PATH + WORD] = np.sqrt(counts / np.maximum(total, 1)[:, None]) * 2
    sizes = np.diff(offsets)
    chars = np.array([len(t) for t in texts])
    linked = np.array([x for p in pages for x in p.linked]) / chars
    stops = np.isin(data, np.frombuffer(b".,;:!?", np.uint8))
    sums = np.concatenate([[0], np.cumsum(stops)])
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    last = data[offsets[1:] - 1]
    place = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    of = np.repeat(np.diff(bounds), np.diff(bounds))
    extra = out[:, PATH + WORD:]
    extra[:, 0] = np.log1p(total) / 3
    extra[:, 1] = np.minimum(linked, 1)
    extra[:, 2] = np.minimum((sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(total, 1), 1)
    extra[:, 3] = np.isin(last, np.frombuffer(b".!?", np.uint8))
    extra[:, 4] = (upper[offsets[1:]] - upper[offsets[:-1]]) / np.maximum(sizes, 1)
    extra[:, 5] = place / of
    extra[:, 6] = np.exp(-place / 3)
    extra[:, 7] = np.exp(-(of - 1 - place) / 3)
    extra[:, 8] = np.array([".hidden" in path for p in pages for path in p.paths])
    return out, bounds


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _start(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {f"{side}{k}": v for side in "fb" for k, v in (("W", f(PATH + WORD + COUNTS, 4 * HIDDEN) * 0.5), ("U", f(HIDDEN, 4 * HIDDEN)), ("c", np.zeros(4 * HIDDEN, np.float32)))}
    for side in "fb":
        p[side + "c"][HIDDEN:2 * HIDDEN] = 1
    return p | {"out": f(2 * HIDDEN), "skip": np.zeros(PATH + WORD + COUNTS, np.float32), "bias": np.zeros(1, np.float32)}


def _lstm(p: dict, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of padded sequences (place, page, input); a padded place keeps the state as it is."""
    steps, n, _ = x.shape
    gates_in = x.reshape(-1, x.shape[2]) @ p[side + "W"] + p[side + "c"]
    gates_in = gates_in.reshape(steps, n, -1)
    h = np.zeros((n, HIDDEN), np.float32)
    c = np.zeros((n, HIDDEN), np.float32)
    out = np.empty((steps, n, HIDDEN), np.float32)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        g = gates_in[t] + h @ p[side + "U"]
        s = _sigmoid(g[:, :3 * HIDDEN])
        i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:], np.tanh(g[:, 3 * HIDDEN:])
        m = mask[t][:, None]
        new_c = np.where(m, f * c + i * u, c)
        tc = np.tanh(new_c)
        new_h = np.where(m, o * tc, h)
        if keep is not None:
            keep.append((t, h, c, i, f, o, u, tc))
        h, c = new_h, new_c
        out[t] = h
    return out


def _padded(x: np.ndarray, bounds: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs by place and page, which of them are filled, and the row of each."""
    sizes = np.diff(bounds)[pages]
    rows = bounds[:-1][pages] + np.arange(sizes.max())[:, None]
    mask = np.arange(sizes.max())[:, None] < sizes
    rows = np.where(mask, rows, 0)
    return x[rows] * mask[:, :, None], mask, rows


def judge(p: dict[str, np.ndarray], x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The logit of each block."""
    out = np.zeros(len(x), np.float32)
    sizes = np.diff(bounds)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and sizes[order[j]] * (j + 1 - i) <= GROUP:
            j += 1
        padded, mask, rows = _padded(x, bounds, order[i:j])
        states = np.concatenate([_lstm(p, side, padded, mask) for side in "fb"], axis=2)
        logit = states @ p["out"] + padded @ p["skip"] + p["bias"]
        out[rows[mask]] = logit[mask]
        i = j
    return out


def _gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    kept: dict[str, list] = {"f": [], "b": []}
    states = np.concatenate([_lstm(p, side, x, mask, kept[side]) for side in "fb"], axis=2)
    q = _sigmoid(states @ p["out"] + x @ p["skip"] + p["bias"])
    d = ((q - y) * mask / mask.sum()).astype(np.float32)
    flat = x.reshape(-1, x.shape[2])
    g = {"bias": d.sum(keepdims=True).reshape(1), "out": np.einsum("tn,tnh->h", d, states), "skip": d.reshape(-1) @ flat}
    for k, side in enumerate("fb"):
        d_states = d[:, :, None] * p["out"][k * HIDDEN:(k + 1) * HIDDEN]
        d_gates = np.zeros((x.shape[0], x.shape[1], 4 * HIDDEN), np.float32)
        d_h = np.zeros((x.shape[1], HIDDEN), np.float32)
        d_c = np.zeros_like(d_h)
        g[side + "U"] = np.zeros_like(p[side + "U"])
        for t, h, c, i, f, o, u, tc in reversed(kept[side]):
            d_h = d_h + d_states[t]
            m = mask[t][:, None]
            d_o = d_h * tc
            d_new = d_c + d_h * o * (1 - tc**2)
            step = np.concatenate([d_new * u * i * (1 - i), d_new * c * f * (1 - f), d_o * o * (1 - o), d_new * i * (1 - u**2)], axis=1) * m
            d_gates[t] = step
            g[side + "U"] += h.T @ step
            d_h = np.where(m, step @ p[side + "U"].T, d_h)
            d_c = np.where(m, d_new * f, d_c)
        wide = d_gates.reshape(-1, 4 * HIDDEN)
        g[side + "W"], g[side + "c"] = flat.T @ wide, wide.sum(0)
    return g


def _made(maker: Maker) -> tuple[Page, np.ndarray]:
    """A made-up page, its blocks labelled by the piece they come from."""
    pieces = maker.page()
    markers, source = [], []
    for i, (markup, label) in enumerate(pieces):
        if label >= 0:
            # A private-use character before each text marks its piece; it is taken out again below.
            markup = re.sub(r">([^<]*[^<\s][^<]*)", lambda m, mark=chr(0xE000 + i): f">{mark}{m[1]}", markup if markup.startswith("<") else f"<!---->{markup}")
        markers.append(label)
        source.append(markup)
    page = parse("".join(source), {})
    labels, keep = [], []
    for k, text in enumerate(page.texts):
        found = re.findall("[\ue000-\uf8ff]", text)
        labels.append(markers[ord(found[0]) - 0xE000] if found else 0)
        page.texts[k] = " ".join(re.sub("[\ue000-\uf8ff]", "", text).split())
        keep.append(bool(page.texts[k]))
    page = Page(*([v for v, ok in zip(values, keep) if ok] for values in (page.texts, page.paths, page.linked)))
    return page, np.array([v for v, ok in zip(labels, keep) if ok], np.float32)


def _given(source: str) -> tuple[Page, np.ndarray] | None:
    """A given page labelled by its markup: what is in its only article and in no part for other things."""
    if len(re.findall(r"<article\b", source)) != 1:
        return None
    page = parse(source, {})
    labels = [float("article" in path and not _BOILERPLATE & set(path)) for path in page.paths]
    return page, np.array(labels, np.float32)


def fit(given: list[str], made: int = MADE, steps: int = STEPS, seed: int = 9) -> dict[str, np.ndarray]:
    """Adam over made-up pages and, where there are any, given ones that their own markup labels."""
    examples = [e for e in map(_given, given) if e and len(e[1])]
    sentences = [t for page, y in examples for t, ok in zip(page.texts, y) if len(t) > 40][:2000]
    maker = Maker(seed, sentences)
    examples = [_made(maker) for _ in range(made)] + examples
    examples = [(Page(e.texts[:LEARNED_BLOCKS], e.paths[:LEARNED_BLOCKS], e.linked[:LEARNED_BLOCKS]), y[:LEARNED_BLOCKS]) for e, y in examples]
    x, bounds = vectors([e for e, _ in examples])
    y = np.concatenate([e for _, e in examples])
    rng = np.random.default_rng(seed)
    p = _start(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        padded, mask, rows = _padded(x, bounds, rng.integers(0, len(examples), BATCH))
        # Some pages come without class words, so that words and order are learned too.
        padded = padded * np.where(rng.random((1, padded.shape[1], padded.shape[2])) < 0.1, 0, 1).astype(np.float32)
        g = _gradients(p, padded, mask, y[rows])
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
    return p


def main_texts(p: dict[str, np.ndarray], sources: list[str | None]) -> list[str]:
    """The main text of each page: blocks judged as main, in page order, joined by one space."""
    known: dict = {}
    pages = [parse(s or "", known) for s in sources]
    x, bounds = vectors(pages)
    main = judge(p, x, bounds) >= 0
    return [" ".join(t for t, ok in zip(page.texts, main[a:b]) if ok) for page, a, b in zip(pages, bounds[:-1], bounds[1:])]


def fit_labeller(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = GIVEN) -> dict[str, np.ndarray]:
    """Fit on the driver on made-up pages and at most ``most`` given ones of ``GIVEN_BYTES`` together."""
    limit = GIVEN_BYTES // max(most, 1) * 4
    short = pages.where(F.col(html_col).isNotNull() & (F.octet_length(html_col) <= limit)).select(F.xxhash64(F.col(id_col)).alias("k"), html_col)
    keys = F.broadcast(short.select("k").distinct().orderBy("k").limit(most))  # at most ``most`` numbers
    rows = short.join(keys, "k", "left_semi").orderBy("k", html_col).limit(most).collect()
    sources, total = [], 0
    for row in rows:
        total += len(row[1])
        if total <= GIVEN_BYTES:
            sources.append(row[1])
    random.Random(1).shuffle(sources)
    return fit(sources)


def extract_main_text(pages: DataFrame, model: dict[str, np.ndarray], columns: list[str], html_col: str = "html", out: str = "text") -> DataFrame:
    """``columns`` of every page and its main text, from the whole page.

    Null and empty pages, and pages without a block judged as main text, give an empty text.
    Character references are decoded, white space inside a block is one space.
    Repeated rows are read each; other columns are not read. Map-only.
    """
    kept = pages.select(*columns, F.col(html_col).alias("_html"))
    schema = T.StructType([*(f for f in kept.schema if f.name != "_html"), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_html"):
                texts = pa.array(main_texts(model, part.column("_html").to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), texts], names=[*columns, out])

    return shipped(kept).mapInArrow(run, schema)
