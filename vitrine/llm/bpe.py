"""Byte-level BPE: merges replayed over all words of a part of the corpus at once, and decoding.

Short words are arrays that take one merge each per round, the leftmost pair of the lowest
rank. Long ones share a replay: an inverted index leads from the rank of a token pair to the places where the pair
stands. Merges run in rank order over the index; each touches only the two pairs
beside it. Words are independent, so replaying them together gives what replaying
each alone gives. A worker keeps the words it has seen, up to a bound.
"""
from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vitrine.llm.shipping import shipped
from vitrine.llm.words import release, slices

#: Words a Python worker remembers, and their bytes, before it keeps those at hand only; no effect on results.
MOST_WORDS, MOST_BYTES = 250_000, 6_000_000
#: Words it keeps between tasks: the shortest, which are the commonest.
KEPT_WORDS = 30_000
#: Text bytes whose words are replayed together.
PART_BYTES = 1_000_000
SHIFT = 24
#: Bytes of the longest words that share rounds; no effect on results.
LONGEST = 48
#: The rank of a pair that is no token.
NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Ranks, the rank of each mergeable pair of ids, and the words seen so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {
            ranks[t[:i]] << SHIFT | ranks[t[i:]]: rank
            for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        }
        self.first = np.array([[self.pairs.get(a << SHIFT | b, -1) for b in self.byte] for a in self.byte], np.int64)
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], 2**62)
        self.pair_ranks = np.append(np.fromiter(self.pairs.values(), np.int32, len(keys))[order], NONE)
        self.tokens: dict[int, bytes] = {rank: t for t, rank in ranks.items()}
        self.seen: dict[str, bytes] = {}
        self.seen_bytes = 0

    def learn(self, words: Iterable[str]) -> None:
        """Put the ids of new words, as little-endian 32-bit integers, into ``seen``."""
        rest: tuple[list[str], list[str]] = ([], [])
        texts: tuple[list[bytes], list[bytes]] = ([], [])
        for word in words:
            data = word.encode()
            whole = self.ranks.get(data)
            if whole is None:
                long = len(data) > LONGEST
                rest[long].append(word)
                texts[long].append(data)
            else:
                self.seen[word] = whole.to_bytes(4, "little")
            self.seen_bytes += len(data)
        for long in (False, True):
            if rest[long]:
                ids, bounds = replay(texts[long], self.byte, self.pairs, self.first) if long else self.rounds(texts[long])
                raw = ids.astype("<u4").tobytes()
                for word, a, b in zip(rest[long], (bounds[:-1] * 4).tolist(), (bounds[1:] * 4).tolist()):
                    self.seen[word] = raw[a:b]

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids."""
        keys = a.astype(np.int64) << SHIFT | b
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of short words one after another, and where each word's begin; each round merges one pair of every word."""
        data = np.frombuffer(b"".join(words), np.uint8)
        part = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        sym = np.array(self.byte, np.int32)[data]
        rank = np.full(len(sym), NONE)
        inner = np.flatnonzero(part[1:] == part[:-1])
        ranks = self.first[data[inner], data[inner + 1]]
        rank[inner] = np.where(ranks >= 0, ranks, NONE)
        done = [(part[:0], sym[:0])]
        while len(sym):
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            sizes = np.diff(starts, append=len(sym))
            best = np.minimum.reduceat(rank, starts)
            if (best == NONE).any():  # nothing is left to merge in these words
                open_ = np.repeat(best != NONE, sizes)
                done.append((part[~open_], sym[~open_]))
                part, sym, rank = part[open_], sym[open_], rank[open_]
                sizes, best = sizes[best != NONE], best[best != NONE]
            spots = np.flatnonzero(rank == np.repeat(best, sizes))
            spots = spots[np.diff(part[spots], prepend=-1) != 0]  # the leftmost of each word
            sym[spots] = rank[spots]
            keep = np.ones(len(sym), bool)
            keep[spots + 1] = False
            part, sym, rank = part[keep], sym[keep], rank[keep]
            spots = spots - np.arange(len(spots))
            rank[spots] = NONE  # unless the pair with the next id has a rank
            for at in (spots[spots > 0] - 1, spots[spots < len(sym) - 1]):
                at = at[part[at] == part[at + 1]]
                rank[at] = self._ranked(sym[at], sym[at + 1])
        part, sym = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(part, kind="stable")
        return sym[order], np.searchsorted(part[order], np.arange(len(words) + 1))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        split = [self.pattern.findall(text) if text else [] for text in texts]
        words = set().union(*split)
        new = words - self.seen.keys()
        if len(self.seen) + len(new) > MOST_WORDS or self.seen_bytes > MOST_BYTES:
            self.keep(words - new)
        if new:
            self.learn(new)
        return [b"".join(map(self.seen.__getitem__, words)) for words in split]

    def keep(self, words: set[str]) -> None:
        self.seen = {word: self.seen[word] for word in words}
        self.seen_bytes = sum(map(len, words))

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def replay(words: list[bytes], byte: list[int], pairs: dict[int, int], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All merges over all words, of any length; the ids one after another, and where each word's begin.

    ``byte`` has the id of each byte, ``first`` the rank of each pair of bytes, -1 for none.

    A merged pair can complete a token of a lower rank than its own; such a pair is
    merged at once, before the next place of the rank at hand, as it would be in its word.
    """
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    # One place of -1 behind each word, and one before the first.
    at = np.arange(len(data)) + np.repeat(np.arange(1, len(words) + 1), np.diff(ends, prepend=0))
    table = np.asarray(byte, np.int64)
    flat = np.full(len(data) + len(words) + 1, -1, np.int64)
    flat[at] = table[data]
    inner = np.flatnonzero(np.diff(at) == 1)
    ranks = first[data[inner], data[inner + 1]]
    places = at[inner][ranks >= 0]
    ranks = ranks[ranks >= 0]
    order = np.argsort(ranks, kind="stable")
    cuts = np.flatnonzero(np.diff(ranks[order], prepend=-1))
    index = {int(ranks[order[a]]): places[order[a:b]].tolist() for a, b in zip(cuts, [*cuts[1:], len(order)])}
    sym, nxt, prv = flat.tolist(), list(range(1, len(flat) + 1)), list(range(-1, len(flat) - 1))
    get = pairs.get
    todo = list(index)
    heapify(todo)
    while todo:
        rank = heappop(todo)
        spots = index.pop(rank)
        spots.sort()
        urgent: list[tuple[int, int]] = []
        for spot in spots:
            now, p = rank, spot
            while True:
                n = nxt[p]
                a, b = sym[p], sym[n]
                if a >= 0 and b >= 0 and get(a << SHIFT | b) == now:
                    sym[p], sym[n] = now, -2
                    m, before = nxt[n], prv[p]
                    nxt[p], prv[m] = m, p
                    for q, c, d in ((before, sym[before], now), (p, now, sym[m])):
                        if c >= 0 and d >= 0:
                            k = get(c << SHIFT | d)
                            if k is None:
                                continue
                            if k < rank:
                                heappush(urgent, (k, q))
                            elif k in index:
                                index[k].append(q)
                            else:
                                index[k] = [q]
                                heappush(todo, k)
                if not urgent:
                    break
                now, p = heappop(urgent)
    out = np.asarray(sym, np.int64)
    stops = np.cumsum(out >= 0)[out == -1]
    return out[out >= 0], stops


_held: dict[int, Vocabulary] = {}


def _vocabulary(shared, pattern: str) -> Vocabulary:
    """One vocabulary per worker and broadcast, kept over tasks."""
    if shared.value[0] not in _held:
        _held.clear()
        _held[shared.value[0]] = Vocabulary(shared.value[1], pattern)
    return _held[shared.value[0]]


def share_ranks(df: DataFrame, path: str):
    """Broadcast a rank file; its size is that of a vocabulary, whatever the corpus."""
    ranks = load_ranks(path)
    return df.sparkSession.sparkContext.broadcast((hash(frozenset(ranks.items())), ranks))


def bpe_encode(
    docs: DataFrame, path: str, pattern: str, columns: list[str], text_col: str = "text", ids: str = "ids", packed: bool = False,
    decoded: str | None = None,
) -> DataFrame:
    """``columns`` of every row and the token ids of its whole text.

    ``decoded`` names a further column: the bytes that the ids decode to, made in the
    same pass, so that one Python worker per core holds a vocabulary.

    Ids are an array of integers, or, ``packed``, binary of little-endian unsigned
    32-bit integers. Special tokens are ordinary text. Null and empty texts have no
    ids. Repeated rows are encoded each; other columns are not read.
    """
    shared = share_ranks(docs, path)
    kept = docs.select(*columns, docs[text_col].alias("_text"))
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    schema = T.StructType([*(f for f in kept.schema if f.name != "_text"), T.StructField(ids, kind), *([T.StructField(decoded, T.BinaryType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared, pattern)
        for batch in batches:
            for part in slices(batch, "_text", PART_BYTES):
                found = vocabulary.encode(part.column("_text").to_pylist())
                if packed:
                    values = pa.array(found, pa.binary())
                else:
                    bounds = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
                    values = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)))
                back = [pa.array([vocabulary.decode(x) for x in found], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), values, *back], names=schema.names)
        # between tasks a worker keeps the common words only, so that other stages have its memory
        vocabulary.keep(set(sorted(vocabulary.seen, key=len)[:KEPT_WORDS]))
        release()

    return shipped(kept).mapInArrow(run, schema)


def bpe_decode(rows: DataFrame, path: str, pattern: str, columns: list[str], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``columns`` of every row and the bytes of its packed ids; null ids give no bytes."""
    shared = share_ranks(rows, path)
    kept = rows.select(*dict.fromkeys([*columns, ids]))
    schema = T.StructType([*(kept.schema[c] for c in columns), T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared, pattern)
        for batch in batches:
            for part in slices(batch, ids, PART_BYTES):
                values = pa.array([vocabulary.decode(x) for x in part.column(ids).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), values], names=[*columns, out])

    return shipped(kept).mapInArrow(run, schema)
