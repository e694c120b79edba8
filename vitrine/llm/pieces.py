"""SentencePiece models of the merge type: an agenda of adjacent symbol pairs in the order of their scores.

A text is escaped, then parted before every run of word marks that follows another
symbol; no piece of a vocabulary that passes ``load_pieces`` reaches over such a place,
so parts are independent. Within a part every pair of neighbouring symbols that is a
piece stands in the agenda; the best score is merged first, the leftmost place among
equals, and each merge touches only the two pairs beside it. The agendas of all new
short parts of a slice are arrays that take one merge each per round; a long part has a
heap of its own. Symbols that are no piece become byte pieces. Every part is compared with
the public library when it is encoded, and every text that is decoded.
"""
from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from vitrine.llm.shipping import shipped
from vitrine.llm.words import release, slices

#: The mark that stands for a space, and for the start of a text.
MARK = "▁"
_PARTS = re.compile(f"{MARK}+[^{MARK}]*")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: How the library writes the id of an unknown symbol.
UNKNOWN = " ⁇ "
#: Parts a Python worker remembers, and the longest that share a round; no effect on results.
MOST_PARTS, LONGEST = 300_000, 48
#: Text bytes encoded together.
PART_BYTES = 2_000_000
#: The rank of a pair that is no piece.
NONE = np.int32(2**31 - 1)


def _one_byte(error: UnicodeError) -> tuple[str, int]:
    """Each byte that is no part of a character is a replacement character of its own."""
    return "�", error.start + 1


codecs.register_error("vitrine-one-byte", _one_byte)


class Pieces:
    """Scores and ids of a vocabulary, and the parts seen so far."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        byte = [self.library.is_byte(i) for i in range(n)]
        control = [self.library.is_control(i) for i in range(n)]
        self.unknown = self.library.unk_id()
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes = [self.unknown] * 256
        self.written: list[bytes] = []
        for i, name in enumerate(names):
            if byte[i]:
                value = int(_BYTE_PIECE.fullmatch(name)[1], 16)
                self.bytes[value] = i
                self.written.append(bytes([value]))
            elif control[i] or i == self.unknown:
                self.written.append(b"" if control[i] else UNKNOWN.encode())
            else:
                self.rank[name], self.ids[name] = -self.library.get_score(i), i
                self.written.append(name.replace(MARK, " ").encode())
        self.marked = [not byte[i] and not control[i] and name.startswith(MARK) for i, name in enumerate(names)]
        self.control = control
        self.fallback = any(byte)
        self.seen: dict[str, bytes] = {}
        #: Parts that the library encodes otherwise.
        self.apart: set[str] = set()
        self._tables()

    def _tables(self) -> None:
        """Ids of characters, and of each pair of pieces that makes a piece, with its place in the order of scores."""
        self.character = -np.arange(1, 0x110001, dtype=np.int32)  # what is no piece keeps its code point
        for name, i in self.ids.items():
            if len(name) == 1:
                self.character[ord(name)] = i
        order = {score: k for k, score in enumerate(sorted(set(self.rank.values())))}
        pairs = sorted(
            (self.ids[name[:k]] << 32 | self.ids[name[k:]], order[self.rank[name]], i)
            for name, i in self.ids.items() for k in range(1, len(name)) if name[:k] in self.ids and name[k:] in self.ids
        )
        keys, ranks, made = zip(*pairs) if pairs else ((), (), ())
        self.pair_keys = np.array([*keys, 2**62], np.int64)
        self.pair_ranks = np.array([*ranks, NONE], np.int32)
        self.pair_made = np.array([*made, -1], np.int32)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the pieces that pairs of symbols make."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        keys[(a < 0) | (b < 0)] = -1
        at = np.searchsorted(self.pair_keys, keys)
        hit = self.pair_keys[at] == keys
        return np.where(hit, self.pair_ranks[at], NONE), self.pair_made[at]

    def learn(self, parts: list[str]) -> None:
        """Put the ids of new short parts into ``seen``; each round takes the best pair of every agenda."""
        points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(p) for p in parts])
        sym, part = self.character[points], np.repeat(np.arange(len(parts)), sizes)
        rank, made = np.full(len(sym), NONE), np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(part[1:] == part[:-1])
        rank[inner], made[inner] = self._pairs(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            sizes = np.diff(starts, append=len(sym))
            best = np.minimum.reduceat(rank, starts)
            if (best == NONE).any():  # their agendas are empty
                open_ = np.repeat(best != NONE, sizes)
                done.append((part[~open_], sym[~open_]))
                part, sym, rank, made = part[open_], sym[open_], rank[open_], made[open_]
                sizes, best = sizes[best != NONE], best[best != NONE]
            spots = np.flatnonzero(rank == np.repeat(best, sizes))
            spots = spots[np.diff(part[spots], prepend=-1) != 0]  # the leftmost of each part
            sym[spots] = made[spots]
            keep = np.ones(len(sym), bool)
            keep[spots + 1] = False
            part, sym, rank, made = part[keep], sym[keep], rank[keep], made[keep]
            spots = spots - np.arange(len(spots))
            for at in (spots[spots > 0] - 1, spots[spots < len(sym) - 1]):
                at = at[part[at] == part[at + 1]]
                rank[at], made[at] = self._pairs(sym[at], sym[at + 1])
            last = spots[(spots == len(sym) - 1) | (part[np.minimum(spots + 1, len(sym) - 1)] != part[spots])]
            rank[last] = NONE
        order = np.argsort(np.concatenate([p for p, _ in done]), kind="stable")
        part, sym = (np.concatenate(x)[order] for x in zip(*done))
        raw = sym.astype("<i4").tobytes()
        bounds = np.searchsorted(part, np.arange(len(parts) + 1)) * 4
        odd = set(part[sym < 0].tolist())
        for i, (p, a, b) in enumerate(zip(parts, bounds[:-1].tolist(), bounds[1:].tolist())):
            self.seen[p] = self._spelt(sym[a // 4:b // 4].tolist()) if i in odd else raw[a:b]

    def _spelt(self, symbols: list[int]) -> bytes:
        """Ids of symbols, with those of their bytes for code points that are no piece."""
        out: list[int] = []
        for s in symbols:
            if s >= 0:
                out.append(s)
            elif self.fallback:
                out.extend(self.bytes[b] for b in chr(-s - 1).encode())
            else:
                out.append(self.unknown)
        return np.array(out, "<i4").tobytes()

    def merged(self, part: str) -> bytes:
        """The ids of one part, by a heap for its agenda."""
        rank = self.rank
        sym: list[str | None] = list(part)
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = part[i:i + 2]
            if pair in rank:
                agenda.append((rank[pair], i, pair, i + 1))
        heapify(agenda)
        while agenda:
            _, left, pair, right = heappop(agenda)
            a, b = sym[left], sym[right]
            if a is None or b is None or len(a) + len(b) != len(pair) or nxt[left] != right:
                continue  # one side has been merged since
            sym[left], sym[right] = pair, None
            after = nxt[left] = nxt[right]
            if after < n:
                prv[after] = left
                new = pair + sym[after]
                if new in rank:
                    heappush(agenda, (rank[new], left, new, after))
            before = prv[left]
            if before >= 0:
                new = sym[before] + pair
                if new in rank:
                    heappush(agenda, (rank[new], before, new, left))
        return self._spelt([self.ids.get(s, -ord(s[0]) - 1) for s in sym if s is not None])

    def compare(self, encoded: dict[str, bytes]) -> None:
        """Put parts for which the library has other ids into ``apart``.

        The library sets a mark before a text, so a part goes without its first one. A mark
        alone would be an empty text, which has no ids: it is asked for behind another part.
        """
        parts = [p for p in encoded if p != MARK]
        theirs = self.library.encode([p[1:].replace(MARK, " ") for p in parts], num_threads=1) if parts else []
        ours = np.frombuffer(b"".join(map(encoded.__getitem__, parts)), "<i4").tolist()
        at = 0
        for part, ids in zip(parts, theirs):
            size = len(encoded[part]) // 4
            if ids != ours[at:at + size]:
                self.apart.add(part)
            at += size
        if MARK in encoded:
            alone, behind = self.library.encode("a"), self.library.encode("a ")
            if alone + np.frombuffer(encoded[MARK], "<i4").tolist() != behind:
                self.apart.add(MARK)

    def encode(self, texts: list[str | None], compared: bool = False) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; null counts as empty.

        ``compared``: new parts are compared with the library's ids. All calls of a run are alike in this.
        """
        return self.encode_parts(texts, compared)[0]

    def encode_parts(self, texts: list[str | None], compared: bool) -> tuple[list[bytes], list[bool]]:
        """``encode``, and whether the library has the same ids for all parts of each text (true if not compared)."""
        split = [_PARTS.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        parts = set().union(*split)
        if len(self.seen) > MOST_PARTS:
            self.seen = {p: self.seen[p] for p in parts & self.seen.keys()}
        new = parts - self.seen.keys()
        long = [p for p in new if len(p) > LONGEST]
        if len(long) < len(new):
            short = [p for p in new if len(p) <= LONGEST]
            self.learn(short)
            if compared:
                self.compare({p: self.seen[p] for p in short})
        seen = self.seen
        if long:
            alone = {p: self.merged(p) for p in long}
            if compared:
                self.compare(alone)
            seen = seen | alone
        same = [self.apart.isdisjoint(p) for p in split] if self.apart else [True] * len(split)
        return [b"".join(map(seen.__getitem__, p)) for p in split], same

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: marks are spaces, the one at the start goes, broken bytes are replaced."""
        ids = list(ids)
        raw = b"".join(map(self.written.__getitem__, ids))
        first = next((i for i in ids if not self.control[i]), None)
        if first is not None and self.marked[first]:
            raw = raw[1:]
        return raw.decode("utf-8", "vitrine-one-byte")


def load_pieces(path: str) -> bytes:
    """A model file, if it is of the merge type and this agenda gives what the library gives.

    Other normalisers, suffix marks, user-defined symbols, unused pieces, and pieces with a mark
    behind another symbol or with a character that is no piece itself, are refused with an error, not encoded differently.
    """
    with open(path, "rb") as file:
        raw = file.read()
    model = model_pb2.ModelProto()
    model.ParseFromString(raw)
    norm, trainer, kinds = model.normalizer_spec, model.trainer_spec, model_pb2.ModelProto.SentencePiece
    usual = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
    if trainer.model_type != model_pb2.TrainerSpec.BPE or not usual or trainer.treat_whitespace_as_suffix:
        raise ValueError("only merge-type models with identity normalisation and a leading mark are supported")
    characters = {piece.piece for piece in model.pieces if piece.type == kinds.NORMAL and len(piece.piece) == 1}
    for piece in model.pieces:
        if piece.type in (kinds.USER_DEFINED, kinds.UNUSED) or piece.type == kinds.NORMAL and (
            MARK in piece.piece.lstrip(MARK) or not characters.issuperset(piece.piece)
        ):
            raise ValueError(f"piece not supported: {piece.piece!r}")
    return raw


#: By model, and whether parts are compared.
_held: dict[str, Pieces] = {}


def _pieces(shared, compared: bool = False) -> Pieces:
    """One vocabulary per worker and model, kept over tasks; parts that were not compared are not met by those that are."""
    key = f"{hashlib.sha256(shared.value).hexdigest()} {compared}"
    if key not in _held:
        _held.clear()
        _held[key] = Pieces(shared.value)
    return _held[key]


def _lists(found: list[bytes]) -> pa.Array:
    bounds = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(found), "<i4")))


def piece_encode(
    docs: DataFrame, path: str, columns: list[str], text_col: str = "text", ids: str = "ids", decoded: str | None = None,
    agrees: str | None = "agrees",
) -> DataFrame:
    """``columns`` of every row, the ids of its whole text, and whether the library gives the same for each part of it.

    ``decoded`` names a further column with the text that the ids decode to; ``agrees``
    then covers decoding too, and None leaves the comparison out. Neither begin nor end
    ids are added. Null and empty texts have no ids and agree; repeated rows are encoded
    each; an empty table gives an empty table; other columns are not read and may have
    any name. Map-only: memory is that of one slice of texts and of the parts remembered,
    and of one text where that alone is longer.
    """
    made = [ids, *(x for x in (decoded, agrees) if x)]
    if clash := set(made) & set(columns):
        raise ValueError(f"columns to keep have the names of results: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path))
    text = next(f"_text{i}" for i in range(len(columns) + 1) if f"_text{i}" not in columns)
    kept = docs.select(*columns, docs[text_col].cast("string").alias(text))
    schema = T.StructType([*(f for f in kept.schema if f.name != text), T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = schema.add(decoded, T.StringType())
    if agrees:
        schema = schema.add(agrees, T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared, bool(agrees))
        for batch in batches:
            for part in slices(batch, text, PART_BYTES):
                texts = [x or "" for x in part.column(text).to_pylist()]
                found, same = pieces.encode_parts(texts, bool(agrees))
                more: list[pa.Array] = []
                lists = [np.frombuffer(x, "<i4").tolist() for x in found] if decoded else []
                back = [pieces.decode(x) for x in lists]
                if decoded:
                    more.append(pa.array(back, pa.string()))
                if agrees:
                    if decoded:
                        same = [a and x == y for a, x, y in zip(same, pieces.library.decode(lists, num_threads=1), back)]
                    more.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), _lists(found), *more], names=schema.names)
        release()

    return shipped(kept).mapInArrow(run, schema)


def piece_decode(rows: DataFrame, path: str, columns: list[str], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``columns`` of every row and the text of its ids, as the library's ``decode``; null ids give an empty text."""
    if out in columns:
        raise ValueError(f"columns to keep have the name of the result: {out}")
    shared = rows.sparkSession.sparkContext.broadcast(load_pieces(path))
    kept = rows.select(*dict.fromkeys([*columns, ids]))
    schema = T.StructType([*(kept.schema[c] for c in columns), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared)
        for batch in batches:
            texts = pa.array([pieces.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), texts], names=schema.names)

    return shipped(kept).mapInArrow(run, schema)
