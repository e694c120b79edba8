"""Byte-level BPE against the public library, and back."""
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from vitrine.llm.bpe import Vocabulary, bpe_decode, bpe_encode, load_ranks, replay

PATTERN = public_tokenizers.PATTERN


def _texts(n):
    r = random.Random(4)
    parts = ["a", "aa", "the", "ing", " ", "  ", "\n", "é", "日本", "😀", "0", "9", "'s", "'", "-", "\x1c", "\xa0", "tion", "<|endoftext|>", "ll", "\r\n"]
    made = ["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(n)]
    made += ["".join(chr(r.choice([r.randrange(32, 300), r.randrange(0x400, 0x3000)])) for _ in range(40)) for _ in range(n // 4)]
    return made + ["", "a" * 60_001, "ab" * 20_000, " " * 5000 + "x", "the" * 9000, "\n" * 3000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_are_those_of_the_library(name, monkeypatch):
    ranks = load_ranks(public_tokenizers.path(name))
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    ours = Vocabulary(ranks, PATTERN)
    monkeypatch.setattr("vitrine.llm.bpe.MOST_WORDS", 3000)  # it forgets words on the way
    texts = _texts(2500)
    for i in range(0, len(texts), 400):
        for text, ids in zip(texts[i:i + 400], ours.encode(texts[i:i + 400])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text[:80]
            assert ours.decode(ids) == text.encode()


def test_operators_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = list(enumerate([*_texts(50), None, "same", "same"]))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id int, text string, ids string")
    coded = bpe_encode(docs, path, PATTERN, ["doc_id"], packed=True, decoded="back")
    apart = bpe_decode(coded.select("doc_id", "ids"), path, PATTERN, ["doc_id"])
    back = {r["doc_id"]: bytes(r["decoded"]) for r in apart.collect()}
    assert back == {i: (t or "").encode() for i, t in rows} == {r["doc_id"]: bytes(r["back"]) for r in coded.collect()}
    lists = {r["doc_id"]: r["ids"] for r in bpe_encode(docs, path, PATTERN, ["doc_id"]).collect()}
    assert lists == {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in coded.collect()}
    assert bpe_encode(docs.limit(0), path, PATTERN, ["doc_id"]).count() == 0


def test_rounds_of_short_words_give_what_a_replay_gives():
    r = random.Random(8)
    ours = Vocabulary(load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), PATTERN)
    words = ["".join(r.choice("the house of sand é𝄞0 ") for _ in range(r.randint(0, 12))).encode() for _ in range(3000)]
    words += [bytes(r.randrange(256) for _ in range(r.randint(0, 48))) for _ in range(500)] + [b"a" * 48, b""]
    for part in (words, words[:1], [b""], [b"x"]):
        ids, bounds = ours.rounds(part)
        plain, ends = replay(part, ours.byte, ours.pairs, ours.first)
        assert ids.tolist() == plain.tolist() and bounds.tolist() == ends.tolist()
