"""Pieces of a merge-type model against the public library, and back."""
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from vitrine.llm.pieces import Pieces, load_pieces, piece_decode, piece_encode

PATH = public_tokenizers.path("piece_bpe_32k.model")


def _texts(n):
    r = random.Random(4)
    parts = ["a", "aa", "the", "ing", " ", "  ", "\n", "é", "日本", "😀", "0", "9", "'s", "-", "\x1c", "\xa0", "tion", "<s>", "<0x0A>", "\r\n", "▁", "\0", "    "]
    made = ["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(n)]
    made += ["".join(chr(r.choice([r.randrange(32, 300), r.randrange(0x400, 0x3000)])) for _ in range(40)) for _ in range(n // 4)]
    return made + ["", " ", "a" * 30_001, "ab" * 20_000, " " * 5000 + "x", "the" * 9000, "\n" * 3000]


def test_ids_and_texts_are_those_of_the_library(monkeypatch):
    library, ours = sentencepiece.SentencePieceProcessor(model_file=PATH), Pieces(load_pieces(PATH))
    monkeypatch.setattr("vitrine.llm.pieces.MOST_PARTS", 3000)  # it forgets parts on the way
    texts = _texts(2500)
    for i in range(0, len(texts), 400):
        for text, raw in zip(texts[i:i + 400], ours.encode(texts[i:i + 400])):
            ids = np.frombuffer(raw, "<i4").tolist()
            assert ids == library.encode(text), text[:80]
            assert ours.decode(ids) == library.decode(ids)
            if len(text) < 3000:  # the heap of a long part gives the same
                assert ids == [x for p in text and [ours.merged("▁" + text.replace(" ", "▁"))] or [] for x in np.frombuffer(p, "<i4").tolist()]
    r = random.Random(5)
    for _ in range(3000):
        ids = [r.choice([r.randrange(300), r.randrange(32_000)]) for _ in range(r.randrange(12))]
        assert ours.decode(ids) == library.decode(ids), ids


def test_operators_round_trip(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = list(enumerate([*_texts(60), None, "same", "same"]))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id int, text string, ids string, _text0 string")
    coded = piece_encode(docs, PATH, ["doc_id", "_text0"], decoded="decoded").collect()
    assert {r["doc_id"]: r["ids"] for r in coded} == {i: library.encode(t or "") for i, t in rows}
    assert all(r["agrees"] for r in coded) and {r["decoded"] for r in coded if rows[r["doc_id"]][1] is None} == {""}
    apart = piece_decode(piece_encode(docs, PATH, ["doc_id"], agrees=None), PATH, ["doc_id"]).collect()
    assert {r["doc_id"]: r["decoded"] for r in apart} == {r["doc_id"]: r["decoded"] for r in coded}
    assert piece_encode(docs.limit(0), PATH, ["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="names of results"):
        piece_encode(docs, PATH, ["ids"])


def test_each_part_is_compared_with_the_library():
    ours = Pieces(load_pieces(PATH))
    texts = ["the  house ", " ", "a", None, "𝄞é\n▁x", "y" * 200 + " z"]
    found, same = ours.encode_parts(texts, True)
    assert all(same) and not ours.apart and found == Pieces(load_pieces(PATH)).encode(texts)
    wrong = Pieces(load_pieces(PATH))
    learn = wrong.learn

    def badly(parts):
        learn(parts)
        wrong.seen.update({p: wrong.seen[p] + b"\1\0\0\0" for p in parts if p in ("▁house", "▁")})

    wrong.learn = badly
    assert wrong.encode_parts(["the house", "the", "a ", "house"], True)[1] == [False, True, False, False]
    assert wrong.encode_parts(["the house"], True)[1] == [False]  # a part remembered as such
