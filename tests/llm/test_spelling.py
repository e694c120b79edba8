"""Near words and forms against a plain version."""
import random
import re
import zlib
from collections import Counter, defaultdict

from vitrine.llm.spelling import spelling_forms, word_counts


def _plain(rows, every, shortest=6, least=5, ratio=5):
    counts = Counter()
    for i, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m.group().lower(), word)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if every and h % every == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    n = {w: c for w, c in counts.items() if len(w) >= shortest and c >= least}
    near = defaultdict(set)
    for a in n:
        for b in n:
            if len(a) == len(b):
                close = sum(x != y for x, y in zip(a, b)) == 1
            else:
                s, t = sorted((a, b), key=len)
                close = len(t) == len(s) + 1 and any(t[:k] + t[k + 1:] == s for k in range(len(t)))
            if close:
                near[a].add(b)
    best = {w: min(s, key=lambda x: (-n[x], x)) for w, s in near.items()}
    form = {w: b for w, b in best.items() if n[b] >= ratio * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def test_forms_are_those_of_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr("vitrine.llm.spelling.MOST_WORDS", 50)  # counts leave the task several times
    r = random.Random(3)
    stems = ["aaaaaa", "aaaaaaa", "Aaaaaab", "banana", "bananna", "ananas", "ÿÀéßüö", "ÿÀéßüöÿ", "strasse", "strassen", "gstrasse", "gstrassen"]
    stems += ["".join(r.choice("ab") for _ in range(r.randint(5, 8))) for _ in range(60)]
    rows = [(i, " ".join(r.choices(stems, [3 ** (k % 7) for k in range(len(stems))], k=60))) for i in range(150)]
    rows += [(None, "banana banana"), (1, None), (2, ""), (3, "banana " * 40), (3, "banana " * 40), (4, "x1y banana2bananaĀbanana")]
    rows += [(900 + i, "y" * 5000 + " " + "y" * 4999 + "z") for i in range(6)]
    rows += [(950, "kettle " * 5 + "kettles " * 30 + "kettless " * 200)]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string").repartition(4)
    for every in (7, None):
        found = [tuple(x) for x in spelling_forms(docs, every=every).collect()]
        assert len(found) == len(set(found)) and set(found) == _plain(rows, every)
    assert any(x[1] != x[2] for x in found if x[1])  # a form that has a form itself


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, "12 ... 日本")], "doc_id long, text string")
    assert word_counts(docs).count() == 0 and spelling_forms(docs).count() == 0
    assert spelling_forms(docs.limit(0)).count() == 0
