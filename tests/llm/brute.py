"""Plain versions of the operators, for small inputs."""
from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lowered(text: str | None) -> list[str]:
    return words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def substring(rows: list[tuple], k: int) -> dict:
    docs = {i: words(t) for i, t in rows if i is not None}
    first: dict = {}
    for i in sorted(docs):
        for j in range(len(docs[i]) - k + 1):
            first.setdefault(tuple(docs[i][j:j + k]), i)
    out = {}
    for i, w in docs.items():
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j:j + k])] < i:
                gone[j:j + k] = [True] * k
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def near(rows: list[tuple], width: int, percent: int) -> dict:
    sets = {}
    for i, t in rows:
        w = lowered(t)
        sets[i] = {tuple(w[j:j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}
