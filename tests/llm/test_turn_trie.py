"""The trie of rebuilt conversations against a plain version."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from vitrine.llm.turn_trie import Messages, turn_trie


def _plain(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            talks[c].append((turn is not None, turn or 0, role, tie, text))
    talks = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in talks.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(talks):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = tuple(talks.get(base, [])[:h] + talks[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    return {
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
        for node, m in members.items()
    }


def _talks(seed):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-120, 420), 160):
        alike = r.random() < 0.4
        for turn in range(r.randint(1, 9)):
            text = f"same {turn}" if alike or turn < 3 else r.choice(["a", "b", "", None, "日本"])
            rows.append((c, r.choice([turn, turn, None]), r.choice(["user", None]) if not alike else "user", text))
    rows += [(500, t, "user", f"same {t}" if t < 40 else f"own {t}") for t in range(150)]
    rows += [(540, t, "user", f"same {t}") for t in range(90)]
    rows += [(None, 1, "user", "nobody"), rows[0], rows[0]]
    r.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("limits", [(200_000, 256), (30, 4), (3, 2)])
def test_trie_is_that_of_the_plain_version(spark, limits, monkeypatch):
    monkeypatch.setattr("vitrine.llm.turn_trie.CHUNK", 3)
    rows = _talks(limits[0])
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "turn AS depth", "'x' AS x1", "role AS size")
    found = turn_trie(table.repartition(5), shard_turns=limits[0], band=limits[1]).collect()
    assert len(found) == len({tuple(x) for x in found})
    assert {tuple(x) for x in found} == _plain(rows)


def test_an_empty_table_has_no_nodes(spark):
    assert turn_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_queue_that_spills_gives_the_same_sums():
    r = random.Random(1)
    small, large = Messages(most=8), Messages()
    nodes = sorted({(d, (r.randint(-3, 3), r.randint(-9, 9))) for d in range(6) for _ in range(40)}, key=lambda x: (-x[0], x[1]))
    for depth, key in nodes:
        assert small.take(depth, key) == large.take(depth, key)
        for _ in range(r.randint(0, 3)):
            parent = r.choice([n for n in nodes if n[0] == depth - 1] or [(depth - 1, (0, 0))])
            n = r.randint(0, 2**40)
            small.push(depth - 1, parent[1], 1, n, n)
            large.push(depth - 1, parent[1], 1, n, n)
    assert small.spills > 5 and not large.spills
