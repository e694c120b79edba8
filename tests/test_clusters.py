"""Host clusters against a plain union of hosts."""
import random
from collections import Counter, defaultdict

from vitrine.operators.clusters import cluster_profiles, fingerprint_values, host_clusters, star_links


def _plain(rows):
    parent = {h: h for h, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for host, kind, value in rows:
        a, b = root(host), root(first.setdefault((kind, value), host))
        parent[max(a, b)] = min(a, b)
    clusters = {h: root(h) for h in parent}
    sizes = Counter(clusters.values())
    return {(h, c, sizes[c]) for h, c in clusters.items()}


def _rows(seed):
    r = random.Random(seed)
    hosts = [f"h{i:03}" for i in r.sample(range(1000), 240)]
    rows = [(h, "page", "everywhere") for h in hosts[:80]]
    rows += [(h, k, f"chain{i // 2 if k == 'page' else (i + 1) // 2}") for i, h in enumerate(hosts[80:140]) for k in ("page", "icon")]
    rows += [(r.choice(hosts[140:]), r.choice(["page", "icon", "tls"]), f"v{r.randrange(150)}") for _ in range(120)]
    rows += [(h, "tls", h) for h in hosts]
    return sorted(set(rows))


def test_clusters_are_those_of_the_plain_version(spark):
    for seed, salts in ((1, 1), (2, 5)):
        rows = _rows(seed)
        values = spark.createDataFrame(rows, "host string, kind string, value string").repartition(3)
        found = host_clusters(values, salts)
        assert {tuple(x) for x in found.collect()} == _plain(rows)
        by = defaultdict(list)
        where = {h: c for h, c, n in _plain(rows) if n > 1}
        for host, kind, value in rows:
            if host in where:
                by[(where[host], kind)].append((host, value))
        expected = set()
        for (cluster, kind), pairs in by.items():
            n = Counter(v for _, v in pairs)
            widest = min(n, key=lambda v: (-n[v], v))
            expected.add((cluster, kind, len({h for h, _ in pairs}), len(n), sum(c > 1 for c in n.values()), widest, n[widest]))
        assert {tuple(x) for x in cluster_profiles(found, values).collect()} == expected


def test_no_star_holds_all_hosts_of_a_common_value(spark):
    values = spark.range(4000).selectExpr("concat('h', id) AS host", "'page' AS kind", "'same' AS value")
    largest = star_links(values, 16).groupBy("star").count().agg({"count": "max"}).first()[0]
    assert largest < 4000 / 16 * 1.5


def test_empty_values_null_hosts_and_left_out_values(spark):
    snaps = spark.createDataFrame(
        [("a", "x", None), ("b", "x", ""), (None, "x", "y"), ("", "x", "y"), ("c", "default", "z"), ("d", "default", None), ("a", "x", None)],
        "host string, page string, icon string")
    values = fingerprint_values(snaps, ["page", "icon"], exclude=spark.createDataFrame([("page", "default")], "kind string, value string"))
    assert sorted(map(tuple, values.collect())) == [("a", "page", "x"), ("b", "page", "x"), ("c", "icon", "z")]
    assert sorted(map(tuple, host_clusters(values).collect())) == [("a", "a", 2), ("b", "a", 2), ("c", "c", 1)]
    assert host_clusters(values.limit(0)).count() == 0
