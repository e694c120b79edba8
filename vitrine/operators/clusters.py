"""Hosts that belong together: clusters of hosts that share fingerprint values.

The graph has two sides, hosts and values. A value links its hosts as a star, never as
pairs, and a value of very many hosts is parted into smaller stars by a salt, whose
centres are linked by one more star; so no join or group holds all hosts of a value.
"""
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.sources.tables import materialized

#: Parts into which the star of a value is split by a hash of the host.
SALTS = 64


def fingerprint_values(snapshots: DataFrame, columns: Iterable[str], host: str = "host", exclude: DataFrame | None = None) -> DataFrame:
    """``host, kind, value``: the distinct fingerprints of each host, one kind per column.

    Null and empty hosts and values take no part. ``exclude`` (``kind, value``) leaves out
    values that say nothing, such as the page that a server shows after its installation.
    """
    pairs = [F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns]
    rows = snapshots.select(F.col(host).alias("host"), F.explode(F.array(*pairs)).alias("_p")).select("host", "_p.*")
    rows = rows.where((F.coalesce("host", F.lit("")) != "") & (F.coalesce("value", F.lit("")) != "")).distinct()
    return rows if exclude is None else rows.join(exclude.select("kind", "value"), ["kind", "value"], "left_anti").select("host", "kind", "value")


def star_links(values: DataFrame, salts: int = SALTS) -> DataFrame:
    """``host, star``: memberships in stars that connect hosts exactly as values do.

    Every (kind, value, salt) is a star of its hosts; the smallest host of each is also
    a member of the value's upper star. Stars of one host link nothing and are dropped.
    """
    salt: Column = F.pmod(F.xxhash64("host"), F.lit(salts)).cast("string")
    name = F.concat(F.length("kind").cast("string"), F.lit(":"), "kind", "value")
    digest = lambda text: F.unhex(F.md5(text))
    lower = values.select("host", digest(F.concat(salt, F.lit(":"), name)).alias("star"), digest(name).alias("upper"))
    centres = lower.groupBy("star", "upper").agg(F.min("host").alias("host"), F.count(F.lit(1)).alias("n"))
    centres = materialized(centres)
    wide = centres.groupBy("upper").agg(F.count(F.lit(1)).alias("stars")).where("stars > 1").select("upper")
    upper = centres.join(wide, "upper").select("host", F.col("upper").alias("star"))
    linking = centres.where("n > 1").select("star")
    return lower.join(linking, "star").select("host", "star").unionByName(upper)


def _least_reached(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """``host, cluster``: the smallest host that each reaches over ``links``.

    Each round takes the smallest label within each star, offers it to the members and to
    the hosts whose label they have, and follows labels one step; rounds grow with the
    logarithm of the longest path. All steps but the last are combined minima; that one is
    a join by label, whose one hot side Spark splits at run time.
    """
    labels = materialized(hosts.select("host", F.col("host").alias("cluster")))
    while True:
        seen = links.join(labels, "host")
        least = seen.groupBy("star").agg(F.min("cluster").alias("least"))
        offered = links.join(least, "star").groupBy("host").agg(F.min("least").alias("least"))
        offers = labels.join(offered, "host")
        # a host's label is a host too: it hears of what those that have it are offered
        to_labels = offers.groupBy(F.col("cluster").alias("host")).agg(F.min("least").alias("least"))
        best = offered.unionByName(to_labels).groupBy("host").agg(F.min("least").alias("least"))
        moved = labels.join(best, "host").select("host", F.col("cluster").alias("old"), F.least("cluster", "least").alias("cluster"))
        moved = materialized(moved)
        ahead = moved.where("cluster <> host").select(F.col("host").alias("_h"), F.col("cluster").alias("_c"))
        followed = materialized(
            moved.join(ahead, F.col("cluster") == F.col("_h"), "left").select("host", "old", F.coalesce("_c", "cluster").alias("cluster"))
        )
        labels = followed.select("host", "cluster")
        if followed.where("cluster <> old").isEmpty():
            return labels


def host_clusters(values: DataFrame, salts: int = SALTS) -> DataFrame:
    """``host, cluster, n_hosts`` of every host in ``values`` (``host, kind, value``, distinct).

    ``cluster`` is the smallest host that shared values lead to; a host that shares nothing
    is a cluster of its own. An empty table has no clusters.
    """
    values = materialized(values.select("host", "kind", "value"))
    links = materialized(star_links(values, salts))
    linked = _least_reached(links, links.select("host").distinct())
    found = materialized(values.select("host").distinct().join(linked, "host", "left").select("host", F.coalesce("cluster", "host").alias("cluster")))
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_hosts"))
    return found.join(sizes, "cluster").select("host", "cluster", "n_hosts")


def cluster_profiles(clusters: DataFrame, values: DataFrame) -> DataFrame:
    """``cluster, kind, n_hosts, n_values, n_shared``: of each kind of fingerprint, the hosts of a cluster that
    have a value, their values, and those that several hosts have; only clusters of two hosts or more.

    The widest value of the kind (most hosts, then the smallest) is ``widest``, on ``widest_hosts`` hosts.
    """
    members = clusters.where("n_hosts > 1").select("host", "cluster")
    placed = values.join(members, "host")
    per_value = placed.groupBy("cluster", "kind", "value").agg(F.count(F.lit(1)).alias("hosts"))
    widest = F.min(F.struct((-F.col("hosts")).alias("minus"), "value")).alias("_w")
    shared = per_value.groupBy("cluster", "kind").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("hosts") > 1).alias("n_shared"), widest
    )
    # distinct hosts by two combined groupings; a plain distinct count would gather a cluster's hosts
    per_host = placed.groupBy("cluster", "kind", "host").agg(F.lit(1).alias("one"))
    hosts = per_host.groupBy("cluster", "kind").agg(F.count(F.lit(1)).alias("n_hosts"))
    return shared.join(hosts, ["cluster", "kind"]).select(
        "cluster", "kind", "n_hosts", "n_values", "n_shared",
        F.col("_w.value").alias("widest"), (-F.col("_w.minus")).alias("widest_hosts"),
    )
