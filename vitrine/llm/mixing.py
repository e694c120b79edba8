"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time 0..1: straight lines between
given points. Its integral is the source's weight in the mix. The demand of a
source grows with the integral of its schedule; a document whose words begin at
the share u of the source's demand gets the time at which the integrated
schedule reaches u, and documents are sorted by these positions.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hash ranges per source: running totals are taken over ranges, then within each.
RANGES = 4096
#: (time, rate relative to the source's weight); mean 1 over time, so weights hold.
FLAT = ((0.0, 1.0), (1.0, 1.0))
RISING = ((0.0, 0.5), (1.0, 1.5))
FALLING = ((0.0, 1.5), (1.0, 0.5))


def word_count(text: Column) -> Column:
    """Runs of bytes other than the six ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def reached_at(share: Column, points: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the integral of a schedule reaches ``share`` of its whole."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:])]
    whole, before, out = sum(area), 0.0, F.lit(points[-1][0])
    pieces = []
    for (t0, r0), (t1, r1), part in zip(points, points[1:], area):
        rest, slope = share * whole - before, (r1 - r0) / (t1 - t0)
        # r0*x + slope*x*x/2 = rest, in the form that stays exact for a flat piece
        root = F.sqrt(F.greatest(F.lit(r0 * r0) + 2 * slope * rest, F.lit(0.0)))
        x = F.when(rest <= 0, 0.0).otherwise(2 * rest / F.greatest(r0 + root, F.lit(1e-12)))
        before += part
        pieces.append((share * whole <= before, t0 + F.least(x, F.lit(t1 - t0))))
    for covered, at in reversed(pieces):
        out = F.when(covered, at).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: tuple[float, ...], total_share: float, most_passes: float) -> DataFrame:
    """Targets by weight, limited to ``most_passes`` times a source, the excess shared anew until none is above.

    ``sizes``: source, source_size; one row per source. Sources stand in code point
    order, null last, and take ``weights`` in turn. Limits that bind are those of the
    lowest limit per weight, so sorting by it and summing up gives the fixed point at once.
    """
    every = W.partitionBy(F.lit(0))
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_limit = W.partitionBy(F.lit(0)).orderBy("_per_weight", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    limited = (
        sizes.withColumn("weight", weight)
        .withColumn("_limit", most_passes * F.col("source_size").cast("double"))
        .withColumn("_per_weight", F.col("_limit") / F.col("weight"))
        .withColumn("_want", total_share * F.sum("source_size").over(every).cast("double"))
        .withColumn("_before", F.coalesce(F.sum("_limit").over(by_limit.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(by_limit.rowsBetween(W.currentRow, W.unboundedFollowing)))
        # the level if all sources before this one are limited and the rest is open
        .withColumn("_level", (F.col("_want") - F.col("_before")) / F.col("_open"))
    )
    level = F.max(F.when(F.col("_per_weight") >= F.col("_level"), F.col("_level"))).over(every)
    return limited.withColumn("_at", level).select(
        "source", "source_size", "weight",
        F.when(F.col("_at").isNull(), F.col("_limit")).otherwise(F.least("_limit", F.col("_at") * F.col("weight"))).alias("target"),
    )


def curriculum(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0), total_share: float = 1.5, most_passes: float = 2.0,
    schedules: tuple = (FALLING, FLAT, RISING), ranges: int = RANGES, seed: int = 17, keep: tuple[str, ...] = (),
    ordered: bool = True,
) -> DataFrame:
    """Per document: size, source_size, target, copies, taken, positions; range-sorted by first position.

    The mix takes whole documents: in each pass over its source a document is taken
    if the middle of its words lies before the target, so a source misses its target
    by half a document at most. ``positions`` has the time of each copy. Order within
    a source is by a seeded hash of the id, so reruns agree. Null sources are one
    source of their own; null and empty texts have size 0, are never taken and have no
    position. Equal ids are placed apart by size. ``keep`` names further columns to
    carry; with ``ordered=False`` the rows are not sorted. An empty table gives an empty result.

    Sums per source and per (source, hash range) are combined before the shuffle; a
    source with a third of all rows is split into ``ranges`` windows.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        key.alias("_key"), F.conv(F.substring(key, 1, 6), 16, 10).cast("long").alias("_high"), *[F.col(c).alias(f"_keep_{c}") for c in keep],
    ).withColumn("_range", (F.col("_high") * ranges / (1 << 24)).cast("int"))
    parts = rows.groupBy("source", "_range").agg(F.sum("size").alias("_part"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("_part").alias("source_size")), weights, total_share, most_passes)
    orders = F.pmod(F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(schedules)))
    targets = targets.withColumn("_schedule", orders)
    before = parts.withColumn(
        "_before", F.coalesce(F.sum("_part").over(W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")),
    ).select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_before")
    bounds = before.join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    within = W.partitionBy("source", "_range").orderBy("_key", "size", "_id")
    placed = (
        rows.withColumn("_in", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
        .join(bounds, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
        .withColumn("_start", F.col("_before") + F.col("_in"))
    )
    middle = F.col("_start") + F.col("size") / 2
    copies = F.when(F.col("size") == 0, 0).otherwise(
        F.greatest(F.lit(0), F.least(F.ceil((F.col("target") - middle) / F.col("source_size")), F.lit(int(most_passes)))).cast("int")
    )
    share = lambda p: (F.col("_start") + p * F.col("source_size")) / F.col("target")
    at = lambda p: F.coalesce(*[F.when(F.col("_schedule") == i, reached_at(share(p), s)) for i, s in enumerate(schedules)])
    mixed = (
        placed.withColumn("copies", copies)
        .withColumn("positions", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies"), F.lit(1)) - 1), at)))
        .select(
            F.col("_id").alias(id_col), "source", "size", "source_size", "target", "copies",
            (F.col("copies") * F.col("size")).cast("long").alias("taken"), "positions",
            F.element_at("positions", 1).alias("position"), *[F.col(f"_keep_{c}").alias(c) for c in keep],
        )
    )
    return mixed.orderBy(F.col("position").asc_nulls_last(), id_col) if ordered else mixed
