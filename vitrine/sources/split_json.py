"""Objects of one long array inside a JSON document, read by many tasks.

A document without line breaks is split at its closing braces, as lines are at line
ends. What a piece means depends on what stands before it: whether it begins inside a
string, and how deep. Both are running sums, made within the splits of the file first
and shifted by the sums of earlier splits, of which there is one row each. No task
reads more than a split, and none holds more than one object.
"""
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.operators.arrival import located
from vitrine.sources.tables import materialized

_SPLIT = ["file", "_start"]
_BEFORE = (Window.unboundedPreceding, -1)


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _running(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the sum of ``column`` over all earlier pieces of the file."""
    within = Window.partitionBy(*_SPLIT).orderBy("_id").rowsBetween(*_BEFORE)
    splits = df.groupBy(*_SPLIT).agg(F.sum(column).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy("file").orderBy("_start").rowsBetween(*_BEFORE))
    shifts = splits.select(*_SPLIT, F.coalesce(earlier, F.lit(0)).alias("_shift"))
    summed = df.withColumn("_in", F.coalesce(F.sum(column).over(within), F.lit(0)))
    return summed.join(shifts, _SPLIT).withColumn(name, F.col("_in") + F.col("_shift")).drop("_in", "_shift")


def read_array_objects(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``file, number, value``: the text of each object of the array under ``key`` of the root object of each file.

    Files hold a JSON object each, or several after one another, on any number of lines. ``number`` counts up in the order
    of a file; gaps are objects at the same depth that stand elsewhere. Objects in other
    arrays, or of that key deeper down, and braces and quotes in strings are no objects here. Elements that
    are not objects are left out. A file that is no JSON gives what can be found in it.
    """
    pieces = located(spark.read.text(path, lineSep="}")).withColumn("_id", F.monotonically_increasing_id())
    bare = F.regexp_replace("value", r"\\.", "")  # without escaped characters
    from_string = F.concat(F.lit('"'), bare)
    outside = lambda text: F.regexp_replace(text, r'"[^"]*+(?:"|$)', "")
    change = lambda text: _count(text, "{[") - _count(text, "]")
    measured = materialized(pieces.select(
        "value", *_SPLIT, "_id", _count(bare, '"').alias("_quotes"),
        change(outside(bare)).alias("_out"), change(outside(from_string)).alias("_in_string"),
    ))
    quoted = _running(measured.drop("value"), "_quotes", "_before")
    begins_in = F.col("_before") % 2 == 1
    ends_in = (F.col("_before") + F.col("_quotes")) % 2 == 1
    opened = F.when(begins_in, F.col("_in_string")).otherwise(F.col("_out"))
    deep = _running(quoted.select(
        *_SPLIT, "_id", opened.alias("_opened"), ends_in.alias("_ends_in"), (opened - F.when(ends_in, 0).otherwise(1)).alias("_change")
    ), "_change", "_depth")
    # the root is depth 1, the array 2: a brace that leads back to depth 2 ends an object
    closed = deep.withColumn("_ends", (~F.col("_ends_in") & (F.col("_depth") + F.col("_change") == 2)).cast("long"))
    starts = (F.col("_depth") <= 2) & (F.col("_depth") + F.col("_opened") >= 3)
    numbered = _running(closed.withColumn("_starts", starts.cast("long")), "_ends", "number")
    rows = numbered.select(*_SPLIT, "_id", "number", "_ends", "_starts", "_depth").join(measured.select(*_SPLIT, "_id", "value"), [*_SPLIT, "_id"])
    # of one object: its pieces from the last that leads down into it; the text before is cut off
    piece = F.struct("_start", "_id", "_starts", "_depth", F.concat("value", F.lit("}")).alias("text"))
    objects = rows.groupBy("file", "number").agg(F.array_sort(F.collect_list(piece)).alias("_p"), F.max("_ends").alias("_whole")).where("_whole = 1")
    first = F.array_max(F.transform("_p", lambda p, i: F.when(p["_starts"] == 1, i)))
    kept = objects.withColumn("_first", first).where("_first IS NOT NULL").withColumn("_kept", F.slice("_p", F.col("_first") + 1, F.size("_p")))
    text = F.array_join(F.transform("_kept", lambda p: p["text"]), "")
    named = rf'(?s)^.*?"{key}"\s*:\s*\[\s*(?:(?:[^\[\]{{}}"]|"(?:[^"\\]|\\.)*")*,\s*)?(?=\{{)'
    inside = kept.select(
        "file", "number", F.col("_kept")[0]["_start"].alias("_start"), text.alias("_text"), F.col("_kept")[0]["_depth"].alias("_depth"),
    ).withColumns({
        # a piece that begins in the array goes on in it; one that does not must name it at depth 1
        "_same": (F.col("_depth") == 2) & F.col("_text").rlike(r'^[^\[\]{}]*\{'),
        "_names": F.col("_text").rlike(named),
    })
    held = materialized(inside.withColumn("_array", F.when(F.col("_same"), F.lit(None)).otherwise(F.col("_names").cast("int"))))
    # which array an object is in is told by the last one before it that is not just the next: again within splits, then across
    run = Window.partitionBy(*_SPLIT).orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lasts = held.groupBy(*_SPLIT).agg(F.max_by("_array", F.when(F.col("_array").isNotNull(), F.col("number"))).alias("_last"))
    carried = lasts.select(*_SPLIT, F.last("_last", ignorenulls=True).over(Window.partitionBy("file").orderBy("_start").rowsBetween(*_BEFORE)).alias("_carried"))
    told = held.withColumn("_now", F.last("_array", ignorenulls=True).over(run)).join(carried, _SPLIT)
    within = told.where(F.coalesce("_now", "_carried", F.lit(0)) == 1)
    lead = F.when(F.col("_same"), F.regexp_replace("_text", r"^[^{]*", "")).otherwise(F.regexp_replace("_text", named, ""))
    return within.select("file", "number", lead.alias("value"))
