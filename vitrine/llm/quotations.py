"""Chat formatting by quotation linking: quote levels, passages joined to their originals, reply order.

Built from DataFrame functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitrine.functions.binding import let

#: Quote marks at the start of a line, one per level.
MARKS = r"^(?:[ \t]*>)+"
#: A line that only introduces the quotation below it.
INTRODUCTION = r"^.*(?:wrote|writes|schrieb|écrit|escribió) ?:[ \t]*$"
#: Turns of one chunk: order within a conversation is found chunk by chunk.
CHUNK = 4096


def _marks(line: Column) -> Column:
    return F.regexp_extract(line, MARKS, 0)


def _depth(line: Column) -> Column:
    return F.length(F.regexp_replace(_marks(line), "[^>]", ""))


def _body(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"^[ \t\r]+|[ \t\r]+$", "")


def normal(text: Column) -> Column:
    """Lower case, every run of white space one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def _key(text: Column) -> Column:
    return F.xxhash64(normal(text))


def _own_lines(lines: Column) -> Column:
    """Lines without quote marks, less those that introduce a quotation."""
    below = lambda i: F.coalesce(_depth(F.get(lines, i + 1)), F.lit(0))
    return F.filter(lines, lambda line, i: (_depth(line) == 0) & ~(line.rlike(INTRODUCTION) & (below(i) > 0)))


def _passages(lines: Column) -> Column:
    """Runs of lines of one depth: passage (their number in the message), depth, lines; linear in the lines."""
    def runs(depths: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(depths, i) != F.get(depths, i - 1)))
        return let(begins, lambda b: F.transform(b, lambda at, k: F.struct(
            k.alias("passage"), F.get(depths, at).alias("depth"), F.slice(lines, at + 1, F.coalesce(F.get(b, k + 1), F.size(lines)) - at).alias("lines"))))

    return let(F.transform(lines, _depth), runs)


def _keys(lines: Column, whole: Column) -> Column:
    """Hash and length of the whole passage and of each of its lines; empty ones give none."""
    pair = lambda text: F.struct(_key(text).alias("key"), F.length(normal(text)).alias("weight"))
    return F.array_distinct(F.filter(F.concat(F.array(pair(whole)), F.transform(lines, pair)), lambda x: x.weight > 0))


def quotation_links(messages: DataFrame) -> DataFrame:
    """conv, turn, passage, depth, source_turn: the earlier message that each quoted passage comes from.

    ``messages``: conv, turn, lines, own. A passage is a run of lines that a message quotes
    at one depth, with nothing between them; ``passage`` numbers the runs of a message. Each of its keys leads to the latest earlier message of the conversation that
    says it in its own words; the passage to the message that most of its text leads to,
    the latest of equals. The latest one is carried along a sorted run of rows, so a line
    said often is never paired with each of its quotations.
    """
    quoting = messages.where(F.exists("lines", lambda line: _depth(line) > 0))
    quoted = (
        quoting.select("conv", "turn", F.explode(_passages(F.col("lines"))).alias("_p"))
        .where("_p.depth > 0").select("conv", "turn", "_p.passage", "_p.depth", F.transform("_p.lines", _body).alias("_at"))
        .select("conv", "turn", "passage", "depth", F.explode(_keys(F.col("_at"), F.array_join("_at", "\n"))).alias("_k"))
        .select("conv", "turn", "passage", "depth", "_k.key", "_k.weight").distinct()
    )
    said = (
        messages.select("conv", "turn", F.explode(_keys(F.col("own"), F.array_join("own", "\n"))).alias("_k"))
        .select("conv", "turn", "_k.key")
        .join(quoted.select("conv", "key").distinct(), ["conv", "key"], "left_semi").distinct()
    )
    both = quoted.select("conv", "turn", "key", "passage", "depth", "weight", F.lit(None).cast("long").alias("_said")).unionByName(
        said.select("conv", "turn", "key", F.lit(None).cast("int").alias("passage"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("int").alias("weight"), F.col("turn").cast("long").alias("_said"))
    )
    # At one turn quotations sort before what is said, so a message never quotes itself.
    earlier = W.partitionBy("conv", "key").orderBy(F.col("turn"), F.col("depth").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    return (
        both.withColumn("source_turn", F.last("_said", ignorenulls=True).over(earlier))
        .where("depth is not null and source_turn is not null")
        .groupBy("conv", "turn", "passage", "depth", "source_turn").agg(F.sum("weight").alias("_sum"))
        .groupBy("conv", "turn", "passage", "depth").agg(F.max(F.struct("_sum", "source_turn")).alias("_best"))
        .select("conv", "turn", "passage", "depth", F.col("_best.source_turn").alias("source_turn"))
    )


def reply_order(
    table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Per message: conversation, turn, role, position, reply_to, n_quotes, content, rendered.

    ``content`` is the message without quoted lines and without lines that introduce
    them; ``reply_to`` the turn that its shallowest linked quotation comes from, the first of
    such, else the turn before, null for the first; ``n_quotes`` its linked passages; ``position`` counts from 1 in order of turns, in
    which each message follows the one it replies to. ``rendered`` is the message
    as a part of a training text: a role line, the content, an end line.

    Null and empty texts have empty content and are kept. Null roles read "user". Rows
    with a null conversation or turn are kept, without position and reply. Rows that
    share a turn share its links and are ordered by role and text. Extra columns
    are not read. An empty table gives an empty result.

    Order is found on narrow rows, in chunks of turns, so that one conversation with a
    third of all messages is many groups; no conversation is collected.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    rows = table.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"),
        lines.alias("lines"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"),
    ).withColumn("own", _own_lines(F.col("lines")))
    chunk = F.floor(F.col("turn") / CHUNK)
    known = rows.where("conv is not null and turn is not null")
    turns = known.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("_n")).withColumn("_chunk", chunk)
    chunks = turns.groupBy("conv", "_chunk").agg(F.sum("_n").alias("_rows"), F.max("turn").alias("_last"))
    past = W.partitionBy("conv").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select("conv", "_chunk", F.coalesce(F.sum("_rows").over(past), F.lit(0)).alias("_rows_before"), F.max("_last").over(past).alias("_turn_before"))
    inside = W.partitionBy("conv", "_chunk").orderBy("turn")
    placed = turns.select(
        "conv", "turn", "_chunk", F.coalesce(F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_in"), F.lag("turn").over(inside).alias("_lag"),
    ).join(chunks, ["conv", "_chunk"]).select("conv", "turn", (F.col("_rows_before") + F.col("_in")).alias("_before"), F.coalesce("_lag", "_turn_before").alias("_previous"))
    found = quotation_links(known.select("conv", "turn", "lines", "own"))
    replies = found.groupBy("conv", "turn").agg(F.min(F.struct("depth", "passage", "source_turn")).alias("_first"), F.count(F.lit(1)).alias("n_quotes"))
    places = placed.join(replies, ["conv", "turn"], "left").select(
        "conv", "turn", "_before", F.coalesce("_first.source_turn", "_previous").alias("reply_to"), F.coalesce("n_quotes", F.lit(0).cast("long")).alias("n_quotes"),
    )
    content = F.regexp_replace(F.array_join("own", "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    same = W.partitionBy("conv", "turn").orderBy("role", "_text")
    return (
        rows.select("conv", "turn", "role", content.alias("content"), F.row_number().over(same).alias("_rank"))
        .join(places, ["conv", "turn"], "left")
        .select(
            F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col),
            (F.col("_before") + F.col("_rank")).alias("position"), "reply_to", F.coalesce("n_quotes", F.lit(0).cast("long")).alias("n_quotes"), "content",
            F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("content"), F.lit("\n<|end|>\n")).alias("rendered"),
        )
    )
