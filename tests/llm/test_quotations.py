"""Quotation linking against SQL on hand-made and made-up conversations."""
import random

import duckdb
import pandas as pd

from vitrine.llm.quotations import reply_order
from vitrine.llm.sql import OP6

COLUMNS = ["conv_id", "turn", "role", "text"]
HAND = [
    (1, 0, "user", "Guten Tag.\nWie backe ich Brot?\n\nDanke"), (1, 1, "assistant", "> Wie  backe ich BROT?\nMit Mehl."),
    (1, 2, "user", "Am Montag schrieb:\n>> Wie backe ich Brot?\n> Mit Mehl.\nMehr > weniger"),
    (1, 9000, "user", "> Guten Tag.\n> Wie backe ich Brot?\n>\n> Danke\nUnd Salz?"), (1, 9001, None, None),
    (2, 0, "user", "x"), (2, 1, "user", "> Mit Mehl.\nin einem anderen Gespräch"), (3, 1, "u", "> ich\nich"), (3, 2, "u", "> ich"),
]


def _made(seed):
    r = random.Random(seed)
    lines = ["ja", "nein", "Wie bitte?", "viel Text und  mehr", "Danke", ""]
    rows = []
    for conv in range(30):
        for turn in sorted(r.sample(range(0, 20_000), 12)):
            rows.append((conv, turn, r.choice(["user", "assistant"]), "\n".join(r.choice(["", "", "> ", ">> ", " >> > "]) + r.choice(lines) for _ in range(r.randrange(6)))))
    return rows


def test_links_agree_with_sql(spark):
    for rows in (HAND, _made(5)):
        conversations = pd.DataFrame(rows, columns=COLUMNS)  # noqa: F841
        want = duckdb.connect().sql(OP6).df()
        table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(3)
        got = reply_order(table).toPandas()
        assert got[want.columns].sort_values(["conv_id", "position"]).astype(str).values.tolist() == \
            want.astype({"reply_to": "float64"}).sort_values(["conv_id", "position"]).astype(str).values.tolist()


def test_replies_and_contents(spark):
    rows = {(r["conv_id"], r["turn"]): r for r in reply_order(spark.createDataFrame(HAND, "conv_id long, turn long, role string, text string")).collect()}
    assert [rows[1, t]["reply_to"] for t in (0, 1, 2, 9000, 9001)] == [None, 0, 1, 0, 9000]
    assert (rows[1, 2]["content"], rows[1, 2]["n_quotes"]) == ("Mehr > weniger", 2)
    assert rows[1, 9000]["rendered"] == "<|user|>\nUnd Salz?\n<|end|>\n"


def test_odd_rows(spark):
    odd = [(None, 3, "user", "> x"), (4, None, "a", "b"), (5, 1, "a", "one"), (5, 1, "b", "two"), (5, 1, "b", "two"), (5, 2, "a", "> two"), (6, 0, "a", "> z\n" * 20_000)]
    table = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    rows = reply_order(table).collect()
    assert len(rows) == len(odd)
    assert sorted(r["position"] for r in rows if r["conv_id"] == 5) == [1, 2, 3, 4]
    assert [r["reply_to"] for r in rows if (r["conv_id"], r["turn"]) == (5, 2)] == [1]
    assert all(r["position"] is None for r in rows if r["conv_id"] is None or r["turn"] is None)
    assert reply_order(table.limit(0)).count() == 0


def test_each_passage_of_an_interleaved_reply_is_linked(spark):
    rows = [(1, 0, "u", "Wo ist das Mehl?"), (1, 1, "u", "Und wo das Salz?"), (1, 2, "u", "Nichts"),
            (1, 3, "a", "> Und wo das Salz?\nIm Schrank.\n> Wo ist das Mehl?\nDaneben.\n>> Nichts\n> Wo ist das Mehl?")]
    row, = [r for r in reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() if r["turn"] == 3]
    assert (row["reply_to"], row["n_quotes"], row["content"]) == (1, 4, "Im Schrank.\nDaneben.")
