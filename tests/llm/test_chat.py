"""Snapshot collapse against a plain comparison of turn lists."""

import compare
from pyspark.sql import functions as F

from pagemill.llm import chat, queries


def test_query_matches_oracle(spark, sf_dir):
    con = compare.connect(sf_dir)
    name = "op7_maximal_chats"
    assert compare.difference(spark, con, queries.QUERIES[name], queries.ORACLES[name], sf_dir) is None


def test_matches_brute_force(spark):
    talks = {
        1: ["a", "b"], 2: ["a", "b", "c"], 3: ["a", "x"], 4: ["a", "b", "c"], 5: ["a"], 6: [None, "b"],
        7: ["", "b"], 8: ["z"] * 300, 9: ["z"] * 299, 10: ["ab"], 11: ["a", "b", "c", "d"],
    }
    rows = [(c, t, "user" if t % 2 else None, x) for c, turns in talks.items() for t, x in enumerate(turns)]
    turns = spark.createDataFrame([*rows, *rows[:5]], "conv_id long, turn long, role string, text string")
    plain = {c: [x or "" for x in turns] for c, turns in talks.items()}
    want = {
        c for c, turns in plain.items()
        if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in plain.values())
        and c == min(d for d, o in plain.items() if o == turns)
    }
    got = {r["conv_id"]: r for r in chat.maximal(turns.withColumn("whole", F.lit(1))).collect()}
    assert set(got) == want == {3, 6, 8, 10, 11}
    assert got[6]["n_copies"] == 2
    assert got[3]["chat"] == "<||>\na\n<|end|>\n<|user|>\nx\n<|end|>\n"


def test_null_ids_ties_and_empty(spark):
    rows = [(None, 0, "u", "a"), (None, 0, "u", "b"), (None, None, "u", "c"), (1, 0, "u", "c")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.maximal(turns).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(None, 3)]
    assert chat.maximal(turns.limit(0)).count() == 0
