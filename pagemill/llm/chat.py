"""Chat formatting with cumulative-snapshot collapse.

A conversation logged after every turn leaves many snapshots of which each is a prefix of the
next.  Every conversation gets the rolling hashes of its prefixes; an anti-join drops those
whose whole hash is a proper prefix of another, equal ones leave the smallest id, and only the
maximal conversations that remain are rendered.

A hash covers role and text of all turns up to a point (128 bits); a prefix that a third of all
conversations share is one row per map task before it is shuffled.

Defined results: turns are ordered by number, role and text, nulls first; a row repeated in full
counts once; a null role or text is empty and renders as such; rows with a null conversation id
form one conversation; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.storage import new_folder, write_table

# How a turn is written
OPEN, CLOSE, AFTER = "<|", "|>\n", "\n<|end|>\n"


def _turn_hash(turn: Column) -> Column:
    return F.md5(F.concat(F.md5(turn["role"]), F.md5(turn["text"])))


def gathered(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` with the turns in order."""
    one = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return (
        turns.select("conv_id", one.alias("t")).groupBy("conv_id")
        .agg(F.array_sort(F.collect_set("t")).alias("turns"))
    )


def prefix_hashes(turns: Column) -> Column:
    """The rolling hash after each turn."""

    def roll(state: Column, turn: Column) -> Column:
        now = F.md5(F.concat(state["now"], _turn_hash(turn)))
        return F.struct(now.alias("now"), F.concat(state["all"], F.array(now)).alias("all"))

    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("all"))
    return F.aggregate(turns, start, roll, lambda state: state["all"])


def rendered(turns: Column) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(AFTER))), ""
    )


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies, chat`` of the conversations that prefix no longer one."""
    spark = turns.sparkSession
    hashed = write_table(
        gathered(turns).withColumn("prefixes", prefix_hashes(F.col("turns"))), new_folder(spark, "chat")
    )
    whole = F.element_at("prefixes", -1)
    proper = hashed.select(F.explode(F.slice("prefixes", 1, F.size("prefixes") - 1)).alias("whole")).distinct()
    kept = (
        hashed.select("conv_id", whole.alias("whole")).groupBy("whole")
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
        .join(proper, "whole", "left_anti")
    )
    return (
        hashed.withColumn("whole", whole)
        .join(kept.withColumnRenamed("conv_id", "first_id"), "whole")
        .filter(F.col("conv_id").eqNullSafe(F.col("first_id")))
        .select(
            "conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies",
            rendered(F.col("turns")).alias("chat"),
        )
    )
