"""Shards that all hold the mixture of the whole, by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; row r of n has the fraction
``(2 r - 1) / 2 n``.  In order of fractions every stretch of the table holds every source in
proportion, so cutting that order into equal runs gives shards of the same mixture whose row
counts are at most one apart.

Neither ranking puts a source, or the table, into one task: rows are range-partitioned by the
sort key, numbered within their partition, and the small table of counts per partition turns
that into a rank.  Every numbering is written before it is read, so a lost executor cannot
change it.

Defined results: a null text counts as empty, a null source is a source of its own, null and
repeated ids are rows like others (rows equal in every respect are interchangeable); an empty
table gives an empty table; columns beyond id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.storage import new_folder, write_table

SHARDS = 40
SEED = 20


def numbered(df: DataFrame, order: list[str], partitions: int, group: str | None = None) -> DataFrame:
    """``df`` with ``pos`` counting from 0 in the given order (within ``group``, its first key)."""
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    kept = write_table(
        df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))),
        new_folder(spark, "numbered"),
    )
    keys = ["_part"] + ([group] if group else [])
    counts = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # a row for each partition (and source in it): its size follows the cluster, not the data
    before = Window.orderBy("_part") if not group else Window.partitionBy(group).orderBy("_part")
    earlier = F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_shift"))
    return kept.join(starts, keys).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def interleave(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id",
    text: str = "text", source: str = "source",
) -> DataFrame:
    """``doc_id, source, size, text_crc32, shard, slot`` of every row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source).isNotNull().alias("_named"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(id_col), body).alias("_shuffled"),
    ).withColumn("_stratum", F.when(F.col("_named"), F.concat(F.lit("s"), "source")).otherwise(F.lit("")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = numbered(slim, ["_stratum", "_shuffled", "doc_id", "text_crc32", "size"], parts, "_stratum")
    sizes = ranked.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_rows"))
    placed = ranked.join(sizes, "_stratum").select(
        "doc_id", F.when(F.col("_named"), F.col("source")).alias("source"), "size", "text_crc32",
        ((2 * F.col("pos") + 1) / (2.0 * F.col("_rows"))).alias("_fraction"),
        F.xxhash64(F.lit(seed), "_stratum").alias("_tie"), "_stratum", "_shuffled",
    )
    order = ["_fraction", "_tie", "_stratum", "_shuffled", "doc_id", "text_crc32", "size"]
    final = numbered(placed, order, parts)
    total = final.count()
    return (
        final.withColumn("shard", F.expr(f"(pos * {shards}) div {total}L").cast("int"))
        .withColumn("slot", F.col("pos") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}"))
        .select("doc_id", "source", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
    )
