"""Interleaved shards: counts, mixture, order and odd input."""

from collections import Counter
from zlib import crc32

from pyspark.sql import functions as F

from pagemill.llm import queries, shards


def test_query_contract(spark, sf_dir):
    docs = {r["doc_id"]: r for r in queries.table(spark, sf_dir, "documents").collect()}
    out = queries.interleaved_shards(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(40):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    for r in out:
        raw = docs[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, crc32(raw), "rows", None)
    # the same source never has two rows more in one shard than in another
    total = Counter(r["source"] for r in out)
    for source, n in total.items():
        each = Counter(r["shard"] for r in out if r["source"] == source)
        assert max(abs(each[s] - n * sizes[s] / len(out)) for s in range(40)) <= 2


def test_matches_a_plain_ranking(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"),
    )
    keyed = docs.withColumn("h", F.xxhash64(F.lit(shards.SEED), "doc_id", "text")).withColumn(
        "stratum", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    rows = keyed.withColumn("tie", F.xxhash64(F.lit(shards.SEED), "stratum")).collect()
    counts, seen, order = Counter(r["stratum"] for r in rows), Counter(), []
    for r in sorted(rows, key=lambda r: (r["stratum"], r["h"], r["doc_id"])):
        seen[r["stratum"]] += 1
        order.append(((2 * seen[r["stratum"]] - 1) / (2.0 * counts[r["stratum"]]), r["tie"], r["doc_id"]))
    order.sort()
    want = {d: (i * 7 // 3000, i - -(-(i * 7 // 3000) * 3000 // 7)) for i, (_, _, d) in enumerate(order)}
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in shards.interleave(docs, 7).collect()}
    assert got == want


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None, None), (1, "a", "s"), (1, "a", "s"), (2, "", None), (3, "é" * 50000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("pos", F.lit(1))
    out = shards.interleave(docs, 2).collect()
    assert Counter(r["shard"] for r in out) == Counter({0: 3, 1: 2})
    assert sorted(r["size"] for r in out) == [16, 16, 17, 17, 100016]
    assert shards.interleave(docs.limit(0), 2).count() == 0
