"""Queries over the given tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import (
    centroids, chat, contamination, jaccard, kneser_ney, language, packing, pieces, private, quality, shards, spelling,
    token_counts,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where the vocabulary files of public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans."""
    found = private.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["seed"])

    def count(k: int) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(private.KINDS)]
    return found.select(
        "doc_id", *counts,
        F.sha2(private.written(base), 256).alias("base_sha256"),
        private.written(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["seed"])).cast("long").alias("n_added"),
    )


def interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.interleave(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


def maximal_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal(table(spark, sf_dir, "conversations"))


def leaked_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, each with the item and what of it is covered."""
    return contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of 0.9 or more."""
    return jaccard.near_components(table(spark, sf_dir, "documents"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.train(docs))
    return found.select(
        "doc_id", language.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte"
    )


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = kneser_ney.is_held_out(F.col("doc_id"))
    scored = kneser_ney.score(docs, kneser_ney.train(docs.filter(~held)))
    return scored.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"
    )


def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it."""
    return pieces.encoded(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with the near word they are a variant of, and the word that those lead to."""
    return spelling.variants(spelling.frequent_words(spelling.noisy_words(table(spark, sf_dir, "documents"))))


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    written = F.concat_ws(",", F.col("centroid").cast("array<string>"))
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(written, 256).alias("centroid_sha256")
    )


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places; of their ids only the checksum is carried along."""
    cut = packing.cut_pieces(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).drop("uid")


QUERIES: dict[str, Query] = {
    "op1_personal_data": personal_data,
    "op2_leaked_benchmark": leaked_benchmark,
    "op3_interleaved_shards": interleaved_shards,
    "op4_quality_rules": quality_rules,
    "op5_languages": languages,
    "op6_token_counts": token_totals,
    "op7_maximal_chats": maximal_chats,
    "op8_near_copies": near_copies,
    "op9_model_scores": model_scores,
    "op10_sentence_pieces": sentence_pieces,
    "op11_spelling_variants": spelling_variants,
    "op12_centroid_clusters": centroid_clusters,
    "op13_packed_sequences": packed_sequences,
}


def _centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """Every vector against every centroid, in each round; after the last round once more."""
    steps = [f"""
        kept AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS (
            SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v
            FROM kept QUALIFY c < {k}
        )"""]
    for i in range(rounds + 1):
        steps.append(f"""
        d{i} AS (
            SELECT r, c, list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
            FROM kept k CROSS JOIN c{i} m
        ), a{i} AS (SELECT r, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            steps.append(f"""
        s{i} AS (
            SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n
            FROM (SELECT a.c, unnest(k.v) AS x, unnest(range(64)) AS i FROM a{i} a JOIN kept k USING (r)) GROUP BY c, i
        ), c{i + 1} AS (
            SELECT m.c, coalesce(n.v, m.v) AS v FROM c{i} m
            LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY c) n USING (c)
        )""")
    return f"""
        WITH {",".join(steps)}
        SELECT k.vec_id, a.c::INTEGER AS cluster, a.d AS distance,
               (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(m.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN kept k USING (r) JOIN c{rounds} m ON m.c = a.c
    """


ORACLES: dict[str, str] = {
    "op12_centroid_clusters": _centroid_sql(),
    "op7_maximal_chats": """
        WITH turns AS (
            SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        ), placed AS (
            SELECT conv_id, count(*) OVER w AS n,
                   string_agg(md5(md5(role) || md5(text)), ',') OVER w AS prefix
            FROM turns
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        ), sized AS (SELECT *, max(n) OVER (PARTITION BY conv_id) AS n_turns FROM placed
        ), whole AS (
            SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n_turns) AS n_turns
            FROM sized WHERE n = n_turns GROUP BY prefix
        ), kept AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM sized WHERE n < n_turns)
        ), chats AS (
            SELECT conv_id, string_agg('<|' || role || chr(124) || '>' || chr(10) || text || chr(10) || '<|end|>' || chr(10),
                                       '' ORDER BY turn NULLS FIRST, role, text) AS chat
            FROM turns GROUP BY conv_id
        )
        SELECT k.conv_id, k.n_turns::BIGINT AS n_turns, k.n_copies::BIGINT AS n_copies, c.chat
        FROM kept k JOIN chats c ON k.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
}
