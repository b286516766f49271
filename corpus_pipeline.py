"""From raw documents to piece ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept and, but
for the last, returns the columns it got: languages that are not known go, one document of each
group of near copies stays, documents that hold a benchmark item go, personal data is masked,
and what remains is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import contamination, jaccard, language, pieces, private
from pagemill.llm.queries import table, tokenizer
from pagemill.storage import new_folder, write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Near copies of the pipeline: shingles of five words, similarity of 0.8 (op8 has its own)
SHINGLE = 5
THRESHOLD = 80


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: texts without a known language go; ``lang`` becomes the predicted one."""
    return language.known_only(docs, language.train(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each component of near copies the document with the smallest id stays."""
    return jaccard.one_each(docs, shingle=SHINGLE, threshold=THRESHOLD)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold an item of ``benchmark`` go."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def masked_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: personal data becomes its kind in brackets; ``n_chars`` follows the text."""
    masked = private.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the ids of the texts' pieces."""
    return pieces.encoded(docs, tokenizer("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_languages),
    ("near_copies", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("personal_data", masked_personal_data),
    ("sentence_pieces", piece_ids),
]

# Tiling, context trees and the segmentation are no SQL; the tests hold stages against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), new_folder(spark, f"stage-{name}"))
    return STAGES[-1][1](spark, docs, sf_dir)
