"""Groups of spelling variants, by PartEnum signatures on letter multisets.

A word is the binary vector of its numbered letters: the first e, the second e, and so on.  Words
that differ by one replaced letter have the same length and vectors at a Hamming distance of two;
by one inserted or deleted letter, lengths one apart and a distance of one.  The numbered letters
are hashed into ``PARTS`` parts; vectors at a distance of h agree on all parts but h of them, so
words share the signature "all parts but these" for some choice of h parts.  Every choice is
enumerated: parts choose two for words of equal length, and parts choose one for words of the
lengths l and l + 1.  The length is in the signature, and which of the two roles a word plays.

A signature is a 64-bit sum of hashes, so it can only let too much through.  Signatures are joined
on equality, and the edit distance is tested inside the join: candidates are compared where they
meet and only pairs that are near leave it.  Each pair meets under several signatures and is
counted once.

Forms are followed to the last by doubling: each round replaces a word's target by that target's
target, in tables that are written, so there are as many rounds as the longest chain has binary
digits.  Along a chain counts at least double, so it can not be long, nor come back to its start.

Defined results: a null text has no words; a null id hashes as an empty one; repeated rows count
each time; words of any length are compared; an empty table gives an empty table; further columns
are ignored.  Of near words with equal counts the smallest in code-point order is the form.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import arrow_text as A
from pagemill.storage import new_folder, write_table

LEAST_LENGTH = 5
LEAST_COUNT = 3
NOISE = 97
PARTS = 7
RATIO = 2
_ENGLISH = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def noisy_words(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", noise: int = NOISE, least: int = LEAST_LENGTH,
) -> DataFrame:
    """``word``, one row for each run of letters; of one run in ``noise``, chosen by hash, a letter is deleted."""
    runs = F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"([A-Za-zÀ-ÿ]{{{least},}})"), F.lit(1)))
    lowered = F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(
        F.translate("run", _ENGLISH, _ENGLISH.lower())
    )
    owner = F.coalesce(F.col("id").cast("string"), F.lit(""))
    hashed = (
        docs.select(F.col(id_col).alias("id"), runs.alias("run"))
        .select("id", lowered.alias("run"))
        .select("run", F.crc32(F.concat(owner, F.lit(":"), "run")).alias("h"))
    )
    place = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least)


def frequent_words(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words that occur often enough."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def _part_sums(words: list[str], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The summed hashes of each word's numbered letters by part, and the words' lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letter = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    order = np.lexsort((letter, word))
    letter = letter[order]  # within each word, sorted
    new = np.ones(len(letter), bool)
    new[1:] = (letter[1:] != letter[:-1]) | (word[1:] != word[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(letter)), 0))
    hashed = A.mix((letter << np.uint64(32)) + (np.arange(len(letter)) - start).astype(np.uint64) + np.uint64(1))
    sums = np.zeros((len(words), parts), np.uint64)
    np.add.at(sums, (word, (hashed >> np.uint64(33)) % np.uint64(parts)), hashed)
    return sums, size


def signatures(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """``word, n, length, same, shorter, longer``: signatures among words of one length, and in the two roles."""
    pairs = np.array(list(combinations(range(parts), 2)))

    def key(rest: np.ndarray, which: np.ndarray, length: np.ndarray) -> np.ndarray:
        tag = A.mix(length.astype(np.uint64)[:, None] * np.uint64(1 << 16) + which.astype(np.uint64)[None, :] + np.uint64(1))
        return A.signed(A.mix(rest + tag))

    def lists(values: np.ndarray) -> pa.ListArray:
        n, width = values.shape
        return A.list_column(values.ravel(), np.arange(n + 1) * width, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, "word"):
                sums, size = _part_sums(part.column("word").to_pylist(), parts)
                whole = sums.sum(1, dtype=np.uint64)[:, None]
                two = key(whole - sums[:, pairs[:, 0]] - sums[:, pairs[:, 1]], np.arange(len(pairs)), size)
                one = whole - sums
                at = len(pairs) + np.arange(parts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, lists(two), lists(key(one, at, size)), lists(key(one, at, size - 1))],
                    names=["word", "n", "same", "shorter", "longer"],
                )

    return words.select("word", "n").mapInArrow(
        run, "word string, n long, same array<long>, shorter array<long>, longer array<long>"
    )


def _merged(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left.join(right, key, how)``, with neither side sent to the driver for a broadcast.

    Spark takes a written table for as large as its compressed files, and exploded signatures for as many
    rows as there are words, 21 times too few: it would broadcast tables that no driver holds.
    """
    return left.join(right.hint("merge"), key, how)


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """``a, n_a, b, n_b``: words that differ by one inserted, deleted or replaced letter, each pair once."""
    signed = signatures(words, parts)

    def exploded(role: str, name: str) -> DataFrame:
        return signed.select(F.explode(role).alias("s"), F.col("word").alias(name), F.col("n").alias(f"n_{name}"))

    one_edit = F.levenshtein("a", "b", 1) == 1
    replaced = _merged(exploded("same", "a"), exploded("same", "b"), "s").filter((F.col("a") < F.col("b")) & one_edit)
    inserted = _merged(exploded("shorter", "a"), exploded("longer", "b"), "s").filter(one_edit)
    return replaced.unionByName(inserted).select("a", "n_a", "b", "n_b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with forms."""
    spark = forms.sparkSession
    at = write_table(forms.select("word", F.col("form").alias("root")), new_folder(spark, "roots"))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = write_table(
            _merged(at, onward, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            new_folder(spark, "roots"),
        )
        if not at.filter("moved").limit(1).count():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(words: DataFrame, parts: int = PARTS, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a table of distinct words and their counts."""
    spark = words.sparkSession
    words = write_table(words.select("word", "n"), new_folder(spark, "words"))
    pairs = write_table(near_pairs(words, parts), new_folder(spark, "near"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    found = both.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("m"), "b")).alias("best")
    )
    enough = -F.col("best.m") >= ratio * F.col("n")
    shaped = write_table(
        _merged(words, found, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.b")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"),
        ),
        new_folder(spark, "forms"),
    )
    roots = _roots(shaped.filter("form IS NOT NULL"))
    return _merged(shaped, roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
