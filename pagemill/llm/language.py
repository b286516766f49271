"""Language identification by prediction by partial matching (PPM) over bytes.

For every language a context tree of order ``ORDER`` says how likely each byte is after the last
``ORDER`` bytes.  A byte seen in a context of n symbols, d of them different, has probability
``count / (n + d)``; another one escapes, with probability ``d / (n + d)``, to the next shorter
context, and past the empty one to 1/256 each (method C, without exclusions).  A text costs each
language the sum of its bytes' exact code lengths; the cheapest language is predicted.  The
statistics are frozen: scoring never updates them.

Trees of all languages are kept as sorted arrays of byte strings packed into integers, with a
row of code lengths (one for each language) for every string seen.  Scoring looks up each
distinct string of a slice once.

The trees are fitted on a bounded sample of labelled texts, at most ``TEXTS`` whole texts and
``BYTES`` bytes of each language, chosen by hash; their strings are counted in Spark.  A language
whose labelled texts are all longer is learned from ``BLOCKS`` blocks dealt evenly over the
shortest of them.  Scoring covers every byte of every text.

Defined results: a null text, one without a letter, or no labelled text at all give ``und`` with
score 0 (without any labelled text :func:`known_only` drops null and letterless texts only); a null id counts as the empty string when rows are dealt into learning and held-out
ones; equal costs go to the first language in alphabetical order; repeated rows are scored row
by row; an empty table gives an empty table; further columns are ignored by :func:`predict` and
kept by :func:`known_only`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm import arrow_text as A
from pagemill.storage import bounded_batches

ORDER = 4
TEXTS = 400
BYTES = 1 << 20
BLOCKS = 16
# Tasks among which the choice of a language's texts is split first
SALTS = 16
UNKNOWN = "und"
_U = np.uint64


def strings(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Every byte with the ``ORDER`` before it, packed; texts begin after ``ORDER`` zero bytes."""
    n = len(data)
    at = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    out = data.astype(_U)
    for back in range(1, ORDER + 1):
        before = np.zeros(n, _U)
        before[back:] = data[:-back] if back <= n else 0
        before[at < back] = 0
        out |= before << _U(8 * back)
    return out


class Trees(NamedTuple):
    langs: list[str]
    keys: list[np.ndarray]
    """Packed strings of k + 1 bytes, ascending, for every order k."""
    bits: list[np.ndarray]
    """Code length of a string's last byte after the others, by language."""
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]
    """Code length of the escape from a context of k bytes, by language."""

    def lengths(self, wanted: np.ndarray) -> np.ndarray:
        """Code lengths of distinct strings of ``ORDER`` + 1 bytes."""
        total = np.zeros((len(wanted), len(self.langs)))
        open_ = np.arange(len(wanted))
        for k in range(ORDER, -1, -1):
            mask = _U((1 << (8 * (k + 1))) - 1)
            found, at = _find(self.keys[k], wanted[open_] & mask)
            total[open_[found]] += self.bits[k][at[found]]
            open_ = open_[~found]
            if not len(open_):
                return total
            seen, at = _find(self.contexts[k], (wanted[open_] & mask) >> _U(8))
            total[open_[seen]] += self.escapes[k][at[seen]]
        total[open_] += 8.0
        return total


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, wanted), max(0, len(table) - 1))
    return (table[at] == wanted) if len(table) else np.zeros(len(wanted), bool), at


def build(langs: list[str], lang: np.ndarray, key: np.ndarray, count: np.ndarray) -> Trees:
    """Trees from how often each language holds each string of ``ORDER`` + 1 bytes."""
    keys, bits, contexts, escapes = [], [], [], []
    shape = len(langs)
    for k in range(ORDER + 1):
        own, at = np.unique(key & _U((1 << (8 * (k + 1))) - 1), return_inverse=True)
        counts = np.zeros((len(own), shape))
        np.add.at(counts, (at, lang), count)
        above, of = np.unique(own >> _U(8), return_inverse=True)
        n, d = np.zeros((len(above), shape)), np.zeros((len(above), shape))
        np.add.at(n, of, counts)
        np.add.at(d, of, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(n > 0, -np.log2(d / (n + d)), 0.0)
            direct = -np.log2(counts / (n + d)[of])
        if k:
            shorter = bits[-1][np.searchsorted(keys[-1], own & _U((1 << (8 * k)) - 1))]
        else:
            shorter = np.full((len(own), shape), 8.0)
        keys.append(own)
        bits.append(np.where(counts > 0, direct, escape[of] + shorter))
        contexts.append(above)
        escapes.append(escape)
    return Trees(langs, keys, bits, contexts, escapes)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def sample(docs: DataFrame, texts: int = TEXTS, size: int = BYTES) -> DataFrame:
    """``lang, text`` of the labelled texts to learn from.

    The choice is made on slim rows, first within salts of a language, then among what those
    keep.  Every language with a labelled text is there.
    """
    able = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id"))).select(
        "lang", "text", F.xxhash64(F.lit(5), "doc_id", "text").alias("chosen")
    )
    slim = able.select("lang", "chosen", F.octet_length("text").alias("size"))
    first = slim.filter(F.col("size") <= size).withColumn("salt", F.pmod("chosen", F.lit(SALTS)))
    order = Window.partitionBy("lang").orderBy("chosen", "size")
    for among in (Window.partitionBy("lang", "salt").orderBy("chosen", "size"), order):
        first = first.withColumn("place", F.row_number().over(among)).filter(F.col("place") <= texts)
    few = (
        first.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("upto") <= size).select("lang", "chosen").distinct()
    )
    shortest = slim.groupBy("lang").agg(F.min(F.struct("size", "chosen")).alias("least"))
    few = few.unionByName(shortest.filter(F.col("least.size") > size).select("lang", "least.chosen"))
    taken = F.when(F.octet_length("text") <= size, F.col("text")).otherwise(_blocks(F.col("text"), size))
    return able.join(F.broadcast(few), ["lang", "chosen"]).select("lang", taken.alias("text"))  # texts rows a language


def _blocks(text: Column, size: int) -> Column:
    """Blocks dealt evenly over a text, at most ``size`` bytes together (a character has up to four)."""
    each = max(1, size // (5 * BLOCKS))
    starts = [F.floor(F.char_length(text) * i / BLOCKS).cast("int") + 1 for i in range(BLOCKS)]
    return F.concat_ws(" ", *[F.substring(text, start, F.lit(each)) for start in starts])


def _count_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in A.slices(batch, "text"):
            data, offsets = A.view(part.column("text"))
            key = strings(data, offsets)
            langs = part.column("lang").dictionary_encode()
            row = np.repeat(langs.indices.to_numpy(), np.diff(offsets))
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                own, times = np.unique(key[row == i], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(own), pa.string()), pa.array(A.signed(own)), pa.array(times)],
                    names=["lang", "key", "times"],
                )


def train(docs: DataFrame, texts: int = TEXTS, size: int = BYTES) -> Trees | None:
    """At most ``ORDER + 1`` entries for each sampled byte reach the driver."""
    counted = (
        sample(docs, texts, size).mapInArrow(_count_strings, "lang string, key long, times long")
        .groupBy("lang", "key").agg(F.sum("times").alias("times")).toArrow()
    )
    if not counted.num_rows:
        return None
    lang = np.array(counted.column("lang").to_pylist())
    langs, of = np.unique(lang, return_inverse=True)
    key = counted.column("key").to_numpy().view(_U)
    return build(langs.tolist(), of, key, counted.column("times").to_numpy())


def costs(trees: Trees, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each row by language."""
    distinct, of = np.unique(strings(data, offsets), return_inverse=True)
    lengths = trees.lengths(distinct)
    out = np.zeros((len(offsets) - 1, len(trees.langs)))
    full = np.flatnonzero(np.diff(offsets))
    for i in range(len(trees.langs)):
        if len(full):
            out[full, i] = np.add.reduceat(lengths[of, i], offsets[full])
    return out


def predict(docs: DataFrame, trees: Trees | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, ``lang_pred``, ``score`` (of the languages' posterior) and ``bits_per_byte`` of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees and tuple(trees))
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.when(letters, F.col(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trees(*shared.value) if shared.value else None
        for batch in batches:
            for part in A.slices(batch, "text"):
                column = part.column("text")
                n = part.num_rows
                none = column.is_null().to_numpy(zero_copy_only=False)
                if model is None:
                    names, score, rate = np.full(n, UNKNOWN, object), np.zeros(n), np.full(n, 8.0)
                else:
                    data, offsets = A.view(column)
                    bits = costs(model, data, offsets)
                    best = bits.argmin(1)
                    least = bits[np.arange(n), best]
                    score = np.where(none, 0.0, 1 / np.exp2(least[:, None] - bits).sum(1))
                    rate = np.where(none, 8.0, least / np.maximum(1, np.diff(offsets)))
                    names = np.where(none, UNKNOWN, np.array(model.langs, object)[best])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(names, pa.string()), pa.array(score), pa.array(rate)],
                    names=["id", "lang_pred", "score", "bits_per_byte"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, bits_per_byte double")
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", "bits_per_byte")


def known_only(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """``docs`` without rows whose language is not known; ``lang`` becomes the prediction.

    Where nothing could be learned, only texts without a letter go and ``lang`` stays.
    """
    if trees is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    found = predict(docs.select(row, F.col("text")), trees, id_col="_row")
    cells = [F.col("lang_pred") if c == "lang" else F.col(f"_row.`{c}`") for c in docs.columns]
    return found.filter(F.col("lang_pred") != UNKNOWN).select(
        *[cell.alias(c) for cell, c in zip(cells, docs.columns, strict=True)]
    )
