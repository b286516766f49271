"""Language-model scores from an interpolated modified Kneser-Ney bigram model.

Counted in Spark over all training texts:

1. words: every block of texts sends its distinct words and counts to the words' partitions;
2. word pairs: likewise, by the first word (pairs of a very frequent first word are spread by
   both), each partition written as sorted arrays of pair hashes and counts;
3. what the words take part in: the pairs' partitions send, for each word, after how many
   different words it came and how many different words came after it once, twice and more;
   each partition of words is written as sorted arrays.

Workers memory-map the arrays and score texts by binary search; nothing of the model but a few
numbers and the list of very frequent words (at most ``4 * partitions``) goes through the driver.

A probability is ``max(c - D(c), 0) / c(h) + g(h) * p(w)`` with three discounts from the counts
of counts; ``p(w)`` is the same over the numbers of different words before w, interpolated with
``1 / (V + 1)``, so all words and one unknown word sum to one.  A text is its words, A-Z in lower
case, and an end; its first word is scored after a begin.

Defined results: a null text counts as empty (one token, the end); a null id counts as the empty
string when texts are held out; without training texts every token has probability one; with
too few counts for a discount 0.5, 1 and 1.5 are taken; repeated rows are counted and scored
each; an empty table gives an empty table; further columns are ignored.  Words and pairs are
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm import array_store
from pagemill.llm import arrow_text as A
from pagemill.storage import new_folder, write_table

_U = np.uint64
BEGIN, END = _U(0x1B0E6C9A37D5F281), _U(0x7C4A1F93E2B86D05)
BLOCK = 16 << 20
SLICE = 2 << 20
PAIR = _U(0x9E3779B97F4A7C15)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each row, and their bounds."""
    w = A.words(*A.view(column), lower=True)
    return np.insert(w.hash, w.bounds[1:], END), w.bounds + np.arange(len(w.bounds))


def histories(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    before = np.empty_like(found)
    before[1:] = found[:-1]
    before[bounds[:-1]] = BEGIN
    return before


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return A.mix(first * PAIR + second)


def word_parts(words: np.ndarray, bits: int) -> np.ndarray:
    return (words >> _U(64 - bits)).astype(np.int64)


def pair_parts(first: np.ndarray, second: np.ndarray, frequent: np.ndarray, bits: int) -> np.ndarray:
    spread = np.where(np.isin(first, frequent), first ^ A.mix(second), first)
    return word_parts(A.mix(spread), bits)


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys ascending, where each was first, and summed counts."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    at = np.flatnonzero(new)
    return sorted_[at], order[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


def _cells(parts: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """Arrays cut where their (ascending) part changes."""
    at = np.flatnonzero(np.diff(parts, prepend=-1))
    for low, high in zip(at, np.append(at[1:], len(parts)), strict=True):
        yield int(parts[low]), [a[low:high].tobytes() for a in arrays]


def _batch(rows: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*[f.split() for f in schema.split(", ")], strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one part at a time from rows sorted by part."""
    part, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part and rows:
                yield part, rows
                rows = []
            part = row["part"]
            rows.append(row)
    if rows:
        yield part, rows


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Tokens and bounds of slices, gathered to blocks."""
    block, size = [], 0
    for batch in batches:
        for part in A.slices(batch, "text"):
            block.append(tokens(part.column("text")))
            size += len(block[-1][0])
            if size * 6 > BLOCK:  # about six bytes a word
                yield block
                block, size = [], 0
    if block:
        yield block


WORDS = "part int, kind int, words binary, counts binary"
PAIRS = "part int, first binary, sizes binary, second binary, times binary"


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            each = [np.unique(t, return_counts=True) for t, _ in block]
            keys, _, counts = _sum_by(*(np.concatenate(x) for x in zip(*each, strict=True)))
            yield _batch([[p, 0, *x] for p, x in _cells(word_parts(keys, bits), [keys, counts])], WORDS)

    return run


def _merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, rows in _by_part(batches):
        keys, _, counts = _sum_by(
            np.concatenate([np.frombuffer(r["words"], _U) for r in rows]),
            np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows]),
        )
        yield _batch([[part, 0, keys.tobytes(), counts.tobytes()]], WORDS)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.int64)
        yield _batch([[int(counts.sum()), len(counts)]], "tokens long, words long")


def _frequent(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.int64)
            words = np.frombuffer(b"".join(batch.column("words").to_pylist()), _U)
            yield _batch([[int(w)] for w in A.signed(words[counts >= least])], "word long")

    return run


def _count_pairs(bits: int, frequent: np.ndarray):
    """Pairs as rows of first words; a count above 255 is several entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            each = []
            for second, bounds in block:
                first = histories(second, bounds)
                keys, at, times = np.unique(pair_keys(first, second), return_index=True, return_counts=True)
                each.append((keys, first[at], second[at], times))
            keys, first, second, times = (np.concatenate(x) for x in zip(*each, strict=True))
            _, at, times = _sum_by(keys, times)
            first, second = first[at], second[at]
            pieces = -(-times // 255)
            left = np.full(pieces.sum(), 255)
            left[np.cumsum(pieces) - 1] = times - 255 * (pieces - 1)
            first, second = np.repeat(first, pieces), np.repeat(second, pieces)
            part = pair_parts(first, second, frequent, bits)
            order = np.lexsort((first, part))
            part, first, second, left = part[order], first[order], second[order], left[order].astype(np.uint8)
            rows = []
            at = np.flatnonzero(np.diff(part, prepend=-1))
            for low, high in zip(at, np.append(at[1:], len(part)), strict=True):
                own = first[low:high]
                heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                sizes = np.diff(np.append(heads, len(own))).astype(np.int32)
                rows.append([int(part[low]), own[heads].tobytes(), sizes.tobytes(), second[low:high].tobytes(), left[low:high].tobytes()])
            yield _batch(rows, PAIRS)

    return run


def _store_pairs(folder: str, bits: int):
    """Sorted arrays of a partition's pairs; what its words take part in goes on (see kinds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            first = np.concatenate([
                np.repeat(np.frombuffer(r["first"], _U), np.frombuffer(r["sizes"], np.int32)) for r in rows
            ])
            second = np.concatenate([np.frombuffer(r["second"], _U) for r in rows])
            times = np.concatenate([np.frombuffer(r["times"], np.uint8) for r in rows]).astype(np.int64)
            keys, at, counts = _sum_by(pair_keys(first, second), times)
            first, second = first[at], second[at]
            large = np.flatnonzero(counts >= 255)
            for name, array in (
                ("keys", keys), ("small", np.minimum(counts, 255).astype(np.uint8)),
                ("large_at", large), ("large", counts[large]),
            ):
                array_store.save(folder, f"pairs-{part}-{name}.npy", array)
            out = [[0, 3, np.int64(part).tobytes(), np.bincount(np.minimum(counts, 5), minlength=5)[1:5].astype(np.int64).tobytes()]]
            words, of = np.unique(first, return_inverse=True)
            after = np.zeros((len(words), 3), np.int32)
            np.add.at(after, (of, np.minimum(counts, 3) - 1), 1)
            out += [[p, 1, *x] for p, x in _cells(word_parts(words, bits), [words, after])]
            words, before = np.unique(second, return_counts=True)
            out += [[p, 2, *x] for p, x in _cells(word_parts(words, bits), [words, before.astype(np.int32)])]
            yield _batch(out, WORDS)

    return run


COLUMNS = {"count": np.int64, "before": np.int64, "after1": np.uint32, "after2": np.uint32, "after3": np.uint32}
SUMMARY = "part int, before1 long, before2 long, before3 long, before4 long, more long, pairs long, pair1 long, pair2 long, pair3 long, pair4 long, pair_parts binary"


def _store_words(folder: str):
    """Sorted arrays of a partition's words; a row of sums for the discounts and of stored parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            kinds = {k: [r for r in rows if r["kind"] == k] for k in range(4)}
            hashes = {k: [np.frombuffer(r["words"], _U) for r in kinds[k]] for k in range(3)}
            words = np.unique(np.concatenate([np.zeros(0, _U), *[h for k in hashes for h in hashes[k]]]))
            table = {name: np.zeros(len(words), np.int64) for name in COLUMNS}
            for k, names in ((0, ["count"]), (1, ["after1", "after2", "after3"]), (2, ["before"])):
                for row, own in zip(kinds[k], hashes[k], strict=True):
                    values = np.frombuffer(row["counts"], np.int64 if k == 0 else np.int32).reshape(len(own), -1)
                    at = np.searchsorted(words, own)
                    for i, name in enumerate(names):
                        table[name][at] += values[:, i]
            array_store.save(folder, f"words-{part}-words.npy", words)
            for name, kind in COLUMNS.items():
                array_store.save(folder, f"words-{part}-{name}.npy", table[name].astype(kind))
            before = np.bincount(np.minimum(table["before"], 5), minlength=6)
            pairs = np.sum([np.zeros(4, np.int64), *[np.frombuffer(r["counts"], np.int64) for r in kinds[3]]], 0)
            yield _batch([[part, *before[1:6].tolist(), int(table["before"].sum()), *pairs.tolist(), b"".join(r["words"] for r in kinds[3])]], SUMMARY)

    return run


def discounts(n: list[int]) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and more, from how many counts are 1, 2, 3 and 4."""
    if min(n[:3]) <= 0:
        return np.array([0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    raw = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
    return np.array([0.0, *np.clip(raw, 0, [1, 2, 3])])


class Model(NamedTuple):
    folder: str
    bits: int
    frequent: np.ndarray
    tokens: int
    words: int
    pairs: int
    word_discounts: np.ndarray
    pair_discounts: np.ndarray
    left_over: float
    """Share of ``1 / (V + 1)`` in ``p(w)``."""
    parts: dict[str, frozenset[int]]
    """The parts of words and of pairs that are stored; nothing of any other was seen."""


def train(texts: DataFrame) -> Model:
    """The model of the column ``text``; the arrays stay in the shared folder."""
    spark = texts.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(6, (tasks - 1).bit_length())
    folder = new_folder(spark, "kneser-ney")
    source = texts.select(F.col("text").cast("string").alias("text"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "part").sortWithinPartitions("part")

    words = write_table(
        dealt(source.mapInArrow(_count_words(bits), WORDS)).mapInArrow(_merge_words, WORDS), f"{folder}-words"
    )
    sums = words.select("counts").mapInArrow(_totals, "tokens long, words long").agg(F.sum("tokens"), F.sum("words")).first()
    total, known = sums[0] or 0, sums[1] or 0
    found = words.select("words", "counts").mapInArrow(_frequent(total / (4 << bits)), "word long").toArrow()
    frequent = np.append(found.column("word").to_numpy().view(_U), BEGIN)
    pairs = dealt(source.mapInArrow(_count_pairs(bits, frequent), PAIRS)).mapInArrow(_store_pairs(folder, bits), WORDS)
    summary = dealt(pairs.unionByName(words)).mapInArrow(_store_words(folder), SUMMARY).toPandas()
    n = summary.drop(columns=["part", "pair_parts"]).sum()
    parts = {
        "words": frozenset(summary["part"].tolist()),
        "pairs": frozenset(np.frombuffer(b"".join(summary["pair_parts"]), np.int64).tolist()),
    }
    of_words = discounts([int(n[f"before{i}"]) for i in (1, 2, 3, 4)])
    of_pairs = discounts([int(n[f"pair{i}"]) for i in (1, 2, 3, 4)])
    kinds = int(n["pairs"])
    more = int(n["before3"] + n["before4"] + n["more"])
    taken = of_words[1] * n["before1"] + of_words[2] * n["before2"] + of_words[3] * more
    left_over = float(taken / kinds) if kinds else 1.0
    return Model(folder, bits, frequent, int(total), int(known), kinds, of_words, of_pairs, left_over, parts)


class _Reader:
    """The mapped arrays, opened as they are asked for."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def array(self, kind: str, part: int, name: str) -> np.ndarray | None:
        if part not in self.model.parts[kind]:
            return None
        key = f"{kind}-{part}-{name}.npy"
        if key not in self.open:
            self.open[key] = array_store.load(self.model.folder, key)
        return self.open[key]

    def _each_part(self, parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(parts, kind="stable")
        cuts = np.flatnonzero(np.diff(parts[order], prepend=-1))
        for low, high in zip(cuts, np.append(cuts[1:], len(parts)), strict=True):
            yield int(parts[order[low]]), order[low:high]

    def words(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        """Columns of distinct ascending words, 0 where unknown."""
        out = {name: np.zeros(len(keys), np.int64) for name in COLUMNS}
        for part, rows in self._each_part(word_parts(keys, self.model.bits)):
            table = self.array("words", part, "words")
            if table is None or not len(table):
                continue
            at = np.minimum(np.searchsorted(table, keys[rows]), len(table) - 1)
            hit = table[at] == keys[rows]
            for name in COLUMNS:
                out[name][rows[hit]] = self.array("words", part, name)[at[hit]]
        return out

    def pairs(self, first: np.ndarray, second: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Counts of pairs with ascending keys."""
        out = np.zeros(len(keys), np.int64)
        for part, rows in self._each_part(pair_parts(first, second, self.model.frequent, self.model.bits)):
            table = self.array("pairs", part, "keys")
            if table is None or not len(table):
                continue
            at = np.minimum(np.searchsorted(table, keys[rows]), len(table) - 1)
            hit = table[at] == keys[rows]
            at, rows = at[hit], rows[hit]
            counts = self.array("pairs", part, "small")[at].astype(np.int64)
            large = counts == 255
            if large.any():
                where = np.searchsorted(self.array("pairs", part, "large_at"), at[large])
                counts[large] = self.array("pairs", part, "large")[where]
            out[rows] = counts
        return out


def _scores(reader: _Reader, found: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Sums of each row over its tokens."""
    m = reader.model
    first = histories(found, bounds)
    words, of = np.unique(np.append(found, BEGIN), return_inverse=True)
    own = reader.words(words)
    begin, of = of[-1], of[:-1]
    known = own["before"]
    lower = m.left_over / (m.words + 1)
    if m.pairs:
        lower = lower + (known - m.word_discounts[np.minimum(known, 3)]) / m.pairs
    else:
        lower = np.full(len(words), lower)
    total = own["count"].copy()
    total[words == END] = 0
    at_end = np.flatnonzero(words == END)
    total[begin] = own["count"][at_end[0]] if len(at_end) else 0  # as many begins as ends
    taken = sum(m.pair_discounts[i] * own[f"after{i}"] for i in (1, 2, 3))
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(total > 0, taken / total, 1.0)
    keys, at, pair_of = np.unique(pair_keys(first, found), return_index=True, return_inverse=True)
    counts = reader.pairs(first[at], found[at], keys)
    before = of[at - 1]
    before[np.isin(at, bounds[:-1])] = begin
    direct = np.where(counts > 0, (counts - m.pair_discounts[np.minimum(counts, 3)]) / np.maximum(total[before], 1), 0.0)
    each = np.log10(direct + left[before] * lower[of[at]])
    base = np.log10((own["count"] + 0.1) / (m.tokens + 0.1 * (m.words + 1)))
    heads = bounds[:-1]  # no row is without a token
    return {
        "n_tokens": np.diff(bounds), "n_known": np.add.reduceat((own["count"] > 0)[of].astype(np.int64), heads),
        "base_score": np.add.reduceat(base[of], heads), "score": np.add.reduceat(each[pair_of], heads),
    }


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, token counts, ``base_score``, ``score`` (log10) and ``perplexity`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(Model(*shared.value))
        for batch in batches:
            for part in A.slices(batch, "text", SLICE):
                sums = _scores(reader, *tokens(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, sums.values())], names=["id", *sums])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
