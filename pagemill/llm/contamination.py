"""Benchmark decontamination by greedy string tiling.

1. *Seeds.*  Every ``tile`` consecutive words of a benchmark item are a seed, and an item of fewer
   words is one seed as a whole.  One pass over the
   documents keeps, of each text, the words inside windows whose hash is in the bitmap of all
   seeds (fixed size, so the benchmark may be of any size) and the hashes of those windows.
2. *Pairs.*  Document windows and benchmark seeds are joined on the hash; pairs whose shared
   seeds could not cover enough of the item are dropped (an upper bound, nothing is lost).
3. *Tiles.*  For each pair the longest common run of unmarked words is found by Karp-Rabin
   hashing of all windows of a length (the length by bisection), marked on both sides, and the
   search goes on until no common run of ``tile`` words (or of the item's, where it has fewer) is
   left.  Order does not matter, so
   reordered passages are covered like others.
4. Items whose tiles cover at least ``coverage`` of their words contaminate the document.

Words are compared with A-Z in lower case.  Of equally long runs the first in the item, then the
first in the document, is marked.  A task holds one pair's words at a time.

Defined results: null and empty texts and items match nothing; an item of fewer than ``tile``
words matches where all its words follow one another; repeated documents and items are answered row by row; an empty documents or
benchmark table gives an empty result; further columns are ignored by :func:`leaks` and kept by
:func:`clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import arrow_text as A
from pagemill.llm import bitmap
from pagemill.storage import new_folder, write_table

TILE = 5
COVERAGE = 0.5


# --- tiling of one pair -----------------------------------------------------------------------

def _room(free: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Free words from each place on, up to a marked one or a gap."""
    n = len(free)
    stop = np.flatnonzero(~(free[:-1] & free[1:] & joined)) if n > 1 else np.zeros(0, np.int64)
    last = np.append(stop, n - 1)
    ends = last[np.searchsorted(last, np.arange(n))]
    return np.where(free, ends - np.arange(n) + 1, 0)


class _Side:
    def __init__(self, words: np.ndarray, joined: np.ndarray):
        self.words, self.joined = words, joined
        self.free = np.ones(len(words), bool)
        up, self.down = A.powers(len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[:-1], out=self.sums[1:])

    def refresh(self) -> None:
        self.room = _room(self.free, self.joined)

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of unmarked runs of a length."""
        at = np.flatnonzero(self.room >= length)
        return at, (self.sums[at + length] - self.sums[at]) * self.down[at]


def tiles(doc: np.ndarray, at: np.ndarray, item: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """(start in ``doc``, start in ``item``, words) of the tiles; ``at`` are places in the text."""
    left = _Side(doc, np.diff(at) == 1)
    right = _Side(item, np.ones(max(0, len(item) - 1), bool))
    found: list[tuple[int, int, int]] = []
    longest = min(len(doc), len(item))
    while True:
        left.refresh()
        right.refresh()
        longest = min(longest, int(left.room.max(initial=0)), int(right.room.max(initial=0)))
        low, high = shortest - 1, longest
        while low < high:  # a common run of n words holds one of n - 1
            middle = (low + high + 1) // 2
            if np.isin(right.runs(middle)[1], left.runs(middle)[1]).any():
                low = middle
            else:
                high = middle - 1
        if low < shortest:
            return found
        marked = False
        places, hashes = left.runs(low)
        order = np.argsort(hashes, kind="stable")
        places, hashes = places[order], hashes[order]
        for j, h in zip(*right.runs(low), strict=True):
            if not right.free[j : j + low].all():
                continue
            for i in places[np.searchsorted(hashes, h) : np.searchsorted(hashes, h, "right")]:
                if left.free[i : i + low].all() and np.array_equal(doc[i : i + low], item[j : j + low]):
                    left.free[i : i + low] = right.free[j : j + low] = False
                    found.append((int(i), int(j), low))
                    marked = True
                    break
        longest = low if marked else low - 1


# --- the passes -------------------------------------------------------------------------------

def _kept_words(seeds, lengths: list[int], names: list[str], schema: pa.Schema):
    """Words inside windows, of any of the lengths, that are in the bitmap of seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = seeds.value
        for batch in batches:
            for part in A.slices(batch, "text"):
                data, offsets = A.view(part.column("text"))
                w = A.words(data, offsets, lower=True)
                inside = np.zeros(len(w.hash) + 1, np.int64)
                starts, found = [], []
                for length in lengths:
                    grams = A.windows(w.hash, length)
                    if not len(grams):
                        continue
                    start = np.flatnonzero(bitmap.test(bits, grams) & (w.row[: len(grams)] == w.row[length - 1 :]))
                    inside[start] += 1
                    inside[start + length] -= 1
                    starts.append(start)
                    found.append(grams[start])
                if not inside.any():
                    continue
                start, seed = np.concatenate(starts), np.concatenate(found)
                order = np.argsort(start, kind="stable")
                start, seed = start[order], seed[order]
                at = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
                rows = np.unique(w.row[start])
                cut = np.searchsorted(w.row[at], np.append(rows, len(offsets)))
                seed_cut = np.searchsorted(w.row[start], np.append(rows, len(offsets)))
                place = at - w.bounds[w.row[at]]
                kept = part.take(pa.array(rows)).select(names)
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns,
                     A.list_column(A.signed(w.hash[at]), cut, pa.int64()),
                     A.list_column(place, cut, pa.int32()),
                     A.list_column(A.signed(seed), seed_cut, pa.int64())],
                    schema=schema,
                )

    return run


def _item_words(names: list[str], schema: pa.Schema, tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, "text"):
                data, offsets = A.view(part.column("text"))
                w = A.words(data, offsets, lower=True)
                each = [w.hash[w.bounds[r] : w.bounds[r + 1]] for r in range(len(offsets) - 1)]
                grams = [A.windows(h, max(1, min(tile, len(h)))) for h in each]
                bounds = np.cumsum([0, *map(len, grams)])
                yield pa.RecordBatch.from_arrays(
                    [*part.select(names).columns,
                     A.list_column(A.signed(w.hash), w.bounds, pa.int64()),
                     A.list_column(A.signed(np.concatenate(grams)), bounds, pa.int64())],
                    schema=schema,
                )

    return run


def _tiled(tile: int, names: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for i in range(batch.num_rows):
                doc, at, item = (
                    batch.column(c)[i].values.to_numpy() for c in ("words", "at", "item_words")
                )
                runs = tiles(doc.view(np.uint64), at, item.view(np.uint64), min(tile, len(item)))
                sums.append((sum(r[2] for r in runs), len(runs), len(item)))
            covered, n, size = (np.array(x, np.int64) for x in zip(*sums, strict=True)) if sums else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [*batch.select(names).columns, pa.array(covered, pa.int64()), pa.array(n, pa.int64()), pa.array(size, pa.int64())],
                schema=schema,
            )

    return run


def _schema(df: DataFrame, names: list[str], *more: tuple[str, T.DataType]) -> T.StructType:
    fields = [T.StructField(n, df.schema[n].dataType) for n in names]
    return T.StructType([*fields, *[T.StructField(n, t) for n, t in more]])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


LONGS, INTS, LONG = T.ArrayType(T.LongType(), False), T.ArrayType(T.IntegerType(), False), T.LongType()


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id",
    text: str = "text", tile: int = TILE, coverage: float = COVERAGE,
) -> DataFrame:
    """``id, item, tiled_words, n_tiles, item_words, coverage`` of contaminated (row, item) pairs."""
    spark = docs.sparkSession
    source = items.select(F.col(item_col), F.col(text).cast("string").alias("text"))
    kind = _schema(source, [item_col], ("item_words", LONGS), ("grams", LONGS))
    bench = write_table(
        source.mapInArrow(_item_words([item_col], _plain(_arrow(kind)), tile), kind)
        .withColumn("_item", F.monotonically_increasing_id()),
        new_folder(spark, "tiles-items"),
    )
    # how many of an item's words a seed may cover, by how often it occurs in it
    own = F.least(F.lit(tile), F.size("item_words"))
    lengths = sorted(r[0] for r in bench.filter("size(grams) > 0").select(own).distinct().collect())  # at most tile rows
    seeds = bench.select("_item", own.alias("own"), F.explode("grams").alias("seed")).groupBy("seed", "_item").agg(
        F.sum("own").alias("reach")
    )
    bits = spark.sparkContext.broadcast(bitmap.build(seeds, "seed"))
    texts = docs.select(F.col(id_col), F.col(text).cast("string").alias("text"))
    kind = _schema(texts, [id_col], ("words", LONGS), ("at", INTS), ("seeds", LONGS))
    hits = write_table(
        texts.mapInArrow(_kept_words(bits, lengths, [id_col], _plain(_arrow(kind))), kind)
        .withColumn("_doc", F.monotonically_increasing_id()),
        new_folder(spark, "tiles-hits"),
    )
    pairs = (
        hits.select("_doc", F.explode(F.array_distinct("seeds")).alias("seed"))
        .join(seeds, "seed").groupBy("_doc", "_item").agg(F.sum("reach").alias("most"))
    )
    both = (
        pairs.join(hits.select("_doc", id_col, "words", "at"), "_doc")
        .join(bench.select("_item", item_col, "item_words"), "_item")
        .filter(F.col("most") >= F.size("item_words") * coverage)
        .select(id_col, item_col, "words", "at", "item_words")
    )
    kind = _schema(both, [id_col, item_col], ("tiled_words", LONG), ("n_tiles", LONG), ("item_words", LONG))
    return (
        both.mapInArrow(_tiled(tile, [id_col, item_col], _plain(_arrow(kind))), kind)
        .withColumn("coverage", F.col("tiled_words") / F.col("item_words"))
        .filter(F.col("coverage") >= coverage)
    )


def _plain(schema: pa.Schema) -> pa.Schema:
    """Without nullability, which Spark reads from its own schema."""
    return pa.schema([pa.field(f.name, pa.list_(f.type.value_type) if pa.types.is_list(f.type) else f.type) for f in schema])


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that an item contaminates; a verdict depends on the text alone."""
    key = F.struct(F.md5(F.col(text)), F.octet_length(text))
    keyed = docs.select(key.alias("_key"), F.col(text).alias("text"))
    found = leaks(keyed, items, id_col="_key", text="text", **options).select("_key").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = docs.select(key.alias("_key"), row.alias("_row")).join(found, "_key", "left_anti")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
