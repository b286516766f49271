"""Centroid clustering with an equal-average equal-variance search.

Vectors become integers once, ``floor(scale * x)``, and every step after that is exact.  A vector
looks for its nearest centroid among centroids sorted by component sum, outward from its own sum.
With S the sums, d the length and V the root of the summed squared deviations from the mean,

    distance >= (S_x - S_c)^2 / d + (V_x - V_c)^2,

so a direction is left as soon as the first term alone is above the best distance, and a centroid
is passed over when both are; what remains is compared in integers.  A bound must be above the
best distance by more than its rounding, so ties reach the integers too.

Tasks add up the integer vectors of each centroid and hand on one row for each; Spark adds those
up, and the driver only ever sees centroids: ``k`` rows of ``dim`` sums.  A round is one scan of
the integer table, without a shuffle of vectors.  The table is written, so a lost executor repeats
its own part only.

Defined results: vectors of another length, null vectors and those with a null, infinite or NaN
component are left out.  Repeated ids are vectors of their own; equal hashes (equal or null ids,
null hashing as an empty number) are ordered by components.  Fewer than ``k`` vectors give as many
centroids; an empty table gives an empty one.  A centroid without vectors stays where it is.
Further columns are ignored.  An integer of 2**27 or more, with which a squared distance might not
fit a long, raises an error; from 2**21 on the bounds are not used, as their rounding would count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.storage import new_folder, write_table

CENTROIDS = 40
ROUNDS = 5
DIM = 64
SCALE = 256
SEED = 2
LARGEST = 1 << 27
EXACT_BOUNDS = 1 << 21
"""Below this, sums of squares of ``dim`` components times ``dim`` are exact in 64 bits."""
SLACK = 1.0
ROWS = 1 << 12


class Book(NamedTuple):
    """Centroids in the order of their sums."""

    number: np.ndarray
    vector: np.ndarray
    total: np.ndarray
    spread: np.ndarray
    bounded: bool
    """Whether the bounds hold: no component is too large for them."""


def _spread(x: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Root of the summed squared deviations from the mean."""
    d = x.shape[1]
    return np.sqrt(np.maximum(d * (x * x).sum(1) - total * total, 0) / d)


def book_of(centroids: list[list[int]]) -> Book:
    vectors = np.array(centroids, np.int64).reshape(len(centroids), len(centroids[0]) if centroids else 1)
    total = vectors.sum(1)
    order = np.argsort(total, kind="stable")
    vectors, total = vectors[order], total[order]
    return Book(order, vectors, total, _spread(vectors, total), bool(np.abs(vectors).max(initial=0) < EXACT_BOUNDS))


def nearest(x: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid (the smaller of equally near ones), and the squared distance."""
    n, k = len(x), len(book.total)
    total = x.sum(1)
    spread = _spread(x, total)
    bounded = np.abs(x).max(1, initial=0) < EXACT_BOUNDS if book.bounded else np.zeros(n, bool)
    best = np.full(n, np.iinfo(np.int64).max)
    who = np.full(n, k)
    up = np.searchsorted(book.total, total)
    sides = [(1, up.copy(), up < k), (-1, up - 1, up > 0)]
    while any(live.any() for _, _, live in sides):
        for step, at, live in sides:
            rows = np.flatnonzero(live)
            c = at[rows]
            apart = (total[rows] - book.total[c]).astype(float) ** 2 / x.shape[1]
            limit = np.where(bounded[rows], best[rows] + SLACK, np.inf)
            near = apart <= limit
            live[rows[~near]] = False
            rows, c, apart, limit = rows[near], c[near], apart[near], limit[near]
            at[rows] += step
            live[rows] = (at[rows] >= 0) & (at[rows] < k)
            near = apart + (spread[rows] - book.spread[c]) ** 2 <= limit
            rows, c = rows[near], c[near]
            off = x[rows] - book.vector[c]
            distance = np.einsum("ij,ij->i", off, off)
            number = book.number[c]
            better = (distance < best[rows]) | ((distance == best[rows]) & (number < who[rows]))
            rows = rows[better]
            best[rows], who[rows] = distance[better], number[better]
    return who, best


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _blocks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for low in range(0, batch.num_rows, ROWS):
        part = batch.slice(low, ROWS)
        yield part, _matrix(part.column("x"), dim)


def integers(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``id, x`` of the vectors that are kept, x an array of integers."""
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column("v")), -1)
            batch = batch.filter(pc.equal(size, dim))
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
            finite = np.isfinite(values).all(1)
            whole = np.floor(scale * values[finite])
            if (np.abs(whole) >= LARGEST).any():
                raise OverflowError(f"a component times {scale} is not below {LARGEST}: distances may not fit a long")
            ids = batch.column("id").filter(pa.array(finite))
            bounds = np.arange(len(whole) + 1, dtype=np.int32) * dim
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(whole.astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([ids, lists], names=["id", "x"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, x array<int>")


def first_centroids(whole: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The ``k`` vectors whose ids have the smallest hashes."""
    number = F.coalesce(F.col("id").cast("string"), F.lit(""))
    hashed = whole.select(F.sha2(F.concat(F.lit(f"{seed}:"), number), 256).alias("h"), "x")
    return [list(r["x"]) for r in hashed.orderBy("h", "x").limit(k).collect()]


def moved(whole: DataFrame, centroids: list[list[int]], dim: int = DIM) -> list[list[int]]:
    """One round: every centroid at the floor of the mean of the vectors nearest to it."""
    book = book_of(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), dim + 1), np.int64)
        for batch in batches:
            for _, x in _blocks(batch, dim):
                who, _ = nearest(x, book)
                order = np.argsort(who, kind="stable")
                first = np.flatnonzero(np.diff(who[order], prepend=-1))
                if len(first):
                    at = who[order[first]]
                    sums[at, :dim] += np.add.reduceat(x[order], first)
                    sums[at, dim] += np.diff(np.append(first, len(who)))
        some = np.flatnonzero(sums[:, dim])
        bounds = np.arange(len(some) + 1, dtype=np.int32) * (dim + 1)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(sums[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), lists], names=["cluster", "sums"])

    parts = whole.mapInArrow(run, "cluster int, sums array<long>")
    totals = (
        parts.select("cluster", F.posexplode("sums").alias("place", "value"))
        .groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    )
    found: dict[int, dict[int, int]] = {}
    for r in totals.collect():  # at most k * (dim + 1) rows
        found.setdefault(r["cluster"], {})[r["place"]] = int(r["value"])
    return [
        [found[c][i] // found[c][dim] for i in range(dim)] if c in found else old
        for c, old in enumerate(centroids)
    ]


def assigned(whole: DataFrame, centroids: list[list[int]], dim: int = DIM) -> DataFrame:
    """``id, cluster, distance`` of every vector."""
    book = book_of(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _blocks(batch, dim):
                who, distance = nearest(x, book)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(who.astype(np.int32)), pa.array(distance)],
                    names=["id", "cluster", "distance"],
                )

    kind = whole.schema["id"].dataType.simpleString()
    return whole.mapInArrow(run, f"id {kind}, cluster int, distance long")


def cluster(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, id_col: str = "vec_id",
    vector: str = "embedding", dim: int = DIM, scale: int = SCALE, seed: int = SEED,
) -> DataFrame:
    """The id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid`` of every kept vector."""
    spark = vectors.sparkSession
    whole = write_table(integers(vectors, id_col, vector, dim, scale), new_folder(spark, "integers"))
    centroids = first_centroids(whole, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(whole, centroids, dim)
    placed = write_table(assigned(whole, centroids, dim), new_folder(spark, "assigned"))
    inertia = {
        r["cluster"]: int(r["d"])
        for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    }
    # a row for each centroid
    about = spark.createDataFrame(
        [(c, d, sum(inertia.values()), centroids[c]) for c, d in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>",
    )
    return placed.join(F.broadcast(about), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )


def digest(centroid: list[int]) -> str:
    """What the digest of a centroid is taken of and its hash."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
