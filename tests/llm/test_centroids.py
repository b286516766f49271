"""Centroid clustering against plain Python."""

import hashlib
import math

import compare
import numpy as np
import pytest

from pagemill.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k=40, rounds=5, dim=64):
    kept = [
        (i, [math.floor(256 * x) for x in v]) for i, v in rows
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(assign(v)[1], []).append(v)
        centers = [
            [sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centers)
        ]
    found = [(i, *assign(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    own = {}
    for _, c, d in found:
        own[c] = own.get(c, 0) + d
    return sorted(
        ((i, c, d, own[c], total, centroids.digest(centers[c])) for i, c, d in found), key=lambda r: (r[0] is None, r)
    )


def test_query_matches_plain(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in queries.table(spark, sf_dir, "embeddings").collect()]
    got = queries.centroid_clusters(spark, sf_dir)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_query_matches_oracle(spark, sf_dir):
    name, con = "op12_centroid_clusters", compare.connect(sf_dir)
    assert compare.difference(spark, con, queries.QUERIES[name], queries.ORACLES[name], sf_dir) is None


def frame(spark, rows, dim, **options):
    out = centroids.cluster(spark.createDataFrame(rows, SCHEMA), dim=dim, **options).collect()
    return sorted(
        ((*list(r)[:-1], centroids.digest(r["centroid"])) for r in out), key=lambda r: (r[0] is None, r)
    )


def test_left_out_ties_repeats_and_null_ids(spark):
    rows = [
        (1, [0.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (None, [0.25, 0.75]), (None, [0.0, 0.0]),
        (3, [0.5]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 0.0]), (7, [float("inf"), 0.0]), (8, [-0.001, -2.0]),
        (9, []),
    ]
    for k in (1, 2, 3, 40):
        assert frame(spark, rows, 2, k=k) == plain(rows, k, 5, 2)


def test_many_equal_vectors_and_a_far_one(spark):
    rows = [(i, [0.5] * 4) for i in range(300)] + [(500 + i, [i / 7, -i / 3, 0.0, 8000.0 * (i % 2)]) for i in range(60)]
    rows += [(900, [300000.0, -300000.0, 1.0, 2.0])]
    assert frame(spark, rows, 4, k=7, rounds=3) == plain(rows, 7, 3, 4)


def test_search_equals_full_comparison():
    r = np.random.default_rng(1)
    for spread, shift in ((3, 0), (200, 50), (1 << 20, 0), (1 << 26, 0)):
        c = r.integers(-spread, spread, (23, 16)) + shift
        c[5] = c[3]
        x = np.concatenate([r.integers(-spread, spread, (500, 16)), c[::2]])
        every = ((x[:, None, :] - c[None]) ** 2).sum(2)
        who, distance = centroids.nearest(x, centroids.book_of(c.tolist()))
        assert (who == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_rejections_spare_comparisons():
    # far apart sums: only the own centroid is compared
    c = [[100 * i] * 8 for i in range(50)]
    x = np.array(c) + 1
    who, distance = centroids.nearest(x, centroids.book_of(c))
    assert (who == np.arange(50)).all() and (distance == 8).all()


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", id string, x int, cluster int, distance string")
    assert centroids.cluster(empty).count() == 0
    rows = spark.createDataFrame([(1, [1.0, 2.0], "a", 1, 2, "b")], empty.schema)
    assert [tuple(r)[:3] for r in centroids.cluster(rows, dim=2).collect()] == [(1, 0, 0)]


def test_too_large_components_raise(spark):
    with pytest.raises(Exception, match="may not fit a long"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 0.0])], SCHEMA), dim=2)
