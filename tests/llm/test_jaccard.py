"""Near-copy components against all pairs compared, on texts near the threshold."""

import random

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill import storage
from pagemill.llm import jaccard, queries
from pagemill.llm.components import components


def shingles(text, k=3):
    w = plain.words(text, True)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, threshold=90):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= threshold * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= threshold * (len(a) + len(b) - both):
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(
        (str(d), len(s), str(least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))
    )


def result(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit(1)).withColumn("n", F.lit("x"))
    out = jaccard.near_components(docs).collect()
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out)


def corpus(seed, n=250):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the"] * 100
    bases = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 12, 30, 40, 80, 200]))] for _ in range(30)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 1 + max(1, len(text) // 25))):  # around 0.9
            at = rng.randrange(len(text))
            if rng.random() < 0.5:
                text[at] = rng.choice(words)
            elif len(text) > 1:
                del text[at]
        rows.append((i, " ".join(text) if i % 7 else "\n".join(text).upper()))
    return rows


def test_components_match_all_pairs(spark):
    odd = [(900, None), (901, ""), (902, " \t"), (None, "a b c d"), (None, "q r s t u"), (903, "A b C d"), (904, "a"), (905, "A"), (906, "a a"), (907, "x " * 9000), (908, "x " * 20), (12, "a b c d e")]
    rows = [*corpus(1), *odd]
    random.Random(3).shuffle(rows)
    assert result(spark, rows) == brute(rows)


def test_one_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 8)
    monkeypatch.setattr(jaccard, "QUERIES", 16)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(260):
        text = list(base)
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(len(text))] = f"e{rng.randrange(40)}"
        rows.append((1000 - i, " ".join(text)))
    assert result(spark, rows) == brute(rows)


def test_identical_parts_are_never_missing():
    tops = jaccard.size_bands(90)
    counts = jaccard.part_counts(tops, 90)
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(1, 1 << 62, rng.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: max(1, int(len(a) * rng.uniform(0.88, 1)))], rng.integers(1, 1 << 62, rng.integers(0, 1 + len(a) // 9), dtype=np.uint64)]))
        values, bounds = jaccard.part_hashes([a, b], tops, counts)
        if jaccard.linked(a, b, 90) and not np.array_equal(a, b):
            assert np.intersect1d(values[: bounds[1]], values[bounds[1] :]).size


def test_empty_parts_are_left_out_without_loss():
    tops = jaccard.size_bands(80)
    needed = jaccard.part_counts(tops, 80)
    spare = jaccard.spare_parts(needed, 80)
    assert not jaccard.spare_parts(jaccard.part_counts(jaccard.size_bands(90), 90), 90).any()
    rng = np.random.default_rng(2)

    def drawn(n):
        return rng.integers(1, 1 << 62, n, dtype=np.uint64)

    for _ in range(400):
        a = np.unique(drawn(rng.integers(1, 300)))
        b = np.unique(np.concatenate([rng.permutation(a)[: max(1, int(len(a) * rng.uniform(0.78, 1)))], drawn(rng.integers(0, 1 + len(a) // 5))]))
        values, bounds = jaccard.part_hashes([a, b], tops, needed + spare, spare)
        if jaccard.linked(a, b, 80) and not np.array_equal(a, b):
            assert np.intersect1d(values[: bounds[1]], values[bounds[1] :]).size
    apart = [np.unique(drawn(400)) for _ in range(60)]
    values, _ = jaccard.part_hashes(apart, tops, needed + spare, spare)
    assert len(np.unique(values)) > 0.99 * len(values)
    before, _ = jaccard.part_hashes(apart, tops, needed)
    assert len(np.unique(before)) < 0.995 * len(before) and len(values) < 1.1 * len(before)


def test_sketches_never_bound_too_low():
    rng = np.random.default_rng(7)

    def drawn(n):
        return np.unique(rng.integers(1, 1 << 62, n, dtype=np.uint64))

    alike = np.unique((rng.integers(1, 1 << 40, 4000, dtype=np.uint64) << np.uint64(20)) + np.uint64(3))  # one bucket
    for _ in range(300):
        a = drawn(rng.integers(1, 2000))
        b = np.unique(np.concatenate([rng.permutation(a)[: rng.integers(1, len(a) + 1)], drawn(rng.integers(1, 900))]))
        both = len(np.intersect1d(a, b))
        assert jaccard.overlap_bound(jaccard.sketch(a), jaccard.sketch(b)) >= both
    assert jaccard.overlap_bound(jaccard.sketch(alike), jaccard.sketch(alike[:3000])) >= 3000
    apart = [jaccard.overlap_bound(jaccard.sketch(drawn(400)), jaccard.sketch(drawn(400))) for _ in range(200)]
    assert max(apart) * 180 < 80 * 800  # sets with nothing in common do not pass


def test_one_of_each_stays(spark):
    rows = [*corpus(2, 80), (150, "b c d e f"), (150, "b c d e f"), (None, "b c d e f"), (None, "n n n m"), (None, "N n n m"), (200, None), (201, ""), (202, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit(1))
    out = jaccard.one_each(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    groups = {c for d, n, c in brute([r for r in rows if r[0] is not None]) if n}
    assert sorted(d for d in kept if d is not None and d < 200) == sorted(int(c) for c in groups)
    assert kept.count(None) == 1 and {200, 201, 202} <= set(kept)


def test_columns_of_any_name_stay(spark):
    names = ["_class", "_stays", "_kept_id", "_row", "_id", "class", "x.y"]
    texts = ["a b c d e f"] * 3 + ["g h i j k l", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.col("doc_id")))
    out = jaccard.one_each(docs)
    assert out.columns == docs.columns
    rows = sorted(tuple(r) for r in out.select("doc_id", *[F.col(f"`{n}`") for n in names]).collect())
    assert rows == [(i, *[f"{n}{i}" for n in names]) for i in (0, 3, 4)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_components(docs).count() == 0
    assert jaccard.one_each(docs).count() == 0


def test_python_gets_texts_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, held in (("1000", 1000), ("1g", storage.BATCH_BYTES), ("64m", storage.BATCH_BYTES)):
            spark.conf.set(key, given)
            if given == "64m":
                jaccard.near_components(spark.createDataFrame([], "doc_id long, text string"))
            else:
                storage.bounded_batches(spark)
            assert int(spark.conf.get(key).rstrip("b")) == held
    finally:
        spark.conf.set(key, before)


def test_classes_move_only_to_groups_that_share_a_part(spark, monkeypatch):
    cells = [(1, 10), (1, 20), (2, 30), (2, 31), (3, 11), (3, 12)]  # (part, class); hubs have no say here
    rows = [(p, c, c, 100, 2) for p, c in cells]
    table = spark.createDataFrame(rows, "part long, class long, component long, n long, shared_by long")
    tokens = list(range(1, 101))
    sets = spark.createDataFrame([
        (c, 100, 1, jaccard.sketch(np.arange(1, 101, dtype=np.uint64)), tokens) for c in sorted({c for _, c in cells})
    ], "class long, n long, least long, sketch binary, tokens array<long>")
    tables = {}

    def kept(df, path):
        name = path.rsplit("/", 1)[-1].rsplit("-", 1)[0]
        tables[name] = storage.write_table(df, path)
        return tables[name]

    monkeypatch.setattr(jaccard, "write_table", kept)
    found = {tuple(sorted(r)) for r in jaccard._matrix_links(table, sets, 90).collect()}
    assert {(10, 20), (30, 31), (11, 12)} <= found
    group = {r["class"]: r["group"] for r in tables["jaccard-groups"].collect()}
    shares = {(c, group[d]) for p, c in cells for q, d in cells if p == q}
    moved = tables["jaccard-pairs"].collect()
    assert moved
    for r in moved:
        assert group[r["class"]] == r["group" if r["asks"] else "to_group"]
        assert (r["class"], r["to_group" if r["asks"] else "group"]) in shares


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, 7), (101, 102)]])
def test_components_of_chains_and_stars(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e}
    want = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_query_covers_all_documents(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf_dir, "documents").collect()]
    out = queries.near_copies(spark, sf_dir).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in out) == brute(docs)


def test_only_texts_with_enough_in_common_are_paired(spark, monkeypatch):
    """A family of texts, too far apart to link, whose pairs all share parts; some copies among them link."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(300)]
    tables = {}

    def kept(df, path):
        tables.setdefault(path.rsplit("/", 1)[-1].rsplit("-", 1)[0], []).append(storage.write_table(df, path))
        return tables[path.rsplit("/", 1)[-1].rsplit("-", 1)[0]][-1]

    monkeypatch.setattr(jaccard, "write_table", kept)
    rows = []
    for i in range(150):
        text = list(base)
        for at in rng.sample(range(300), 14):
            text[at] = f"e{i}x{at}"
        rows.append((i, " ".join(text)))
    rows += [(200 + i, t + " more") for i, t in rows[:5]] + [(300 + i, t) for i, t in rows[:3]]
    assert result(spark, rows) == brute(rows)
    assert max(t.count() for t in tables["jaccard-reach"]) <= 10  # the five that link, with their partners
    pairs = tables["jaccard-pairs"][-1]
    assert pairs.count() == pairs.distinct().count() <= 20


def test_common_tokens_are_never_too_few():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(1, 1 << 62, 50, dtype=np.uint64) << np.uint64(2)) for _ in range(40)]
    sets += [np.unique(np.concatenate([sets[i][:20], sets[i + 1][:7]])) for i in range(0, 40, 2)]
    keys = jaccard.class_keys(sets)
    from_tasks = [list(jaccard._packed_tokens(lambda batch, seen: iter(batch), 3)([[(some, None)]])) for some in (sets[:30], sets[30:])]
    records = [r for found in from_tasks for b in found for r in b.to_pylist()]
    bits = np.zeros(1 << 20, np.uint64)
    for k in range(3):
        of = [r for r in records if r["range"] == k]
        for found in jaccard._repeated(26)(pa.Table.from_pylist(of)).to_pylist():
            words = np.frombuffer(found["words"], "<u8")
            bits[found["first"] : found["first"] + len(words)] |= words
    found = jaccard.common_tokens(bits, sets)
    every, times = np.unique(np.concatenate(sets), return_counts=True)
    want = [int((times[np.searchsorted(every, s)] > 1).sum()) for s in sets]
    assert len(keys) == len(found) and all(f >= w for f, w in zip(found, want, strict=True))
    assert sum(found) <= sum(want) + 2
