"""N-gram Jaccard self-join by a token-group matrix.

Every text becomes the set of hashes of its word shingles.  Texts with equal sets form a class
that is handled once.  Classes are partitioned into groups of similar sets (around the same hub,
cut into blocks of about ``GROUP``); a group holds the union of its members' tokens, by bucket.
A query can only link into a group if the union holds ``threshold`` percent of its tokens, so a
group is opened, and its members compared exactly, only when that bound is met.

Which (query, group) pairs are worth a look follows from counting, without loss: two sets of at
most y tokens that link differ in at most ``d = 2 y (100 - t) / (100 + t)`` tokens, so of
``d + 1`` parts into which tokens are hashed at least one is identical in both.  A set therefore
carries the hashes of its parts (for the sizes its partners may have), and the matrix has a cell
for each (part hash, group) with more than one class.  Parts without a token agree in sets
that have nothing in common; at low thresholds, where they are many, there are ``m`` more parts:
sets that link and agree in empty parts alone have more than ``m``, so a set of at most ``m``
leaves its empty parts out.

Tokens of a set move only where a link is possible.  Every candidate has a sketch, a byte for each
of about half as many buckets as tokens, which counts the tokens of the bucket; two sets have at
most the sum of the smaller counts in common.  A group's union has, of every bucket, the largest
count of any member: that bounds what it can share with a query, and the members' sketches bound
each of them.

Order of work, each step a Spark job over written tables:

1. scan: set size and class of every document;
2. scan: tokens that occur more than once, as a bitmap; they travel packed, without their classes,
   and sorted by range.  Two sets that link have ``threshold`` percent of the larger one in common,
   so a set with fewer tokens in that bitmap links with nothing and is left out of all that follows;
3. scan: parts of the sets that are left, with their classes; those of several classes are kept;
4. scan: token sets and sketches of just those classes; of these the tokens are counted once more,
   which tells for each class how large a set it may still link with (``most``);
5. *home*: classes with the same smallest token are compared within blocks, and with the first
   class of all those blocks;
6. *hubs*: of the classes that share a part, each is compared with the one whose parts are shared
   most; a very large group of near copies becomes one component here, at linear cost;
7. *matrix*: cells whose classes already are one component are dropped (no further link can
   change the result), queries meet the remaining groups, the bounds are tested, groups opened;
8. components of all links.

Nothing is capped: blocks only bound what a task holds.  Shingles and classes are 64-bit hashes.

Defined results: A-Z compare as a-z; a text of fewer words than a shingle has is one shingle; a
text without words is empty, is linked with nothing and is its own component; a null id takes
part but is never the smallest; repeated rows are answered row by row; an empty table gives an
empty table; further columns are ignored by :func:`near_components` and kept by :func:`one_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import arrow_text as A
from pagemill.llm import bitmap
from pagemill.llm.components import components
from pagemill.storage import bounded_batches, buckets_once, new_folder, write_table

SHINGLE = 3
THRESHOLD = 90
GROUP = 64
QUERIES = 256
HUB_ROUNDS = 1
KEPT_BYTES = 5
"""Bytes of a token that the first pass compares: chance equality lets a token through, none is lost."""
TOKEN_BITS = 29
"""The bitmap of tokens has at most 2 to this many bits, 64 MB; a fuller one lets more classes through."""
PACKED = 1 << 21
"""Tokens of a record, and of a range, or about so many."""
_U = np.uint64


# --- sets and their parts ---------------------------------------------------------------------

def token_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    w = A.words(data, offsets, lower=True)
    grams = A.windows(w.hash, shingle)
    out = []
    for r in range(len(offsets) - 1):
        first, last = w.bounds[r], w.bounds[r + 1]
        n = last - first
        if n >= shingle:
            out.append(np.unique(grams[first : last - shingle + 1]))
        elif n:
            out.append(A.mix(A.windows(w.hash[first:last], n) + _U(n)))
        else:
            out.append(np.zeros(0, _U))
    return out


def size_bands(threshold: int) -> np.ndarray:
    """Largest size of each band: partners of a set are in its own band or the next one up."""
    tops = [1]
    while tops[-1] < 1 << 40:
        tops.append(max(tops[-1] + 1, tops[-1] * 100 // threshold))
    return np.array(tops)


def part_counts(tops: np.ndarray, threshold: int) -> np.ndarray:
    """One more part than linked sets of a band can differ in tokens."""
    return 2 * tops * (100 - threshold) // (100 + threshold) + 1


def spare_parts(counts: np.ndarray, threshold: int) -> np.ndarray:
    """Parts to add, about as many as small sets leave empty; none where these are rare."""
    tokens = (100 + threshold) / (2 * max(1, 100 - threshold)) * (threshold / 100) ** 2  # a part, at least
    empty = np.exp(-tokens)
    return np.ceil(empty * counts + np.sqrt(empty * counts)).astype(np.int64) * ((empty > 0.01) & (counts > 1))


def part_hashes(
    sets: list[np.ndarray], tops: np.ndarray, counts: np.ndarray, spare: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Part hashes of every set, for its own band and the next, and their bounds.

    ``spare`` of the ``counts`` parts are more than needed: a set leaves out its empty parts if
    there are no more of them than that.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets) if len(sets) else np.zeros(0, _U)
    spread = A.mix(tokens ^ _U(0x5851F42D4C957F2D))
    own = np.searchsorted(tops, sizes)
    found, widths = [], []
    for step in (0, 1):
        band = own + step
        k = np.where((sizes > 0) & (counts[band] > 1), counts[band], 0)
        base = np.concatenate([[0], np.cumsum(k)])
        keep = np.repeat(k > 0, sizes)
        at = np.repeat(base[:-1], sizes)[keep]
        part = ((spread[keep] >> _U(32)) * np.repeat(k, sizes)[keep].astype(_U)) >> _U(32)
        sums = np.zeros(base[-1], _U)
        np.add.at(sums, at + part.astype(np.int64), tokens[keep])
        place = np.arange(base[-1]) - np.repeat(base[:-1], k)
        salt = A.mix(np.repeat(band, k).astype(_U) * _U(1 << 32) + place.astype(_U))
        values = A.mix(sums ^ salt)
        if spare is not None:
            owner = np.repeat(np.arange(len(k)), k)
            empty = np.bincount(at + part.astype(np.int64), minlength=base[-1]) == 0
            few = np.bincount(owner[empty], minlength=len(k)) <= spare[band]
            kept = ~(empty & few[owner])
            values, k = values[kept], np.bincount(owner[kept], minlength=len(k))
            base = np.concatenate([[0], np.cumsum(k)])
        found.append((values, base))
        widths.append(k)
    bounds = np.concatenate([[0], np.cumsum(widths[0] + widths[1])])
    out = np.zeros(bounds[-1], _U)
    for (values, base), shift in zip(found, (np.zeros_like(widths[0]), widths[0]), strict=True):
        k = np.diff(base)
        out[np.arange(len(values)) - np.repeat(base[:-1], k) + np.repeat(bounds[:-1] + shift, k)] = values
    return out, bounds


def class_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Equal sets, equal keys."""
    return A.mix(np.array([int(A.mix(s).sum()) + len(s) & 0xFFFFFFFFFFFFFFFF for s in sets], _U))


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < threshold * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


class _Union:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (up := self.parent.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.parent[p] = x
        return x

    def join(self, x: int, y: int) -> None:
        self.parent[self.root(x)] = self.root(y)


# --- passes -----------------------------------------------------------------------------------

def _describe(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, "text"):
                sets = token_sets(*A.view(part.column("text")), shingle)
                empty = np.array([len(s) == 0 for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(A.signed(class_keys(sets)), mask=empty)],
                    names=["id", "n", "class"],
                )

    return run


def _classes_of(shingle: int):
    """A function from a batch to its sets and their keys, each class once a task if it can be told."""

    def classes(batch: pa.RecordBatch, seen: set[int]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        for some in A.slices(batch, "text"):
            sets = token_sets(*A.view(some.column("text")), shingle)
            keys = class_keys(sets)
            rows = [r for r in range(len(sets)) if len(sets[r]) and not (int(keys[r]) in seen or seen.add(int(keys[r])))]
            if len(seen) > 1 << 20:
                seen.clear()  # it only spares work
            if rows:
                yield [sets[r] for r in rows], keys[rows]

    return classes


def _stored(batch: pa.RecordBatch, seen: set[int]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The sets and keys of a batch of the table of sets."""
    rows = list(_rows(pa.Table.from_batches([batch])))
    if rows:
        yield [s for _, s, _ in rows], np.array([c for c, _, _ in rows], np.int64).view(_U)


def _packed_tokens(classes, ranges: int):
    """The high ``KEPT_BYTES`` bytes of the tokens of sets, without their classes, by range.

    Of a record's tokens two copies show that there are several, so no range grows with a common one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            values = np.sort(np.concatenate(held))
            values = np.concatenate([values[:2], values[2:][values[2:] != values[:-2]]])
            at = ((values >> _U(32)) * _U(ranges)) >> _U(32)
            first = np.flatnonzero(np.diff(at.astype(np.int64), prepend=-1))
            raw = values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES]
            bounds = KEPT_BYTES * np.append(first, len(values))
            return pa.RecordBatch.from_arrays(
                [pa.array(at[first].astype(np.int32)), A.binary_column(raw.ravel(), bounds)], names=["range", "kept"]
            )

        for batch in batches:
            for sets, _ in classes(batch, seen):
                held.extend(sets)
                size += sum(map(len, sets))
                if size > PACKED:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _repeated(bits: int):
    """The bitmap words, from the first to the last, of tokens that occur more than once in a range."""

    def run(table: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(table.column("kept").to_pylist()), np.uint8).reshape(-1, KEPT_BYTES)
        whole = np.zeros((len(raw), 8), np.uint8)
        whole[:, :KEPT_BYTES] = raw
        values = np.sort(whole.view(">u8").ravel().astype(_U))
        again = np.unique(values[1:][values[1:] == values[:-1]] >> _U(64 - bits))
        if not len(again):
            return pa.table({"first": pa.array([], pa.int64()), "words": pa.array([], pa.binary())})
        words, at = np.unique((again >> _U(6)).astype(np.int64), return_index=True)
        dense = np.zeros(words[-1] - words[0] + 1, "<u8")
        dense[words - words[0]] = np.bitwise_or.reduceat(_U(1) << (again & _U(63)), at)
        return pa.table({"first": pa.array([words[0]], pa.int64()), "words": pa.array([dense.tobytes()], pa.binary())})

    return run


def common_tokens(bits: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """At least as many tokens as each set (none is empty) has in common with any others."""
    sizes = np.array([len(s) for s in sets])
    return np.add.reduceat(bitmap.test(bits, np.concatenate(sets)).astype(np.int64), np.cumsum(sizes) - sizes)


def _candidate_parts(shared, classes, threshold: int):
    """The parts of those sets that have ``threshold`` percent of their tokens in common with others."""
    tops = size_bands(threshold)
    counts = part_counts(tops, threshold)
    spare = spare_parts(counts, threshold)
    counts = counts + spare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        seen: set[int] = set()
        for batch in batches:
            for sets, keys in classes(batch, seen):
                may = 100 * common_tokens(bits, sets) >= threshold * np.array([len(s) for s in sets])
                if may.any():
                    values, bounds = part_hashes(
                        [sets[r] for r in np.flatnonzero(may)], tops, counts, spare if spare.any() else None
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(A.signed(values)), pa.array(A.signed(np.repeat(keys[may], np.diff(bounds))))],
                        names=["part", "class"],
                    )

    return run


def _reach(shared, threshold: int):
    """The sets that may still link, with the size of the largest set that they may link with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for sets, keys in _stored(batch, set()):
                size, common = np.array([len(s) for s in sets]), common_tokens(bits, sets)
                may = 100 * common >= threshold * size
                most = (100 + threshold) * common // threshold - size
                yield pa.RecordBatch.from_arrays(
                    [pa.array(A.signed(keys[may])), pa.array(most[may].astype(np.int64))], names=["class", "most"]
                )

    return run


# --- sketches: how many tokens of a set fall into each bucket ---------------------------------

def sketch(tokens: np.ndarray) -> bytes:
    """A byte for each of about half as many buckets as tokens; 255 stands for that many or more."""
    buckets = max(16, 1 << max(0, int(len(tokens) - 1).bit_length() - 1))
    return np.minimum(np.bincount((tokens & _U(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def _folded(counts: np.ndarray, buckets: int) -> np.ndarray:
    """The sketch over fewer buckets, with 65535 for a count that is not known."""
    wide = counts.astype(np.int64)
    wide[wide == 255] = 65535
    return np.minimum(wide.reshape(-1, buckets).sum(0), 65535)


def overlap_bound(a: bytes, b: bytes) -> int:
    """At least as many tokens as the sets of two sketches have in common."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    buckets = min(len(x), len(y))
    return int(np.minimum(_folded(x, buckets), _folded(y, buckets)).sum())


def _sets_of(shared, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            for part in A.slices(batch, "text"):
                sets = token_sets(*A.view(part.column("text")), shingle)
                keys = class_keys(sets)
                rows = [
                    r for r in np.flatnonzero(bitmap.test(bits, keys))
                    if len(sets[r]) and not (int(keys[r]) in seen or seen.add(int(keys[r])))
                ]
                if len(seen) > 1 << 20:
                    seen.clear()  # it only spares work
                chosen = [sets[r] for r in rows]
                if chosen:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(A.signed(keys[rows])), pa.array([len(s) for s in chosen], pa.int64()),
                         pa.array(A.signed(np.array([s[0] for s in chosen], _U))),
                         pa.array([sketch(s) for s in chosen], pa.binary()),
                         A.list_column(A.signed(np.concatenate(chosen)), np.cumsum([0, *map(len, chosen)]), pa.int64())],
                        names=["class", "n", "least", "sketch", "tokens"],
                    )

    return run


def _rows(table: pa.Table) -> Iterator[tuple[int, np.ndarray, dict]]:
    tokens = table.column("tokens").combine_chunks()
    others = table.drop_columns(["tokens"]).to_pylist()
    for i, row in enumerate(others):
        yield row["class"], tokens[i].values.to_numpy().view(_U), row


def _link_table(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({
        "a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())
    })


def _link_home(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        sets = {c: s for c, s, _ in _rows(table)}
        first = min(r["first"] for r in table.select(["first"]).to_pylist())
        order = [first, *[c for c in sets if c != first]]
        union, links = _Union(), []
        for i, x in enumerate(order):
            for y in order[:i]:
                if union.root(x) != union.root(y) and linked(sets[x], sets[y], threshold):
                    union.join(x, y)
                    links.append((x, y))
        return _link_table(links)

    return run


def _hub_bound(threshold: int):
    """Rows of a block whose queries may link with its hub, going by the sketches, and the hub's own."""

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_pylist()
        of, sizes = table.column("sketch").to_pylist(), table.column("n").to_pylist()
        at = asks.index(False)
        keep = np.array([
            a and (100 + threshold) * overlap_bound(s, of[at]) >= threshold * (n + sizes[at])
            for a, s, n in zip(asks, of, sizes, strict=True)
        ])
        keep[at] = keep.any()
        return table.filter(pa.array(keep)).drop_columns(["sketch", "n"])

    return run


def _member_bound(threshold: int):
    """Rows of groups that may hold ``threshold`` percent of a query, and of members that may link with it.

    The group's bucketed union is the largest count of any member; what it lets through is bounded
    by each member's own sketch.
    """

    def run(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("asks").to_pylist(), bool)
        counts = [np.frombuffer(x, np.uint8) for x in table.column("sketch").to_pylist()]
        size, component = table.column("n").to_numpy(), table.column("component").to_numpy()
        buckets = min(map(len, counts))
        folded = np.stack([_folded(c, buckets) for c in counts])
        queries, members = np.flatnonzero(asks), np.flatnonzero(~asks)
        keep = np.zeros(len(asks), bool)
        union = folded[members].max(0) if len(members) else np.zeros(buckets, np.int64)
        shared = np.minimum(folded[queries], union).sum(1)
        for q in queries[100 * shared >= threshold * size[queries]]:
            both = np.minimum(folded[q], folded[members]).sum(1)
            near = ((100 + threshold) * both >= threshold * (size[q] + size[members])) & (component[members] != component[q])
            near &= (threshold * size[q] <= 100 * size[members]) & (threshold * size[members] <= 100 * size[q])
            keep[q] = near.any()
            keep[members[near]] = True
        return table.filter(pa.array(keep)).drop_columns(["sketch", "n"])

    return run


def _open_groups(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        members, queries = [], []
        for row in _rows(table):
            (queries if row[2]["asks"] else members).append(row)
        tokens = np.unique(np.concatenate([s for _, s, _ in members])) if members else np.zeros(0, _U)
        union, links = _Union(), []
        for c, s, row in queries:
            at = np.searchsorted(tokens, s)
            at[at == len(tokens)] = 0
            overlap = int((tokens[at] == s).sum()) if len(tokens) else 0
            if 100 * overlap < threshold * len(s):
                continue  # no member can hold enough of its tokens
            for d, t, other in members:
                x, y = row["component"], other["component"]
                if union.root(x) != union.root(y) and linked(s, t, threshold):
                    union.join(x, y)
                    links.append((c, d))
        return _link_table(links)

    return run


def _block(key: Column, count: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(key), F.ceil(count / F.lit(size)).cast("long"))


def _with_tokens(rows: DataFrame, sets: DataFrame, keys: list[str], link) -> DataFrame:
    """Links within the groups of ``keys``; rows are slim until here, so sets move once by class
    and once to the groups that want them."""
    return rows.join(sets.select("class", "tokens"), "class").groupBy(*keys).applyInArrow(link, "a long, b long")


def _home_links(sets: DataFrame, threshold: int) -> DataFrame:
    """Links within blocks, and between each block and the first class of its smallest token."""
    slim = sets.select("class", "least")
    shared = slim.groupBy("least").agg(F.count(F.lit(1)).alias("size"), F.min("class").alias("first")).filter("size > 1")
    members = slim.join(shared, "least").select(
        "least", _block(F.col("class"), F.col("size"), GROUP).alias("block"), "first", "class"
    )
    blocks = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / F.lit(GROUP)).cast("long") - 1)
    firsts = shared.select("least", F.explode(blocks).alias("block"), "first", F.col("first").alias("class"))
    return _with_tokens(members.unionByName(firsts), sets, ["least", "block"], _link_home(threshold))


def _cells(shared: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """(part, class) cells of parts whose classes are not all in one component yet."""
    own = F.coalesce("component", "class").alias("component")
    labelled = sets.select("class", "n").join(found.withColumnRenamed("node", "class"), "class", "left")
    cells = shared.join(labelled.select("class", "n", own), "class")
    open_parts = cells.groupBy("part").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("shared_by")
    )
    return write_table(
        cells.join(open_parts.filter("lo < hi").select("part", "shared_by"), "part"),
        new_folder(shared.sparkSession, "jaccard-cells"),
    )


def _hubs(cells: DataFrame) -> DataFrame:
    """The hub of every part: of the classes that have it, the one whose parts are shared most."""
    degree = cells.groupBy("class").agg(F.sum("shared_by").alias("degree"))
    return cells.join(degree, "class").groupBy("part").agg(
        F.max(F.struct("degree", "class", "component", "n", "most")).alias("hub")
    )


def _hub_links(cells: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links of classes with the hubs of their parts."""
    near = (F.col("hub.n") * threshold <= F.col("n") * 100) & (F.col("n") * threshold <= F.col("hub.n") * 100)
    near &= (F.col("n") <= F.col("hub.most")) & (F.col("hub.n") <= F.col("most"))
    asks = write_table(
        cells.join(_hubs(cells), "part").filter((F.col("component") != F.col("hub.component")) & near)
        .select("class", "component", F.col("hub.class").alias("hub"), F.col("hub.component").alias("to")).distinct(),
        new_folder(cells.sparkSession, "jaccard-asks"),
    )
    counts = asks.groupBy("hub").agg(F.count(F.lit(1)).alias("asked"))
    asks = asks.join(counts, "hub").withColumn("block", _block(F.col("class"), F.col("asked"), QUERIES))
    queries = asks.select("hub", "block", "class", "component", F.lit(True).alias("asks"))
    members = asks.select(
        "hub", "block", F.col("hub").alias("class"), F.col("to").alias("component"), F.lit(False).alias("asks")
    ).distinct()
    rows = queries.unionByName(members)
    # sketches move first, token sets only to where links are possible
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    near = write_table(
        rows.join(sets.select("class", "n", "sketch"), "class").select(*rows.columns, "n", "sketch")
        .groupBy("hub", "block").applyInArrow(_hub_bound(threshold), kinds),
        new_folder(cells.sparkSession, "jaccard-near"),
    )
    return _with_tokens(near, sets, ["hub", "block"], _open_groups(threshold))


def _matrix_links(cells: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links found by opening the groups that the matrix lets through.

    A group is a block of the classes that have the same most-shared hub.  Groups meet in the
    cells of a part if they have classes of different components and sizes that can link; each
    class of the one that shares a part with the other is then a query against it, and only such
    classes of the other are compared.
    """
    spark = cells.sparkSession
    if "most" not in cells.columns:  # nothing is known of tokens in common
        cells = cells.withColumn("most", F.floor(F.col("n") * 100 / threshold))
    best = cells.join(_hubs(cells), "part").groupBy("class").agg(
        F.max(F.struct("hub.degree", "hub.class")).alias("hub"), F.first("component").alias("component"), F.first("n").alias("n"),
        F.first("most").alias("most"),
    ).select("class", "component", "n", "most", F.col("hub.class").alias("hub"))
    sizes = best.groupBy("hub").agg(F.count(F.lit(1)).alias("size"))
    grouped = write_table(
        best.join(sizes, "hub").select(
            "class", "component", "n", "most", F.xxhash64("hub", _block(F.col("class"), F.col("size"), GROUP)).alias("group")
        ),
        new_folder(spark, "jaccard-groups"),
    )
    matrix = write_table(
        cells.select("part", "class").join(grouped, "class").groupBy("part", "group").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"),
            F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max("most").alias("most"),
            F.collect_set(F.struct("class", "n", "most")).alias("classes"),  # of one block
        ),
        new_folder(spark, "jaccard-matrix"),
    )
    other = matrix.select("part", *[F.col(c).alias(f"to_{c}") for c in matrix.columns[1:]])
    differ = F.least("lo", "to_lo") != F.greatest("hi", "to_hi")
    near = (F.col("n_lo") * threshold <= F.col("to_n_hi") * 100) & (F.col("to_n_lo") * threshold <= F.col("n_hi") * 100)
    near &= (F.col("n_lo") <= F.col("to_most")) & (F.col("to_n_lo") <= F.col("most"))

    def fitting(own: str, other: str) -> Column:
        """Those classes of a group that may link with some class of the other, going by sizes."""
        fits = F.filter(f"{own}classes", lambda c: (c["n"] <= F.col(f"{other}most")) & (F.col(f"{other}n_lo") <= c["most"]))
        return F.transform(fits, lambda c: c["class"])

    # classes that link share a part, so of two groups only those move that share one with the other;
    # groups that meet in many parts are told once which classes these are
    met = (
        matrix.join(other, "part").filter((F.col("group") <= F.col("to_group")) & differ & near)
        .select("group", "to_group", fitting("", "to_").alias("own"), fitting("to_", "").alias("others"))
        .groupBy("group", "to_group").agg(*(F.array_distinct(F.flatten(F.collect_set(c))).alias(c) for c in ("own", "others")))
    )
    sides = F.array(
        F.struct(F.col("own").alias("of"), F.lit(True).alias("asks")),
        F.struct(F.col("others").alias("of"), F.lit(False).alias("asks")),
    )
    rows = write_table(
        met.select("group", "to_group", F.explode(sides).alias("side"))
        .select("group", "to_group", F.explode("side.of").alias("class"), F.col("side.asks").alias("asks")),
        new_folder(spark, "jaccard-pairs"),
    )
    near = write_table(
        rows.join(grouped.select("class", "component", "n"), "class").join(sets.select("class", "sketch"), "class")
        .select("group", "to_group", "class", "component", "asks", "n", "sketch")
        .groupBy("group", "to_group").applyInArrow(
            _member_bound(threshold), "group long, to_group long, class long, component long, asks boolean"
        ),
        new_folder(spark, "jaccard-near"),
    )
    return _with_tokens(near, sets, ["group", "to_group"], _open_groups(threshold))


def _all_links(sets: DataFrame, shared: DataFrame, threshold: int) -> DataFrame:
    """Components of the linked classes."""
    spark = sets.sparkSession
    links = write_table(_home_links(sets, threshold), new_folder(spark, "jaccard-home"))
    found = components(links)
    for step in [_hub_links] * HUB_ROUNDS + [_matrix_links]:
        more = step(_cells(shared, sets, found), sets, threshold)
        links = links.unionByName(write_table(more, new_folder(spark, "jaccard-links")))
        found = components(links)
    return found


def _common(rows: DataFrame, classes, sized: DataFrame) -> Broadcast:
    """A bitmap of the tokens that occur more than once in ``rows``; ``sized`` has their numbers ``n``."""
    spark = rows.sparkSession
    tokens = sized.agg(F.sum("n")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // PACKED + 1)
    bits = min(max(int(tokens).bit_length() - 1, bitmap.BITS), TOKEN_BITS)
    packed = rows.mapInArrow(_packed_tokens(classes, ranges), "range int, kept binary")
    found = packed.groupBy("range").applyInArrow(_repeated(bits), "first long, words binary").toArrow()
    out = np.zeros(1 << (bits - 6), _U)
    for first, words in zip(found.column("first").to_pylist(), found.column("words"), strict=True):
        some = np.frombuffer(words.as_buffer(), "<u8")
        out[first : first + len(some)] |= some
    return spark.sparkContext.broadcast(out)


def _classes(docs: DataFrame, id_col: str, text: str, shingle: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """The described documents (id, n, class) and the components of linked classes."""
    spark = docs.sparkSession
    context = spark.sparkContext
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    described = write_table(
        texts.mapInArrow(_describe(shingle), f"id {kind}, n long, class long"), new_folder(spark, "jaccard-sets")
    )
    classes = _classes_of(shingle)
    bits = _common(texts.select("text"), classes, described)
    held = write_table(
        texts.select("text").mapInArrow(_candidate_parts(bits, classes, threshold), "part long, class long").distinct(),
        new_folder(spark, "jaccard-held"),
    )
    several = held.groupBy("part").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("part")
    shared = write_table(held.join(several, "part"), new_folder(spark, "jaccard-shared"))
    bits = context.broadcast(bitmap.build(shared.select("class").distinct(), "class"))
    kinds = "class long, n long, least long, sketch binary, tokens array<long>"
    # in buckets by class: the joins that want sketches or tokens move the rows that ask, not the sets
    sets = buckets_once(
        spark, new_folder(spark, "jaccard-candidates"), kinds, "class", int(spark.conf.get("spark.sql.shuffle.partitions")),
        lambda: texts.select("text").mapInArrow(_sets_of(bits, shingle), kinds)
        .groupBy("class").agg(*(F.first(c).alias(c) for c in ("n", "least", "sketch", "tokens"))),
    )
    # tokens of classes that are left: copies of a text no longer count as others
    bits = _common(sets.select("class", "tokens"), _stored, sets)
    reach = write_table(
        sets.select("class", "tokens").mapInArrow(_reach(bits, threshold), "class long, most long"),
        new_folder(spark, "jaccard-reach"),
    )
    return described.select("id", "n", "class"), _all_links(sets, shared.join(reach, "class"), threshold)


def _labels(described: DataFrame, linked_classes: DataFrame) -> DataFrame:
    """Smallest id of each class's component."""
    classes = described.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min("id").alias("least_id"))
    joined = classes.join(linked_classes.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "component", F.coalesce("component", "class")
    )
    least = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return joined.select("class", "component").join(least, "component").select("class", "component", "component_id")


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD,
) -> DataFrame:
    """The id, ``n_shingles`` and ``component_id`` of every row."""
    described, linked_classes = _classes(docs, id_col, text, shingle, threshold)
    labels = _labels(described, linked_classes).select("class", "component_id")
    return described.join(labels, "class", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _by_class(shared, text: str, shingle: int, inside: bool):
    """Rows whose class is in the bitmap, with the class; or those whose class is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for part in A.slices(batch, text):
                sets = token_sets(*A.view(part.column(text)), shingle)
                keys = class_keys(sets)
                hit = bitmap.test(bits, keys) & np.array([len(s) > 0 for s in sets])
                if inside:
                    columns, names = [*part.columns, pa.array(A.signed(keys))], [*part.schema.names, "_class"]
                    part = pa.RecordBatch.from_arrays(columns, names=names)
                yield part.filter(pa.array(hit == inside))

    return run


def one_each(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD,
) -> DataFrame:
    """``docs`` with one row of each component, one of the smallest id (null last); empty texts stay.

    Rows that are alone in their component go from the scan to the result; only the others are
    shuffled with their texts.
    """
    spark = docs.sparkSession
    names = docs.columns
    numbered = {name: f"c{i}" for i, name in enumerate(names)}  # no column of docs clashes with one of here
    docs, id_col, text = docs.toDF(*numbered.values()), numbered[id_col], numbered[text]
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))
    described, linked_classes = _classes(docs.select(key.alias("_key"), F.col(text).alias("text")), "_key", "text", shingle, threshold)
    classes = (
        described.filter(F.col("class").isNotNull()).groupBy("class")
        .agg(F.min(F.struct("id", "class")).alias("least"), F.count(F.lit(1)).alias("rows"))
        .join(linked_classes.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    kept = classes.groupBy("component").agg(F.min("least").alias("kept"), F.sum("rows").alias("rows")).filter("rows > 1")
    several = write_table(
        classes.select("class", "component").join(kept, "component").select(
            F.col("class").alias("_class"), (F.col("class") == F.col("kept.class")).alias("_stays"),
            F.col("kept.id.id").alias("_kept_id"),
        ),
        new_folder(spark, "jaccard-several"),
    )
    bits = spark.sparkContext.broadcast(bitmap.build(several, "_class"))
    alone = docs.mapInArrow(_by_class(bits, text, shingle, False), docs.schema)
    schema = T.StructType([*docs.schema.fields, T.StructField("_class", T.LongType())])
    together = docs.mapInArrow(_by_class(bits, text, shingle, True), schema).join(several, "_class", "left")
    chosen = together.filter(F.col("_stays").isNull() | (F.col("_stays") & F.col("_kept_id").eqNullSafe(F.col(id_col))))
    one = chosen.groupBy("_class", F.col(id_col).alias("_id")).agg(F.first(F.struct(*docs.columns)).alias("_row"))
    return alone.unionByName(one.select("_row.*")).toDF(*names)
