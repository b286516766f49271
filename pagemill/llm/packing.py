"""Best-fit packing of token sequences, improved by a swap-based local search.

Documents are tokenized and end with ``END``.  A document of more than ``CAPACITY`` tokens is cut
so that only its first piece is shorter; pieces of exactly ``CAPACITY`` fill a sequence alone.
The others are dealt by hash into groups of about ``GROUP`` pieces, and every group is packed by
itself: best fit in decreasing order, then exchanges between bins that are not full.

An exchange gives part of one bin (one piece or two) for part of another (none, one or two).  The
bin that is emptied gives what makes another bin fuller than it was itself, so the sum of squared
fills grows with every exchange and the search ends.  Bins are taken up emptiest first.  Partners
are found in two tables, how many pieces (or pairs) of a size lie in bins of a gap: an exchange
that fills its partner exactly lies on a diagonal of a table, so looking for one is one pass over
that diagonal.  The search of a group ends early when no fewer bins can hold its tokens.

Pieces of bins that did not get full meet again in fewer, mixed groups in the next of ``PASSES``
passes, so what a border between groups costs is repaired.  Groups are bounded at every size of
the input and no pass needs more than one shuffle of slim rows.

The ids of equal parts of texts are found once a task, with the tokenizer's own library: parts are
cut where its pattern always cuts, in front of white space that follows another character and of
punctuation that follows a letter, and told apart by 64-bit hashes.

Defined results: a null text counts as empty and is one piece, the end token alone; repeated rows
and null ids are documents of their own; an empty table gives an empty table; further columns are
ignored by ``cut_pieces`` and carried along by ``pack``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import arrow_text as A
from pagemill.storage import new_folder, write_table

CAPACITY = 1024
END = 2
GROUP = 1 << 14
PASSES = 3
KNOWN = 1 << 20
"""Text parts whose ids a task keeps."""
JOINED = 64
"""Text parts of a call of the tokenizer."""
PIECES = 1 << 12
"""Pieces of a batch that is handed on."""
TRIES = 4
"""Passes of the search over the bins of a group that are not full."""


LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK = np.zeros(256, bool)
MARK[[*b",.;:!?)"]] = True


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of parts that the tokenizer treats alike wherever they are.

    Special strings hold no white space and none of the marks, so none is cut.
    """
    space = A.SPACE[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[:1] = False
    # after what may be the end of non-ASCII white space there is no cut
    at = np.flatnonzero(cut)
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    cut[at[(two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))]] = False
    cut[1:] |= MARK[data[1:]] & LETTER[data[:-1]]
    return A.runs_before(cut, offsets)


def joinable(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which text parts end where one that begins with white space may follow, and begin with it."""
    last = np.maximum(bounds[1:] - 1, 0)
    two, three = data[np.maximum(last - 1, 0)], data[np.maximum(last - 2, 0)]
    size = np.diff(bounds)
    wide = ((size > 1) & (two == 0xC2)) | ((size > 2) & (three >= 0xE1) & (three <= 0xE3))
    return A.SPACE[data[bounds[:-1]]] & ~A.SPACE[data[last]] & ~wide


def token_bytes(tokenizer) -> np.ndarray:
    """How many bytes of text each id stands for, if the vocabulary is one of bytes."""
    added = {i: token.content for i, token in tokenizer.get_added_tokens_decoder().items()}
    out = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True) + 1, np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        if i < len(out):
            out[i] = len(added[i].encode()) if i in added else len(token)
    return out


class Encoder:
    """Ids of text parts, kept by hash.

    Parts that are not known yet are given to the tokenizer joined, where its pattern cuts between
    them, since a call costs more than a part; the ids' lengths in bytes tell them apart again.
    Where these do not meet the parts' ends, each part is a call of its own.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bytes = token_bytes(self.tokenizer)
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        """Where the ids of each key begin."""
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _calls(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that are a call each, and how many each has."""
        texts = A.binary_column(data, bounds).cast(pa.string()).to_pylist()
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def _joined(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of parts that may follow one another, several to a call."""
        edge = np.append(bounds[:-1:JOINED], bounds[-1])
        ids, _ = self._calls(data, edge)
        ends = np.cumsum(self.bytes[np.minimum(ids, len(self.bytes) - 1)])
        stop = np.searchsorted(ends, bounds[1:])
        if len(ids) and ends[-1] == bounds[-1] and np.array_equal(ends[stop], bounds[1:]):
            return ids, np.diff(stop + 1, prepend=0)
        return self._calls(data, bounds)

    def _learn(self, key: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        raw, bounds = A.gather(data, start, end)
        may = joinable(raw, bounds)
        order = np.concatenate([np.flatnonzero(may), np.flatnonzero(~may)])
        key, start, end = key[order], start[order], end[order]
        found = [
            encode(*A.gather(data, start[some], end[some]))
            for encode, some in ((self._joined, slice(0, may.sum())), (self._calls, slice(may.sum(), None))) if len(start[some])
        ]
        size = np.concatenate([s for _, s in found])
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in found)])
        order = np.argsort(key)
        key, at, size = key[order], at[order], size[order]
        place = np.searchsorted(self.key, key)
        self.at, self.size = np.insert(self.at, place, at), np.insert(self.size, place, size)
        self.key = np.insert(self.key, place, key)

    def _unknown(self, key: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.ones(len(key), bool)
        return self.key[np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)] != key

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each row, and their bounds."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        start, end, row = parts(data, offsets)
        key, first, which = np.unique(A.run_hashes(data, start, end), return_index=True, return_inverse=True)
        new = self._unknown(key)
        if len(self.key) + new.sum() > KNOWN and len(self.key):
            self._forget()
            new[:] = True
        if new.any():
            at = first[new]
            self._learn(key[new], data, start[at], end[at])
        place = np.searchsorted(self.key, key)
        ids, bounds = A.gather(self.ids, self.at[place][which], (self.at[place] + self.size[place])[which])
        return ids, bounds[np.searchsorted(row, np.arange(len(offsets)))]


def _with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))


def cut_pieces(
    docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end: int = END,
    id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``uid``, the id, ``piece``, ``start``, ``length`` and ``ids`` (little-endian, four bytes each) of every piece."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    names = ["uid", id_col, "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_file)
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in A.slices(batch, "text"):
                ids, bounds = _with_end(*encoder.encode(*A.view(part.column("text"))), end)
                size = np.diff(bounds)
                count = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                head = (size - 1) % capacity + 1  # of the first piece
                start = np.where(piece > 0, head[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, head[row])
                raw = ids.astype("<u4", copy=False).view(np.uint8)
                # pieces lie after one another
                edge = np.append(0, np.cumsum(length))
                for low in range(0, len(row), PIECES):
                    high = min(len(row), low + PIECES)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(uid + np.arange(low, high)), part.column("id").take(pa.array(row[low:high])),
                            pa.array(piece[low:high].astype(np.int32)), pa.array(start[low:high]), pa.array(length[low:high]),
                            A.binary_column(raw[4 * edge[low] : 4 * edge[high]], 4 * (edge[low : high + 1] - edge[low])),
                        ],
                        names=names,
                    )
                uid += len(row)

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"uid long, `{id_col}` {kind}, piece int, start long, length long, ids binary")


class Bins:
    """Bins of one group, with the sizes found in those that are not full."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.capacity = capacity
        self.length = lengths.tolist()
        self.items: list[list[int]] = []
        self.gap: list[int] = []
        self._best_fit(np.argsort(-lengths, kind="stable").tolist())
        self.least = -(-int(lengths.sum()) // capacity)

    def _best_fit(self, order: list[int]) -> None:
        """Each piece into the bin with the smallest gap that holds it."""
        with_gap: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        gaps = 0  # bit g: there is a bin of gap g
        for i in order:
            size = self.length[i]
            fitting = gaps >> size
            if fitting:
                g = size + (fitting & -fitting).bit_length() - 1
                b = with_gap[g].pop()
                if not with_gap[g]:
                    gaps &= ~(1 << g)
                self.items[b].append(i)
            else:
                g, b = self.capacity, len(self.items)
                self.items.append([i])
                self.gap.append(0)
            self.gap[b] = g - size
            if g > size:
                with_gap[g - size].append(b)
                gaps |= 1 << (g - size)

    def count(self) -> int:
        return sum(map(bool, self.items))

    # the tables of what lies in bins that are not full

    def _sizes(self, b: int) -> tuple[list[int], list[int]]:
        own = sorted({self.length[i] for i in self.items[b]})
        twice = {s for s in own if sum(self.length[i] == s for i in self.items[b]) > 1}
        pairs = {x + y for k, x in enumerate(own) for y in own[k + 1 :]} | {2 * s for s in twice}
        return own, sorted(pairs)

    def _enter(self, b: int) -> None:
        g = self.gap[b]
        if not g or not self.items[b]:
            return
        own, pairs = self._sizes(b)
        self.entered[b] = (g, own, pairs)
        self.twos[g, pairs] += 1
        for s in own:
            self.ones[g, s] += 1
            self.held[g] |= 1 << s
            self.where.setdefault((g, s), set()).add(b)
        for s in pairs:
            self.where_two.setdefault((g, s), set()).add(b)
        self.open.setdefault(g, set()).add(b)

    def _leave(self, b: int) -> None:
        if b not in self.entered:
            return
        g, own, pairs = self.entered.pop(b)
        self.twos[g, pairs] -= 1
        for s in own:
            self.ones[g, s] -= 1
            if not self.ones[g, s]:
                self.held[g] ^= 1 << s
            self.where[g, s].discard(b)
        for s in pairs:
            self.where_two[g, s].discard(b)
        self.open[g].discard(b)

    def _taken(self, b: int, size: int, pair: bool) -> list[int]:
        """Pieces of bin ``b`` that are together of this size: one, or two for a pair."""
        if not pair:
            return [next(i for i in self.items[b] if self.length[i] == size)]
        at: dict[int, int] = {}
        for i in self.items[b]:
            other = at.get(size - self.length[i])
            if other is not None:
                return [other, i]
            at[self.length[i]] = i
        raise AssertionError("no such pair")

    def _swap(self, a: int, given: list[int], b: int, got: list[int]) -> None:
        more = sum(self.length[i] for i in given) - sum(self.length[i] for i in got)
        for x, out, into, change in ((a, given, got, more), (b, got, given, -more)):
            self._leave(x)
            gone = set(out)
            self.items[x] = [i for i in self.items[x] if i not in gone] + into
            self.gap[x] += change
        self._enter(a)
        self._enter(b)

    def _offers(self, a: int) -> list[tuple[int, list[int]]]:
        """What bin ``a`` can give, larger first: (size, pieces)."""
        one: dict[int, list[int]] = {}
        two: dict[int, list[int]] = {}
        for k, i in enumerate(self.items[a]):
            for j in self.items[a][k + 1 :]:
                two.setdefault(self.length[i] + self.length[j], [i, j])
            one.setdefault(self.length[i], [i])
        return sorted((two | one).items(), key=lambda offer: -offer[0])

    def _partner(self, size: int, least_gap: int, given: int) -> tuple[int, int, int, bool] | None:
        """(growth, gap, size taken, whether a pair): the exchange for ``size`` that fills its partner most.

        The partner grows by at most its gap, and must end fuller than the giving bin was: its gap
        afterwards is below ``least_gap``.
        """
        g = np.arange(1, min(self.capacity, size) + 1)
        exact: list[tuple[int, int, int, bool]] = []
        if size <= self.capacity and self.open.get(size):
            exact.append((size, size, 0, False))  # a move
        for table, pair in ((self.ones, False), (self.twos, True)):
            if pair and given == 2:
                continue
            taken = size - g
            fits = np.flatnonzero((taken > 0) & (taken <= self.capacity) & (table[g, np.clip(taken, 0, self.capacity)] > 0))
            if len(fits):
                best = int(g[fits[-1]])
                exact.append((best, best, size - best, pair))
        if exact:
            return max(exact)
        return self._inexact(size, least_gap)

    def _inexact(self, size: int, least_gap: int) -> tuple[int, int, int, bool] | None:
        best = None
        for g, bins in self.open.items():
            if not bins or g - min(g, size) >= least_gap:
                continue
            if size <= g:
                grows, taken = size, 0
            else:
                held = self.held[g] >> (size - g)  # bit s: a piece of size - g + s
                step = (held & -held).bit_length() - 1
                if not held or step >= g:
                    continue
                grows, taken = g - step, size - g + step
            if g - grows < least_gap and (best is None or grows * (grows - g) > best[0] * (best[0] - best[1])):
                best = (grows, g, taken, False)
        return best

    def improve(self, tries: int = TRIES) -> None:
        """Exchange until the fewest possible bins are left, or no exchange is found."""
        n = self.capacity + 1
        self.ones, self.twos = np.zeros((n, n), np.int32), np.zeros((n, n), np.int32)
        self.held = [0] * n
        """Of each gap, a bit for every size."""
        self.where: dict[tuple[int, int], set[int]] = {}
        self.where_two: dict[tuple[int, int], set[int]] = {}
        self.open: dict[int, set[int]] = {}
        self.entered: dict[int, tuple[int, list[int], list[int]]] = {}
        for b in range(len(self.items)):
            self._enter(b)
        count = self.count()
        for _ in range(tries):
            found = False
            for a in sorted((b for b in self.entered), key=lambda b: (-self.gap[b], b)):
                while count > self.least and self.items[a] and self.gap[a]:
                    if not self._give(a):
                        break
                    found = True
                    count -= not self.items[a]
            if not found or count <= self.least:
                return

    def _give(self, a: int) -> bool:
        """One exchange after which another bin is fuller than ``a`` was."""
        before = self.gap[a]
        self._leave(a)
        chosen = None
        for size, pieces in self._offers(a):
            found = self._partner(size, before, len(pieces))
            if found and (chosen is None or found[0] * (found[0] - found[1] + before) > chosen[0]):
                chosen = (found[0] * (found[0] - found[1] + before), size, pieces, found)
        if chosen is None:
            self._enter(a)
            return False
        _, _, pieces, (_, g, taken, pair) = chosen
        index = self.where_two if pair else self.where
        b = min(index[g, taken]) if taken else min(self.open[g])
        self._swap(a, pieces, b, self._taken(b, taken, pair) if taken else [])
        return True


def packed_group(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """The places of ``lengths`` in each bin."""
    bins = Bins(lengths, capacity)
    bins.improve()
    return [b for b in bins.items if b]


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, passes: int = PASSES) -> DataFrame:
    """``pieces`` (``uid`` distinct, ``length`` at most ``capacity``) with ``sequence_id`` and ``offset``.

    A sequence is named by the smallest uid in it.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    items = write_table(pieces.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")), new_folder(spark, "pieces"))
    kind = items.schema["row"].dataType.simpleString()

    def place(is_last: bool):
        def run(table: pa.Table) -> pa.Table:
            uid = table.column("uid").to_numpy()
            order = np.argsort(uid, kind="stable")  # so that a repeated task packs alike
            table, uid = table.take(pa.array(order)), uid[order]
            length = table.column("length").to_numpy()
            sequence, offset = np.zeros(len(uid), np.int64), np.zeros(len(uid), np.int64)
            settled = np.ones(len(uid), bool)
            for b in packed_group(length, capacity):
                at = np.sort(b)
                ends = np.cumsum(length[at])
                sequence[at], offset[at] = uid[at[0]], ends - length[at]
                settled[at] = is_last or ends[-1] == capacity
            return pa.table({
                "row": table.column("row"), "sequence_id": sequence, "offset": offset, "settled": settled,
            })

        return run

    full = F.col("row.length") == capacity
    done = [items.filter(full).select("row", F.col("row.uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left = items.filter(~full)
    for k in range(passes):
        count = left.count()
        groups = -(-count // group)
        is_last = k == passes - 1 or groups <= 1
        dealt = left.select(
            "row", F.col("row.uid").alias("uid"), F.col("row.length").cast("long").alias("length"),
            F.pmod(F.xxhash64(F.lit(k), "row.uid"), F.lit(max(groups, 1))).alias("dealt"),
        )
        placed = dealt.groupBy("dealt").applyInArrow(
            place(is_last), f"row {kind}, sequence_id long, offset long, settled boolean"
        )
        placed = write_table(placed, new_folder(spark, "packed"))
        done.append(placed.filter("settled").drop("settled"))
        if is_last:
            break
        left = placed.filter("NOT settled").select("row")
    whole = done[0]
    for some in done[1:]:
        whole = whole.unionByName(some)
    return whole.select(*(F.col(f"row.`{c}`").alias(c) for c in names), "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` (an array) of pieces that were packed with their ``ids``; a sequence has ``CAPACITY`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "ids"]
            )

    ordered = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return ordered.select("sequence_id", F.col("parts.ids").alias("ids")).mapInArrow(run, "sequence_id long, ids array<int>")
