"""SentencePiece encoding and decoding with an Aho-Corasick automaton and one Viterbi pass.

The automaton holds the UTF-8 bytes of all pieces (the piece mark as a space).  Reading a text
byte by byte it is always in the state of the longest piece prefix that ends here; the state and
its output links give every piece that ends here, each of which relaxes the best score of this
place from the place where the piece begins.  The best path is read backwards.

A character that is no piece costs ``UNKNOWN`` and becomes its bytes' pieces.  Of equally good
paths the one whose last piece is longer wins.  Scores are those of the model file, so for a
model trained by merging pairs this is the best-scoring segmentation, not the order of merges.

Pieces hold the piece mark only in front, so a place where a space follows another character is
always a border, and texts are cut there: equal parts of a slice are encoded once, all of them
together, one byte a step in numpy arrays.

As in the library a space is put before every text that is not empty; decoding removes it.
Decoding what was encoded gives the text back, byte by byte: no text normalisation is done (the
file asks for none), and a literal piece mark is encoded as bytes.

Defined results: a null text encodes and decodes like an empty one, to nothing; repeated rows,
null ids and further columns change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import arrow_text as A

MARK = "▁"
UNKNOWN = -1e6
SLICE = 4 << 20
SPACE = 32


class Vocabulary(NamedTuple):
    bytes_of: list[bytes]
    """What each id decodes to; nothing for control pieces."""
    score: np.ndarray
    usable: np.ndarray
    byte_ids: np.ndarray
    """Id of each byte's piece."""


def read_model(model_file: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    byte_ids = np.full(256, model.unk_id())
    bytes_of, usable = [], np.ones(n, bool)
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            bytes_of.append(bytes([value]))
            usable[i] = False
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            bytes_of.append(b"")
            usable[i] = False
        else:
            bytes_of.append(piece.replace(MARK, " ").encode())
    return Vocabulary(bytes_of, np.array([model.get_score(i) for i in range(n)], float), usable, byte_ids)


class Automaton:
    """``goto`` of every state and byte; the piece a state ends; the next state in its output chain."""

    def __init__(self, words: Vocabulary):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        depth = [0]
        for i in np.flatnonzero(words.usable):
            state = 0
            for byte in words.bytes_of[i]:
                following = children[state].get(byte)
                if following is None:
                    following = children[state][byte] = len(children)
                    children.append({})
                    ends.append(-1)
                    depth.append(depth[state] + 1)
                state = following
            if state and (ends[state] < 0 or words.score[i] > words.score[ends[state]]):
                ends[state] = int(i)
        n = len(children)
        self.goto = np.zeros((n, 256), np.int32)
        self.piece = np.array(ends)
        self.out = np.zeros(n, np.int32)
        """The nearest state on the failure chain, itself included, that ends a piece; 0 for none."""
        self.rest = np.zeros(n, np.int32)
        """The same without itself."""
        self.length = np.array(depth)
        self.score = np.where(self.piece >= 0, words.score[self.piece], 0.0)
        fail = np.zeros(n, np.int32)
        level = [0]
        while level:
            following = []
            for state in level:
                own = children[state]
                if state:
                    self.goto[state] = self.goto[fail[state]]
                    self.rest[state] = self.out[fail[state]]
                    self.out[state] = state if ends[state] >= 0 else self.rest[state]
                for byte, child in own.items():
                    fail[child] = self.goto[fail[state], byte] if state else 0
                    self.goto[state, byte] = child
                    following.append(child)
            level = following


def segment(auto: Automaton, words: Vocabulary, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each byte run ``data[bounds[i]:bounds[i+1]]``, and their bounds.

    Runs are sorted by length so that those still being read are always the first ones.
    """
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    start, left = bounds[:-1][order], size[order]
    n = len(order)
    place = np.concatenate([[0], np.cumsum(left + 1)])[:-1]  # of each run's scores
    best = np.full(len(data) + n, -np.inf)
    back = np.zeros(len(best), np.int64)  # the piece that ends here, or -bytes of an unknown character
    count = np.zeros(len(best), np.int64)
    best[place] = 0.0
    state = np.zeros(n, np.int32)
    begun = np.zeros(n, np.int64)  # where the current character begins
    live = n
    for t in range(int(left[0]) if n else 0):
        while live and left[live - 1] <= t:
            live = int(np.searchsorted(-left, -t, "left"))
        if not live:
            break
        byte = data[start[:live] + t]
        first = (byte & 0xC0) != 0x80
        begun[:live] = np.where(first, t, begun[:live])
        state[:live] = auto.goto[state[:live], byte]
        here = place[:live] + t + 1
        alone = np.zeros(live, bool)
        which = np.flatnonzero(auto.out[state[:live]])
        node = auto.out[state[:live][which]]
        while len(which):
            at, long = here[which], auto.length[node]
            alone[which] |= long == t + 1 - begun[which]
            score = best[at - long] + auto.score[node]
            better = score > best[at]
            to, of = at[better], node[better]
            best[to] = score[better]
            back[to] = auto.piece[of]
            count[to] = count[to - long[better]] + 1
            node = auto.rest[node]
            more = node > 0
            which, node = which[more], node[more]
        last = left[:live] == t + 1
        following = data[np.minimum(start[:live] + t + 1, len(data) - 1)]
        ended = last | ((following & 0xC0) != 0x80)
        odd = np.flatnonzero(ended & ~alone)
        if len(odd):
            long = t + 1 - begun[odd]
            at = here[odd]
            score = best[at - long] + UNKNOWN
            better = score > best[at]
            to, long = at[better], long[better]
            best[to] = score[better]
            back[to] = -long
            count[to] = count[to - long] + long
    # backwards
    totals = count[place + left]
    out_bounds = np.zeros(n + 1, np.int64)
    sizes = np.zeros(n, np.int64)
    sizes[order] = totals
    np.cumsum(sizes, out=out_bounds[1:])
    ids = np.zeros(out_bounds[-1], np.int32)
    write = out_bounds[1:][order].copy()
    at = left.copy()
    which = np.flatnonzero(at > 0)
    lengths = np.array([len(b) for b in words.bytes_of])
    while len(which):
        piece = back[place[which] + at[which]]
        whole = piece >= 0
        w = which[whole]
        write[w] -= 1
        ids[write[w]] = piece[whole]
        at[w] -= lengths[piece[whole]]
        w, long = which[~whole], -piece[~whole]
        for k in range(1, int(long.max(initial=0)) + 1):  # up to four bytes, last first
            some = w[long >= k]
            write[some] -= 1
            ids[write[some]] = words.byte_ids[data[start[some] + at[some] - k]]
        at[w] -= long
        which = which[at[which] > 0]
    return ids, out_bounds


def encode(auto: Automaton, words: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each row and their bounds."""
    full = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][full], SPACE)
    offsets = offsets + np.concatenate([[0], np.cumsum(full)])
    space = data == SPACE
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    start, end, row = A.runs_before(cut, offsets)
    _, at, inverse = np.unique(A.run_hashes(data, start, end), return_index=True, return_inverse=True)
    ids, bounds = segment(auto, words, *A.gather(data, start[at], end[at]))
    out, out_bounds = A.gather(ids, bounds[:-1][inverse], bounds[1:][inverse])
    return out, out_bounds[np.searchsorted(row, np.arange(len(offsets)))]


def decoder(words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words.bytes_of), np.uint8), np.cumsum([0, *map(len, words.bytes_of)])


def decode(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each row and their offsets; the space put before a text is taken away."""
    data, at = table
    out, ends = A.gather(data, at[ids], at[ids + 1])
    offsets = ends[bounds]
    heads = offsets[:-1][np.diff(offsets) > 0]
    heads = heads[out[heads] == SPACE]
    keep = np.ones(len(out), bool)
    keep[heads] = False
    return out[keep], offsets - np.searchsorted(heads, offsets)


def encoded(docs: DataFrame, model_file: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, ``ids``, ``n_ids``, and whether decoding them gives the text (``round_trip``)."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = read_model(model_file)
        auto, back = Automaton(words), decoder(words)
        for batch in batches:
            for part in A.slices(batch, "text", SLICE):
                data, offsets = A.view(part.column("text"))
                ids, bounds = encode(auto, words, data, offsets)
                again, at = decode(back, ids, bounds)
                same = np.array_equal(at, offsets) and np.array_equal(again, data)
                each = np.full(part.num_rows, True) if same else np.array([
                    np.array_equal(data[offsets[r] : offsets[r + 1]], again[at[r] : at[r + 1]]) for r in range(part.num_rows)
                ])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), A.list_column(ids, bounds, pa.int32()), pa.array(np.diff(bounds)), pa.array(each)],
                    names=[id_col, "ids", "n_ids", "round_trip"],
                )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_ids long, round_trip boolean")


def decoded(rows: DataFrame, model_file: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The id and ``text`` of rows of ids."""
    pairs = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(read_model(model_file))
        for batch in batches:
            lists = batch.column("ids")
            values = lists.flatten().to_numpy()
            data, at = decode(back, values, lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), A.binary_column(data, at).cast(pa.string())], names=[id_col, "text"]
            )

    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.mapInArrow(run, f"`{id_col}` {kind}, text string")
