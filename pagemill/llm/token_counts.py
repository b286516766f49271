"""Token counts by way of distinct pre-tokens, without ids.

Texts are cut into pre-tokens; how many pieces a pre-token has is found once for each distinct
one, with the tokenizer's own library, and joined to the frequencies of pre-tokens in documents.

Cuts are made where white space (space, tab to carriage return) follows another character: at
such a place the tokenizer's pattern always cuts too, so the pieces of a text are those of its
parts.  (Not after a character that may be non-ASCII white space, where it might not.)  Marks
stay with their word, which only makes a part a little longer; special strings hold no white
space and are the library's business.

Frequencies travel as postings: a block of up to ``BLOCK_ROWS`` documents sends one record for
each distinct pre-token with the rows it is in and how often.  Records meet by pre-token, those
in very many rows of a block spread over ``SALTS`` tasks; each task adds up the tokens of each
row, and sends each block one record of sums, which meet there.  So a word that is in every
document costs one record a block, and nothing grows with a single key.

Defined results: a null text counts as empty, with no tokens; rows are counted by themselves,
repeated ones and null ids included; an empty table gives an empty table; further columns are
ignored.  Distinct pre-tokens of a block are told apart by 64-bit hashes.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import arrow_text as A

BLOCK_ROWS = 1 << 14
BLOCK_BYTES = 32 << 20
SALTS = 64
COMMON = 16
"""A pre-token in more than one of this many rows of a block is spread over the salts."""
RECORDS = 1 << 15
SUMS = 1 << 22
"""Row sums a task gathers before it adds them up, and hands on if they are too many."""
KNOWN = 1 << 20
LIMIT = 512


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of pre-tokens."""
    n = len(data)
    space = A.SPACE[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[:1] = False
    # leads of characters among which there is white space; the bytes after them are not looked at
    at = np.flatnonzero(cut)
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    odd = (two == 0xC2) | (three == 0xE1) | (three == 0xE2) | (three == 0xE3)
    cut[at[odd]] = False
    return A.runs_before(cut, offsets) if n else (np.zeros(0, np.int64),) * 3


class _Block:
    """Postings of some documents."""

    def __init__(self):
        self.rows, self.bytes, self.found, self.words = 0, 0, [], []

    def add(self, column: pa.Array) -> None:
        data, offsets = A.view(column)
        start, end, row = parts(data, offsets)
        key = A.run_hashes(data, start, end)
        order = np.lexsort((key, row))
        key_, row_ = key[order], row[order]
        new = np.ones(len(order), bool)
        new[1:] = (key_[1:] != key_[:-1]) | (row_[1:] != row_[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(order)))
        self.found.append((key_[first], (row_[first] + self.rows).astype(np.uint16), times.astype(np.int32)))
        distinct, at = np.unique(key, return_index=True)
        self.words.append((distinct, A.binary_column(*A.gather(data, start[at], end[at]))))
        self.rows += len(column)
        self.bytes += len(data)

    def records(self, number: int) -> Iterator[tuple[pa.Array, ...]]:
        """(pre-token, salt, rows and times); a count above 255 is several entries."""
        key, row, times = (np.concatenate(x) for x in zip(*self.found, strict=True))
        self.found = []
        pieces = -(-times // 255)
        left = np.full(pieces.sum(), 255, np.uint8)
        left[np.cumsum(pieces) - 1] = times - 255 * (pieces - 1)
        if len(left) > len(key):
            key, row = np.repeat(key, pieces), np.repeat(row, pieces)
        order = np.argsort(key, kind="stable")
        key, row, left = key[order], row[order], left[order]
        keys = np.concatenate([k for k, _ in self.words])
        distinct, at = np.unique(keys, return_index=True)
        words = pa.concat_arrays([w for _, w in self.words]).take(pa.array(at))
        bounds = np.append(np.searchsorted(key, distinct), len(key))
        salt = np.where(np.diff(bounds) * COMMON > self.rows, 1 + number % SALTS, 0)
        for low in range(0, len(distinct), RECORDS):
            high = min(len(distinct), low + RECORDS)
            b = bounds[low : high + 1]
            width = np.diff(b)
            at = np.repeat(3 * (b[:-1] - b[0]), width)  # bytes before each record
            place = np.arange(b[-1] - b[0]) - np.repeat(b[:-1] - b[0], width)
            both = np.zeros(3 * (b[-1] - b[0]), np.uint8)
            pairs = np.ascontiguousarray(row[b[0] : b[-1]]).view(np.uint8).reshape(-1, 2)
            both[at + 2 * place], both[at + 2 * place + 1] = pairs[:, 0], pairs[:, 1]
            both[at + 2 * np.repeat(width, width) + place] = left[b[0] : b[-1]]
            yield words[low:high], pa.array(salt[low:high], pa.int32()), A.binary_column(both, 3 * (b - b[0]))


_FIELDS = "base long, row long, id {id}, n_bytes long, word binary, salt int, posted binary"
_SUMMED = "base long, row long, id {id}, n_bytes long, posted binary"


def _postings(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(block: _Block, base: int) -> Iterator[pa.RecordBatch]:
            for word, salt, posted in block.records(base // BLOCK_ROWS):
                n = len(word)
                none = [pa.nulls(n, schema.field(f).type) for f in ("row", "id", "n_bytes")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, base)), *none, word, salt, posted], schema=schema)

        block, base, expected = _Block(), 0, -1
        for batch in batches:
            for part in A.slices(batch, "text"):
                for low in range(0, part.num_rows, BLOCK_ROWS):
                    some = part.slice(low, BLOCK_ROWS)
                    row = some.column("row").to_numpy()
                    n = len(row)
                    full = block.rows + n > BLOCK_ROWS or block.bytes > BLOCK_BYTES or row[0] != expected
                    if block.rows and full:
                        yield from flush(block, base)
                        block = _Block()
                    if not block.rows:
                        base = int(row[0])
                    nulls = [pa.nulls(n, schema.field(f).type) for f in ("word", "salt", "posted")]
                    size = pc.fill_null(pc.binary_length(some.column("text")), 0).cast(pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, base)), some.column("row"), some.column("id"), size, *nulls], schema=schema
                    )
                    block.add(some.column("text"))
                    expected = int(row[-1]) + 1
        if block.rows:
            yield from flush(block, base)

    return run


class _Sums:
    """Tokens of rows, as (base, row, tokens) entries that are added up when they get many."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, base: np.ndarray, row: np.ndarray, tokens: np.ndarray) -> None:
        self.parts.append((base, row, tokens))
        self.size += len(row)
        if self.size > SUMS:
            self.merge()

    def merge(self) -> None:
        base, row, tokens = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(row, kind="stable")
        row = row[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        tokens = np.add.reduceat(tokens[order], first) if len(first) else tokens
        self.parts = [(base[order[first]], row[first], tokens)]
        self.size = len(first)

    def records(self) -> Iterator[tuple[int, bytes]]:
        """Each block's rows (two bytes each) and their tokens (four bytes each)."""
        if not self.parts:
            return
        self.merge()
        base, row, tokens = self.parts[0]
        self.parts, self.size = [], 0
        big = np.uint32(0xFFFFFFFF)
        at = np.flatnonzero(np.diff(base, prepend=-1))
        for low, high in zip(at, np.append(at[1:], len(base)), strict=True):
            rows, left = (row[low:high] - base[low:high]).astype(np.uint16), tokens[low:high]
            while len(left):
                yield int(base[low]), rows.tobytes() + np.minimum(left, big).astype(np.uint32).tobytes()
                rows, left = rows[left > big], left[left > big] - int(big)


def _summed(tokenizer_file: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        known: dict[bytes, int] = {}
        sums = _Sums()

        def handed_on() -> Iterator[pa.RecordBatch]:
            records = list(sums.records())
            none = [pa.nulls(len(records), schema.field(f).type) for f in ("row", "id", "n_bytes")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in records], pa.int64()), *none, pa.array([x for _, x in records], pa.binary())],
                schema=schema,
            )

        for batch in batches:
            has_word = batch.column("word").is_valid()
            about = batch.filter(pc.invert(has_word))
            if about.num_rows:
                columns = about.select(["base", "row", "id", "n_bytes"]).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(about.num_rows, pa.binary())], schema=schema)
            batch = batch.filter(has_word)
            if not batch.num_rows:
                continue
            words = batch.column("word").to_pylist()
            if len(known) > KNOWN:
                known.clear()
            new = list({w for w in words if w not in known})
            encoded = tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)
            known.update(zip(new, map(len, encoded), strict=True))
            pieces = np.array([known[w] for w in words], np.int64)
            posted, bounds = A.view(batch.column("posted").cast(pa.large_binary()).view(pa.large_string()))
            width = np.diff(bounds) // 3
            start = np.repeat(bounds[:-1], width)
            place = np.arange(len(start)) - np.repeat(np.cumsum(width) - width, width)
            row = posted[start + 2 * place].astype(np.int64) + posted[start + 2 * place + 1].astype(np.int64) * 256
            times = posted[start + 2 * np.repeat(width, width) + place].astype(np.int64)
            base = np.repeat(batch.column("base").to_numpy(), width)
            sums.add(base, base + row, times * np.repeat(pieces, width))
            if sums.size > SUMS // 2:
                yield from handed_on()
        yield from handed_on()

    return run


def _assembled(table: pa.Table) -> pa.Table:
    """The documents of one block with their tokens."""
    is_sum = table.column("posted").is_valid()
    about = table.filter(pc.invert(is_sum))
    base = table.column("base")[0].as_py()
    total = np.zeros(1 << 16, np.int64)
    for record in table.filter(is_sum).column("posted").to_pylist():
        n = len(record) // 6
        np.add.at(total, np.frombuffer(record, np.uint16, n), np.frombuffer(record, np.uint32, n, 2 * n))
    rows = about.column("row").to_numpy() - base
    return pa.table({"id": about.column("id"), "n_bytes": about.column("n_bytes"), "n_tokens": pa.array(total[rows])})


def count(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The id, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")
    )
    kind = texts.schema["id"].dataType.simpleString()

    def schema(fields: str) -> pa.Schema:
        return to_arrow_schema(spark.createDataFrame([], fields).schema)

    posted, summed = _FIELDS.format(id=kind), _SUMMED.format(id=kind)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = (
        texts.mapInArrow(_postings(schema(posted)), posted)
        .repartition(tasks, F.coalesce("word", F.col("row").cast("string").cast("binary")), "salt")
        .mapInArrow(_summed(tokenizer_file, schema(summed)), summed)
    )
    counted = sums.groupBy("base").applyInArrow(_assembled, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
