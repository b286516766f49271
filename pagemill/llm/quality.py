"""Quality rules by gradient-boosted trees over document statistics.

One pass over whole texts gives each document its statistics; trees fitted on labelled rows score
them.  Trees are flattened into numpy arrays (feature, threshold, children, value) and walked for
all documents of a batch at once.  Symbols, repeated lines, repeated words and capitals may only
lower a score (monotonic constraints, kept through the bounds of every split's halves).

The trees are fitted on the driver from at most ``SAMPLE`` labelled documents, those of the
smallest hashed ids; their statistics come from a Spark pass over those texts.  Statistics and
verdicts cover every document.

Defined results: a null text counts as empty (no words, base rules fail); rows are judged by
themselves, so repeated rows and null ids change nothing; labels without a value are ignored, an
id labelled more than once takes its lowest label; without labels of both kinds every document
that passes the base rules is kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import arrow_text as A

SAMPLE = 20_000
# Fixed values
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\v\f\r"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "n_short")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeated", "upper", "digits", "marks", "distinct", "line_length", "short")
FALLING = {"symbols", "dup_lines", "repeated", "upper"}
"""Features of which more can never raise the score."""

_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), np.uint8))
_IS_CHAR_START = (np.arange(256) & 0xC0) != 0x80
_IS_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_IS_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_IS_MARK = np.isin(np.arange(256), np.frombuffer(b"!?;:", np.uint8))


def _dup_lines(text: str | None) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    seen: set[str] = set()
    total = 0
    for line in (text or "").split("\n"):
        if line.strip(BLANK):
            total += 1
            seen.add(line)
    return total, total - len(seen)


def _repeated(grams: np.ndarray) -> int:
    """Words inside windows that occur more than once, given one hash for each window."""
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(grams) + WINDOW, np.int64)
    at = np.flatnonzero(twice)
    edges[at] += 1
    edges[at + WINDOW] -= 1
    return int((np.cumsum(edges) > 0).sum())


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``COUNTS`` for each text."""
    data, offsets = A.view(column)
    w = A.words(data, offsets)

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[offsets])

    rows = len(offsets) - 1
    out = np.zeros((rows, len(COUNTS)), np.int64)
    out[:, 0] = np.diff(w.bounds)
    out[:, 1] = per_row(_IS_CHAR_START[data] & ~A.SPACE[data])
    out[:, 2] = per_row(_IS_SYMBOL[data])
    out[:, 6] = per_row(_IS_UPPER[data])
    out[:, 7] = per_row(_IS_DIGIT[data])
    out[:, 8] = per_row(_IS_MARK[data])
    short = np.zeros(len(w.hash) + 1, np.int64)
    np.cumsum(w.end - w.start <= 3, out=short[1:])
    out[:, 10] = np.diff(short[w.bounds])
    for r, text in enumerate(column.to_pylist()):
        out[r, 5], out[r, 3] = _dup_lines(text)
        own = w.hash[w.bounds[r] : w.bounds[r + 1]]
        out[r, 4] = _repeated(A.windows(own, WINDOW))
        out[r, 9] = len(np.unique(own))
    return out


def features(counts: np.ndarray) -> np.ndarray:
    c = dict(zip(COUNTS, counts.T.astype(float), strict=True))
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    columns = {
        "log_words": np.log1p(c["n_words"]), "word_length": c["word_chars"] / words,
        "symbols": c["n_symbols"] / words, "dup_lines": c["n_dup_lines"] / lines,
        "repeated": c["n_repeat_words"] / words, "upper": c["n_upper"] / chars,
        "digits": c["n_digits"] / chars, "marks": c["n_marks"] / words,
        "distinct": c["n_distinct"] / words, "line_length": c["n_words"] / lines,
        "short": c["n_short"] / words,
    }
    return np.stack([columns[f] for f in FEATURES], 1)


# --- trees ------------------------------------------------------------------------------------

class Trees(NamedTuple):
    """Nodes of all trees in one array each; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of being good."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                lower = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(lower, self.left[node], self.right[node])
            total += self.value[node]
        return total


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
    ridge: float = 1.0, leaf: float = 5.0, falling: frozenset[int] | None = None,
) -> Trees:
    """Second-order boosting of the logistic loss over feature quantiles."""
    falling = frozenset(FEATURES.index(f) for f in FALLING) if falling is None else falling
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], 1)
    rate_of = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    start = float(np.log(rate_of / (1 - rate_of)))
    margin = np.full(len(y), start)
    nodes: list[list[float]] = []
    roots = []

    def weight(g: np.ndarray, h: np.ndarray, bounds: tuple[float, float]) -> np.ndarray:
        return np.clip(-g / (h + ridge), *bounds)

    def gain(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        return -(g * w + 0.5 * (h + ridge) * w * w)

    def grow(rows: np.ndarray, level: int, bounds: tuple[float, float]) -> int:
        me = len(nodes)
        g, h = grad[rows], hess[rows]
        total_g, total_h = g.sum(), h.sum()
        own = weight(total_g, total_h, bounds)
        nodes.append([0, np.inf, me, me, rate * float(own)])
        best = (1e-6, -1, -1, 0.0, 0.0)
        for f, c in enumerate(cuts if level < depth else []):
            if not len(c):
                continue
            left_g = np.cumsum(np.bincount(binned[rows, f], g, len(c) + 1))[:-1]
            left_h = np.cumsum(np.bincount(binned[rows, f], h, len(c) + 1))[:-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            lw, rw = weight(left_g, left_h, bounds), weight(right_g, right_h, bounds)
            more = gain(left_g, left_h, lw) + gain(right_g, right_h, rw) - gain(total_g, total_h, own)
            more[(left_h < leaf / 4) | (right_h < leaf / 4) | ((f in falling) & (rw > lw))] = -np.inf
            k = int(np.argmax(more))
            if more[k] > best[0]:
                best = (float(more[k]), f, k, float(lw[k]), float(rw[k]))
        if best[1] >= 0:
            _, f, k, lw, rw = best
            middle = (lw + rw) / 2
            left_bounds = (max(bounds[0], middle), bounds[1]) if f in falling else bounds
            right_bounds = (bounds[0], min(bounds[1], middle)) if f in falling else bounds
            low = binned[rows, f] <= k
            nodes[me][:2] = [f, float(cuts[f][k])]
            nodes[me][2] = grow(rows[low], level + 1, left_bounds)
            nodes[me][3] = grow(rows[~low], level + 1, right_bounds)
        else:
            margin[rows] += rate * float(own)
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(grow(np.arange(len(y)), 0, (-np.inf, np.inf)))
    table = np.array(nodes, float).reshape(-1, 5)
    whole = [table[:, i].astype(np.int64) for i in (0, 2, 3)]
    return Trees(np.array(roots), whole[0], table[:, 1], whole[1], whole[2], table[:, 4], depth, start)


# --- passes -----------------------------------------------------------------------------------

def _labelled_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in A.slices(batch, "text"):
            counts = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"), *[pa.array(counts[:, i]) for i in range(len(COUNTS))]],
                names=["doc_id", "label", *COUNTS],
            )


def labelled(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """Statistics and label of the sampled labelled documents: at most ``sample`` rows.

    Of several rows with one id the one of least statistics counts.
    """
    chosen = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit(4), "doc_id"), "doc_id").limit(sample)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", "label", "text").mapInArrow(
        _labelled_batches, f"doc_id {kind}, label int, " + ", ".join(f"{c} long" for c in COUNTS)
    )
    return rows.groupBy("doc_id").agg(F.min(F.struct("label", *COUNTS)).alias("row")).select("row.*")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Trees | None:
    table = labelled(docs, labels, label, sample).toArrow()
    y = table.column("label").to_numpy().astype(float) > 0
    if y.all() or not y.any():
        return None
    counts = np.stack([table.column(c).to_numpy() for c in COUNTS], 1)
    order = np.lexsort((*counts.T, y))  # the order of collected rows must not matter
    return fit(features(counts[order]), y[order].astype(float))


STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def judge(docs: DataFrame, model: Trees | None, keep: float = 0.5) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed``, ``score`` and ``kept`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model and tuple(model))
    names = [s.split()[0] for s in STATISTICS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = Trees(*shared.value) if shared.value else None
        for batch in batches:
            for part in A.slices(batch, "text"):
                counts = statistics(part.column("text"))
                failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
                odds = trees.score(features(counts)) if trees else np.full(len(counts), 9.0)
                score = 1 / (1 + np.exp(-odds))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(counts[:, i]) for i in range(len(names))],
                     pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep))],
                    names=["doc_id", *names, "base_failed", "score", "kept"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, {STATISTICS}, base_failed boolean, score double, kept boolean"
    )
