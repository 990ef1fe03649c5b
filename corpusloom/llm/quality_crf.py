"""Quality classifier: a linear-chain conditional random field over lines.

Each line of a document is good or bad. Its features are shares of byte classes,
length, ending and repetition, together with those of the lines before and after;
a transition weight ties neighbouring labels. Trained on documents labelled by
``labels.quality`` (every line takes its document's label), scored by
forward-backward: the document's quality is the mean of its lines' marginals,
weighted by their length.

The fit uses a bounded sample: the TRAIN_DOCS labelled documents of least hash that
aren't held out, but for those of over TRAIN_LINES lines. Scoring covers all rows and
all lines, each where it is, without a shuffle; inputs are the text and nothing else.

Defined results: a null or empty text scores the share of good documents in the
sample; without any usable label every score is 0.5; labels that repeat a document
count as their mean, ties good; a row without ``doc_id`` is held out; repeated rows
are each scored; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordhash import Words, text_slices

TRAIN_DOCS, TRAIN_LINES = 3000, 400
STEPS, RATE, RIDGE = 120, 0.1, 1e-3
FOLDS, HELD = 3, 1

_CLASS = np.zeros(256, dtype=np.uint8)  # 0: other
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[97:123] = 2
_CLASS[128:] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[35, 42, 36, 37, 38, 124, 60, 62]] = 5
_CLASS[[46, 33, 63, 44, 59, 58, 39, 34, 40, 41, 45]] = 6
_END = np.zeros(256, dtype=bool)
_END[[46, 33, 63]] = True
#: Words back within which an equal word counts as a repetition.
ECHO = 6


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(True))


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, weight of each line, first line of each row)."""
    rows = len(offsets) - 1
    breaks = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # a break at the end of a row opens an empty last line there, at the next row's offset
    owner = np.sort(np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, side="right") - 1]), kind="stable")
    starts = starts[np.lexsort((starts, owner))] if len(starts) else starts
    first = np.searchsorted(owner, np.arange(rows + 1))
    ends = np.empty(len(starts), dtype=np.int64)
    ends[:-1] = starts[1:] - 1
    last = first[1:] - 1
    ends[last] = offsets[1:]
    n = np.maximum(ends - starts, 0).astype(np.float64)
    sums = np.zeros(len(raw) + 1, dtype=np.int64)
    cls = _CLASS[raw]
    counts = []
    for k in range(1, 7):
        np.cumsum(cls == k, out=sums[1:])
        counts.append((sums[ends] - sums[starts]).astype(np.float64))
    w = Words(raw, offsets, lower=True)
    # the words of a line are those that start in it
    lo, hi = np.searchsorted(w.start, starts), np.searchsorted(w.start, ends)
    hi = np.maximum(hi, lo)
    words = (hi - lo).astype(np.float64)
    echo, near = np.zeros(len(w.hash), dtype=bool), np.zeros(len(w.hash), dtype=bool)
    for lag in range(1, ECHO + 1):
        near[lag:] |= w.hash[lag:] == w.hash[:-lag]
        if lag == 1:
            echo[:] = near
    share = lambda flags: (lambda c: (c[hi] - c[lo]) / np.maximum(words, 1))(np.concatenate(([0], np.cumsum(flags))))
    blank, low, up, digit, symbol, mark = counts
    full = np.maximum(n - blank, 1.0)
    ending = np.zeros(len(n))
    some = n > 0
    ending[some] = _END[raw[ends[some] - 1]]
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(w.hash, dtype=np.uint64)))
    body = total[hi] - total[lo]  # equal for lines of equal words, and for few others
    key = np.lexsort((body, owner))
    again = np.zeros(len(n))
    if len(n) > 1:
        same = (body[key][1:] == body[key][:-1]) & (owner[key][1:] == owner[key][:-1]) & (words[key][1:] > 0)
        again[key[1:][same]] = 1.0
    x = np.stack(
        [np.log1p(n) / 5, low / full, up / full, digit / full, symbol / full, mark / full, blank / np.maximum(n, 1), np.log1p(words) / 3,
         np.minimum(full / np.maximum(words, 1), 30) / 10, ending, again, (words <= 3).astype(np.float64),
         share(echo), share(near)], axis=1,
    )
    return x, full * (n > blank), first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after (0 beyond the ends), and 1."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    heads = first[:-1]
    before[heads[heads < len(x)]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


def marginals(unary: np.ndarray, turn: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line is good) for every line, and the expected counts of the transitions.
    ``unary``: log odds of good by the line alone; ``turn``: 2 x 2 log weights. The
    chains run side by side, position by position."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    heads, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # rows longer than t
    a = np.zeros((len(unary), 2))
    b = np.zeros((len(unary), 2))
    for t in range(longest):
        at = heads[: active[t]] + t
        own = np.stack([np.zeros(len(at)), unary[at]], axis=1)
        if t:
            own += np.logaddexp(a[at - 1][:, :1] + turn[0], a[at - 1][:, 1:] + turn[1])
        a[at] = own - np.logaddexp(own[:, :1], own[:, 1:])
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = heads[: active[t + 1]] + t
        nxt = b[at + 1] + np.stack([np.zeros(len(at)), unary[at + 1]], axis=1)
        both = a[at][:, :, None] + turn[None] + nxt[:, None, :]
        p = np.exp(both - both.max(axis=(1, 2), keepdims=True))
        pairs += (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = np.logaddexp(turn[:, 0][None] + nxt[:, :1], turn[:, 1][None] + nxt[:, 1:])
        b[at] = back - np.logaddexp(back[:, :1], back[:, 1:])
    both = a + b
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), pairs


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions that maximise the ridged likelihood of the documents'
    labels ``y`` on all their lines (Adam on the exact gradient)."""
    size = np.diff(first)
    label = np.repeat(y, size).astype(np.float64)
    inner = np.maximum(size - 1, 0)
    seen = np.array([[inner[y == 0].sum(), 0.0], [0.0, inner[y == 1].sum()]])
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        p, pairs = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), first)
        grad = np.concatenate([x.T @ (label - p), (seen - pairs).ravel()]) / max(len(y), 1) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray | None, np.ndarray | None, float]:
    """(weights, transitions, share of good documents) from the sample."""
    known = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("y")).filter(~held_out(F.col("doc_id")))
    )
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS).select(F.col("doc_id").alias("l_id"), "y")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("l_id"))  # TRAIN_DOCS rows at most
        .filter(lines <= TRAIN_LINES).select("doc_id", "text", "y").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(TRAIN_DOCS).toArrow()
    )
    y = rows.column("y").to_numpy()
    if not len(y):
        return None, None, 0.5
    xs, firsts, at = [], [np.zeros(1, dtype=np.int64)], 0
    text = rows.column("text").combine_chunks()
    for _, raw, offsets in text_slices(text):
        x, _, first = line_features(raw, offsets)
        xs.append(with_neighbours(x, first))
        firsts.append(first[1:] + at)
        at += len(x)
    weights, turn = fit(np.concatenate(xs), np.concatenate(firsts), y)
    return weights, turn, float(y.mean())


def _scorer(weights: np.ndarray | None, turn: np.ndarray | None, prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, prior)
            for row, raw, offsets in text_slices(batch.column("text")) if weights is not None else ():
                x, weight, first = line_features(raw, offsets)
                p, _ = marginals(with_neighbours(x, first) @ weights, turn, first)
                total = np.add.reduceat(weight, first[:-1])
                good = np.add.reduceat(weight * p, first[:-1])
                n = len(offsets) - 1
                scores[row : row + n] = np.where(total > 0, good / np.maximum(total, 1), prior)
            scores = np.clip(scores, 0.0, 1.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, labels)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        _scorer(*model), "doc_id long, held_out boolean, score double, predicted int"
    )
