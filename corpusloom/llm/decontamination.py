"""Benchmark decontamination: n-gram seeds and Smith-Waterman alignment.

The benchmark is a query set against all documents, taken in blocks of about
BLOCK_ITEMS items and BLOCK_CHARS characters, so that what is sent to the tasks is
bounded. Every 3-gram of an item is a seed, however many documents hold it: edited
copies keep some run of three words, and a gram left out for being frequent could be
the only one. A pass over the documents finds the seeds and aligns the words around
the hits with the item by Smith-Waterman, which tolerates replaced, added and missing
words. What frequent seeds bring is held down by a bound alone: an alignment scores
no more than the item has words that the document, or the stretch of it, holds too,
so that below the threshold none is computed. The texts are read where they lie and
nothing is shuffled.

Words are lower-cased (A-Z) and free of ASCII punctuation here. The similarity is
the alignment score (1 for an equal word, -0.5 for a replaced, added or missing
one) divided by the item's number of words; THRESHOLD and more is a leak. n_seeds is
the number of places of the document where a 3-gram of the item stands.

Defined results: null or empty texts and items match nothing; an item of fewer than
three words is one seed, found as a whole document of these words only (anywhere
else it says nothing); rows that repeat a document or an item are each matched; an
empty benchmark or an empty table gives an empty result; extra columns are ignored.
A copy without any three words of the item in a row isn't found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fingerprint, packed, written
from .wordhash import Words, row_grams, text_slices

N = 3
THRESHOLD = 0.5
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
MATCH, OTHER, GAP = 1.0, -0.5, 0.5


class _Items:
    """Seeds and words of a block of items."""

    def __init__(self, ids: list, texts: list[str | None]) -> None:
        self.ids, self.words, grams = ids, [], []
        for first, raw, offsets in text_slices(pa.array(texts, pa.string())):
            w = Words(raw, offsets, lower=True, marks=True)
            g = w.grams(N)
            for r in range(len(offsets) - 1):
                self.words.append(w.hash[w.first[r] : w.first[r + 1]])
                grams.append(np.unique(row_grams(w, g, N, r)))
        self.by_seed: dict[int, list[int]] = {}
        for i, g in enumerate(grams):
            for x in g:
                self.by_seed.setdefault(int(x), []).append(i)
        self.seeds = np.array(sorted(self.by_seed), dtype=np.uint64)
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, dtype=np.uint64)
        self.codes = [np.searchsorted(self.vocabulary, x) for x in self.words]

    def held(self, words: np.ndarray) -> np.ndarray:
        """Which words of the vocabulary are among ``words``."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        out = np.zeros(len(self.vocabulary), dtype=bool)
        out[at[self.vocabulary[at] == words]] = True
        return out


def _seed_hits(seeds: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Indexes of the grams that are seeds."""
    table = np.zeros(1 << 20, dtype=bool)
    table[(seeds >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(table[(grams >> np.uint64(44)).astype(np.int64)])
    if not len(maybe):
        return maybe
    at = np.minimum(np.searchsorted(seeds, grams[maybe]), len(seeds) - 1)
    return maybe[seeds[at] == grams[maybe]]


def _hits(batches: Iterator[pa.RecordBatch], seeds: np.ndarray):
    """(batch, row, words of the row, positions and hashes of its seeds), rows with any."""
    for batch in batches:
        for first, raw, offsets in text_slices(batch.column("text")):
            w = Words(raw, offsets, lower=True, marks=True)
            g = w.grams(N)
            at = _seed_hits(seeds, g)
            row = np.searchsorted(w.first, at, side="right") - 1
            inside = at + N <= w.first[row + 1]
            at, row = at[inside], row[inside]
            short = np.flatnonzero((np.diff(w.first) < N) & (np.diff(w.first) > 0))
            for r in np.unique(np.concatenate([row, short])):
                mine = at[row == r] if len(at) else at
                words = w.hash[w.first[r] : w.first[r + 1]]
                if len(words) < N:
                    h = row_grams(w, g, N, r)
                    if np.isin(h, seeds).all():
                        yield batch, first + r, words, np.zeros(1, dtype=np.int64), h
                elif len(mine):
                    yield batch, first + r, words, mine - w.first[r], g[mine]


def smith_waterman(a: np.ndarray, b: np.ndarray) -> float:
    """Best local alignment score of two word sequences with linear gap cost."""
    j = np.arange(len(b)) * GAP
    prev, best = np.zeros(len(b)), 0.0
    for x in a:
        diagonal = np.concatenate(([0.0], prev[:-1])) + np.where(b == x, MATCH, OTHER)
        cell = np.maximum(np.maximum(diagonal, prev - GAP), 0.0)
        prev = np.maximum.accumulate(cell + j) - j
        best = max(best, float(prev.max()))
    return best


def _windows(pos: np.ndarray, reach: int, n: int) -> list[tuple[int, int]]:
    """Stretches of ``reach`` words around the hits, merged where they meet."""
    out: list[list[int]] = []
    for p in np.sort(pos):
        a, b = max(0, int(p) - reach), min(n, int(p) + N + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _aligner(items: _Items, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, its, seeds, sims = [], [], [], []
        for batch, row, words, pos, h in _hits(batches, items.seeds):
            found: dict[int, list[int]] = {}
            for p, x in zip(pos, h, strict=True):
                for i in items.by_seed[int(x)]:
                    found.setdefault(i, []).append(int(p))
            held = items.held(words)
            for i, ps in found.items():
                item = items.words[i]
                least = threshold * len(item)
                if held[items.codes[i]].sum() < least:
                    continue
                near = [words[a:b] for a, b in _windows(np.array(ps), len(item), len(words))]
                score = max((smith_waterman(item, w) for w in near if np.isin(item, w).sum() >= least), default=-1.0)
                if score >= least:
                    docs.append(batch.column("doc_id")[row].as_py())
                    its.append(items.ids[i])
                    seeds.append(len(ps))
                    sims.append(score / len(item))
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(its, pa.int64()), pa.array(seeds, pa.int64()), pa.array(sims, pa.float64())],
            names=["doc_id", "item_id", "n_seeds", "similarity"],
        )

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_seeds, similarity) for each document and item that align."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("length(text) > 0")
    count, chars = items.agg(F.count(F.lit(1)), F.sum(F.char_length("text"))).first()
    n_blocks = max(-(-count // BLOCK_ITEMS), -(-(chars or 0) // BLOCK_CHARS))
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_seeds long, similarity double")
    for k in range(n_blocks):
        part = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        rows = part.orderBy("item_id", "text").collect()  # a block
        block = _Items([r["item_id"] for r in rows], [r["text"] for r in rows])
        if not len(block.seeds):
            continue
        found = docs.mapInArrow(_aligner(block, threshold), "doc_id long, item_id long, n_seeds long, similarity double")
        out = found if n_blocks == 1 else out.unionByName(written(found, "leaks"))
    return out


def drop_leaking(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text aligns with no item, unchanged."""
    keyed = docs.select(fingerprint(F.col("text")).alias("doc_id"), "text")
    gone = written(find_leaks(keyed, benchmark, threshold).select(F.col("doc_id").alias("gone")).distinct(), "leaking")
    rows = packed(docs, k_fp=fingerprint(F.col("text")))
    return rows.join(gone, F.col("k_fp") == F.col("gone"), "left_anti").select("doc.*")
