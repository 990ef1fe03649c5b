"""Substring dedup with repeated-phrase automata.

A window is 50 consecutive words. A word goes if a window over it also starts in a
document with a smaller doc_id.

1. Anchors. Of the 16-word grams in a window, the one of least hash is its anchor.
   Equal windows have equal anchors, and only one word in twenty starts one, so
   anchors found in two documents narrow the search to a small part of the words.
2. Confirmation. The stretches of windows around such anchors ("pieces") are cut
   out; their windows are counted with the first document and position of each,
   combined before the shuffle. Those in two documents or more are confirmed, and
   their runs in their first documents are the recurring passages.
3. Automata. The passages are dealt to shards by anchor; each shard compiles their
   windows into Aho-Corasick automata (pyahocorasick, over word numbers) of at most
   AUTOMATON windows each, and streams the pieces of all documents with an anchor of
   the shard through them, which locates every occurrence. A shard with many pieces
   is cut into slices by document, its passages copied to each.

Documents whose whole word sequence equals that of one with a smaller doc_id need
no search: all their windows recur, so all their words go if they have 50.

Defined results: a null or empty text has no words, and its kept text is empty; a
document of fewer than 50 words keeps all; rows that repeat a ``doc_id`` are judged
apart and never against each other; a row without ``doc_id`` is neither searched
nor searched against and keeps all; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .wordhash import Words, mixed, text_slices

WINDOW = 50
GRAM = 16
#: Confirmed windows per shard, pieces per slice and windows per automaton.
SHARD, SLICE, AUTOMATON = 20_000, 20_000, 20_000
#: A window's hash is made of those of runs of so many words.
STRIDE = 10


def _windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window start, row, anchor start) for each window of each row, word indexes."""
    n = len(w.hash)
    if n < WINDOW:
        z = np.zeros(0, dtype=np.int64)
        return z, z, w.hash[:0]
    g = w.grams(GRAM)
    least, at = g, np.arange(len(g))  # least gram of the next 1, 2, 4, ... and its place, the first of equal ones
    width, k = 1, WINDOW - GRAM + 1
    while width < k:
        d = min(width, k - width)
        at = np.where(least[d:] < least[:-d], at[d:], at[:-d])
        least = np.minimum(least[d:], least[:-d])
        width += d
    start = np.arange(n - WINDOW + 1)
    row = np.searchsorted(w.first, start, side="right") - 1
    ok = start + WINDOW <= w.first[row + 1]
    return start[ok], row[ok], at[start[ok]]


def _row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of 64-bit values, which run over, from each of ``first`` to the next."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    return (sums[first[1:]] - sums[first[:-1]]).view(np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, fp, n_words, a 128-bit hash of the word sequence, and the anchors."""
    for batch in batches:
        ids, fps = batch.column("doc_id").to_pylist(), batch.column("fp").to_pylist()
        for first, raw, offsets in text_slices(batch.column("text")):
            w = Words(raw, offsets, lower=False)
            g = w.grams(GRAM)
            start, row, anchor = _windows(w)
            new = np.ones(len(anchor), dtype=bool)
            new[1:] = anchor[1:] != anchor[:-1]
            rows, hashes = row[new], g[anchor[new]] if len(anchor) else g[:0]
            cut = np.searchsorted(rows, np.arange(len(offsets)))
            n = np.diff(w.first)
            place = (np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)).astype(np.uint64)
            sums = [_row_sums(mixed(w.hash ^ mixed(place, 5 + i), 7 + i), w.first) for i in range(2)]
            anchors = [np.unique(hashes[cut[r] : cut[r + 1]]).view(np.int64) for r in range(len(n))]
            out = (ids[first : first + len(n)], fps[first : first + len(n)], n, *sums, anchors)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "fp", "n_words", "s1", "s2", "anchors"])


def _word_numbers(w: Words, a: int, b: int) -> np.ndarray:
    return (w.hash[a:b] >> np.uint64(32)).astype(np.uint32)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their recurring anchors -> pieces: anchor, doc_id, fp, start (word) and
    the numbers of the words as bytes."""
    for batch in batches:
        ids, fps, wanted = batch.column("doc_id").to_pylist(), batch.column("fp").to_pylist(), batch.column("anchors")
        for first, raw, offsets in text_slices(batch.column("text")):
            w = Words(raw, offsets, lower=False)
            g = w.grams(GRAM)
            start, row, anchor = _windows(w)
            out: list[list] = [[], [], [], [], []]
            if len(start):
                heads = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
                tails = np.append(heads[1:], len(start)) - 1
                want = {r: set(wanted[first + r].as_py() or ()) for r in np.unique(row)}
                names = g[anchor[heads]].view(np.int64).tolist()
                for h, t, name in zip(heads.tolist(), tails.tolist(), names, strict=True):
                    r = int(row[h])
                    if name in want[r]:
                        a, b = int(start[h]), int(start[t]) + WINDOW
                        for c, v in zip(out, (name, ids[first + r], fps[first + r], a - int(w.first[r]), _word_numbers(w, a, b).tobytes()), strict=True):
                            c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["anchor", "doc_id", "fp", "start", "words"])


def _weighted(values: np.ndarray, step: int, n: int, seed: int) -> np.ndarray:
    """Hash of the ``n`` values, ``step`` apart, from each one on."""
    place = mixed(np.arange(n, dtype=np.uint64), seed) | np.uint64(1)
    total = np.zeros(max(0, len(values) - step * (n - 1)), dtype=np.uint64)
    for k in range(n):
        total += values[k * step : k * step + len(total)] * place[k]
    return mixed(total, seed + 1)


def _window_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW words from each word on: of runs of STRIDE, then of these."""
    runs = _weighted(mixed(words.astype(np.uint64), 10), 1, STRIDE, 11)
    return _weighted(runs, STRIDE, WINDOW // STRIDE, 13)


def _piece_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of pieces, many pieces at a time: their words lie one behind the other
    in one buffer, and a window that runs from one piece into the next is left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            words = part.column("words").cast(pa.large_binary())
            cuts = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
            hashes = _window_hashes(np.frombuffer(words.buffers()[2], dtype=np.uint8)[cuts[0] : cuts[-1]].view(np.uint32))
            first = (cuts - cuts[0]) // 4
            n = np.maximum(np.diff(first) - WINDOW + 1, 0)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            repeat = lambda c: np.repeat(part.column(c).to_numpy(zero_copy_only=False), n)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[np.repeat(first[:-1], n) + within].view(np.int64)), *(pa.array(repeat(c)) for c in ("anchor", "doc_id", "fp")), pa.array(repeat("start") + within)],
                names=["h", "anchor", "doc_id", "fp", "pos"],
            )


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of first documents with the positions of their confirmed windows -> the
    runs of these: anchor, doc_id and words."""
    for batch in batches:
        out: list[list] = [[], [], []]
        for anchor, doc, start, words, pos in zip(*(batch.column(c) for c in ("anchor", "doc_id", "start", "words", "pos")), strict=True):
            w = np.frombuffer(words.as_buffer(), dtype=np.uint32)
            p = np.unique(pos.values.to_numpy()) - start.as_py()
            p = p[(p >= 0) & (p <= len(w) - WINDOW)]
            for run in np.split(p, np.flatnonzero(np.diff(p) > 1) + 1) if len(p) else ():
                for c, v in zip(out, (anchor.as_py(), doc.as_py(), w[run[0] : run[-1] + WINDOW].tobytes()), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "doc_id", "words"])


def _automata(passages: pd.DataFrame) -> Iterator[ahocorasick.Automaton]:
    """Automata over the windows of the passages, AUTOMATON windows each."""
    machine, size = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), 0
    for doc, words in zip(passages["doc_id"], passages["words"], strict=True):
        w = np.frombuffer(words, dtype=np.uint32).tolist()
        for i in range(len(w) - WINDOW + 1):
            key = tuple(w[i : i + WINDOW])
            machine.add_word(key, min(int(doc), machine.get(key, int(doc))))
            size += 1
            if size >= AUTOMATON:
                machine.make_automaton()
                yield machine
                machine, size = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), 0
    if size:
        machine.make_automaton()
        yield machine


def _runs(found: list[tuple[int, int]], doc: int) -> list[tuple[int, int]]:
    """Stretches that windows of documents before ``doc`` cover, of (last word, first document)."""
    runs: list[tuple[int, int]] = []
    a = b = -1
    for end, first in found:
        if first < doc:
            if end - WINDOW + 1 > b:
                if b >= 0:
                    runs.append((a, b))
                a = end - WINDOW + 1
            b = end + 1
    return [*runs, (a, b)] if b >= 0 else runs


def _locate(key: tuple, pieces: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
    """Every stretch of the pieces that windows of smaller documents cover. Equal pieces
    are streamed once."""
    hits: list[tuple] = []
    if len(passages):
        equal: dict[bytes, list] = {}
        for row in zip(pieces["words"], pieces["doc_id"], pieces["fp"], pieces["start"], strict=True):
            equal.setdefault(row[0], []).append(row[1:])
        texts = [(tuple(np.frombuffer(x, dtype=np.uint32).tolist()), rows) for x, rows in equal.items()]
        for machine in _automata(passages):
            for words, rows in texts:
                found = list(machine.iter(words))
                if not found:
                    continue
                latest = max(first for _, first in found)
                every = _runs(found, latest + 1)
                for doc, fp, start in rows:
                    hits.extend((doc, fp, start + a, start + b) for a, b in (every if doc > latest else _runs(found, doc)))
    return pd.DataFrame(hits, columns=["doc_id", "fp", "a", "b"]).astype("int64")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for doc, text, whole, spans in zip(*(batch.column(c) for c in ("doc_id", "text", "whole", "spans")), strict=True):
            w = (text.as_py() or "").encode().split()  # splits at the same six blanks
            keep = np.ones(len(w), dtype=bool)
            if whole.as_py() and len(w) >= WINDOW:
                keep[:] = False
            for s in spans.as_py() or ():
                keep[s["a"] : s["b"]] = False
            kept = w if keep.all() else [x for x, k in zip(w, keep, strict=True) if k]
            for c, v in zip(out, (doc.as_py(), len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole, spans). ``docs`` has doc_id, text, fp. whole: doc_id, fp of documents that
    copy one with a smaller doc_id. spans: doc_id, fp, a, b, word ranges to remove."""
    scan = written(docs.filter("doc_id IS NOT NULL").mapInArrow(_scan, "doc_id long, fp long, n_words long, s1 long, s2 long, anchors array<long>"), "anchors")
    scan = scan.filter(F.col("n_words") >= WINDOW)
    firsts = scan.groupBy("n_words", "s1", "s2").agg(F.min("doc_id").alias("first"))
    known = scan.select("doc_id", "fp", "n_words", "s1", "s2").join(firsts, ["n_words", "s1", "s2"])
    whole = written(known.filter("doc_id > first").select("doc_id", "fp").distinct(), "whole-copies")
    searched = scan.join(whole, ["doc_id", "fp"], "left_anti").select("doc_id", "fp", F.explode("anchors").alias("anchor"))
    twice = searched.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("anchor")
    wanted = searched.join(twice, "anchor").groupBy("doc_id", "fp").agg(F.collect_set("anchor").alias("anchors"))
    found = docs.join(wanted, ["doc_id", "fp"]).select("doc_id", "fp", "text", "anchors")
    pieces = written(found.mapInArrow(_pieces, "anchor long, doc_id long, fp long, start long, words binary"), "pieces")

    windows = pieces.mapInArrow(_piece_windows, "h long, anchor long, doc_id long, fp long, pos long")
    counted = windows.groupBy("h", "anchor").agg(F.min(F.struct("doc_id", "fp", "pos")).alias("first"), F.max("doc_id").alias("last"))
    confirmed = written(counted.filter(F.col("first.doc_id") < F.col("last")).select("anchor", "first.*"), "confirmed")
    starts = confirmed.groupBy("doc_id", "fp", "anchor").agg(F.collect_list("pos").alias("pos"))
    passages = pieces.join(starts, ["doc_id", "fp", "anchor"]).mapInArrow(_passages, "anchor long, doc_id long, words binary")

    shards = max(1, -(-confirmed.count() // SHARD))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    live = pieces.join(confirmed.select("anchor").distinct(), "anchor", "left_semi").select(shard, "doc_id", "fp", "start", "words")
    live = written(live, "live-pieces")
    cuts = live.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    cuts = written(cuts, "slices")
    left = live.join(cuts, "shard").select(
        F.col("shard").alias("l_shard"), F.pmod(F.xxhash64("doc_id", "start"), F.col("slices")).cast("int").alias("l_slice"),
        "doc_id", "fp", "start", "words",
    )
    copies = cuts.select(F.col("shard").alias("r_shard"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("r_slice"))
    right = passages.select(shard, "doc_id", "words").join(copies, F.col("shard") == F.col("r_shard")).select("r_shard", "r_slice", "doc_id", "words")
    spans = (
        left.groupBy("l_shard", "l_slice")
        .cogroup(right.groupBy("r_shard", "r_slice"))
        .applyInPandas(_locate, "doc_id long, fp long, a long, b long")
    )
    return whole, written(spans, "spans")


def substring_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp"))
    whole, spans = repeated_spans(docs)
    cuts = whole.select("doc_id", "fp", F.lit(True).alias("whole"), F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("spans")).unionByName(
        spans.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("a", "b")).alias("spans")).select("doc_id", "fp", F.lit(False).alias("whole"), "spans")
    )
    return docs.join(cuts, ["doc_id", "fp"], "left").select("doc_id", "text", "whole", "spans").mapInArrow(
        _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )
