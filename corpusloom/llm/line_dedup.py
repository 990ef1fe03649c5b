"""Line dedup by range-partitioned line hashes.

Rows ``(hash, document, position)`` of all long lines are range-partitioned by
hash and a document slice, and sorted by document and position inside. A stream
over each range emits the first row of every document, which yields per hash
the number of documents and the one that keeps its lines. What comes back per
document is a run-length compressed keep bitmap, never text; the bitmap is
applied to the text in one last join.

Only DataFrame functions run here. A line held by a third of all documents is
split into ``slices`` ranges by document before anything is counted.

Defined results: a null or empty text is one empty line; lines equal within one
document all share that document's fate; a null ``doc_id`` counts as one
document that sorts below all others; rows that repeat a ``doc_id`` are each
returned; an empty table gives an empty result; extra columns are kept by
:func:`dedup_lines` and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, blank_trimmed, fingerprint, packed, release, written

MIN_CHARS = 40
MIN_DOCS = 5
SLICES = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line whose key has ``min_chars`` code points or more: doc_id, fp,
    pos and the 128-bit hash (h1, h2) of the key."""
    lines = docs.select(
        "doc_id", fingerprint(F.col("text")).alias("fp"), F.posexplode(_lines(F.col("text"))).alias("pos", "line")
    )
    stripped = lines.select("doc_id", "fp", "pos", blank_trimmed(F.col("line")).alias("line"))
    keys = stripped.filter(F.char_length("line") >= min_chars).select(
        "doc_id", "fp", "pos", ascii_lower(F.col("line")).alias("k")
    )
    return keys.select(
        "doc_id", "fp", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), F.col("k")).alias("h2")
    )


def repeated_lines(hashes: DataFrame, min_docs: int = MIN_DOCS, slices: int = SLICES) -> DataFrame:
    """Hashes found in ``min_docs`` documents or more, with ``top``, the largest
    doc_id that holds the line."""
    sliced = hashes.select("h1", "h2", "doc_id", "pos", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).alias("slice"))
    ranged = sliced.repartitionByRange("h1", "h2", "slice").sortWithinPartitions(
        "h1", "h2", "slice", F.desc_nulls_last("doc_id"), "pos"
    )
    stream = Window.partitionBy("h1", "h2", "slice").orderBy(F.desc_nulls_last("doc_id"), "pos")
    firsts = ranged.select(
        "h1", "h2", "slice", "doc_id",
        ((F.row_number().over(stream) == 1) | ~F.col("doc_id").eqNullSafe(F.lag("doc_id").over(stream))).alias("first"),
    ).filter("first")
    per_slice = firsts.groupBy("h1", "h2", "slice").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
    return (
        per_slice.groupBy("h1", "h2")
        .agg(F.sum("n").alias("n_docs"), F.max("top").alias("top"))
        .filter(F.col("n_docs") >= min_docs)
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document with a dropped line: doc_id, fp, n_dropped and ``dropped_runs``,
    the keep bitmap as runs of zeros (array of (start, length))."""
    hashes = written(line_hashes(docs, min_chars), "line-hashes")
    # written first, so that Spark can split the join at a line that many documents hold
    repeated = written(repeated_lines(hashes, min_docs), "repeated-lines").select(
        F.col("h1").alias("r1"), F.col("h2").alias("r2"), "top"
    )
    dropped = hashes.join(repeated, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))).filter(
        ~F.col("doc_id").eqNullSafe(F.col("top"))
    )
    # copies of a row hold each position more than once
    per_doc = dropped.groupBy("doc_id", "fp").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    edge = lambda step: F.filter(
        F.col("p"), lambda x, i: F.coalesce(F.get(F.col("p"), i + step) != x + step, F.lit(True))
    )
    runs = per_doc.select("doc_id", "fp", F.size("p").cast("long").alias("n_dropped"), edge(-1).alias("a"), edge(1).alias("b"))
    maps = runs.select(
        "doc_id", "fp", "n_dropped",
        F.zip_with("a", "b", lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length"))).alias("dropped_runs"),
    )
    maps = written(maps, "keep-bitmaps")
    release(hashes)
    return maps


def _kept(lines: Column, runs: Column) -> Column:
    """Lines outside the runs, by slices between one run's end and the next start."""
    before = F.transform(
        runs,
        lambda r, i: F.slice(
            lines,
            F.coalesce(F.get(runs, i - 1)["start"] + F.get(runs, i - 1)["length"], F.lit(0)) + 1,
            r["start"] - F.coalesce(F.get(runs, i - 1)["start"] + F.get(runs, i - 1)["length"], F.lit(0)),
        ),
    )
    last = F.element_at(runs, -1)
    end = last["start"] + last["length"]
    tail = F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0)))
    return F.concat(F.flatten(before), tail)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Each row of ``docs`` as struct ``doc`` with n_lines, n_dropped, dropped_runs
    and the kept text."""
    rows = packed(docs, k_id=F.col("doc_id"), k_fp=fingerprint(F.col("text")), text=F.col("text"))
    maps = bitmaps.select(F.col("doc_id").alias("m_id"), F.col("fp").alias("m_fp"), "n_dropped", "dropped_runs")
    joined = rows.join(
        maps, rows["k_id"].eqNullSafe(maps["m_id"]) & (rows["k_fp"] == maps["m_fp"]), "left"
    ).select("doc", "text", _lines(F.col("text")).alias("lines"), "n_dropped", "dropped_runs")
    return joined.select(
        "doc",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        "dropped_runs",
        F.when(F.col("dropped_runs").isNull(), F.coalesce("text", F.lit("")))
        .otherwise(F.array_join(_kept(F.col("lines"), F.col("dropped_runs")), "\n"))
        .alias("kept"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text`` and all other columns as
    they were, but for ``n_chars``, which follows the text where it exists."""
    out = apply_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs))
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("doc")["text"])
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(text.alias("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col("n_dropped") > 0, F.char_length("kept").cast("long")).otherwise(F.col("doc")[c]).alias(c))
        else:
            cols.append(F.col("doc")[c].alias(c))
    return out.select(*cols)


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and the run-length keep bitmap of every
    document: ``dropped_runs``, start:length of each run of dropped lines."""
    docs = docs.select("doc_id", "text")
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select(
        F.col("doc")["doc_id"].alias("doc_id"), "n_lines", "n_dropped",
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
        F.coalesce(
            F.array_join(F.transform("dropped_runs", lambda r: F.concat_ws(":", r["start"].cast("string"), r["length"].cast("string"))), ","), F.lit("")
        ).alias("dropped_runs"),
    )
