"""Merkle fixity audit of WARC replicas.

Every record is hashed, records are gathered into nodes by ordered offset ranges of
their file (RANGE bytes at the lowest level, FANOUT times as many at each next one),
and a node's digest is the hash of its children's in order. Two replicas are
compared from the roots down: only the children of nodes that differ are joined, so
an intact file costs one comparison, and what differs is located to the record: of the
ranges that differ, records equal in id and digest are set aside wherever they stand
(a changed length moves all that follows in its file), and the rest are matched by id.

All of it is grouping and joining by (file, node); a range holds a bounded number of
records, so no group grows with a file, and a file with a third of all records is as
parallel as any. Only the number of levels reaches the driver.

Defined results: a null payload is an empty one; records without a file belong to
file '' and those without an offset stand below 0, spread by their digest; records
that repeat an offset are hashed together in the order of their digests, those that
repeat an id are matched in the order of their offsets; a record without id has id '';
empty tables have no nodes, so that against an empty replica every record is missing;
pages without id are dealt to files by a hash of their url; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

RANGE, FANOUT = 1 << 16, 16
#: Pages per WARC file of the exported table.
FILE_PAGES = 500
#: Added to a page's id for the stray record behind it in the derived replica.
STRAY = 1 << 40


def warc_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """A response record in WARC/1.0 form, as text."""
    html = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def _file_of(page_id: Column, url: Column) -> Column:
    spread = F.format_string("crawl-x%05x.warc", F.pmod(F.xxhash64(url), F.lit(1 << 20)))
    return F.when(page_id.isNull(), spread).otherwise(F.format_string("crawl-%05d.warc", F.floor(page_id / FILE_PAGES).cast("long")))


def export_records(pages: DataFrame) -> DataFrame:
    """Pages as WARC records: page_id, record_id, file, offset, length, digest. A file holds
    the pages of FILE_PAGES ids, in order, or what a column ``file`` says; offsets are
    running sums within it."""
    rec = warc_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    file = F.col("file") if "file" in pages.columns else _file_of(F.col("page_id"), F.col("url"))
    rows = pages.select("page_id", file.alias("file"), rec.alias("rec")).select(
        "page_id", "file", F.octet_length("rec").cast("long").alias("length"), F.sha2("rec", 256).alias("digest")
    )
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "page_id", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"), "file",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"), "length", "digest",
    )


def _leaves(records: DataFrame) -> DataFrame:
    low = -1 - F.pmod(F.xxhash64("digest"), F.lit(1 << 40))
    record = F.coalesce("record_id", F.lit("")) if "record_id" in records.columns else F.lit("")
    return records.select(
        F.coalesce("file", F.lit("")).alias("file"), F.coalesce(F.col("offset").cast("long"), low).alias("offset"), record.alias("record_id"), "digest"
    )


def merkle_nodes(records: DataFrame, levels: int) -> DataFrame:
    """Nodes (level, file, node, digest) over leaves (file, offset, digest). Level 1
    hashes the records of a range; level l+1 hashes FANOUT nodes of level l."""
    hashed = lambda place: F.sha2(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, "digest"))), lambda x: F.concat_ws(":", x[place].cast("string"), x["digest"])), ","), 256
    )
    level = records.withColumn("node", F.floor(F.col("offset") / RANGE).cast("long"))
    level = written(level.groupBy("file", "node").agg(hashed("offset").alias("digest")).select(F.lit(1).alias("level"), "file", "node", "digest"), "merkle-1")
    out = level
    for k in range(2, levels + 1):
        up = level.select("file", F.floor(F.col("node") / FANOUT).cast("long").alias("up"), "node", "digest")
        level = written(up.groupBy("file", "up").agg(hashed("node").alias("digest")).select(F.lit(k).alias("level"), "file", F.col("up").alias("node"), "digest"), f"merkle-{k}")
        out = out.unionByName(level)
    return out


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    b = b.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("digest").alias("b_digest"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"b_{k}"))
    j = a.join(b, cond, "full_outer").filter(~F.col("digest").eqNullSafe(F.col("b_digest")))
    return j.select(*[F.coalesce(k, f"b_{k}").alias(k) for k in keys], F.col("digest").alias("digest_a"), F.col("b_digest").alias("digest_b"))


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("offset")
    return rows.withColumn("k", F.row_number().over(w))


def _matched(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of records on ``keys`` and their number among equal ones."""
    side = lambda r, x: _numbered(r, keys).select("k", *keys, *[F.col(c).alias(f"{c}_{x}") for c in r.columns if c not in keys])
    return side(a, "a").join(side(b, "b"), ["k", *keys], "full_outer")


def locate_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records (file, offset, record_id, digest) in which replica ``b`` differs from ``a``:
    file, record_id, offset_a, offset_b, digest_a, digest_b, status (corrupt, missing or
    extra). A record that only stands elsewhere in its file doesn't differ."""
    a, b = _leaves(a), _leaves(b)
    top = max((x.agg(F.max(F.abs("offset"))).first()[0] or 0) for x in (a, b))
    levels = 1
    while RANGE * FANOUT ** (levels - 1) <= top:
        levels += 1
    ta, tb = merkle_nodes(a, levels), merkle_nodes(b, levels)
    bad = None
    for k in range(levels, 0, -1):
        na, nb = (t.filter(F.col("level") == k).select("file", "node", "digest") for t in (ta, tb))
        if bad is not None:
            up = bad.select(F.col("file").alias("p_file"), F.col("node").alias("p_node"))
            under = lambda n, up=up: n.join(up, (F.col("file") == F.col("p_file")) & (F.floor(F.col("node") / FANOUT) == F.col("p_node")), "left_semi")
            na, nb = under(na), under(nb)
        bad = written(_differing(na, nb, ["file", "node"]).select("file", "node"), f"differing-{k}")
    up = bad.select(F.col("file").alias("p_file"), F.col("node").alias("p_node"))
    leaf = lambda r: r.join(
        up, (F.col("file") == F.col("p_file")) & (F.floor(F.col("offset") / RANGE) == F.col("p_node")), "left_semi"
    )
    moved = written(_matched(leaf(a), leaf(b), ["file", "record_id", "digest"]).filter("offset_a IS NULL OR offset_b IS NULL"), "unmatched")
    left = lambda x: moved.filter(f"offset_{x} IS NOT NULL").select("file", "record_id", "digest", F.col(f"offset_{x}").alias("offset"))
    out = _matched(left("a"), left("b"), ["file", "record_id"])
    return out.select(
        "file", "record_id", "offset_a", "offset_b", "digest_a", "digest_b",
        F.when(F.col("offset_b").isNull(), "missing").when(F.col("offset_a").isNull(), "extra").otherwise("corrupt").alias("status"),
    )


def aged_replica(pages: DataFrame) -> DataFrame:
    """A second copy of the pages as a damaged disk might hold it, derived by a fixed
    rule: of 97 pages by crc32 of the id, one has a byte changed (5), one is lost (6),
    one is cut to half its length (7) and one is followed by a stray record (8)."""
    pages = pages.select("page_id", "url", "html", _file_of(F.col("page_id"), F.col("url")).alias("file"))
    kind = F.coalesce(F.crc32(F.col("page_id").cast("string").cast("binary")) % 97, F.lit(0))
    changed = F.concat(F.lit("?"), F.substring("html", 2, 2**31 - 1))
    half = F.substring(F.col("html"), F.lit(1), F.floor(F.char_length("html") / 2).cast("int"))
    html = F.when(kind == 5, changed).when(kind == 7, half).otherwise(F.col("html"))
    stray = pages.filter(kind == 8).select((F.col("page_id") + STRAY).alias("page_id"), "url", "html", "file")
    return pages.filter(kind != 6).select("page_id", "url", html.alias("html"), "file").unionByName(stray)


def audit_digest(pages: DataFrame) -> DataFrame:
    """Every record of the table and what the audit of its aged replica says of it, and the
    records that only the replica holds."""
    pages = pages.select("page_id", "url", "html")
    a = written(export_records(pages), "replica-a")
    b = written(export_records(aged_replica(pages)), "replica-b")
    found = written(locate_differences(a, b), "differences")
    told = found.filter("status <> 'extra'").select(F.col("file").alias("d_file"), F.col("offset_a").alias("d_offset"), "status")
    cols = ["page_id", F.col("file").alias("warc_file"), F.col("offset").alias("warc_offset"), F.col("length").alias("warc_length"), "digest"]
    known = a.join(told, (F.col("file") == F.col("d_file")) & (F.col("offset") == F.col("d_offset")), "left")
    extra = found.filter("status = 'extra'").select(F.col("file").alias("d_file"), F.col("offset_b").alias("d_offset"), "status")
    more = b.join(extra, (F.col("file") == F.col("d_file")) & (F.col("offset") == F.col("d_offset")))
    return known.select(*cols, F.coalesce("status", F.lit("ok")).alias("status")).unionByName(more.select(*cols, "status"))
