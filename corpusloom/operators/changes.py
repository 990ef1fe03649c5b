"""Snapshot differences and name-status feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors


def file_hashes(content: DataFrame) -> DataFrame:
    return content.select("repo", "path", F.sha2("content", 256).alias("sha256"))


def diff_hashes(current: DataFrame, stored: DataFrame, suffix: str = ".py", symmetric: bool = False) -> DataFrame:
    """(repo, path, status A, M or D). Only the current side is filtered by ``suffix``
    unless ``symmetric``, so that other stored files show as deleted."""
    cur = current.filter(F.col("path").endswith(suffix)).select("repo", "path", F.col("sha256").alias("now"), F.lit(True).alias("is_now"))
    old = stored.filter(F.col("path").endswith(suffix)) if symmetric else stored
    old = old.select("repo", "path", F.col("sha256").alias("then"), F.lit(True).alias("was"))
    j = cur.join(old, ["repo", "path"], "full_outer")
    status = F.when(F.col("was").isNull(), "A").when(F.col("is_now").isNull(), "D").when(~F.col("now").eqNullSafe(F.col("then")), "M")
    return j.select("repo", "path", status.alias("status")).filter("status IS NOT NULL")


def parse_feed(feed: DataFrame, key: str | None = None) -> DataFrame:
    """(key, path, status) of tab-separated lines: M, A and D as they are, a rename as D
    of the old and A of the new path; anything else is dropped."""
    parts = F.split("line", "\t")
    one = lambda s, i: F.struct(F.lit(s).alias("status"), F.get(parts, F.lit(i)).alias("path"))
    code = F.get(parts, F.lit(0))
    rows = (
        F.when(code.isin("M", "A", "D") & (F.size(parts) >= 2), F.array(F.struct(code.alias("status"), F.get(parts, F.lit(1)).alias("path"))))
        .when(code.startswith("R") & (F.size(parts) >= 3), F.array(one("D", 1), one("A", 2)))
    )
    cols = [key] if key else []
    return feed.select(*cols, F.explode(rows).alias("x")).select(*cols, F.col("x.path").alias("path"), F.col("x.status").alias("status"))


def detect_changes(feed: DataFrame | None = None, current: DataFrame | None = None, stored: DataFrame | None = None, repo: str = "") -> DataFrame:
    """The feed if there is one, else the hashes."""
    if feed is not None:
        return parse_feed(feed).select(F.lit(repo).alias("repo"), "path", "status").distinct()
    if current is None or stored is None:
        raise ValueError("give a feed, or current and stored hashes")
    return diff_hashes(current, stored)


def detect_by_repo(feed: DataFrame, current: DataFrame, stored: DataFrame) -> DataFrame:
    """(repo, path, status) for many repositories at once: of those with rows in ``feed``
    (repo, line), as their base commit is known, the feed tells; of the others the hashes."""
    told = parse_feed(feed, "repo").select("repo", "path", "status").distinct()
    known = feed.select("repo").distinct()
    others = lambda rows: rows.join(known, "repo", "left_anti")
    return told.unionByName(diff_hashes(others(current), others(stored)))


def change_totals(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def affected_directories(changes: DataFrame) -> DataFrame:
    return changes.select("repo", F.explode(ancestors(F.col("path"))).alias("dir")).distinct()


def changed_paths(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("repo", "path")
    for p in parts[1:]:
        out = out.unionByName(p.select("repo", "path"))
    return out.distinct()
