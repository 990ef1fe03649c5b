"""Reports on how packages depend on each other, for all packages in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import parent_package
from ..schemas import IMPORTS
from .hierarchy import contained_by


def inventory_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum("token_est").alias("tokens"))


def importers(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("relationship") == IMPORTS).groupBy("repo", "dst", "src").agg(F.count(F.lit(1)).alias("n"))


def package_pairs(edges: DataFrame) -> DataFrame:
    """(repo, src_package, dst_package) of imports between different packages."""
    e = edges.filter(F.col("relationship") == IMPORTS).select(
        "repo", parent_package(F.col("src")).alias("src_package"), parent_package(F.col("dst")).alias("dst_package")
    )
    return e.filter("src_package <> dst_package").distinct()


def internal_imports(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, package, src, dst): both ends are direct children of one package."""
    inside = contained_by(edges, nodes)
    e = edges.filter(F.col("relationship") == IMPORTS).select("repo", "src", "dst").distinct()
    a = inside.select("repo", F.col("child").alias("src"), F.col("parent").alias("package"))
    b = inside.select("repo", F.col("child").alias("dst"), F.col("parent").alias("package"))
    return e.join(a, ["repo", "src"]).join(b, ["repo", "dst", "package"]).select("repo", "package", "src", "dst")


def package_ends(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """(repo, src, dst, p_src, p_dst): imports with the packages (repo, child, parent) that
    their ends lie in, null where an end lies in none."""
    e = edges.filter(F.col("relationship") == IMPORTS).select("repo", "src", "dst")
    a = inside.select("repo", F.col("child").alias("src"), F.col("parent").alias("p_src"))
    b = inside.select("repo", F.col("child").alias("dst"), F.col("parent").alias("p_dst"))
    return e.join(a, ["repo", "src"], "left").join(b, ["repo", "dst"], "left")


def crossing_imports(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, package, direction, other): distinct targets outside the package (out) and
    sources outside it (in)."""
    inside = contained_by(edges, nodes)
    e = edges.filter(F.col("relationship") == IMPORTS).select("repo", "src", "dst").distinct()
    a = inside.select("repo", F.col("child").alias("src"), F.col("parent").alias("p_src"))
    b = inside.select("repo", F.col("child").alias("dst"), F.col("parent").alias("p_dst"))
    j = e.join(a, ["repo", "src"], "left").join(b, ["repo", "dst"], "left").filter(~F.col("p_src").eqNullSafe(F.col("p_dst")))
    out = j.filter("p_src IS NOT NULL").select("repo", F.col("p_src").alias("package"), F.lit("out").alias("direction"), F.col("dst").alias("other"))
    inn = j.filter("p_dst IS NOT NULL").select("repo", F.col("p_dst").alias("package"), F.lit("in").alias("direction"), F.col("src").alias("other"))
    return out.unionByName(inn).distinct()


def first_per_repo(rows: DataFrame, n: int, *order) -> DataFrame:
    w = Window.partitionBy("repo").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def batches(pending: DataFrame, size: int, cut=None) -> DataFrame:
    """``pending`` with batch, ``size`` nodes each, by repository and node id. With ``cut``,
    which writes a table and reads it again, rows are numbered by range partitions and
    the sums of their sizes, so that no task holds a repository; else by a window. These
    sums are written too, as Spark then knows whether they are few: few are sent to the
    rows, many are met by repository and range partition, never by repository alone."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    if cut is not None:
        ranged = pending.repartitionByRange("repo", "node_id").sortWithinPartitions("repo", "node_id")
        # partition number and place within it
        placed = cut(ranged.withColumn("at__", F.monotonically_increasing_id()))
        part = F.shiftright("at__", 33)
        # a row for each range partition of a repository
        sizes = placed.groupBy(F.col("repo").alias("r__"), part.alias("p__")).agg(F.min("at__").alias("first__"), F.count(F.lit(1)).alias("n__"))
        before = Window.partitionBy("r__").orderBy("p__").rowsBetween(Window.unboundedPreceding, -1)
        sizes = cut(sizes.select("r__", "p__", "first__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("before__")))
        j = placed.join(sizes, F.col("repo").eqNullSafe(F.col("r__")) & (part == F.col("p__")))
        return j.select(*pending.columns, F.floor((F.col("before__") + F.col("at__") - F.col("first__")) / size).cast("long").alias("batch"))
    w = Window.partitionBy("repo").orderBy("node_id")
    return pending.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
