"""Tree listings: one row per line, ordered, and one text per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, base_name, directory

# The drawing.
BRANCH, LAST, BAR, GAP = "├── ", "└── ", "│   ", "    "


def tree_lines(files: DataFrame, directories: DataFrame | None = None) -> DataFrame:
    """(repo, path, is_dir, sort_key, line). sort_key, an array of (lower name, name) per
    level, gives the depth-first order. ``directories`` (repo, path) adds empty ones."""
    f = files.select("repo", "path").distinct().withColumn("is_dir", F.lit(False))
    d = files.select("repo", F.explode(ancestors(F.col("path"))).alias("path"))
    if directories is not None:
        d = d.unionByName(directories.select("repo", "path")).unionByName(directories.select("repo", F.explode(ancestors(F.col("path"))).alias("path")))
    e = f.unionByName(d.distinct().withColumn("is_dir", F.lit(True)))
    name = base_name(F.col("path"))
    w = Window.partitionBy("repo", directory(F.col("path"))).orderBy(F.lower(name), name)
    e = e.withColumn("last", F.lead("path").over(w).isNull())
    up = e.select("repo", "path", F.posexplode(ancestors(F.col("path"))).alias("k", "above"))
    marks = up.join(e.select("repo", F.col("path").alias("above"), F.col("last").alias("up_last")), ["repo", "above"])
    prefix = marks.groupBy("repo", "path").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "up_last"))), lambda x: F.when(x["up_last"], GAP).otherwise(BAR)), "").alias("prefix")
    )
    j = e.join(prefix, ["repo", "path"], "left")
    line = F.concat(F.coalesce("prefix", F.lit("")), F.when(F.col("last"), LAST).otherwise(BRANCH), name, F.when(F.col("is_dir"), "/").otherwise(""))
    key = F.transform(F.split("path", "/"), lambda x: F.struct(F.lower(x).alias("l"), x.alias("n")))
    return j.select("repo", "path", "is_dir", key.alias("sort_key"), line.alias("line"))


def tree_report(files: DataFrame, root: str, directories: DataFrame | None = None) -> DataFrame:
    """(repo, tree_string, total_files, total_folders, estimated_tokens)."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("sort_key", "line"))), lambda x: x["line"])
    g = tree_lines(files, directories).groupBy("repo").agg(
        F.concat_ws("\n", F.lit(root + "/"), F.array_join(ordered, "\n")).alias("tree_string"),
        F.count_if(~F.col("is_dir")).alias("total_files"), F.count_if("is_dir").alias("total_folders"),
    )
    return g.select("*", F.floor(F.char_length("tree_string") / 3.5).cast("long").alias("estimated_tokens"))
