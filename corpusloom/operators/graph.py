"""Node and edge tables: symbols, import resolution, removal, checks and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import directory
from ..schemas import CONTAINS, EXTERNAL, IMPORTS
from .ignore import last_of


def file_nodes(files: DataFrame) -> DataFrame:
    return files.select("repo", F.col("path").alias("node_id"), F.lit("file").alias("type"), "size", "token_est")


def symbol_nodes(symbols: DataFrame) -> DataFrame:
    """(repo, node_id, type, name, path, start_line, end_line). Of equal ids the one with
    the highest start line wins, then the highest end line and type."""
    named = symbols.filter("type IN ('function', 'class')").withColumn("node_id", F.concat_ws("::", "path", "name"))
    one = last_of(named, ["repo", "node_id"], [F.desc("start_line"), F.desc("end_line"), F.desc("type")])
    return one.select("repo", "node_id", "type", "name", "path", "start_line", "end_line")


def contains_edges(symbol_rows: DataFrame) -> DataFrame:
    return symbol_rows.select("repo", F.col("path").alias("src"), F.col("node_id").alias("dst"), F.lit(CONTAINS).alias("relationship"))


def candidates(imports: DataFrame) -> DataFrame:
    """(repo, dir, name, k, path): the four paths that an import may mean, made once for
    all files of a directory."""
    asked = imports.select("repo", directory(F.col("src")).alias("dir"), "name").distinct()
    here = F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/")))
    dotted = F.translate("name", ".", "/")
    paths = F.array(
        F.concat(here, "name", F.lit(".py")), F.concat(dotted, F.lit(".py")),
        F.concat(here, "name", F.lit("/__init__.py")), F.concat(dotted, F.lit("/__init__.py")),
    )
    return asked.select("repo", "dir", "name", F.posexplode(paths).alias("k", "path"))


def asked_names(imports: DataFrame) -> DataFrame:
    """(repo, dir, name, path): what an import may mean, without its ending: beside the
    importing file and from the root."""
    asked = imports.select("repo", directory(F.col("src")).alias("dir"), "name").distinct()
    here = F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat("dir", F.lit("/"), "name"))
    return asked.select("repo", "dir", "name", F.explode(F.array_distinct(F.array(here, F.translate("name", ".", "/")))).alias("path"))


def names_of(paths: DataFrame) -> DataFrame:
    """(repo, path): by which of ``asked_names`` a path is meant."""
    return _meant(paths).select("repo", F.col("at__").alias("path"))


def _meant(files: DataFrame) -> DataFrame:
    """(repo, at__, module, package): a row for each path without its ending that names a
    module, a directory with an __init__.py, or both."""
    ends = lambda end, module: F.when(F.col("path").endswith(end), F.struct(F.left("path", F.char_length("path") - len(end)).alias("at__"), F.lit(module).alias("module"), F.lit(not module).alias("package")))
    x = files.select("repo", F.explode(F.array_compact(F.array(ends(".py", True), ends("/__init__.py", False)))).alias("x"))
    return x.groupBy("repo", F.col("x.at__").alias("at__")).agg(F.max("x.module").alias("module"), F.max("x.package").alias("package"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, src, name, strategy, dst). Of the four candidate paths of an import the first
    that is a file wins, else the name is external (strategy 5). The four are two names
    without their ending, beside the importing file and from the root, so that two joins
    find them all. What is joined on is a column, not an expression: a sort would make an
    expression anew for every two rows that it compares."""
    meant = _meant(files).hint("shuffle_hash")  # few beside the imports and each once, so that these need no sort
    here = lambda d: F.when(d == "", F.col("name")).otherwise(F.concat(d, F.lit("/"), F.col("name")))
    beside = meant.select(F.col("repo").alias("r__"), F.col("at__").alias("here__"), F.col("module").alias("m1__"), F.col("package").alias("p1__"))
    above = meant.select(F.col("repo").alias("r__"), F.col("at__").alias("dotted__"), F.col("module").alias("m2__"), F.col("package").alias("p2__"))
    met = lambda rows, known, at: rows.withColumnRenamed("at__", "x__").join(known, (F.col("repo") == F.col("r__")) & (F.col("x__") == F.col(at)), "left")
    j = met(imports.select("repo", "src", "name", here(directory(F.col("src"))).alias("at__")), beside, "here__")
    j = met(j.select("repo", "src", "name", "m1__", "p1__", F.translate("name", ".", "/").alias("at__")), above, "dotted__")
    k = F.when(F.col("m1__"), 1).when(F.col("m2__"), 2).when(F.col("p1__"), 3).when(F.col("p2__"), 4).otherwise(5)
    to = F.when(k == 5, F.concat(F.lit(EXTERNAL), "name")).otherwise(
        F.concat(F.when(k.isin(1, 3), here(directory(F.col("src")))).otherwise(F.col("x__")), F.when(k <= 2, ".py").otherwise("/__init__.py"))
    )
    return j.select("repo", "src", "name", k.alias("strategy"), to.alias("dst"))


def import_edges(resolved: DataFrame, repeats: bool = False) -> DataFrame:
    """With ``repeats`` an edge comes once for each name by which a file imports another."""
    edges = resolved.select("repo", "src", "dst", F.lit(IMPORTS).alias("relationship"))
    return edges if repeats else edges.distinct()


def external_nodes(resolved: DataFrame) -> DataFrame:
    return resolved.filter("strategy = 5").select("repo", F.col("dst").alias("node_id"), F.lit("external_module").alias("type"), "name").distinct()


def merge_externals(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Existing attributes stay, only missing ones are filled."""
    fill = new.select("repo", "node_id", F.col("type").alias("t__"), F.col("name").alias("n__"))
    j = nodes.join(fill, ["repo", "node_id"], "full_outer")
    cols = {"type": F.coalesce("type", "t__"), "name": F.coalesce("name", "n__")}
    return j.select(*[cols.get(c, F.col(c)).alias(c) for c in nodes.columns])


def lazy_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Targets of edges that are no node yet: (repo, node_id)."""
    ends = edges.select("repo", F.col("dst").alias("node_id")).distinct()
    return ends.join(nodes.select("repo", "node_id"), ["repo", "node_id"], "left_anti")


def one_edge_per_pair(edges: DataFrame, later: DataFrame) -> DataFrame:
    """Edges with those of ``later`` in place of equal pairs."""
    return edges.join(later.select("repo", "src", "dst"), ["repo", "src", "dst"], "left_anti").unionByName(later)


def check_symbols(symbol_rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason): a symbol's parent must be a file."""
    parents = files.select("repo", "path").distinct()
    bad = symbol_rows.join(parents, ["repo", "path"], "left_anti").withColumn("reason", F.lit("parent is no file"))
    return symbol_rows.join(parents, ["repo", "path"], "left_semi"), bad


def check_imports(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = nodes.select("repo", F.col("node_id").alias("src")).distinct()
    bad = edges.join(known, ["repo", "src"], "left_anti").withColumn("reason", F.lit("source is no node"))
    return edges.join(known, ["repo", "src"], "left_semi"), bad


def remove_nodes(nodes: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes ``doomed`` (repo, node_id) and every edge that touches one."""
    gone = doomed.select("repo", "node_id").distinct()
    kept = edges.join(gone.withColumnRenamed("node_id", "src"), ["repo", "src"], "left_anti")
    kept = kept.join(gone.withColumnRenamed("node_id", "dst"), ["repo", "dst"], "left_anti")
    return nodes.join(gone, ["repo", "node_id"], "left_anti"), kept.select(*edges.columns)


def doomed_by_files(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Files (repo, path) and the symbols they contain, as (repo, node_id)."""
    files = paths.select("repo", F.col("path").alias("node_id")).distinct()
    inside = edges.filter(F.col("relationship") == CONTAINS).join(files.withColumnRenamed("node_id", "src"), ["repo", "src"], "left_semi")
    return files.unionByName(inside.select("repo", F.col("dst").alias("node_id"))).distinct()


def remove_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rejected): paths that aren't file nodes are rejected."""
    known = nodes.filter("type = 'file'").select("repo", F.col("node_id").alias("path"))
    bad = paths.join(known, ["repo", "path"], "left_anti").withColumn("reason", F.lit("no such file node"))
    good = paths.join(known, ["repo", "path"], "left_semi")
    return (*remove_nodes(nodes, edges, doomed_by_files(edges, good)), bad)


def callers(edges: DataFrame) -> DataFrame:
    """(repo, dst, src): who imports a file."""
    return edges.filter(F.col("relationship") == IMPORTS).select("repo", "dst", "src").distinct()


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.groupBy("repo").agg(F.count(F.lit(1)).alias("edges"))
    return n.join(e, "repo", "full_outer").select("repo", F.coalesce("nodes", F.lit(0)).cast("long").alias("nodes"), F.coalesce("edges", F.lit(0)).cast("long").alias("edges"))


def fan_in_out(edges: DataFrame) -> DataFrame:
    """(repo, node_id, fan_in, fan_out) over edges of all kinds, in one pass over them."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o"))))
    return edges.select("repo", ends.alias("x")).groupBy("repo", F.col("x.node_id").alias("node_id")).agg(
        F.sum("x.i").cast("long").alias("fan_in"), F.sum("x.o").cast("long").alias("fan_out")
    )
