"""Incremental update of the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import EXTERNAL, IMPORTS
from . import graph


def _resolved(imports: DataFrame, files: DataFrame, changes: DataFrame) -> DataFrame:
    """``graph.resolve_imports`` with touched: whether an import may mean a changed path. The
    candidates meet files and changes in one join."""
    told = lambda rows, there, changed: rows.select("repo", "path", F.lit(there).alias("there"), F.lit(changed).alias("changed"))
    known = told(files, True, False).unionByName(told(changes, False, True)).groupBy("repo", "path").agg(F.max("there").alias("there"), F.max("changed").alias("changed"))
    hits = graph.candidates(imports).join(known, ["repo", "path"]).groupBy("repo", "dir", "name").agg(
        F.min(F.when(F.col("there"), F.struct((F.col("k") + 1).alias("k"), "path"))).alias("hit"), F.max("changed").alias("touched")
    )
    named = imports.select("repo", "src", "name", graph.directory(F.col("src")).alias("dir"))
    return named.join(hits, ["repo", "dir", "name"], "left").select(
        "repo", "src", "name", F.coalesce("hit.k", F.lit(5)).alias("strategy"), F.coalesce("hit.path", F.concat(F.lit(EXTERNAL), "name")).alias("dst"),
        F.coalesce("touched", F.lit(False)).alias("touched"),
    )


def _live(changes: DataFrame, files: DataFrame) -> DataFrame:
    return changes.filter("status IN ('A', 'M')").select("repo", "path").distinct().join(files, ["repo", "path"])


def change_counts(nodes: DataFrame, changes: DataFrame, files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """The counts of ``update_graph``; of ``nodes`` only file nodes are read."""
    gone, live = changes.filter("status IN ('D', 'M')").select("repo", "path").distinct(), _live(changes, files)
    per_repo = lambda rows, name: rows.groupBy("repo").agg(F.count(F.lit(1)).alias(name))
    was = gone.join(nodes.filter("type = 'file'").select("repo", F.col("node_id").alias("path")), ["repo", "path"], "left_semi")
    own = symbols.filter("type IN ('function', 'class')").join(live.select("repo", "path"), ["repo", "path"], "left_semi")
    mine = imports.join(live.select("repo", F.col("path").alias("src")), ["repo", "src"], "left_semi")
    counts = per_repo(was, "removed").join(per_repo(live.select("repo").unionByName(own.select("repo")), "added"), "repo", "full_outer")
    return counts.join(per_repo(mine, "imports"), "repo", "full_outer").na.fill(0)


def update_graph(
    nodes: DataFrame, edges: DataFrame, changes: DataFrame, files: DataFrame, symbols: DataFrame, imports: DataFrame, repair: bool = False, cut=None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts). ``files`` is the inventory after the change; ``symbols`` and
    ``imports`` are those of the changed files, or with ``repair`` the imports of all
    files. Only imports of changed files are resolved; with ``repair`` also those of
    files with an import that may mean a changed path, so that edges into modified files
    and names that a new file has taken come out as in a full build. External modules keep
    the attributes that they have. counts (repo, removed, added, imports): file nodes
    taken out, files and definitions put in, and import names of the changed files.
    ``cut`` (table, label) writes what is read more than once and reads it again."""
    cut = cut or (lambda df, label: df)
    gone = changes.filter("status IN ('D', 'M')").select("repo", "path").distinct()
    live = cut(_live(changes, files), "live")
    doomed = cut(graph.doomed_by_files(edges, gone), "doomed")
    again = live.select("repo", F.col("path").alias("src"))
    there = files.select("repo", F.col("path").alias("src"))
    if repair:
        every = cut(_resolved(imports, files, changes), "every")
        again = cut(again.unionByName(every.filter("touched").select("repo", "src")).distinct(), "again")
        resolved = every.drop("touched").join(again.join(there, ["repo", "src"], "left_semi"), ["repo", "src"], "left_semi")
    else:
        resolved = cut(graph.resolve_imports(imports.join(again.join(there, ["repo", "src"], "left_semi"), ["repo", "src"], "left_semi"), files), "resolved")
    # one join on the source for what is removed and what is resolved again, another on the target
    gone_src, gone_dst = (doomed.withColumnRenamed("node_id", c) for c in ("src", "dst"))
    is_import = F.col("relationship").eqNullSafe(F.lit(IMPORTS))
    stale = gone_src.unionByName(again).distinct() if repair else gone_src
    kept_imports = edges.filter(is_import).join(stale, ["repo", "src"], "left_anti")
    kept_edges = edges.filter(~is_import).join(gone_src, ["repo", "src"], "left_anti").unionByName(kept_imports)
    kept_edges = kept_edges.join(gone_dst, ["repo", "dst"], "left_anti").select(*edges.columns)
    new_symbols = graph.symbol_nodes(symbols.join(live.select("repo", "path"), ["repo", "path"], "left_semi"))
    known = graph.merge_externals(nodes.join(doomed, ["repo", "node_id"], "left_anti"), graph.external_nodes(resolved))
    if repair:  # external modules stay as long as someone imports them
        of_kept = edges.filter(F.col("dst").startswith(EXTERNAL))
        of_kept = of_kept.filter(is_import).join(stale, ["repo", "src"], "left_anti").unionByName(of_kept.filter(~is_import).join(gone_src, ["repo", "src"], "left_anti"))
        used = of_kept.select("repo", "dst").unionByName(resolved.select("repo", "dst").filter(F.col("dst").startswith(EXTERNAL))).distinct()
        used = used.select("repo", F.col("dst").alias("node_id"), F.lit(True).alias("used__"))
        known = known.join(used, ["repo", "node_id"], "left").filter("type IS DISTINCT FROM 'external_module' OR used__").select(*known.columns)
    fresh = graph.file_nodes(live).unionByName(new_symbols.drop("path"), allowMissingColumns=True)
    out_nodes = known.join(fresh.select("repo", "node_id"), ["repo", "node_id"], "left_anti").unionByName(fresh, allowMissingColumns=True)
    added = graph.contains_edges(new_symbols).unionByName(graph.import_edges(resolved))
    out_edges = graph.one_edge_per_pair(kept_edges, added.select(*edges.columns))
    return out_nodes, out_edges, change_counts(nodes, changes, files, symbols, imports)
