"""The graph as a versioned set of tables, kept equal to a full build by deltas.

Beside files, symbols and resolved imports the set holds a reverse candidate index
(for each path that an import may mean, without its ending, who asks for it) and for each directory the
number of files below it. A batch of changes reads only the buckets of the changed
paths and of what they touch: imports are found by the index when a path that they
may mean appears or vanishes, and packages appear and vanish by their counts.

Nodes and edges, the hierarchy included, are views over these tables. Summaries and
risks are kept for each node until its file changes; those of external modules stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestors, base_name, depth, directory
from ..sources.versions import Versions
from . import graph, hierarchy

TABLES = {
    "files": ("repo string, path string, size long, token_est long, sha256 string", "path"),
    "symbols": ("repo string, path string, node_id string, type string, name string, start_line int, end_line int", "path"),
    "resolved": ("repo string, src string, dir string, name string, strategy int, dst string", "src"),
    "asked": ("repo string, path string, dir string, name string", "path"),
    "directories": ("repo string, dir string, n long", "dir"),
    "told": ("repo string, node_id string, summary string, risks array<string>", "node_id"),
}
Cut = Callable[[DataFrame, str], DataFrame]


def graph_tables(spark: SparkSession, folder: str, buckets: int = 64) -> Versions:
    return Versions(spark, folder, TABLES, append_only=("asked",), buckets=buckets, parts={"resolved": "name"})


def _resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    return graph.resolve_imports(imports, files).select("repo", "src", directory(F.col("src")).alias("dir"), "name", "strategy", "dst")


def _asked(imports: DataFrame) -> DataFrame:
    return graph.asked_names(imports).select("repo", "path", "dir", "name")


def _below(files: DataFrame) -> DataFrame:
    """(repo, dir, n): directories above files, with the number of files below each."""
    return files.select("repo", F.explode(ancestors(F.col("path"))).alias("dir")).groupBy("repo", "dir").agg(F.count(F.lit(1)).alias("n"))


def build(tables: Versions, files: DataFrame, symbols: DataFrame, imports: DataFrame, cut: Cut, batch: int = 0) -> bool:
    """The first batch: a full build of inventory (repo, path, size, token_est, sha256),
    code nodes and imports (repo, src, name)."""
    if tables.is_done(batch):
        return False
    files, imports = cut(files, "files"), cut(imports, "imports")
    return tables.commit(batch, {
        "files": files, "symbols": graph.symbol_nodes(symbols), "resolved": _resolved(imports, files), "asked": _asked(imports), "directories": _below(files),
    })


def update(
    tables: Versions, batch: int, changes: DataFrame, live: DataFrame, symbols: DataFrame, imports: DataFrame, cut: Cut, whole: bool = False,
    release: Callable[..., None] | None = None,
) -> dict[str, int] | None:
    """Apply ``changes`` (repo, path, status). ``live`` is the inventory of those changed
    paths that exist now, ``symbols`` and ``imports`` what these files hold. Returns the
    counts removed, added and imports, or None if the batch was applied before. The
    tables that ``cut`` wrote on the way are given to ``release`` at the end."""
    if tables.is_done(batch):
        return None
    write, scratch = cut, []

    def cut(rows: DataFrame, label: str) -> DataFrame:
        scratch.append(write(rows, label))
        return scratch[-1]

    touched = cut(changes.select("repo", "path").distinct(), "touched")
    at = tables.only(touched, "path")
    old = cut(tables.read("files", at).join(touched, ["repo", "path"], "left_semi"), "old")
    now = cut(live.join(touched, ["repo", "path"], "left_semi").select(*old.columns), "now")
    inside = lambda rows, c: rows.join(now.select("repo", F.col("path").alias(c)).hint("shuffle_hash"), ["repo", c], "left_semi")
    defined = cut(inside(symbols.filter("type IN ('function', 'class')"), "path"), "defined")
    asked = cut(inside(imports, "src").select("repo", "src", "name").distinct(), "asked")
    key = ["repo", "path"]
    moved = cut(
        now.join(old, key, "left_anti").select(*key, F.lit(1).alias("step")).unionByName(old.join(now, key, "left_anti").select(*key, F.lit(-1).alias("step"))), "moved"
    )
    # imports of other files that may mean a path which has come or gone
    meant = cut(graph.names_of(moved), "meant")
    hit = cut(tables.read("asked", tables.only(meant, "path")).join(meant, key, "left_semi").select("repo", "dir", "name").distinct(), "hit")
    beside = F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), F.lit("_"))  # a path in that directory
    near = tables.read("resolved", tables.only(hit.select("repo", beside.alias("path")), "path"), like=hit)
    again = cut(near.select("repo", "src", "name").join(touched.withColumnRenamed("path", "src"), ["repo", "src"], "left_anti"), "again")
    todo = cut(asked.unionByName(again), "todo")
    paths = graph.candidates(todo).select("repo", "path")
    there = tables.read("files", tables.only(paths, "path")).join(touched, key, "left_anti").unionByName(now)
    # directories by the files that have come or gone below them
    step = cut(moved.select("repo", F.explode(ancestors(F.col("path"))).alias("dir"), "step").groupBy("repo", "dir").agg(F.sum("step").alias("step")).filter("step <> 0"), "step")
    had = tables.read("directories", tables.only(step, "dir"))
    counted = step.join(had, ["repo", "dir"], "left").select("repo", "dir", (F.coalesce("n", F.lit(0)) + F.col("step")).alias("n")).filter("n > 0")
    # of the nodes of these files those that something is told of
    theirs = tables.read("symbols", at, like=touched).select("repo", "node_id").unionByName(touched.select("repo", F.col("path").alias("node_id")))
    gone_nodes = tables.read("told", at).select("repo", "node_id").join(theirs, ["repo", "node_id"], "left_semi").select("repo", F.col("node_id").alias("unit"))
    by_path = touched.select("repo", F.col("path").alias("unit"))
    done = tables.commit(
        batch,
        {
            "files": now, "symbols": graph.symbol_nodes(defined), "resolved": _resolved(todo, there),
            "asked": _asked(asked), "directories": counted,
        },
        {
            "files": by_path, "symbols": by_path, "resolved": by_path.unionByName(again.select("repo", F.col("src").alias("unit"), F.col("name").alias("part")), allowMissingColumns=True),
            "directories": step.select("repo", F.col("dir").alias("unit")), "told": gone_nodes,
        },
        whole,
    )
    counts = {"removed": old.count(), "added": now.count() + defined.count(), "imports": asked.count()}
    if release:
        release(*scratch)
    return counts if done else None


def tell(tables: Versions, batch: int, results: DataFrame) -> bool:
    """Put summaries and risks (repo, node_id, summary, risks) on nodes."""
    rows = results.select("repo", "node_id", "summary", "risks")
    return tables.commit(batch, {"told": rows}, {"told": rows.select("repo", F.col("node_id").alias("unit"))})


def read_once(tables: Versions, cut: Cut, as_of: int | None = None) -> Callable[[str], DataFrame]:
    """A reader for ``nodes`` and ``edges`` that finds a table's rows at its first use and has
    ``cut`` write them for the others."""
    known: dict[str, DataFrame] = {}

    def read(table: str) -> DataFrame:
        if table not in known:
            known[table] = cut(tables.read(table, as_of=as_of), table)
        return known[table]

    return read


def packages(tables: Versions, as_of: int | None = None, read: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """The package nodes: directories with a file below them."""
    d = read("directories") if read else tables.read("directories", as_of=as_of)
    return d.select("repo", F.col("dir").alias("node_id"), F.lit("package").alias("type"), base_name(F.col("dir")).alias("name"), depth(F.col("dir")).alias("level"))


def nodes(tables: Versions, project: str | None = None, as_of: int | None = None, read: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """All nodes, with packages, project and levels if a project's name is given; ``read`` as
    of ``read_once``."""
    read = read or (lambda table: tables.read(table, as_of=as_of))
    files = read("files")
    out = graph.file_nodes(files).unionByName(read("symbols").drop("path"), allowMissingColumns=True)
    out = out.unionByName(graph.external_nodes(read("resolved")), allowMissingColumns=True)
    if project is not None:
        out = out.unionByName(packages(tables, as_of, read), allowMissingColumns=True).unionByName(hierarchy.project_nodes(files, project), allowMissingColumns=True)
        out = hierarchy.with_levels(out)
    return out.join(tables.read("told", as_of=as_of), ["repo", "node_id"], "left")


def edges(tables: Versions, project: str | None = None, as_of: int | None = None, read: Callable[[str], DataFrame] | None = None) -> DataFrame:
    read = read or (lambda table: tables.read(table, as_of=as_of))
    out = graph.contains_edges(read("symbols")).unionByName(graph.import_edges(read("resolved")))
    if project is not None:
        out = out.unionByName(hierarchy.containment_edges(read("files"), packages(tables, as_of, read), project))
    return out
