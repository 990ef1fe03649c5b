"""File listings, contents and graph documents."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cut import written
from ..schemas import CONTENT


# Directories that no listing enters.
SKIPPED = (".git", ".venv", "__pycache__")
_LISTED = "repo string, root string, path string, size long, is_dir boolean"


def _walker(budget: int, chunk: int = 10_000):
    """Lists directories until about ``budget`` entries are seen; those found by then and
    not yet entered are handed back as rows of their own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, seen = [], 0
            todo = [(r, root, p) for r, root, p in zip(frame["repo"], frame["root"], frame["path"], strict=True)][::-1]
            while todo:
                repo, root, path = todo.pop()
                try:
                    entries = os.scandir(os.path.join(root, path))
                except OSError:
                    continue
                with entries:
                    for e in entries:
                        below = f"{path}/{e.name}" if path else e.name
                        seen += 1
                        try:
                            if e.is_dir(follow_symlinks=False):
                                if e.name not in SKIPPED:
                                    if seen < budget:
                                        todo.append((repo, root, below))
                                    else:
                                        rows.append((repo, root, below, None, True))
                            elif stat.S_ISREG((info := e.stat()).st_mode):
                                rows.append((repo, root, below, info.st_size, False))
                        except OSError:
                            continue
                        if len(rows) >= chunk:
                            yield pd.DataFrame(rows, columns=["repo", "root", "path", "size", "is_dir"]).astype({"size": "Int64"})
                            rows = []
                if seen >= budget:
                    rows += [(*x, None, True) for x in todo]
                    todo = []
            yield pd.DataFrame(rows, columns=["repo", "root", "path", "size", "is_dir"]).astype({"size": "Int64"})

    return run


def list_files(spark: SparkSession, roots: dict[str, str], cut=written, budget: int = 20_000) -> DataFrame:
    """Inventory of directories that all executors can read: {repo: root} -> files. Spark's
    own readers hide names that begin with '_' or '.', so tasks walk the directories. A
    task lists about ``budget`` entries and hands back the directories that it has not
    entered; these are dealt anew, round by round, so that neither a deep nor a wide tree
    is one task's. Rows are streamed; a round is written by ``cut`` and read again."""
    frontier = spark.createDataFrame([(r, os.path.abspath(root), "") for r, root in roots.items()], "repo string, root string, path string")
    files, tasks = [], len(roots)
    while tasks:
        found = cut(frontier.repartition(min(tasks, 1000), "repo", "path").mapInPandas(_walker(budget), _LISTED), "listed")
        files.append(found.filter("NOT is_dir"))
        frontier = found.filter("is_dir").select("repo", "root", "path")
        tasks = frontier.count()
    out = files[0]
    for x in files[1:]:
        out = out.unionByName(x)
    return out.select("repo", "path", "size", F.expr("size div 4").alias("token_est"))


def inventory(files: DataFrame) -> DataFrame:
    """A listing table (repo, path, size) as an inventory, in path order per repository."""
    return files.select("repo", "path", "size", F.expr("size div 4").alias("token_est")).orderBy("repo", "path")


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for repo, root, path in zip(frame["repo"], frame["root"], frame["path"], strict=True):
            try:
                with open(os.path.join(root, path), "rb") as f:
                    body = f.read()
            except OSError:
                body = None
            yield pd.DataFrame([(repo, path, body)], columns=["repo", "path", "content"])


def read_files(files: DataFrame, roots: dict[str, str]) -> DataFrame:
    """(repo, path, content) of listed files; content is null where a file can't be read."""
    spark = files.sparkSession
    r = spark.createDataFrame(list(roots.items()), "repo string, root string")
    return files.select("repo", "path").join(r, "repo").repartition("repo", "path").mapInPandas(_read, CONTENT)


def decoded(content: DataFrame) -> DataFrame:
    """``content`` with text and read_error: a NUL byte is an error; UTF-8, else Latin-1."""
    binary = F.expr("position(x'00' in content) > 0")
    utf8 = F.expr("is_valid_utf8(cast(content as string))")
    text = F.when(utf8, F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    error = F.when(F.col("content").isNull(), "unreadable").when(binary, "binary")
    return content.select("*", error.alias("read_error")).withColumn("text", F.when(F.col("read_error").isNull(), text))


_NODE = "id string, type string, name string, size bigint, token_est bigint, start_line int, end_line int, level int, summary string, risks array<string>"
_LINK = "source string, target string, relationship string"
_META = "commit_hash string, build_time string, file_hashes map<string,string>"
GRAPH_JSON = (
    f"nodes array<struct<{_NODE.replace(' ', ':').replace(',:', ',')}>>,links array<struct<{_LINK.replace(' ', ':').replace(',:', ',')}>>,"
    f"edges array<struct<{_LINK.replace(' ', ':').replace(',:', ',')}>>,graph map<string,string>,build_metadata struct<{_META.replace(' ', ':').replace(',:', ',')}>"
)


def load_graph(spark: SparkSession, path: str, repo: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, metadata) of a node-link JSON document as any tool writes it; one
    without nodes or without links fails the read. metadata is (repo, commit_hash,
    build_time, file_hashes)."""
    raw = spark.read.schema(GRAPH_JSON).option("mode", "FAILFAST").json(path, multiLine=True)
    whole = raw.select(
        F.when(F.col("nodes").isNull() | (F.col("links").isNull() & F.col("edges").isNull()), F.raise_error(F.lit("not a graph document"))).otherwise(F.col("nodes")).alias("nodes"),
        F.coalesce("links", "edges").alias("links"), "build_metadata",
    )
    nodes = whole.select(F.explode("nodes").alias("x")).select(F.lit(repo).alias("repo"), F.col("x.id").alias("node_id"), *[F.col(f"x.{c}").alias(c) for c in _NODE_COLUMNS])
    edges = whole.select(F.explode("links").alias("x")).select(F.lit(repo).alias("repo"), F.col("x.source").alias("src"), F.col("x.target").alias("dst"), "x.relationship")
    return nodes, edges, whole.select(F.lit(repo).alias("repo"), "build_metadata.*")


_NODE_COLUMNS = ("type", "name", "size", "token_est", "start_line", "end_line", "level", "summary", "risks")


def build_metadata(hashes: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo, commit_hash, build_time, path, sha256): a row for each file, from
    ``file_hashes`` and (repo, commit_hash, build_time), one row for each repository."""
    return commits.select("repo", "commit_hash", "build_time").join(hashes.select("repo", "path", "sha256"), "repo", "left")


def document_lines(nodes: DataFrame, edges: DataFrame, metadata: DataFrame | None = None, cut=None) -> DataFrame:
    """(repo, part, key, line): a node-link JSON document for each repository, as lines that
    are in order by (part, key) and joined are the document. Nodes, links and file hashes
    have a line each, so that no document is ever one row. ``cut`` (table, label) writes
    the first key of each part and reads it again: Spark then knows that these are few,
    and the lines needn't move to meet them. Nodes and edges are read twice."""
    cols = [c for c in nodes.columns if c not in ("repo", "node_id")]
    comma = lambda first, body: F.concat(F.when(first, "").otherwise(","), body)
    n = nodes.select("repo", F.lit(1).alias("part"), F.col("node_id").alias("key"), F.to_json(F.struct(F.col("node_id").alias("id"), *cols)).alias("line"))
    e = edges.select("repo", F.lit(3).alias("part"), F.concat_ws("\0", "src", "dst", "relationship").alias("key"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "relationship")).alias("line"))
    rows = n.unionByName(e)
    repos = nodes.select("repo").distinct()
    head = '{"directed":true,"multigraph":false,"graph":{},"nodes":['
    fixed = [(0, F.lit(head)), (2, F.lit('],"links":['))]
    if metadata is None:
        fixed.append((4, F.lit('],"build_metadata":{}}')))
    else:
        text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1), F.lit(""))
        value = lambda c: F.when(F.col(c).isNull(), "null").otherwise(text(c))
        once = metadata.groupBy("repo").agg(F.max("commit_hash").alias("commit_hash"), F.max("build_time").alias("build_time"))
        start = F.concat(F.lit('],"build_metadata":{"commit_hash":'), value("commit_hash"), F.lit(',"build_time":'), value("build_time"), F.lit(',"file_hashes":{'))
        told = repos.join(once, "repo", "left").select("repo", F.lit(4).alias("part"), F.lit("").alias("key"), start.alias("line"))
        files = metadata.filter("path IS NOT NULL").join(repos, "repo", "left_semi")
        hashes = files.select("repo", F.lit(5).alias("part"), F.col("path").alias("key"), F.concat(text("path"), F.lit(":"), value("sha256")).alias("line"))
        rows = rows.unionByName(told).unionByName(hashes)
        fixed.append((6, F.lit("}}}")))
    for part, line in fixed:
        rows = rows.unionByName(repos.select("repo", F.lit(part).alias("part"), F.lit("").alias("key"), line.alias("line")))
    first = rows.groupBy(F.col("repo").alias("f_repo"), F.col("part").alias("f_part")).agg(F.min("key").alias("f_key"))
    first = cut(first, "first") if cut else first
    j = rows.join(first, F.col("repo").eqNullSafe(F.col("f_repo")) & (F.col("part") == F.col("f_part")))
    listed = F.col("part").isin(1, 3, 5)
    return j.select("repo", "part", "key", F.when(listed, comma(F.col("key") == F.col("f_key"), F.col("line"))).otherwise(F.col("line")).alias("line"))


def save_documents(nodes: DataFrame, edges: DataFrame, folder: str, metadata: DataFrame | None = None, cut=None, compression: str = "none") -> None:
    """Write the documents as text, a folder for each repository whose files, one behind the
    other by name, are its document, with ``compression`` ("gzip") a packed one. Range
    partitions share a large one."""
    lines = document_lines(nodes, edges, metadata, cut)
    lines = lines.repartitionByRange("repo", "part", "key").sortWithinPartitions("repo", "part", "key")
    lines.select("repo", F.col("line").alias("value")).write.mode("overwrite").option("compression", compression).partitionBy("repo").text(folder)


def load_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, metadata rows) of what ``save_documents`` has written, line by line."""
    raw = spark.read.schema("value string, repo string").text(folder)
    body = F.regexp_replace("value", "^,", "")
    n = raw.filter(body.startswith('{"id":')).select("repo", F.from_json(body, _NODE, {"mode": "FAILFAST"}).alias("x"))
    nodes = n.select("repo", F.col("x.id").alias("node_id"), *[F.col(f"x.{c}").alias(c) for c in _NODE_COLUMNS])
    e = raw.filter(body.startswith('{"source":')).select("repo", F.from_json(body, _LINK, {"mode": "FAILFAST"}).alias("x"))
    edges = e.select("repo", F.col("x.source").alias("src"), F.col("x.target").alias("dst"), "x.relationship")
    told = raw.filter(body.startswith('],"build_metadata":{"')).select(
        "repo", F.from_json(F.concat(F.regexp_extract("value", r'(?s)^\],"build_metadata":(.*),"file_hashes":\{$', 1), F.lit("}")), _META).alias("m")
    )
    h = raw.filter(body.startswith('"')).select("repo", F.explode(F.from_json(F.concat(F.lit("{"), body, F.lit("}")), "map<string,string>")).alias("path", "sha256"))
    return nodes, edges, build_metadata(h, told.select("repo", "m.commit_hash", "m.build_time"))


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str, metadata: DataFrame | None = None) -> None:
    """The tables as Parquet, one directory per repository."""
    for name, rows in (("nodes", nodes), ("edges", edges), ("build_metadata", metadata)):
        if rows is not None:
            rows.write.mode("overwrite").partitionBy("repo").parquet(f"{folder}/{name}")
