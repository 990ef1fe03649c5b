"""Reports of projects, packages, modules and symbols, all of a kind in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import base_name
from ..schemas import CONTAINS, EXTERNAL, IMPORTS
from .graph import callers
from .hierarchy import contained_by
from .packages import package_ends, package_pairs


def _section(title: str, items: Column) -> Column:
    """Title, blank, items, blank; null without items."""
    return F.when(F.size(items) > 0, F.concat(F.lit(title + "\n\n"), F.array_join(items, "\n"), F.lit("\n")))


def _listed(rows: DataFrame, keys: list[str], order: list, text: Column, name: str) -> DataFrame:
    s = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], text.alias("t"))))
    return rows.groupBy(*keys).agg(F.transform(s, lambda x: x["t"]).alias(name))


def _children(nodes: DataFrame, edges: DataFrame, name: str = "kids") -> DataFrame:
    """(repo, node_id, kids): packages by name, files by path, symbols by start line."""
    return _listed_children(nodes, edges.filter(F.col("relationship") == CONTAINS).select("repo", F.col("src").alias("parent"), F.col("dst").alias("node_id")), name)


def _child_order() -> tuple[list[Column], Column]:
    """The order of a node's children and the text of each."""
    label = F.concat(F.lit("- **"), F.coalesce("name", "node_id"), F.lit("**"), F.when(F.col("summary") != "", F.concat(F.lit(" - "), "summary")).otherwise(""))
    rank = F.when(F.col("type") == "package", 0).when(F.col("type") == "file", 1).otherwise(2)
    return [rank, F.coalesce("start_line", F.lit(0)), F.coalesce("name", "node_id"), F.col("node_id")], label


def _listed_children(nodes: DataFrame, e: DataFrame, name: str) -> DataFrame:
    order, label = _child_order()
    return _listed(e.join(nodes, ["repo", "node_id"]), ["repo", "parent"], order, label, name).withColumnRenamed("parent", "node_id")


def _joined(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias(name))


def _risks() -> Column:
    return _section("## Risiken:", F.transform(F.coalesce("risks", F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)))


def _text(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _summary(title: str = "") -> Column:
    return F.when(F.col("summary") != "", F.concat(F.lit(title), "summary", F.lit("\n")))


def _io(out: Column, inn: Column) -> Column:
    rows = F.array_compact(F.array(
        F.when(F.size(out) > 0, F.concat(F.lit("- Importiert: "), F.array_join(out, ", "))),
        F.when(F.size(inn) > 0, F.concat(F.lit("- Wird importiert von: "), F.array_join(inn, ", "))),
    ))
    return rows


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, report), a fixed text for repositories without a project node."""
    hints = package_pairs(edges).select("repo", F.concat(F.lit("- "), "src_package", F.lit(" importiert "), "dst_package").alias("h"))
    p = nodes.filter("type = 'project'").join(_children(nodes, edges), ["repo", "node_id"], "left").join(_joined(hints, ["repo"], "h", "hints"), "repo", "left")
    made = p.select("repo", _text(F.concat(F.lit("# "), F.coalesce("name", "node_id"), F.lit("\n")), _summary(), _section("## Hauptbereiche:", F.col("kids")), _section("## Architektur-Hinweise:", F.col("hints"))).alias("made"))
    none = "# Project Overview\n\nNo project node found.\n"
    return nodes.select("repo").distinct().join(made, "repo", "left").select("repo", F.coalesce("made", F.lit(none)).alias("report"))


def packages(nodes: DataFrame, edges: DataFrame, cut=None) -> DataFrame:
    """Both ends of each import meet their packages once, and the lists of a package are
    made of the same rows. ``cut`` (table, label) writes what is in packages and reads it
    again, as it is few beside the edges."""
    cut = cut or (lambda df, label: df)
    mine = cut(nodes.filter("type = 'package'"), "packages")
    inside = cut(contained_by(edges, mine), "inside")
    x = package_ends(edges, inside)
    src, dst = F.col("p_src"), F.col("p_dst")
    kind = lambda at, k, text: F.struct(at.alias("node_id"), F.lit(k).alias("kind"), text.alias("text"))
    cross = ~src.eqNullSafe(dst)
    told = F.array_compact(F.array(
        F.when(src == dst, kind(src, 0, F.concat(F.lit("- "), base_name(F.col("src")), F.lit(" importiert "), base_name(F.col("dst"))))),
        F.when(cross & src.isNotNull(), kind(src, 1, F.col("dst"))), F.when(cross & dst.isNotNull(), kind(dst, 2, F.col("src"))),
    ))
    rows = x.select("repo", F.explode(told).alias("x")).select("repo", "x.*")
    some = lambda k: F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("text"))))
    lists = rows.groupBy("repo", "node_id").agg(some(0).alias("inner"), some(1).alias("out"), some(2).alias("inn"))
    kids = _listed_children(nodes, inside.withColumnRenamed("child", "node_id"), "kids")
    j = mine.join(kids, ["repo", "node_id"], "left").join(lists, ["repo", "node_id"], "left")
    return j.select("repo", "node_id", _text(
        F.concat(F.lit("# "), "node_id", F.lit("/\n")), _summary(), _section("## Module:", F.col("kids")), _section("## Interne Struktur:", F.col("inner")),
        _section("## Externe Schnittstellen:", _io(F.col("out"), F.col("inn"))), _risks(),
    ).alias("report"))


def modules(nodes: DataFrame, edges: DataFrame, kids: DataFrame | None = None) -> DataFrame:
    """All that a report tells is gathered by one grouping. Rows are dealt by their node
    before it, since lists get no shorter by a grouping ahead of the shuffle. Import edges
    may come more than once. With ``kids`` (repo, parent, node_id, type, name, start_line,
    summary), the children of files, these are not looked up, and ``nodes`` need hold no
    more than files."""
    files = nodes.filter("type = 'file'")
    if kids is None:
        kids = edges.filter(F.col("relationship") == CONTAINS).select("repo", F.col("src").alias("parent"), F.col("dst").alias("node_id")).join(nodes, ["repo", "node_id"])
    order, label = _child_order()
    items = kids.select("repo", F.col("parent").alias("node_id"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], label.alias("t")).alias("kid"))
    # those who import external modules are very many and in no report, but where a file is called like one
    none_called = files.filter(F.col("node_id").startswith(EXTERNAL)).isEmpty()
    left_out = F.col("dst").startswith(EXTERNAL) if none_called else F.lit(False)
    end = lambda at, out, inn: F.struct(F.col(at).alias("node_id"), out.alias("out"), inn.alias("inn"))
    none = F.lit(None).cast("string")
    ends = F.array_compact(F.array(end("src", F.col("dst"), none), F.when(~left_out, end("dst", none, F.concat("src", F.lit(" (1x)"))))))
    told = edges.filter(F.col("relationship") == IMPORTS).select("repo", F.explode(ends).alias("x")).select("repo", "x.*")
    rows = files.select("repo", "node_id", F.lit(True).alias("file"), "summary", "risks")
    rows = rows.unionByName(items, allowMissingColumns=True).unionByName(told, allowMissingColumns=True)
    j = rows.repartition("repo", "node_id").groupBy("repo", "node_id").agg(
        F.max("file").alias("file"), F.max("summary").alias("summary"), F.max("risks").alias("risks"), F.sort_array(F.collect_list("kid")).alias("kids"),
        F.sort_array(F.collect_set("out")).alias("out"), F.sort_array(F.collect_set("inn")).alias("inn"),
    ).filter("file")
    texts = F.transform("kids", lambda x: x["t"])
    return j.select("repo", "node_id", _text(
        F.concat(F.lit("# "), "node_id", F.lit("\n")), _summary(), _section("## Enthält:", texts), _section("## Abhängigkeiten:", _io(F.col("out"), F.col("inn"))), _risks(),
    ).alias("report"))


def symbols(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    by = _joined(callers(edges).select("repo", F.col("dst").alias("file"), F.concat(F.lit("- "), "src").alias("c")), ["repo", "file"], "c", "callers")
    s = nodes.filter("type IN ('function', 'class')").withColumn("file", F.substring_index("node_id", "::", 1))
    sign = F.when(F.col("type") == "function", F.concat(F.lit("def "), "name", F.lit("(...)"))).otherwise(F.concat(F.lit("class "), "name", F.lit(":")))
    return s.join(by, ["repo", "file"], "left").select("repo", "node_id", _text(
        F.concat(F.lit("# "), "node_id", F.lit("\n")), F.concat(F.lit("## Signatur:\n\n"), sign, F.lit("\n")), _summary("## Verhalten:\n\n"),
        _section("## Aufrufer:", F.col("callers")), _risks(),
    ).alias("report"))


def full_report(nodes: DataFrame, edges: DataFrame, cut=None) -> DataFrame:
    """(repo, node_id, type, summary, risks, out_edges, in_edges) of every node, sorted.
    ``cut`` (table, label) writes the rows and reads them again before they are sorted:
    finding the ranges of a sort reads them once more."""
    end = lambda c, other, way: F.struct(F.col(c).alias("node_id"), F.lit(way).alias("way"), F.concat_ws(" ", "relationship", other).alias("t"))
    ends = edges.select("repo", F.explode(F.array(end("src", "dst", 0), end("dst", "src", 1))).alias("x")).select("repo", "x.*")
    told = lambda way: F.array_join(F.sort_array(F.collect_list(F.when(F.col("way") == way, F.col("t")))), "; ")
    lists = ends.groupBy("repo", "node_id").agg(told(0).alias("out_edges"), told(1).alias("in_edges"))
    j = nodes.join(lists, ["repo", "node_id"], "left")
    rows = j.select(
        "repo", "node_id", "type", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce(F.array_join("risks", "; "), F.lit("")).alias("risks"),
        F.coalesce("out_edges", F.lit("")).alias("out_edges"), F.coalesce("in_edges", F.lit("")).alias("in_edges"),
    )
    return (cut(rows, "report") if cut else rows).orderBy("repo", "node_id")
