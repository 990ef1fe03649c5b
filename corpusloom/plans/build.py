"""The full build: files, symbols and imports to node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import graph, hierarchy


def build_graph(files: DataFrame, symbols: DataFrame, imports: DataFrame, project: str | None = None, cut=None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of inventory, code nodes and imports; with ``project`` also the
    package hierarchy and levels. ``cut`` (table, label) writes what several parts of the
    graph are made of and reads it again."""
    cut = cut or (lambda df, label: df)
    files = cut(files, "files")
    sym = cut(graph.symbol_nodes(symbols), "symbols")
    resolved = cut(graph.resolve_imports(imports, files), "resolved")
    nodes = graph.file_nodes(files).unionByName(sym.drop("path"), allowMissingColumns=True)
    nodes = nodes.unionByName(graph.external_nodes(resolved), allowMissingColumns=True)
    edges = graph.contains_edges(sym).unionByName(graph.import_edges(resolved))
    if project is not None:
        pkg = hierarchy.package_nodes(files)
        nodes = hierarchy.with_levels(nodes.unionByName(pkg, allowMissingColumns=True).unionByName(hierarchy.project_nodes(files, project), allowMissingColumns=True))
        edges = edges.unionByName(hierarchy.containment_edges(files, pkg, project))
    return nodes, edges


def graph_edges(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """The edges of ``build_graph`` alone: with one reader nothing is worth writing."""
    resolved = graph.resolve_imports(imports, files)
    return graph.contains_edges(graph.symbol_nodes(symbols)).unionByName(graph.import_edges(resolved))


def build_tree(files: DataFrame, symbols: DataFrame, project: str, cut=None) -> tuple[DataFrame, DataFrame]:
    """The nodes of ``build_graph`` but for external modules, and its CONTAINS edges: all
    that a reader of symbols, packages and containment needs, without resolving imports."""
    cut = cut or (lambda df, label: df)
    files, sym = cut(files, "files"), cut(graph.symbol_nodes(symbols), "symbols")
    pkg = hierarchy.package_nodes(files)
    nodes = graph.file_nodes(files).unionByName(sym.drop("path"), allowMissingColumns=True).unionByName(pkg, allowMissingColumns=True)
    nodes = hierarchy.with_levels(nodes.unionByName(hierarchy.project_nodes(files, project), allowMissingColumns=True))
    return nodes, graph.contains_edges(sym).unionByName(hierarchy.containment_edges(files, pkg, project))
