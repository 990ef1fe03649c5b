"""Listings, contents and graph documents."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.cut import release, written
from corpusloom.operators import changes, graph
from corpusloom.plans.build import build_graph
from corpusloom.sources import files as sources

NODES = "repo string, node_id string, type string, name string, size long, token_est long, start_line int, end_line int, level int, summary string, risks array<string>"
EDGES = "repo string, src string, dst string, relationship string"


@pytest.mark.parametrize("budget", [1, 5, 10_000])
def test_deep_and_wide_trees(spark, tmp_path, budget):
    deep, want = tmp_path / "deep", {}
    at = deep
    for k in range(12):
        at = at / f"_d{k}"
        at.mkdir(parents=True)
        (at / "x.py").write_text("y" * k)
        want["r", str((at / "x.py").relative_to(deep))] = (k, k // 4)
    wide = tmp_path / "wide"
    for k in range(40):
        (wide / f"p{k}").mkdir(parents=True)
        (wide / f"p{k}/.h").write_text("abcd")
        want["w", f"p{k}/.h"] = (4, 1)
    for name in (".git", "p1/__pycache__"):
        (wide / name).mkdir()
        (wide / name / "no.py").write_text("")
    os.symlink(wide / "gone", wide / "p2/broken")
    rounds = []

    def cut(df, label):
        rounds.append(written(df, label))
        return rounds[-1]

    got = sources.list_files(spark, {"r": str(deep), "w": str(wide)}, cut, budget)
    assert {(r.repo, r.path): (r.size, r.token_est) for r in got.collect()} == want
    assert len(rounds) == {1: 13, 10_000: 1}.get(budget, len(rounds))
    content = sources.read_files(got, {"r": str(deep), "w": str(wide)})
    assert {(r.repo, r.path): len(r.content) for r in content.collect()} == {k: v[0] for k, v in want.items()}
    release(*rounds)


def _graph(spark):
    nodes = [
        ("a", "x.py", "file", None, 5, 1, None, None, 1, None, None), ("a", "x.py::f", "function", "f", None, None, 1, 2, 2, 'says "hi"\n\t\\', ["r,1", "ü"]), ("a", "x.py::g", "function", "g", None, None, 3, 4, 2, "", []),
        ("a", "external::os", "external_module", "os", None, None, None, None, None, None, None), ("a", 'odd",{"source":', None, None, None, None, None, None, None, None, None), ("b", "y.py", "file", None, 1, 0, None, None, 1, None, None),
    ]
    edges = [("a", "x.py", "x.py::f", "CONTAINS"), ("a", "x.py", "x.py::g", "CONTAINS"), ("a", "x.py", "external::os", "IMPORTS")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def _set(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


@pytest.mark.parametrize("with_metadata", [False, True])
def test_documents_round_trip(spark, tmp_path, with_metadata):
    nodes, edges = _graph(spark)
    meta = None
    if with_metadata:
        hashes = spark.createDataFrame([("a", "x.py", "h1"), ("a", 'odd "p"', "h2")], "repo string, path string, sha256 string")
        commits = spark.createDataFrame([("a", "c1", "2024-01-01T00:00:00"), ("b", None, "t")], "repo string, commit_hash string, build_time string")
        meta = sources.build_metadata(hashes, commits)
    sources.save_documents(nodes, edges, f"{tmp_path}/docs", meta)
    n, e, m = sources.load_documents(spark, f"{tmp_path}/docs")
    cols = [c.split()[0] for c in NODES.split(", ")]
    assert _set(n, *cols) == _set(nodes, *cols) and _set(e, "repo", "src", "dst", "relationship") == _set(edges, "repo", "src", "dst", "relationship")
    # the files of a repository are one valid document, which the other reader knows
    for repo in ("a", "b"):
        parts = sorted((tmp_path / f"docs/repo={repo}").glob("part-*"))
        text = "".join(p.read_text() for p in parts)
        (tmp_path / f"{repo}.json").write_text(text)
        doc = json.loads(text)
        assert doc["directed"] and len(doc["nodes"]) == nodes.filter(F.col("repo") == repo).count()
        n1, e1, m1 = sources.load_graph(spark, f"{tmp_path}/{repo}.json", repo)
        assert _set(n1, *cols) == _set(nodes.filter(F.col("repo") == repo), *cols) and e1.count() == len(doc["links"])
        if with_metadata:
            row = m1.first()
            assert (row.commit_hash, row.build_time) == {"a": ("c1", "2024-01-01T00:00:00"), "b": (None, "t")}[repo]
            assert (row.file_hashes or {}) == ({"x.py": "h1", 'odd "p"': "h2"} if repo == "a" else {})
    if with_metadata:
        assert _set(m, "repo", "commit_hash", "build_time", "path", "sha256") == _set(meta, "repo", "commit_hash", "build_time", "path", "sha256")


@pytest.mark.parametrize("text", ['{"nodes": []}', '{"links": []}', '{"foo": 1}', "{ not json"])
def test_documents_that_are_none(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="not a graph document|MALFORMED|Malformed|FAILFAST"):
        sources.load_graph(spark, f"{tmp_path}/x.json")[0].collect()


def test_parquet_tables_and_the_key_edges(spark, tmp_path):
    nodes, edges = _graph(spark)
    sources.save_graph(nodes, edges, f"{tmp_path}/g")
    assert _set(spark.read.parquet(f"{tmp_path}/g/edges"), "repo", "src", "dst") == _set(edges, "repo", "src", "dst")
    (tmp_path / "e.json").write_text('{"nodes": [{"id": "a"}], "edges": [{"source": "a", "target": "b"}]}')
    n, e, _ = sources.load_graph(spark, f"{tmp_path}/e.json")
    assert (n.count(), e.first().dst) == (1, "b")
    lazy = graph.lazy_nodes(n, e)
    assert [r.node_id for r in lazy.collect()] == ["b"]


def test_checks_of_imports_and_choice_of_strategy(spark):
    nodes, edges = _graph(spark)
    more = edges.unionByName(spark.createDataFrame([("a", "nowhere.py", "x.py", "IMPORTS")], EDGES))
    good, bad = graph.check_imports(more, nodes)
    assert good.count() == 3 and [(r.src, r.reason) for r in bad.collect()] == [("nowhere.py", "source is no node")]
    feed = spark.createDataFrame([("M\tx.py",)], "line string")
    h = "repo string, path string, sha256 string"
    now, old = spark.createDataFrame([("", "n.py", "1")], h), spark.createDataFrame([("", "o.py", "1")], h)
    assert [(r.path, r.status) for r in changes.detect_changes(feed).collect()] == [("x.py", "M")]
    assert {(r.path, r.status) for r in changes.detect_changes(None, now, old).collect()} == {("n.py", "A"), ("o.py", "D")}
    with pytest.raises(ValueError):
        changes.detect_changes(None, now)
    two = spark.createDataFrame([("a", "M\tx.py"), ("a", "R1\tp\tq")], "repo string, line string")
    both = lambda rows: spark.createDataFrame(rows, h)
    got = changes.detect_by_repo(two, both([("a", "no.py", "1"), ("b", "n.py", "2")]), both([("b", "n.py", "1"), ("b", "o.py", "1")]))
    assert {(r.repo, r.path, r.status) for r in got.collect()} == {("a", "x.py", "M"), ("a", "p", "D"), ("a", "q", "A"), ("b", "n.py", "M"), ("b", "o.py", "D")}


def test_build_keeps_one_node_for_each_file(spark):
    files = spark.createDataFrame([("", "a.py", 1, 0)], "repo string, path string, size long, token_est long")
    empty = spark.createDataFrame([], "repo string, path string, type string, name string, start_line int, end_line int")
    nodes, edges = build_graph(files, empty, spark.createDataFrame([("", "a.py", "a")], "repo string, src string, name string"))
    assert nodes.count() == 1 and [(r.src, r.dst) for r in edges.collect()] == [("a.py", "a.py")]


def test_packed_documents_round_trip(spark, tmp_path):
    """The first keys are written before the lines meet them, and the text may be packed."""
    nodes, edges = _graph(spark)
    labels = []

    def cut(df, label):
        labels.append(label)
        return written(df, label)

    sources.save_documents(nodes, edges, f"{tmp_path}/docs", None, cut, "gzip")
    n, e, _ = sources.load_documents(spark, f"{tmp_path}/docs")
    cols = [c.split()[0] for c in NODES.split(", ")]
    assert _set(n, *cols) == _set(nodes, *cols) and _set(e, "repo", "src", "dst", "relationship") == _set(edges, "repo", "src", "dst", "relationship")
    assert labels == ["first"] and list(tmp_path.glob("docs/repo=a/*.gz")) and not list(tmp_path.glob("docs/repo=a/*.txt"))
