"""Enrichment and roll-up with a model: failures, calls, and what a change costs."""

import json
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.cut import written
from corpusloom.operators import enrich, hierarchy
from corpusloom.schemas import EDGES

NODES = "repo string, node_id string, type string, name string, level int, summary string, start_line int, end_line int, risks array<string>"


def _cut(df, label="t"):
    return written(df, label)


def _node(node_id, kind, level, summary=None):
    return ("", node_id, kind, node_id.rsplit("/", 1)[-1].rsplit("::", 1)[-1], level, summary, 1, 1, None)


TREE = [
    _node("project::p", "project", 0), _node("d", "package", 1), _node("e", "package", 1), _node("d/a.py", "file", 2, "old a"), _node("d/b.py", "file", 2), _node("e/c.py", "file", 2),
    _node("d/a.py::f", "function", 3, "f does"), _node("d/b.py::g", "function", 3, "g does"), _node("e/c.py::h", "function", 3, "h does"), _node("e/c.py::i", "function", 3),
]
LINKS = [("project::p", "d"), ("project::p", "e"), ("d", "d/a.py"), ("d", "d/b.py"), ("e", "e/c.py"), ("d/a.py", "d/a.py::f"), ("d/b.py", "d/b.py::g"), ("e/c.py", "e/c.py::h"), ("e/c.py", "e/c.py::i")]


@pytest.fixture
def graph(spark):
    return spark.createDataFrame(TREE, NODES), spark.createDataFrame([("", a, b, "CONTAINS") for a, b in LINKS] + [("", "d/a.py", "e/c.py", "IMPORTS")], EDGES)


def _model(log, broken=()):
    """Notes every call in a file, as tasks run in other processes."""
    log = str(log)

    def send(system, prompt):
        with open(log, "a") as f:
            f.write(json.dumps(prompt) + "\n")
        node = prompt.rsplit("node_id: ", 1)[1]
        if node in broken:
            raise ValueError("down")
        if node == "e":
            return "no JSON"
        if node == "d/b.py":
            return json.dumps([{"node_id": node, "summary": ""}])
        kids = re.findall(r"(?m)^- (.*)$", prompt)
        return json.dumps([{"node_id": "x", "summary": "y"}, {"node_id": node, "summary": f"<{'|'.join(kids)}>"}])

    return send


def _calls(log):
    return sorted(json.loads(x).rsplit("node_id: ", 1)[1] for x in open(log)) if log.exists() else []


def _summaries(nodes):
    return {r.node_id: r.summary for r in nodes.collect()}


def test_failed_and_empty_summaries(spark, graph, tmp_path):
    """A failing node keeps and passes on what it had; an empty answer isn't passed on."""
    model = _model(tmp_path / "log", ["d/a.py"])
    up = hierarchy.roll_up(*graph, _cut, answer=enrich.model_summaries(model, f"file://{tmp_path}/ledger", _cut, wait=0, at_once=2))
    got = _summaries(up)
    assert got["d/a.py"] == "old a" and got["d/b.py"] == "" and got["e"] is None
    assert got["d"] == "<d/a.py: old a>" and got["e/c.py"] == "<e/c.py::h: h does>"
    assert got["project::p"] == "<d: <d/a.py: old a>>"
    assert _calls(tmp_path / "log") == ["d", "d/a.py", "d/a.py", "d/a.py", "d/b.py", "e", "e/c.py", "project::p"]


def test_answers_are_asked_for_once(spark, graph, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    first, second = _model(tmp_path / "a", ["d/a.py"]), _model(tmp_path / "b")
    hierarchy.roll_up(*graph, _cut, answer=enrich.model_summaries(first, ledger, _cut, wait=0, per_round=1)).collect()
    up = hierarchy.roll_up(*graph, _cut, answer=enrich.model_summaries(second, ledger, _cut, wait=0))
    # the failed node again, and those whose prompt is another one for it
    assert _calls(tmp_path / "b") == ["d", "d/a.py", "project::p"]
    assert _summaries(up)["d"] == "<d/a.py: <d/a.py::f: f does>>"
    third = _model(tmp_path / "c")
    hierarchy.roll_up(*graph, _cut, answer=enrich.model_summaries(third, ledger, _cut)).collect()
    assert _calls(tmp_path / "c") == []


def test_only_what_stands_above_a_change_is_summarised_again(spark, graph, tmp_path):
    nodes, edges = graph
    full = written(hierarchy.roll_up(nodes, edges, _cut), "full")
    edited = full.withColumn("summary", F.when(F.col("node_id") == "e/c.py::i", "i does").otherwise(F.col("summary")))
    changed = spark.createDataFrame([("", "e/c.py::i")], "repo string, node_id string")
    again, seen = hierarchy.roll_up_again(edited, edges, changed, _cut)
    assert {r.node_id for r in seen.collect()} == {"e/c.py", "e", "project::p"}
    assert _summaries(again) == _summaries(hierarchy.roll_up(edited, edges, _cut))
    # a summary that comes out as it was ends the walk
    same, seen = hierarchy.roll_up_again(full, edges, changed, _cut)
    assert {r.node_id for r in seen.collect()} == {"e/c.py"} and _summaries(same) == _summaries(full)
    # a node that has lost a child is named itself
    fewer = edges.filter("dst <> 'd/b.py'")
    lost, seen = hierarchy.roll_up_again(full, fewer, spark.createDataFrame([("", "d")], "repo string, node_id string"), _cut)
    assert {r.node_id for r in seen.collect()} == {"d", "project::p"}
    assert _summaries(lost)["d"] == "d/a.py: d/a.py::f: f does"
    none, seen = hierarchy.roll_up_again(full, edges, changed.limit(0), _cut)
    assert seen.count() == 0 and _summaries(none) == _summaries(full)


def test_children_more_than_one_level_down(spark):
    rows = [_node("project::p", "project", 0), _node("deep/x/a.py", "file", 3), _node("deep/x/a.py::f", "function", 4, "does")]
    edges = spark.createDataFrame([("", "project::p", "deep/x/a.py", "CONTAINS"), ("", "deep/x/a.py", "deep/x/a.py::f", "CONTAINS")], EDGES)
    got = _summaries(hierarchy.roll_up(spark.createDataFrame(rows, NODES), edges, _cut))
    assert got["project::p"] == "deep/x/a.py: deep/x/a.py::f: does"


def test_symbols_with_code(spark, graph, tmp_path):
    nodes, _ = graph
    texts = spark.createDataFrame([("", "e/c.py", "def i(): pass\n")], "repo string, path string, text string")

    def send(system, prompt):
        ids = re.findall(r"(?m)^### \d+\. (.*)$", prompt)
        if "d/b.py::g" in ids:
            return "sorry"
        if "project" in prompt:
            raise ValueError("x")
        return json.dumps([{"node_id": i, "summary": "```python\ndef i(): pass\n```" in prompt and "code seen", "risks": ["r"]} for i in ids])

    nodes = nodes.withColumn("summary", F.when(F.col("node_id") == "d/a.py::f", F.col("summary")))
    out, failed = enrich.enrich_with_model(nodes, texts, send, f"file://{tmp_path}/l", _cut, batch_size=1, wait=0)
    got = {r.node_id: (r.summary, r.risks) for r in out.filter("type = 'function'").collect()}
    assert got["e/c.py::i"] == ("code seen", ["r"]) and got["d/a.py::f"][0] == "f does" and got["d/b.py::g"] == (None, None)
    assert [(r.batch, r.error) for r in failed.collect()] == [(0, "no JSON array")]
