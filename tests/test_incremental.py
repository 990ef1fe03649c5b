"""The versioned tables: batches of changes against a full build, replays, crashes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.cut import written
from corpusloom.operators import extract, incremental, update
from corpusloom.plans.build import build_graph
from corpusloom.sources.files import decoded
from corpusloom.streaming import updates

STEPS = [
    {"app/main.py": "import util\nimport os\nfrom lib.core import f\ndef main():\n    pass\n", "app/util.py": "def helper():\n    pass\n", "lib/core.py": "import os\nclass Core:\n    pass\n",
     "notes.md": "x", "deep/a/b/c.py": "import d\n", "top.py": "import late\nimport pkg\n"},
    # util goes (so the import becomes external), late.py and a package come, c.py is edited
    {"app/util.py": None, "late.py": "def soon():\n    pass\n", "pkg/__init__.py": "", "deep/a/b/c.py": "import late\ndef c():\n    pass\ndef c():\n    return 1\n"},
    # the deep directories vanish, util comes back elsewhere, a file breaks
    {"deep/a/b/c.py": None, "util.py": "import main\n", "lib/core.py": "class Core(:\n", "app/util/__init__.py": "def helper():\n    pass\n"},
    # a rename, and nothing but an edit
    {"late.py": None, "app/late.py": "def soon():\n    pass\n", "top.py": "import late\n"},
]


def _cut(df, label):
    return written(df, label)


def _reader(spark, tree):
    rows = spark.createDataFrame([("", p, bytearray(t.encode())) for p, t in tree.items()], "repo string, path string, content binary")
    return lambda paths: rows.join(paths, ["repo", "path"], "left_semi")


def _parsed(spark, tree):
    rows = spark.createDataFrame([("", p, bytearray(t.encode())) for p, t in tree.items()], "repo string, path string, content binary")
    files = rows.select("repo", "path", F.octet_length("content").cast("long").alias("size"), F.expr("octet_length(content) div 4").alias("token_est"), F.sha2("content", 256).alias("sha256"))
    found = extract.extract_symbols(decoded(rows))
    return files, extract.definitions(found), extract.imports(found)


def _rows(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


NODE = ("node_id", "type", "name", "size", "token_est", "start_line", "end_line", "level")


def _same_as_rebuild(spark, tables, tree):
    files, symbols, imports = _parsed(spark, tree)
    n, e = build_graph(files, symbols, imports, "p", _cut)
    assert _rows(incremental.nodes(tables, "p"), *NODE) == _rows(n, *NODE)
    assert _rows(incremental.edges(tables, "p"), "src", "dst", "relationship") == _rows(e, "src", "dst", "relationship")
    hashes = {r.path: r.sha256 for r in tables.read("files").collect()}
    assert hashes == {p: hashlib.sha256(t.encode()).hexdigest() for p, t in tree.items()}
    assert {r.node_id: r.n for r in tables.read("directories").select(F.col("dir").alias("node_id"), "n").collect()} == {
        d: sum(p.startswith(d + "/") for p in tree) for d in {"/".join(p.split("/")[:k]) for p in tree for k in range(1, len(p.split("/")))}
    }


def _feed(before, step):
    status = {p: "D" if t is None else "M" if p in before else "A" for p, t in step.items()}
    return "".join(f"{s}\t{p}\n" for p, s in status.items())


@pytest.mark.parametrize("whole_every", [0, 2])
def test_stream_of_batches_equals_rebuild(spark, tmp_path, whole_every):
    tables = incremental.graph_tables(spark, f"file://{tmp_path}/graph", buckets=4)
    tree = dict(STEPS[0])
    assert incremental.build(tables, *_parsed(spark, tree), _cut)
    assert not incremental.build(tables, *_parsed(spark, tree), _cut)  # done before
    _same_as_rebuild(spark, tables, tree)
    (tmp_path / "in").mkdir()
    for k, step in enumerate(STEPS[1:]):
        (tmp_path / f"in/{k}.txt").write_text(_feed(tree, step))
        tree = {p: t for p, t in (tree | step).items() if t is not None}
        lines = updates.change_stream(spark, f"{tmp_path}/in")
        updates.update_stream(lines, tables, _reader(spark, tree), f"{tmp_path}/cp", _cut, whole_every=whole_every).awaitTermination()
        _same_as_rebuild(spark, tables, tree)
    # the last batch once more, as after a driver that died before the stream's own note
    before = _rows(incremental.edges(tables), "src", "dst")
    changes = spark.createDataFrame([("", "top.py", "D")], "repo string, path string, status string")
    assert updates.apply_batch(tables, 3, changes, _reader(spark, {}), _cut) is None
    assert _rows(incremental.edges(tables), "src", "dst") == before
    if whole_every:
        assert tables.vacuum() == [0, 1]
        _same_as_rebuild(spark, tables, tree)
    else:  # every earlier state can be read
        first = {p for p in STEPS[0]}
        assert {r.path for r in tables.read("files", as_of=0).collect()} == first


def test_half_a_batch_counts_for_nothing(spark, tmp_path, monkeypatch):
    tables = incremental.graph_tables(spark, f"file://{tmp_path}/graph", buckets=2)
    tree = dict(STEPS[0])
    incremental.build(tables, *_parsed(spark, tree), _cut)
    changes = spark.createDataFrame([("", "app/util.py", "D"), ("", "late.py", "A")], "repo string, path string, status string")
    after = {p: t for p, t in (tree | {"late.py": "x = 1\n"}).items() if p != "app/util.py"}
    write, seen = tables._write, []

    def dies(rows, table, *args):
        seen.append(table)
        if len(seen) == 4:
            raise RuntimeError("lost")
        write(rows, table, *args)

    monkeypatch.setattr(tables, "_write", dies)
    with pytest.raises(RuntimeError):
        updates.apply_batch(tables, 1, changes, _reader(spark, after), _cut)
    monkeypatch.setattr(tables, "_write", write)
    _same_as_rebuild(spark, tables, tree)
    assert updates.apply_batch(tables, 1, changes, _reader(spark, after), _cut) == {"removed": 1, "added": 1, "imports": 0}
    _same_as_rebuild(spark, tables, after)


def test_only_touched_buckets_are_read(spark, tmp_path):
    tables = incremental.graph_tables(spark, f"file://{tmp_path}/graph", buckets=16)
    tree = {f"d{k}/m{j}.py": "import os\n" for k in range(30) for j in range(2)}
    incremental.build(tables, *_parsed(spark, tree), _cut)
    one = spark.createDataFrame([("", "d3/m1.py")], "repo string, path string")
    at = tables.only(one, "path")
    assert len(at) == 1
    plan = tables.read("files", at)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and f"bucket#" in plan and len(tables.read("files", at).inputFiles()) >= 1
    got = {r.path for r in tables.read("files", at).collect()}
    assert {"d3/m0.py", "d3/m1.py"} <= got and len(got) < len(tree)


def test_summaries_stay_until_the_file_changes(spark, tmp_path):
    tables = incremental.graph_tables(spark, f"file://{tmp_path}/graph", buckets=2)
    tree = dict(STEPS[0])
    incremental.build(tables, *_parsed(spark, tree), _cut)
    told = [("", n, f"about {n}", ["r"]) for n in ("app/main.py::main", "app/util.py::helper", "external::os", "lib/core.py::Core")]
    incremental.tell(tables, 1, spark.createDataFrame(told, "repo string, node_id string, summary string, risks array<string>"))
    changes = spark.createDataFrame([("", "app/main.py", "M")], "repo string, path string, status string")
    after = tree | {"app/main.py": "import os\ndef main():\n    return 2\n"}
    updates.apply_batch(tables, 2, changes, _reader(spark, after), _cut)
    got = {r.node_id for r in incremental.nodes(tables).filter("summary IS NOT NULL").collect()}
    assert got == {"app/util.py::helper", "external::os", "lib/core.py::Core"}


@pytest.mark.parametrize("repair", [False, True])
def test_update_keeps_what_is_known_of_externals(spark, repair):
    tree = {"a.py": "import os\nimport re\n", "b.py": "import os\n"}
    nodes, edges = build_graph(*_parsed(spark, tree), None, _cut)
    nodes = nodes.withColumn("summary", F.when(F.col("node_id") == "external::os", "stdlib")).withColumn("risks", F.lit(None).cast("array<string>"))
    after = {"b.py": "import os\ndef g():\n    pass\n", "c.py": "import os\n"}
    files, symbols, imports = _parsed(spark, after)
    ch = spark.createDataFrame([("", "a.py", "D"), ("", "b.py", "M"), ("", "c.py", "A")], "repo string, path string, status string")
    n, e, counts = update.update_graph(written(nodes, "n"), written(edges, "e"), ch, files, symbols, imports, repair)
    got = {r.node_id: r.summary for r in n.collect()}
    assert got["external::os"] == "stdlib" and ("external::re" in got) != repair and len(got) == 5 - repair
    assert [(r.removed, r.added, r.imports) for r in counts.collect()] == [(2, 3, 2)]
    assert {(r.src, r.dst) for r in e.collect()} == {("b.py", "external::os"), ("c.py", "external::os"), ("b.py", "b.py::g")}


def test_update_writes_what_it_reads_twice_and_equals_a_full_build(spark):
    tree = {"a/x.py": "import y\nimport b.z\n", "a/y.py": "import os\n", "c.py": "import a.x\nimport b.z\n"}
    after = {"a/x.py": tree["a/x.py"], "b/z.py": "import os\ndef g():\n    pass\n", "c.py": "import a.y\n"}
    ch = spark.createDataFrame([("", "a/y.py", "D"), ("", "b/z.py", "A"), ("", "c.py", "M")], "repo string, path string, status string")
    labels = []

    def cut(rows, label):
        labels.append(label)
        return _cut(rows, label)

    was, now = build_graph(*_parsed(spark, tree), None, _cut), _parsed(spark, after)
    n, e, counts = update.update_graph(*was, ch, *now, True, cut)
    nodes, edges = build_graph(*now, None, _cut)
    key = lambda df, *cols: sorted(tuple(r) for r in df.select(*cols).collect())
    assert key(n, "node_id", "type") == key(nodes, "node_id", "type") and key(e, "src", "dst", "relationship") == key(edges, "src", "dst", "relationship")
    # imports are resolved, and files to do again found, in one written table
    assert sorted(labels) == ["again", "doomed", "every", "live"]
    assert [(r.removed, r.added, r.imports) for r in counts.collect()] == [(2, 3, 2)] == [(r.removed, r.added, r.imports) for r in update.change_counts(was[0], ch, *now).collect()]


def test_tables_are_read_once_and_asked_for_by_two_names(spark, tmp_path):
    files = spark.createDataFrame([("", p, 1, 1, "h") for p in ("a/x.py", "a/y.py", "b/__init__.py")], "repo string, path string, size long, token_est long, sha256 string")
    symbols = spark.createDataFrame([("", "a/x.py", "function", "f", 1, 2)], "repo string, path string, type string, name string, start_line int, end_line int")
    imports = spark.createDataFrame([("", "a/x.py", "y"), ("", "a/x.py", "b"), ("", "a/y.py", "q.r"), ("", "a/y.py", "b")], "repo string, src string, name string")
    tables = incremental.graph_tables(spark, f"{tmp_path}/g", buckets=4)
    incremental.build(tables, files, symbols, imports, _cut)
    asked = [(r.dir, r.name, r.path) for r in tables.read("asked").collect()]
    assert sorted(asked) == [("a", "b", "a/b"), ("a", "b", "b"), ("a", "q.r", "a/q.r"), ("a", "q.r", "q/r"), ("a", "y", "a/y"), ("a", "y", "y")]
    # what is meant as a package and as a module comes and goes
    changes = spark.createDataFrame([("", "a/b.py", "A"), ("", "b/__init__.py", "D"), ("", "q/r/__init__.py", "A")], "repo string, path string, status string")
    live = spark.createDataFrame([("", p, 1, 1, "h") for p in ("a/b.py", "q/r/__init__.py")], files.schema)
    incremental.update(tables, 1, changes, live, symbols.limit(0), imports.limit(0), _cut)
    labels = []
    read = incremental.read_once(tables, lambda df, label: labels.append(label) or _cut(df, label))
    n, e = incremental.nodes(tables, "p", read=read), incremental.edges(tables, "p", read=read)
    assert sorted(labels) == ["directories", "files", "resolved", "symbols"]
    assert _rows(n, "node_id") == _rows(incremental.nodes(tables, "p"), "node_id") and _rows(e, "src", "dst") == _rows(incremental.edges(tables, "p"), "src", "dst")
    assert {(r.src, r.dst) for r in e.filter("relationship = 'IMPORTS'").collect()} == {("a/x.py", "a/y.py"), ("a/x.py", "a/b.py"), ("a/y.py", "a/b.py"), ("a/y.py", "q/r/__init__.py")}


def test_imports_that_stay_as_they_are_are_not_written_again(spark, tmp_path):
    """Of a file with many imports only the one that means a path that comes or goes is resolved again."""
    tables = incremental.graph_tables(spark, f"file://{tmp_path}/graph", buckets=2)
    inventory = "repo string, path string, size long, token_est long, sha256 string"
    files = lambda *paths: spark.createDataFrame([("", p, 1, 0, p) for p in paths], inventory)
    symbols = spark.createDataFrame([("", "a.py", "function", "f", 1, 2)], "repo string, path string, type string, name string, start_line int, end_line int")
    names = [f"x{k}" for k in range(20)] + ["new", "b"]
    imports = spark.createDataFrame([("", "a.py", n) for n in names], "repo string, src string, name string")
    nothing = lambda df: df.limit(0)
    changes = lambda *rows: spark.createDataFrame([("", *r) for r in rows], "repo string, path string, status string")
    got = lambda: {(r.src, r.dst) for r in incremental.edges(tables).filter("relationship = 'IMPORTS'").collect()}
    want = lambda *known: {("a.py", f"{n}.py" if n in known else f"external::{n}") for n in names}
    stored = lambda batch: spark.read.parquet(f"file://{tmp_path}/graph/resolved/batch={batch}").count()
    assert incremental.build(tables, files("a.py", "b.py"), symbols, imports, _cut) and got() == want("b")
    incremental.update(tables, 1, changes(("new.py", "A")), files("new.py"), nothing(symbols), nothing(imports), _cut)
    assert got() == want("b", "new") and stored(1) == 1
    incremental.update(tables, 2, changes(("new.py", "D"), ("b.py", "D")), nothing(files("b.py")), nothing(symbols), nothing(imports), _cut)
    assert got() == want() and stored(2) == 2
    incremental.update(tables, 3, changes(("new.py", "A")), files("new.py"), nothing(symbols), nothing(imports), _cut, whole=True)
    assert got() == want("new") and stored(3) == len(names)
    incremental.update(tables, 4, changes(("a.py", "M")), files("a.py"), symbols, imports.filter("name IN ('new', 'x1')"), _cut)
    assert got() == {("a.py", "new.py"), ("a.py", "external::x1")} and stored(4) == 2
    assert tables.vacuum() == [0, 1, 2] and got() == {("a.py", "new.py"), ("a.py", "external::x1")}
