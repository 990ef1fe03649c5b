"""Small fixtures for the corpus operators."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.cut import release, written
from corpusloom.functions import paths, text
from corpusloom.operators import changes, enrich, extract, hierarchy, ignore, packages, report, traverse, tree
from corpusloom.plans.build import build_graph, build_tree
from corpusloom.sources import files as sources

MAIN = "from utils import helper_function\n\ndef main():\n    pass\n"
UTILS = "import os\nimport json as j\nfrom . import x\nfrom __future__ import annotations\n\n@dec\nasync def helper_function():\n    return 1\n"


@pytest.fixture(scope="module")
def built(spark):
    texts = spark.createDataFrame([("", "utils.py", UTILS), ("", "main.py", MAIN)], "repo string, path string, text string")
    files = texts.select("repo", "path", F.char_length("text").cast("long").alias("size"), F.lit(1).cast("long").alias("token_est"))
    nodes = extract.extract_symbols(texts)
    return build_graph(files, extract.definitions(nodes), extract.imports(nodes), "p"), texts


def test_two_files(built):
    (nodes, edges), _ = built
    ids = {r.node_id: r.type for r in nodes.collect()}
    assert ids == {"utils.py": "file", "main.py": "file", "main.py::main": "function", "utils.py::helper_function": "function", "external::os": "external_module", "project::p": "project"}
    got = {(r.src, r.dst, r.relationship) for r in edges.collect()}
    assert ("main.py", "utils.py", "IMPORTS") in got and ("utils.py", "external::os", "IMPORTS") in got
    assert ("project::p", "main.py", "CONTAINS") in got and len(got) == 6


def test_broken_source_is_partial(spark):
    t = spark.createDataFrame([("", "a.py", "import os\ndef f(:\n"), ("", "b.txt", "def g(): 1"), ("", "c.py", "")], "repo string, path string, text string")
    assert [(r.name, r.parse_status) for r in extract.extract_symbols(t).orderBy("seq").collect()] == [("os", "partial"), ("f", "partial")]


@pytest.mark.parametrize(("pattern", "path", "hit"), [
    ("dist", "a/dist/x", True), ("/dist", "a/dist/x", False), ("*.md", "a/b.md", True), ("a/*.py", "a/b/c.py", False), ("a/**/c.py", "a/c.py", True),
    ("build/", "build", False), ("build/", "build/x", True), ("[!a].py", "b.py", True), ("x?", "xy", True), ("# no", "no", None),
])
def test_patterns(spark, pattern, path, hit):
    c = ignore.compiled(pattern)
    assert (c is None) == (hit is None)
    if c:
        assert spark.range(1).select(F.lit(path).rlike(f"(?s)^(?:{c[0]})$")).first()[0] == hit


def test_negation_takes_back(spark):
    f = spark.createDataFrame([("", p) for p in ("dist/bundle.js", "dist/keep.txt", "main.py", ".git/x", ".gitignore")], "repo string, path string")
    assert {r.path for r in ignore.filter_inventory(f, ["!dist/keep.txt"]).collect()} == {"dist/keep.txt", "main.py"}
    rules = spark.createDataFrame([("", 1, "!dist/keep.txt")], "repo string, seq int, pattern string")
    assert {r.path for r in ignore.filter_by_rules(f, rules).collect()} == {"dist/keep.txt", "main.py"}


def test_tree(spark):
    f = spark.createDataFrame([("", p) for p in ("README.md", "src/main.py", "src/utils/helper.py")], "repo string, path string")
    t = tree.tree_report(f, "demo").first()
    assert t.tree_string.split("\n") == ["demo/", "├── README.md", "└── src/", "    ├── main.py", "    └── utils/", "        └── helper.py"]
    assert (t.total_files, t.total_folders) == (3, 2)


def test_feed_and_diff(spark):
    lines = ["M\tp", "A\tp", "D\tp", "R100\told\tnew", "R100\tonly", "X\tp", "garbage"]
    got = [(r.path, r.status) for r in changes.parse_feed(spark.createDataFrame([(x,) for x in lines], "line string")).collect()]
    assert got == [("p", "M"), ("p", "A"), ("p", "D"), ("old", "D"), ("new", "A")]
    h = "repo string, path string, sha256 string"
    d = changes.diff_hashes(spark.createDataFrame([("", "app.py", "n"), ("", "new.py", "n")], h), spark.createDataFrame([("", "app.py", "o"), ("", "gone.md", "o")], h))
    assert {(r.path, r.status) for r in d.collect()} == {("app.py", "M"), ("new.py", "A"), ("gone.md", "D")}


def test_cycle_ends(spark):
    e = spark.createDataFrame([("", "a", "b"), ("", "b", "a"), ("", "b", "c")], "repo string, src string, dst string")
    s = spark.createDataFrame([("", "a")], "repo string, seed string")
    got = {(r.node_id, r.hops, r.parent) for r in traverse.reach(e, s, lambda x: written(x, "t")).collect()}
    assert got == {("a", 0, None), ("b", 1, "a"), ("c", 2, "b")}


def test_responses_and_merge(spark):
    r = spark.createDataFrame([("", 0, '[{"node_id": "a", "summary": "s"}, 5, {"x": 1}]'), ("", 1, 'so:\n[{"node_id": "a", "risks": ["r"]}]'), ("", 2, "no")], "repo string, batch long, response string")
    ok, bad = enrich.parse_responses(r)
    assert bad.count() == 1
    n = spark.createDataFrame([("", "a", None, None), ("", "b", None, None)], "repo string, node_id string, summary string, risks array<string>")
    assert {(x.node_id, x.summary) for x in enrich.merge_results(n, ok).collect()} == {("a", ""), ("b", None)}


def test_model_failure_is_isolated(spark):
    def send(system, prompt):
        if prompt == "bad":
            raise ValueError("x")
        return prompt.upper()

    p = spark.createDataFrame([("", 0, "ok"), ("", 1, "bad")], "repo string, batch long, prompt string")
    got = {r.batch: (r.response, r.error) for r in enrich.call_model(p, send, wait=0).collect()}
    assert got == {0: ("OK", None), 1: (None, "ValueError: x")}


def test_text_functions(spark):
    s = spark.createDataFrame([(1, "```\n- dist/\n1. *.log\n# c\nsome prose here\n.env\nbuild\n```")], "id int, t string")
    assert [r.pattern for r in text.clean_patterns(s, "id", "t").orderBy("pos").collect()] == ["dist/", "*.log", ".env", "build"]
    l = spark.createDataFrame([("",), ("a\r\nb\n",), ("a\n\n",)], "t string").select(paths.lines(F.col("t")).alias("l"))
    assert [r.l for r in l.collect()] == ["".splitlines(), "a\r\nb\n".splitlines(), "a\n\n".splitlines()]


def test_decoding(spark):
    c = spark.createDataFrame([("", "a", b"\xc3\xa4"), ("", "b", b"\xe4"), ("", "c", b"x\x00")], "repo string, path string, content binary")
    assert [(r.text, r.read_error) for r in sources.decoded(c).orderBy("path").collect()] == [("ä", None), ("ä", None), (None, "binary")]


def test_listing_sees_hidden_names(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    for n in ("pkg/__init__.py", "pkg/.h.py", "top.py"):
        (tmp_path / n).write_text("x" * 9)
    got = {(r.path, r.size, r.token_est) for r in sources.list_files(spark, {"": str(tmp_path)}).collect()}
    assert got == {("pkg/__init__.py", 9, 2), ("pkg/.h.py", 9, 2), ("top.py", 9, 2)}


def test_reports(built):
    (nodes, edges), _ = built
    nodes = nodes.withColumn("summary", F.when(F.col("type") == "function", "does")).withColumn("risks", F.lit(None).cast("array<string>"))
    mod = {r.node_id: r.report for r in report.modules(nodes, edges).collect()}
    assert mod["utils.py"] == "# utils.py\n\n## Enthält:\n\n- **helper_function** - does\n\n## Abhängigkeiten:\n\n- Importiert: external::os\n- Wird importiert von: main.py (1x)\n"
    sym = {r.node_id: r.report for r in report.symbols(nodes, edges).collect()}
    assert sym["utils.py::helper_function"] == "# utils.py::helper_function\n\n## Signatur:\n\ndef helper_function(...)\n\n## Verhalten:\n\ndoes\n\n## Aufrufer:\n\n- main.py\n"
    assert report.overview(nodes, edges).first().report.startswith("# p\n\n## Hauptbereiche:\n\n- **main.py**\n")


def test_module_reports_of_files_and_their_children(spark, built):
    """Repeated imports are told once, children given are those looked up, and only a file has importers, however it is called."""
    (nodes, edges), _ = built
    nodes = nodes.withColumn("summary", F.when(F.col("type") == "function", "does")).withColumn("risks", F.lit(None).cast("array<string>"))
    want = {r.node_id: r.report for r in report.modules(nodes, edges).collect()}
    files, imports = nodes.filter("type = 'file'"), edges.filter("relationship = 'IMPORTS'")
    kids = nodes.filter("type IN ('function', 'class')").withColumn("parent", paths.file_of(F.col("node_id")))
    assert {r.node_id: r.report for r in report.modules(files, imports.unionByName(imports), kids).collect()} == want and len(want) > 1
    alike = files.limit(1).withColumn("node_id", F.lit("external::os"))
    got = {r.node_id: r.report for r in report.modules(files.unionByName(alike), imports, kids).collect()}
    assert got.pop("external::os") == "# external::os\n\n## Abhängigkeiten:\n\n- Wird importiert von: utils.py (1x)\n" and got == want


def test_imports_meet_files_without_being_sorted(spark):
    from corpusloom.operators import graph

    imports = spark.range(9).selectExpr("'' AS repo", "concat('d/m', id, '.py') AS src", "concat('m', id + 1) AS name")
    out = graph.resolve_imports(imports, imports.selectExpr("repo", "src AS path"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan
    assert {(r.src, r.strategy, r.dst) for r in out.collect()} == {(f"d/m{i}.py", *((1, f"d/m{i + 1}.py") if i < 8 else (5, "external::m9"))) for i in range(9)}


def test_batch_size_and_roll_up(spark, built):
    (nodes, edges), _ = built
    with pytest.raises(ValueError):
        packages.batches(nodes, 0)
    nodes = nodes.withColumn("summary", F.when(F.col("type") == "function", "does"))
    up = hierarchy.roll_up(nodes, edges, lambda x: written(x, "t"))
    assert {r.node_id: r.summary for r in up.collect()}["project::p"] == "main.py: main.py::main: does; utils.py: utils.py::helper_function: does"


def test_batches_never_meet_by_repository_alone(spark):
    rows = [(r, f"n{k:03d}") for r in ("a", None, "b") for k in range(57)]
    nodes = spark.createDataFrame(rows, "repo string, node_id string").repartition(5)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = packages.batches(nodes, 10, lambda x: written(x, "t"))
        assert {(r.repo, r.node_id): r.batch for r in got.collect()} == {(r, n): int(n[1:]) // 10 for r, n in rows}
        dealt = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning" in x]
        assert dealt and all("shiftright(at__" in x or "p__" in x for x in dealt)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_stream_applies_changes(spark, tmp_path):
    from corpusloom.streaming.updates import apply_changes, change_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("M\tx.py\nR1\ta\tb\n")
    seen = []
    apply_changes(change_stream(spark, str(tmp_path / "in")), lambda df, k: seen.extend((r.path, r.status) for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [("a", "D"), ("b", "A"), ("x.py", "M")]


def test_code_report_beyond_four_digits(spark):
    t = spark.createDataFrame([("", "a.py", "x\n" * 10_001)], "repo string, path string, text string")
    s = spark.createDataFrame([("", "a.py::f", "a.py", 9_999, 10_001)], "repo string, node_id string, path string, start_line int, end_line int")
    lines = extract.numbered_code(s, t).first().report.split("\n")
    assert lines[0] == "# a.py::f - Quellcode" and lines[3:6] == ["9999 | x", "10000 | x", "10001 | x"]


def test_answers_of_another_kind(spark):
    """JSON that isn't an array, or isn't an object, is rejected whole."""
    r = spark.createDataFrame([("", 0, '{"a": [{"node_id": "x"}]}')], "repo string, batch long, response string")
    ok, bad = enrich.parse_responses(r)
    assert ok.count() == 0 and bad.count() == 1
    a = spark.createDataFrame([('[{"action": "x"}]',), ('so {"action": "y"}',)], "t string")
    assert [x.action for x in text.parse_actions(a, "t").collect()] == [None, "y"]


def test_impact_of_whole_import_chains(spark):
    """The unbounded query against a walk in plain Python, which goes over 3 hops."""
    from corpusloom import registry

    d = "/root/testdata/sf0.01"
    users, want, deepest = {}, {}, 0
    for r in registry._imports(spark, d).collect():
        users.setdefault(r.dst, set()).add(r.src)
    for r in registry._query_set(spark, d).collect():
        seen, front, hops = {r.seed}, {r.seed}, 0
        while front := {u for x in front for u in users.get(x, ())} - seen:
            seen, hops = seen | front, hops + 1
        want[r.seed], deepest = len(seen), max(deepest, hops)
    assert {r.seed: r.n for r in registry.queries()["h2_impact_all"](spark, d).collect()} == want
    assert deepest > 3


def test_parts_joined_are_the_whole(spark, built):
    """A target that most edges have is cut into parts, which joined are its report."""
    from corpusloom.operators import parts

    (nodes, edges), _ = built
    more = spark.createDataFrame([("", f"m{k}.py", "utils.py", "IMPORTS") for k in range(57)], edges.schema)
    files = spark.createDataFrame([("", f"m{k}.py", "file") for k in range(57)], "repo string, node_id string, type string")
    nodes = nodes.unionByName(files, allowMissingColumns=True)
    nodes = nodes.withColumn("summary", F.when(F.col("node_id").isin("utils.py", "main.py::main"), "does")).withColumn("risks", F.when(F.col("node_id") == "utils.py", F.array(F.lit("a"), F.lit("b"))))
    edges = edges.unionByName(more)
    want = {r.node_id: r.report for r in report.modules(nodes, edges).collect()}
    for size in (1, 5, 1000):
        rows = parts.module_texts(nodes, edges, lambda x: written(x, "t"), size).collect()
        got = {}
        for r in sorted(rows, key=lambda r: (r.node_id, r.section, r.part)):
            got[r.node_id] = got.get(r.node_id, "") + r.text
        assert got == want
        assert sum(r.node_id == "utils.py" and r.section == 3 for r in rows) == -(-58 // size)
    lists = parts.edge_lists(edges, lambda x: written(x, "t"), 7).collect()
    whole = {r.node_id: r.in_edges for r in report.full_report(nodes, edges).collect()}
    assert "".join(r.edges for r in sorted(lists, key=lambda r: r.part) if (r.node_id, r.direction) == ("utils.py", "in")) == whole["utils.py"]
    with pytest.raises(ValueError):
        parts.in_parts(edges, ["src"], ["dst"], "dst", ",", written, 0)


def test_overview_parts_joined_are_the_whole(spark, built):
    """Main areas and hints come in parts; a project without any, and no project at all, too."""
    from corpusloom.operators import parts

    (nodes, edges), _ = built
    dirs = [f"d{k}" for k in range(23)]
    files = [f"{d}/m.py" for d in dirs]
    rows = [("", d, "package", d) for d in dirs] + [("", f, "file", f) for f in files] + [("bare", "project::b", "project", None), ("none", "a.py", "file", "a.py")]
    rows += [("", "project::corpus", "project", "corpus")] if not nodes.filter("type = 'project' AND repo = ''").count() else []
    more = spark.createDataFrame(rows, "repo string, node_id string, type string, name string")
    project = nodes.filter("type = 'project' AND repo = ''").select("node_id").first()
    top = project.node_id if project else "project::corpus"
    links = [("", top, d, "CONTAINS") for d in dirs] + [("", a, b, "IMPORTS") for a, b in zip(files, files[1:], strict=False)]
    links += [("none", "x/a.py", "y/b.py", "IMPORTS")]
    nodes = nodes.unionByName(more, allowMissingColumns=True)
    nodes = nodes.withColumn("summary", F.when(F.col("node_id").isin(top, "d3", "project::b"), "does")).withColumn("risks", F.array().cast("array<string>"))
    edges = edges.unionByName(spark.createDataFrame(links, edges.schema))
    want = {r.repo: r.report for r in report.overview(nodes, edges).collect()}
    assert want["none"].endswith("No project node found.\n") and "d22" in want[""] and want["bare"] == "# project::b\n\ndoes\n"
    for size in (1, 5, 1000):
        rows = parts.overview_texts(nodes, edges, lambda x: written(x, "t"), size).collect()
        got = {}
        for r in sorted(rows, key=lambda r: (r.repo, r.section, r.part)):
            got[r.repo] = got.get(r.repo, "") + r.text
        assert got == want


def _random_tree(spark, seed):
    """Files of two repositories, their hierarchy and symbols of which some have summaries."""
    rng = random.Random(seed)
    files = sorted({(r, "/".join([*rng.choices("ab", k=rng.randint(0, 3)), f"m{rng.randint(0, 6)}.py"])) for r in ("x", "y") for _ in range(25)})
    f = spark.createDataFrame([(*p, 1, 1) for p in files], "repo string, path string, size long, token_est long")
    sym = [(*p, "function", f"s{k}", k + 1, k + 2) for p in files for k in range(rng.randint(0, 4))]
    nodes, edges = build_tree(f, spark.createDataFrame(sym, "repo string, path string, type string, name string, start_line int, end_line int"), "p")
    told = (F.col("type") == "function") & (F.xxhash64("repo", "node_id", F.lit(seed)) % 3 != 0) | F.col("node_id").isin("a/b", "a/m1.py", "b/b/b")
    return nodes.withColumn("summary", F.when(told, F.concat(F.lit("ü "), "node_id"))), edges


@pytest.mark.parametrize("seed", [1, 2])
def test_pieces_are_the_roll_up(spark, seed):
    cut = lambda x: written(x, "t")
    nodes, edges = (written(x, "t") for x in _random_tree(spark, seed))
    whole = hierarchy.roll_up(nodes, edges, cut).filter("level <= 2 AND summary <> ''")
    want = {(r.repo, r.node_id): r.summary for r in whole.collect()}
    pieces = {}
    for r in sorted(hierarchy.roll_up_pieces(nodes, edges, cut, 2).collect(), key=lambda r: r.place):
        pieces.setdefault((r.repo, r.node_id), []).append(r.text)
    symbols = {k: [v] for k, v in want.items() if "::s" in k[1]}
    assert {k: "".join(v) for k, v in pieces.items()} == {k: v for k, v in want.items() if k not in symbols}
    # a project's text lies in as many pieces as files below it have one
    assert all(len(v) > 5 for k, v in pieces.items() if k[1] == "project::p")
    told = lambda df: {(r.repo, r.node_id): r.digest for r in df.collect()}
    assert told(hierarchy.roll_up_digests(nodes, edges, cut, 2)) == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def test_digests_again_are_those_of_a_full_roll_up(spark):
    cut = lambda x: written(x, "t")
    nodes, edges = (written(x, "t") for x in _random_tree(spark, 3))
    hit = (F.col("type") == "function") & (F.col("repo") == "x") & F.col("name").isin("s0")
    edited = nodes.withColumn("summary", F.when(hit, F.lit("again")).otherwise(F.col("summary")))
    told = lambda df: {(r.repo, r.node_id): r.digest for r in df.collect()}
    before = cut(hierarchy.roll_up_digests(nodes, edges, cut, 2))
    got = told(hierarchy.roll_up_digests(edited, edges, cut, 2, before, nodes.filter(hit).select("repo", "node_id")))
    assert got == told(hierarchy.roll_up_digests(edited, edges, cut, 2)) != told(before)
    # what no change stands below is taken from before, not read again
    odd = before.withColumn("digest", F.lit("old"))
    kept = {k for k, v in told(hierarchy.roll_up_digests(edited, edges, cut, 2, odd, nodes.filter(hit).select("repo", "node_id"))).items() if v == "old"}
    assert {r for r, _ in kept} >= {"y"} and ("x", "project::p") not in kept


@pytest.mark.parametrize("max_hops", [None, 2])
def test_counts_are_those_of_reach(spark, max_hops):
    rng = random.Random(7)
    cut = lambda x: written(x, "t")
    rows = {(r, f"n{rng.randint(0, 90)}", f"n{rng.randint(0, 90)}") for r in ("x", "y") for _ in range(130)}
    e = spark.createDataFrame(sorted(rows), "repo string, src string, dst string")
    s = spark.createDataFrame([(r, f"n{k}") for r in ("x", "y") for k in range(100)] + [("x", "n1")], "repo string, seed string")
    got = {tuple(r) for r in traverse.reach_counts(e, s, cut, release, max_hops, per_slice=128).select("repo", "seed", "hops", "n").collect()}
    want = traverse.reach(e, s, cut, max_hops).groupBy("repo", "seed", "hops").agg(F.count(F.lit(1)).alias("n"))
    assert got == {tuple(r) for r in want.collect()}
    assert max(h for _, _, h, _ in got) >= 2


def test_a_tree_is_the_graph_without_imports(spark, built):
    (nodes, edges), texts = built
    files = texts.select("repo", "path", F.char_length("text").cast("long").alias("size"), F.lit(1).cast("long").alias("token_est"))
    tree_nodes, tree_edges = build_tree(files, extract.definitions(extract.extract_symbols(texts)), "p")
    key = lambda df, *cols: {tuple(r) for r in df.select(*cols).collect()}
    cols = ("repo", "node_id", "type", "name", "size", "level")
    assert key(tree_nodes, *cols) == key(nodes.filter("type <> 'external_module'"), *cols)
    assert key(tree_edges, "src", "dst") == key(edges.filter("relationship = 'CONTAINS'"), "src", "dst")


def _shortest(edges, seed):
    """{node: (hops, smallest predecessor, path)} by walking from one seed."""
    out, level = {seed: (0, None, [seed])}, [seed]
    while level:
        up = {}
        for a in level:
            for b in edges.get(a, ()):
                if b not in out:
                    up[b] = min(up.get(b, a), a)
        for b, a in up.items():
            out[b] = (out[a][0] + 1, a, [*out[a][2], b])
        level = list(up)
    return out


def test_reach_and_paths_are_shortest(spark, monkeypatch):
    monkeypatch.setattr(traverse, "HOT", 4)
    rng = random.Random(11)
    cut = lambda x: written(x, "t")
    rows = {(r, f"n{rng.randint(0, 90)}", f"n{min(rng.randint(0, 90), rng.randint(0, 90))}") for r in ("x", "y") for _ in range(170)}
    seeds = [(r, f"n{k}") for r in ("x", "y") for k in range(100)]
    e = spark.createDataFrame(sorted(rows), "repo string, src string, dst string")
    s = spark.createDataFrame([*seeds, ("x", "n1")], "repo string, seed string")
    graphs = {r: {} for r in ("x", "y")}
    for r, a, b in rows:
        graphs[r].setdefault(a, []).append(b)
    want = {(r, seed, n): v for r, seed in seeds for n, v in _shortest(graphs[r], seed).items()}
    got = traverse.reach(e, s, cut).collect()
    assert len(got) == len(want) and {(r.repo, r.seed, r.node_id): (r.hops, r.parent) for r in got} == {k: v[:2] for k, v in want.items()}
    got = traverse.reach_paths(e, s, cut).collect()
    assert len(got) == len(want) and {(r.repo, r.seed, r.node_id): r.path for r in got} == {k: v[2] for k, v in want.items()}
    assert max(v[0] for v in want.values()) >= 4


def test_reach_writes_no_row_for_each_pair(spark):
    wrote = []

    def cut(rows):
        wrote.append(written(rows, "t"))
        return wrote[-1]

    pairs = [("", f"s{k:02}", "hub") for k in range(64)] + [("", "hub", f"leaf{k}") for k in range(100)]
    e = spark.createDataFrame(pairs, "repo string, src string, dst string")
    s = e.filter("dst = 'hub'").select("repo", F.col("src").alias("seed"))
    assert traverse.reach(e, s, cut).count() == traverse.reach_paths(e, s, cut).count() == 64 * 102
    assert max(t.count() for t in wrote) <= 300


def test_paths_that_end_are_not_written(spark, monkeypatch):
    """Where every seed has a path of its own, only nodes from which it goes on have rows."""
    monkeypatch.setattr(traverse, "PACK", 7)
    wrote = []

    def cut(rows):
        wrote.append(written(rows, "t"))
        sizes.append(wrote[-1].count())
        return wrote[-1]

    sizes = []
    way = [(f"s{k:02}", f"m{k:02}") for k in range(70)] + [(f"m{k:02}", "hub") for k in range(70)] + [("hub", f"leaf{k}") for k in range(60)] + [(f"leaf{k}", f"end{k % 50}") for k in range(60)]
    e = spark.createDataFrame([("", a, b) for a, b in way], "repo string, src string, dst string")
    s = e.filter("dst LIKE 'm%'").select("repo", F.col("src").alias("seed"))
    graph_of = {}
    for a, b in way:
        graph_of.setdefault(a, []).append(b)
    for max_hops in (None, 3):
        want = {(x, n): " ".join(v[2]) for x in graph_of if x[0] == "s" for n, v in _shortest(graph_of, x).items() if max_hops is None or v[0] <= max_hops}
        got = traverse.reach_path_texts(e, s, cut, max_hops, release).collect()
        assert len(got) == len(want) and {(r.seed, r.node_id): r.path for r in got} == want
    assert max(sizes) <= 400  # of 70 * 60 paths to a leaf


def test_imports_are_resolved_by_two_joins(spark):
    """Equal to the rule on random names; no import is multiplied by its candidate paths."""
    from corpusloom.operators import graph

    rng = random.Random(5)
    dirs = ["", "a", "a/b", "b", "c/d"]
    at = lambda d, x: f"{d}/{x}" if d else x
    files = {at(d, x) for d in dirs for x in ("a.py", "b.py", "d.py", "__init__.py", "x.md", "a/b.py", "d/__init__.py", "__init__") if rng.random() < 0.5}
    asked = {(at(d, f"m{k}.py"), rng.choice(["a", "b", "a.b", "c.d", "d", "__init__", "os", "a.b.a", "b/a", "", "x.md"])) for d in dirs for k in range(12)}

    def rule(src, name):
        d, dotted = src.rpartition("/")[0], name.replace(".", "/")
        four = [at(d, f"{name}.py") if name or d else ".py", f"{dotted}.py", at(d, f"{name}/__init__.py"), f"{dotted}/__init__.py"]
        return next(((k + 1, p) for k, p in enumerate(four) if p in files), (5, f"external::{name}"))

    imports = spark.createDataFrame([("", *x) for x in sorted(asked)] + [("", "a/m0.py", None), (None, "a/m0.py", "b")], "repo string, src string, name string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = graph.resolve_imports(imports, spark.createDataFrame([("", p) for p in sorted(files)], "repo string, path string"))
        got = {(r.repo, r.src, r.name): (r.strategy, r.dst) for r in out.collect()}
        assert "posexplode" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {("", s, n): rule(s, n) for s, n in asked} | {("", "a/m0.py", None): (5, None), (None, "a/m0.py", "b"): (5, "external::b")}
    assert [r.d for r in spark.createDataFrame([("a/b",), ("a",), ("/a",), ("a/",), (None,)], "p string").select(paths.directory(F.col("p")).alias("d")).collect()] == ["a", "", "", "a", None]


def test_externals_are_removed_without_resolving_again(spark, monkeypatch):
    from corpusloom import registry
    from corpusloom.operators import graph

    calls, plain = [], graph.resolve_imports
    monkeypatch.setattr(graph, "resolve_imports", lambda *x: calls.append(1) or plain(*x))
    registry.queries()["d6_removed_nodes"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_only_long_lists_are_numbered(spark):
    """Lists of few rows are sorted as one; those of many by range partitions, with the same parts."""
    from corpusloom.operators import parts

    rows = [("k0", f"v{k:04d}") for k in range(700)] + [(f"k{k % 90}", f"w{k:04d}") for k in range(900)] + [(None, "n"), (None, "m")]
    df = spark.createDataFrame(rows, "key string, v string").repartition(3)
    for common, most in ((20_000, 0), (640, 790), (1, 2000)):
        numbered = []

        def cut(x, label="t", numbered=numbered):
            out = written(x, label)
            numbered += [out.count()] if "at__" in x.columns else []
            return out

        got = {(r.key, r.part): (r.text, r.last) for r in parts.in_parts(df, ["key"], ["v"], "v", ",", cut, 7, common).collect()}
        want = {}
        for key in {k for k, _ in rows}:
            vs = sorted(v for k, v in rows if k == key)
            for p in range(-(-len(vs) // 7)):
                want[(key, p)] = (("," if p else "") + ",".join(vs[p * 7 : p * 7 + 7]), p * 7 + 7 >= len(vs))
        assert got == want and len(numbered) == 1 and numbered[0] <= most and (common > 640 or numbered[0] >= 700)


def test_overview_joins_the_projects_children_only(spark, built):
    from corpusloom.operators import parts

    (nodes, edges), _ = built
    nodes = nodes.withColumn("summary", F.lit("s")).withColumn("risks", F.array().cast("array<string>"))
    seen = []
    cut = lambda x: seen.append(x.columns) or written(x, "t")
    parts.overview_texts(nodes, edges, cut, 5)
    assert ["repo", "node_id", "id"] in seen


def test_package_report_meets_packages_once(spark):
    """Its lists are those of the two functions on imports; what is few is written first."""
    rows = [("", p, t, p) for p, t in (("a", "package"), ("a/b", "package"), ("a/x.py", "file"), ("a/y.py", "file"), ("a/b/z.py", "file"), ("top.py", "file"), ("a/x.py::f", "function"))]
    nodes = spark.createDataFrame(rows, "repo string, node_id string, type string, name string").withColumn("summary", F.lit("s")).withColumn("risks", F.array(F.lit("r"))).withColumn("start_line", F.lit(1))
    links = [("a", "a/x.py", "CONTAINS"), ("a", "a/y.py", "CONTAINS"), ("a", "a/b", "CONTAINS"), ("a/b", "a/b/z.py", "CONTAINS"), ("a/x.py", "a/x.py::f", "CONTAINS")]
    links += [("a/x.py", "a/y.py", "IMPORTS"), ("a/x.py", "a/y.py", "IMPORTS"), ("a/x.py", "a/b/z.py", "IMPORTS"), ("top.py", "a/x.py", "IMPORTS"), ("a/b/z.py", "external::os", "IMPORTS"), ("top.py", "external::os", "IMPORTS")]
    edges = spark.createDataFrame([("", *x) for x in links], "repo string, src string, dst string, relationship string")
    labels = []
    got = {r.node_id: r.report for r in report.packages(nodes, edges, lambda df, label: labels.append(label) or written(df, label)).collect()}
    assert labels == ["packages", "inside"] and got == {r.node_id: r.report for r in report.packages(nodes, edges).collect()}
    inner = {(r.package, r.src, r.dst) for r in packages.internal_imports(edges, nodes).collect()}
    cross = {(r.package, r.direction, r.other) for r in packages.crossing_imports(edges, nodes).collect()}
    assert inner == {("a", "a/x.py", "a/y.py")} and cross == {("a", "out", "a/b/z.py"), ("a/b", "in", "a/x.py"), ("a", "in", "top.py"), ("a/b", "out", "external::os")}
    assert got["a"].count("x.py importiert y.py") == 1 and "- Importiert: a/b/z.py\n- Wird importiert von: top.py\n" in got["a"]
    assert "Interne Struktur" not in got["a/b"] and "- Importiert: external::os\n- Wird importiert von: a/x.py\n" in got["a/b"]


def test_full_report_is_written_before_it_is_sorted(spark, built):
    (nodes, edges), _ = built
    nodes = nodes.withColumn("summary", F.lit("s")).withColumn("risks", F.array(F.lit("r")))
    labels = []
    rows = report.full_report(nodes, edges, lambda df, label: labels.append(label) or written(df, label)).collect()
    assert labels == ["report"] and rows == report.full_report(nodes, edges).collect() and [r.node_id for r in rows] == sorted(r.node_id for r in rows)
    told = {r.node_id: (r.out_edges, r.in_edges) for r in rows}
    assert told["main.py"] == ("CONTAINS main.py::main; IMPORTS utils.py", "CONTAINS project::p") and told["main.py::main"] == ("", "CONTAINS main.py")
