"""Ignore rules by repository, blanks of all scripts, broken sources, tasks of equal bytes."""

import ast
import os
import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom import registry
from corpusloom.functions import text
from corpusloom.operators import extract, ignore


@pytest.mark.parametrize(("pattern", "hits", "misses"), [
    ("[[]x", ["[x", "a/[x"], ["x"]), ("[z-a].py", [], ["z.py", "a.py", "-.py"]), ("[!z-a].py", ["q.py"], ["qq.py"]), ("[a&&b].py", ["a.py", "&.py", "b.py"], ["c.py"]),
    ("[]a].py", ["].py", "a.py"], ["b.py"]), ("[^a].py", ["^.py", "b.py"], ["a.py"]), ("[a^].py", ["^.py", "a.py"], ["b.py"]), ("x[", ["x["], ["x"]), ("[a-c-].t", ["b.t", "-.t"], ["d.t"]),
    ("[\\d].t", ["\\.t", "d.t"], ["5.t"]), ("[é-ü]", ["ö"], ["z"]), ("[.]x", [".x"], ["ax"]),
])
def test_brackets_in_both_engines(spark, pattern, hits, misses):
    regex = ignore.compiled(pattern)[0]
    rows = spark.createDataFrame([(p,) for p in hits + misses], "path string")
    assert {r.path for r in rows.filter(F.col("path").rlike(f"(?s)^(?:{regex})$")).collect()} == set(hits)
    assert {p for p in hits + misses if re.compile(f"(?s)(?:{regex})\\Z").match(p)} == set(hits)
    assert {p for p in hits + misses if ignore.Rules([pattern]).last(p) is False} == set(hits)


def test_a_program_decides_as_its_patterns_do():
    rng = random.Random(4)
    names = ["a", "b", "ab", "x.py", "y.py", "c.md", "!z", "[k]", "d"]
    forms = ["{0}", "{0}/", "/{0}", "{0}/{1}", "/{0}/{1}/", "*.py", "*.md/", "**/{0}", "{0}/**", "{0}/*.py", "*", "?", "[ab]", "!{0}", "!*.py", "!{0}/", "!/{0}/{1}", "{0} ", "\\!z", "*.p*", "#x", "", "*.py "]
    for _ in range(400):
        patterns = [rng.choice(forms).format(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(1, 8))]
        rules = ignore.Rules(patterns)
        for _ in range(20):
            path = "/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "/"])
            want = None
            for p in patterns:
                c = ignore.compiled(p)
                if c and re.compile(f"(?s)(?:{c[0]})\\Z").match(path):
                    want = c[1]
            assert rules.last(path) == want, (patterns, path)


def test_rules_of_many_repositories(spark):
    paths = ["dist/bundle.js", "dist/keep.txt", "main.py", "doc/a.md", "doc/deep/b.md", ".git/x"]
    files = spark.createDataFrame([(r, p, 1) for r in ("one", "two", "none") for p in paths], "repo string, path string, negated int")
    rules = spark.createDataFrame([("one", 1, "!dist/keep.txt"), ("one", 2, "*.md"), ("two", 1, "doc/"), ("two", 2, "!doc/deep/b.md"), ("two", 3, "[z-a]"), ("other", 1, "*")], "repo string, seq int, pattern string")
    got = {(r.repo, r.path) for r in ignore.filter_by_rules(files, rules, per_slice=2).collect()}
    assert got == {("one", "dist/keep.txt"), ("one", "main.py"), ("two", "main.py"), ("two", "doc/deep/b.md"), ("none", "main.py"), ("none", "doc/a.md"), ("none", "doc/deep/b.md")}
    # in the tree a hidden directory hides all below it
    tree = {(r.repo, r.path) for r in ignore.filter_tree_by_rules(files, rules, per_slice=2).collect()}
    assert {p for r, p in tree if r == "two"} == {"main.py"} and {p for r, p in tree if r == "none"} == {"main.py", "doc/a.md", "doc/deep/b.md"}


def test_blanks_of_all_scripts(spark):
    rows = [(1, "\u00a0- dist/\n1.\u00a0*.log\n\u3000build\u2003\n\u0661. x/\n"), (2, "\u3000\n\n")]
    df = spark.createDataFrame(rows, "id int, t string")
    assert [r.pattern for r in text.clean_patterns(df, "id", "t").orderBy("id", "pos").collect()] == ["dist/", "*.log", "build", "x/"]
    p = spark.createDataFrame([("r", "\u00a0*.md\u3000\n\u00a0# no\n\u2003\n")], "repo string, text string")
    assert [r.pattern for r in ignore.load_patterns(p).collect()] == ["*.md"]


def test_ends_are_stripped_without_a_look_at_every_run_of_blanks(spark):
    """A run of 200,000 blanks inside a text was tried again from each of its places."""
    run = "x" + " " * 200_000 + "y"
    odd = [chr(k) for k in range(0x3100) if chr(k).isspace() or k in (0x200B, 0x180E, 0xFEFF)]
    rows = [(1, run)] + [(k + 2, f"{c}{c}a{c}b{c}") for k, c in enumerate(odd)] + [(9998, " \u2028\r\n"), (9999, "")]
    began = time.monotonic()
    got = {r.id: r.t for r in spark.createDataFrame(rows, "id int, t string").select("id", text.stripped(F.col("t")).alias("t")).collect()}
    assert got == {k: t.strip() for k, t in rows} and time.monotonic() - began < 15


def test_line_of_the_imported_name(spark):
    t = spark.createDataFrame([("", "a.py", "import a, \\\n  b\n"), ("", "b.py", "import a, \\\n  b\ndef (\n")], "repo string, path string, text string")
    got = {(r.path, r.name, r.start_line, r.parse_status) for r in extract.extract_symbols(t).collect()}
    assert got == {("a.py", "a", 1, "ok"), ("a.py", "b", 2, "ok"), ("b.py", "a", 1, "partial"), ("b.py", "b", 2, "partial")}


def test_scanner_equals_the_parser_on_valid_files():
    n = 0
    for f in sorted(Path(os.__file__).parent.glob("[a-m]*.py")):
        source = f.read_text(encoding="utf-8", errors="replace")
        try:
            ast.parse(source)
        except SyntaxError:
            continue
        assert extract._scanned(source) == extract._parsed(source), f
        n += 1
    assert n > 50
    odd = "class A: import a.b; x = {'k': 1}; import c as d\nif lambda: 1: import e\nfrom f import (\n  g)\nasync def h(x: int = {1: 2}[1]): return '''\n'''\n@dec(\n 1)\ndef i():\n    s = 'a\\\n b'\n\n    # trailing\n\nfrom . import j\nfrom __future__ import k\n"
    assert extract._scanned(odd) == extract._parsed(odd)


@pytest.mark.parametrize(("source", "want"), [
    ("def a():\n    x = (1,\ndef b():\n    pass\nimport os\n", [("function", "a", 1, 2), ("function", "b", 3, 4), ("import", "os", 5, 5)]),
    ("class A:\n    def m(self):\n        return [1\n\n    def n(self):\n        pass\n\nx = )\n", [("class", "A", 1, 6), ("function", "m", 2, 3), ("function", "n", 5, 6)]),
    ("s = 'never closed\nimport re\ndef f(:\n    return 1\n", [("import", "re", 2, 2)]),
    ("'''open\nimport a\n", [("import", "a", 2, 2)]),
    ("x = 'import no'\n# def no(): pass\n'''\nclass No: pass\n'''\nclass Yes(:\n    pass\n", [("class", "Yes", 6, 7)]),
    ("import a as b, c\nfrom x.y import z\nfrom . import q\nif :\n", [("import", "c", 1, 1), ("import", "x.y", 2, 2)]),
])
def test_broken_files(source, want):
    got = extract._scanned(source)
    assert [x for x in got if x in want] == want
    with pytest.raises(SyntaxError):
        ast.parse(source)


def test_tasks_of_equal_bytes(spark):
    rng = random.Random(1)
    sizes = [40_000] * 3 + [int(rng.paretovariate(1.1) * 100) % 30_000 + 1 for _ in range(3000)]
    files = spark.createDataFrame([("r", f"f{i}.py", s) for i, s in enumerate(sizes)], "repo string, path string, size long")
    for tasks in (4, 8):
        dealt = extract.deal_by_size(files, F.col("size"), tasks).groupBy(F.spark_partition_id().alias("t")).agg(F.sum("size").alias("n")).collect()
        assert len(dealt) == tasks and sum(r.n for r in dealt) == sum(sizes)
        assert max(r.n for r in dealt) < 1.5 * sum(sizes) / tasks
    assert extract.deal_by_size(files.limit(0), F.col("size")).count() == 0


def test_inventory_query_and_sql_take_back_alike(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(67, "SMALL TIN", "Brand#11", 1), (7507, "SMALL TIN", "Brand#12", 1), (36, "SMALL TIN", "Brand#13", 1), (747, "SMALL TIN", "Brand#14", 1), (41, "SMALL TIN", "Brand#15", 1)]
    spark.createDataFrame(rows, "p_partkey long, p_type string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.path for r in registry.queries()["b1_inventory_filter"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    told = {r[0] for r in con.execute(registry.oracle_sql()["b1_inventory_filter"]).fetchall()}
    assert got == told == {"dist/b12/notes7507.md", "src/small tin/b14/notes747.md", "src/small tin/b15/m41.py"}
