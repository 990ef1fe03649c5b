"""Ignore rules: patterns compiled to one regular expression each, the last one that
matches decides."""

from __future__ import annotations

import re
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import LINE_END, ancestors, base_name
from ..functions.text import stripped

# Fixed values.
HARD = (".git", ".venv", "__pycache__")
META = (".gitignore",)
DEFAULTS = (
    ".git", ".svn", ".hg", ".fslckout", "_darcs", ".bzr", ".DS_Store", "Thumbs.db", "dist", "build", "out", "target", "bin", "obj",
    "vendor", "node_modules", "bower_components", ".npm", ".yarn", ".pnpm-store", ".next", ".nuxt", ".output", ".astro", ".svelte-kit",
    ".vercel", ".netlify", ".cache", ".parcel-cache", ".turbo", "coverage", ".nyc_output", ".venv", "venv", "env", ".env", "virtualenv",
    "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".hypothesize", "htmlcov", ".coverage", "cover", ".tox", ".nox",
    "site-packages", ".phpunit.cache", ".php-cs-fixer.cache", "wp-admin", "wp-includes", ".dart_tool", ".pub-cache", ".flutter-plugins",
    ".flutter-plugins-dependencies", ".gradle", "gradle", ".settings", ".classpath", ".project", "packages", "TestResults", ".vs",
    "cmake-build-debug", "cmake-build-release", "CMakeFiles", "pkg", ".idea", ".vscode",
)
WILD = ("*.egg-info",)


def _one_of(members: str, negated: bool) -> str:
    """A bracket's members as a class that Java and Python read alike: all signs but
    letters, digits and those beyond ASCII are quoted, and an empty range holds nothing."""
    quoted = lambda c: c if c.isalnum() or ord(c) > 127 else "\\" + c
    out, i = "", 0
    while i < len(members):
        if members[i + 1 : i + 2] == "-" and i + 2 < len(members):
            if members[i] <= members[i + 2]:
                out += f"{quoted(members[i])}-{quoted(members[i + 2])}"
            i += 3
        else:
            out, i = out + quoted(members[i]), i + 1
    if not out:
        return "." if negated else "(?!)"
    return f"[{'^' * negated}{out}]"


def compiled(pattern: str) -> tuple[str, bool] | None:
    """(Java regex over a whole path, negated) of one wildmatch pattern; None for
    blanks and comments. A pattern also covers everything below what it matches."""
    if not pattern.strip() or pattern.startswith("#"):
        return None
    negated = pattern.startswith("!")
    body = pattern[negated:]
    body = body[1:] if body.startswith(("\\#", "\\!")) else body.rstrip(" ") if not body.endswith("\\ ") else body
    only_dir = body.endswith("/")
    body = body.rstrip("/") if only_dir else body
    anchored = "/" in body
    body = body.lstrip("/")
    if not body:
        return None
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i) and i + 2 == len(body) and i and body[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and (m := re.match(r"(?s)\[([!^]?)(\]?[^\]]*)\]", body[i:])):
            out, i = out + _one_of(m[2], bool(m[1])), i + m.end()
        elif body[i] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out + ("/.*" if only_dir else "(?:/.*)?"), negated


class Rules:
    """The patterns of one repository as a program: plain names and ``*.suffix`` are looked
    up for each part of a path, plain anchored paths for each directory above it, and
    only what is left is matched one by one. The last pattern that matches decides."""

    def __init__(self, patterns: list[str]) -> None:
        self.names: list[dict[str, tuple[int, bool]]] = [{}, {}]  # at 1: only above something
        self.suffixes: list[dict[str, tuple[int, bool]]] = [{}, {}]
        self.paths: list[dict[str, tuple[int, bool]]] = [{}, {}]
        self.others: list[tuple[int, bool, re.Pattern]] = []
        for seq, pattern in enumerate(patterns):
            if (c := compiled(pattern)) is None:
                continue
            entry, only_dir = (seq, c[1]), int(pattern.rstrip(" ").endswith("/"))
            body = pattern[c[1] :].strip(" ").rstrip("/")
            plain = not re.search(r"[*?\[\\!#]", body[1:] if body.startswith("*.") else body)
            if plain and "/" in body and not body.startswith("*"):
                self.paths[only_dir][body.lstrip("/")] = entry
            elif plain and "/" not in body and body.startswith("*."):
                self.suffixes[only_dir][body[1:]] = entry
            elif plain and "/" not in body and pattern.lstrip("!").startswith(body):
                self.names[only_dir][body] = entry
            else:
                self.others.append((*entry, re.compile(f"(?s)(?:{c[0]})\\Z")))
        self.lengths = sorted({len(x) for d in self.suffixes for x in d})

    def last(self, path: str) -> bool | None:
        """Whether the last pattern that matches takes the path back; None if none does."""
        best: tuple[int, bool | None] = (-1, None)
        parts = path.split("/")
        for k, part in enumerate(parts):
            for only_dir in (0, 1):
                if only_dir and k + 1 == len(parts):
                    continue
                best = max(best, self.names[only_dir].get(part, best))
                for n in self.lengths:
                    best = max(best, self.suffixes[only_dir].get(part[-n:], best))
                if self.paths[only_dir]:
                    best = max(best, self.paths[only_dir].get("/".join(parts[: k + 1]), best))
        for seq, negated, regex in reversed(self.others):
            if seq < best[0]:
                break
            if regex.match(path):
                return negated
        return best[1]


def rule_verdicts(files: DataFrame, rules: DataFrame, tree: bool = False, per_slice: int = 50_000) -> DataFrame:
    """(repo, path, negated) for the files that a rule of their repository decides about.
    Each repository's patterns become one program; it meets the repository's files in
    slices of about ``per_slice``, so that neither files x rules rows nor a large
    repository in one task arise. With ``tree`` a rule that hides a directory hides all
    below it: such files come with negated false."""
    # Lists are as long as one repository's rule files.
    lists = rules.groupBy("repo").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "pattern"))), lambda x: x["pattern"]).alias("patterns"))
    mine = files.join(rules.select("repo").distinct(), "repo", "left_semi").select("repo", "path")
    slices = mine.groupBy("repo").agg(F.ceil(F.count(F.lit(1)) / per_slice).cast("int").alias("n"))
    dealt = mine.join(slices, "repo").select("repo", "path", F.pmod(F.xxhash64("path"), F.col("n")).cast("int").alias("slice"))
    programs = lists.join(slices, "repo").select("repo", "patterns", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slice"))

    def decide(paths: pd.DataFrame, program: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(paths) and len(program):
            rule = Rules(list(program["patterns"].iloc[0]))
            hidden: dict[str, bool] = {}
            for repo, path in sorted(set(zip(paths["repo"], paths["path"], strict=True))):
                said = rule.last(path)
                if tree:
                    parts = path.split("/")
                    for k in range(1, len(parts)):
                        d = "/".join(parts[:k]) + "/"
                        if d not in hidden:
                            hidden[d] = rule.last(d) is False
                        said = False if hidden[d] else said
                if said is not None:
                    rows.append((repo, path, said))
        return pd.DataFrame(rows, columns=["repo", "path", "negated"])

    by = ["repo", "slice"]
    return dealt.groupBy(*by).cogroup(programs.groupBy(*by)).applyInPandas(decide, "repo string, path string, negated boolean")


def load_patterns(ignore_files: DataFrame) -> DataFrame:
    """(repo, seq, pattern) of rows (repo, text): trimmed lines, without blanks and comments."""
    lines = ignore_files.select("repo", F.posexplode(F.split(F.coalesce("text", F.lit("")), LINE_END)).alias("seq", "pattern"))
    trimmed = lines.select("repo", "seq", stripped(F.col("pattern")).alias("pattern"))
    return trimmed.filter("pattern <> '' AND NOT startswith(pattern, '#')")


def ignored_by(path: Column, patterns: list[str]) -> Column:
    """Whether a fixed list of patterns ignores a path: one expression, no join."""
    out = F.lit(False)
    for p in patterns:
        if (c := compiled(p)) is not None:
            out = F.when(path.rlike(f"(?s)^(?:{c[0]})$"), not c[1]).otherwise(out)
    return out


def _named(names: tuple[str, ...] | list[str]) -> str:
    return "|".join(re.escape(n) for n in names)


def ignored_by_default(path: Column) -> Column:
    """The default names at any level, or an egg-info directory."""
    return path.rlike(rf"(?s)(?:^|/)(?:{_named(DEFAULTS)}|[^/]*\.egg-info)(?:/|$)")


def filter_inventory(files: DataFrame, patterns: list[str] = ()) -> DataFrame:
    """Files that the hard names, meta-files, defaults and ``patterns`` (later ones win,
    ``!`` takes back) leave."""
    path = F.col("path")
    hard = path.rlike(rf"(?s)(?:^|/)(?:{_named(HARD)})(?:/|$)") | base_name(path).isin(*META)
    rule = ignored_by_default(path)
    for p in patterns:
        if (c := compiled(p)) is not None:
            rule = F.when(path.rlike(f"(?s)^(?:{c[0]})$"), not c[1]).otherwise(rule)
    return files.filter(~hard & ~rule)


def filter_by_rules(files: DataFrame, rules: DataFrame, per_slice: int = 50_000) -> DataFrame:
    """As filter_inventory with patterns per repository, ``rules`` (repo, seq, pattern): the
    last match of a file's repository decides, else the defaults."""
    rows = filter_hard(files)
    said = rule_verdicts(rows, rules, per_slice=per_slice).withColumnsRenamed({"repo": "r__", "path": "p__", "negated": "n__"})
    j = rows.join(said, (F.col("repo") == F.col("r__")) & (F.col("path") == F.col("p__")), "left")
    return j.filter(F.coalesce("n__", ~ignored_by_default(F.col("path")))).select(*files.columns)


def filter_tree_by_rules(files: DataFrame, rules: DataFrame, per_slice: int = 50_000) -> DataFrame:
    """As filter_tree with patterns per repository."""
    rows = filter_tree(files)
    hidden = rule_verdicts(rows, rules, True, per_slice).filter("NOT negated").select("repo", "path")
    return rows.join(hidden, ["repo", "path"], "left_anti")


def filter_hard(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.filter(~(path.rlike(rf"(?s)(?:^|/)(?:{_named(HARD)})(?:/|$)") | base_name(path).isin(*META)))


def filter_tree(files: DataFrame, patterns: list[str] = ()) -> DataFrame:
    """The tree's rule: a name of the defaults, a meta-file or a pattern hides an entry,
    and a hidden directory hides all below it, without return."""
    rows = files.select("*", F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("entry__"))
    is_dir = F.col("entry__") != F.col("path")
    hit = base_name(F.col("entry__")).isin(*DEFAULTS, *META)
    if patterns:
        hit = hit | F.when(is_dir, ignored_by(F.concat("entry__", F.lit("/")), patterns)).otherwise(ignored_by(F.col("entry__"), patterns))
    hidden = rows.filter(hit).select("repo", "path").distinct()
    return files.join(hidden, ["repo", "path"], "left_anti")


def last_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn__", F.row_number().over(w)).filter("rn__ = 1").drop("rn__")
