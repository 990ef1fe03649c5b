"""Symbols, imports and snippets of Python sources."""

from __future__ import annotations

import ast
import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import lines
from ..schemas import CODE_NODES

MAX_LINES = 100
def _parsed(text: str) -> list[tuple[str, str, int, int]]:
    out = []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            out.append((kind, node.name, node.lineno, node.end_lineno, node.col_offset))
        elif isinstance(node, ast.Import):
            out += [("import", a.name, a.lineno, a.lineno, a.col_offset) for a in node.names if a.asname is None]
        elif isinstance(node, ast.ImportFrom) and not node.level and node.module != "__future__":
            out.append(("import", node.module, node.lineno, node.lineno, node.col_offset))
    return [x[:4] for x in sorted(out, key=lambda x: (x[2], x[4]))]


#: Lexical pieces of a source: strings (their ends are looked for apart), comments, line
#: ends, brackets, names, and single signs.
_PIECE = re.compile(
    r"""(?P<string>[rRbBuUfFtT]{0,2}(?:\"{3}|'{3}|[\"']))|(?P<comment>\#[^\n]*)|(?P<joined>\\\n)|(?P<end>\n)|(?P<open>[(\[{])|(?P<close>[)\]}])"""
    r"""|(?P<name>[^\W\d]\w*)|(?P<blank>[^\S\n]+)|(?P<sign>.)"""
)
_STARTS = re.compile(r"[ \t]*(?:async[ \t]+def|def|class|import|from|@|return|if|for|while|with|try)\b[ \t]*")
_BLOCK = {"if", "elif", "else", "for", "while", "try", "except", "finally", "with", "def", "class", "async", "match", "case"}


def _string_end(text: str, at: int, quote: str) -> int:
    """Position behind a string that begins before ``at``; one that is never closed ends
    with its line."""
    stop = len(text) if len(quote) == 3 else text.find("\n", at) % (len(text) + 1)
    while 0 <= (end := text.find(quote, at)):
        if len(quote) == 1 and end > stop:
            carried = text[stop - 1 : stop] == "\\" and stop < len(text)  # goes on in the next line
            if not carried:
                break
            stop = text.find("\n", stop + 1) % (len(text) + 1)
            continue
        k = end
        while text[k - 1 : k] == "\\" and k > at:
            k -= 1
        if (end - k) % 2 == 0:
            return end + len(quote)
        at = end + 1
    line = text.find("\n", at)
    return len(text) if line < 0 else line


def _statements(text: str) -> Iterator[tuple[int, list[tuple[str, int, int]], int, bool]]:
    """(indentation, pieces as (text, line, column), last line, first of its line) of every
    simple statement and block header. A bracket that is left open is given up where a
    line begins with a keyword no deeper than the statement."""
    tokens: list[tuple[str, int, int]] = []
    depth, line, begin, at, indent, last = 0, 1, 0, 0, 0, 1
    fresh = True

    def parts() -> Iterator[tuple[int, list[tuple[str, int, int]], int, bool]]:
        # cut at semicolons, and behind the colon of a block header
        level, lambdas, some, first = 0, 0, [], True
        for t in tokens:
            level += (t[0] in "([{") - (t[0] in ")]}") if len(t[0]) == 1 else 0
            lambdas += t[0] == "lambda" and level == 0
            if t[0] == ":" and level == 0 and lambdas:
                lambdas -= 1
            elif level == 0 and (t[0] == ";" or t[0] == ":" and some and some[0][0] in _BLOCK):
                yield indent, some, last, first
                some, first = [], False
                continue
            some.append(t)
        if some:
            yield indent, some, last, first

    while at < len(text):
        if fresh and depth and (m := _STARTS.match(text, at)) and len(m[0]) - len(m[0].lstrip()) <= indent:
            yield from parts()
            tokens, depth = [], 0
        m = _PIECE.match(text, at)
        kind, piece = m.lastgroup, m[0]
        fresh = False
        if kind == "string":
            end = _string_end(text, m.end(), piece.lstrip("rRbBuUfFtT"))
            if not tokens:
                indent = at - begin
            tokens.append(("''", line, at - begin))
            n = text.count("\n", at, end)
            line += n
            begin = text.rfind("\n", at, end) + 1 if n else begin
            last, at = line, end
            continue
        if kind in ("name", "sign", "open", "close"):
            if not tokens:
                indent = len(text[begin:at].expandtabs())
            tokens.append((piece, line, at - begin))
            depth = max(0, depth + (kind == "open") - (kind == "close"))
            last = line
        at = m.end()
        if kind in ("end", "joined"):
            line, begin = line + 1, at
            fresh = kind == "end"
            if kind == "end" and not depth and tokens:
                yield from parts()
                tokens = []
    if tokens:
        yield from parts()


def _scanned(text: str) -> list[tuple[str, str, int, int]]:
    """For files that don't parse: the same by indentation, so that what stands before and
    behind a broken place is found, with its nesting and last lines."""
    text = re.sub(r"\r\n?", "\n", text)
    found: list[list] = []
    still_open: list[tuple[int, int]] = []  # (indentation, place in found)
    for indent, tokens, last, first in _statements(text):
        words = [t[0] for t in tokens]
        if first:
            while still_open and still_open[-1][0] >= indent:
                still_open.pop()
        for _, k in still_open:
            found[k][3] = last
        k = 1 if words[0] == "async" else 0
        if words[k : k + 1] and words[k] in ("def", "class") and len(words) > k + 1 and words[k + 1].isidentifier():
            kind = "class" if words[k] == "class" else "function"
            found.append([kind, words[k + 1], tokens[0][1], last, tokens[0][2]])
            still_open.append((indent if first else indent + 1, len(found) - 1))
        elif words[0] == "import":
            for group in _split(tokens[1:], ","):
                name = "".join(t[0] for t in group)
                if group and re.fullmatch(r"[^\W\d]\w*(?:\.[^\W\d]\w*)*", name) and "as" not in [t[0] for t in group]:
                    found.append(["import", name, group[0][1], group[-1][1], group[0][2]])
        elif words[0] == "from" and "import" in words:
            group = tokens[1 : words.index("import")]
            name = "".join(t[0] for t in group)
            if group and name != "__future__" and re.fullmatch(r"[^\W\d]\w*(?:\.[^\W\d]\w*)*", name):
                found.append(["import", name, group[0][1], group[-1][1], tokens[0][2]])
    return [tuple(x[:4]) for x in sorted(found, key=lambda x: (x[2], x[4]))]


def _split(tokens: list, sign: str) -> Iterator[list]:
    some: list = []
    for t in tokens:
        if t[0] == sign:
            yield some
            some = []
        else:
            some.append(t)
    yield some


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for repo, path, text in zip(frame["repo"], frame["path"], frame["text"], strict=True):
            try:
                found, status = _parsed(text), "ok"
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                found, status = _scanned(text), "partial"
            rows += [(repo, path, *x, i, status) for i, x in enumerate(found)]
        yield pd.DataFrame(rows, columns=["repo", "path", "type", "name", "start_line", "end_line", "seq", "parse_status"])


#: Bytes of source that a task gets about, and how small a file is against a task's share
#: to be dealt by its hash.
TASK_BYTES, LIGHT = 32 << 20, 20


def deal_by_size(rows: DataFrame, size: Column, tasks: int | None = None) -> DataFrame:
    """``rows`` (repo, path and more) in tasks of about equal bytes. Files of more than a
    twentieth of a task's share, at most twenty for each task, are packed by the driver,
    the largest first, each into the task that has least; the others fill up what is left
    of each share, by a hash."""
    sized = rows.withColumn("size__", F.coalesce(size, F.lit(0)).cast("long"))
    total = sized.agg(F.sum("size__")).first()[0] or 0
    tasks = tasks or max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    share = max(1, total / tasks)
    heavy = sized.filter(F.col("size__") > share / LIGHT).select("repo", "path", "size__").collect()
    bins = [(0, k) for k in range(tasks)]
    placed = []
    for r in sorted(heavy, key=lambda r: (-r["size__"], r["repo"] or "", r["path"])):
        held, k = heapq.heappop(bins)
        heapq.heappush(bins, (held + r["size__"], k))
        placed.append((r["repo"], r["path"], k))
    # what is left of each share, as stretches of [0, 1)
    left = [max(0.0, share - held) for held, _ in sorted(bins, key=lambda b: b[1])]
    scale, upto, ends = sum(left) or 1.0, 0.0, []
    for x in left:
        upto += x / scale
        ends.append(upto)
    place = F.pmod(F.xxhash64("repo", "path"), F.lit(1 << 30)) / float(1 << 30)
    by_hash = F.least(F.size(F.filter(F.array(*[F.lit(x) for x in ends]), lambda x: x <= place)), F.lit(tasks - 1))
    table = rows.sparkSession.createDataFrame(placed, "repo string, path string, task__ int").withColumnsRenamed({"repo": "r__", "path": "p__"})
    j = sized.join(F.broadcast(table), F.col("repo").eqNullSafe(F.col("r__")) & (F.col("path") == F.col("p__")), "left")
    return j.withColumn("task__", F.coalesce("task__", by_hash)).repartitionById(tasks, F.col("task__")).select(*rows.columns)


def extract_symbols(texts: DataFrame, tasks: int | None = None) -> DataFrame:
    """Code nodes of rows (repo, path, text): functions and classes at any depth, plain
    imports; aliased and relative ones aren't taken. Files that fail to read are left
    out, those that fail to parse are scanned and marked partial. Only names ending in
    .py. Files are dealt to tasks by their bytes: by a column ``size`` if there is one,
    else by the texts' lengths, which reads these twice."""
    rows = texts.filter("path LIKE '%.py' AND text IS NOT NULL")
    size = F.col("size") if "size" in texts.columns else F.octet_length("text")
    rows = rows.select("repo", "path", "text", size.cast("long").alias("size"))
    return deal_by_size(rows, F.col("size"), tasks).drop("size").mapInPandas(_extract, CODE_NODES)


def definitions(code_nodes: DataFrame) -> DataFrame:
    return code_nodes.filter("type IN ('function', 'class')")


def imports(code_nodes: DataFrame) -> DataFrame:
    return code_nodes.filter("type = 'import'").select("repo", F.col("path").alias("src"), "name").distinct()


def _cut(all_lines: Column, start: Column, end: Column) -> Column:
    return F.slice(all_lines, F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0)))


def snippets(symbols: DataFrame, texts: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """``symbols`` (repo, node_id, path, start_line, end_line) with code: the lines of the
    definition, the first ``max_lines`` and a note if there are more; null if there are none."""
    t = texts.select("repo", "path", lines(F.col("text")).alias("all__"))
    j = symbols.join(t, ["repo", "path"], "left").withColumn(
        "cut__", F.when(F.col("start_line") <= F.col("end_line"), _cut(F.col("all__"), F.col("start_line"), F.col("end_line")))
    )
    n = F.size("cut__")
    more = F.concat(F.array_join(F.slice("cut__", 1, max_lines), "\n"), F.lit("\n... (truncated, "), (n - max_lines).cast("string"), F.lit(" more lines)"))
    code = F.when(n > max_lines, more).otherwise(F.array_join("cut__", "\n"))
    return j.withColumn("code", F.nullif(code, F.lit(""))).drop("all__", "cut__")


def code_rejects(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """(repo, node_id, reason): the symbols that ``numbered_code`` has no report of."""
    a, b = F.col("start_line"), F.col("end_line")
    reason = F.when(a.isNull() | b.isNull(), "no line range").when(a > b, "inverted line range").when(F.col("there__").isNull(), "no source")
    j = symbols.join(texts.select("repo", "path", F.lit(True).alias("there__")), ["repo", "path"], "left")
    return j.select("repo", "node_id", reason.alias("reason")).filter("reason IS NOT NULL")


def numbered_code(symbols: DataFrame, texts: DataFrame) -> DataFrame:
    """(repo, node_id, report): the code report of every symbol with a valid line range."""
    from ..functions.paths import fence

    t = texts.select("repo", "path", lines(F.col("text")).alias("all__"))
    j = symbols.filter("start_line <= end_line").join(t, ["repo", "path"])
    code = F.transform(_cut(F.col("all__"), F.col("start_line"), F.col("end_line")), lambda x, i: F.format_string("%4d | %s", F.col("start_line") + i, x))
    head = F.array(F.concat(F.lit("# "), "node_id", F.lit(" - Quellcode")), F.lit(""), F.concat(F.lit("```"), fence(F.col("path"))))
    foot = F.array(F.lit("```"), F.lit(""), F.concat(F.lit("Zeilen "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")))
    return j.select("repo", "node_id", F.array_join(F.concat(head, code, foot), "\n").alias("report"))
