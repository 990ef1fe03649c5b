"""Column functions on paths, node ids and lines. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The line ends that Python's splitlines() knows.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# Languages by suffix and names of code fences.
LANGUAGES = {".py": "python"}
FENCES = {"py": "python", "js": "javascript", "ts": "typescript"}


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Path without its last part; '' at the root."""
    return F.left(path, F.char_length(path) - F.char_length(base_name(path)) - 1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def ancestors(path: Column) -> Column:
    """All directories above a path, outermost first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(
        n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    ).otherwise(F.array().cast("array<string>"))


def suffix(path: Column) -> Column:
    """Last extension with its dot, '' if there is none (a leading dot is a name)."""
    return F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def language(path: Column) -> Column:
    s = F.lower(suffix(path))
    out = F.lit(None).cast("string")
    for k, v in LANGUAGES.items():
        out = F.when(s == k, v).otherwise(out)
    return out


def fence(path: Column) -> Column:
    s = F.ltrim(suffix(path), F.lit("."))
    out = s
    for k, v in FENCES.items():
        out = F.when(s == k, v).otherwise(out)
    return out


def file_of(node_id: Column) -> Column:
    return F.substring_index(node_id, "::", 1)


def parent_package(node_id: Column) -> Column:
    """Directory of the file that a node belongs to; null at the root."""
    return F.nullif(directory(file_of(node_id)), F.lit(""))


def lines(text: Column) -> Column:
    """Lines as splitlines() gives them: no empty last line, none for an empty text."""
    parts = F.split(text, LINE_END)
    n = F.size(parts)
    return F.when(text == "", F.array().cast("array<string>")).when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), n - 1)
    ).otherwise(parts)
