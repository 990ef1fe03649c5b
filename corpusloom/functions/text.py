"""Cleaning of model output and rendering of conversations, as built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The blanks that Python's strip() and ``\s`` know, as a class for Java's expressions
#: and for those of DuckDB.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACE_RE2 = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same as a string.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
STRICT = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false"}


def stripped(text: Column) -> Column:
    """Without blanks of any script at both ends. Only the ends are looked at: an expression
    for the last blanks tries each run of blanks again from every place in it."""
    return F.btrim(text, F.lit(BLANKS))


def clean_patterns(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, pattern): the lines of a model's answer that look like ignore
    patterns. Fences, blanks and comments go, list marks are stripped, prose (spaces
    without a slash, star or leading dot) is dropped."""
    lines = df.select(key, F.posexplode(F.split(stripped(F.coalesce(text, F.lit(""))), "\n")).alias("pos", "raw"))
    kept = lines.select(key, "pos", stripped(F.col("raw")).alias("raw")).filter("raw <> '' AND NOT startswith(raw, '```') AND NOT startswith(raw, '#')")
    # The list marks.
    bare = F.regexp_replace(F.regexp_replace("raw", rf"^[-*](?:{SPACE}+|$)", ""), rf"^\p{{Nd}}+\.(?:{SPACE}+|$)", "")
    out = kept.select(key, "pos", stripped(bare).alias("pattern"))
    p = F.col("pattern")
    return out.filter((p != "") & (p.contains("/") | p.contains("*") | p.startswith(".") | ~p.contains(" ")))


def transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, transcript) of rows (conv_id, turn, role, text), in order of turns."""
    part = F.concat(F.lit("["), F.upper(F.coalesce("role", F.lit(""))), F.lit("]\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), part.alias("part"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n").alias("transcript"))


def json_in(text: Column, opening: str, closing: str) -> Column:
    """The greedy stretch from the first ``opening`` to the last ``closing``."""
    return F.nullif(F.regexp_extract(text, rf"(?s)\{opening}.*\{closing}", 0), F.lit(""))


def parse_actions(df: DataFrame, text: str) -> DataFrame:
    """``df`` with action (its name, null if rejected) and payload (the JSON object)."""
    kind = "map<string,string>"
    whole = F.when(F.col(text).rlike(r"^\s*\{"), F.from_json(text, kind, STRICT))
    part = json_in(F.col(text), "{", "}")
    ok = F.coalesce(F.element_at(whole, "action"), F.lit(None))
    inner = F.when(F.try_parse_json(text).isNull(), F.element_at(F.from_json(part, kind, STRICT), "action"))
    return df.withColumn("action", F.coalesce(ok, inner)).withColumn(
        "payload", F.when(ok.isNotNull(), F.col(text)).when(inner.isNotNull(), part)
    )
