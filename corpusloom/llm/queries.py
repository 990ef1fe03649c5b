"""The operators' queries over the given tables, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    byte_bpe, decontamination, filter_audit, line_dedup, merkle_manifest, mixing, ngram_join, pii, quality_crf, quality_rules, substring_dedup,
    url_filter, warc_fixity,
)
from .common import read_table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_fixity": lambda s, d: warc_fixity.audit_digest(read_table(s, d, "pages")),
        "op2_decontamination": lambda s, d: decontamination.find_leaks(_documents(s, d), read_table(s, d, "benchmark")),
        "op3_line_dedup": lambda s, d: line_dedup.line_dedup_digest(_documents(s, d)),
        "op4_quality_rules": lambda s, d: quality_rules.quality_digest(_documents(s, d)),
        "op5_mixing": lambda s, d: mixing.mix_digest(read_table(s, d, "documents", "doc_id", "source", "text")),
        "op6_substring_dedup": lambda s, d: substring_dedup.substring_digest(_documents(s, d)),
        "op7_pii": lambda s, d: pii.pii_digest(_documents(s, d)),
        "op8_quality_crf": lambda s, d: quality_crf.score_documents(_documents(s, d), read_table(s, d, "labels")),
        "op9_ngram_join": lambda s, d: ngram_join.ngram_join_digest(_documents(s, d)),
        "op10_url_filter": lambda s, d: url_filter.judge_urls(read_table(s, d, "pages")),
        "op11_byte_bpe": lambda s, d: byte_bpe.round_trip_digest(_documents(s, d)),
        "op12_filter_audit": lambda s, d: filter_audit.audit(read_table(s, d, "documents", "doc_id", "lang", "text"), read_table(s, d, "labels")),
        "op13_merkle_manifest": lambda s, d: merkle_manifest.manifest_digest(read_table(s, d, "documents")),
    }


#: Lines of at least 40 code points in five documents or more, kept in the largest.
LINE_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line
             FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.top IS NOT NULL AND k.doc_id <> r.top AS gone FROM k LEFT JOIN r USING (key)),
g AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM m WHERE gone),
u AS (SELECT doc_id, min(pos) AS first_pos, concat(CAST(min(pos) - 1 AS VARCHAR), ':', CAST(count(*) AS VARCHAR)) AS run FROM g GROUP BY doc_id, island),
v AS (SELECT doc_id, string_agg(run, ',' ORDER BY first_pos) AS runs FROM u GROUP BY doc_id)
SELECT m.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256, coalesce(any_value(v.runs), '') AS dropped_runs
FROM m LEFT JOIN v USING (doc_id) GROUP BY m.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": LINE_SQL,
        "op5_mixing": mixing.MIX_SQL.format(docs="documents"),
        "op10_url_filter": url_filter.URL_SQL,
        "op12_filter_audit": filter_audit.AUDIT_SQL,
        "op13_merkle_manifest": merkle_manifest.MANIFEST_SQL,
    }
