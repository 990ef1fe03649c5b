"""A code corpus as views over the given tables: the same SQL runs in Spark and DuckDB.
The tables hold no source code, so paths, imports, symbols and texts are derived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "c_files_raw": """SELECT p_partkey AS file_key,
 CASE WHEN p_partkey % 97 = 1 THEN '' WHEN p_partkey % 31 = 5 THEN concat('dist/b', substr(p_brand, 7)) WHEN p_partkey % 23 = 2 THEN concat('src/', lower(p_type))
 ELSE concat('src/', lower(p_type), '/b', substr(p_brand, 7)) END AS dir,
 CASE WHEN p_partkey % 50 = 0 THEN '__init__.py' WHEN p_partkey % 20 = 7 THEN concat('notes', CAST(p_partkey AS VARCHAR(20)), '.md')
 ELSE concat('m', CAST(p_partkey AS VARCHAR(20)), '.py') END AS base,
 CAST(p_size AS BIGINT) * 100 + p_partkey % 97 AS size FROM part""",
    "c_files": """SELECT '' AS repo, path, min(file_key) AS file_key, min(size) AS size FROM
 (SELECT CASE WHEN dir = '' THEN base ELSE concat(dir, '/', base) END AS path, file_key, size FROM c_files_raw) t GROUP BY path""",
    "c_imports": """SELECT DISTINCT '' AS repo, s.path AS src,
 CASE l.k WHEN 0 THEN regexp_replace(t.base, '[.]py$', '') WHEN 1 THEN replace(regexp_replace(t.tpath, '[.]py$', ''), '/', '.')
 WHEN 2 THEN replace(t.dir, '/', '.') WHEN 3 THEN concat('b', substr(t.p_brand, 7)) ELSE concat('lib', CAST(l.l_suppkey % 10 AS VARCHAR(20))) END AS name
 FROM (SELECT l_partkey, l_suppkey, l_linenumber % 5 AS k, l_orderkey % (SELECT count(*) FROM part) AS tkey FROM lineitem) l
 JOIN c_files s ON s.file_key = l.l_partkey
 JOIN (SELECT r.file_key, r.dir, r.base, p.p_brand, CASE WHEN r.dir = '' THEN r.base ELSE concat(r.dir, '/', r.base) END AS tpath FROM c_files_raw r JOIN part p ON p.p_partkey = r.file_key) t ON t.file_key = l.tkey
 WHERE s.path LIKE '%.py'""",
    "c_symbols": """SELECT '' AS repo, s.path, CASE WHEN l.l_suppkey % 4 = 0 THEN 'class' ELSE 'function' END AS type, concat('s', CAST(l.l_suppkey % 40 AS VARCHAR(20))) AS name,
 CAST(l.l_linenumber * 60 + l.l_orderkey % 50 AS INT) AS start_line, CAST(l.l_linenumber * 60 + l.l_orderkey % 50 + l.l_quantity AS INT) AS end_line
 FROM lineitem l JOIN c_files s ON s.file_key = l.l_partkey WHERE s.path LIKE '%.py'""",
    "c_content": """SELECT '' AS repo, concat(source, '/', lang, '/d', CAST(doc_id AS VARCHAR(20)), '.py') AS path, text, doc_id FROM documents""",
    "c_feed": """SELECT event_id, ts, concat(CASE event_type WHEN 'click' THEN 'M' WHEN 'view' THEN 'A' WHEN 'error' THEN 'D' WHEN 'signup' THEN 'R100' ELSE 'T' END, chr(9), 'src/u', CAST(user_id AS VARCHAR(20)), '.py',
 CASE WHEN event_type = 'signup' AND event_id % 10 <> 0 THEN concat(chr(9), 'src/r', CAST(event_id AS VARCHAR(20)), '.py') ELSE '' END) AS line FROM events""",
}
TABLES = {
    "c_files_raw": ["part"], "c_files": ["part"], "c_imports": ["part", "lineitem"], "c_symbols": ["part", "lineitem"],
    "c_content": ["documents"], "c_feed": ["events"],
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A corpus view as a DataFrame."""
    needed = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    ctes = [f"{v} AS ({q})" for v, q in VIEWS.items() if set(TABLES[v]) <= set(needed) and v != name]
    sql = f"WITH {', '.join(ctes)} {VIEWS[name]}" if ctes else VIEWS[name]
    for t in needed:
        sql = sql.replace(f" {t})", f" {{{t}}})").replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
        sql = sql[: -len(t)] + f"{{{t}}}" if sql.endswith(f"FROM {t}") else sql
    return spark.sql(sql, **needed)


def ctes(*names: str) -> str:
    """The views as DuckDB CTEs, with all that they rest on."""
    need = {n for n in names} | ({"c_files_raw", "c_files"} if {"c_files", "c_imports", "c_symbols"} & set(names) else set())
    return ", ".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in need)
