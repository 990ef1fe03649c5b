"""DuckDB SQL of the queries that build texts: reports, trees, prompts and summaries.
Each is put behind the registry's common table expressions (``imp``, ``sym``, ``pkg``...)."""

from __future__ import annotations

_NL = "chr(10)"
# The headings of the reports below, as operators/report.py has them.


def _section(title: str, items: str) -> str:
    return f"CASE WHEN {items} IS NOT NULL THEN concat('{title}', {_NL}, {_NL}, {items}, {_NL}) END"


def _io(title: str, out: str, inn: str) -> str:
    both = f"concat_ws({_NL}, CASE WHEN {out} IS NOT NULL THEN concat('- Importiert: ', {out}) END, CASE WHEN {inn} IS NOT NULL THEN concat('- Wird importiert von: ', {inn}) END)"
    return _section(title, f"nullif({both}, '')")


#: The enriched graph, and the children of each node as one text.
_TOLD = f""", told AS (SELECT *, CASE WHEN start_line % 3 = 0 THEN concat('about ', name) END AS summary, start_line % 6 = 0 AS risky FROM sym),
 node AS MATERIALIZED (SELECT path AS node_id, 'file' AS type, path AS name, 1 AS rank, 0 AS at, NULL AS summary, false AS risky FROM c_files
   UNION ALL SELECT node_id, type, name, 2, start_line, summary, risky FROM told UNION ALL SELECT node_id, 'package', name, 0, 0, NULL, false FROM pkg
   UNION ALL SELECT 'project::corpus', 'project', 'corpus', 2, 0, NULL, false UNION ALL SELECT DISTINCT dst, 'external_module', name, 2, 0, NULL, false FROM res WHERE strategy = 5),
 tree AS MATERIALIZED (SELECT src, dst FROM con UNION ALL SELECT src, dst FROM pcon),
 kid AS MATERIALIZED (SELECT t.src AS node_id, string_agg(concat('- **', n.name, '**', CASE WHEN n.summary <> '' THEN concat(' - ', n.summary) ELSE '' END), {_NL} ORDER BY n.rank, n.at, n.name, n.node_id) AS kids
   FROM tree t JOIN node n ON n.node_id = t.dst GROUP BY t.src)"""

_SRC, _DST = (f"CASE WHEN {c} LIKE '%/%' THEN regexp_replace({c}, '/[^/]*$', '') END" for c in ("src", "dst"))
_BASE = "regexp_extract({}, '[^/]*$')"

_OVERVIEW = _TOLD + f""", pair AS (SELECT DISTINCT concat('- ', a, ' importiert ', b) AS h FROM (SELECT {_SRC} AS a, {_DST} AS b FROM imp) WHERE a <> b),
 hint AS (SELECT string_agg(h, {_NL} ORDER BY h) AS hints FROM pair)
SELECT concat_ws({_NL}, concat('# corpus', {_NL}), {_section('## Hauptbereiche:', 'kids')}, {_section('## Architektur-Hinweise:', 'hints')}) AS report
 FROM node LEFT JOIN kid USING (node_id) CROSS JOIN hint WHERE type = 'project'"""

_OVERVIEW_PARTS = _TOLD + f""", pair AS (SELECT DISTINCT concat('- ', a, ' importiert ', b) AS h FROM (SELECT {_SRC} AS a, {_DST} AS b FROM imp) WHERE a <> b),
 item AS (SELECT 1 AS section, row_number() OVER (ORDER BY n.rank, n.at, n.name, n.node_id) - 1 AS k, concat('- **', n.name, '**', CASE WHEN n.summary <> '' THEN concat(' - ', n.summary) ELSE '' END) AS x
   FROM tree t JOIN node n ON n.node_id = t.dst WHERE t.src = 'project::corpus' UNION ALL SELECT 2, row_number() OVER (ORDER BY h) - 1, h FROM pair),
 cnt AS (SELECT *, count(*) OVER (PARTITION BY section) AS n FROM item)
SELECT section, k // 50 AS part, concat(CASE WHEN k // 50 > 0 THEN {_NL} WHEN section = 1 THEN concat({_NL}, '## Hauptbereiche:', {_NL}, {_NL}) ELSE concat({_NL}, '## Architektur-Hinweise:', {_NL}, {_NL}) END,
   string_agg(x, {_NL} ORDER BY k), CASE WHEN max(k) + 1 = any_value(n) THEN {_NL} ELSE '' END) AS text FROM cnt GROUP BY section, k // 50
UNION ALL SELECT 0, 0, concat('# corpus', {_NL})"""

_PACKAGES = _TOLD + f""", j AS (SELECT i.src, i.dst, a.parent AS ps, b.parent AS pd FROM imp i LEFT JOIN inpkg a ON a.child = i.src LEFT JOIN inpkg b ON b.child = i.dst),
 inn AS (SELECT DISTINCT ps AS node_id, concat('- ', {_BASE.format('src')}, ' importiert ', {_BASE.format('dst')}) AS x FROM j WHERE ps = pd),
 inner_ AS (SELECT node_id, string_agg(x, {_NL} ORDER BY x) AS inside FROM inn GROUP BY node_id),
 outs AS (SELECT node_id, string_agg(x, ', ' ORDER BY x) AS outgoing FROM (SELECT DISTINCT ps AS node_id, dst AS x FROM j WHERE ps IS NOT NULL AND ps IS DISTINCT FROM pd) GROUP BY node_id),
 ins AS (SELECT node_id, string_agg(x, ', ' ORDER BY x) AS incoming FROM (SELECT DISTINCT pd AS node_id, src AS x FROM j WHERE pd IS NOT NULL AND ps IS DISTINCT FROM pd) GROUP BY node_id)
SELECT node_id, concat_ws({_NL}, concat('# ', node_id, '/', {_NL}), {_section('## Module:', 'kids')}, {_section('## Interne Struktur:', 'inside')},
 {_io('## Externe Schnittstellen:', 'outgoing', 'incoming')}) AS report
 FROM pkg LEFT JOIN kid USING (node_id) LEFT JOIN inner_ USING (node_id) LEFT JOIN outs USING (node_id) LEFT JOIN ins USING (node_id)"""

_MODULES = _TOLD + f""", outs AS (SELECT src AS node_id, string_agg(dst, ', ' ORDER BY dst) AS outgoing FROM imp GROUP BY src),
 ins AS (SELECT node_id, string_agg(x, ', ' ORDER BY x) AS incoming FROM (SELECT dst AS node_id, concat(src, ' (1x)') AS x FROM imp) GROUP BY node_id)
SELECT node_id, concat_ws({_NL}, concat('# ', node_id, {_NL}), {_section('## Enthält:', 'kids')}, {_io('## Abhängigkeiten:', 'outgoing', 'incoming')}) AS report
 FROM node LEFT JOIN kid USING (node_id) LEFT JOIN outs USING (node_id) LEFT JOIN ins USING (node_id) WHERE type = 'file'"""

_SYMBOLS = _TOLD + f""", caller AS (SELECT dst AS path, string_agg(concat('- ', src), {_NL} ORDER BY src) AS callers FROM imp GROUP BY dst)
SELECT node_id, concat_ws({_NL}, concat('# ', node_id, {_NL}),
 concat('## Signatur:', {_NL}, {_NL}, CASE WHEN type = 'function' THEN concat('def ', name, '(...)') ELSE concat('class ', name, ':') END, {_NL}),
 {_section('## Verhalten:', 'summary')}, {_section('## Aufrufer:', 'callers')}, CASE WHEN risky THEN concat('## Risiken:', {_NL}, {_NL}, '- long', {_NL}, '- untested', {_NL}) END) AS report
 FROM told LEFT JOIN caller USING (path)"""

_FULL = _TOLD + """, e AS (SELECT src, dst, 'IMPORTS' AS r FROM imp UNION ALL SELECT src, dst, 'CONTAINS' FROM tree),
 outs AS (SELECT src AS node_id, string_agg(concat(r, ' ', dst), '; ' ORDER BY concat(r, ' ', dst)) AS out_edges FROM e GROUP BY src),
 ins AS (SELECT dst AS node_id, string_agg(concat(r, ' ', src), '; ' ORDER BY concat(r, ' ', src)) AS in_edges FROM e GROUP BY dst)
SELECT node_id, type, coalesce(summary, '') AS summary, CASE WHEN risky THEN 'long; untested' ELSE '' END AS risks, coalesce(out_edges, '') AS out_edges, coalesce(in_edges, '') AS in_edges
 FROM node LEFT JOIN outs USING (node_id) LEFT JOIN ins USING (node_id)"""

#: Paths have at most three directories, so three steps up reach the project.
def _roll(word: str) -> str:
    out = f""", f AS (SELECT path AS id, string_agg(concat(node_id, ': ', {word}, name), '; ' ORDER BY node_id) AS s FROM sym WHERE start_line % 3 = 0 GROUP BY path)"""
    for level, below in ((3, "f"), (2, "k3"), (1, "k2"), (0, "k1")):
        parent = f"JOIN pkg k ON k.node_id = p.src AND k.level = {level}" if level else "AND p.src = 'project::corpus'"
        out += f""", p{level} AS (SELECT p.src AS id, string_agg(concat(c.id, ': ', c.s), '; ' ORDER BY c.id) AS s FROM pcon p JOIN {below} c ON c.id = p.dst {parent} GROUP BY p.src),
 k{level} AS (SELECT id, s FROM f UNION ALL SELECT id, s FROM p{level})"""
    return out + f""" SELECT id AS node_id, sha256(s) AS digest FROM (SELECT id, s FROM p2 UNION ALL SELECT id, s FROM p1 UNION ALL SELECT id, s FROM p0
 UNION ALL SELECT id, s FROM f WHERE id NOT LIKE '%/%/%' UNION ALL SELECT node_id, concat({word}, name) FROM sym WHERE start_line % 3 = 0 AND path NOT LIKE '%/%')"""


def _counted() -> str:
    """The model that counts children, and fails for ids of some lengths."""
    out = """, f AS (SELECT path AS id, count(*) AS n FROM sym WHERE start_line % 3 = 0 AND length(path) % 7 <> 3 GROUP BY path)"""
    for level, below in ((3, "f"), (2, "k3"), (1, "k2"), (0, "k1")):
        parent = f"JOIN pkg k ON k.node_id = p.src AND k.level = {level}" if level else "AND p.src = 'project::corpus'"
        out += f""", p{level} AS (SELECT p.src AS id, count(*) AS n FROM pcon p JOIN {below} c ON c.id = p.dst {parent} WHERE length(p.src) % 7 <> 3 GROUP BY p.src),
 k{level} AS (SELECT id, n FROM f UNION ALL SELECT id, n FROM p{level})"""
    return out + " SELECT id AS node_id, concat(n, ' parts') AS summary FROM (SELECT * FROM f UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p0)"


_PROMPTS = f""", b AS (SELECT *, row_number() OVER (ORDER BY node_id) - 1 AS n FROM pend)
SELECT n // 10 AS batch, concat_ws({_NL}, concat('Analyze these code elements:', {_NL}),
 string_agg(concat('### ', n % 10 + 1, '. ', node_id, {_NL}, '- type: ', type, {_NL}, '- name: ', name, {_NL}, '- lines: ', start_line, '-', end_line, {_NL}), {_NL} ORDER BY n),
 'Return JSON array: [{{"node_id": "...", "summary": "...", "risks": ["..."]}}]') AS prompt FROM b GROUP BY n // 10"""

#: Imports before and after the changes; ``res2`` is what a full build afterwards has.
_STATES = """, bef AS (SELECT path FROM c_files WHERE path NOT IN (SELECT path FROM chg WHERE status = 'A')), live AS (SELECT path FROM c_files WHERE path NOT IN (SELECT path FROM chg WHERE status = 'D')),
 h1 AS (SELECT c.src, c.name, arg_min(c.path, c.prio) AS path FROM cand c JOIN bef f ON f.path = c.path GROUP BY c.src, c.name),
 h2 AS (SELECT c.src, c.name, arg_min(c.path, c.prio) AS path FROM cand c JOIN live f ON f.path = c.path GROUP BY c.src, c.name),
 old AS (SELECT DISTINCT i.src, coalesce(h1.path, concat('external::', i.name)) AS dst FROM c_imports i LEFT JOIN h1 ON h1.src = i.src AND h1.name = i.name WHERE i.src NOT IN (SELECT path FROM chg)),
 was AS (SELECT DISTINCT coalesce(h1.path, concat('external::', i.name)) AS dst FROM c_imports i JOIN bef ON bef.path = i.src LEFT JOIN h1 ON h1.src = i.src AND h1.name = i.name),
 res2 AS MATERIALIZED (SELECT DISTINCT i.src, coalesce(h2.path, concat('external::', i.name)) AS dst FROM c_imports i JOIN live ON live.path = i.src LEFT JOIN h2 ON h2.src = i.src AND h2.name = i.name),
 edited AS (SELECT res2.src, res2.dst FROM res2 JOIN chg ON chg.path = res2.src),
 plain AS (SELECT path AS node_id, 'file' AS type, '' AS name FROM live UNION ALL SELECT node_id, type, name FROM sym WHERE path IN (SELECT path FROM live))
"""
_UPDATED = _STATES + """SELECT src, dst, 'IMPORTS' AS relationship FROM old WHERE dst NOT IN (SELECT path FROM chg WHERE status IN ('D', 'M'))
UNION ALL SELECT src, dst, 'IMPORTS' FROM edited UNION ALL SELECT src, dst, 'CONTAINS' FROM con WHERE src IN (SELECT path FROM live)"""
_OUTSIDE = "SELECT * FROM plain UNION ALL SELECT dst, 'external_module', substr(dst, 11) FROM (SELECT dst FROM {0}) WHERE starts_with(dst, 'external::')"
_UPDATED_NODES = _STATES + _OUTSIDE.format("was UNION SELECT dst FROM edited")
_REPAIRED_NODES = _STATES + _OUTSIDE.format("(SELECT DISTINCT dst FROM res2)")
_COUNTS = """, am AS (SELECT path FROM chg WHERE status <> 'D') SELECT (SELECT count(*) FROM chg WHERE status <> 'A') AS removed,
 (SELECT count(*) FROM am) + (SELECT count(*) FROM c_symbols WHERE path IN (SELECT path FROM am)) AS added, (SELECT count(*) FROM c_imports WHERE src IN (SELECT path FROM am)) AS imports"""
_VERSIONED = _STATES + """, sp AS (SELECT path, string_split(path, '/') AS p FROM live),
 dirs AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS dir, i FROM (SELECT p, unnest(range(1, len(p))) AS i FROM sp)),
 child AS (SELECT dir AS id FROM dirs UNION ALL SELECT path FROM live)
SELECT 'node' AS kind, path AS a, 'file' AS b, CAST(len(p) AS VARCHAR) AS c FROM sp
UNION ALL SELECT 'node', node_id, type, CAST(len(string_split(path, '/')) + 1 AS VARCHAR) FROM sym WHERE path IN (SELECT path FROM live)
UNION ALL SELECT 'node', dst, 'external_module', '-' FROM (SELECT DISTINCT dst FROM res2) WHERE starts_with(dst, 'external::')
UNION ALL SELECT 'node', dir, 'package', CAST(i AS VARCHAR) FROM dirs UNION ALL SELECT 'node', 'project::corpus', 'project', '0'
UNION ALL SELECT 'edge', src, dst, 'IMPORTS' FROM res2 UNION ALL SELECT 'edge', src, dst, 'CONTAINS' FROM con WHERE src IN (SELECT path FROM live)
UNION ALL SELECT 'edge', CASE WHEN id LIKE '%/%' THEN regexp_replace(id, '/[^/]*$', '') ELSE 'project::corpus' END, id, 'CONTAINS' FROM child
UNION ALL SELECT 'hash', path, sha256(path), '' FROM live"""

#: The lines of the tree of each repository; ``{repo}`` tells a file's.
_TREE = """, own AS (SELECT {repo} AS repo, path FROM c_files), sp AS (SELECT repo, path, string_split(path, '/') AS p FROM own),
 ent AS (SELECT repo, path, false AS is_dir FROM own UNION ALL SELECT DISTINCT repo, array_to_string(p[1:i], '/'), true FROM (SELECT repo, p, unnest(range(1, len(p))) AS i FROM sp)),
 e2 AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, string_split(path, '/') AS p FROM ent),
 e3 AS (SELECT *, lead(path) OVER (PARTITION BY repo, dir ORDER BY lower(name), name) IS NULL AS last FROM e2),
 above AS (SELECT repo, path, i, array_to_string(p[1:i], '/') AS up FROM (SELECT repo, path, p, unnest(range(1, len(p))) AS i FROM e3)),
 pre AS (SELECT a.repo, a.path, string_agg(CASE WHEN d.last THEN '    ' ELSE '│   ' END, '' ORDER BY a.i) AS prefix FROM above a JOIN e3 d ON d.repo = a.repo AND d.path = a.up GROUP BY a.repo, a.path),
 tl AS (SELECT e.repo, e.path, e.is_dir, list_transform(e.p, lambda x: {{'l': lower(x), 'n': x}}) AS k,
   concat(coalesce(prefix, ''), CASE WHEN last THEN '└── ' ELSE '├── ' END, name, CASE WHEN is_dir THEN '/' ELSE '' END) AS line FROM e3 e LEFT JOIN pre USING (repo, path))"""
_LINES = _TREE.format(repo="''") + " SELECT path, line FROM tl"
_TREES = _TREE.format(repo="concat('r', file_key // 1000)") + f""", t AS (SELECT repo, concat('corpus/', {_NL}, string_agg(line, {_NL} ORDER BY k)) AS tree,
   count(*) FILTER (WHERE NOT is_dir) AS total_files, count(*) FILTER (WHERE is_dir) AS total_folders FROM tl GROUP BY repo)
SELECT repo, total_files, total_folders, CAST(floor(length(tree) / 3.5) AS BIGINT) AS estimated_tokens, sha256(tree) AS digest FROM t"""


_EDGE_PARTS = """, e AS (SELECT src, dst, 'IMPORTS' AS r FROM imp UNION ALL SELECT src, dst, 'CONTAINS' FROM con UNION ALL SELECT src, dst, 'CONTAINS' FROM pcon),
 b AS (SELECT src AS node_id, 'out' AS direction, concat(r, ' ', dst) AS x FROM e UNION ALL SELECT dst, 'in', concat(r, ' ', src) FROM e),
 n AS (SELECT *, row_number() OVER (PARTITION BY node_id, direction ORDER BY x) - 1 AS k FROM b)
SELECT node_id, direction, k // 50 AS part, concat(CASE WHEN k // 50 > 0 THEN '; ' ELSE '' END, string_agg(x, '; ' ORDER BY k)) AS edges FROM n GROUP BY node_id, direction, k // 50"""

_MODULE_PARTS = _TOLD + f""", item AS (SELECT c.src AS node_id, 1 AS section, row_number() OVER (PARTITION BY c.src ORDER BY n.at, n.name, n.node_id) - 1 AS k, {_NL} AS sep,
   concat('- **', n.name, '**', CASE WHEN n.summary <> '' THEN concat(' - ', n.summary) ELSE '' END) AS x FROM con c JOIN node n ON n.node_id = c.dst
  UNION ALL SELECT src, 2, row_number() OVER (PARTITION BY src ORDER BY dst) - 1, ', ', dst FROM imp
  UNION ALL SELECT dst, 3, row_number() OVER (PARTITION BY dst ORDER BY src) - 1, ', ', concat(src, ' (1x)') FROM imp WHERE dst IN (SELECT path FROM c_files)),
 cnt AS (SELECT *, count(*) OVER (PARTITION BY node_id, section) AS n FROM item),
 pt AS (SELECT node_id, section, k // 50 AS part, concat(CASE WHEN k // 50 > 0 THEN any_value(sep) ELSE '' END, CASE WHEN section = 1 THEN string_agg(x, {_NL} ORDER BY k) ELSE string_agg(x, ', ' ORDER BY k) END) AS t, max(k) + 1 = any_value(n) AS last FROM cnt GROUP BY node_id, section, k // 50),
 o AS (SELECT DISTINCT src FROM imp), i AS (SELECT DISTINCT dst FROM imp)
SELECT pt.node_id, section, part, concat(CASE WHEN part > 0 THEN '' WHEN section = 1 THEN concat({_NL}, '## Enthält:', {_NL}, {_NL}) WHEN section = 2 THEN concat({_NL}, '## Abhängigkeiten:', {_NL}, {_NL}, '- Importiert: ')
   WHEN o.src IS NOT NULL THEN concat({_NL}, '- Wird importiert von: ') ELSE concat({_NL}, '## Abhängigkeiten:', {_NL}, {_NL}, '- Wird importiert von: ') END, t,
   CASE WHEN last AND NOT (section = 2 AND i.dst IS NOT NULL) THEN {_NL} ELSE '' END) AS text
 FROM pt LEFT JOIN o ON o.src = pt.node_id LEFT JOIN i ON i.dst = pt.node_id
UNION ALL SELECT path, 0, 0, concat('# ', path, {_NL}) FROM c_files"""

#: The graphs of repositories of a thousand files each.
_MANY = """, own AS (SELECT path, size, concat('r', file_key // 1000) AS repo FROM c_files),
 mcand AS (SELECT o.repo, c.* FROM cand c JOIN own o ON o.path = c.src),
 mhit AS (SELECT c.repo, c.src, c.name, arg_min(c.path, c.prio) AS path FROM mcand c JOIN own f ON f.path = c.path AND f.repo = c.repo GROUP BY c.repo, c.src, c.name),
 mimp AS (SELECT DISTINCT o.repo, i.src, coalesce(h.path, concat('external::', i.name)) AS dst FROM c_imports i JOIN own o ON o.path = i.src LEFT JOIN mhit h ON h.src = i.src AND h.name = i.name AND h.repo = o.repo),
 msp AS (SELECT repo, path, size, string_split(path, '/') AS p FROM own),
 mdir AS (SELECT DISTINCT repo, array_to_string(p[1:i], '/') AS dir, i FROM (SELECT repo, p, unnest(range(1, len(p))) AS i FROM msp)),
 mkid AS (SELECT repo, dir AS id FROM mdir UNION ALL SELECT repo, path FROM own),
 mnode AS (SELECT repo, path AS id, concat('file - - ', len(p), ' ', size) AS x FROM msp
   UNION ALL SELECT o.repo, node_id, concat(type, ' ', CASE WHEN start_line % 3 = 0 THEN concat('about ', name) ELSE '-' END, ' ', CASE WHEN start_line % 6 = 0 THEN 'long,untested' ELSE '-' END, ' ', len(string_split(sym.path, '/')) + 1, ' -') FROM sym JOIN own o ON o.path = sym.path
   UNION ALL SELECT DISTINCT repo, dst, 'external_module - - - -' FROM mimp WHERE starts_with(dst, 'external::')
   UNION ALL SELECT repo, dir, concat('package - - ', i, ' -') FROM mdir UNION ALL SELECT DISTINCT repo, 'project::corpus', 'project - - 0 -' FROM own),
 medge AS (SELECT repo, src, concat(dst, ' IMPORTS') AS x FROM mimp UNION ALL SELECT o.repo, con.src, concat(con.dst, ' CONTAINS') FROM con JOIN own o ON o.path = con.src
   UNION ALL SELECT repo, CASE WHEN id LIKE '%/%' THEN regexp_replace(id, '/[^/]*$', '') ELSE 'project::corpus' END, concat(id, ' CONTAINS') FROM mkid)"""


def _roll_by_repo() -> str:
    out = _MANY + """, mtree AS (SELECT repo, CASE WHEN id LIKE '%/%' THEN regexp_replace(id, '/[^/]*$', '') ELSE 'project::corpus' END AS src, id FROM mkid),
 f AS (SELECT o.repo, o.path AS id, string_agg(concat(node_id, ': about ', name), '; ' ORDER BY node_id) AS s FROM sym JOIN own o ON o.path = sym.path WHERE start_line % 3 = 0 GROUP BY o.repo, o.path)"""
    for level, below in ((3, "f"), (2, "k3"), (1, "k2"), (0, "k1")):
        parent = f"JOIN mdir k ON k.repo = p.repo AND k.dir = p.src AND k.i = {level}" if level else "AND p.src = 'project::corpus'"
        out += f""", p{level} AS (SELECT p.repo, p.src AS id, string_agg(concat(c.id, ': ', c.s), '; ' ORDER BY c.id) AS s FROM mtree p JOIN {below} c ON c.repo = p.repo AND c.id = p.id {parent} GROUP BY p.repo, p.src),
 k{level} AS (SELECT * FROM f UNION ALL SELECT * FROM p{level})"""
    return out + """ SELECT repo, id AS node_id, sha256(s) AS digest FROM (SELECT * FROM p2 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p0 UNION ALL SELECT * FROM f WHERE id NOT LIKE '%/%/%'
 UNION ALL SELECT o.repo, node_id, concat('about ', name) FROM sym JOIN own o ON o.path = sym.path WHERE start_line % 3 = 0 AND o.path NOT LIKE '%/%')"""


_ROUND_TRIP = _MANY + """ SELECT repo, 'node' AS kind, id AS a, x AS b FROM mnode UNION ALL SELECT repo, 'edge', src, x FROM medge
 UNION ALL SELECT repo, 'hash', path, concat(sha256(repo), ' 2024-01-01T00:00:00 ', sha256(path)) FROM own"""
_DOCUMENTS = _MANY + """ SELECT repo, part, count(*) AS lines FROM (SELECT repo, 1 AS part FROM mnode UNION ALL SELECT repo, 3 FROM medge UNION ALL SELECT repo, 5 FROM own
 UNION ALL SELECT repo, unnest([0, 2, 4, 6]) FROM (SELECT DISTINCT repo FROM own)) GROUP BY repo, part"""


def report_sql() -> dict[str, str]:
    return {
        "d10_updated_edges": _UPDATED, "d10_updated_nodes": _UPDATED_NODES, "d10_repaired_nodes": _REPAIRED_NODES, "d10_counts": _COUNTS, "s1_versioned_graph": _VERSIONED,
        "e5_roll_up": _roll("'about '"), "e5_roll_up_again": _roll("CASE WHEN start_line % 30 = 3 THEN 'again ' ELSE 'about ' END"), "e5_model_roll_up": _counted(), "e5_roll_up_by_repo": _roll_by_repo(),
        "g4_edge_parts": _EDGE_PARTS, "r2_module_parts": _MODULE_PARTS, "a3_a4_round_trip": _ROUND_TRIP, "a3_a4_graph_documents": _DOCUMENTS,
        "g1_tree": _LINES, "g1_tree_report": _TREES, "g4_full_report": _FULL, "j1_prompts": _PROMPTS,
        "r0_overview": _OVERVIEW, "r0_overview_parts": _OVERVIEW_PARTS, "r1_packages": _PACKAGES, "r2_modules": _MODULES, "r3_symbols": _SYMBOLS,
    }
