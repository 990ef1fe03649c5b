"""Merkle manifest of a dataset: a tree for each source over its rows, a tree over the
sources' roots, an inclusion proof for every row, and its verification.

Every node is labelled with the interval [lo, hi) of leaf ranks that it covers, so
that a node lies below another exactly if its interval lies inside the other's. The
tree is built level by level, each level a written table of a third of the rows of
the one below. Proofs are made from the top down: a join for each level, on source
and bucket (the rank by the width of the level above), with containment of the
intervals, attaches its parent to each node; the parent's interval without the
node's own, before and behind it, names the siblings. What a proof holds above a
node is thus made once for all leaves below it.

Ranks within a source are counted by range partitions and the sums of their sizes,
so that a source with a third of all rows is no group of its own. No text is
shuffled: leaves are hashed in the scan. The driver gets the size of the largest
source and the root.

Defined results: a null source is a source of its own, the first; rows come by
doc_id, null first, and rows that repeat a doc_id by their leaf; equal rows are
leaves of their own. An empty table has an empty result. Columns that aren't among
the five hashed ones aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 3


def leaf_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields, each '-' if null, else its length in bytes, ':' and itself."""
    told = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*[F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in told]), 256)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (grp and more) with lo, the rank in its group by ``order``, hi, one more,
    and n, the size of the group."""
    placed = written(
        rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id()), "placed"
    )
    part = F.shiftright("at", 33)
    counts = placed.groupBy("grp", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("k"))
    whole = Window.partitionBy("grp")  # one row for each range partition that holds the group
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("grp").alias("c_grp"), F.col("part").alias("c_part"), "first", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"), F.sum("k").over(whole).alias("n")
    )
    j = placed.join(counts, (F.col("grp") == F.col("c_grp")) & (part == F.col("c_part")))
    lo = F.col("before") + F.col("at") - F.col("first")
    out = written(j.select(*rows.columns, lo.alias("lo"), (lo + 1).alias("hi"), "n"), "ranked")
    release(placed)
    return out


def _is_root() -> Column:
    return F.col("hi") - F.col("lo") == F.col("n")


def tree_levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of the trees over ``leaves`` (grp, h, lo, hi, n), lowest first. Nodes of
    the upper levels have ``kids``, the hashes of their children, beside."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, width = [leaves], 1
    while width < most:
        above = width * fanout
        at = F.col("lo") % above / width
        run = levels[-1].filter(~_is_root()).groupBy("grp", (F.floor(F.col("lo") / above)).alias("bucket"), "n").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_compact(F.array(*[F.max(F.when(at == k, F.col("h"))) for k in range(fanout)])).alias("kids")
        )
        levels.append(written(run.select("grp", "lo", "hi", "n", "kids", F.sha2(F.array_join("kids", ""), 256).alias("h")), f"level-{len(levels)}"))
        width = above
    return levels


def subtree_roots(levels: list[DataFrame]) -> DataFrame:
    """(grp, h, level, node) of the node of each group that covers all its leaves; node has
    lo, hi, n and, above the leaves, kids."""
    out = None
    for k, level in enumerate(levels):
        kids = F.col("kids") if k else F.lit(None).cast("array<string>").alias("kids")
        own = level.filter(_is_root()).select("grp", "h", F.lit(k).alias("level"), F.struct("lo", "hi", "n", kids).alias("node"))
        out = own if out is None else out.unionByName(own)
    return out


#: Levels whose joins make one job; the lowest of them is written.
TOGETHER = 3


def proofs(levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The leaves of ``levels`` with subroot and proof, an array of (before, after): the
    joined hashes of the siblings on both sides, from the leaf up. ``tops`` (grp, level,
    subroot, node, proof) holds the root of each group and what stands above it."""
    above = None
    for k in range(len(levels) - 1, -1, -1):
        level, width = levels[k], fanout**k
        top = tops.filter(F.col("level") == k)
        if k:
            here = top.select("grp", "node.*", F.col("subroot").alias("h"), "subroot", "proof").select(*level.columns, "subroot", "proof")
        else:
            here = level.filter(_is_root()).join(top.select(F.col("grp").alias("t_grp"), "subroot", "proof"), F.col("grp") == F.col("t_grp")).drop("t_grp")
        if above is not None:
            p = above.select(
                F.col("grp").alias("p_grp"), F.floor(F.col("lo") / (width * fanout)).alias("p_bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"),
                F.col("kids").alias("p_kids"), "subroot", F.col("proof").alias("p_proof"),
            )
            inside = (F.col("lo") >= F.col("p_lo")) & (F.col("hi") <= F.col("p_hi"))
            j = level.filter(~_is_root()).join(p, (F.col("grp") == F.col("p_grp")) & (F.floor(F.col("lo") / (width * fanout)) == F.col("p_bucket")) & inside)
            # the parent's interval without the node's own: [p_lo, lo) and [hi, p_hi)
            n_before = ((F.col("lo") - F.col("p_lo")) / width).cast("int")
            n_after = F.ceil((F.col("p_hi") - F.col("hi")) / width).cast("int")
            step = F.struct(
                F.array_join(F.slice("p_kids", F.lit(1), n_before), "").alias("before"), F.array_join(F.slice("p_kids", n_before + 2, n_after), "").alias("after")
            )
            here = j.select(*level.columns, "subroot", F.concat(F.array(step), F.col("p_proof")).alias("proof")).unionByName(here)
        above = written(here, f"above-{k}") if k and k % TOGETHER == 0 else here
    return above


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""
    return F.aggregate(proof, leaf, lambda acc, x: F.sha2(F.concat(x["before"], acc, x["after"]), 256))


def proof_hash(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def inclusion_proofs(leaves: DataFrame) -> tuple[DataFrame, str | None]:
    """(rows, root) of ``leaves`` (source, h, the columns to order by first, then others):
    all its columns with subroot and proof, and the root over all sources."""
    grp = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    rows = ranked(leaves.withColumn("grp", grp).drop("source"), *[c for c in leaves.columns if c != "source"])
    levels = tree_levels(rows)
    roots = written(subtree_roots(levels), "subroots")
    sources = ranked(roots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "h", F.col("level").alias("own"), "node"), "source")
    upper = tree_levels(sources)
    root = upper[-1].filter(_is_root()).select("h").first()
    none = F.array().cast("array<struct<before:string,after:string>>")
    start = subtree_roots(upper).select("grp", "level", F.col("h").alias("subroot"), "node", none.alias("proof"))
    tops = proofs(upper, start).select(F.col("source").alias("grp"), F.col("own").alias("level"), F.col("h").alias("subroot"), "node", "proof")
    tops = written(tops, "tops")
    release(*upper, roots)
    return proofs(levels, tops), root[0] if root else None


def manifest_digest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every
    document. Where the CRC-32 of the decimal doc_id is even, the row is tampered with
    before it is verified: its text loses its line ends."""
    columns = {c: F.col(c) for c in FIELDS}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    cut = leaf_hash(columns | {"text": F.replace("text", F.lit("\n"), F.lit(""))})
    leaf = leaf_hash(columns)
    rows, root = inclusion_proofs(docs.select("doc_id", leaf.alias("h"), "source", F.when(hit & F.col("text").contains("\n"), cut).alias("cut")))
    top = F.lit(root).cast("string")
    out = rows.select(
        "doc_id", F.col("h").alias("leaf"), "subroot", top.alias("root"), proof_hash(F.col("proof")).alias("proof_sha256"),
        folded(F.coalesce("cut", "h"), F.col("proof")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes ``name`` (g, lvl, i, h, n) over ``leaves`` (g, i, h, n)."""
    return f"""{name} AS (SELECT g, 0 AS lvl, i, h, n FROM {leaves}
  UNION ALL SELECT g, lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, lvl, i // 3)"""


#: DuckDB SQL. CRC-32 is written out bit by bit; proofs and folds are recursions.
MANIFEST_SQL = f"""
WITH RECURSIVE f AS (SELECT doc_id, source, text, concat({', '.join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END" for c in FIELDS[:4])}) AS head,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)) + z)) AS crc FROM documents),
 e AS (SELECT doc_id, source, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 AND text IS NOT NULL THEN sha256(concat(head, strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), ''))) END AS cut FROM f),
 lf AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS g, leaf AS h, cut, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM e),
 {_tree_sql('t', 'lf')},
 sr AS MATERIALIZED (SELECT g AS src, '' AS g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
 {_tree_sql('u', 'sr')},
 node AS MATERIALIZED (SELECT g, lvl, i, h FROM t WHERE n > 1 UNION ALL SELECT '/', lvl, i, h FROM u WHERE n > 1),
 kids AS MATERIALIZED (SELECT g, lvl, i // 3 AS p, list(h ORDER BY i) AS hs FROM node GROUP BY g, lvl, i // 3),
 top AS MATERIALIZED (SELECT g, max(lvl) + 1 AS up FROM kids GROUP BY g),
 w AS (SELECT lf.g AS src, lf.i AS pos, '' AS sofar, coalesce(lf.cut, lf.h) AS acc, 0 AS lvl, lf.i AS i, lf.g AS g FROM lf
   UNION ALL SELECT w.src, w.pos, CASE WHEN k.hs IS NULL THEN w.sofar ELSE concat(w.sofar, array_to_string(k.hs[:w.i % 3], ''), array_to_string(k.hs[w.i % 3 + 2:], '')) END,
     CASE WHEN k.hs IS NULL THEN w.acc ELSE sha256(concat(array_to_string(k.hs[:w.i % 3], ''), w.acc, array_to_string(k.hs[w.i % 3 + 2:], ''))) END,
     CASE WHEN k.hs IS NULL THEN 0 ELSE w.lvl + 1 END, CASE WHEN k.hs IS NULL THEN s.i ELSE w.i // 3 END, CASE WHEN k.hs IS NULL THEN '/' ELSE w.g END
   FROM w LEFT JOIN kids k ON k.g = w.g AND k.lvl = w.lvl AND k.p = w.i // 3 JOIN sr s ON s.src = w.src WHERE k.hs IS NOT NULL OR w.g <> '/'),
 done AS (SELECT src, pos, sofar, acc FROM w LEFT JOIN top ON top.g = '/' WHERE w.g = '/' AND w.lvl = coalesce(top.up, 0)),
 root AS (SELECT h FROM u WHERE n = 1)
SELECT lf.doc_id, lf.h AS leaf, sr.h AS subroot, root.h AS root, sha256(done.sofar) AS proof_sha256, done.acc AS folded_root, done.acc = root.h AS verified
FROM lf JOIN sr ON sr.src = lf.g JOIN done ON done.src = lf.g AND done.pos = lf.i, root
"""
