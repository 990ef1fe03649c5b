"""How filters interact: what every filter removes at every place of every order.

One pass over the texts gives each document a mask with a bit for each filter that
it fails; documents are then counted by part and mask, which leaves at most 32
cells for a part. A recursive common table expression starts from the empty prefix
and extends each prefix with every letter that it doesn't hold yet: it joins the
part's cells, carries the bits that were applied, and emits the step's figures. An
order's figures at step k are those of its prefix of k letters, so 325 rows for a
part answer for its 600.

Only the digest of a text is shuffled, to find equal ones: grouped with partial
minima, then met by doc_id and digest, so that a text with very many copies is
spread by doc_id. Parts may be many; the recursion's limit on rows is lifted while
it runs, and its result is written.

Defined results: a null text is empty, a null part the empty string, which is one
part with the empty ones. Rows without doc_id have no smaller doc_id and are
nobody's; rows that repeat a doc_id are counted each, and equal texts of one
doc_id are no copies of each other. A document with several labels is good (or
toxic) if one of them says so. Empty tables give no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, words, written

LETTERS = "ABCDE"
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
MIN_WORDS = 200

#: The walk over the prefixes. ``cells`` has one row for a part, its cells in an array.
WALK = """
WITH RECURSIVE walk(part, prefix, applied, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, CAST('' AS STRING), 0, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM {cells}
  UNION ALL
  SELECT part, concat(prefix, letter), applied | bit, step + 1,
    aggregate(cells, CAST(0 AS BIGINT), (s, c) -> s + IF(c.mask & (applied | bit) = 0, c.n, 0)),
    aggregate(cells, CAST(0 AS BIGINT), (s, c) -> s + IF(c.mask & applied = 0 AND c.mask & bit <> 0, c.n, 0)),
    aggregate(cells, CAST(0 AS BIGINT), (s, c) -> s + IF(c.mask & applied <> 0 AND c.mask & bit <> 0, c.n, 0)),
    aggregate(cells, CAST(0 AS BIGINT), (s, c) -> s + IF(c.mask = bit, c.n, 0)),
    aggregate(cells, CAST(0 AS BIGINT), (s, c) -> s + IF(c.mask & applied = 0 AND c.mask & bit <> 0, c.good, 0)),
    aggregate(cells, CAST(0 AS BIGINT), (s, c) -> s + IF(c.mask & applied = 0 AND c.mask & bit <> 0, c.toxic, 0))
  FROM (SELECT w.part, w.prefix, w.applied, w.step, c.cells, explode(filter(c.letters, x -> w.applied & x.bit = 0)) AS next
        FROM walk w JOIN {cells} c ON w.part = c.part)
  LATERAL VIEW inline(array(next)) x AS letter, bit
)
SELECT * FROM walk WHERE step > 0
"""


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, fails, digest): the bits of the filters A to D that a document's
    text fails, and the text's digest."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), text.alias("text"), words(text).alias("w"))
    n = F.size("w")
    failed = [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct("w")).cast("long") < 50 * n.cast("long"),
        100 * F.char_length(F.regexp_replace("text", f"[^{UPPER}]+", "")).cast("long") > 3 * F.char_length("text").cast("long"),
        F.col("text").rlike("[#$%&*|]"),
    ]
    bits: Column = F.lit(0)
    for k, f in enumerate(failed):
        bits = bits + F.when(f, 1 << k).otherwise(0)
    return rows.select("doc_id", "part", bits.alias("fails"), F.unhex(F.sha2("text", 256)).alias("digest"))


def mask_cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail, E included."""
    rows = written(failures(docs, part), "failures")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("digest", "first_digest")
    told = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("l_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    j = rows.join(first, (F.col("doc_id") == F.col("first_id")) & (F.col("digest") == F.col("first_digest")), "left")
    copy = F.col("doc_id").isNotNull() & F.col("first_id").isNull()
    j = j.select("doc_id", "part", (F.col("fails") + F.when(copy, 1 << 4).otherwise(0)).alias("mask"))
    j = j.join(told, F.col("doc_id") == F.col("l_id"), "left")
    return j.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("toxic")
    )


def prefix_metrics(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The figures of every prefix of every order: part, prefix, applied, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost."""
    spark = cells.sparkSession
    alphabet = F.array(*[F.struct(F.lit(x).alias("letter"), F.lit(1 << k).alias("bit")) for k, x in enumerate(letters)])
    by_part = written(
        cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).withColumn("letters", alphabet), "cells"
    )
    old = spark.conf.get(ROW_LIMIT, None)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return written(spark.sql(WALK, cells=by_part), "prefixes")
    finally:
        spark.conf.unset(ROW_LIMIT) if old is None else spark.conf.set(ROW_LIMIT, old)


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row for each part, order of the five filters and step: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley."""
    by_prefix = prefix_metrics(mask_cells(docs, labels, part))
    # a prefix of k letters begins (5 - k)! of the orders
    weight = F.factorial(len(LETTERS) - F.col("step"))
    letter = F.substring("prefix", -1, 1)
    value = by_prefix.groupBy(F.col("part").alias("s_part"), letter.alias("s_letter")).agg(F.sum(F.col("removed") * weight).alias("shapley"))
    valued = by_prefix.join(value, (F.col("part") == F.col("s_part")) & (letter == F.col("s_letter")))
    orders = [("".join(p), k, "".join(p)[:k]) for p in permutations(LETTERS) for k in range(1, len(LETTERS) + 1)]
    steps = docs.sparkSession.createDataFrame(orders, "filter_order string, at_step int, of_prefix string")  # 600 rows, fixed
    return valued.join(F.broadcast(steps), F.col("prefix") == F.col("of_prefix")).select(
        "part", "filter_order", F.col("at_step").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


#: DuckDB SQL for the rows of ``audit`` by lang: orders first, then cells for each step.
AUDIT_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 lo AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
 lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
 m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
   CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
   + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
   + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > lo.least THEN 16 ELSE 0 END AS mask
   FROM d JOIN lo USING (t) LEFT JOIN lab ON lab.doc_id = d.doc_id),
 cell AS MATERIALIZED (SELECT part, mask, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM m GROUP BY part, mask),
 l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
 pre AS (SELECT '' AS p, 0 AS seen UNION ALL SELECT concat(p, c), seen + bit FROM pre JOIN l ON seen & bit = 0),
 ord AS (SELECT p AS filter_order FROM pre WHERE length(p) = 5),
 st AS (SELECT filter_order, CAST(k AS INT) AS step, pre.seen AS applied, l.bit FROM ord, range(1, 6) r(k), pre, l WHERE pre.p = filter_order[:k - 1] AND l.c = filter_order[k:k]),
 f AS (SELECT part, filter_order, step, bit, CAST(sum(CASE WHEN mask & (applied | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
   CAST(sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
   CAST(sum(CASE WHEN mask & applied <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
   CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
   CAST(sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN g ELSE 0 END) AS BIGINT) AS good_lost,
   CAST(sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN x ELSE 0 END) AS BIGINT) AS toxic_lost FROM st, cell GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM f
"""
