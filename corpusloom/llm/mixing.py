"""Mixing sources to target weights by capped water-filling.

Targets: every source gets its share of the total by weight; sources above
``max_epochs`` times their own size are clamped there and the excess is shared
among the others by weight, again and again until no source is above its cap.
Only one row of sums reaches the driver per pass.

Sampling: a source with target ``r`` times its size takes each document
``floor(r)`` times, and a seeded random order of its documents fills up the
fraction: documents are taken once more until the running size comes nearest to
what is missing. The order is cut into buckets, so that a source that holds a
third of all rows is summed in parallel and only one bucket per source is sorted.

Only DataFrame functions run here. Defined results: a null text has size 0; a
null source is a source of its own and comes last in the order of weights; rows
that repeat a ``doc_id`` are documents of their own, those that are also equal in
source and text share one decision; with an empty table or without words every
target is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, word_count, written

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
BUCKET_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source (columns source, source_size, weight, cap, target). ``sizes`` has
    source and size; weights repeat over the sources in code point order, null last."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))  # one row per source
    k = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod(k, F.lit(len(weights))) + 1)
    src = written(
        per.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap")), "sources"
    )
    total = src.agg(F.sum("source_size")).first()[0] or 0
    num, den = total, src.agg(F.sum("weight")).first()[0] or 1
    while True:
        clamped = F.col("cap") * F.lit(den) < F.lit(num) * F.col("weight")
        row = src.agg(
            F.sum(F.when(clamped, F.col("cap"))).alias("c"), F.sum(F.when(~clamped, F.col("weight"))).alias("w")
        ).first()
        left, over = row["w"] or 0, total - (row["c"] or 0)
        if left == 0 or (over, left) == (num, den):
            break
        num, den = over, left
    level = F.col("weight") * F.lit(num).cast("double") / F.lit(den).cast("double")
    return src.select("source", "source_size", "weight", "cap", F.least(F.col("cap").cast("double"), level).alias("target"))


def _taken(rows: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """``rows`` (doc, doc_id, source, size, fp) with the source's columns and
    ``copies``, how often the mix takes the document."""
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    d = rows.join(F.broadcast(t) if _small(t) else t, rows["source"].eqNullSafe(t["t_source"])).select(
        *rows.columns, "source_size", "target", whole.cast("long").alias("whole"),
        (F.col("target") - whole * F.col("source_size")).alias("missing"),
        F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("u"),
    )
    d = d.withColumn("bucket", F.substring("u", 1, BUCKET_DIGITS))
    per_bucket = d.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.first("missing").alias("missing"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = per_bucket.select("source", "bucket", "n", "missing", F.sum("n").over(upto).alias("upto")).select(
        F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"),
        (F.col("upto") - F.col("n")).alias("before"),
        F.when(F.col("upto") <= F.col("missing"), "all")
        .when(F.col("upto") - F.col("n") >= F.col("missing"), "none")
        .otherwise("some").alias("fate"),
    )
    d = d.join(cut, d["source"].eqNullSafe(F.col("b_source")) & (d["bucket"] == F.col("b_bucket"))).drop("b_source", "b_bucket")
    sure = d.filter("fate <> 'some'").select(
        *rows.columns, "source_size", "target", (F.col("whole") + (F.col("fate") == "all").cast("long")).alias("copies")
    )
    # a range frame: rows that repeat a document are peers and get one decision
    run = Window.partitionBy("source").orderBy("u", "doc_id", "size", "fp").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = d.filter("fate = 'some'").withColumn("run", F.col("before") + F.sum("size").over(run)).select(
        *rows.columns, "source_size", "target",
        (F.col("whole") + (F.col("run") - F.col("size") / 2 < F.col("missing")).cast("long")).alias("copies"),
    )
    return sure.unionByName(edge)


#: Sources up to which their table is sent to all executors; beyond it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def _small(targets: DataFrame) -> bool:
    return targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("fp"))


def mix_digest(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    rows = written(_sized(docs), "sizes")
    out = _taken(rows, source_targets(rows), seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix: the documents taken at least once, all their columns, and size,
    source_size, target, copies and taken. Where ``docs`` has a column of such a name
    it stays, and the operator's own is called ``mix_size`` and so on."""
    rows = written(_sized(docs), "sizes")
    picks = _taken(rows, source_targets(rows, weights, max_epochs), seed).filter("copies > 0").distinct()
    full = packed(docs, k_id=F.col("doc_id"), k_source=F.col("source"), k_fp=F.xxhash64("text"))
    j = full.join(
        picks,
        F.col("k_id").eqNullSafe(F.col("doc_id")) & F.col("k_source").eqNullSafe(F.col("source")) & (F.col("k_fp") == F.col("fp")),
    )
    own = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": F.col("copies"), "taken": F.col("size") * F.col("copies")}

    def free(name: str) -> str:
        return free("mix_" + name) if name in docs.columns else name

    return j.select(*[F.col("doc")[c].alias(c) for c in docs.columns], *[c.alias(free(name)) for name, c in own.items()])


#: DuckDB SQL for the rows of mix_digest over a table ``{docs}``.
MIX_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
             md5(concat('mix-1:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS u FROM {docs}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
k AS (SELECT source, source_size, source_size * 3 AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS caps, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest,
        sum(source_size) OVER () AS total, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS n FROM k
      WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT caps, rest, total FROM o WHERE cap * rest >= (total - caps) * weight ORDER BY n LIMIT 1),
t AS (SELECT k.source, k.source_size, least(CAST(cap AS DOUBLE), weight * CAST(total - caps AS DOUBLE) / CAST(rest AS DOUBLE)) AS target FROM k, f),
m AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY substr(u, 1, 3)) AS upto,
        sum(size) OVER (PARTITION BY source, substr(u, 1, 3)) AS n,
        sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, size) AS run,
        target - whole * source_size AS missing FROM m)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN upto <= missing THEN 1 WHEN upto - n >= missing THEN 0 WHEN run - size / 2 < missing THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
