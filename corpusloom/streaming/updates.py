"""Name-status lines as a stream of changes, applied batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import extract, incremental
from ..operators.changes import parse_feed
from ..sources.files import decoded
from ..sources.versions import Versions


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text files as they arrive, as changes (path, status)."""
    return parse_feed(spark.readStream.text(folder).select(F.col("value").alias("line")))


def apply_changes(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """``apply(changes, batch id)`` for each micro-batch; one query per target keeps the
    updates in order, and a batch that comes again overwrites what it wrote."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, k: apply(df.distinct(), k))
    return (w.trigger(availableNow=True) if once else w).start()


def apply_batch(tables: Versions, batch: int, changes: DataFrame, read: Callable[[DataFrame], DataFrame], cut: incremental.Cut, whole_every: int = 0) -> dict[str, int] | None:
    """One batch of changes (repo, path, status) from content to tables. ``read`` gives the
    content (repo, path, content) of those paths that exist now, null where it can't be
    read: such files, and those that don't parse, keep their file node. Every
    ``whole_every`` batches the tables are written out whole."""
    if tables.is_done(batch):
        return None
    changes = cut(changes.select("repo", "path", "status").distinct(), "changes")
    content = cut(read(changes.select("repo", "path").distinct()), "content")
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    live = content.select("repo", "path", size.alias("size"), F.expr("octet_length(content) div 4").alias("token_est"), F.sha2("content", 256).alias("sha256"))
    found = cut(extract.extract_symbols(decoded(content)), "found")
    whole = bool(whole_every) and batch % whole_every == 0
    return incremental.update(tables, batch, changes, live, extract.definitions(found), extract.imports(found), cut, whole)


def update_stream(lines: DataFrame, tables: Versions, read: Callable[[DataFrame], DataFrame], checkpoint: str, cut: incremental.Cut, repo: str = "", once: bool = True, whole_every: int = 0) -> StreamingQuery:
    """Keep the tables of a graph up to date with a stream of changes (path, status), such
    as ``change_stream`` gives. Batch k of the stream is batch k + 1 of the tables (0 is
    the full build): after a failure Spark hands the same batch over again, and one that
    was applied is passed over. One query for each set of tables keeps updates in order."""

    def apply(rows: DataFrame, k: int) -> None:
        apply_batch(tables, k + 1, rows.select(F.lit(repo).alias("repo"), "path", "status"), read, cut, whole_every)

    return apply_changes(lines, apply, checkpoint, once)
