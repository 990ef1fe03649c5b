"""A set of tables that changes batch by batch.

Every batch writes its new rows, and the units (a file, a directory, a node) whose
earlier rows it takes back, into folders of its own; one row in ``done`` makes it
count, written last. Of a table with a part column single parts of a unit can be taken
back (one import of a file), so that the others needn't be written again. A batch without that row is as if it had never begun, and one
that is applied again finds itself done. Rows are dealt into buckets by directory, as
partitions, so that a reader who knows the directories reads these buckets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import directory, file_of

_DONE = "batch long, base long, buckets int"
_GONE = "of string, repo string, unit string, part string"


class Versions:
    """``tables`` maps a table's name to (schema, unit column), ``parts`` to its part column.
    All have a column repo; ``append_only`` ones never take rows back."""

    def __init__(
        self, spark: SparkSession, folder: str, tables: dict[str, tuple[str, str]], append_only: tuple[str, ...] = (), buckets: int = 64, parts: dict[str, str] | None = None,
    ) -> None:
        self.spark, self.folder, self.tables, self.append_only, self.parts = spark, folder.rstrip("/"), tables, append_only, parts or {}
        self._new_buckets, self._known = buckets, None

    def bucket(self, unit: Column | str, repo: Column | str = "repo") -> Column:
        """The bucket of a path, or of a node of that path: files of a directory share one."""
        unit = F.col(unit) if isinstance(unit, str) else unit
        return F.pmod(F.xxhash64(repo, directory(file_of(unit))), F.lit(self.buckets())).cast("int")

    def buckets(self) -> int:
        """Fixed by the first batch."""
        rows = self._done()
        return rows[0]["buckets"] if rows else self._new_buckets

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def _done(self) -> list:
        """One row for each finished batch, oldest first; read once, as one writer at a time
        is all that the tables take."""
        if self._known is None:
            there = self._exists(f"{self.folder}/done")
            rows = self.spark.read.schema(_DONE).option("recursiveFileLookup", "true").json(f"{self.folder}/done").collect() if there else []
            self._known = sorted(rows, key=lambda r: r["batch"])
        return self._known

    def is_done(self, batch: int) -> bool:
        return any(r["batch"] == batch for r in self._done())

    def last(self) -> int | None:
        rows = self._done()
        return rows[-1]["batch"] if rows else None

    def _stored(self, table: str, schema: str, as_of: int | None, only: list[int] | None) -> DataFrame:
        done = [r for r in self._done() if as_of is None or r["batch"] <= as_of]
        wanted = [r["batch"] for r in done if r["batch"] >= done[-1]["base"]] if done else []
        paths = [p for b in wanted if self._exists(p := f"{self.folder}/{table}/batch={b}")]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, batch long, bucket int").filter(F.lit(False))  # known to be empty, so that joins with it go
        rows = self.spark.read.schema(f"{schema}, batch long, bucket int").option("basePath", f"{self.folder}/{table}").parquet(*paths)
        return rows if only is None else rows.filter(F.col("bucket").isin(only))

    def read(self, table: str, only: list[int] | None = None, as_of: int | None = None, like: DataFrame | None = None) -> DataFrame:
        """The rows of a table that no later batch took back, now or as of a batch;
        ``only``: those of some buckets; ``like``: those that equal a row of it in all its
        columns, which are found before what was taken back is looked for."""
        schema, unit = self.tables[table]
        rows = self._stored(table, schema, as_of, only)
        if like is not None:
            rows = rows.join(like.hint("shuffle_hash"), like.columns, "left_semi")
        if table not in self.append_only:
            gone = self._stored("gone", _GONE, as_of, only).filter(F.col("of") == table)
            last = gone.groupBy("repo", "unit", "part").agg(F.max("batch").alias("batch"))
            rows = self._without(rows, last, table)
        return rows.drop("batch", "bucket")

    def _without(self, rows: DataFrame, gone: DataFrame, table: str) -> DataFrame:
        """``rows`` but for those of the units, or the single parts of units, of ``gone`` (repo,
        unit, part); if it has a batch, for those of batches before that."""
        g = gone.select(*[F.col(c).alias(f"g_{c}") for c in gone.columns]).hint("shuffle_hash")  # units, few beside rows
        on = (F.col("repo") == F.col("g_repo")) & (F.col(self.tables[table][1]) == F.col("g_unit"))
        if "batch" in gone.columns:
            on = on & (F.col("batch") < F.col("g_batch"))
        if table in self.parts:
            on = on & (F.col("g_part").isNull() | (F.col(self.parts[table]) == F.col("g_part")))
        return rows.join(g, on, "left_anti")

    def only(self, rows: DataFrame, unit: str) -> list[int]:
        """The buckets of some units: at most as many numbers as there are buckets."""
        return [r[0] for r in rows.select(self.bucket(unit).alias("b")).distinct().collect()]

    def commit(self, batch: int, put: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None, whole: bool = False) -> bool:
        """Apply a batch: take back the units of ``gone`` (repo, unit; with a column part the
        single parts where it isn't null), then add ``put``.
        With ``whole`` the tables are written out as they are now, and earlier batches
        aren't read any more. False if the batch was applied before."""
        if self.is_done(batch):
            return False
        if (last := self.last()) is not None and batch < last:
            raise ValueError(f"batch {batch} comes after batch {last}")
        whole_unit = F.lit(None).cast("string").alias("part")
        gone = {k: v.select("repo", "unit", "part" if "part" in v.columns else whole_unit) for k, v in (gone or {}).items() if k not in self.append_only}
        if whole:
            put = {k: self._after(k, put.get(k), gone.get(k)) for k in self.tables}
            gone = {}
        for name, rows in put.items():
            schema, unit = self.tables[name]
            self._write(rows, name, batch, unit, schema)
        if gone:
            parts = [v.select(F.lit(k).alias("of"), "repo", "unit", "part") for k, v in gone.items()]
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            self._write(rows.distinct(), "gone", batch, "unit", _GONE)
        done = self._done()
        base = batch if whole or not done else done[-1]["base"]
        self.spark.createDataFrame([(batch, base, self.buckets())], _DONE).coalesce(1).write.mode("overwrite").json(f"{self.folder}/done/{batch}")
        self._known = None
        return True

    def _after(self, table: str, put: DataFrame | None, gone: DataFrame | None) -> DataFrame:
        rows = self.read(table)
        if gone is not None:
            rows = self._without(rows, gone.distinct(), table)
        rows = rows if put is None else rows.unionByName(put.select(*rows.columns))
        return rows.distinct() if table in self.append_only else rows

    def _write(self, rows: DataFrame, table: str, batch: int, unit: str, schema: str) -> None:
        cols = self.spark.createDataFrame([], schema).columns
        out = rows.select(*cols, self.bucket(unit).alias("bucket"))
        # a bucket's rows together, a large bucket over several tasks
        out.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{table}/batch={batch}")

    def vacuum(self) -> list[int]:
        """Delete the folders of batches that the newest whole one replaces; returns them."""
        done = self._done()
        old = [r["batch"] for r in done if r["batch"] < done[-1]["base"]] if done else []
        for b in old:
            for table in (*self.tables, "gone"):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/batch={b}")
                at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        return old

