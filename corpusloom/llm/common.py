"""Shared pieces of the training-data operators: word rules, row identity and
written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six blank characters that separate words, and the regular
#: expressions built from them.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RE = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: WeakKeyDictionary = WeakKeyDictionary()


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named table, only the columns asked for."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from
    ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests
    on one machine) a folder of our own is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-corpusloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again. This cuts
    the lineage: a lost executor costs the tasks that it ran, not the stages
    before, and the rows stay the same for every later use. The shuffle files of
    the write go when it has ended, since nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corpusloom/{label}-{uuid.uuid4().hex}"
    old = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if old is None else spark.conf.set(SHUFFLE_CLEANUP, old)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no later step reads."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def blank_trimmed(text: Column) -> Column:
    """Text without blanks at both ends; null stays null."""
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; none for a null text."""
    trimmed = blank_trimmed(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, BLANK_RE + "+")
    )


def word_count(text: Column) -> Column:
    trimmed = blank_trimmed(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", F.lit(0)).otherwise(
        F.size(F.split(trimmed, BLANK_RE + "+"))
    ).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, UPPER, LOWER)


def fingerprint(text: Column) -> Column:
    """64 bits of the text, which with ``doc_id`` identify a row; rows equal in
    both are copies of one row and get the same decisions."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def packed(docs: DataFrame, **extra: Column) -> DataFrame:
    """All columns of ``docs`` in one struct ``doc`` beside named working columns,
    so that extra columns of the caller never clash with those of an operator."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        *[c.alias(k) for k, c in extra.items()],
    )


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition on equal keys in which null equals null."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond
