"""Shared pieces of the training-data operators: scratch tables, Arrow batches, word splitting."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters outside this class (space and the ASCII controls 9 to 13).
BLANK = r"\x20\x09-\x0D"

#: Rows and bytes of texts that Python code takes up at a time.
SLICE_ROWS, SLICE_BYTES = 256, 8_000_000
#: Bytes of an Arrow batch while an operator runs its own jobs.
BATCH_BYTES = 2_000_000

_LOCAL: dict[str, str] = {}
_MADE = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    Without that setting a local session (unit tests) gets a temporary folder; on a cluster, where
    each executor would write to a disk of its own, it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL.setdefault("root", "file://" + tempfile.mkdtemp(prefix="quill-"))
    path = f"{root.rstrip('/')}/quill-{uuid.uuid4().hex}-{name}"
    for made in getattr(_MADE, "scopes", []):
        made.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, whatever store it lies in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch_scope(spark: SparkSession, keep: list[str]) -> Iterator[None]:
    """Delete at its end the scratch folders made inside, but for those in ``keep`` by then."""
    scopes = _MADE.__dict__.setdefault("scopes", [])
    made: list[str] = []
    scopes.append(made)
    try:
        yield
    finally:
        scopes.remove(made)
        for path in made:
            if path not in keep:
                delete(spark, path)


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write once as Parquet in the shared folder and read back.

    Cuts the lineage with a copy that outlives any executor, and keeps column pruning
    for the readers, which a checkpointed RDD would lose. ``rows`` is the number of rows, or a bound of it,
    of a table of pairs and ids: a task writes up to half a million of them, so that iterations leave few
    files while the tables are small, and no task grows with them.
    """
    spark = df.sparkSession
    if rows is not None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(-(-partitions // 16), -(-rows // 500_000))
        if tasks < partitions:
            df = df.coalesce(tasks)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of materialised tables that no plan reads any more."""
    for t in tables:
        if getattr(t, "scratch", None):
            delete(t.sparkSession, t.scratch)


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """While an operator runs its own jobs, Arrow batches hold at most ``size`` bytes; then the caller's
    setting is back. Plans that run later have the caller's bound (64 MB by default)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``SLICE_ROWS`` rows and about ``SLICE_BYTES`` bytes at most, so that
    what Python makes of them at a time is bounded by bytes (and by the longest text)."""
    for b in batches:
        step = max(1, min(SLICE_ROWS, SLICE_BYTES * b.num_rows // max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words as long; null counts as none."""
    return F.coalesce(F.expr("cast(0 as bigint)") + F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0).cast("long"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator is about to add, whatever their case."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rows_under(docs: DataFrame, name: str, *columns: Column) -> DataFrame:
    """``columns`` and beside them the whole row as one struct ``name``, so that no column of ``docs``
    clashes with those of an operator."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name))
