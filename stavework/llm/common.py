"""Helpers shared by the corpus operators: table access, lineage cuts, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python step works on at a time.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths that ``cut_table`` writes, if a step collects them.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def cut_folder(spark: SparkSession) -> None:
    """See that there is a checkpoint folder.

    It comes from ``spark.checkpoint.dir``. A session on this machine alone (a local test)
    gets a temporary folder without it; on a cluster, whose executors can't share one,
    that is an error.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stavework-checkpoint-"))


@contextmanager
def collected_tables() -> Iterator[list[str]]:
    """The paths of the tables that ``cut_table`` writes meanwhile; an outer collection gets them too."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield paths
    finally:
        _written.reset(token)
        if (outer := _written.get()) is not None:
            outer.extend(paths)


def drop_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables of ``cut_table`` that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches, cut so that ``column`` holds about CHUNK_BYTES in each.

    A single longer text stays whole, in a batch of its own.
    """
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null is empty."""
    at = batch.schema.get_field_index(column)
    return [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's decimal text is a multiple of five (a null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def cut_table(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the checkpoint folder and read again, its lineage cut.

    Unlike a checkpoint it can be deleted by its path (see ``collected_tables``).
    """
    cut_folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    if (paths := _written.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
