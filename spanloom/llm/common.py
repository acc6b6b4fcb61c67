"""What the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one for a local session without it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spanloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, so that its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores; a few large splits are dealt out by rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows that a Python worker of the pipeline holds at once, beside what Spark's own memory takes.
FEW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands Python at most FEW_ROWS rows at a time: whole texts and what is made of them are held for a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= FEW_ROWS:
        spark.conf.set(key, FEW_ROWS)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def by_text(kernel: Callable[[str | None], tuple], key: str, text: str, types) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function: (key, *kernel(text)) for each row of (key, text)."""
    import pyarrow as pa

    names = [n for n, _ in types]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kernel(t) for t in batch.column(text).to_pylist()]
            cols = [batch.column(key)] + [pa.array([r[i] for r in rows], type=t) for i, (_, t) in enumerate(types)]
            yield pa.RecordBatch.from_arrays(cols, names=[key, *names])

    return run
