"""Shared folder, safe texts and the limits of Python workers."""
from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and Spark runs in one process (tests), a folder is made and set once.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        folder = sc.getCheckpointDir()
        if folder is None:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="corpus-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, limit: int = 1 << 24) -> None:
    """Python workers get texts in batches of at most `limit` bytes (or one row) from now on in this session."""
    if int(spark.conf.get(BATCH).rstrip("bB")) > limit:
        spark.conf.set(BATCH, f"{limit}b")


_MEMORIES: dict[str, dict] = {}


def worker_memory(name: str) -> dict:
    """What a worker process remembers for one kind of work. Workers outlive tasks; taking up one kind forgets the others."""
    for other, kept in _MEMORIES.items():
        if other != name and kept:
            kept.clear()
    return _MEMORIES.setdefault(name, {})


def give_back() -> None:
    """What a worker process no longer uses goes back to the machine; workers outlive tasks and wait beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(run):
    """The task `run`, which gives back its memory when it ends."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return task


@contextmanager
def dropping_exchanges(spark: SparkSession):
    """What jobs in this block exchange is dropped from the executors' disks when each ends: nothing reads it later."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    with dropping_exchanges(df.sparkSession):
        return df.checkpoint()


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Written to the shared folder as Parquet and read again."""
    path = new_folder(df.sparkSession, name)
    with dropping_exchanges(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_of(column: str = "text") -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def chunks(texts: list, limit: int = 1 << 20):
    """Consecutive (start, stop) ranges of about `limit` characters; one long text is a range by itself."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
