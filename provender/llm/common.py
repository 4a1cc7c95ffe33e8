"""What the operators share: tables in the shared folder and bounded batches of texts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker handles at once (one longer text is a chunk of its own).
CHUNK_CHARS = 1_000_000
#: Characters after which a worker gives back the memory that its arrays left.
RELEASE_CHARS = 2_000_000
#: Bytes of rows that Spark sends to a worker at once: the JVM and the worker both hold some such batches for each task.
BATCH_BYTES = 4 << 20
#: Rows of keys and facts that are sent to all executors; beyond, both sides are exchanged.
BROADCAST_ROWS = 1_000_000
#: Rows of a key from which it is hot.
HOT = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a local one is made only where none is set and the session is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='provender-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_MADE: set[str] = set()


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder for a table that goes with this process, if nothing removes it before."""
    if not _MADE:
        atexit.register(_remove_all)
    _MADE.add(path := f"{shared_dir(spark)}/provender-{what}-{uuid.uuid4().hex}")
    return path


def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_MADE) if spark else ():
        with contextlib.suppress(Exception):  # the session may be ending
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder, by whatever file system holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _MADE.discard(path)


class Stored:
    """A written table: lineage ends here, so a lost executor costs no earlier stage."""

    def __init__(self, df: DataFrame, what: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, what)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        self.df._stored_at = self.path

    def drop(self) -> None:
        remove(self.spark, self.path)


def stored(df: DataFrame, what: str) -> DataFrame:
    return Stored(df, what).df


def made() -> set[str]:
    """The tables that this process has in the shared folder."""
    return set(_MADE)


def remove_made_since(spark: SparkSession, before: set[str], *keep: DataFrame) -> None:
    """Deletes the tables made since then, but for those that stored() returned as one of `keep`: they are read later."""
    for path in made() - before - {df._stored_at for df in keep}:
        remove(spark, path)


def few(rows: DataFrame, most: int | None = None) -> bool:
    """Whether there are at most BROADCAST_ROWS rows: so many may be sent to all executors."""
    most = BROADCAST_ROWS if most is None else most
    return rows.limit(most + 1).count() <= most


def meet(rows: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with facts (a written table with a column `size`, the rows of each key): those of hot keys, if these can be named, stay where they are."""
    hot = facts.filter(F.col("size") >= HOT)
    if hot.isEmpty() or not few(hot):
        return rows.join(facts, on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(facts.filter(F.col("size") < HOT), on)
    return rest.union(rows.join(F.broadcast(hot), on).select(*rest.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow, by batches of BATCH_BYTES where the session sets no size of its own (Spark's is 64 MB or 10,000 rows)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives freed memory back: a worker lives on after its task, and would keep the most that any task had, beside the JVM's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (null: empty), each of about `limit` characters, however the batches were cut."""
    done = 0
    try:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            size = 0
            start = 0
            texts: list[str] = []
            for i, value in enumerate(batch.column(at)):
                text = value.as_py() or ""
                if texts and size + len(text) > limit:
                    yield batch.slice(start, i - start), texts
                    done += size
                    start, size, texts = i, 0, []
                    if done > RELEASE_CHARS:
                        release()
                        done = 0
                texts.append(text)
                size += len(text)
            if texts:
                yield batch.slice(start, len(texts)), texts
                done += size
    finally:
        release()
