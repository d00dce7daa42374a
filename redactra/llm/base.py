"""Helpers shared by the operators: shared storage, Arrow passes, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

#: Rows of one Arrow batch: with very long texts a batch must still fit a worker.
ARROW_ROWS = 512
#: Entries of a worker's word caches; a full cache is emptied, which costs time but changes no result.
CACHE_WORDS = 400_000

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, as in local tests, a folder of our own that goes when
    the process ends; on a cluster, where no executor would see it, an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="redactra-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def clear_tables(spark: SparkSession) -> bool:
    """Removes the tables that operators left in the shared folder.  Results not yet read are lost with them:
    call it when a job's output is written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/redactra")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/redactra/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    Cuts the lineage so that a lost executor costs a re-read, not a recomputation
    of everything before.
    """
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(columns: list[str], names: list[str]) -> list[str]:
    """The columns that a result of these names does not replace."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Before a pass in Python: ship the package, and bound the rows of Arrow batches
    (Spark's default of 10,000 holds gigabytes of long texts).  The bound is a setting of the session, read when the
    lazy plan runs, and so it stays."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def release() -> None:
    """Gives back to the system what a finished pass no longer needs: a worker outlives its tasks,
    and would add what one pass freed to what the next one takes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def with_columns_of(
    df: DataFrame, column: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list]], keep: list[str] | None = None
) -> DataFrame:
    """The ``keep`` columns of ``df`` (default: all but those named like a field) and ``fields``, worked out from
    the texts of ``column``.

    ``make`` is called once a task and returns a function from a list of texts
    (nulls as empty texts) to a list of Arrow arrays, one for each field.
    """
    small_batches(df.sparkSession)
    keep = without(df.columns, [f.name for f in fields]) if keep is None else keep
    # the text rides along last under a name of its own, and is dropped unless kept
    source = df.select(*[named(c) for c in keep], F.coalesce(named(column).cast("string"), F.lit("")).alias("__text__"))
    schema = T.StructType([*source.schema.fields[:-1], *fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            arrays = work(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=names)
        del work
        release()

    return source.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hash of a word's bytes, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() splits at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split()


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of the splitmix generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for each run of ``size`` words; none if there are fewer words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * _ODD + hashes[i : i + n]
    return mixed(total)
