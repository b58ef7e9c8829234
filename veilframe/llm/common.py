"""What several operators share: the staging folder, words, hashes, byte blocks."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

# A word, and one character between words.
WORD = "[^\\x20\\x09-\\x0D]+"
BLANK = "[\\x20\\x09-\\x0D]"

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The application's folder under ``spark.checkpoint.dir``, dropped when the driver ends.

    The setting is read from the session; only on a local master (tests) may it be unset.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = shared_dir(spark)
    return _folders[app]


def staged(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a reused Python worker remembers between tasks, by operator, and how to drop it.
REMEMBERED: dict[str, Callable[[], None]] = {}
_now = [""]
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def enter(name: str) -> None:
    """Called as a task begins: a worker holds the memory of one operator at a time.

    What the one before has freed goes back to the system, for the worker may live on
    through all stages next to the executor's heap.
    """
    if _now[0] != name:
        for other, drop in REMEMBERED.items():
            if other != name:
                drop()
        _now[0] = name
        gc.collect()
        give_back()


def give_back() -> None:
    """What this worker has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, after which the worker holds no memory that it has freed.

    A stage with two Python steps leaves more workers than cores, and those wait, as large
    as they were, next to the workers of the stages that follow.
    """

    def inner(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return inner


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of equal stretches."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return starts, np.diff(np.append(starts, len(sorted_keys)))


def spans_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every stretch, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before - starts, lengths)
