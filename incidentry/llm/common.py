"""Helpers of the operators here: words as bytes, batches to Python, written tables, checked broadcasts."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentry.plans.catalog import scratch

# Bytes of a byte-wise translation: A-Z to a-z, and whatever is no word character to a blank.
# Word characters are 0-9, a-z and every byte of a code point beyond 0x7F.
PLAIN_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
# ASCII letters in lower case, nothing else changed.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: A side is broadcast when it is measured to hold at most so many bytes, else the join shuffles.
BROADCAST_BYTES = 32 * 1024 * 1024


def plain_words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8. Null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN_WORDS).split()


def blank_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``bytes.split`` cuts at just these six bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(LOWER) if lower else raw).split()


def sha256(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def _worker_home() -> types.ModuleType:
    return sys.modules.setdefault("_incidentry_worker_store", types.ModuleType("_incidentry_worker_store"))


def worker_store(name: str, make: Callable[[], object], large: bool = False) -> object:
    """A value that one Python worker makes once and keeps over its tasks. ``large``: until another operator's."""
    home = _worker_home()
    if not hasattr(home, name):
        setattr(home, name, make())
    if large:
        home.__dict__.setdefault("_large", {})[name] = _stage()
    return getattr(home, name)


def _stage() -> int | None:
    here = TaskContext.get()
    return here and here.stageId()


def let_go_large() -> None:
    """Large stores of other stages are dropped: a worker outlives the operator that filled them."""
    home = _worker_home()
    held, now = home.__dict__.get("_large", {}), _stage()
    for name in [n for n, stage in held.items() if stage != now]:
        del held[name]
        delattr(home, name)


def arrow_schema(schema: str):
    """The Arrow schema of a DDL string; made on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def row_map(df: DataFrame, f: Callable[..., tuple], schema: str, columns: list[str], rows: int = 500) -> DataFrame:
    """``f(*values)`` for each row of ``columns``; it returns one tuple of ``schema``. No shuffle.

    Arrow carries the batches; a batch is worked on in slices, so few results are held at once.
    """
    import pyarrow as pa

    target = arrow_schema(schema)

    def run(batches: Iterator["pa.RecordBatch"]) -> Iterator["pa.RecordBatch"]:
        let_go_large()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = [f(*values) for values in zip(*(part.column(i).to_pylist() for i in range(len(columns))))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col, t.type) for col, t in zip(zip(*out), target)], schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder; later steps read the copy.

    The shuffle files behind it are let go once it is written: a lost executor rereads the table.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a small table that one task works on at least.
ROWS_A_TASK = 20_000


def in_few_tasks(df: DataFrame, rows: int, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """``df``, made of ``rows`` rows, in a task for every ``rows_a_task`` of them, one for each core at least.

    A small table is else written as one file for each shuffle partition. Large ones keep their partitions.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_a_task)))


def small(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is measured to hold at most ``limit`` bytes at ``bytes_per_row``, its fixed row width."""
    most = limit // bytes_per_row
    return df.limit(most + 1).count() <= most


def checked_broadcast(df: DataFrame, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint for a side measured to be small; any other size is left to a shuffled join."""
    return F.broadcast(df) if small(df, bytes_per_row, limit) else df


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(*(columns or ("doc_id", "text")))
