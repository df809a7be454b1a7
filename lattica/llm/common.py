"""Helpers shared by the corpus operators: shared checkpoints, Arrow batches, words of a text."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word pattern of every operator here, as Java and RE2 read it: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

#: bytes.translate table that lower-cases A-Z alone.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode; on a cluster an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of a batch that goes to a Python worker. A session's default would hold ten thousand texts at once.
BATCH_BYTES = 8 << 20


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches of about BATCH_BYTES (set for the session), and memory given back after each."""

    def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def trimmed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                release()

        return run(trimmed())

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(given_back, schema)


def release() -> None:
    """Give memory that nothing uses back to the system, as workers outlive their stage. Only a hint; without glibc, Arrow's alone."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


_KEPT: dict[Hashable, Any] = {}


def per_process(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` returned for ``key`` in this process. One thing is kept at a time, so a worker drops a former stage's tables."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def id_hash_mod(column: Column, modulus: int) -> Column:
    """CRC-32 of an id's decimal text, modulo ``modulus``: the fold of a document. A null id folds as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def unused(columns: list[str], *hints: str) -> list[str]:
    """Names like ``hints`` that no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for h in hints:
        while h.lower() in taken:
            h += "_"
        taken.add(h.lower())
        out.append(h)
    return out


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def long_parts(text: bytes, most: int = 4 << 20, at: bytes = b" \n\t\r\x0b\x0c") -> Iterator[bytes]:
    """A text in parts that begin with a character of ``at``, of about ``most`` bytes, so that memory doesn't follow the text."""
    low, marks = 0, [at[k : k + 1] for k in range(len(at))]
    while len(text) - low > most:
        high = max(text.rfind(c, low, low + most) for c in marks)
        if high <= low:
            high = min((x for c in marks if (x := text.find(c, low + most)) >= 0), default=len(text))
        yield text[low:high]
        low = high
    yield text[low:]


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch that hold about ``most`` bytes of ``text`` each, one row at least."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    bins, low = np.cumsum(sizes) // most, 0
    for high in [*(np.flatnonzero(np.diff(bins)) + 1).tolist(), batch.num_rows]:
        if high > low:
            yield batch.slice(low, high - low)
            low = high


def groups_in(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole groups out of batches sorted by ``keys``; a batch out holds every row of each of its groups.

    The rows of the last key of a batch wait for the next one, so that memory holds one batch and one group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table_ = pa.Table.from_batches([*held, batch]).combine_chunks()
        batch = table_.to_batches()[0] if table_.num_rows else batch
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            c = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= c[1:] != c[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        if last:
            yield batch.slice(0, last)
        held = [batch.slice(last)]
    if held:
        yield held[0]
