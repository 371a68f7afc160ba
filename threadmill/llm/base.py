"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import sys
import time
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

#: Words of a text: maximal runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read from there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_alone(df: DataFrame) -> DataFrame:
    """Like ``stored``; the shuffle files that led there go as soon as it is written.

    The setting holds for the one plan that is made here, and is put back.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    conf = df.sparkSession.conf
    old = conf.get(key)
    conf.set(key, "true")
    try:
        own = df.select("*")
    finally:
        conf.set(key, old)
    return stored(own)


#: Rows of slim tables (ids, numbers) that make one task.
TASK_ROWS = 25_000


def counted(df: DataFrame, rows: int | None = None, what: Column | None = None) -> tuple[DataFrame, int]:
    """``stored`` and, counted while it is written, its rows (or those for which ``what`` holds).

    ``rows``: the most rows of few bytes that ``df`` can have, where that is known:
    it is then written by as many tasks as they need.
    """
    seen = Observation()
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // TASK_ROWS)))
    out = stored(df.observe(seen, F.count(F.lit(1) if what is None else F.when(what, 1)).alias("n")))
    return out, seen.get["n"]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    root = checkpoint_root(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of one batch inside ``small_batches``; a batch ends with the row that reaches them.
SMALL_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256):
    """Actions inside hand ``rows`` rows, or SMALL_BYTES, at a time to Python, for rows that are large.

    The session's settings are put back afterwards.
    """
    inside = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows,
              "spark.sql.execution.arrow.maxBytesPerBatch": SMALL_BYTES}
    old = {key: spark.conf.get(key) for key in inside}
    for key, value in inside.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of phases that nothing refers to any more.

    Spark's cleaner follows the garbage collections of the driver; a phase
    whose result is stored no longer needs its shuffle files.  The last query
    is still referred to until another one has run, and the files of what one
    collection finds go a moment later.
    """
    spark.range(1).count()
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def trim() -> None:
    """Give memory that this Python worker no longer uses back to the system: idle workers stay alive."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def _kept() -> dict:
    return sys.__dict__.setdefault("_threadmill_kept", {})


def forget(but: str | None = None) -> None:
    """Drop what this Python worker keeps for other operators than ``but``: idle workers are used again."""
    kept = _kept()
    others = [g for g in kept if g != but]
    for g in others:
        del kept[g]
    if others:
        gc.collect()
        trim()


def per_worker(name: str, make, group: str | None = None):
    """A value made once per Python worker and kept between its tasks, until another operator's tasks come.

    Functions are pickled by value, so their module's globals live for one
    task only; ``sys`` is the worker's own.  ``group`` names the operator whose
    values stay together.
    """
    group = group or name
    forget(group)
    kept = _kept().setdefault(group, {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


#: Rows of a slice of a batch that becomes Python objects at once.
SLICE_ROWS = 256


def arrow_columns(df: DataFrame, fields: list, source: str, make, keep: bool = True, rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with the columns ``fields``, the arrays that ``make`` returns for a slice of ``rows`` rows of column ``source``.

    Other columns pass through; those named like a new one are replaced, and
    ``source`` goes as well where ``keep`` is false.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    new = [f.name for f in fields]
    kept = [c for c in df.columns if c not in new or c == source]
    out = [c for c in kept if c not in new and (keep or c != source)]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                made = make(batch.column(kept.index(source)))
                yield pa.RecordBatch.from_arrays([batch.column(kept.index(c)) for c in out] + made, [*out, *new])
        trim()

    return df.select(*kept).mapInArrow(run, T.StructType([df.schema[c] for c in out] + fields))


def packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length in one compressed value.

    Each column's bytes are laid out plane by plane (all first bytes, all second
    bytes, ...), so small numbers and runs cost next to nothing.
    """
    import zstandard
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T) for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The columns of a packed value, of the given kinds."""
    import zstandard
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(sizes), [], 0
    for k, size in zip(kinds, sizes):
        column = np.empty((n, size), np.uint8)
        for i, plane in enumerate(raw[at:at + n * size].reshape(size, n)):
            column[:, i] = plane
        out.append(column.view(k).ravel())
        at += n * size
    return out


def stored_compact(df: DataFrame) -> DataFrame:
    """Like ``stored_alone``, for many rows: kept as compressed Arrow batches."""
    import pyarrow as pa

    def pack(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["data"])

    def unpack(batches):
        for batch in batches:
            for data in batch.column(0):
                yield from pa.ipc.open_stream(data.as_buffer())

    return stored_alone(df.mapInArrow(pack, "data binary")).mapInArrow(unpack, df.schema)
