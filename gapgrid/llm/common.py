"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import zipfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapgrid.session import checkpoint_root, discard, materialize

__all__ = ["checkpoint_root", "discard", "free_names", "frugal", "give_back", "map_batches", "materialize", "read_table", "ship", "slices_of", "text_bytes", "utf8_column"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(8)
def _shipped(application: str) -> bool:
    sc = SparkSession.getActiveSession().sparkContext
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "operators.zip")  # the driver serves it from there
    with open(path, "wb") as f:
        f.write(raw.getvalue())
    sc.addPyFile(path)
    return True


def ship(spark: SparkSession) -> None:
    """Let the application's Python workers import this package, once per application."""
    _shipped(spark.sparkContext.applicationId)


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at the workers' hands."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


@lru_cache(1)
def _malloc_trim():
    """The C library's function of that name; None where it has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system. Spark keeps a Python worker for the next tasks, and large arrays freed between small ones stay with it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = _malloc_trim()
    if trim is not None:
        trim(0)


def frugal(run):
    """``run``, a function of ``map_batches``, with ``give_back`` after every batch and at the end."""
    def given(batches):
        for batch in batches:
            yield batch
            del batch
            give_back()

    def lean(batches):
        try:
            yield from run(given(batches))
        finally:
            give_back()

    return lean


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The ``names``, lengthened where ``df`` has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def utf8_column(name: str = "text"):
    """The column as bytes, null as empty, so that tasks read Arrow buffers without decoding strings."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary").alias(name)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a whole binary column and the n + 1 offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    width = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices_of(offsets: np.ndarray, most: int):
    """(first, last) runs of rows whose bytes sum to ``most`` at most; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
