"""Helpers shared by the training-data operators: Arrow slicing, hashing, shared folders."""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.sources.shared import discard, shared_folder, written

#: Bytes of text that a Python worker handles at once (one text may be larger).
SLICE_BYTES = 4 << 20


__all__ = ["crc_mod", "crc_mod_col", "discard", "filesystem", "map_text", "shared_folder", "slices", "table", "text_bytes", "without_cycle_search", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """pyarrow file system and path of a URI (file, hdfs, s3, gs, or a plain path)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of `column`, so that Python objects stay few."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n) + 64
    if start < batch.num_rows:
        yield batch.slice(start)


@contextmanager
def without_cycle_search():
    """For a task that fills large tables without cycles: searching them for cycles costs a third of the time. Ends with the task."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def map_text(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, text_col: str) -> DataFrame:
    """Narrow map over slices of Arrow batches; `make` builds the per-task function in the worker."""

    def run(batches):
        f = make()
        with without_cycle_search():
            for batch in batches:
                for part in slices(batch, text_col):
                    yield f(part)

    return df.mapInArrow(run, schema)


def crc_mod(ids: list, mod: int) -> list[int]:
    """crc32(id as decimal text) mod `mod`; a null id counts as the empty text."""
    return [zlib.crc32(b"" if i is None else str(i).encode()) % mod for i in ids]


def crc_mod_col(column: str, mod: int):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def text_bytes(column) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()
