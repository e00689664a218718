"""What the corpus operators share: tables, worker caches, free column names, and the folder for intermediate tables."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import materialise, new_path, path_exists, remove, shared_dir, sized

__all__ = ["free_name", "in_byte_slices", "in_slices", "materialise", "new_path", "path_exists", "remove", "shared_dir", "sized", "table", "worker_cache"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(owner: str) -> dict:
    """A dict that lives in the Python worker until another owner asks for one, so that tasks share what is slow to load and a
    worker holds the models of one operator at a time."""
    module = sys.modules.setdefault("_inventorium_worker_cache", types.ModuleType("_inventorium_worker_cache"))
    if getattr(module, "owner", None) != owner:
        module.owner, module.held = owner, {}
        pa.default_memory_pool().release_unused()
    return module.held


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some rows, so that few texts at once are Python objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def in_byte_slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have about ``most`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or that with more underscores, such that df has no column of the name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
