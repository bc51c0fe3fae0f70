"""Row-wise operators over Arrow batches that carry the input's columns along."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

BATCH_BYTES = 8 << 20
_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """``run``, after which the Python worker gives back what it has freed: workers are reused, and idle ones would keep it.

    A session that has Spark's default size of Arrow batches, 64 MB, gets one of BATCH_BYTES: executor and worker each hold some.
    """
    if (session := SparkSession.getActiveSession()) is not None and session.conf.get(_SIZE).removesuffix("b") == str(64 << 20):
        session.conf.set(_SIZE, str(BATCH_BYTES))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
                trim(0)

    return apply


def extend(docs: DataFrame, inputs: list[Column], made: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all, if None) and the made ones, row by row.

    ``run`` gets batches of the inputs and yields (batch, first row, last row, arrays) with the arrays of the made columns
    for these rows. A carried column whose name clashes with a made one, in any case, gives way to it; to keep it, carry
    the row as one struct, as the pipeline does.
    """
    new = T._parse_datatype_string(made)
    taken = {f.name.lower() for f in new.fields}
    held = [f for f in docs.schema.fields if f.name.lower() not in taken and (carry is None or f.name in carry)]
    n = len(held)
    names = [f.name for f in held] + new.names

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, j, arrays in run(batches):
            yield pa.RecordBatch.from_arrays([c.slice(i, j - i) for c in batch.columns[:n]] + arrays, names=names)

    plain = docs.select(*[docs[f"`{f.name}`"] for f in held], *[c.alias(f"_in{k}") for k, c in enumerate(inputs)])
    return plain.mapInArrow(released(apply), T.StructType(held + new.fields))


def inputs_of(batch: pa.RecordBatch, count: int) -> list[pa.Array]:
    return batch.columns[len(batch.columns) - count :]
