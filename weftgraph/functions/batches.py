"""Arrow batches inside tasks: taken in pieces, and made from Python's values."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch that are Python objects at a time.
PIECE = 256


def pieces(batches: Iterator[pa.RecordBatch], rows: int = PIECE) -> Iterator[pa.RecordBatch]:
    """``batches`` in pieces of ``rows`` rows, so that what a worker holds as Python objects doesn't grow with a batch. What is freed goes back to the
    system after each batch, not to a pool that keeps the largest."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        del batch
        pa.default_memory_pool().release_unused()


def record_batch(columns: dict[str, Iterable], schema: T.StructType) -> pa.RecordBatch:
    """``columns`` (lists or series) as a batch of ``schema``; dicts are maps, NaN is null."""
    arrays = []
    for field in to_arrow_schema(schema):
        values = columns[field.name]
        if pa.types.is_map(field.type):
            values = [list(x.items()) if isinstance(x, dict) else None for x in values]
        arrays.append(pa.array(values, field.type, from_pandas=True))
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)
