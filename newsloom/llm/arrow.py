"""Moving Arrow batches through Python functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return pc.cast(column, pa.large_binary()).to_pylist()


def portions(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that what is made of one stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def settled(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which Arrow's pool gives back what is free: workers outlive their tasks, and idle ones would hold it beside the JVM."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return task
