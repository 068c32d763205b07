"""Folds over the rows of a key in order, for rules that no window can say: what is told next depends on what was told."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that leave a fold together.
OUT_ROWS = 4096


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable, schema: StructType) -> DataFrame:
    """``step(state, row) -> (state, out)`` over each key's rows by ``order``; ``row`` is a dict, ``out`` a tuple or None, the
    first state None. Keys are dealt to partitions that are sorted, and rows pass through one at a time: a key with most of
    the rows takes one task its time, but no more memory than any other."""

    arrow = to_arrow_schema(schema)

    def emit(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], f.type) for k, f in enumerate(arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]):
        now, state, found = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now:
                    now, state = key, None
                state, out = step(state, row)
                if out is not None:
                    found.append(out)
                    if len(found) == OUT_ROWS:
                        yield emit(found)
                        found = []
        yield emit(found)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
