"""Ordered folds whose next step depends on earlier decisions.

Rows are shuffled by the fold key, sorted on disk-backed Spark sorters and
streamed through Arrow batches. Only the state of the current key is held, so
a long key costs time but not memory. Callers cut keys at natural resets
first (gap islands, overlap islands, cuts) to keep single keys short.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: Rows that a grouped fold gives to Spark at a time.
BATCH = 10_000


def plain(column: pa.Array) -> list:
    """Python values of a column, as `to_pylist` gives them; numbers, lists and structs are made from whole columns, not value by value."""
    kind = column.type
    if pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind):
        if not column.null_count:
            return column.to_numpy(zero_copy_only=False).tolist()
        filled = column.fill_null(False if pa.types.is_boolean(kind) else 0).to_numpy(zero_copy_only=False).tolist()
        return [v if here else None for v, here in zip(filled, plain(column.is_valid()))]
    if pa.types.is_struct(kind) and kind.num_fields:
        names = [f.name for f in kind]
        rows = [dict(zip(names, values)) for values in zip(*[plain(c) for c in column.flatten()])]
        return rows if not column.null_count else [r if here else None for r, here in zip(rows, plain(column.is_valid()))]
    if pa.types.is_list(kind):
        items, at, lists = plain(column.flatten()), 0, []
        for n in plain(pc.list_value_length(column)):
            lists.append(None if n is None else items[at:at + n])
            at += n or 0
        return lists
    return column.to_pylist()


def grouped_fold(df: DataFrame, keys: list[str], order: list[str], work: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that `work` makes of the rows of each key, which come one by one in `order`; both are tuples of all columns."""
    result = StructType.fromDDL(schema)
    key_of = itemgetter(*[df.columns.index(k) for k in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(result)
        made: list[tuple] = []

        def pack() -> pa.RecordBatch:
            columns = zip(*made) if made else [()] * len(out_schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

        rows = (row for batch in batches for row in zip(*[plain(c) for c in batch.columns]))
        for _, group in groupby(rows, key_of):
            made.extend(work(group))
            if len(made) >= BATCH:
                yield pack()
                made = []
        yield pack()

    placed = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return placed.mapInArrow(run, result)


def streaming_fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str],
                   start: Callable[[], Callable], added: str) -> DataFrame:
    """Append columns computed row by row in `order` within `keys`.

    `start()` makes a fresh step for each key; `step(*input_values)` returns a
    tuple of the added columns, or None to drop the row.
    """
    schema = StructType(list(df.schema.fields) + list(StructType.fromDDL(added).fields))
    names = df.columns
    key_at = [names.index(k) for k in keys]
    input_at = [names.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(schema)
        current, step = None, None
        for batch in batches:
            read = {i: plain(batch.column(i)) for i in {*key_at, *input_at}}
            kept, results = [], []
            key_rows = zip(*[read[i] for i in key_at])
            input_rows = zip(*[read[i] for i in input_at])
            for at, (key, values) in enumerate(zip(key_rows, input_rows)):
                if key != current:
                    current, step = key, start()
                result = step(*values)
                if result is not None:
                    kept.append(at)
                    results.append(result)
            base = batch.take(pa.array(kept, pa.int64()))
            fields = out_schema
            arrays = [base.column(i).cast(fields.field(i).type) for i in range(base.num_columns)]
            for j in range(len(fields) - base.num_columns):
                arrays.append(pa.array([r[j] for r in results], fields.field(base.num_columns + j).type))
            yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    placed = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return placed.mapInArrow(run, schema)
