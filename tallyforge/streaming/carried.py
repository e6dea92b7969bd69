"""State machines over ordered rows, whose state is carried across Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def carried(rows: DataFrame, key: str, order: list[str], make: Callable, out: str) -> DataFrame:
    """What a machine a key gives when it takes the key's rows in order.

    ``make()`` gives a machine: ``take(*row without key)`` and ``end()`` return lists of tuples. The key is the first
    column of ``rows`` and of ``out`` (a schema as text). Keys are sorted within their partitions, so a task holds one
    batch and one machine, however long a sequence is. Rows that are alike in ``order`` go by their other columns.
    """
    types = dict(c.strip().split(" ") for c in out.split(","))
    schema = pa.schema([(name, ARROW[kind]) for name, kind in types.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = machine = None
        found: list[tuple] = []

        def told() -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if machine is None or k != at:
                    found += [(at, *x) for x in machine.end()] if machine else []
                    at, machine = k, make()
                found += [(k, *x) for x in machine.take(*row)]
            yield told()
            found = []
        if machine:
            found = [(at, *x) for x in machine.end()]
            yield told()

    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.repartition(F.col(key)).sortWithinPartitions(key, *order, *rest).mapInArrow(run, out)
