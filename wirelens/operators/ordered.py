"""State machines over rows in order, one for each key: what window functions can't express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def ordered_scan(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], schema: str, machine: Callable[[], object]) -> DataFrame:
    """What the machines give for rows in order, with the keys in front.

    A key's rows go, one after the other, to machine().feed(*columns), then end() is called; both give lists of dicts of
    the schema's fields. One shuffle on the keys; a task streams through its sorted rows, so no key is gathered in
    memory, and the work is linear in the rows.
    """
    names = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema]
    whole = ", ".join([*names, schema])
    arrow = to_arrow_schema(StructType.fromDDL(whole))
    wanted = [*keys, *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, out = None, None, []

        def give(found: list) -> None:
            for row in found:
                out.append(row | dict(zip(keys, key, strict=True)))

        for batch in batches:
            for values in zip(*[batch.column(c).to_pylist() for c in wanted], strict=True):
                now = values[: len(keys)]
                if state is None or now != key:
                    if state is not None:
                        give(state.end())
                    state, key = machine(), now
                give(state.feed(*values[len(keys) :]))
            yield pa.RecordBatch.from_pylist(out, arrow)
            out = []
        if state is not None:
            give(state.end())
            yield pa.RecordBatch.from_pylist(out, arrow)

    kept = list(dict.fromkeys([*keys, *order, *columns]))
    return rows.select(*kept).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, whole)
