"""Adding columns made in Python, Arrow batch by Arrow batch."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.session import small_batches


# Rows that become Python objects at once.
ROWS = 256


def add_columns(df: DataFrame, added: str, make: Callable[[pa.RecordBatch], list[pa.Array]],
                drop: tuple[str, ...] = (), load: Callable[[], None] | None = None) -> DataFrame:
    """df without `drop`, plus the columns of the DDL string `added`, which make(batch) returns.

    A map over batches is a step of its own: unlike a function inside an expression it can be
    neither copied into a filter nor run twice. `load` runs once a task; `make` sees up to ROWS rows at a time.
    """
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType([*kept, *T._parse_datatype_string(added).fields])

    def run(batches):
        if load is not None:
            load()
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), ROWS):
                batch = whole.slice(at, ROWS)
                columns = [batch.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, *make(batch)], schema.names)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def struct_lists(rows, fields) -> pa.Array:
    """One list of tuples a row as a list array over one flat struct array."""
    offsets, flat = [0], []
    for row in rows:
        flat.extend(row)
        offsets.append(len(flat))
    columns = list(zip(*flat)) if flat else [()] * len(fields)
    arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, fields)]
    structs = pa.StructArray.from_arrays(arrays, fields=[pa.field(n, k) for n, k in fields])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
