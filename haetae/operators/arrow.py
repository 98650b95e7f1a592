"""Row functions over Arrow batches, as one column of the plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows and bytes of what one array that goes back to the JVM holds, at most (or one row).
ROWS, BYTES = 256, 4 << 20


def _size(value: Any) -> int:
    """Bytes of a value, nearly."""
    if isinstance(value, (bytes, str)):
        return len(value)
    if isinstance(value, dict):
        return sum(map(_size, value.values()))
    if isinstance(value, list):
        return sum(map(len if {*map(type, value)} <= {bytes, str} else _size, value))
    return 8


def _array(rows: list[dict[str, Any] | None], kind: pa.StructType) -> pa.StructArray:
    """``rows`` as an array, field by field, which costs a third of what rows at once do."""
    gone = [r is None for r in rows]
    fields = [pa.array([None if r is None else r.get(f.name) for r in rows], f.type) for f in kind]
    return pa.StructArray.from_arrays(fields, fields=list(kind), mask=pa.array(gone) if any(gone) else None)


def struct_of(schema: str, make: Callable[..., dict[str, Any]], *inputs: Column) -> Column:
    """A struct column: ``make`` of each row's ``inputs``, null where all of these are null.

    Only the inputs travel to Python and only the struct comes back; the frame's other columns stay where they are.
    Batches that come in are bounded in bytes by the session's ``spark.sql.execution.arrow.maxBytesPerBatch``, so files of some
    MB fit. A batch is gone through row by row, and what is made goes back in arrays of ``ROWS`` rows or ``BYTES`` bytes: a worker holds
    no batch's objects at once, however large what is made of a short row. Nothing is shuffled.
    """
    kind = T.StructType(list(T._parse_datatype_string(schema)))
    arrow = to_arrow_type(kind)

    def pieces(columns: tuple[pa.Array, ...]) -> Iterator[pa.Array]:
        rows, size = [], 0
        for i in range(len(columns[0])):
            values = [c[i].as_py() for c in columns]
            rows.append(None if all(v is None for v in values) else make(*values))
            size += _size(rows[-1])
            if len(rows) >= ROWS or size >= BYTES:
                yield _array(rows, arrow)
                rows, size = [], 0
        if rows:
            yield _array(rows, arrow)

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield from pieces(columns if isinstance(columns, tuple) else (columns,))

    return run(*inputs)


def add_struct(df: Any, name: str, inputs: list[str], schema: str, make: Callable[..., dict[str, Any]]) -> Any:
    """``df`` with ``struct_of`` the columns ``inputs``."""
    return df.withColumn(name, struct_of(schema, make, *[F.col(c) for c in inputs]))
