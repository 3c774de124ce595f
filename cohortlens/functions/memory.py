"""Memory of Python processes: rows that leave as they are found, and freed memory that goes back to the system."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructType


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, for mapInArrow, with what it freed given back to the system now and then, and at its end.

    Python processes outlive their tasks; what the allocators keep for later would lie beside the next operator's memory.
    """

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        for out in run(batches):
            yield out
            del out
            if time.monotonic() - last > 1:
                _give_back()
                last = time.monotonic()
        _give_back()

    return leaner


# Characters of results that a task holds before they leave it.
FLUSH = 1 << 20
_TYPES = {"int": (IntegerType(), pa.int32()), "string": (StringType(), pa.string())}


def rows_of(df: DataFrame, keys: list[str], value: str, parse: Callable[[object], Iterable[tuple]], fields: dict[str, str]) -> DataFrame:
    """(keys, fields): a row for each tuple that ``parse`` gives for a value, which may be null.

    A task holds one batch of values, the tuples of one value and about FLUSH characters of others,
    whatever the number of rows; a scalar function would hold the results of the whole batch, as objects and as columns.
    """
    own = df.select(*keys, value)
    schema = StructType(own.schema.fields[:-1])
    for name, kind in fields.items():
        schema = schema.add(name, _TYPES[kind][0])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places: list[int] = []
            rows: list[tuple] = []
            held = 0

            def leave():
                at = pa.array(places, pa.int64())
                found = [pa.array([r[k] for r in rows], _TYPES[kind][1]) for k, kind in enumerate(fields.values())]
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), *found], names)  # noqa: B023

            for place, cell in enumerate(batch.column(len(keys))):
                for row in parse(cell.as_py()):
                    places.append(place)
                    rows.append(row)
                    held += 100 + sum(len(x) for x in row if isinstance(x, str))
                    if held >= FLUSH:
                        yield leave()
                        places, rows, held = [], [], 0
            if rows:
                yield leave()

    return own.mapInArrow(lean(run), schema)
