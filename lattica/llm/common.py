"""Arrow helpers shared by the corpus operators.

Intermediate tables (:func:`lattica.functions.staging.stage`) go to the folder
named by ``spark.checkpoint.dir``: it is the one place that driver and
executors share, so a lost executor costs a re-read and not a recomputation of
everything above the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lattica.functions.staging import ship, stage

__all__ = ["map_rows", "map_text", "private", "ship", "slices", "stage", "text_column"]


#: Rows that an operator's body sees at once, whatever size the session's Arrow batches have.
BATCH_ROWS = 2000


def private(columns: list[str], *names: str) -> list[str]:
    """Each name, or a longer one that no column has, whatever the case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_column(column: pa.Array) -> pa.Array:
    """A text column whose nulls are empty texts."""
    return column.fill_null("") if column.null_count else column


def map_text(
    docs: DataFrame,
    schema: str | T.StructType,
    body: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | None],
    columns: list[str],
) -> DataFrame:
    """Apply ``body`` to each Arrow batch of the named columns.

    Only those columns leave the scan, so extra columns of the input, whatever
    their names, play no part.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH_ROWS):
                yield from body(batch.slice(first, BATCH_ROWS))

    return docs.select(*columns).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 21, max_rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of at most ``max_rows`` rows and ``max_bytes`` of text each.

    Yields (first row, last row exclusive, bytes, offsets).  A text longer than
    the bound comes alone and whole.
    """
    text = text_column(batch.column(column))
    width = np.int64 if pa.types.is_large_string(text.type) else np.int32
    offsets = np.frombuffer(text.buffers()[1], dtype=width)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = text.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(text):
        last = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), first + max_rows, len(text))
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def map_rows(docs: DataFrame, id_col: str, text_col: str, schema: str, row: Callable[[str], tuple]) -> DataFrame:
    """The id with the columns of ``schema`` that ``row`` makes of each text (null: the empty text)."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    names = [part.split()[0] for part in schema.split(",")]
    types = T._parse_datatype_string(schema)

    def body(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(text_col)
        for first in range(0, batch.num_rows, 512):
            ids = batch.column(id_col).slice(first, 512)
            made = [row(text.as_py() or "") for text in texts.slice(first, 512)]
            columns = [pa.array(list(c), _arrow(f.dataType)) for c, f in zip(zip(*made, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=[id_col, *names])

    return map_text(docs, f"`{id_col}` {kind}, {schema}", body, list(dict.fromkeys([id_col, text_col])))


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}[kind.simpleString()]
