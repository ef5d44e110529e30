"""Arrow batches cut and gathered by size, so that a Python worker holds the objects of one piece at a time, however many and however large the rows of a batch are."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

ROWS, BYTES = 256, 1 << 20


def steps(n: int, size: int) -> Iterator[tuple[int, int]]:
    """(begin, rows) of the pieces of ``n`` rows that have ``size`` bytes in all."""
    step = max(1, min(ROWS, n * BYTES // max(1, size)))
    for at in range(0, n, step):
        yield at, min(step, n - at)


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in order, in slices (no bytes are copied)."""
    for batch in batches:
        for at, n in steps(batch.num_rows, batch.nbytes):
            yield batch.slice(at, n)


def gathered(rows: Iterable[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows to batches; one ends with the row that fills it."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str | bytes))
        if len(held) >= ROWS or size >= BYTES:
            yield _batch(held, names, types)
            held, size = [], 0
    if held:
        yield _batch(held, names, types)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
