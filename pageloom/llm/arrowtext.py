"""Arrow string columns as flat numpy code-point arrays, and back, without a call per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_code_points(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows, offsets of the n + 1 row borders). A null row has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64, count=n + 1, offset=column.offset * 8)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    # one decode for the whole batch; every byte that isn't a continuation byte begins a code point
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return points, starts[offsets]


def to_arrow(points: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The string column of code points; rows where ``valid`` is false are null."""
    data = points.astype("<u4", copy=False).tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    ends = np.concatenate(([0], np.cumsum(width)))[offsets].astype(np.int64)
    bits = None
    if valid is not None and not valid.all():
        bits = pa.array(valid).buffers()[1]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [bits, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.string())


def row_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of every code point."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def in_parts(batches, column: str, most: int = 1 << 20):
    """Cut Arrow batches so that a part holds about ``most`` bytes of text (a longer row stands alone)."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        text = text.cast(pa.large_binary() if pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type) else pa.large_string())
        n = len(text)
        if not n:
            continue
        offsets = np.frombuffer(text.buffers()[1], np.int64, count=n + 1, offset=text.offset * 8)
        begin = 0
        while begin < n:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
            yield batch.slice(begin, min(end, n) - begin)
            begin = end


def spread(df):
    """``df`` in as many partitions as there are cores at least: a small file would be one task of long work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
