"""Small parts of what Spark hands to a function in Python, so that a worker's memory is bounded by a block and not by an Arrow batch."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Characters (frames) or bytes (batches) of text that a block holds, unless it is one row; and after how many of them memory is given back.
MOST, RETURN = 1 << 20, 4 << 20


def returned() -> None:
    """Give back what a worker no longer uses, as it lives on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _cut(lengths: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths sum up to `most`, or that are one row; memory is given back between them."""
    start = end = total = since = 0
    for n in lengths:
        if end > start and total + n > most:
            yield start, end
            start, since, total = end, since + total, 0
            if since >= RETURN:
                returned()
                since = 0
        end, total = end + 1, total + n
    if end > start:
        yield start, end
    returned()


def frames(parts: Iterable[pd.DataFrame], column: str, most: int = MOST) -> Iterator[pd.DataFrame]:
    """The rows of frames in order, cut by the length of a column of texts."""
    for part in parts:
        for a, b in _cut((len(x) if isinstance(x, str) else 0 for x in part[column]), most):
            yield part.iloc[a:b].reset_index(drop=True)


def batches(parts: Iterable[pa.RecordBatch], column: str, most: int = MOST) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in order, cut by the bytes of a column of texts."""
    for part in parts:
        for a, b in _cut(np.asarray(pc.fill_null(pc.binary_length(part.column(column)), 0)).tolist(), most):
            yield part.slice(a, b - a)
