"""Arrow batches in slices of bounded text."""
from __future__ import annotations

import sys
from collections.abc import Callable, Hashable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Where a Python worker keeps what its tasks share: modules that travel with a job are new in
# every task, the worker's process isn't.
_KEPT = "_geoweft_kept"


def once(name: Hashable, make: Callable):
    """What `make` gives, made once in each process for a name."""
    kept = sys.modules.setdefault(_KEPT, ModuleType(_KEPT)).__dict__.setdefault("made", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


# Bytes of text that a slice holds at most, unless a single text is longer.
SLICE_BYTES = 400_000


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", least: int = 0) -> Iterator[pa.RecordBatch]:
    """The batches' rows in their order, cut so that the working arrays of a slice stay small
    however many rows a batch has; a row counts as `least` bytes at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(np.maximum(sizes, least))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The slice's texts, nulls as empty ones."""
    return [t or "" for t in batch.column(text).to_pylist()]


def text_in(batch: pa.RecordBatch, rest: str, at: int) -> pa.RecordBatch:
    """The batch with `text`, the field number `at` of its struct column `rest`: a text that is
    among the columns to be kept needs no copy beside them."""
    return batch.append_column("text", pc.struct_field(batch.column(rest), [at]).cast(pa.string()))
