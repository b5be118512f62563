"""Texts as Arrow columns inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTES_AT_ONCE = 4 << 20


def lowered(texts: pa.Array) -> pa.Array:
    """The texts with A-Z as a-z; null as empty. Bytes of other characters are 128 or more."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy() if data is not None else np.empty(0, np.uint8)
    raw[(raw >= 65) & (raw <= 90)] |= 32
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(raw.tobytes()))


def parted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts: the distinct ones, each word as a position among them, and how many
    words each text has. Words are parted by the six white space characters of ASCII."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten().dictionary_encode()
    code = flat.indices.to_numpy().astype(np.int64)
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py() if len(texts) else np.zeros(1, np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    empty = pc.index(flat.dictionary, "").as_py()
    if empty >= 0:  # comes before and after white space at a text's ends
        owner, code = owner[code != empty], code[code != empty]
    return flat.dictionary, code, np.bincount(owner, minlength=len(texts))


def slices(batch: pa.RecordBatch, text: str, rows: int, size: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of so many rows at most, and of texts of about so many bytes or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives memory that it no longer needs back to the machine. Workers
    stay for later tasks, some of which don't need Python at all."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()

    return whole
