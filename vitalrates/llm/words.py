"""Words of whole texts: maximal runs of bytes other than ASCII white space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the bounds of each; null is empty."""
    texts = pc.fill_null(texts, "")
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0]:at[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words (binary) in a row and how many each text has. ``lower``: A to
    Z as a to z."""
    data, at = buffers(texts)
    space = _SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    begin = ~space
    begin[1:] &= space[:-1] | first[1:-1]
    start = np.flatnonzero(begin)
    kept = data[~space]
    if lower:
        kept = np.where((kept >= 65) & (kept <= 90), kept + 32, kept).astype(np.uint8)
    bound = np.append(np.concatenate([[0], np.cumsum(~space)])[start], len(kept)).astype(np.int32)
    own = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bound), pa.py_buffer(np.ascontiguousarray(kept))])
    return own, np.diff(np.searchsorted(start, at))
