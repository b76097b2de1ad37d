"""Words of a batch of texts as arrays: places in the original bytes and an exact dictionary.

A word is a run of digits, letters and bytes beyond ASCII; A to Z become lower
case, which changes no byte's place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# The class of bytes that make words, in upper or lower case, and the lower case.
_BYTES = np.arange(256, dtype=np.uint8)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
_WORD = _UPPER | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
# The same words as a pattern over lowered text, for Spark and DuckDB.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass
class Words:
    """Words in order: byte range, text number, and place in the list of distinct words."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    code: np.ndarray
    distinct: pa.Array

    def counts(self, docs: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=docs)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of the texts that ``offsets`` cuts out of ``data``; none crosses a border."""
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(data) else inside
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    places = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    body = _LOWER[data[inside]]
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(places), pa.py_buffer(body)])
    coded = found.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    return Words(start, end, doc, code, coded.dictionary)
