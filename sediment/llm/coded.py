"""Words of Arrow columns as exact codes: each distinct word of a stretch of text is looked at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A-Z as a-z, byte by byte.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of text that are coded at a time.
STRETCH = 2 << 20


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true for bytes in one of the ranges (both ends in)."""
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


def raw_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow column of strings without nulls as its UTF-8 bytes in a row, and where each row ends in them."""
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at[1:] - at[0]


class Coded:
    """The words of a stretch: starts (first byte of each), codes, and the distinct words in order of their codes."""

    def __init__(self, raw: np.ndarray, word: np.ndarray):
        folded = FOLD[raw]
        solid = word[folded]
        edge = np.diff(np.r_[False, solid, False].view(np.int8))
        self.starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(ends - self.starts, out=offsets[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(folded[solid])])
        found = words.dictionary_encode()
        self.codes, self.words = found.indices.to_numpy(), found.dictionary.to_pylist()

    def __len__(self) -> int:
        return len(self.codes)


def stretches(raw: np.ndarray, word: np.ndarray, breaks: np.ndarray, overlap: int, size: int = STRETCH) -> Iterator[tuple[int, int, int]]:
    """(start, stop, words seen before) of stretches of about `size` bytes, cut behind a byte of `breaks` where there is one.

    Without one the cut comes between words, and the next stretch begins `overlap` words earlier: what lies wholly in
    these words was seen before. A word longer than a stretch makes its stretch longer.
    """
    at, seen, want = 0, 0, size
    while at < len(raw):
        stop = min(at + want, len(raw))
        if stop == len(raw):
            yield at, stop, seen
            return
        part = raw[at:stop]
        found = np.flatnonzero(breaks[part])
        if len(found):
            stop = at + int(found[-1]) + 1
            yield at, stop, seen
            at, seen, want = stop, 0, size
            continue
        solid = word[FOLD[part]]
        starts = np.flatnonzero(np.diff(np.r_[False, solid].view(np.int8)) == 1)
        if not solid[-1] and len(starts) > max(seen, overlap):
            yield at, stop, seen
            at, seen, want = at + int(starts[-overlap]), overlap, size
        elif solid[-1] and len(starts) > max(seen, overlap) + 1:  # the last word may go on
            stop = at + int(starts[-1])
            yield at, stop, seen
            at, seen, want = at + int(starts[-1 - overlap]), overlap, size
        else:
            want *= 2
