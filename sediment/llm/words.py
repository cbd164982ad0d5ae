"""Hashes of words and of runs of words, for whole Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .fingerprints import POWERS, PRIMES

U = np.uint64
#: Bytes of text that are hashed at a time (a longer document is a block of its own).
BLOCK = 1 << 20
#: Bases (odd, so invertible by 2^64) and the code points that part words.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=U) | U(1)
FOLDED = VALUES.copy()
FOLDED[65:91] = VALUES[97:123]  # A-Z count as a-z


class _Powers:
    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            step, back = U(pow(self.base, k, 1 << 64)), U(pow(pow(self.base, -1, 1 << 64), k, 1 << 64))
            self.up, self.down = np.concatenate([self.up, self.up * step]), np.concatenate([self.down, self.down * back])
        return self.up[:n], self.down[:n]


BYTES, WORDS = _Powers(BYTE_BASE), _Powers(WORD_BASE)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def sums(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers, out=out[1:])
    return out


class Block:
    """Words of some documents. first[i]..first[i+1] are document i's words; hashes has all of them in order."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, folded: bool):
        """data: the documents' UTF-8 bytes in a row; ends: where each ends."""
        solid = ~BLANK[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[ends] = True
        cut[0] = True
        start = solid.copy()
        start[1:] &= ~solid[:-1] | cut[1:-1]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | cut[1:-1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        up, down = BYTES.get(len(data) + 1)
        s = sums((FOLDED if folded else VALUES)[data], up[: len(data)])
        self.hashes = mixed((s[self.ends] - s[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U))
        self.first = np.r_[0, np.searchsorted(self.starts, ends)]
        self.data, self.folded = data, folded
        self.sums = self.checks = None

    def runs(self, start: np.ndarray, n) -> np.ndarray:
        """Hashes of the runs of n words from the word numbers `start`."""
        up, down = WORDS.get(len(self.hashes) + 1)
        if self.sums is None:
            self.sums = sums(self.hashes, up[: len(self.hashes)])
        n = np.broadcast_to(np.asarray(n), start.shape)
        return mixed((self.sums[start + n] - self.sums[start]) * down[start] + n.astype(U) * U(0x9E3779B97F4A7C15))

    def check(self, start: np.ndarray, n) -> np.ndarray:
        """62-bit hashes of the same runs, by two primes and from the bytes of their words with a zero between words: a
        second lane that texts built against a power of two (Thue-Morse words) do not defeat."""
        if self.checks is None:
            size = self.ends - self.starts
            at = np.r_[0, np.cumsum(size)]  # where each word starts among the bytes of words
            codes = self.data[~BLANK[self.data]].astype(U)
            if self.folded:
                codes[(codes >= 65) & (codes <= 90)] += U(32)
            power = np.arange(len(codes)) + np.repeat(np.arange(len(size)), size)
            POWERS.grow(len(codes) + len(size) + 1)
            self.checks = at, []
            for p, up in zip(PRIMES, POWERS.up):
                s = sums((codes + U(1)) * up[power] % U(p), U(1))
                self.checks[1].append(s % U(p))
        at, prefixes = self.checks
        i, j = at[start], at[start + n]
        out = np.zeros(len(start), U)
        for p, s, down in zip(PRIMES, prefixes, POWERS.down):
            out = (out << U(31)) | ((s[j] + U(p) - s[i]) % U(p) * down[i + start] % U(p))
        return out


def blocks(text: pa.Array, folded: bool) -> Iterator[tuple[int, int, Block]]:
    """(first row, row after the last, Block) over an Arrow column of strings or binaries without nulls."""
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    _, offsets, data = text.buffers()
    if data is None:
        data = pa.py_buffer(b"")
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
        j = min(j, len(text))
        yield i, j, Block(raw[at[i] : at[j]], at[i + 1 : j + 1] - at[i], folded)
        i = j
