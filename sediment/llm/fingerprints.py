"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, numbered, range_index, split_ranges, stored

#: Two primes near 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
U = np.uint64


class _Powers:
    """Powers of the bases and of their inverses, grown as needed."""

    def __init__(self):
        self.n = 0
        self.up: list[np.ndarray] = []
        self.down: list[np.ndarray] = []

    def grow(self, n: int) -> None:
        if n <= self.n:
            return
        self.n = max(n, 1 << 14, 2 * self.n)
        self.up, self.down = [], []
        for p, b in zip(PRIMES, BASES):
            for into, base in ((self.up, b), (self.down, pow(b, -1, p))):
                a = np.ones(1, U)
                while len(a) < self.n:  # doubling: the next len(a) powers are these times base^len(a)
                    a = np.concatenate([a, a * U(pow(base, len(a), p)) % U(p)])
                into.append(a[: self.n])


POWERS = _Powers()


class Prefixes:
    """Modular prefix arrays of a text: S[i] is the sum of code * base^position over the first i code points."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U) + U(1)
        self.n = len(codes)
        POWERS.grow(self.n + 1)
        self.sums = []
        for p, up in zip(PRIMES, POWERS.up):
            s = np.zeros(self.n + 1, U)
            np.cumsum(codes * up[: self.n] % U(p), out=s[1:])
            s %= U(p)
            self.sums.append(s)

    def spans(self, k: int) -> np.ndarray:
        """62-bit hashes, mixed to 64 bits, of all spans of k code points; of the whole text where it is shorter."""
        k = min(k, self.n)
        out = np.zeros(self.n - k + 1, U)
        for p, s, down in zip(PRIMES, self.sums, POWERS.down):
            out = (out << U(31)) | ((s[k:] + U(p) - s[: self.n - k + 1]) % U(p) * down[: self.n - k + 1] % U(p))
        out *= U(0x9E3779B97F4A7C15)
        out ^= out >> U(32)
        out *= U(0xD6E8FEB86659FD93)
        return out ^ (out >> U(32))

    def span(self, i: int, j: int) -> tuple[int, ...]:
        return tuple((int(s[j]) - int(s[i])) * int(d[i]) % p for p, s, d in zip(PRIMES, self.sums, POWERS.down))

    def equal(self, i: int, other: "Prefixes", j: int, n: int) -> bool:
        """Whether n code points from i equal those of the other text from j."""
        return i + n <= self.n and j + n <= other.n and self.span(i, i + n) == other.span(j, j + n)

    def extension(self, i: int, other: "Prefixes", j: int) -> int:
        """Longest common extension to the right of i here and j there, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low


def fingerprint(prefixes: Prefixes, k: int = 16, keep: int = 64) -> str:
    """16 hex digits for the whole text, then the `keep` smallest hashes of its spans of k code points, 8 digits each, in
    order; empty for no text."""
    if not prefixes.n:
        return ""
    h = prefixes.spans(k)
    low = np.unique(np.partition(h, 4 * keep)[: 4 * keep]) if len(h) > 4 * keep else np.unique(h)
    if len(low) < keep < len(h):
        low = np.unique(h)
    whole = int(prefixes.spans(prefixes.n)[0])
    return f"{whole:016x}" + (low[:keep] >> U(32)).astype(">u4").tobytes().hex()


def likeness(a: str, b: str, keep: int = 64) -> float:
    """Share of common spans, twice the common ones over the sum of both, estimated from two fingerprints."""
    if a == b:
        return 1.0
    x, y = ({s[i : i + 8] for i in range(16, len(s), 8)} for s in (a, b))
    both = sorted(x | y)[:keep]
    j = sum(v in x and v in y for v in both) / max(len(both), 1)
    return 2 * j / (1 + j)


def successors(df: DataFrame, id_col: str, text_col: str, range_bytes: int = 4 << 20, most_ranges: int = 4096) -> DataFrame:
    """Rows (r, marker, _k1, _k2, _k3, id, text) dealt by ranges in descending id and sorted: the next row of a range is the
    next document, and each range ends with a marker, a copy of the next range's first document (after the last: of the
    first). Ranges come from size-weighted sampled splitters over (id, hash of text, the row's place), so texts are
    shuffled once, and neither a null id, nor an id, nor a row that a third of the rows repeat makes one task larger."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    (place,) = fresh(df.columns, "place")
    keyed = [F.coalesce(F.bitwise_not(F.col(id_col).cast("long")), F.lit((1 << 63) - 1)).alias("_k1"), F.xxhash64(text).alias("_k2"), F.col(place).alias("_k3")]
    rows = numbered(df, place).select(*keyed, F.col(id_col).cast("long").alias("id"), text.alias("text"))
    cols = ["_k1", "_k2", "_k3"]
    keys = stored(rows.select(*cols, (F.octet_length("text") + 1).cast("long").alias("size")), "fingerprint-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = int(min(most_ranges, max(1, total // range_bytes)))
    bounds, sizes = split_ranges(keys, cols, "size", parts, max(4096, 4 * parts))
    heads = {r["r"]: tuple(r["h"]) for r in keys.groupBy(range_index(cols, bounds).alias("r")).agg(F.min(F.struct(*cols)).alias("h")).collect()}
    full = sorted(heads)
    before = {r: full[i - 1] for i, r in enumerate(full)}
    lit = lambda k: f"struct({', '.join(f'bigint({v!r}) as {c}' if v > -(1 << 63) else f'-9223372036854775808L as {c}' for c, v in zip(cols, k))})"
    table = f"array({', '.join(lit(heads.get(r, (0, 0, 0))) for r in range(len(sizes)))})"
    last = f"array({', '.join(str(before.get(r, 0)) for r in range(len(sizes)))})"
    target = F.expr(f"if(struct({", ".join(cols)}) = get({table}, r), array(struct(r as r, 0 as marker), struct(get({last}, r) as r, 1 as marker)), array(struct(r as r, 0 as marker)))")
    dealt = rows.withColumn("r", range_index(cols, bounds)).withColumn("_t", F.explode(target)).select("_t.r", "_t.marker", *cols, "id", "text")
    # Several small ranges meet in a task, so that hashing deals them evenly; past the most ranges each has its own.
    tasks = len(full) if parts == most_ranges else -(-len(full) // 4)
    return dealt.repartition(max(1, tasks), "r").sortWithinPartitions("r", "marker", *cols)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 16, keep: int = 64) -> DataFrame:
    """Per document: id, n_chars long, fingerprint, and how near it is to an edited copy and to the next document.

    The next document is the next one in descending id (after the last: the first). The edited text has the last
    floor(n_chars / 2) code points replaced by the first as many of the next document's. Columns: edited_sha256,
    edited_fingerprint, near_edited, near_next, shared_prefix long (the longest common extension of text and edited
    text from their start, by binary search on the prefix arrays).

    Defined cases: null text is empty; an empty text has an empty fingerprint, at likeness 1 to another empty one and 0
    to others; null ids come last, in order of their texts' hashes, as do rows of equal ids; repeated rows each have a
    row, in order of their places; a single document is its own next one; an empty table gives an empty result; other columns are not read.
    """

    def run(batches):
        held = None  # (range, id, text, its prefixes and fingerprint) that waits for its next document
        out: list[tuple] = []

        def told(doc, text, a, own, following, nxt):
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            b = Prefixes(edited)
            new = fingerprint(b, k, keep)
            out.append((doc, a.n, hashlib.sha256(edited.encode()).hexdigest(), own, new, likeness(own, new, keep), likeness(own, nxt, keep), a.extension(0, b, 0)))

        def batch():
            cols = list(zip(*out)) or [[]] * 8
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            for r, marker, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if held and held[0] != r:
                    held = None
                text = text.as_py()
                prefixes = Prefixes(text)
                own = fingerprint(prefixes, k, keep)
                if held:
                    told(*held[1:], text, own)
                held = None if marker else (r, doc, text, prefixes, own)
                if len(out) >= 1000:
                    yield batch()
        yield batch()

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shared_prefix"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_prefix long"
    rows = successors(df, id_col, text_col).select("r", "marker", "id", "text")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
