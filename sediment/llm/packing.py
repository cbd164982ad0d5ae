"""Packing documents into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coded import FOLD, byte_class, raw_bytes
from .common import stored, trim
from .words import BLANK

#: Pieces of words whose ids a worker remembers, and words that are no such pieces in each of two generations.
REMEMBERED = 200_000
#: Bytes of text that are cut into pieces at a time (a longer word makes it longer).
STRETCH = 1 << 20


class Memory(dict):
    """What a worker has met: when the younger generation is full it becomes the older one, and what that held and nobody
    has asked for since is forgotten. Common words are met again soon, so they stay."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        if (found := self.older.get(key)) is None:
            found = self.make(key)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Known:
    """Pieces and their ids as flat arrays (about 40 bytes a piece). Beyond REMEMBERED pieces those asked for last stay, half
    as many; common pieces are asked for again soon."""

    def __init__(self, make):
        self.make, self.clock = make, 0
        self.forget()

    def forget(self) -> None:
        self.pieces, self.ids = pa.array([], pa.large_binary()), np.zeros(0, np.uint32)
        self.ends, self.asked = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Where each of these distinct pieces stands; new ones are encoded first. The next call may move them."""
        if len(self.pieces) > REMEMBERED:
            kept = np.sort(np.argsort(-self.asked, kind="stable")[: REMEMBERED // 2])
            n = np.diff(self.ends)[kept]
            self.ids, self.ends = self.ids[spread(self.ends[kept], n)], np.r_[0, np.cumsum(n)]
            self.pieces, self.asked = self.pieces.take(pa.array(kept)), self.asked[kept]
        found = pc.index_in(pieces, value_set=self.pieces)
        new = pc.is_null(found)
        at = np.where(new.to_numpy(zero_copy_only=False), -1, found.fill_null(0).to_numpy())
        made = pieces.filter(new)
        if len(made):
            ids, n = self.make(made)
            at[at < 0] = len(self.pieces) + np.arange(len(made))
            self.pieces = pa.concat_arrays([self.pieces, made])
            self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(n)])
            self.asked = np.concatenate([self.asked, np.zeros(len(made), np.int64)])
        self.clock += 1
        self.asked[at] = self.clock
        return at


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ..., n[i] of them, for every i in turn."""
    upto = np.cumsum(n)
    return np.repeat(first - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)


class Tokens:
    """Ids of texts by a public tokenizer, piece by piece: its pattern never spans ASCII white space, so a text's ids are
    its words' ids. Words of ASCII and Latin-1 letters are cut into pieces for whole stretches of text at a time, and a
    stretch's distinct pieces go straight to the vocabulary's merges; every other word, any with an apostrophe and any that
    may hold an added token are a piece each. What was encoded is remembered."""

    #: The pattern and the byte table of the tokenizer, for the characters that PLAIN admits.
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    #: Kinds of bytes in lower case (letters: both bytes of a Latin-1 letter too), the first byte of Latin-1
    #: letters, the second ones of the signs among these, and the last of their upper case.
    LETTER, DIGIT, OTHER = 1, 2, 3
    LATIN, SIGNS, UPPER = 0xC3, (0x97, 0xB7), 0x9E

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = sorted((t.content for t in self.whole.get_added_tokens_decoder().values()), key=lambda t: (-len(t), t))
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.model = self.whole.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        table = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.bytes = [table[b] for b in range(256)]
        self.kinds = np.full(256, self.OTHER, np.uint8)
        self.kinds[97:123] = self.kinds[128:192] = self.kinds[self.LATIN] = self.LETTER
        self.kinds[48:58] = self.DIGIT
        begins = [t.encode()[0] for t in added if t]
        self.odd = byte_class((0, 8), (14, 31), (39, 39), (127, 127), (192, self.LATIN - 1), (self.LATIN + 1, 255), *zip(begins, begins))
        self.words, self.pieces = Memory(self.word), Known(self.encoded)

    def piece(self, p: str) -> list[int]:
        mapped = p if p.isascii() else "".join([self.bytes[b] for b in p.encode()])
        return [t.id for t in self.model.tokenize(mapped)]

    def word(self, w: str) -> bytes:
        if self.PLAIN.fullmatch(w) and not self.added.search(w):
            return array("I", [i for p in self.PIECES.findall(w.lower()) for i in self.piece(p)]).tobytes()
        return array("I", self.whole.encode(w, add_special_tokens=False).ids).tobytes()

    def hard(self, raw: np.ndarray) -> np.ndarray:
        """Whether each byte (the first of a character counts) keeps its word whole."""
        out = self.odd[raw]
        lead = np.flatnonzero(raw == self.LATIN)
        out[lead] |= np.isin(raw[lead + 1], self.SIGNS)
        return out

    def encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each piece has) of distinct pieces and whole words."""
        raw, ends = raw_bytes(pieces)
        whole = np.logical_or.reduceat(self.hard(raw), np.r_[0, ends[:-1]])
        ids, n = [], []
        for p, w in zip(pieces.cast(pa.large_string()).to_pylist(), whole.tolist()):
            own = np.frombuffer(self.words[p], np.uint32).tolist() if w else self.piece(p)
            ids += own
            n.append(len(own))
        return np.array(ids, np.uint32), np.array(n, np.int64)

    def stretch(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them come before each of `ends`) of UTF-8 bytes; texts end at the ends."""
        low, solid = FOLD[raw], ~BLANK[raw]
        first = np.zeros(len(raw) + 1, bool)
        first[ends] = first[0] = True
        first = first[:-1]
        first[1:] |= ~solid[:-1]
        first &= solid  # where words start
        upper = np.flatnonzero(raw == self.LATIN) + 1
        low[upper[(raw[upper] <= self.UPPER) & ~np.isin(raw[upper], self.SIGNS)]] += 32
        kinds = self.kinds[low]
        cut = first.copy()
        cut[1:] |= (kinds[1:] != kinds[:-1]) | (kinds[1:] == self.DIGIT)
        cut &= solid
        if len(at := np.flatnonzero(self.hard(raw))):
            words = np.flatnonzero(first)
            last = np.flatnonzero(solid & ~np.append(solid[1:] & ~first[1:], False))
            which = np.unique(np.searchsorted(words, at, "right") - 1)
            inside = spread(words[which], last[which] + 1 - words[which])
            low[inside] = raw[inside]
            cut[inside] = first[inside]
        places = np.flatnonzero(cut)
        offsets = np.append(np.cumsum(solid)[places] - 1, np.count_nonzero(solid)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(low[solid])]).dictionary_encode()
        known = self.pieces
        at = known.places(pieces.dictionary)[pieces.indices.to_numpy()]
        n = known.ends[at + 1] - known.ends[at]
        return known.ids[spread(known.ends[at], n)], np.r_[0, np.cumsum(n)][np.searchsorted(places, ends)]

    def ids(self, text: str) -> bytes:
        return next(self.texts(pa.array([text])))

    def texts(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a column without nulls, little-endian, in stretches cut where a word or a text ends."""
        raw, ends = raw_bytes(column)
        at, i, parts = 0, 0, []
        while i < len(ends):
            stop = min(at + STRETCH, len(raw))
            j = int(np.searchsorted(ends, stop, "right"))
            if j > i:
                stop = int(ends[j - 1])  # whole texts
            else:  # a long text: as far as its last white space, else its next
                white = np.flatnonzero(BLANK[raw[at:stop]])
                if len(white):
                    stop = at + int(white[-1]) + 1
                else:
                    stop = int(ends[i])
                    for k in range(at + STRETCH, stop, STRETCH):
                        if len(white := np.flatnonzero(BLANK[raw[k : min(k + STRETCH, stop)]])):
                            stop = k + int(white[0]) + 1
                            break
                    j = i + (stop == ends[i])
            ids, upto = self.stretch(raw[at:stop], ends[i:j] - at)
            start = 0
            for n in upto.tolist():
                parts.append(ids[start:n].tobytes())
                yield parts[0] if len(parts) == 1 else b"".join(parts)
                start, parts = n, []
            if start < len(ids):
                parts.append(ids[start:].tobytes())
            at, i = stop, j


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def differenced(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window of each item: Karmarkar-Karp multiway differencing into k windows.

    Each item starts as a partial partition with one filled window. The two partitions of largest imbalance are merged,
    the fullest windows of one with the emptiest of the other, until one partition is left.
    """
    n = len(sizes)
    if k <= 1 or n <= 1:
        return np.zeros(n, np.int64)
    sums, merges, heap = {}, [], []
    for i, s in enumerate(sizes):
        v = np.zeros(k, np.int64)
        v[0] = s
        sums[i] = v
        heap.append((-int(s), i))
    heapq.heapify(heap)
    top = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        v = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-v, kind="stable")
        v = v[order]
        v -= v[-1]
        merges.append((a, b, order))
        sums[top] = v
        heapq.heappush(heap, (-int(v[0]), top))
        top += 1
    place = {top - 1: np.arange(k)}  # window of each slot of a partition
    out = np.zeros(n, np.int64)
    for j in range(len(merges) - 1, -1, -1):
        a, b, order = merges[j]
        mine = place.pop(n + j)
        slot = np.empty(k, np.int64)
        slot[order] = mine
        for child, at in ((a, slot), (b, slot[::-1])):
            if child < n:
                out[child] = at[0]
            else:
                place[child] = at
    return out


def balanced(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of at most `capacity`, near equal: as few as the sum allows, one more each time one overflows."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        where = differenced(sizes, k)
        if np.bincount(where, weights=sizes).max(initial=0) <= capacity:
            return where
        k += max(1, k // 100)


def pack(df: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, piece: int = 512, crumb: int = 64, crumbled: int = 8, group_windows: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs documents' ids into sequences of at most `window`.

    A document's ids are its text's by the tokenizer file and end_id. Whole windows of a document are sequences of
    their own; its rest is cut into near-equal pieces of at most `piece` ids, or of `crumb` ids for one document in
    `crumbled`, whose small pieces let the differencing end nearly level. Pieces are dealt into groups of about
    `group_windows` windows by a hash of their number, and each group is packed by differencing; groups are all that a
    task ever holds. Only (id, start, length, crc) rows of such pieces are shuffled, never whole windows, texts or ids.

    Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long). Sequences are padded by the
    consumer: 2048 less the sum of their lengths.

    Defined cases: null or empty text gives one piece, the end id; rows with null or equal ids are packed each by
    itself; other columns are not read; an empty table gives an empty result.
    """

    def cut(batches):
        enc, end = tokens(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for doc, of in zip(b.column(0).to_pylist(), enc.texts(b.column(1))):
                ids = memoryview(of + end)
                n = len(ids) // 4
                ends = list(range(window, n + 1, window))
                if rest := n % window:
                    parts = -(-rest // (crumb if zlib.crc32(ids) % crumbled == 0 else piece))
                    ends += [n - rest + rest * (i + 1) // parts for i in range(parts)]
                start = 0
                for e in ends:
                    out.append((doc, start, e - start, zlib.crc32(ids[start * 4 : e * 4]), n))
                    start = e
            cols = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["id", "start", "length", "ids_crc32", "doc_tokens"])
        enc.words.forget()  # the worker may go on to another stage
        enc.pieces.forget()
        trim()

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = slim.mapInArrow(cut, "id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = stored(cuts.withColumn("n", F.monotonically_increasing_id()), "pieces")
    parts = pieces.where(F.col("length") < window)
    total = parts.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (window * group_windows)))

    def windows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy()
        seq = balanced(sizes, window)
        order = np.argsort(seq, kind="stable")
        run = np.cumsum(sizes[order]) - sizes[order]
        s = seq[order]
        first = np.r_[True, s[1:] != s[:-1]]
        offset = np.empty(len(pdf), np.int64)
        offset[order] = run - np.maximum.accumulate(np.where(first, run, 0))
        pdf["sequence_id"] = (int(key[0]) << 32) + seq
        pdf["offset"] = offset
        return pdf.drop(columns=["n", "g"])

    kinds = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    grouped = parts.withColumn("g", F.pmod(F.xxhash64("n"), F.lit(groups))).groupBy("g").applyInPandas(windows, kinds)
    # A whole window is a sequence by itself, numbered beyond all those of groups.
    whole = pieces.where(F.col("length") >= window).withColumn("sequence_id", F.col("n") + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    out = grouped.unionByName(whole.drop("n"))
    return out.withColumnRenamed("id", id_col)
