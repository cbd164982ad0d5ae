"""Text functions: cleaning, filings as HTML, quote alignment, spans."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from hashlib import sha256
from html import unescape
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters folded (by the cleaner, and beyond them by quote alignment), stop words of the language test.
FOLDED = {"\xa0": " ", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"'}
FOLDED_IN_QUOTES = FOLDED | {"\u2013": "-", "\u2014": "-", "\u2212": "-"}
BULLETS, ENDS = "\ufffd\u2022*- ", ".;:"
STOP_WORDS = frozenset(("and", "company", "for", "in", "of", "the", "to"))


#: All white space there is, and as a class of regular expressions.
WHITE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
WHITE_CLASS = f"[{''.join(f'\\x{{{ord(c):x}}}' for c in WHITE)}]"
BLANK_LINE = f"\n{WHITE_CLASS}*\n"


def strip(text: Column) -> Column:
    """Text without white space at both ends."""
    return F.btrim(text, F.lit(WHITE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def clean(text: str, folded: dict[str, str] = FOLDED) -> str:
    """Character references decoded, NFKC, quotes plain, white space collapsed and trimmed."""
    text = unicodedata.normalize("NFKC", unescape(text))
    return " ".join(text.translate(str.maketrans(folded)).split())


def clean_text():
    """clean() as a function of a string column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else clean(t))

    return run


def language(text: str) -> str:
    """unknown under five words, en with two stop words or more, else unknown."""
    words = re.findall(r"[a-z]+", text.casefold())
    return "en" if len(words) >= 5 and sum(w in STOP_WORDS for w in words) >= 2 else "unknown"


def folded(text: str) -> tuple[str, list[int]]:
    """The text with each character's width and punctuation folded, runs of white space as one space and none at the ends;
    and the place in the text that each character comes from."""
    marks = ((FOLDED_IN_QUOTES.get(f, f), i) for i, c in enumerate(text) for f in unicodedata.normalize("NFKC", c))
    out: list[tuple[str, int]] = []
    for blank, run in groupby(marks, key=lambda m: m[0].isspace()):
        out += [(" ", next(run)[1])] if blank else run
    if out and out[0][0] == " ":
        del out[0]
    if out and out[-1][0] == " ":
        del out[-1]
    return "".join(c for c, _ in out), [i for _, i in out]


def align(source: str, quote: str) -> tuple[int, int] | None:
    """Code-point range of the quote in the source, both folded alike; None where it isn't found or nothing is quoted.

    A quote is looked for as it is, then without leading bullets, then without one closing mark (and with its bullets)."""
    text, places = folded(source)
    base, _ = folded(quote)
    for q in (base, base.lstrip(BULLETS), base[:-1] if base.endswith(tuple(ENDS)) else ""):
        if q and (at := text.find(q)) >= 0:
            return places[at], places[at + len(q) - 1] + 1
    return None


def align_quote():
    """align() as a function of (source, quote) columns."""

    @F.pandas_udf("start int, stop int")
    def run(sources: pd.Series, quotes: pd.Series) -> pd.DataFrame:
        found = [align(s, q) if s is not None and q is not None else None for s, q in zip(sources, quotes)]
        return pd.DataFrame([f or (None, None) for f in found], columns=["start", "stop"]).astype("Int64")

    return run


def first_paragraph(text: Column) -> Column:
    """The first paragraph that is not blank, stripped; empty if there is none. Paragraphs end at blank lines."""
    said = F.filter(F.transform(F.split(text, BLANK_LINE), strip), lambda p: p != "")
    return F.when(text.isNotNull(), F.coalesce(F.get(said, F.lit(0)), F.lit("")))


def near(a: Column, b: Column, most: int = 2) -> Column:
    """Whether the edit distance is at most `most`, given up early beyond it."""
    return F.levenshtein(a, b, most) >= 0


#: Kinds of characters by their first byte: tokens by themselves, in words, blank.
ALONE, IN_WORD, EMPTY = range(3)
KINDS = np.full(256, ALONE, np.uint8)
KINDS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = IN_WORD
KINDS[[9, 10, 32]] = EMPTY
#: Bytes of text whose tokens are found at a time (a longer text is by itself).
STRETCH = 1 << 22


def found_tokens(texts: pa.Array) -> pa.Array:
    """token_offsets() of an Arrow column of strings: their bytes are read in one pass, not token by token."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data or b"", np.uint8)
    counts, starts, stops, i = [], [], [], 0
    while i < len(texts):
        j = min(max(i + 1, int(np.searchsorted(at, at[i] + STRETCH, "right")) - 1), len(texts))
        part = raw[at[i] : at[j]]
        lead = (part & 0xC0) != 0x80  # each character's first byte
        ends = np.r_[0, np.cumsum(lead)][at[i : j + 1] - at[i]]  # of texts, in characters
        kind = KINDS[part[lead]]
        word = kind == IN_WORD
        joined = word[1:] & word[:-1]  # with the character before it
        inner = ends[(ends > 0) & (ends < len(kind))]
        joined[inner - 1] = False
        solid = kind != EMPTY
        first, last = (np.flatnonzero(x) for x in (solid & ~np.r_[False, joined][: len(kind)], solid & ~np.r_[joined, False][: len(kind)]))
        many = np.diff(np.searchsorted(first, ends))
        base = np.repeat(ends[:-1], many)
        counts.append(many)
        starts.append((first - base).astype(np.int32))
        stops.append((last + 1 - base).astype(np.int32))
        i = j
    counts, starts, stops = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (counts, starts, stops))
    pairs = pa.StructArray.from_arrays([pa.array(starts), pa.array(stops)], ["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pairs, mask=pa.array(counts == 0))


def token_offsets(text: Column) -> Column:
    """array of struct start, stop in code points of the text's tokens: runs of ASCII letters and digits, and every other
    character but blanks, tabs and line ends by itself. Null where there are none. A row stays where it is."""

    @F.arrow_udf("array<struct<start:int,stop:int>>")
    def run(texts: pa.Array) -> pa.Array:
        return found_tokens(texts)

    return run(text)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often it is used: expressions in lambdas share nothing."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def token_span(text: Column, offsets: Column, start: Column, stop: Column, quote: Column | None = None) -> Column:
    """struct(first, stop) of the tokens that text[start:stop] is made of, by index in offsets; null where that is not exact.

    offsets: array of struct start, stop in code points, in the order of the text; a field `sequence` may say which text a
    token is of (0: this one, null: none). Both ends are found by binary search among the tokens that hold text of
    sequence 0. Exact means: the bounds lie in the text (and hold the quote, where one is given), the tokens cover the whole
    span, and what they cover beyond it is white space.
    """
    own = F.transform(offsets, lambda t, i: F.struct(i.alias("i"), t["start"].cast("int").alias("a"), t["stop"].cast("int").alias("b")))
    return bound(F.filter(own, lambda t: t["a"] < t["b"]), lambda own: _token_span(text, own, start, stop, quote))


def own_tokens(offsets: Column) -> Column:
    """offsets (array of struct start, stop, sequence) with the tokens of other texts emptied, so that they count for none."""
    return F.transform(offsets, lambda t: F.struct(t["start"].alias("start"), F.when(t["sequence"] == 0, t["stop"]).otherwise(t["start"]).alias("stop")))


def _token_span(text: Column, own: Column, start: Column, stop: Column, quote: Column | None) -> Column:
    def search(before) -> Column:
        """How many tokens in a row, from the first, are `before`: an array of n tokens is halved 31 times at most."""

        def step(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
            yes = before(F.get(own, mid))
            open_ = acc["lo"] < acc["hi"]
            return F.struct(F.when(open_ & yes, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~yes, mid).otherwise(acc["hi"]).alias("hi"))

        halvings = F.sequence(F.lit(0), F.floor(F.log2(F.size(own) + 1)).cast("int"))
        return F.aggregate(halvings, F.struct(F.lit(0).alias("lo"), F.size(own).alias("hi")), step, lambda acc: acc["lo"])

    def told(at: Column) -> Column:
        first, after = at["first"], at["after"]
        left, right = F.get(own, first)["a"], F.get(own, after - 1)["b"]
        part = lambda a, b: F.substring(text, a + 1, b - a)
        ok = (start >= 0) & (start < stop) & (stop <= F.char_length(text)) & (first < after) & (left <= start) & (right >= stop)
        ok &= (strip(part(left, start)) == "") & (strip(part(stop, right)) == "")
        if quote is not None:
            ok &= quote.isNull() | (part(start, stop) == quote)
        return F.when(ok, F.struct(F.get(own, first)["i"].alias("first"), (F.get(own, after - 1)["i"] + 1).alias("stop")))

    return bound(F.struct(search(lambda t: t["b"] <= start).alias("first"), search(lambda t: t["a"] < stop).alias("after")), told)


def tokenizer_offsets(path: str):
    """A function of a string column: array of struct start, stop of the tokens that a tokenizer file makes of the text."""

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def run(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        found = tokenizer.encode_batch(["" if t is None else t for t in texts], add_special_tokens=False)
        return pd.Series([None if t is None else [{"start": a, "stop": b} for a, b in e.offsets] for t, e in zip(texts, found)])

    return run


def canonical(value: object, ascii_only: bool = False, sort: bool = True) -> str:
    return json.dumps(value, sort_keys=sort, ensure_ascii=ascii_only, separators=(",", ":"), default=str)


def digest(value: object, ascii_only: bool = False) -> str:
    return sha256(canonical(value, ascii_only).encode()).hexdigest()


def canonical_json(ascii_only: bool = False, sort: bool = True):
    """A function of a JSON string column: no spaces, keys sorted (or as given), other characters kept (or escaped)."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else canonical(json.loads(t), ascii_only, sort))

    return run
