"""Filings as HTML: byte-positioned marks, blocks of prose, headings and tables, and the sections they make."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clean, language

# What is left out, what makes a block, boilerplate marks and penalties.
HIDDEN = frozenset(("head", "header", "nav", "script", "style", "footer", "ix:hidden"))
PROSE = frozenset(("blockquote", "div", "li", "p", "pre"))
TITLES = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BOILERPLATE = ("forward-looking statement", "pursuant to the requirements", "safe harbor", "signature")
PENALTIES = {"low_text_density": 0.20, "malformed_html": 0.25, "missing_headings": 0.15, "no_text": 1.00}
ITEM = re.compile(r"item\s+\d+(?:\.\d+)?\b", re.IGNORECASE)
LONGEST_ITEM, LEAST_DENSITY = 180, 0.005

#: A document's sections, as the normaliser returns them.
SECTIONS = "array<struct<section_id string, heading string, text string, source_start int, source_end int, is_table boolean, is_boilerplate boolean>>"

MARK = re.compile(rb"""<!--.*?(?:-->|\Z) | <[!?][^>]*(?:>|\Z) | <(?P<shut>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)""", re.S | re.X)
FIELD = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
BOLD = re.compile(r"font-weight:(?:bold|[6-9]00)")


class Mark(NamedTuple):
    """A tag, or the text between two tags (name ""), and the bytes it stands in."""

    start: int
    stop: int
    name: str
    shut: bool = False
    empty: bool = False
    style: str = ""
    text: str = ""


class Block(NamedTuple):
    kind: str
    start: int
    stop: int
    text: str


def marks(raw: bytes) -> Iterator[Mark]:
    """Tags and texts of a document in order; text is UTF-8 where the whole document is, else windows-1252."""
    try:
        raw.decode("utf-8")
        code = "utf-8"
    except UnicodeDecodeError:
        code = "windows-1252"
    at = 0
    while at < len(raw):
        m = MARK.search(raw, at)
        stop = m.start() if m else len(raw)
        if stop > at:
            yield Mark(at, stop, "", text=unescape(raw[at:stop].decode(code, "replace")))
        if not m:
            return
        at = m.end()
        if m["name"]:
            name, rest = m["name"].decode("latin-1").lower(), m["rest"].decode("latin-1")
            fields = {k.lower(): v.strip("\"'") for k, v in FIELD.findall(rest)} if not m["shut"] and "=" in rest else {}
            yield Mark(m.start(), at, name, bool(m["shut"]), rest.rstrip().endswith("/"), unescape(fields.get("style", "")).replace(" ", "").lower())
            if name in ("script", "style") and not m["shut"]:  # their content holds no tags
                end = re.compile(rb"</" + name.encode() + rb"(?=[\s/>])", re.I).search(raw, at)
                at = end.start() if end else len(raw)


def visible(found: Iterator[Mark], broken: list[str]) -> Iterator[Mark]:
    """The marks outside hidden elements; an element hides up to its own end tag, others of its name counted in."""
    name, depth = "", 0
    for m in found:
        if depth:
            if m.name == name and not m.empty:
                depth += -1 if m.shut else 1
        elif m.name and not m.shut and not m.empty and (m.name in HIDDEN or "display:none" in m.style or "visibility:hidden" in m.style):
            name, depth = m.name, 1
        else:
            yield m
    if depth:
        broken.append(name)


def table_text(inside: list[Mark]) -> str:
    """Rows of a table, nested ones' too, as lines of cells parted by tabs; rows without text are left out."""
    rows: list[list[str]] = []
    row: list[str] | None = None
    cell: list[str] | None = None
    for m in inside:
        if not m.name:
            if cell is not None:
                cell.append(m.text)
        elif m.name in ("td", "th") and not m.empty:
            if m.shut and cell is not None:
                row = [] if row is None else row
                row.append(clean("".join(cell)))
            cell = None if m.shut else []
        elif m.name == "tr" and not m.empty:
            if m.shut and row is not None and any(row):
                rows.append(row)
            row = None if m.shut else []
    return "\n".join("\t".join(r) for r in rows)


def blocks(raw: bytes) -> tuple[list[Block], bool]:
    """The document's blocks in order, and whether its tags are broken.

    A block runs from its start tag to its end tag, to the next block's start (broken, but for a div), or to a table.
    Bold text makes its whole block a heading. Text outside blocks and tables is left out.
    """
    out: list[Block] = []
    broken: list[str] = []
    kind, name, start, parts = "", "", 0, []
    grid: list[Mark] = []
    level = 0

    def end(stop: int) -> None:
        nonlocal name
        if name and (text := clean("".join(parts))):
            out.append(Block(kind, start, stop, text))
        name = ""

    for m in visible(marks(raw), broken):
        if m.name == "table" and not m.empty:
            if not level and not m.shut:
                end(m.start)
                grid = [m]
            if level or not m.shut:
                level += -1 if m.shut else 1
                if not level and (text := table_text(grid)):
                    out.append(Block("table", grid[0].start, m.stop, text))
                if not level:
                    continue
        if level:
            grid.append(m)
        elif not m.name:
            if name:
                parts.append(m.text)
        elif m.shut:
            if m.name == name:
                end(m.stop)
        elif m.name == "br":
            if name:
                parts.append("\n")
        elif not m.empty:
            bold = m.name in ("b", "strong") or bool(BOLD.search(m.style))
            if name and bold:
                kind = "heading"
            if m.name in PROSE or m.name in TITLES:
                if name and name != "div":
                    broken.append(name)
                end(m.start)
                kind, name, start, parts = "heading" if bold or m.name in TITLES else "prose", m.name, m.start, []
    if name:
        broken.append(name)
        end(len(raw))
    if level:
        broken.append("table")
    return out, bool(broken)


def is_boilerplate(heading: Column, text: Column) -> Column:
    """Whether a section's heading and text hold one of the marks, in any case of letters."""
    both = F.lower(F.concat(F.coalesce(heading, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))
    out = F.lit(False)
    for mark in BOILERPLATE:
        out |= both.contains(mark)
    return out


def sections(found: list[Block]) -> list[dict]:
    """Prose under the heading before it, and each table by itself.

    Headings are heading blocks and short blocks that begin as an item does; under an item, other headings are prose. A
    table that begins as an item gives the heading itself.
    """
    out: list[dict] = []
    heading: str | None = None
    since: int | None = None
    prose: list[Block] = []

    def add(start: int, stop: int, text: str, table: bool) -> None:
        low = f"{heading or ''} {text}".casefold()
        out.append({"section_id": f"section_{len(out) + 1:03d}", "heading": heading, "text": text, "source_start": start, "source_end": stop, "is_table": table, "is_boilerplate": any(b in low for b in BOILERPLATE)})

    def close() -> None:
        nonlocal since
        if prose:
            add(prose[0].start if since is None else since, prose[-1].stop, "\n\n".join(b.text for b in prose), False)
            prose.clear()
            since = None

    for b in found:
        item = bool(ITEM.match(b.text))
        if b.kind == "table":
            close()
            if item:
                heading = clean(b.text.splitlines()[0])
            add(b.start, b.stop, b.text, True)
        elif b.kind == "heading" or item and len(b.text) <= LONGEST_ITEM:
            close()
            if heading and ITEM.match(heading) and not item:
                prose.append(b)
            else:
                heading, since = b.text, b.start
        else:
            prose.append(b)
    close()
    return out


def quality(warnings: list[str]) -> float:
    return max(0.0, 1.0 - sum(PENALTIES[w] for w in warnings))


def normalized(raw: bytes, kind: str) -> dict:
    """One filing document: whether it is an exhibit, its language, warnings, the quality they leave, and its sections."""
    found, broken = blocks(raw)
    made = sections(found)
    size = sum(len(s["text"]) for s in made)
    warnings = {"no_text": not made, "malformed_html": broken, "missing_headings": not any(s["heading"] for s in made), "low_text_density": bool(raw) and size / len(raw) < LEAST_DENSITY}
    names = sorted(w for w, on in warnings.items() if on)
    return {"is_exhibit": kind.casefold().startswith("ex-"), "language": language(" ".join(s["text"] for s in made)), "parsing_quality": quality(names), "warnings": names, "sections": made}


#: A worker holds the sections of so many filings at a time, however many rows Arrow gives it at once.
SLICE = 64


def normalize_filings(df: DataFrame, raw: str = "raw", kind: str = "document_type") -> DataFrame:
    """df (raw BINARY, document_type) with is_exhibit, language, parsing_quality, warnings and sections."""

    @F.pandas_udf(f"is_exhibit boolean, language string, parsing_quality double, warnings array<string>, sections {SECTIONS}")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for raws, kinds in batches:
            for i in range(0, len(raws), SLICE):
                made = [normalized(bytes(r or b""), k or "") for r, k in zip(raws[i : i + SLICE], kinds[i : i + SLICE])]
                yield pd.DataFrame(made, columns=["is_exhibit", "language", "parsing_quality", "warnings", "sections"])

    return df.withColumn("_n", run(raw, kind)).select("*", "_n.*").drop("_n")
