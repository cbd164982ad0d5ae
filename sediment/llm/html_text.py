"""Main text of web pages: mark-up says what may be the article, and host suffix arrays what repeats across pages."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, join_hot, numbered, stored, trim
from .words import mixed

# Names of elements and words of class, id and role that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style title textarea iframe noembed noframes noscript template svg math canvas object audio video xmp".split())
CHROME = frozenset("nav footer aside form button select dialog menu head datalist search".split())
CHROME_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
IN_MENU = frozenset("nav ul ol li a span b p".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
#: First and last parts of class names that tell a page's or an element's state, and elements that no class makes chrome.
STATES = frozenset("has no with without is not hide hides open closed on off active enabled disabled visible allowed layout page".split())
NEVER = frozenset("html body main article".split())
#: Words of regions in which an article is not the page's own.
OTHERS_ARTICLES = frozenset("comment comments commentlist disqus replies reply respond related recommended teaser promo promoted promotion ad ads advert adverts advertisement sponsor sponsored widget widgets".split())
#: Elements whose content is never text, up to the page's end where they are not closed; others count as closed there.
OPEN_ENDED = frozenset("script style title textarea iframe noembed noframes noscript xmp".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
PART = re.compile(r"[A-Za-z]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}
MAIN, OPEN, OTHER = 2, 1, 0


def _class_words(value: str) -> set[str]:
    """First and last parts of each class name or id; none of one that tells a state (has-sidebar, comments-open)."""
    out = set()
    for name in value.lower().split():
        parts = PART.findall(name)
        if parts and not (len(parts) > 1 and (parts[0] in STATES or parts[-1] in STATES)):
            out |= {parts[0], parts[-1]}
    return out


def _marks(name: str, attrs: str, inside: bool) -> tuple[int, bool]:
    """OTHER, OPEN or MAIN for an element that starts, given whether it starts inside the article; and, for OTHER, whether
    an article in it is another one (a comment, a teaser) or the page's own after all."""
    if name in CHROME or name == "header" and not inside:
        return OTHER, name not in ("header", "form")
    kind = MAIN if name in ("article", "main") else OPEN
    if "=" not in attrs and "hidden" not in attrs:
        return kind, False
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attrs)}
    bare = ATTRIBUTE.sub(" ", attrs).lower().split()
    if "hidden" in bare or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return OTHER, True
    role = found.get("role", "").lower()
    if role in CHROME_ROLES:
        return OTHER, True
    words = _class_words(f"{found.get('class', '')} {found.get('id', '')}") if name not in NEVER else set()
    if words & CHROME_WORDS or not inside and words & HEADER_WORDS:
        return OTHER, bool(words & OTHERS_ARTICLES)
    return MAIN if role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody" else kind, False


def blocks(html: str) -> list[tuple[int, str]]:
    """(kind, text) of every block with text, in page order; kind: MAIN, OPEN or OTHER.

    Where a page has an article, what stands outside it (in a `main` too) is OPEN. Tags need not be closed or nested
    well: an end tag closes all that was opened since its start, one without a start is passed over.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, int]] = []  # name, kind of what is inside, whether article (2) or main (1)
    parts: list[str] = []
    kind, level, pos, top, foreign = OPEN, 0, 0, 0, False

    def close():
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append((kind * 4 + level, text))
            parts.clear()

    for m in iter(lambda: TAG.search(html, pos), None):
        if m.start() > pos:
            seg = html[pos : m.start()]
            parts.append(unescape(seg) if "&" in seg else seg)
        pos = m.end()
        name = m[2]
        if not name:
            continue
        name, attrs = name.lower(), m[3]
        if attrs.count('"') % 2 and (q := html.find('"', pos)) >= 0 and (e := html.find(">", q)) >= 0:
            attrs, pos = html[m.start(3) : e], e + 1
        if name in BLOCK:
            close()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if any(s[0] in BLOCK for s in stack[i:]):
                        close()
                    del stack[i:]
                    kind, level = (stack[-1][1], stack[-1][2]) if stack else (OPEN, 0)
                    break
            continue
        if name in RAW:
            end = RAW_END[name].search(html, pos)
            pos = end.end() if end else len(html) if name in OPEN_ENDED else pos
            continue
        if name in VOID:
            if name == "br":
                parts.append(" ")
            continue
        if name == "article" and (i := next((i for i, s in enumerate(stack) if s[0] == "nav"), None)) is not None and all(s[0] in IN_MENU for s in stack[i:]):
            del stack[i:]  # a menu that was never closed
            kind, level = (stack[-1][1], stack[-1][2]) if stack else (OPEN, 0)
        own, others = _marks(name, attrs, level > 0)
        if kind == OTHER and own == MAIN and not foreign:  # a wrapper that only looked like chrome
            kind = OPEN
        if own == OTHER and kind != OTHER or kind == OTHER:
            close()
            foreign = others if kind != OTHER else foreign or others
            new = OTHER
        elif own == MAIN:
            close()
            new, level = MAIN, max(level, 1 if name == "main" else 2)
        else:
            new = kind
        kind = new
        stack.append((name, kind, level))
    if pos < len(html):
        seg = html[pos:]
        parts.append(unescape(seg) if "&" in seg else seg)
    close()
    top = max((x % 4 for x, _ in out if x // 4 == MAIN), default=0)
    return [(OTHER if x // 4 == OTHER else MAIN if top and x // 4 == MAIN and x % 4 == top else OPEN, t) for x, t in out]


def suffix_array(tokens: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of int tokens by prefix doubling, and the ranks by the first 1, 2, 4, ... tokens; with depth the
    suffixes are ordered by that many tokens or more, and not by all."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    ranks, k = [rank], 1
    order = np.argsort(rank, kind="stable")
    while k < min(n, depth or n) and rank[order[-1]] + 1 < n:
        second = np.zeros(n, np.int64)
        second[:-k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, s[1:] != s[:-1]])
        ranks.append(rank)
        k *= 2
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix of the array with the one before it."""
    n = len(order)
    a, b, out = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    for m in range(len(ranks) - 1, -1, -1):
        step = 1 << m
        ok = (a + step <= n) & (b + step <= n)
        same = np.zeros(n - 1, bool)
        same[ok] = ranks[m][a[ok]] == ranks[m][b[ok]]
        a[same] += step
        b[same] += step
    out[1:] = a - order[:-1]
    return out


def flattened(streams: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The pages' token streams one after another, each closed by a separator of its own: numbers of tokens, pages, and
    the distinct tokens."""
    ids: dict[str, int] = {}
    flat, page = [], []
    for p, stream in enumerate(streams):
        flat += [ids.setdefault(t, len(ids)) for t in stream]
        flat.append(-1 - p)  # a separator that no other page has
        page += [p] * (len(stream) + 1)
    return np.array(flat, np.int64), np.array(page, np.int64), list(ids)


def run_hashes(tokens: np.ndarray, names: list[str], at: np.ndarray, min_tokens: int) -> np.ndarray:
    """128-bit hashes, as two longs a row, of the `min_tokens` tokens from each place; the same in every group of a host."""
    digests = b"".join(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in names)
    of = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    out = np.zeros((len(at), 2), np.uint64)
    for j in range(min_tokens):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + of[tokens[at + j]])
    return out.view(np.int64)


def block_hashes(texts: list[str]) -> np.ndarray:
    """128-bit hashes of whole blocks, as two longs a row."""
    digests = b"".join(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16, person=b"whole block").digest() for t in texts)
    return np.frombuffer(digests, np.int64).reshape(-1, 2)


def whole_runs(tokens: np.ndarray, min_tokens: int) -> np.ndarray:
    """Places from which `min_tokens` tokens of one page follow."""
    n = len(tokens)
    if n < min_tokens:
        return np.zeros(0, np.int64)
    breaks = np.r_[0, np.cumsum(tokens < 0)]
    return np.flatnonzero(breaks[min_tokens:] == breaks[: n - min_tokens + 1])


def group_runs(streams: list[list[str]], min_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct run of `min_tokens` tokens in the pages' streams: its hashes, and how many pages have it."""
    tokens, page, names = flattened(streams)
    whole = np.zeros(len(tokens), bool)
    whole[whole_runs(tokens, min_tokens)] = True
    if not whole.any():
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    order, ranks = suffix_array(tokens, min_tokens)
    lcp = common_prefixes(order, ranks)
    run = np.cumsum(lcp < min_tokens) - 1
    keep = whole[order]  # all suffixes of a run, or none
    at = order[keep]
    found, first, run = np.unique(run[keep], return_index=True, return_inverse=True)
    pages = np.bincount(np.unique(run * len(streams) + page[at]) // len(streams), minlength=len(found))
    return run_hashes(tokens, names, at[first], min_tokens), pages


def covered(streams: list[list[str]], hits: np.ndarray, min_tokens: int) -> list[np.ndarray]:
    """For each page's token stream, which tokens lie in a run of `min_tokens` tokens whose hashes are among `hits`."""
    tokens, _, names = flattened(streams)
    n = len(tokens)
    mark = np.zeros(n + 1, np.int64)
    at = whole_runs(tokens, min_tokens)
    if len(at) and len(hits):
        pair = np.dtype([("a", np.int64), ("b", np.int64)])
        as_pairs = lambda h: np.ascontiguousarray(h).view(pair).ravel()
        hit = at[np.isin(as_pairs(run_hashes(tokens, names, at, min_tokens)), as_pairs(hits))]
        np.add.at(mark, hit, 1)
        np.add.at(mark, hit + min_tokens, -1)
    inside = np.cumsum(mark[:n]) > 0
    ends = np.cumsum([len(s) + 1 for s in streams])
    return [inside[e - len(s) - 1 : e - 1] for e, s in zip(ends, streams)]


def unique_runs(block: list[str], inside: np.ndarray, min_tokens: int) -> list[str]:
    """A block's words without its covered runs; a shorter covered run goes only with the whole block, as it may just be
    the end of a run that began in another block."""
    if inside.all():
        return []
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    gone = np.zeros(len(block), bool)
    for a, b in zip(edge[::2], edge[1::2]):
        gone[a:b] = b - a >= min_tokens
    return [w for w, g in zip(block, gone) if not g]


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_tokens: int = 6, min_pages: int = 3, group_pages: int = 400, group_chars: int = 8_000_000) -> DataFrame:
    """The main text of each page: blocks in page order, joined by one \\n.

    Mark-up says what a block can be. Scripts, styles, comments, menus, headers, footers, sidebars, forms, adverts, notices
    and reader comments go. Of a page that marks its article (article, else main), the article's blocks are candidates; of
    any other page all open blocks are. The token streams of what all pages of a host have outside their articles, also of
    what goes, are concatenated, and suffix arrays find the runs of `min_tokens` words or more that `min_pages` distinct
    pages have there: the host's boilerplate. It decides on every page: tokens it covers leave open blocks, and a block of
    an article goes where the whole of it stands outside articles on so many pages. Passages that only articles share
    (licences, quotes) stay.

    Columns: id, url, text, n_chars long. Hosts are dealt into groups of about `group_pages` pages or `group_chars`
    characters by hash of the page's number, so a host with a third of all pages is many groups. Each group's suffix array
    finds its runs and their pages; the pages of a run are added up over all groups of the host by a 128-bit hash, so
    groups change the work and never the text. Only streams outside articles and hashes are shuffled; the pages are parsed
    a second time rather than kept.

    Defined cases: null html is empty and gives an empty text; a null or odd url belongs to the host ''; repeated rows are
    kept, each a page of its own; other columns are not read; an empty table gives an empty result.
    """
    (row,) = fresh(df.columns, "row")
    html = F.coalesce(F.col(html_col), F.lit(""))
    pages = numbered(df, row).select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))

    def parse(batches):
        for b in batches:
            found = [blocks(h.as_py()) for h in b.column(2)]
            around = [[t for k, t in f if k != MAIN] for f in found]
            own = [block_hashes([t for k, t in f if k == MAIN and t.count(" ") + 1 >= min_tokens]) for f in found]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            flat = np.concatenate([np.zeros((0, 2), np.int64), *own])
            whole = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(2)], ["h1", "h2"]))
            yield pa.record_batch(
                [
                    b.column(0), b.column(1), pa.array([any(k == MAIN for k, _ in f) for f in found], pa.bool_()),
                    pa.array([[k for k, _ in f if k != MAIN] for f in found], pa.list_(pa.int32())), pa.array(around, pa.list_(pa.string())),
                    pa.array([sum(map(len, t)) for t in around], pa.int64()), whole,
                ], ["row", "host", "marked", "kinds", "texts", "chars", "whole"],
            )
        trim()

    streams = pages.select("row", host.alias("host"), "html").mapInArrow(parse, "row long, host string, marked boolean, kinds array<int>, texts array<string>, chars long, whole array<struct<h1 long, h2 long>>")
    streams = stored(streams, "page-streams")
    hosts = stored(streams.groupBy("host").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars_of_host")), "hosts")
    groups = F.greatest(F.ceil(F.col("pages") / group_pages), F.ceil(F.col("chars_of_host") / group_chars))
    dealt = join_hot(streams.drop("whole"), hosts, "host", "pages", "inner").withColumns({"g": F.pmod(F.xxhash64("row"), groups), "alone": groups == 1})

    def find(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h, n = group_runs([[w for t in page for w in t.split(" ")] for page in pdf["texts"]], min_tokens)
        around = Counter()
        for page in pdf["texts"]:
            around.update({t for t in page if t.count(" ") + 1 >= min_tokens})
        h, n = np.concatenate([h, block_hashes(list(around))]), np.concatenate([n, np.array(list(around.values()), np.int64)])
        if pdf["alone"].iloc[0]:  # the group is the host
            h, n = h[n >= min_pages], n[n >= min_pages]
        return pd.DataFrame({"host": key[0], "g": key[1], "h1": h[:, 0], "h2": h[:, 1], "n": n})

    runs = stored(dealt.select("host", "g", "texts", "alone").groupBy("host", "g").applyInPandas(find, "host string, g long, h1 long, h2 long, n long"), "host-runs")
    run = ["host", "h1", "h2"]
    hits = runs.groupBy(*run).agg(F.sum("n").alias("n"), F.count("*").alias("many")).where(F.col("n") >= min_pages).select(*run, "many")
    hits = stored(hits, "boilerplate-runs")
    told = join_hot(runs.drop("n"), hits, run, "many", "inner").select("host", "g", "h1", "h2")

    def keep(key: tuple, pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:  # a group in which all pages mark their article
            return pd.DataFrame([], columns=["row", "kept"])
        words = [[t.split(" ") for t in page] for page in pdf["texts"]]
        marks = covered([[w for block in page for w in block] for page in words], told[["h1", "h2"]].to_numpy(np.int64), min_tokens)
        out = []
        for kinds, page, inside in zip(pdf["kinds"], words, marks):
            at, lines = 0, []
            for kind, block in zip(kinds, page):
                if kind == OPEN and (left := unique_runs(block, inside[at : at + len(block)], min_tokens)):
                    lines.append(" ".join(left))
                at += len(block)
            out.append("\n".join(lines))
        return pd.DataFrame({"row": pdf["row"], "kept": out})

    bare = dealt.where(~F.col("marked")).select("host", "g", "row", "kinds", "texts").groupBy("host", "g")
    kept = stored(bare.cogroup(told.groupBy("host", "g")).applyInPandas(keep, "row long, kept string"), "unmarked-pages")
    # Blocks of articles that are boilerplate as a whole; a notice in a third of all articles is a hot key.
    own = stored(streams.select("row", "host", F.explode("whole").alias("w")).select("row", "host", "w.*").join(hits.select(*run), run, "left_semi"), "article-boilerplate")
    gone = own.groupBy("row").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    discard(runs, hosts)

    @F.pandas_udf("string")
    def article(htmls: pd.Series, gone: pd.Series) -> pd.Series:
        def main(h, gone):
            found = [t for k, t in blocks(h) if k == MAIN]
            if found and gone is not None:
                out = {(g["h1"], g["h2"]) for g in gone}
                long = [t.count(" ") + 1 >= min_tokens for t in found]
                found = [t for t, big, x in zip(found, long, block_hashes(found).tolist()) if not (big and tuple(x) in out)]
                return "\n".join(found)
            return "\n".join(found) if found else None

        return pd.Series([main(h, g) for h, g in zip(htmls, gone)], dtype=object)

    if own.isEmpty():
        pages = pages.withColumn("gone", F.lit(None).cast("array<struct<h1 long, h2 long>>"))
    else:
        pages = pages.join(gone, "row", "left")
    out = pages.withColumn("main", article("html", "gone")).select("row", "id", "url", "main")
    if not kept.isEmpty():
        out = out.join(kept, "row", "left").withColumn("main", F.coalesce("main", "kept"))
    out = out.select("id", "url", F.coalesce("main", F.lit("")).alias("text"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
