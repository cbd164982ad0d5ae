"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, trim

LETTER = regex.compile(r"\p{L}")
APART = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


#: Texts that are walked side by side while at least so many are left; the rest of the longest are walked one by one.
FEW = 48


#: Characters of texts that are coded and walked at a time, about; a longer text is alone.
AT_A_TIME = 6_000_000


def alphabet(texts: list[str]) -> dict[int, int]:
    """Codes from 1 for all characters of the texts, common ones first, for str.translate; every other character is 0."""
    return _Coding({ord(c): i for i, (c, _) in enumerate(sorted(Counter("".join(texts)).items(), key=lambda x: (-x[1], x[0])), 1)})


class _Coding(dict):
    def __missing__(self, c):
        return 0


class Automaton:
    """Suffix automaton of a coded text as one sparse table, however many characters there are.

    A state is a number of its own, and its step by a code is the table's entry at state + code, if that entry's upper
    half names the state; the lower half is the next state. States share the table's rows where their codes leave room.
    """

    def __init__(self, codes):
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            if not c:
                continue
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p != -1:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        number, size = self.placed(nexts)
        self.root = number[0]
        self.table = np.zeros(size, np.int64)
        for s, own in enumerate(nexts):
            for c, t in own.items():
                self.table[number[s] + c] = (number[s] << 32) | number[t]
        self.plain = memoryview(self.table)

    @staticmethod
    def placed(nexts: list[dict[int, int]]) -> tuple[list[int], int]:
        """A number above 0 for each state such that no two steps fall on one entry, and the table's size. States with many
        steps are placed first, at the first number that fits; those with one step fill what entries are free."""
        width = max((c for own in nexts for c in own), default=0) + 1
        most = 4 * len(nexts) + 2 * width + 64
        full, named = bytearray(most), bytearray(most)
        number, start, slot = [0] * len(nexts), 1, 1
        for s in sorted(range(len(nexts)), key=lambda s: (-len(nexts[s]), s)):
            own = nexts[s]
            if len(own) > 1:
                at = start
                while True:
                    if at + width >= len(full):
                        full += bytes(len(full))
                        named += bytes(len(named))
                    if not named[at]:
                        for c in own:
                            if full[at + c]:
                                break
                        else:
                            break
                    at += 1
                if at - start > 400:
                    start = at - 200
            else:
                c = next(iter(own), 0)
                slot = max(slot, c + 1)
                while True:
                    if slot + width >= len(full):
                        full += bytes(len(full))
                        named += bytes(len(named))
                    if not (own and full[slot]) and not named[slot - c]:
                        break
                    slot += 1
                at = slot - c
            number[s] = at
            named[at] = 1
            for c in own:
                full[at + c] = 1
        return number, max(number) + width + 1

    def phrases(self, codes, s: int | None = None, n: int = 0) -> int:
        """How many longest matches, one after another, cover the coded text; a character not in the text is one."""
        table, root = self.plain, self.root
        s = root if s is None else s
        for c in codes:
            e = table[s + c]
            if e >> 32 == s:
                s = e & 0xFFFFFFFF
            else:
                if s != root:
                    n += 1
                e = table[root + c]
                if e >> 32 == root:
                    s = e & 0xFFFFFFFF
                else:
                    s = root
                    n += 1
        return n + (s != root)


class Parser:
    """Automata of all languages over one coding of characters, and the phrases a character they need on text kept apart."""

    def __init__(self, model: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in model]
        self.coding = alphabet([text for _, text in model])
        self.parts: list[tuple[Automaton, float, float]] = []
        reach = 1
        for _, text in model:
            cut = len(text) * 4 // 5
            a = Automaton(self.coded(text[:cut]).tolist())
            own = text[cut:] or text
            self.parts.append((a, 0.0, math.log2(max(cut, 2))))
            reach = max(reach, len(self.coding) + 1)
            a.table = np.concatenate([a.table, np.zeros(max(0, a.root + reach - len(a.table)) + reach, np.int64)])
            a.plain = memoryview(a.table)
            self.parts[-1] = (a, max(a.phrases(self.coded(own).tolist()), 1) / max(len(own), 1), self.parts[-1][2])
        # All tables in one, with the states' numbers moved on by where their table begins.
        sizes = [len(a.table) for a, _, _ in self.parts]
        self.bases = np.cumsum([0, *sizes], dtype=np.int64)[:-1]
        moved = [np.where(a.table > 0, a.table + ((b << 32) | b), 0) for (a, _, _), b in zip(self.parts, self.bases.tolist())]
        self.table = np.concatenate([*moved, np.zeros(1, np.int64)])
        self.roots = np.array([b + a.root for (a, _, _), b in zip(self.parts, self.bases.tolist())], np.int64)
        trim()

    def all_phrases(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """phrases of many texts (flat codes; size in falling order) in all languages, [language, text].

        Texts and languages are walked side by side, a character of each at a time, while at least FEW texts are left.
        """
        table, k = self.table, len(self.parts)
        n, s = np.zeros((k, len(size)), np.int64), np.repeat(self.roots[:, None], len(size), 1)
        pos, live, low = 0, int(np.count_nonzero(size)), np.int64(0xFFFFFFFF)
        while live >= FEW:
            stop = int(size[live - 1])
            state, count, base = s[:, :live].ravel(), n[:, :live].ravel(), np.repeat(self.roots, live)
            at = start[:live] + pos
            for _ in range(pos, stop):
                c = np.tile(flat[at], k)
                e = table[state + c]
                t = e & low
                lost = np.flatnonzero(e >> 32 != state)
                if len(lost):
                    root = base[lost]
                    e = table[root + c[lost]]
                    again = e >> 32 == root
                    count[lost] += (state[lost] != root).astype(np.int64) + ~again
                    t[lost] = np.where(again, e & low, root)
                state = t
                at += 1
            s[:, :live], n[:, :live] = state.reshape(k, live), count.reshape(k, live)
            pos = stop
            live = int(np.searchsorted(-size, -pos, "left"))
        out = n + (s != self.roots[:, None])
        for i in range(live):
            rest = flat[start[i] + pos : start[i] + size[i]].tolist()
            for j, (a, _, _) in enumerate(self.parts):
                out[j, i] = a.phrases(rest, int(s[j, i] - self.bases[j]), int(n[j, i]))
        return out

    def coded(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.translate(self.coding).encode("utf-32-le", "surrogatepass"), np.uint32)
        return codes.astype(np.uint16 if len(self.coding) < 1 << 16 else np.uint32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        return [t[:2] for t in self.judge(texts, [None] * len(texts))]

    def judge(self, texts: list[str | None], labels: list[str | None]) -> list[tuple[str, float, float | None]]:
        """(language, score, against) of each text: against is how many times as many normalised phrases the text needs in
        its label's language as in the one predicted; None where the label is none that was learned."""
        out: list[tuple[str, float, float | None]] = [(UNKNOWN, 0.0, None)] * len(texts)
        at = {lang: k for k, lang in enumerate(self.langs)}
        known = [i for i, t in enumerate(texts) if t is not None and self.langs and LETTER.search(t)]
        if not known:
            return out
        codes = [self.coded(APART.sub(" ", texts[i].lower())) for i in known]
        size = np.array([len(c) for c in codes], np.int64)
        order = np.argsort(-size, kind="stable")
        flat = np.concatenate(codes)
        start = (np.cumsum(size) - size)[order]
        counts = np.empty((len(self.parts), len(known)))
        counts[:, order] = self.all_phrases(flat, start, size[order])
        for j, i in enumerate(known):
            raw = [counts[k, j] / rate for k, (_, rate, _) in enumerate(self.parts)]
            best = min(range(len(raw)), key=lambda k: (raw[k], self.langs[k]))
            _, rate, bits = self.parts[best]
            spread = sum(2.0 ** -min(1000.0, (n - raw[best]) * rate * bits) for n in raw)
            k = at.get(labels[i])
            out[i] = (self.langs[best], 1.0 / spread, None if k is None else float(raw[k] / raw[best]) if raw[best] else 1.0)
        return out


@lru_cache(maxsize=1)
def parser(model: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(model)


def train(df: DataFrame, learns: Column, text_col: str = "text", lang_col: str = "lang", chars: int = 40_000, of_a_text: int = 2_000) -> tuple[tuple[str, str], ...]:
    """The model: for each language about `chars` characters of its labelled texts, lower-cased, at most `of_a_text` of
    each text. The bound is on the learner's sample alone and is the same for any input; the texts are distinct ones with
    the smallest hashes of their content, so copies change nothing and each language with a text that holds a letter is
    learned. The languages' samples and a table of 30 sizes a language are all that the driver holds."""
    learned = df.where(learns & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    head = F.lower(F.substring(text_col, 1, of_a_text))
    rows = learned.select(F.col(lang_col).alias("lang"), head.alias("text")).where(F.col("text").rlike(r"\p{L}"))
    # Distinct texts by their hash: each one's characters count once, in the bucket of its hash's highest bit.
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    texts = rows.groupBy("lang", F.xxhash64("text").alias("key"), h.alias("h")).agg(F.max(F.char_length("text")).alias("n"))
    bucket = F.length(F.bin("h")).cast("int")  # h < 2 ** bucket
    sizes = sorted((r["lang"], r["b"], r["n"]) for r in texts.groupBy("lang", bucket.alias("b")).agg(F.sum("n").alias("n")).collect())
    if not sizes:
        return ()
    below: dict[str, int] = {}
    total: dict[str, int] = {}
    for lang, b, n in sizes:  # the smallest hashes, up to the first bucket with three times the characters
        if total.setdefault(lang, 0) < 3 * chars:
            below[lang] = 1 << b
        total[lang] += n
    most = F.element_at(F.create_map(*[F.lit(x) for pair in below.items() for x in pair]), F.col("lang"))
    sample = rows.where(h < most).select("lang", "text").distinct().collect()
    out = []
    for lang in sorted(total):
        text, own = "", sorted((r["text"] for r in sample if r["lang"] == lang), key=hash_order)
        for t in own:
            if len(text) >= chars:
                break
            text += APART.sub(" ", t) + " "
        if text:
            out.append((lang, text[:chars]))
    return tuple(out)


def hash_order(text: str) -> tuple:
    import hashlib

    return hashlib.md5(text.encode()).digest(), text


def identify(df: DataFrame, model: tuple[tuple[str, str], ...], text_col: str = "text", label_col: str | None = None) -> DataFrame:
    """df with lang_pred string and score double, and with label_col also against double: how many times as many phrases
    the text needs in its label's language as in the one predicted (null for labels that were not learned).

    Letters alone are compared, lower-cased; whatever stands between them counts as one space. The whole text is cut, for each language, into the longest phrases that the language's labelled text holds (walked
    on its suffix automaton); the phrases are divided by those the language needs on text of its own that its automaton
    has not seen, and the language with the smallest quotient wins. The score is the winner's share when each phrase
    counts with its code length (log2 of the automaton's text), between 0 and 1.

    Only the model's texts (40,000 characters a language) travel to the executors, which build the automata once for
    each worker. Defined cases: null text, text without a letter and an empty model give `und` with score 0; ties go to
    the language first by name; empty tables give empty results; columns named as the results are replaced.
    """

    told = ["lang_pred", "score", "against"]

    @F.pandas_udf("lang_pred string, score double, against double")
    def predicted(texts: pd.Series, labels: pd.Series) -> pd.DataFrame:
        p, rows = parser(model), []
        ends = np.cumsum([0, *(len(t) if t is not None else 0 for t in texts)])
        i = 0
        while i < len(texts):  # bounds what is held beside the batch
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + AT_A_TIME, "right")) - 1)
            rows += p.judge(texts.iloc[i:j].tolist(), labels.iloc[i:j].tolist())
            trim()
            i = j
        return pd.DataFrame(rows, columns=told)

    # Else a filter on the results is pushed below and every text is walked twice, by two workers a task.
    predicted = predicted.asNondeterministic()
    kept = told if label_col else told[:2]
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    out = df.drop(*kept) if label_col not in kept else df
    (pair,) = fresh(out.columns, "pair")
    out = out.withColumn(pair, predicted(F.col(text_col), label)).drop(*kept)
    return out.select("*", *[f"{pair}.{c}" for c in kept]).drop(pair)


def lettered(text: Column) -> Column:
    """Whether a text holds a letter, and so gets a language from any model that is not empty; false for null."""

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([t is not None and LETTER.search(t) is not None for t in texts], dtype=bool)

    return found(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 by 4; false for a null id, from which nothing is learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
