"""License scans: places of phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coded import STRETCH, Coded, byte_class, raw_bytes, stretches
from .common import stored, trim

#: Bytes of words once A-Z are lower-cased (digits, a-z, all of what is not ASCII).
IN_WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
NONE = byte_class()

#: Phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices of well-known licenses, as their texts ask for them, and the labels that they give.
TEMPLATES = [
    ("mit-notice", "Released under the MIT License"),
    ("mit-notice", "Licensed under the MIT License"),
    ("mit-notice", "Distributed under the terms of the MIT License"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit-text", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-text", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-text", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "Licensed under the GNU General Public License"),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-text", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("lgpl-notice", "Licensed under the GNU Lesser General Public License"),
    ("bsd-notice", "Licensed under the BSD 3-Clause License"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-text", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-text", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense-text", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
]


def words_of(text: str) -> list[str]:
    """The words of a short text, as the contract has them."""
    coded = Coded(np.frombuffer(text.encode(), np.uint8), IN_WORD)
    return [coded.words[c].decode() for c in coded.codes]


def window_of(n: int) -> int:
    """Words of the blocks for a template of n words: a power of two such that any n words in a row lie in one block, as
    blocks begin at every half of it."""
    half = 4
    while half + 1 < n:
        half *= 2
    return 2 * half


class Templates:
    """Templates as sets: label, window, and tokens; ids are numbers of the vocabulary's words in code-point order."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        texts = [(label, words_of(text)) for label, text in templates]
        self.vocabulary = sorted({w for _, ws in texts for w in ws})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.rows = []
        for t, (label, ws) in enumerate(texts):
            tokens = sorted({number[w] for w in ws})
            # the smallest overlap whose share of the template reaches the threshold
            least = next(o for o in range(1, len(tokens) + 1) if o / len(tokens) >= threshold)
            self.rows.append((t, label, window_of(len(ws)), tokens, least))


class Tokens:
    """Words of a batch that are in the vocabulary: doc (row of the batch), number (from 0 in its document) and token, in
    order; words has each document's number of words. Texts end in a line break each and are coded in stretches."""

    def __init__(self, column: pa.Array, vocabulary: dict[bytes, int], size: int = STRETCH):
        raw, ends = raw_bytes(column)
        docs, places, tokens, total = [], [], [], 0
        self.words = np.zeros(len(ends), np.int64)
        for start, stop, seen in stretches(raw, IN_WORD, NONE, 1, size):
            coded = Coded(raw[start:stop], IN_WORD)
            own = coded.codes[seen:]
            doc = np.searchsorted(ends, coded.starts[seen:] + start, "right")
            self.words += np.bincount(doc, minlength=len(ends))
            token = np.fromiter((vocabulary.get(w, -1) for w in coded.words), np.int64, len(coded.words))[own]
            at = np.flatnonzero(token >= 0)
            docs.append(doc[at])
            places.append(at + total)
            tokens.append(token[at])
            total += len(own)
        one = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.doc, self.place, self.token = one(docs), one(places), one(tokens)
        self.number = self.place - (np.cumsum(self.words) - self.words)[self.doc]

    def phrase(self, phrase: list[int]) -> np.ndarray:
        """Where the phrase's words stand one after another in a document."""
        n = len(self.token) - len(phrase) + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        ok = self.doc[:n] == self.doc[len(phrase) - 1 :]
        for i, token in enumerate(phrase):
            ok &= (self.token[i : n + i] == token) & (self.place[i : n + i] == self.place[:n] + i)
        return np.flatnonzero(ok)

    def blocks(self, window: int, rank: np.ndarray, anchor: np.ndarray, least: int):
        """(document, block, ranks) of the blocks of `window` words, which begin at every half of it, with an anchor and
        at least `least` different tokens. rank has -1 for tokens that don't count; ranks ascend."""
        ranks = rank[self.token]
        mine = ranks >= 0
        doc, block, ranks = self.doc[mine], self.number[mine] // (window // 2), ranks[mine]
        doc, block, ranks = np.r_[doc, doc[block > 0]], np.r_[block, block[block > 0] - 1], np.r_[ranks, ranks[block > 0]]
        key = doc << 40 | block
        ok = np.isin(key, np.unique(key[anchor[ranks]]))
        key, ranks = key[ok], ranks[ok]
        order = np.lexsort((ranks, key))
        key, ranks = key[order], ranks[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (ranks[1:] != ranks[:-1])][: len(key)]
        key, ranks = key[new], ranks[new]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        for i, j in zip(first.tolist(), np.r_[first[1:], len(key)].tolist()):
            if j - i >= least:
                yield int(key[i] >> 40), int(key[i] & ((1 << 40) - 1)), ranks[i:j].tolist()


def frequencies(docs: DataFrame, vocabulary: list[str]) -> list[int]:
    """How often each word of the templates stands in all documents: a row a word to the driver, whatever the input's size."""

    def run(batches):
        number, total = {w.encode(): i for i, w in enumerate(vocabulary)}, np.zeros(len(vocabulary), np.int64)
        for b in batches:
            total += np.bincount(Tokens(b.column(0), number).token, minlength=len(vocabulary))
        yield pa.record_batch([pa.array(range(len(vocabulary)), pa.int32()), pa.array(total)], ["token", "n"])
        trim()

    found = docs.select("text").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    out = dict(map(tuple, found))
    return [out.get(i, 0) for i in range(len(vocabulary))]


BLOCKS = "array<struct<window:int,block:long,tokens:array<int>>>"


def scan(df: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.9, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License findings of each document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    Texts have A-Z lower-cased; words are runs of digits, a-z and characters beyond ASCII. Base: places at which a
    phrase's words stand one after another. The join: a template of n words is looked for in blocks of a power of two
    words that begin at every half of it, so wide that any n words in a row are inside one. A block holds a template when
    it has the share `threshold` of the template's different words; all such pairs are found. labels has the labels
    of phrases and templates found; score is the largest share of a template in a block of the document that reaches the
    threshold, 1 with a phrase, 0 with neither; found lists (template, block, share) with the template's place in the list.

    All words of the templates are counted in all documents and ordered from rare to frequent. A template is indexed
    under its first words only (so many that a block without any of these falls short), blocks are dealt by their words
    in the same order, a pair meets at the first word that both have, and length and places of that word rule it out
    where too few words are left. What remains is compared whole. Words outside templates can't count towards a
    containment, so blocks carry the others alone.

    Defined cases: null text has no words; first_word and last_word are null without a place, labels empty strings; null
    and equal ids and repeated rows are each a row; ties between templates and blocks do not matter, as all are found; long
    texts are coded in parts; other columns are not read and their names do not clash; an empty table gives an empty
    result; without templates the phrases alone are looked for.
    """
    known = Templates(templates, threshold)
    spoken = {label: words_of(phrase) for phrase, label in phrases.items()}
    vocabulary = sorted({*known.vocabulary, *(w for ws in spoken.values() for w in ws)})
    number = {w: i for i, w in enumerate(vocabulary)}
    docs = df.select(F.col(id_col).alias("id"), F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n")).alias("text"))
    often = frequencies(docs, vocabulary) if templates else [0] * len(vocabulary)
    order = sorted(range(len(vocabulary)), key=lambda i: (often[i], vocabulary[i]))
    rank = {vocabulary[i]: r for r, i in enumerate(order)}
    sets = [(t, label, window, sorted(rank[known.vocabulary[x]] for x in tokens), least) for t, label, window, tokens, least in known.rows]

    def run(batches):
        code = {w.encode(): i for i, w in enumerate(vocabulary)}
        classes = []
        for window in sorted({s[2] for s in sets}):
            mine = [s for s in sets if s[2] == window]
            ranks, anchor = np.full(len(vocabulary), -1, np.int64), np.zeros(len(vocabulary), bool)
            for _, _, _, tokens, least in mine:
                for r in tokens:
                    ranks[order[r]] = r
                anchor[tokens[: len(tokens) - least + 1]] = True
            classes.append((window, ranks, anchor, min(s[4] for s in mine)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("window", pa.int32()), ("block", pa.int64()), ("tokens", pa.list_(pa.int32()))])))
        for b in batches:
            found = Tokens(b.column(1), code)
            n = len(b)
            places, first, last = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            labels, blocks = [[] for _ in range(n)], [[] for _ in range(n)]
            for label, phrase in spoken.items():
                at = found.phrase([number[w] for w in phrase])
                doc, word = found.doc[at], found.number[at]
                places += np.bincount(doc, minlength=n)
                np.maximum.at(last, doc, word)
                lowest = np.full(n, np.iinfo(np.int64).max)
                np.minimum.at(lowest, doc, word)
                first = np.where(lowest == np.iinfo(np.int64).max, first, np.where(first < 0, lowest, np.minimum(first, lowest)))
                for d in np.unique(doc).tolist():
                    labels[d].append(label)
            for window, ranks, anchor, least in classes:
                for d, block, tokens in found.blocks(window, ranks, anchor, least):
                    blocks[d].append({"window": window, "block": block, "tokens": tokens})
            own = [found.words, places, pa.array(first, mask=first < 0), pa.array(last, mask=last < 0), labels, blocks]
            yield pa.record_batch([b.column(0), *(pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(own, kinds))], ["id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])
        trim()

    kind = dict(docs.dtypes)["id"]
    rows = docs.mapInArrow(run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks {BLOCKS}")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "license-blocks")
    hits = joined(rows, sets).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"), F.array_sort(F.collect_list(F.struct("template", "block", "share"))).alias("found"))
    none = F.array().cast("array<string>")
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return rows.join(hits, "row", "left").select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", text(F.col("base")).alias("base_labels"),
        text(F.concat("base", F.coalesce("more", none))).alias("labels"), score.alias("score"), "found",
    )


def joined(rows: DataFrame, sets: list[tuple]) -> DataFrame:
    """(row, label, template, block, share) of all blocks that hold a template: sets has (template, label, window, tokens
    by rank, least overlap). The index of the templates is as long as the list given; Spark broadcasts it if it is small."""
    index = [(window, r, i, t, label, tokens, least) for t, label, window, tokens, least in sets for i, r in enumerate(tokens[: len(tokens) - least + 1])]
    index = rows.sparkSession.createDataFrame(index, "window int, token int, i int, template int, label string, theirs array<int>, least int")
    block = rows.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    dealt = block.select("row", "window", "block", "tokens", F.posexplode("tokens").alias("j", "token"))
    rest = F.least(F.size("theirs") - F.col("i"), F.size("tokens") - F.col("j"))
    met = dealt.join(index, ["window", "token"]).where((F.size("tokens") >= F.col("least")) & (rest >= F.col("least")))
    earlier = F.arrays_overlap(F.slice("theirs", F.lit(1), F.col("i")), F.slice("tokens", F.lit(1), F.col("j")))
    both = F.size(F.array_intersect("theirs", "tokens"))
    whole = met.where(~earlier).withColumn("both", both).where(F.col("both") >= F.col("least"))
    return whole.select("row", "label", "template", "block", (F.col("both") / F.size("theirs")).alias("share"))
