"""Collocations, the Merkle manifest and the license scan against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from sediment.llm import licenses, merkle, phrases
from sediment.llm.coded import Coded, stretches
from sediment.llm.licenses import TEMPLATES, Tokens, scan, window_of, words_of
from sediment.llm.merkle import manifest
from sediment.llm.phrases import collocations, phrase_counts

from .conftest import make, odd_rows

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- collocations -----------------------------------------------------------------------------------------------------


def counted(rows, longest=4):
    out, totals = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, longest + 1):
                out.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    return out, totals


def plain_collocations(rows, least, within=80, top=2000):
    f, totals = counted(rows)
    found = defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        inside = any(
            b >= least and len(q) > len(p) and ql == lang and 100 * b >= within * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (ql, q), b in f.items() if b >= least
        )
        if inside:
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {
        (lang, i, p.decode(), -a, l, r, totals[lang], -score)
        for lang, some in found.items()
        for i, (score, a, p, l, r) in enumerate(sorted(some)[:top], 1)
    }


def chatter(seed=3, n=120):
    rng = random.Random(seed)
    common = ["new york", "New York City", "a b a b a", "né à", "of the", "x\ty  z"]
    rows = []
    for i in range(n):
        parts = [rng.choice(common) if rng.random() < 0.6 else "".join(rng.choice("abcxyz") for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 30))]
        rows.append((i, "".join(p + rng.choice([" ", " ", " ", ", ", "\n", "! "]) for p in parts), rng.choice(["en", "fr", None, "und"]), None))
    return rows


@pytest.mark.parametrize("most_cells", [1 << 16, 1 << 4])
def test_phrase_counts(spark, most_cells):
    """A sketch so small that it lets all through gives the same."""
    rows = chatter()
    f, totals = counted(rows)
    got = {(r["lang"], r["phrase"], r["size"]): r["f"] for r in phrase_counts(make(spark, rows).repartition(3), 8, most_cells=most_cells).collect()}
    assert got == {(lang, " ".join(p), len(p)): n for (lang, p), n in f.items() if n >= 8} | {(lang, None, 0): n for lang, n in totals.items()}


def test_collocations(spark):
    rows = chatter()
    got = [tuple(r) for r in collocations(make(spark, rows).repartition(3), least=6).collect()]
    assert len(got) > 20 and set(got) == plain_collocations(rows, 6) and len(got) == len(set(got))


def test_collocations_of_odd_rows(spark, docs, empty):
    assert {tuple(r) for r in collocations(docs, least=12).collect()} == plain_collocations(odd_rows(), 12)
    assert collocations(empty).collect() == [] and collocations(docs, least=10**6).collect() == []


def test_top_breaks_ties_by_phrase(spark):
    rows = [(i, "b a. a b. c d e", "en", None) for i in range(30)]
    got = collocations(make(spark, rows), top=2).orderBy("rank").collect()
    assert [(r["rank"], r["phrase"], r["score"]) for r in got] == [(1, "c d e", 1_000_000), (2, "a b", 500_000)]


@pytest.mark.parametrize("size", [16, 64, 300])
def test_stretches_count_each_run_once(size):
    rng = random.Random(size)
    text = " ".join(rng.choice(["a", "bb", "ccc", "a" * 50]) for _ in range(300)) + "\n" + "z" * 700 + " a bb, a bb a bb\n"
    want, _ = counted([(0, text, "en", None)])
    got = Counter()
    bits = np.full((phrases.ROWS, 1 << 10), 255, np.uint8)
    n = 0
    for coded, found in phrases.grams(np.frombuffer(text.encode(), np.uint8), "en", 4, size):
        n += 1
        for p, _, c in zip(*phrases.survivors(coded, found, bits, (1 << 13) - 1)):
            got["en", tuple(p.split(" "))] += c
    assert got == want and n > 2


def test_stretches_cover_the_text():
    raw = np.frombuffer(b"one two three four five six seven\neight", np.uint8)
    breaks, word = np.zeros(256, bool), phrases.IN_WORD
    out = []
    for a, b, seen in stretches(raw, word, breaks, 1, 8):
        out += [Coded(raw[a:b], word).words[c] for c in Coded(raw[a:b], word).codes[seen:]]
    assert b" ".join(out) == bytes(raw).replace(b"\n", b" ")


def test_sums_past_64_bits_stay_exact(spark):
    big = 9_000_000_000_000_000
    counts = spark.createDataFrame([("en", "a b", big, big + 1, big + 2, 1)], "lang string, phrase string, a long, l long, r long, k int")
    got = counts.selectExpr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as s").first()["s"]
    assert got == 2_000_000 * big // (2 * big + 3)


# --- Merkle manifest --------------------------------------------------------------------------------------------------


def h(*digests):
    return sha256("".join(digests).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """Levels from leaves to root."""
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def plain_manifest(rows):
    by = defaultdict(list)
    for i, text, lang, source in rows:
        n = None if text is None else len(text)
        digest = lambda t: sha256("".join(map(field, (i, source, lang, n, t))).encode()).hexdigest()
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        by[lang].append(((i is None, i or 0, digest(text)), i, digest(text), digest(text.translate(UPPER)) if hit and text is not None else digest(text)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([r[2] for r in sorted(by[x], key=lambda r: r[0])]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for g, x in enumerate(langs):
        for j, (_, i, leaf, seen) in enumerate(sorted(by[x], key=lambda r: r[0])):
            proof, now = "", seen
            for levels, at in ((trees[x], j), (top, g)):
                for nodes in levels[:-1]:
                    lo, hi = nodes[at // 8 * 8 : at], nodes[at + 1 : at // 8 * 8 + 8]
                    proof, now, at = proof + "".join(lo + hi), h(*lo, now, *hi), at // 8
            out.append((i, leaf, trees[x][-1][0], top[-1][0], h(proof), now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(spark, levels):
    """Blocks of 8, 64 and 4096 leaves."""
    rng = random.Random(levels)
    rows = odd_rows() + [(1000 + i, f"Text {rng.random()}", ["en", "de", "en"][i % 3] if i % 50 else f"l{i}", f"s{i % 3}") for i in range(600)]
    rng.shuffle(rows)
    got = sorted((tuple(r) for r in manifest(make(spark, rows).repartition(5), levels=levels).collect()), key=str)
    assert got == plain_manifest(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_of_few(spark, empty):
    assert manifest(empty).collect() == []
    rows = [(1, "A", "en", None)]
    assert [tuple(r) for r in manifest(make(spark, rows)).collect()] == plain_manifest(rows)
    rows = [(i, "A", f"l{i % 9}", None) for i in range(9)] + [(None, None, None, None)] * 3
    assert sorted((tuple(r) for r in manifest(make(spark, rows)).collect()), key=str) == plain_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 200, 512, 513])
def test_traversal(n):
    nodes = [sha256(str(i).encode()).digest() for i in range(n)]
    levels = tree([x.hex() for x in nodes])
    for i, path in enumerate(merkle.traverse(nodes, merkle.height(n))):
        want = [(levels[k][i // 8**k // 8 * 8 : i // 8**k // 8 * 8 + 8], i // 8**k % 8) for k in range(len(levels) - 1)]
        assert [([x.hex() for x in run], at) for run, at in path] == want


def test_equal_keys_are_dealt_over_partitions(spark):
    """A third of all rows with one id and text: positions come from ranges that such rows don't fill alone."""
    rows = [(None, "same", "en", "s")] * 400 + [(i, f"t{i}", "en", "s") for i in range(800)]
    got = manifest(make(spark, rows).repartition(4), levels=1).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)


# --- licenses ---------------------------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def plain_scan(rows, templates=TEMPLATES, threshold=0.9):
    out = []
    for i, text, _, _ in rows:
        w = plain_words(text)
        places, base = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            found = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            places += found
            base |= {label} if found else set()
        labels, share = set(base), 0.0
        pairs = []
        for t, (label, template) in enumerate(templates):
            tokens = set(plain_words(template))
            window = window_of(len(plain_words(template)))
            for block in range(0, 2 * len(w) // window + 1):
                own = set(w[block * window // 2 : block * window // 2 + window])
                if len(own & tokens) / len(tokens) >= threshold:
                    labels.add(label)
                    share = max(share, len(own & tokens) / len(tokens))
                    pairs.append((t, block))
        out.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else share, pairs))
    return sorted(out, key=str)


def licensed():
    rng = random.Random(11)
    filler = ["the", "of", "and", "work", "under", "license", "is", "version", "né", "x1", "software", "mit", "public", "general"]
    rows = []
    for i in range(150):
        w = [rng.choice(filler) for _ in range(rng.randint(0, 90))]
        if i % 3:
            t = plain_words(rng.choice(TEMPLATES)[1])
            t = [rng.choice(filler) if rng.random() < 0.06 else x for x in t]
            at = rng.randint(0, len(w))
            w[at:at] = t
        rows.append((i, "".join(x + rng.choice([" ", "\n", ", ", " - "]) for x in w), "en", None))
    return rows


@pytest.mark.parametrize("threshold", [0.9, 0.6])
def test_scan(spark, threshold):
    rows = licensed()
    got = [(*tuple(r)[:-1], [(x["template"], x["block"]) for x in r["found"] or ()]) for r in scan(make(spark, rows).repartition(3), threshold=threshold).collect()]
    assert sorted(got, key=str) == plain_scan(rows, threshold=threshold)
    assert sum(bool(r[-1]) for r in got) > 50


def test_scan_of_odd_rows(spark, docs, empty):
    got = [tuple(r)[:-1] for r in scan(docs).collect()]
    assert sorted(got, key=str) == [r[:-1] for r in plain_scan(odd_rows())]
    assert scan(empty).collect() == []
    assert sorted((tuple(r)[:4] for r in scan(docs, templates=[]).collect()), key=str) == sorted((r[:4] for r in plain_scan(odd_rows(), [])), key=str)


def test_phrases_stop_at_documents_and_other_words(spark):
    rows = [(1, "general public", "en", None), (2, "license. MIT  licenses; mit-LICENSE", "en", None), (3, "mit éa license mit\n\nlicense", "en", None)]
    got = {r["doc_id"]: (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in scan(make(spark, rows).coalesce(1)).collect()}
    assert got == {1: (0, None, None, ""), 2: (1, 3, 3, "mit"), 3: (1, 3, 3, "mit")}


@pytest.mark.parametrize("size", [16, 40, 1000])
def test_tokens_over_stretches(size):
    texts = ["the mit license of x " * 20, "", "mit", "license mit license " + "y" * 100]
    number = {b"mit": 0, b"license": 1}
    found = Tokens(pa.array([t + "\n" for t in texts]), number, size)
    assert found.words.tolist() == [len(t.split()) for t in texts]
    want = [(d, j, number[w.encode()]) for d, t in enumerate(texts) for j, w in enumerate(t.split()) if w.encode() in number]
    assert list(zip(found.doc.tolist(), found.number.tolist(), found.token.tolist())) == want
    assert len(found.phrase([0, 1])) == 21


def test_any_run_lies_in_one_block():
    for n in range(1, 200):
        half = window_of(n) // 2
        assert all(any(b * half <= i and i + n <= (b + 2) * half for b in (i // half, i // half - 1)) for i in range(3 * half))
    assert all(words_of(t) == plain_words(t) for _, t in TEMPLATES)
