"""Each operator against a plain version, on odd rows, and on an empty table."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sediment.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from sediment.llm.packing import pack

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    plain = Tokenizer.from_file(path)
    docs = docs.unionByName(docs.where("doc_id = 403").withColumns({"doc_id": F.lit(800).cast("long"), "text": F.lit("a <|endoftext|> b x<|startoftext|>y <|endoftext|><|ENDOFTEXT|>z < |endoftext|>")}))
    out = rows(pack(docs, path))
    ids = [(r.doc_id, np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in docs.select("doc_id", "text").collect()]
    assert sum(r["length"] for r in out) == sum(len(b) // 4 for _, b in ids)
    pieces = defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
    for doc, b in ids:
        if doc is None or doc == 500:
            continue
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(b) // 4
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(b[r["start"] * 4 : at * 4])
        assert at == len(b) // 4
    for doc in (None, 500):  # rows that share an id: each is cut whole, by itself
        own = [b for d, b in ids if d == doc]
        assert sum(r["length"] for r in pieces[doc]) == sum(len(b) // 4 for b in own) and sum(r["start"] == 0 for r in pieces[doc]) == len(own)
        assert all(any(len(b) // 4 == r["doc_tokens"] and zlib.crc32(b[r["start"] * 4 : (r["start"] + r["length"]) * 4]) == r["ids_crc32"] for b in own) for r in pieces[doc])
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r["length"] for r in out) / (2048 * len(by)) > 0.9
    assert pack(empty, path).count() == 0


def test_differencing_is_near_equal():
    from sediment.llm.packing import balanced, differenced

    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 513, 900)
    where = differenced(sizes, 40)
    sums = np.bincount(where, weights=sizes, minlength=40)
    assert sums.max() - sums.min() < 64 and sums.sum() == sizes.sum()
    assert np.bincount(balanced(sizes, 2048), weights=sizes).max() <= 2048
    assert list(differenced(np.array([5]), 3)) == [0]
    assert balanced(np.array([], int), 2048).size == 0


def test_mixing(docs, empty):
    from sediment.llm.mixing import mix

    out = rows(mix(docs.select("doc_id", "text", "source", "size")))
    again = rows(mix(docs.repartition(5).select("doc_id", "text", "source", "size")))
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    size = defaultdict(int)
    source = {(r.doc_id, r.text): r.source for r in docs.collect()}
    for r in out:
        assert r["size"] == len(WORD.findall(r["text"] or ""))
        size[source[r["doc_id"], r["text"]]] += r["size"]
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, total, target = set(names), 1.5 * sum(size.values()), {}
    while True:
        rate = total / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * rate > 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * size[s]
            total -= target[s]
        left -= full
    target |= {s: weight[s] * rate for s in left}
    taken = defaultdict(int)
    for r in out:
        s = source[r["doc_id"], r["text"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == sum(t["words"] for t in r["takes"]) and all(0 <= t["position"] <= 1 for t in r["takes"])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert mix(empty).count() == 0


def test_schedules_integrate_and_invert(spark):
    from pyspark.sql import functions as F

    from sediment.llm.mixing import integrated, inverted

    knots = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(r).alias("rate")) for t, r in ((0.0, 2.0), (0.25, 1.0), (0.5, 0.0), (1.0, 3.0))])
    df = spark.range(0, 101).select((F.col("id") / 100).alias("share")).withColumn("t", inverted(integrated(knots), F.col("share")))
    grid = np.linspace(0, 1, 200001)
    rate = np.interp(grid, [0, 0.25, 0.5, 1], [2, 1, 0, 3])
    area = np.r_[0, np.cumsum((rate[1:] + rate[:-1]) / 2)]
    for r in df.collect():
        assert np.interp(r.t, grid, area / area[-1]) == pytest.approx(r.share, abs=1e-5)


def test_sharding(docs, empty):
    from sediment.llm.sharding import shard

    out = rows(shard(docs, 8))
    assert len(out) == docs.count() and {"lang", "source", "n_chars"} <= out[0].keys()
    total = sum(r["size"] for r in out)
    by = defaultdict(list)
    for r in out:
        b = (r["text"] or "").encode()
        assert r["size"] == len(b) + 1 and r["text_crc32"] == zlib.crc32(b) and r["law"] == "bytes" and r["grown_shard"] is None
        by[r["shard"]].append(r)
    for s in by.values():
        assert sorted(r["slot"] for r in s) == list(range(len(s)))
    assert shard(empty, 8).count() == 0
    # By (hash of the text, id), shards and slots run on from one row to the next.
    key = lambda r: (xxhash.xxh64_intdigest((r["text"] or "").encode(), 42) + (1 << 63)) % (1 << 64)
    order = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    places = [(key(r), r["doc_id"] is not None, r["doc_id"] or 0) for r in order]
    assert places == sorted(places)
    even = rows(shard(docs.where("length(text) < 3000 or text is null"), 3))
    share = Counter()
    for r in even:
        share[r["shard"]] += r["size"]
    total = sum(share.values())
    assert all(abs(v - total / 3) < 3000 for v in share.values())


def test_hot_texts_are_subdivided(spark):
    from sediment.llm.sharding import shard

    df = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 > 0, 'one hot text', cast(id as string)) as text")
    share = Counter()
    for r in shard(df, 8).collect():
        share[r.shard] += r["size"]
    assert max(share.values()) - min(share.values()) < 0.05 * sum(share.values())


def test_line_dedup(docs, empty):
    from sediment.llm.line_dedup import dedup_lines

    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    big = 1 << 62
    data = [(r.doc_id if r.doc_id is not None else big, r.text or "") for r in docs.collect()]
    owner = {}
    for d, t in data:
        for x in t.split("\n"):
            owner[key(x)] = min(owner.get(key(x), big), d)
    want = Counter()
    for d, t in data:
        kept = [x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] >= d]
        want[d, len(t.split("\n")), len(t.split("\n")) - len(kept), "\n".join(kept)] += 1
    for batches, fanout in ((4, 3), (6, 2), (1, 2)):
        out = rows(dedup_lines(docs, batches=batches, fanout=fanout))
        assert Counter((r["doc_id"] if r["doc_id"] is not None else big, r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out) == want
    assert out[0]["h"] == "clash"
    assert dedup_lines(empty).count() == 0


def test_exact_dedup(docs, empty):
    from sediment.llm.exact_dedup import dedup

    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for r in docs.collect():
        groups[bare(r.text)].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, r.doc_id))
    out = defaultdict(list)
    for r in rows(dedup(docs)):
        out[r["text_sha256"]].append(r)
    assert len(out) == len(groups)
    for t, g in groups.items():
        got = out[hashlib.sha256(t.encode()).hexdigest()]
        assert len(got) == len(g) == got[0]["group_size"] and sum(r["kept"] for r in got) == 1
        assert {r["keep_id"] for r in got} == {min(g)[3]}
        assert next(r for r in got if r["kept"])["doc_id"] == min(g)[3]
    assert dedup(empty).count() == 0


def test_bloom_filters_miss_nothing(spark, monkeypatch):
    from sediment.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "MOST_BITS", 1 << 14)  # several slices
    df = spark.range(6000).selectExpr("xxhash64(if(id < 5000, id, id % 700)) as h").repartition(7).cache()
    flagged = exact_dedup.flag_repeated(df, "h", 6000)
    counts = {r.h: r["count"] for r in df.groupBy("h").count().collect()}
    got = [(r.h, r.maybe) for r in flagged.collect()]
    assert len(got) == 6000 and all(m for h, m in got if counts[h] > 1)
    assert sum(m for h, m in got if counts[h] == 1) < 0.05 * len(got)


def test_exact_dedup_in_slices(docs, spark, monkeypatch):
    """Rows are the same with one filter and with a filter for each of many slices, one of which holds a third of all rows."""
    from sediment.llm import exact_dedup

    hot = spark.range(400).selectExpr("id + 10000 as doc_id", "concat('the same', repeat(' ', int(id % 3)), ' text') as text")
    both = docs.select("doc_id", "text").unionByName(hot)
    key = lambda df: Counter(tuple(r) for r in df.collect())
    want = key(exact_dedup.dedup(both))
    monkeypatch.setattr(exact_dedup, "MOST_BITS", 1 << 10)
    assert key(exact_dedup.dedup(both)) == want


def groups_of(data, k, num, den):
    fold = lambda t: re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for _, t in data:
        w = WORD.findall(fold(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    part = list(range(len(data)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                part[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(data, sets)))


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (1, 60)])
def test_jaccard_join(docs, empty, k, num):
    from sediment.llm.jaccard_join import similar_groups

    big = (1 << 63) - 1
    data = [(r.doc_id if r.doc_id is not None else big, r.text) for r in docs.collect()]
    some = lambda v: big if v is None else v
    out = Counter((some(r["doc_id"]), r["n_shingles"], some(r["component_id"])) for r in rows(similar_groups(docs, k, num, 100)))
    assert out == groups_of(data, k, num, 100)
    if k == 3:
        assert similar_groups(empty).count() == 0


@pytest.mark.parametrize("num", [90, 70])
def test_jaccard_join_of_small_sets(spark, num):
    """Sets on both sides of the boundary, with links by single words, and chains of links."""
    import random

    from sediment.llm.jaccard_join import similar_groups

    rng = random.Random(num)
    data = []
    for i in range(150):
        if i % 3 and data:
            w = data[rng.randrange(len(data))][1].split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(60)}"
            if rng.random() < 0.4:
                w.append(f"w{rng.randrange(60)}")
        else:
            w = [f"w{rng.randrange(60)}" for _ in range(rng.randint(2, 40))]
        data.append((i, " ".join(w)))
    out = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(similar_groups(spark.createDataFrame(data, "doc_id long, text string"), 1, num, 100)))
    assert out == groups_of(data, 1, num, 100)


def test_jaccard_join_around_leaders(spark, monkeypatch):
    """Groups of near copies with edits of all sizes beside texts that share a passage, with several rounds of leaders."""
    import random

    from sediment.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "SHORT", 2)
    monkeypatch.setattr(jaccard_join, "SHORT_OF_DIFFERENCES", 3)
    monkeypatch.setattr(jaccard_join, "FEW_PAIRS", 0)
    monkeypatch.setattr(jaccard_join, "LEADERS", 4)
    rng = random.Random(12)
    bases = [[f"b{b}w{i}" for i in range(70)] for b in range(2)]
    passage = [f"p{i}" for i in range(9)]
    data = []
    for i in range(160):
        w = list(bases[i % 2]) if i % 5 else [f"u{i}w{j}" for j in range(40)] + passage
        for _ in range(rng.randint(0, 7)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 2)] = [f"e{rng.randrange(25)}" for _ in range(rng.randint(0, 2))]
        data.append((i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    for num in (90, 75):
        out = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.similar_groups(df, 3, num, 100)))
        assert out == groups_of(data, 3, num, 100)


def test_jaccard_join_of_a_shared_passage(spark, monkeypatch):
    """Sets that share a passage and are not near meet in one list for it, not in one a word, and make no rows of pairs."""
    import random

    from sediment.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "OFTEN", 1000)  # else so few documents' common words come last
    short, around, lists, found = jaccard_join.short_pairs, jaccard_join.around_leaders, [], []
    monkeypatch.setattr(jaccard_join, "short_pairs", lambda *a: found.append(short(*a)) or found[-1])
    monkeypatch.setattr(jaccard_join, "around_leaders", lambda members, *a: lists.append(members.select("k2").distinct().count()) or around(members, *a))
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    data = [(i, " ".join(passage + [f"u{i}w{j}" for j in range(120)])) for i in range(48)]
    for i in range(6):  # near copies of one of them beside
        w = data[5][1].split()
        w[rng.randrange(30, 150)] = f"edit{i}"
        data.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.similar_groups(df, 1, 80, 100)))
    assert out == groups_of(data, 1, 80, 100) and len({c for _, _, c in out}) == 48
    assert sum(p.count() for p in found) < 48
    assert 0 < lists[0] <= 6


def test_parities_rule_out_no_link(spark):
    """Linked sets of all sizes pass, with as many bits or twice as many; sets that share little do not; sizes far apart tell nothing."""
    import random

    from sediment.llm.jaccard_join import Threshold, alike_parities, parities

    rng, t = random.Random(5), Threshold(80, 100)
    draw = lambda n: {rng.getrandbits(64) for _ in range(n)}
    cases = []
    for n in (1, 5, 60, 64, 66, 100, 128, 140, 700):
        for _ in range(4):
            x = draw(n)
            y = set(rng.sample(sorted(x), n - n // 18)) | draw(n // 18)  # J of 0.89 or more
            cases += [("linked", x, y), ("linked", x, x | draw(n // 4)), ("linked", x | draw(n // 4), x)]
            if n >= 60:
                cases.append(("apart", x, draw(n)))
    cases += [("far", draw(10), draw(600)), ("far", draw(600), draw(10))]
    side = lambda s: (len(s), parities(np.array(sorted(s), np.uint64)).tolist())
    made = [(case, side(x), side(y)) for case, x, y in cases]
    both = "struct<n:int,bits:array<long>>"
    told = spark.createDataFrame(made, f"case string, x {both}, y {both}").select("case", alike_parities(t).alias("may")).distinct().collect()
    assert {(r["case"], r["may"]) for r in told} == {("linked", True), ("apart", False), ("far", True)}
    assert any(len(x[1]) != len(y[1]) for case, x, y in made if case == "linked")


def test_block_sets_are_those_of_each_document():
    """Sets, identities and parities made for a whole block are those made document by document."""
    import random

    import pyarrow as pa

    from sediment.llm.jaccard_join import U, all_parities, block_sets, identities, parities, shingles
    from sediment.llm.words import blocks, mixed

    rng = random.Random(7)
    texts = ["", "a", "a b c d", "a b c d e", "x " * 30, " \n ", *[" ".join(str(rng.randrange(40)) for _ in range(n)) for n in (4, 5, 6, 68, 69, 300, 1030)], ""]
    for i, j, block in blocks(pa.array(texts), True):
        h, ends = block_sets(block, j - i, 5)
        (s1, s2), (bits, at) = identities(h, ends), all_parities(h, ends)
        for r in range(j - i):
            own = shingles(block, r, 5)
            assert h[ends[r] : ends[r + 1]].tolist() == own.tolist()
            assert bits[at[r] : at[r + 1]].tolist() == parities(own).tolist()
            for x, s in ((0x243F6A8885A308D3, s1), (0x13198A2E03707344, s2)):
                assert s[r : r + 1].view(U)[0] == mixed(own ^ U(x)).sum(dtype=U)


def test_stars_are_told_by_parities_and_postings_travel_as_bytes(spark, monkeypatch):
    """Sets that share a passage alone go before their elements travel; postings of one set alone are no rows of a table."""
    from sediment.llm import jaccard_join

    given, written = [], Counter()
    told, kept = jaccard_join.plausible, jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "plausible", lambda pairs, *a: given.append(pairs.count()) or told(pairs, *a))

    def stored(df, name):
        out = kept(df, name)
        written[name] += out.count() if "postings" in name else 0
        return out

    monkeypatch.setattr(jaccard_join, "stored", stored)
    data = [(i, " ".join([f"p{j}" for j in range(40)] + [f"u{i}w{j}" for j in range(100)])) for i in range(40)]
    data += [(100 + i, data[i][1].replace("w50", "edit")) for i in range(3)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(jaccard_join.similar_groups(df, 5, 80, 100)))
    assert out == groups_of(data, 5, 80, 100) and len({c for _, _, c in out}) == 40
    assert 3 <= given[0] <= 6  # 42 sets share a list with its leader
    assert sum(written.values()) < 2 * 43 * 30  # sets have some 30 postings each, most of them of one set alone


def test_near_duplicates_leaves_the_texts_where_they_are(spark):
    """Few rows that go are broadcast whatever Spark's own limit is: the texts that stay are not shuffled."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(i, f"{' '.join(f'w{j}' for j in range(30))} x{i % 2}", "en", "s", 1) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
        out = corpus_pipeline.near_duplicates(spark, df, "")
        assert [r.doc_id for r in out.collect()] == [0]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_components_of_long_chains(spark):
    """Chains whose labels fall away from the smallest node, or stand in random order; a hub, a pair and a lone node."""
    import random

    from sediment.llm.jaccard_join import components

    order = list(range(1000, 1500))
    random.Random(1).shuffle(order)
    falling = [0, *range(500, 0, -1)]
    edges = [*zip(falling, falling[1:]), *zip(order, order[1:]), *((2000 + i, 2500) for i in range(40)), (3001, 3000), (4000, 4000)]
    want = {**dict.fromkeys(falling, 0), **dict.fromkeys(order, 1000), **dict.fromkeys([*range(2000, 2040), 2500], 2000), 3000: 3000, 3001: 3000, 4000: 4000}
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(out) == len(want) and {r["node"]: r["label"] for r in out} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_join_of_a_chain(spark):
    """Each document is linked with the next one alone; ids fall along the chain."""
    from sediment.llm.jaccard_join import similar_groups

    data = [(500 - i, " ".join(f"w{j}" for j in range(i, i + 20))) for i in range(500)]
    out = similar_groups(spark.createDataFrame(data, "doc_id long, text string"), 1, 90, 100).collect()
    assert len(out) == 500 and {r["component_id"] for r in out} == {1}


def test_language_id(docs, empty, spark, sf):
    from sediment.llm.language_id import identify, train

    out = queries.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    model = train(spark.read.parquet(f"{sf}/documents.parquet"), __import__("pyspark.sql.functions", fromlist=["lit"]).lit(True))
    got = {r["doc_id"]: r for r in rows(identify(docs, model))}
    assert all(got[i]["lang_pred"] == "und" for i in (400, 401, 402, 404)) and got[700]["lang_pred"] != "und" and got[700]["n"] == 1
    assert {r["lang_pred"] for r in rows(identify(docs, ()))} == {"und"}
    assert identify(empty, model).count() == 0 and train(empty, empty.doc_id.isNotNull()) == ()


def test_language_id_learns_from_copies(spark):
    """A language made of big groups of copies, and of one text alone, is learned; copies change nothing of the model."""
    from pyspark.sql import functions as F

    from sediment.llm.language_id import identify, train

    once = [("copies", f"wort{i} und noch ein satz hier {i} {'abc' * 300}") for i in range(30)] + [("one", "solitary text of its language " * 9)]
    once += [("wide", f"mots {i} " + " ".join(f"mot{i}x{j}" for j in range(200))) for i in range(300)]
    df = spark.createDataFrame(once, "lang string, text string")
    times = {"copies": 2000, "one": 20000, "wide": 1}
    many = F.element_at(F.create_map(*[F.lit(x) for p in times.items() for x in p]), F.col("lang"))
    copied = df.withColumn("_", F.explode(F.sequence(F.lit(1), many))).drop("_")
    model = train(copied, F.lit(True))
    assert [lang for lang, _ in model] == ["copies", "one", "wide"] and model == train(df, F.lit(True))
    size = {lang: len(text) for lang, text in model}
    assert size["wide"] == 40_000 and size["copies"] > 27_000 and size["one"] > 200
    pred = identify(df.dropDuplicates(["lang"]), model).collect()
    assert all(r["lang"] == r["lang_pred"] for r in pred)


def test_letters_alone_make_a_language(spark):
    """Number signs are no letters; ordinals, modifiers and letters of any script are."""
    from sediment.llm.language_id import identify, lettered

    odd = {"½ ² Ⅷ": False, "①": False, "٣ १": False, "_ - \u0301": False, "": False, None: False, "ª": True, "漢": True, "1a": True, "ʰ": True, "ǅ": True, "12 \U00010400": True}
    df = spark.createDataFrame(list(odd.items()), "text string, want boolean")
    model = (("aa", "some words of a language " * 40), ("bb", "autres mots d une langue " * 40))
    assert [r["text"] for r in rows(identify(df, model)) if (r["lang_pred"] != "und") != r["want"]] == []
    assert df.where(lettered(F.col("text")) != F.col("want")).count() == 0


#: Ids of rows from which nothing is learned.
UNTAUGHT = [i for i in range(900, 1000) if zlib.crc32(str(i).encode()) % 4 == 2][:7]


def two_languages(spark):
    rng = random.Random(8)
    made = {k: ["".join(rng.choice(abc) for _ in range(rng.randint(2, 6))) for _ in range(150)] for k, abc in (("en", "abcdefghij"), ("fr", "klmnopqrst"))}
    text = lambda k, n: " ".join(rng.choice(made[k]) for _ in range(n))
    data = [(i, text(k, 120), k) for i, k in enumerate(["en", "fr"] * 60)]
    odd = [(text("fr", 120), "en"), (text("en", 120), "fr"), (text("en", 60) + " " + text("fr", 60), "en"), (text("fr", 90), None), (text("en", 90), "xx"), ("12", "en"), (None, "fr")]
    data += [(i, *r) for i, r in zip(UNTAUGHT, odd)]
    return spark.createDataFrame([(*r, "s", 1) for r in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_pipeline_rejects_wrong_languages(spark):
    """A text in another language than its label's goes; one of two languages stays; null labels are told, unknown ones kept."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = two_languages(spark)
    out = {r.doc_id: r for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    both, null, unknown = UNTAUGHT[2:5]
    assert set(out) == {*range(120), both, null, unknown}
    assert out[both].lang == "en" and out[null].lang == "fr" and out[unknown].lang == "xx" and all(out[i].lang == ("en", "fr")[i % 2] for i in range(120))
    clash = docs.withColumns({c: F.lit(c) for c in ("lang_pred", "score", "against", "row", "of", "label")})
    told = corpus_pipeline.language_id(spark, clash, "")
    assert told.columns == clash.columns and {r.doc_id for r in told.collect()} == set(out) and told.where("row != 'row' or against != 'against'").count() == 0


def test_pipeline_identifies_each_text_once(spark):
    """A filter on the results is not pushed below them, which would have Python walk every text twice."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    told = corpus_pipeline.language_id(spark, two_languages(spark), "")
    assert told._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_judged_against_the_label(spark):
    from sediment.llm.language_id import identify, train

    docs = two_languages(spark)
    model = train(docs.where("doc_id < 120"), F.lit(True))
    told = {r["doc_id"]: r for r in rows(identify(docs, model, "text", "lang"))}
    fr, en, both, null, unknown, digits, nothing = (told[i] for i in UNTAUGHT)
    assert all(told[i]["against"] == 1.0 for i in range(120)) and fr["against"] > 2 < en["against"] and 1 <= both["against"] < 2
    assert null["against"] is None and unknown["against"] is None and digits["lang_pred"] == nothing["lang_pred"] == "und"
    assert "against" not in identify(docs, model).columns


def test_pipeline_language_id_without_labels(docs, spark):
    from pyspark.sql import functions as F

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    key = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    want = key(corpus_pipeline.language_id(spark, docs, ""))
    got = key(corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), ""))
    assert got == want and len(got) > 80


def test_cross_parsing_is_longest_match():
    from sediment.llm.language_id import Automaton, Parser

    def plain(text, of):
        n = i = 0
        while i < len(text):
            j = i + 1
            while j <= len(text) and text[i:j] in of:
                j += 1
            i = max(j - 1, i + 1)
            n += 1
        return n

    rng = np.random.default_rng(5)
    of = rng.integers(1, 5, 300).tolist()
    a = Automaton(of)
    a.table = np.r_[a.table, np.zeros(8, np.int64)]
    a.plain = memoryview(a.table)
    for n in (0, 1, 5, 200):
        text = rng.integers(0, 7, n).tolist()
        assert a.phrases(text) == plain(bytes(text), bytes(of))
    p = Parser((("a", "abab cdcd abcd " * 9), ("b", "xyz zyx yyxx " * 9)))
    texts = ["".join(rng.choice(list("abcdxyz "), rng.integers(1, 90))) for _ in range(200)]
    codes = sorted((p.coded(t) for t in texts), key=len, reverse=True)
    size = np.array([len(c) for c in codes])
    got = p.all_phrases(np.concatenate(codes), np.cumsum(size) - size, size)
    assert got.tolist() == [[a.phrases(c.tolist()) for c in codes] for a, _, _ in p.parts]


def plain_language(model, text):
    """The cross-parsing by its definition: longest matches in the text as a string, phrase rates of the held-back fifth."""
    import math

    def phrases(codes, of):
        n = i = 0
        while i < len(codes):
            j = i + 1
            while j <= len(codes) and codes[i:j] in of:
                j += 1
            i = max(j - 1, i + 1)
            n += 1
        return n

    if text is None or not any(unicodedata.category(c)[0] == "L" for c in text):
        return "und", 0.0
    letters = re.sub(r"[\W\d_]+", " ", text.lower())
    raw = []
    for lang, own in model:
        cut = len(own) * 4 // 5
        of, rest = own[:cut], own[cut:] or own
        rate = max(phrases(rest, of), 1) / max(len(rest), 1)
        raw.append((phrases(letters, of) / rate, lang, rate, math.log2(max(cut, 2))))
    best, lang, rate, bits = min(raw)
    return lang, 1 / sum(2.0 ** -min(1000.0, (n - best) * rate * bits) for n, *_ in raw)


def test_language_id_against_plain_version(spark):
    """Scripts with thousands of characters beside Latin ones; prediction and score of every text."""
    import random

    from sediment.llm.language_id import identify, train

    rng = random.Random(4)
    ranges = {"zh": (0x4E00, 1500), "ja": (0x3041, 80), "ko": (0xAC00, 2000), "xa": (0x61, 26), "xb": (0x61, 26), "ru": (0x430, 32), "jz": (0x4E00, 1500), "cu": (0x12000, 700)}
    words = {k: ["".join(chr(a + int(n * rng.random() ** 2)) for _ in range(rng.randint(1, 4))) for _ in range(500)] for k, (a, n) in ranges.items()}
    words["jz"] += words["ja"] * 2
    text = lambda k, n: " ".join(words[k][int(500 * rng.random() ** 2) % len(words[k])] for _ in range(n))
    rows_ = [(i, k, text(k, rng.randint(5, 60))) for k in words for i in range(60)]
    df = spark.createDataFrame(rows_, "i long, lang string, text string")
    model = train(df.where("i < 40"), F.lit(True), chars=3000)
    held = [r for r in rows(identify(df, model)) if r["i"] >= 40]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.9 * len(held)
    odd = [(0, "x", "123 ..."), (1, "x", None), (2, "x", "Ωμέγα"), (3, "x", "")] + [(4 + i, "x", text("zh", 3) + " " + text("xa", i)) for i in range(60)]
    for r in [*held, *rows(identify(spark.createDataFrame(odd, "i long, lang string, text string"), model))]:
        lang, score = plain_language(model, r["text"])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, rel=1e-9), r


def test_many_languages():
    import random

    from sediment.llm.language_id import Parser

    rng = random.Random(9)
    words = [["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6))) for _ in range(90)] for _ in range(150)]
    text = lambda k, n: " ".join(rng.choice(words[k]) for _ in range(n))
    p = Parser(tuple((f"l{k:03}", text(k, 300)) for k in range(150)))
    assert [lang for lang, _ in p.predict([text(k, 40) for k in range(150)])] == [f"l{k:03}" for k in range(150)]


def test_fingerprints(docs, empty):
    from sediment.llm.fingerprints import Prefixes, fingerprint, fingerprints

    out = rows(fingerprints(docs))
    assert len(out) == docs.count()
    known = sorted(((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None), reverse=True)
    texts = dict(known)
    print_ = {}
    got = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    ids = sorted(texts, reverse=True)
    for i, d in enumerate(ids[:-1]):
        t, following = texts[d], texts[ids[i + 1]]
        if d == 500:
            continue
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), d
        shared = next((k for k in range(min(len(t), len(edited))) if t[k] != edited[k]), min(len(t), len(edited)))
        assert r["shared_prefix"] == shared
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert print_.setdefault(t, r["fingerprint"]) == r["fingerprint"] == fingerprint(Prefixes(t))
    assert len(set(print_.values())) == len(print_)
    assert fingerprints(empty).count() == 0
    one = rows(fingerprints(docs.where("doc_id = 0")))
    assert len(one) == 1 and one[0]["near_next"] == 1


def plain_fingerprint(text, k=16, keep=64):
    """The whole text's hash and the hashes of its spans, by the definition: sums of code point times base to the place."""
    if not text:
        return "", set()

    def mixed(codes):
        h = 0
        for p, b in ((2147483647, 911382323), (2147483629, 972663749)):
            h = h << 31 | sum(c * pow(b, i, p) for i, c in enumerate(codes)) % p
        h = h * 0x9E3779B97F4A7C15 % (1 << 64)
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 % (1 << 64)
        return h ^ h >> 32

    codes = [ord(c) + 1 for c in text]
    n = min(k, len(codes))
    low = sorted({mixed(codes[i : i + n]) for i in range(len(codes) - n + 1)})[:keep]
    return f"{mixed(codes):016x}" + "".join(f"{h >> 32:08x}" for h in low), {f"{h >> 32:08x}" for h in low}


def test_fingerprints_against_plain_version(spark):
    import random

    from sediment.llm.fingerprints import fingerprints

    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh é\U0001d49c") for _ in range(300))
    texts = ["", "x", "short text", base, base[:150] + "another end of the text", base, base[:7] * 30, None, "y" * 400]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randint(10, 200))) for _ in range(12)]
    out = {r.doc_id: r for r in fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}

    def likeness(a, b):
        (x, s), (y, t) = a, b
        if x == y:
            return 1.0
        both = sorted(s | t)[:64]
        j = sum(v in s and v in t for v in both) / max(len(both), 1)
        return 2 * j / (1 + j)

    for d in range(len(texts)):
        t, following = texts[d] or "", texts[d - 1] or ""  # the next one in descending id; after the last the first
        half = len(t) // 2
        own, edited, nxt = (plain_fingerprint(x) for x in (t, t[: len(t) - half] + following[:half], following))
        r = out[d]
        assert (r.fingerprint, r.edited_fingerprint) == (own[0], edited[0])
        assert r.near_edited == pytest.approx(likeness(own, edited)) and r.near_next == pytest.approx(likeness(own, nxt))


def test_repeated_rows_are_dealt_over_ranges(spark):
    """A third of the rows repeat one row with a null id: no range is much larger than the others, and each row is told once."""
    from sediment.llm.fingerprints import fingerprints, successors

    data = [(None, "the same row again and again " * 3)] * 600 + [(i, f"text number {i} " * 6) for i in range(1200)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    dealt = Counter(r.r for r in successors(docs, "doc_id", "text", range_bytes=6000).where("marker = 0").select("r").collect())
    assert sum(dealt.values()) == len(data) and len(dealt) > 12
    assert max(dealt.values()) <= 2.5 * len(data) / len(dealt)
    out = rows(fingerprints(docs))
    assert Counter(r["doc_id"] for r in out) == Counter(d for d, _ in data)
    assert sum(r["near_next"] == 1 for r in out if r["doc_id"] is None) == 599


def test_spans_and_extensions():
    from sediment.llm.fingerprints import Prefixes

    a, b = Prefixes("the quick brown fox jumps"), Prefixes("a quick brown fox sleeps")
    assert a.equal(4, b, 2, 16) and not a.equal(4, b, 2, 17) and not a.equal(20, b, 2, 16)
    assert a.extension(4, b, 2) == 16 and a.extension(0, b, 0) == 0 and a.extension(25, b, 24) == 0
    h = Prefixes("abcabcabc").spans(3)
    assert h[0] == h[3] == h[6] and len(set(h.tolist())) == 3


def test_substring_dedup(docs, empty):
    from sediment.llm.substring_dedup import remove_repeats

    big = 1 << 62
    data = [(r.doc_id if r.doc_id is not None else big, WORD.findall(r.text or "")) for r in docs.collect()]
    for length in (50, 15):
        owner = {}
        for d, w in data:
            for i in range(len(w) - length + 1):
                k = tuple(w[i : i + length])
                owner[k] = min(owner.get(k, big), d)
        want = Counter()
        for d, w in data:
            gone = [False] * len(w)
            for i in range(len(w) - length + 1):
                if owner[tuple(w[i : i + length])] < d:
                    gone[i : i + length] = [True] * length
            kept = " ".join(x for x, g in zip(w, gone) if not g)
            want[d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
        out = rows(remove_repeats(docs, length, keep_text=True))
        assert Counter((r["doc_id"] if r["doc_id"] is not None else big, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == want
        assert all(sum(s["stop"] - s["start"] for s in r["removed"]) == r["n_removed"] and len(r["kept_text"].split()) <= r["n_words"] for r in out)
    assert remove_repeats(empty).count() == 0


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_second_lane_of_word_runs():
    """Words built so that polynomials modulo a power of two agree are told apart by the prime lane; it is the same wherever
    a run stands and however its words are parted."""
    import pyarrow as pa

    from sediment.llm.words import blocks

    texts = [thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a"), "x  y\tz one two", "y z", "yz", "one two\nx y z"]
    ((_, _, block),) = blocks(pa.array([t.encode() for t in texts], pa.large_binary()), False)
    assert block.hashes[0] == block.hashes[1] and block.runs(np.array([0]), 1) == block.runs(np.array([1]), 1)
    at = block.first
    lane = lambda d, i, n: int(block.check(np.array([at[d] + i]), n)[0])
    assert lane(0, 0, 1) != lane(1, 0, 1)
    assert lane(2, 1, 2) == lane(3, 0, 2) == lane(5, 3, 2) != lane(4, 0, 1)
    assert lane(2, 0, 3) == lane(5, 2, 3) and lane(2, 3, 2) == lane(5, 0, 2)
    ((_, _, folded),) = blocks(pa.array([b"Two Words", b"two wORDS"], pa.large_binary()), True)
    one, two = folded.check(np.array([0, 2]), 2)
    assert one == two


def test_substring_dedup_of_words_whose_hashes_meet(spark):
    from sediment.llm.substring_dedup import remove_repeats

    around = [f"w{i}" for i in range(60)]
    a, b = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    text = lambda x: " ".join([*around[:25], x, *around[25:49]])
    docs = spark.createDataFrame([(1, text(a)), (2, text(b)), (3, text(a))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in rows(remove_repeats(docs))} == {1: 0, 2: 0, 3: 50}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="home">
<header><a href=/>Site</a></header><nav><ul><li><a>Home</a><li>About</ul></nav><div class="ad">Buy &amp; save</div>
<article><h1>Head &lt;1&gt;</h1><p>One<b>two</b>
 three&nbsp;four.<br>five<p>Last &amp;amp; &#233;<div class="share-links">Share</div><aside>Related</aside><ul><li>a</li><li>b</li></ul></article>
<section id="comments"><article><p>Nice post</p></article></section><footer>&copy; host</footer></body></html>"""


def test_html(spark):
    from sediment.llm.html_text import extract

    menu = "<div>Home News Sport Weather Travel Money More</div>"
    plain = [f"<html><body>{menu}<p>own words of page number {i} " + " ".join(f"w{i}x{j}" for j in range(9)) + f"</p><div>Terms of use and other small print here</div></body>" for i in range(5)]
    data = [(1, "https://a.example/1", PAGE), (2, None, None), (3, "x", ""), (4, "https://a.example/2", "plain text only"), (5, "https://a.example/3", "<p>unclosed <b>tags <div>next")]
    data += [(10 + i, f"https://b.example/{i}", h) for i, h in enumerate(plain)] + [(20, "https://c.example", plain[0])] * 2
    out = {r["page_id"]: r for r in rows(extract(spark.createDataFrame([(*d, "clash") for d in data], "page_id long, url string, html string, text string")))}
    assert out[1]["text"] == "Head <1>\nOnetwo three four. five\nLast &amp; é\na\nb"
    assert out[2]["text"] == out[3]["text"] == "" and out[4]["text"] == "plain text only" and out[5]["text"] == "unclosed tags\nnext"
    for i in range(5):
        assert out[10 + i]["text"] == f"own words of page number {i} " + " ".join(f"w{i}x{j}" for j in range(9))
    assert out[20]["text"].startswith("Home News") and all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_runs_of_a_large_host(spark):
    """What counts as shared is the same however a host's pages are dealt; the plain version counts runs over whole hosts."""
    from sediment.llm.html_text import extract

    rng = np.random.default_rng(8)
    notes = [" ".join(f"note{k}x{j}" for j in range(12)) for k in range(8)]
    pages, words = [], []
    for i in range(160):
        blocks = [[f"p{i}b{b}x{j}" for j in range(rng.integers(1, 12))] for b in range(2)]
        blocks += [notes[k].split() for k in range(8) if i % (80, 53, 41, 20, 11, 7, 3, 1000)[k] == 0]
        words.append([w for b in blocks for w in b])
        text = "".join(f"<div>{' '.join(b)}</div>" for b in blocks)
        pages.append((i, f"https://{'big' if i < 150 else 'small'}.example/{i}", f"<body>{text}<article>own {i}</article></body>" if i % 10 == 1 else f"<body>{text}</body>"))
    on = defaultdict(set)
    for i, w in enumerate(words):
        for j in range(len(w) - 5):
            on[i < 150, tuple(w[j : j + 6])].add(i)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for group in (1000, 10):
        out = {r["page_id"]: r["text"] for r in rows(extract(df, group_pages=group))}
        for i, w in enumerate(words):
            gone = [False] * len(w)
            for j in range(len(w) - 5):
                if len(on[i < 150, tuple(w[j : j + 6])]) >= 3:
                    gone[j : j + 6] = [True] * 6
            want = ["own", str(i)] if i % 10 == 1 else [x for x, g in zip(w, gone) if not g]
            assert out[i].split() == want, (group, i)


def test_html_marks(spark):
    """Wrappers that only look like chrome, elements that are never closed, and boilerplate inside articles."""
    from sediment.llm.html_text import blocks, extract

    text = lambda h: [t for k, t in blocks(h) if k == 2]
    assert text('<div class="layout has-sidebar"><article><p>body</p></article></div>') == ["body"]
    assert text('<article class="post comments-open"><p>body</p></article>') == ["body"]
    assert text("<article><p>one</p><svg><path d='x'/><p>two</p></article>") == ["one", "two"]
    assert text("<article><p>one</p><svg><text>no</text></svg><p>two</p></article>") == ["one", "two"]
    assert text('<div class="page-header"><article><p>body</p></article></div>') == ["body"]
    assert text('<article><p>body</p><div id="comments"><article><p>reader</p></article></div></article>') == ["body"]
    assert text('<article><p>body</p><aside><article><p>teaser</p></article></aside><p>more</p></article>') == ["body", "more"]
    assert text('<body class="sidebar-open"><main><p>body</p></main></body>') == ["body"]
    notice, licence = "this site uses small files to remember what you read", "all may copy this text under the same terms"
    page = lambda i: f"<body><div class='x{i}'>{notice}</div><article><p>own words {i} of this page</p><p>{notice}</p><p>{licence}</p></article></body>"
    df = spark.createDataFrame([(i, f"https://h.example/{i}", page(i)) for i in range(40)] + [(90, "https://other.example/1", page(90))], "page_id long, url string, html string")
    for group in (1000, 5):
        out = {r["page_id"]: r["text"] for r in rows(extract(df, group_pages=group))}
        assert all(out[i] == f"own words {i} of this page\n{licence}" for i in range(40))
        assert out[90] == f"own words 90 of this page\n{notice}\n{licence}"


def test_covered_tokens():
    """Covered tokens, block by block, against a plain search of token strings."""
    from sediment.llm.html_text import covered, group_runs

    rng = np.random.default_rng(3)
    streams = [[f"t{x}" for x in rng.integers(0, 3, rng.integers(0, 40))] for _ in range(25)]
    for n in (2, 5):
        h, pages = group_runs(streams, n)
        on = defaultdict(set)
        for p, s in enumerate(streams):
            for i in range(len(s) - n + 1):
                on[tuple(s[i : i + n])].add(p)
        assert sorted(pages.tolist()) == sorted(map(len, on.values())) and len(np.unique(h, axis=0)) == len(on)
        marks = covered(streams, h[pages >= 3], n)
        for s, m in zip(streams, marks):
            want = [False] * len(s)
            for i in range(len(s) - n + 1):
                if len(on[tuple(s[i : i + n])]) >= 3:
                    want[i : i + n] = [True] * n
            assert m.tolist() == want


def test_suffix_array():
    from sediment.llm.html_text import common_prefixes, suffix_array

    rng = np.random.default_rng(1)
    for n in (1, 2, 60, 300):
        t = rng.integers(0, 3, n)
        order, ranks = suffix_array(t)
        assert order.tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
        lcp = common_prefixes(order, ranks)
        for k in range(1, n):
            a, b = t[order[k - 1] :], t[order[k] :]
            m = min(len(a), len(b))
            assert lcp[k] == next((i for i in range(m) if a[i] != b[i]), m)


def test_no_name_clashes(docs):
    """Columns named as the operators' own come through unchanged."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from sediment.llm import language_id, line_dedup, mixing, sharding

    own = ["_p", "pair", "_i", "i", "_k", "k", "_id", "_rk", "rk", "_gone", "gone", "_source", "_s", "_o", "_row", "row", "_b", "b", "_k1", "_k2", "_k3", "_r", "_n", "c0", "takes", "words", "path", "at", "number", "order"]
    base = docs.where("doc_id < 30").select("doc_id", "text", "source", "lang", F.col("n_chars"))
    odd = base.select("*", *[F.concat(F.lit(f"{c}/"), F.col("doc_id").cast("string")).alias(c) for c in own])
    model = language_id.train(base, F.lit(True))
    for f in (lambda d: language_id.identify(d, model), line_dedup.dedup_lines, mixing.mix, lambda d: sharding.shard(d, 4)):
        plain, found = rows(f(base)), rows(f(odd))
        kept = [c for c in own if c != "takes" or "takes" not in plain[0]]
        assert len(found) == len(plain) and all(r[c] == f"{c}/{r['doc_id']}" for r in found for c in kept)
        one = lambda r: tuple((k, str(r[k])) for k in sorted(plain[0]) if k not in ("slot", "shard"))  # noqa: B023, E731
        assert Counter(map(one, found)) == Counter(map(one, plain))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(docs.sparkSession, odd, "")
        assert out.columns == odd.columns, name
        assert all(r[c] == f"{c}/{r['doc_id']}" for r in rows(out) for c in own), name


def test_a_full_memory_changes_nothing(spark, monkeypatch):
    """Ids with room for three words and pieces in a generation."""
    import public_tokenizers

    from sediment.llm import packing

    texts = ["to be, or not to be: that's it. " * 5, "né À l'été <|endoftext|> 12 12", "one two three four five one two six one"]
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    want = [packing.Tokens(path).ids(t) for t in texts]
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    few = packing.Tokens(path)
    assert [few.ids(t) for t in texts] == want and len(few.words) <= 3 and len(few.words.older) <= 3


def test_ids_of_a_column_are_the_tokenizers_own_in_any_stretch(monkeypatch):
    """Each text's ids against the whole tokenizer's; stretches of a few bytes and a memory of five pieces."""
    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer

    from sediment.llm import packing

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", "To be, OR not 2 be:42 THAT's it...", "  né\tÀ l'ÉTÉ ×÷ß Ÿ 5×3 \x00a\x1cb", "<|endoftext|>x <b>", "İſK 中文 e\u0301 a\u00a0b €5", "", "x" * 90 + "é" * 40 + " end", "\n\x0b\x0c\r"]
    whole = Tokenizer.from_file(path)
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for size, remembered in ((packing.STRETCH, packing.REMEMBERED), (24, 5), (1, 1)):
        monkeypatch.setattr(packing, "STRETCH", size)
        monkeypatch.setattr(packing, "REMEMBERED", remembered)
        t = packing.Tokens(path)
        column = pa.array(["skipped", *texts, "skipped"]).slice(1, len(texts))
        assert [np.frombuffer(x, "<u4").tolist() for x in t.texts(column)] == want, size
        many = list(t.texts(pa.array([f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)])))
        assert len(many) == 300 and (size > 1000 or len(t.pieces.pieces) <= remembered + size)


def test_whole_windows_skip_the_groups(spark):
    import public_tokenizers

    from sediment.llm.packing import pack

    df = spark.createDataFrame([(i, "word " * (2047 if i % 2 else 4100)) for i in range(12)], "doc_id long, text string").repartition(3)
    out = rows(pack(df, str(public_tokenizers.path("word_bpe_49k.json"))))
    whole = [r for r in out if r["length"] == 2048]
    assert len(whole) == 6 + 12 and len({r["sequence_id"] for r in whole}) == 18 and {r["offset"] for r in whole} == {0}
    assert not {r["sequence_id"] for r in whole} & {r["sequence_id"] for r in out if r["length"] < 2048}


def plain_pipeline(data):
    """(id, text, source) rows to the documents that the pipeline packs, a row each time one is taken."""
    low = lambda t: re.sub(r"[A-Z]", lambda m: m[0].lower(), t)
    big = (1 << 62, "")
    data = [r for r in data if r[1] is not None and any(unicodedata.category(c)[0] == "L" for c in r[1])]
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    owner = {}
    for d, t, _ in data:
        for x in t.split("\n"):
            owner[key(x)] = min(owner.get(key(x), big[0]), big[0] if d is None else d)
    kept = []
    for d, t, s in data:
        lines = [x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] >= (big[0] if d is None else d)]
        if len(lines) == len(t.split("\n")) or WORD.search("\n".join(lines)):
            kept.append((d, "\n".join(lines), s))
    group = {}
    for i, _, part in groups_of([(i, t) for i, (_, t, _) in enumerate(kept)], 5, 80, 100):
        group.setdefault(part, []).append(i)
    first = [min(g, key=lambda i: (kept[i][0] is None, kept[i][0] or 0, i)) for g in group.values()]
    kept = [kept[i] for i in first]
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    size = defaultdict(int)
    for _, t, s in kept:
        size[s] += len(WORD.findall(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, left, total, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set(names), 1.5 * sum(size.values()), {}
    while left:
        rate = total / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * rate > 2 * size[s]}
        if not full:
            target |= {s: weight[s] * rate for s in left}
            break
        target |= {s: 2 * size[s] for s in full}
        total -= sum(2 * size[s] for s in full)
        left -= full
    out = []
    for s in names:
        rest = int(target[s] + 1e-6)
        own = sorted((r for r in kept if r[2] == s), key=lambda r: md5(f"{'' if r[0] is None else r[0]}/{md5(r[1])}"))
        for d, t, _ in own * 2:
            words = WORD.findall(t)
            take = min(rest, len(words))
            rest -= take
            if take:
                out.append((d, t if take == len(words) else " ".join(words[:take])))
    return out


def test_pipeline_run(docs, spark, tmp_path):
    """run() as a whole against the plain version: every document it packs, and every piece's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    source = docs.where("doc_id is null or doc_id < 200 or doc_id >= 300").select("doc_id", "text", "lang", "source", "n_chars")
    near = docs.where("doc_id between 200 and 204 or doc_id = 300").select("doc_id", "text", "lang", "source", "n_chars")
    source.unionByName(near).repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    out = rows(corpus_pipeline.run(spark, f"file://{tmp_path}"))
    data = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"file://{tmp_path}/documents.parquet").collect()]
    plain = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    ids = [(d, np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, t in plain_pipeline(data)]
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in out if r["start"] == 0) == Counter((d, len(b) // 4) for d, b in ids)
    assert sum(r["length"] for r in out) == sum(len(b) // 4 for _, b in ids)
    pieces = Counter((r["doc_id"], r["doc_tokens"], r["start"], r["ids_crc32"]) for r in out)
    for d, b in ids:
        for r in out:
            if (r["doc_id"], r["doc_tokens"]) == (d, len(b) // 4) and zlib.crc32(b[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]:
                pieces.pop((r["doc_id"], r["doc_tokens"], r["start"], r["ids_crc32"]), None)
    assert not pieces


def test_pipeline_stages(docs, empty, spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = docs.columns
    for start in (docs, empty):
        d, n = start, None
        for name, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, "").cache()
            assert d.columns == names, name
            if name == "language_id" and start is docs:
                assert not {400, 401, 402, 404} & {r.doc_id for r in d.collect()} and d.where("doc_id < 60").count() == 60
            if name == "near_duplicates" and start is docs:
                assert d.where("doc_id between 200 and 305").count() <= 1
            n = d.count()
        assert (n > 0) == (start is docs)
        assert corpus_pipeline.STAGES[-1][1](spark, d, "").count() >= n


def test_pipeline_near_duplicates_by_row(spark):
    """Null and repeated ids: one row of each group stays, and a clean text with a duplicate's id does."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    text = lambda name, edit="": " ".join(f"{name}{i}" for i in range(60)) + edit
    data = [(None, text("a")), (None, text("a")), (None, text("a", " x")), (5, text("b")), (5, text("b")), (5, text("b", " y"))]
    data += [(1, text("c")), (7, text("c", " z")), (7, text("d")), (None, text("c")), (None, "   "), (None, "   "), (9, None), (9, None)]
    out = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(data, "doc_id long, text string").repartition(3), "").collect())
    group = lambda names: sum(n for (d, t), n in out.items() if t in names)
    assert group({text("a"), text("a", " x")}) == group({text("b"), text("b", " y")}) == 1
    assert group({text("c"), text("c", " z")}) == out[1, text("c")] == 1 and out[7, text("d")] == 1
    assert out[None, "   "] == 2 and out[9, None] == 2 and sum(out.values()) == 8
