import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, shard string, id string, n int, score string, h string"


def make(spark, rows):
    """documents with columns whose names clash with the operators' own."""
    full = [(i, t, lang, s, None if t is None else len(t), "clash", "clash", "clash", "clash", 1, "clash", "clash") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, shared passages, near and exact copies."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage = words(rng, 70, vocabulary)
    rows = [(i, words(rng, rng.randint(1, 160), vocabulary), ("en", "fr")[i % 2], f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, f"{words(rng, 20, vocabulary)}\n{passage}\n{words(rng, 25, vocabulary)}", "en", "s0") for i in range(8)]
    base = words(rng, 200, vocabulary)
    for i in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((200 + i, " ".join(w), "fr", None))
    rows += [(300 + i, base, "fr", "s1") for i in range(5)]
    rows += [(400, None, "en", "s1"), (401, "", "en", "s1"), (402, "   \n\t\n ", None, None), (403, "one", "en", "s2"), (404, "123 456 !!", "en", "s2")]
    rows += [(None, base, "fr", "s1"), (None, None, None, None), (None, "lonely text of a row without id", "en", "s3"), (None, "lonely text of a row without id", "en", "s3")]
    rows += [(500, "twice the same row\nShared line of text", "en", "s3")] * 2
    rows += [(600, "Shared line of text  \nshort\nshort\nown line number one", "en", "s3"), (601, "  shared LINE of text\nÉtat de fait\nétat de fait\nshort", "fr", "s3")]
    rows += [(700, words(rng, 6000, vocabulary), "en", "s2"), (701, "x" * 30000, "en", "s2"), (702, "né \U0001d49c   tail " * 30, "fr", "s2")]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return make(spark, odd_rows()).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
