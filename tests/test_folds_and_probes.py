"""Digests as streams, probes over partitions and spans by their bounds, against plain versions."""

import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.operators import annotation, baselines, graph, probe
from sediment.operators.folds import ordered_digest


def test_a_large_group_is_joined_side_by_side(spark):
    """One group over many blocks and ranges, with nulls, empty and long values, beside small groups; its rows are sorted by
    ranges before the one stream."""
    value = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 7 == 1, "").when(F.col("id") == 50, F.repeat(F.lit("é"), 20000)).otherwise(F.concat(F.lit("v"), F.col("id").cast("string")))
    df = spark.range(6000).select(F.when(F.col("id") % 100 == 0, F.col("id")).when(F.col("id") % 100 == 1, None).otherwise(-1).alias("k"), (F.col("id") * 7919 % 6007).alias("i"), value.alias("v"))
    found = ordered_digest(df, ["k"], [F.col("i")], F.col("v"), start="s:", sep="|")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    groups = {}
    for r in sorted(df.collect(), key=lambda r: r.i):
        groups.setdefault(r.k, []).append(r.v)
    want = {k: (sha256(("s:" + "|".join(v for v in vs if v is not None)).encode()).hexdigest(), len(vs)) for k, vs in groups.items()}
    assert {r.k: (r.hash, r.n) for r in found.collect()} == want


def test_ordered_digest(spark):
    rng = random.Random(2)
    rows = [(None if i % 13 == 0 else "hot" if i % 3 else f"k{i % 40}", i, rng.choice([None, "", "é|", f"v{i}"])) for i in rng.sample(range(3000), 3000)]
    df = spark.createDataFrame(rows, "k string, i int, v string").repartition(5)
    got = {r.k: (r.hash, r.n) for r in ordered_digest(df, ["k"], [F.col("i")], F.col("v"), start="s:", sep="|").collect()}
    for k in {r[0] for r in rows}:
        own = sorted((i, v) for kk, i, v in rows if kk == k)
        assert got.pop(k) == (sha256(("s:" + "|".join(v for _, v in own if v is not None)).encode()).hexdigest(), len(own))
    assert not got and ordered_digest(df.limit(0), ["k"], [F.col("i")], F.col("v")).collect() == []


def test_a_group_of_many_batches_is_one_digest(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = ordered_digest(spark.range(5000).withColumn("k", F.lit(1)), ["k"], [F.col("id")], F.col("id")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r) for r in got] == [(1, sha256("".join(map(str, range(5000))).encode()).hexdigest(), 5000)]


def test_components_contract_hubs_alone(spark, monkeypatch):
    """Nodes of several rows, with null keys and null nodes, against a plain union; nodes that share one value are no link."""
    sizes = {}
    real = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: sizes.setdefault(name, out := real(df, name)) and out)
    alone = spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") % 10).alias("a"))
    assert {(r.event_id, r.component) for r in graph.components(alone, ["a"]).collect()} == {(i, i % 10) for i in range(1000)}
    assert sizes["ties"].isEmpty()
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(150)]), rng.choice([None, *range(60)]), rng.choice([None, *range(60)])) for _ in range(130)]
    of = {}
    find = lambda x: x if of.setdefault(x, x) == x else find(of[x])
    for n, a, b in rows:
        if n is not None:
            for v in (("a", a), ("b", b)):
                find(("n", n))
                if v[1] is not None:
                    of[find(v)] = find(("n", n))
    ids = {n for n, *_ in rows if n is not None}
    least = {}
    for n in sorted(ids):
        least.setdefault(find(("n", n)), n)
    got = graph.components(spark.createDataFrame(rows, "event_id long, a long, b long"), ["a", "b"]).collect()
    assert sorted((r.event_id, r.component) for r in got) == sorted((n, least[find(("n", n))]) for n in ids)


def test_split_of_known_components(spark):
    """A component of a third of all nodes; the split of a part of a release by the components it has."""
    rows = [(i, "hub" if i % 3 == 0 else f"e{i}") for i in range(90)]
    nodes = spark.createDataFrame(rows, "event_id long, entity string")
    parts = graph.components(nodes, ["entity"])
    got = {r.component: (r.hash, r.size) for r in graph.group_hashes(parts, "x").collect()}
    assert got[0] == (sha256(("x:" + "|".join(sorted(str(i) for i in range(0, 90, 3)))).encode()).hexdigest(), 30) and len(got) == 61
    whole = graph.split(nodes, ["entity"], "x", 0.2).collect()
    hashes = sorted((h, c, n) for c, (h, n) in got.items())
    want, upto = {}, 0
    for _, c, n in hashes:
        want[c] = "eval" if upto < 18 else "train"
        upto += n
    assert {r.component: r.part for r in whole} == want and len(whole) == 90
    assert sorted(map(tuple, graph.split_components(parts, "x", 0.2).collect())) == sorted(map(tuple, whole))
    assert graph.split(nodes.limit(0), ["entity"], "x", 0.2).collect() == []


def test_agreement_rows(spark):
    rows = [(1, "x", "x"), (2, "x", "y"), (3, None, "y"), (4, None, None), (5, "z", "z")]
    got = {tuple(r) for r in annotation.calibration_agreement(spark.createDataFrame(rows, "event_id long, a string, b string")).collect()}
    assert got == {("tasks", 5, None), ("completed_a", 3, None), ("completed_b", 4, None), ("paired", 3, None), ("agreed", 2, None), ("disagreed", 1, 2), ("incomplete", 1, 3), ("incomplete", 1, 4)}


# --- spans ------------------------------------------------------------------------------------------------------------


def test_spans_against_positions(spark):
    rng = random.Random(9)
    some = lambda: [(a := rng.randint(-5, 40), a + rng.randint(-3, 12)) for _ in range(rng.randint(0, 5))]
    rows = [(some(), some()) for _ in range(200)] + [(None, some()), (some(), None), ([], [])]
    got = baselines.span_overlap(spark.createDataFrame(rows, "a array<struct<start:int,stop:int>>, b array<struct<start:int,stop:int>>"), "a", "b").first()
    at = lambda spans: {i for s, e in spans or () for i in range(s, e)}
    tp, na, nb = (sum(len(x) for x in xs) for xs in ([at(a) & at(b) for a, b in rows], [at(a) for a, _ in rows], [at(b) for _, b in rows]))
    assert (got.precision, got.recall) == pytest.approx((tp / nb, tp / na)) and got.f1 == pytest.approx(2 * tp / (na + nb))


def test_long_spans_cost_their_bounds(spark):
    n = 10**8
    df = spark.createDataFrame([([(0, n), (n // 2, 2 * n)], [(n, 3 * n)])] * 50, "a array<struct<start:long,stop:long>>, b array<struct<start:long,stop:long>>")
    r = baselines.span_overlap(df, "a", "b").first()
    assert (r.precision, r.recall) == (0.5, 0.5)


# --- probes -----------------------------------------------------------------------------------------------------------


def logistic(x, y, c=1.0, balanced=True):
    """The same objective by dense Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    n, pos = len(y), float(y.sum())
    sw = np.where(y > 0, n / (2 * pos), n / (2 * (n - pos))) if balanced else np.ones(n)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve(np.eye(len(w)) + c * (x * (sw * p * (1 - p))[:, None]).T @ x, w + c * x.T @ (sw * (p - y)))
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return w


@pytest.mark.parametrize("balanced", [True, False])
def test_heads_equal_dense_newton(spark, balanced, monkeypatch):
    monkeypatch.setattr(probe, "TOGETHER", 8 * 49 * 2)  # two heads a pass
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)).round(3)
    targets = [[n for n, k in (("a", 0), ("b", 1), ("c", 2)) if x[i, k] + rng.normal() > 0.7] + ["all"] for i in range(400)]
    rows = [(i, t, v) for i, (t, v) in enumerate(zip(targets, x.tolist()))] + [(900, ["a"], None)]
    df = spark.createDataFrame(rows, "id int, targets array<string>, v array<double>").repartition(7)
    heads = {r.label: r for r in probe.fit_heads(df, "targets", "v", 0.7, balanced, labels=["a", "b", "c", "all", "never"]).collect()}
    for name in "abc":
        y = np.array([name in t for t in targets], float)
        assert heads[name].weights == pytest.approx(logistic(x, y, 0.7, balanced).tolist(), rel=1e-8, abs=1e-8)
    assert heads["all"].weights is None and heads["all"].rate == 1 and heads["never"].weights is None and heads["never"].rate == 0


def test_report_of_observed_and_constant_labels(spark):
    train = spark.createDataFrame([(i, ["material"] if v > 0 else [], [float(v), 0.0]) for i, v in enumerate((-3, -2, -1, 1, 2, 3))], "id int, targets array<string>, v array<double>")
    heads = probe.fit_heads(train, "targets", "v", balanced=False, labels=["material", "never_seen"])
    test = spark.createDataFrame([(7, [-2.5, 0.0], []), (8, [2.5, 0.0], ["material"])], "id int, v array<double>, truth array<string>")
    told = probe.predict_heads(test, heads, "id", "v")
    assert told.count() == 4 and {r.prob for r in told.where("label = 'never_seen'").collect()} == {0.0}
    r = probe.probe_report(told.join(test.select("id", "truth"), "id"), F.array_contains("truth", F.col("label"))).first()
    assert (r.micro_f1, r.exact_set_accuracy, r.validation_positive_cells, r.predicted_positive_cells, r.false_positive_cells) == (1.0, 1.0, 1, 1, 0)
    p = {(x.id, x.label): x.prob for x in told.collect()}
    assert r.maximum_probability == p[8, "material"] == r.maximum_positive_target_probability
    assert r.label_cell_brier == pytest.approx(np.mean([(p[7, "material"]) ** 2, (1 - p[8, "material"]) ** 2, 0, 0]))
    none = probe.probe_report(told.limit(0).withColumn("truth", F.lit(True)), F.col("truth")).first()
    assert none.validation_items == 0 and none.micro_f1 == 0 and none.maximum_probability == 0


def test_vectors_of_unequal_width_are_refused(spark):
    with pytest.raises(ValueError, match="between 1 and 2"):
        probe.fit_heads(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "l string, v array<double>"), "l", "v")
    assert probe.fit_heads(spark.createDataFrame([], "l string, v array<double>"), "l", "v", labels=["a"]).collect()[0].weights is None
