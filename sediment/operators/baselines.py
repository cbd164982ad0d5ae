"""Frequency and naive Bayes baselines, and the metrics that judge them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import first_of
from .tables import join_hot, stored


def words(text: str | Column) -> Column:
    """Lower-case runs of a-z and 0-9 of at least two characters."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 2)


def modal(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """The commonest value of each key (of all rows without keys); ties go to the smallest."""
    keys = keys or []
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    if keys:
        return first_of(counts, keys, [F.desc("n"), F.asc(value)])
    return counts.orderBy(F.desc("n"), F.asc(value)).limit(1)


def fit_bayes(docs: DataFrame, label: str, text: str) -> tuple[DataFrame, DataFrame, int]:
    """(classes, token counts by class, vocabulary size) of a multinomial model."""
    tokens = docs.select(F.col(label).alias("label"), F.explode(words(text)).alias("token"))
    by = tokens.groupBy("label", "token").agg(F.count("*").alias("n"))
    totals = by.groupBy("label").agg(F.sum("n").alias("total"))
    classes = docs.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("docs")).join(totals, "label", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return classes, by, by.select("token").distinct().count()


def predict_bayes(docs: DataFrame, model: tuple[DataFrame, DataFrame, int], id_col: str, text: str, alpha: float = 1.0) -> DataFrame:
    """(id, label, logp, prob) for every document and class; tokens outside the vocabulary are passed over.

    Known tokens are joined with their counts by class as one sparse vector a token, so a document's token meets each
    class once and classes without the token cost nothing but the smoothing term.
    """
    classes, by, vocabulary = model
    n = classes.agg(F.sum("docs")).first()[0] or 1
    v = alpha * max(1, vocabulary)
    vectors = by.groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("by"), F.sum("n").alias("times"))
    tokens = docs.select(F.col(id_col).alias("id"), F.explode(words(text)).alias("token")).groupBy("id", "token").agg(F.count("*").alias("k"))
    known = join_hot(stored(tokens, "bayes-tokens"), stored(vectors, "bayes-vectors"), "token", "times")
    cls = F.broadcast(classes.select("label", "docs", "total"))
    labels = F.lit([r["label"] for r in classes.select("label").collect()])
    per = known.withColumn("label", F.explode(labels)).join(cls, "label")
    count = F.coalesce(F.try_element_at("by", F.col("label")), F.lit(0))
    gain = per.groupBy("id", "label").agg(F.sum(F.col("k") * F.log((count + alpha) / (F.col("total") + v))).alias("gain"))
    all_ = docs.select(F.col(id_col).alias("id")).distinct().withColumn("label", F.explode(labels)).join(cls, "label")
    scored = all_.join(gain, ["id", "label"], "left").withColumn("logp", F.log(F.col("docs") / F.lit(float(n))) + F.coalesce("gain", F.lit(0.0)))
    w = Window.partitionBy("id")
    e = scored.withColumn("e", F.exp(F.col("logp") - F.max("logp").over(w)))
    return e.withColumn("prob", F.col("e") / F.sum("e").over(w)).select(F.col("id").alias(id_col), "label", "logp", "prob")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def set_metrics(df: DataFrame, truth: str, guess: str, none: str = "no_material_event") -> DataFrame:
    """Exact-set accuracy and micro precision, recall and F1; an empty set counts as the one label `none`."""
    a, b = (F.when(F.size(c) == 0, F.array(F.lit(none))).otherwise(F.col(c)) for c in (truth, guess))
    d = df.select(a.alias("a"), b.alias("b"))
    s = d.agg(
        F.count("*").alias("n"), F.count(F.when(F.array_sort("a") == F.array_sort("b"), 1)).alias("same"),
        F.sum(F.size(F.array_intersect("a", "b"))).alias("tp"), F.sum(F.size("a")).alias("na"), F.sum(F.size("b")).alias("nb"),
    )
    p, r = ratio(F.col("tp"), F.col("nb")), ratio(F.col("tp"), F.col("na"))
    return s.select(F.col("n").alias("rows"), ratio(F.col("same"), F.col("n")).alias("exact"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def calibration(df: DataFrame, prob: str, truth: str) -> DataFrame:
    """Brier score and expected calibration error over five bins; 1.0 falls into the last, empty bins count nothing."""
    y = F.col(truth).cast("double")
    bins = df.groupBy(F.least(F.floor(F.col(prob) * 5), F.lit(4)).alias("b")).agg(F.count("*").alias("n"), F.avg(prob).alias("p"), F.avg(y).alias("y"), F.sum((F.col(prob) - y) ** 2).alias("sq"))
    return bins.agg(F.sum("n").alias("rows"), ratio(F.sum("sq"), F.sum("n")).alias("brier"), ratio(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))), F.sum("n")).alias("ece"))


def covered(spans: Column) -> Column:
    """How many positions lie in a union of half-open spans (an array of start, stop): one walk over the spans in order of
    their starts, each of which adds what lies beyond the furthest stop so far. Null and empty spans cover nothing."""
    kept = F.filter(F.coalesce(spans, F.array().cast("array<struct<start:bigint,stop:bigint>>")), lambda s: s["stop"] > s["start"])
    kept = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].cast("long").alias("start"), s["stop"].cast("long").alias("stop"))))
    least = F.lit(-(1 << 63)).cast("long")
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["stop"] - F.greatest(s["start"], acc["far"]), F.lit(0))).alias("n"), F.greatest(acc["far"], s["stop"]).alias("far"))
    return F.aggregate(kept, F.struct(F.lit(0).cast("long").alias("n"), least.alias("far")), step, lambda acc: acc["n"])


def span_overlap(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Character precision, recall and F1 over the union of each side's half-open spans (arrays of start, stop).

    What both sides cover is what each covers less what they cover together, so the cost is that of the spans, not of
    the characters.
    """
    same = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<start:bigint,stop:bigint>>")), lambda s: F.struct(s["start"].cast("long").alias("start"), s["stop"].cast("long").alias("stop")))
    d = df.select(covered(F.col(truth)).alias("a"), covered(F.col(guess)).alias("b"), covered(F.concat(same(truth), same(guess))).alias("all"))
    s = d.agg(F.sum(F.col("a") + F.col("b") - F.col("all")).alias("tp"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p, r = ratio(F.col("tp"), F.col("nb")), ratio(F.col("tp"), F.col("na"))
    return s.select(p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def report(train: DataFrame, test: DataFrame, id_col: str, label: str, kind: str, text: str, alpha: float = 1.0, split: str = r"\|") -> DataFrame:
    """One row a baseline (global_frequency, filing_type_frequency, lexical_naive_bayes): exact-set accuracy, micro
    precision, recall and F1, Brier score and calibration error of its material probability, over the rows of test.

    A label column holds a signature: labels joined by a bar, empty for none; material is any signature but the empty one.
    """
    material = F.avg(F.when(F.col(label) != "", 1.0).otherwise(0.0))
    every = F.broadcast(train.agg(material.alias("all_prob")).join(modal(train, label).select(F.col(label).alias("all_guess")), F.lit(True)))
    own = modal(train, label, [kind]).select(kind, F.col(label).alias("own_guess")).join(train.groupBy(kind).agg(material.alias("own_prob")), kind)
    rows = stored(test.select(F.col(id_col).alias("id"), F.col(label).alias("truth"), kind, text), "report-rows")
    told = rows.drop(text).join(every, F.lit(True)).join(own, kind, "left")
    scored = stored(predict_bayes(rows, fit_bayes(train, label, text), "id", text, alpha), "report-bayes")
    best = first_of(scored, ["id"], [F.round("logp", 6).desc(), F.asc("label")]).select("id", F.col("label").alias("nb_guess"))
    prob = scored.groupBy("id").agg(F.sum(F.when(F.col("label") != "", F.col("prob")).otherwise(0.0)).alias("nb_prob"))
    told = told.join(best, "id").join(prob, "id")
    models = {"global_frequency": ("all_guess", "all_prob"), "filing_type_frequency": ("own_guess", "own_prob"), "lexical_naive_bayes": ("nb_guess", "nb_prob")}
    labels = lambda c: F.filter(F.split(c, split), lambda x: x != "")
    out = None
    for name, (guess, p) in models.items():
        g, q = F.coalesce(F.col(guess), F.col("all_guess")), F.least(F.greatest(F.coalesce(F.col(p), F.col("all_prob")), F.lit(0.0)), F.lit(1.0))
        d = told.select(labels(F.col("truth")).alias("a"), labels(g).alias("b"), q.alias("p"), (F.col("truth") != "").alias("y"))
        one = set_metrics(d, "a", "b").join(calibration(d, "p", "y").drop("rows"), F.lit(True)).select(F.lit(name).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out
