"""Linear probes: one L2 logistic head for each label on given vectors, fitted by Newton steps over all partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .baselines import f1, ratio
from .tables import discard, stored

#: Bytes of Hessians that a task sums at a time: heads beyond it are another pass over the rows.
TOGETHER = 64 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows, with 1 for the intercept at the end."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    return np.column_stack([x, np.ones(len(column))])


def chances(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights.T, -500, 500)))


def newton_sums(rows: DataFrame, heads: list[str], weights: np.ndarray, weighing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients (heads, d) and Hessians (heads, d, d) of the weighted log loss over all rows (targets, v).

    Each partition adds up its rows' parts, and the parts are added by (head, row of the Hessian), so what is shuffled is
    a model's size a partition and what the driver gets is a model's size, however many rows there are.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    d = weights.shape[1]

    def part(batches):
        g, h = np.zeros((len(heads), d)), np.zeros((len(heads), d, d))
        for b in batches:
            x = matrix(b.column(1))
            if not len(x):
                continue
            p = chances(x, weights)
            targets = [set(t) for t in b.column(0).to_pylist()]
            for i, head in enumerate(heads):
                y = np.fromiter((head in t for t in targets), float, len(targets))
                w = np.where(y > 0, weighing[i, 1], weighing[i, 0])
                g[i] += (w * (p[:, i] - y)) @ x
                h[i] += (x * (w * p[:, i] * (1 - p[:, i]))[:, None]).T @ x
        whole = np.concatenate([h, g[:, None, :]], axis=1).reshape(-1, d)
        head, i = np.divmod(np.arange(len(whole)), d + 1)
        yield pa.record_batch([pa.array(head, pa.int32()), pa.array(i, pa.int32()), pa.array(whole.tolist(), pa.list_(pa.float64()))], ["head", "i", "v"])

    sums = rows.mapInArrow(part, "head int, i int, v array<double>").groupBy("head", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    out = np.zeros((len(heads), d + 1, d))
    for r in sums.collect():
        out[r["head"], r["i"]] = r["v"]
    return out[:, d], out[:, :d]


def fit_heads(df: DataFrame, label: str, vector: str, c: float = 1.0, balanced: bool = True, labels: list[str] | None = None, steps: int = 50) -> DataFrame:
    """(label, rate, weights): a head a label of the ontology (or found), against the rest; the intercept is the last weight.

    label is a string or an array of strings. Weights minimise |w|^2 / 2 + c * weighted log loss, the intercept penalised
    like the others; balanced weighs a label's rows and the others n / (2 * count). A label of all rows or none gets a
    constant head (null weights). All heads take their Newton steps together, a pass over the rows a step; a head rests
    once its step is below 1e-10. Rows without a vector teach nothing; vectors of unequal width are an error; a null
    label is a row of no label.
    """
    spark = df.sparkSession
    target = F.col(label).cast("array<string>") if df.schema[label].dataType.typeName() == "array" else F.array_compact(F.array(F.col(label).cast("string")))
    rows = df.where(F.col(vector).isNotNull()).select(F.coalesce(target, F.array().cast("array<string>")).alias("targets"), F.col(vector).cast("array<double>").alias("v"))
    rows = stored(rows, "probe-rows")
    n, low, high = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if low != high:
        raise ValueError(f"vectors have between {low} and {high} values")
    counts = dict(map(tuple, rows.select(F.explode(F.array_distinct("targets")).alias("l")).groupBy("l").count().collect()))
    heads = sorted(labels if labels is not None else counts)
    fitted = [h for h in heads if 0 < counts.get(h, 0) < n]
    weights = {h: np.zeros((high or 0) + 1) for h in fitted}
    weigh = lambda h: (n / (2 * (n - counts[h])), n / (2 * counts[h])) if balanced else (1.0, 1.0)
    size = max(1, TOGETHER // (8 * ((high or 0) + 1) ** 2))
    moving = list(fitted)
    for _ in range(steps):
        still = []
        for at in range(0, len(moving), size):
            some = moving[at : at + size]
            g, hessian = newton_sums(rows, some, np.stack([weights[h] for h in some]), np.array([weigh(h) for h in some]))
            for i, h in enumerate(some):
                step = np.linalg.solve(np.eye(len(g[i])) + c * hessian[i], weights[h] + c * g[i])
                weights[h] = weights[h] - step
                if np.abs(step).max() >= 1e-10:
                    still.append(h)
        moving = still
        if not moving:
            break
    discard(rows)
    out = [(h, counts.get(h, 0) / n if n else 0.0, weights[h].tolist() if h in weights else None) for h in heads]
    return spark.createDataFrame(out, "label string, rate double, weights array<double>")


def predict_heads(df: DataFrame, heads: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, label, prob): all heads on all rows; the heads, a model's size, go to every task. Rows without a vector have none."""
    model = sorted((r["label"], r["rate"], r["weights"]) for r in heads.collect())
    live = [m for m in model if m[2]]
    rows = df.where(F.col(vector).isNotNull()).select(id_col, F.col(vector).cast("array<double>").alias("v"))
    kinds = T.StructType([rows.schema[id_col], T.StructField("label", T.StringType()), T.StructField("prob", T.DoubleType())])
    weights = np.array([m[2] for m in live]) if live else np.zeros((0, 1))

    def run(batches):
        for b in batches:
            told = np.empty((len(b), len(model)))
            told[:, [i for i, m in enumerate(model) if m[2]]] = chances(matrix(b.column(1)), weights) if live and len(b) else 0
            for i, (_, rate, w) in enumerate(model):
                if not w:
                    told[:, i] = float(rate > 0.5)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(b)), len(model))))
            names = pa.array([m[0] for m in model] * len(b), pa.string())
            yield pa.record_batch([ids, names, pa.array(told.reshape(-1))], [id_col, "label", "prob"])

    return rows.mapInArrow(run, kinds)


def probe_report(predicted: DataFrame, truth: Column, threshold: float = 0.5) -> DataFrame:
    """One row of metrics over cells (id, label, prob), where truth says whether the cell's label is one of its row:
    exact_set_accuracy, micro_precision, micro_recall, micro_f1, label_cell_brier, the cells counted, and the largest
    probabilities. Every id should have a cell a label. Without rows all are 0."""
    y = F.coalesce(truth, F.lit(False))
    cells = predicted.select(F.col(predicted.columns[0]).alias("id"), "prob", y.alias("y"), (F.col("prob") >= threshold).alias("p"))
    count = lambda c: F.count(F.when(c, 1))
    by = cells.groupBy("id").agg(
        F.bool_and(F.col("p") == F.col("y")).alias("same"), count(F.col("y")).alias("y"), count(F.col("p")).alias("p"), count(F.col("y") & F.col("p")).alias("tp"),
        F.sum((F.col("prob") - F.col("y").cast("double")) ** 2).alias("sq"), F.count("*").alias("n"), F.max("prob").alias("top"), F.max(F.when(F.col("y"), F.col("prob"))).alias("top_true"),
    )
    s = by.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("y", "p", "tp", "n", "sq")], count(F.col("same")).alias("same"), F.count("*").alias("rows"), F.coalesce(F.max("top"), F.lit(0.0)).alias("top"), F.coalesce(F.max("top_true"), F.lit(0.0)).alias("top_true"))
    precision, recall = ratio(F.col("tp"), F.col("p")), ratio(F.col("tp"), F.col("y"))
    return s.select(
        F.col("rows").alias("validation_items"), ratio(F.col("same"), F.col("rows")).alias("exact_set_accuracy"), precision.alias("micro_precision"), recall.alias("micro_recall"), f1(precision, recall).alias("micro_f1"),
        ratio(F.col("sq"), F.col("n")).alias("label_cell_brier"), F.col("y").alias("validation_positive_cells"), F.col("p").alias("predicted_positive_cells"), F.col("tp").alias("true_positive_cells"),
        (F.col("p") - F.col("tp")).alias("false_positive_cells"), (F.col("y") - F.col("tp")).alias("false_negative_cells"), F.col("top").alias("maximum_probability"), F.col("top_true").alias("maximum_positive_target_probability"),
    )
