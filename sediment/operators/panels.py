"""Annotation queues from normalised documents, and panels of models made into one record a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import align_quote, near
from . import annotation, review
from .releases import contract
from .tables import stored


def calibration_tasks(normalized: DataFrame, knowledge: DataFrame, companies: DataFrame, expected: int | None = None, terms: list[str] = review.EVENT_TERMS) -> DataFrame:
    """One task for each normalised document (normalization_id, sections) with a knowledge record (normalization_id,
    record_id, entity_id, cik, accession_number, document_type, source_published_at, tradable_at).

    Both must hold the same documents (and `expected` of them). The relevant section is the review text of the sections,
    with the first paragraphs as candidate evidence; the prior disclosure is the review text of the entity's last document
    that was published strictly before. Documents without reviewable text are errors.
    """
    texts = stored(normalized.select("normalization_id", review.review_with_spans(review.top_sections(F.col("sections"), 6, terms)).alias("review")), "reviews")
    ids = [df.groupBy("normalization_id").agg(F.lit(True).alias(c)) for df, c in ((texts, "_n"), (knowledge, "_k"))]
    apart = ids[0].join(ids[1], "normalization_id", "full").where("_n is null or _k is null")
    contract(same_documents=apart.isEmpty(), expected_documents=expected is None or texts.count() == expected)
    told = texts.join(knowledge, "normalization_id")
    told = stored(told.select("*", F.col("review.text").alias("text"), F.col("review.spans").alias("candidate_evidence"), F.col("source_published_at").alias("published"), F.struct("normalization_id", "record_id").alias("task_id")).drop("review"), "review-texts")
    contract(reviewable_text=told.where("text = '' or size(candidate_evidence) = 0").isEmpty())
    out = annotation.prior_disclosure(told).join(companies.select("cik", F.col("name").alias("_name")), "cik", "left")
    return out.select(
        F.concat(F.lit("calibration-"), "record_id").alias("event_id"), F.coalesce("_name", F.concat(F.lit("SEC registrant CIK "), F.col("cik").cast("string"))).alias("company"), "entity_id",
        F.col("accession_number").alias("related_event_group"), "source_published_at", "tradable_at", F.col("document_type").alias("filing_type"), F.col("text").alias("relevant_section"),
        "candidate_evidence", F.col("prior").alias("prior_company_disclosure"), F.lit("calibration").alias("annotation_round"),
    )


def synthesized(decisions: DataFrame, rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """One record a task: decisions (task_number, task_id, labels, adjudicated, supporters) made of the supporting models'
    rows (model, task_number, task_id, labels, confidence, ambiguity_flag, attributes: array of struct label, field,
    value; evidence: array of struct label, quote) on the tasks' texts (task_id, text).

    An adjudicated task follows model A alone. Each attribute and the ambiguity flag are voted on, a label's evidence is
    the span that most models quote, the confidence is the median. error: a model's labels differ from the decision's, a
    task id is further than two edits from the task's, or a label has no evidence in the text.
    """
    sources = F.when(F.col("adjudicated"), F.array(F.lit("A"))).otherwise(F.col("supporters"))
    chosen = decisions.select("task_number", F.col("task_id").alias("event_id"), F.array_sort("labels").alias("final"), "adjudicated", F.explode(sources).alias("model"))
    told = stored(chosen.join(rows, ["task_number", "model"], "left"), "panel-rows")
    wrong = F.when(F.col("task_id").isNull(), "no_row").when(F.array_sort("labels") != F.col("final"), "other_labels").when(~near(F.col("task_id"), F.col("event_id")), "other_task")
    one = told.groupBy("task_number", "event_id", "final", "adjudicated").agg(
        F.median("confidence").alias("confidence"), F.array_sort(F.collect_set("model")).alias("source_models"), F.min(wrong).alias("wrong"),
        F.array_sort(F.collect_set(F.when(F.col("task_id") != F.col("event_id"), F.concat_ws("=", "model", "task_id")))).alias("task_id_repairs"),
    )
    flags = annotation.vote(told.select("task_number", "model", F.col("ambiguity_flag").alias("value")), ["task_number"])
    flags = flags.select("task_number", F.col("value").alias("ambiguity_flag"), F.col("rule").alias("ambiguity_rule"))
    cells = told.select("task_number", "model", F.explode("attributes").alias("a")).select("task_number", "model", "a.*").where(F.col("label").isNotNull())
    voted = annotation.vote(cells, ["task_number", "label", "field"])
    attributes = voted.groupBy("task_number").agg(F.array_sort(F.collect_list(F.struct("label", "field", "value", "rule"))).alias("attributes"))
    quotes = told.select("task_number", "event_id", "model", "final", F.explode("evidence").alias("q")).where(F.array_contains("final", F.col("q.label")))
    found = quotes.join(tasks.select(F.col("task_id").alias("event_id"), "text"), "event_id").withColumn("at", align_quote()("text", "q.quote"))
    spans = found.where("at.start is not null").select("task_number", F.col("q.label").alias("label"), "model", "at.start", "at.stop")
    best = annotation.evidence(spans, ["task_number", "label"]).groupBy("task_number").agg(F.array_sort(F.collect_list(F.struct("label", "start", "stop", "support"))).alias("evidence"))
    out = one.join(flags, "task_number", "left").join(attributes, "task_number", "left").join(best, "task_number", "left")
    bare = F.size(F.coalesce("evidence", F.array().cast("array<struct<label string, start int, stop int, support bigint>>"))) < F.size("final")
    return out.select(
        "task_number", F.col("event_id").alias("task_id"), F.col("final").alias("labels"), (F.size("final") == 0).alias("no_material_event"), "attributes", "evidence", "confidence",
        "ambiguity_flag", "ambiguity_rule", "source_models", "task_id_repairs", F.coalesce("wrong", F.when(bare, "no_evidence")).alias("error"),
    )
