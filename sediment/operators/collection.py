"""Runs over collected filings: normalisation with reuse, knowledge records, request logs and the ledger of experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filing import normalize_filings
from ..functions.text import canonical_json
from ..sources.sinks import checked_insert
from . import annotation, ranking
from .calendar import tradable_at


def knowledge_id(source: Column, policy: str) -> Column:
    return F.concat(F.lit("knowledge_"), F.sha2(F.concat(source, F.lit(f":{policy}")), 256))


def materialized(normalized: DataFrame, sources: DataFrame, days: DataFrame, policy: str, entities: DataFrame | None = None) -> DataFrame:
    """One row for each normalised document (normalization_id, source_document_id, output_hash): a knowledge record, or
    why there is none (skipped: missing_source, missing_acceptance, unresolved_entity).

    sources: document_id, accession_number, cik, acceptance_at. entities (cik, entity_id) resolves an entity; without it
    the cik is one by itself. Skipped rows have null record columns.
    """
    s = sources.select(F.col("document_id").alias("source_document_id"), F.lit(True).alias("_found"), "accession_number", "cik", "acceptance_at")
    told = normalized.join(s, "source_document_id", "left")
    if entities is None:
        told = told.withColumn("entity_id", F.concat(F.lit("sec-cik:"), F.col("cik").cast("string")))
    else:
        told = told.join(entities.select("cik", "entity_id"), "cik", "left")
    why = F.when(F.col("_found").isNull(), "missing_source").when(F.col("acceptance_at").isNull(), "missing_acceptance").when(F.col("entity_id").isNull(), "unresolved_entity")
    told = tradable_at(told.withColumn("skipped", why), days, "acceptance_at")
    ok = lambda c: F.when(F.col("skipped").isNull(), c)
    source = F.concat(F.lit("sec-normalized:"), F.col("normalization_id").cast("string"))
    return told.select(
        "normalization_id", "source_document_id", "skipped", ok(knowledge_id(source, policy)).alias("record_id"), ok(F.col("entity_id")).alias("entity_id"),
        ok(F.concat_ws(":", "accession_number", F.col("source_document_id").cast("string"))).alias("knowledge_key"), ok(source).alias("source_id"), ok(F.col("output_hash")).alias("content_hash"),
        ok(F.col("acceptance_at")).alias("source_published_at"), ok(F.col("tradable_at")).alias("tradable_at"),
    )


def normalization_run(sources: DataFrame, done: DataFrame, version: str, limit: int | None = None) -> DataFrame:
    """One row for each selected source (document_id, accession_number, document_type, sequence, content_hash, raw):
    status reused, completed or failed, its parent, what the normaliser made of it, and the error.

    limit takes documents from the accessions' prefixes in turn; None takes all. done (source_document_id, content_hash,
    parser_version, success) holds earlier results: those with the same hash and version are reused and not parsed. Bytes
    that don't have the declared hash fail; failures have null results. The rows go to the manifest by `upsert`.
    """
    exhibit = F.lower(F.coalesce("document_type", F.lit(""))).startswith("ex-")
    primary = sources.where(~exhibit).groupBy("accession_number").agg(F.min(F.struct(F.col("sequence").cast("int"), "document_id")).alias("p")).select("accession_number", F.col("p.document_id").alias("primary_id"))
    chosen = sources if limit is None else annotation.round_robin(sources, F.substring("accession_number", 1, 10), "document_id", limit).drop("stratum", "turn")
    known = done.where((F.col("parser_version") == version) & F.col("success")).select(F.col("source_document_id").alias("document_id"), F.col("content_hash").alias("done_hash"))
    told = chosen.join(known, "document_id", "left").join(primary, "accession_number", "left").withColumn("is_exhibit", exhibit)
    right = F.sha2("raw", 256) == F.col("content_hash")
    status = F.when(F.coalesce(F.col("done_hash") == F.col("content_hash"), F.lit(False)), "reused").when(right, "completed").otherwise("failed")
    told = told.withColumn("status", status)
    # Only bytes that are to be parsed reach the parser.
    made = normalize_filings(told.withColumn("_raw", F.when(F.col("status") == "completed", F.col("raw"))).drop("is_exhibit", "raw"), "_raw", "document_type")
    ok = lambda c: F.when(F.col("status") == "completed", F.col(c)).alias(c)
    return made.select(
        F.col("document_id").alias("source_document_id"), "content_hash", F.lit(version).alias("parser_version"), "status", "is_exhibit",
        F.when(F.col("is_exhibit"), F.col("primary_id")).alias("parent_document_id"), ok("language"), ok("parsing_quality"), ok("warnings"), ok("sections"),
        F.when(F.col("status") == "completed", F.sha2(F.to_json("sections"), 256)).alias("output_hash"), (F.col("status") != "failed").alias("success"),
        F.when(F.col("status") == "failed", F.lit("ValueError: source content hash does not match the manifest")).alias("error"),
    )


def request_log(log: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """log (request_id, ...) with new requests appended in order, numbered on from the last one; nothing is replaced."""
    last = log.agg(F.max("request_id")).first()[0] or 0
    return log.unionByName(ranking.numbered(new, order, "_n").withColumn("request_id", F.col("_n") + F.lit(last)).select(*log.columns))


def ledger_rows(runs: DataFrame) -> DataFrame:
    """runs (run_id, model_version, config JSON) with config as canonical JSON and its sha256 as config_hash."""
    told = runs.withColumn("config", canonical_json(True)("config"))
    return told.withColumn("config_hash", F.sha2("config", 256))


def record_runs(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows to append to the ledger; a run that is stored with the same config is no change, with another one an error."""
    return checked_insert(ledger, ledger_rows(runs), "run_id", "config_hash")


def run_of(ledger: DataFrame, run_id: str) -> DataFrame:
    return ledger.where(F.col("run_id") == run_id)
