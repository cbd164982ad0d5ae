"""The security master: identifiers, securities and memberships as of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import valid_at


def normal_cik(c: Column) -> Column:
    """Digits only, ten at most, padded with zeros; null otherwise."""
    t = F.trim(c)
    return F.when(t.rlike("^[0-9]{1,10}$"), F.lpad(t, 10, "0"))


def entity_asof(queries: DataFrame, history: DataFrame, entities: DataFrame, id_type: str = "cik") -> DataFrame:
    """queries (query_id, cik, as_of) with entity_id and n_entities (over 1: an integrity error).

    Identifier history valid at the date decides; only queries without any row there fall back to the entities' own cik.
    """
    h = history.where(F.col("identifier_type") == id_type).select(F.col("identifier_value").alias("cik"), F.col("entity_id").alias("h_entity"), "valid_from", "valid_to")
    by_history = queries.join(h, "cik").where(valid_at("as_of", "valid_from", "valid_to")).select("query_id", F.col("h_entity").alias("entity_id"), F.lit(0).alias("way"))
    e = entities.select("cik", F.col("entity_id").alias("e_entity"), "valid_from", "valid_to")
    by_cik = queries.join(e, "cik").where(valid_at("as_of", "valid_from", "valid_to")).select("query_id", F.col("e_entity").alias("entity_id"), F.lit(1).alias("way"))
    both = by_history.unionByName(by_cik).distinct()
    best = both.withColumn("_w", F.min("way").over(Window.partitionBy("query_id"))).where(F.col("way") == F.col("_w"))
    found = best.groupBy("query_id").agg(F.min("entity_id").alias("entity_id"), F.countDistinct("entity_id").alias("n_entities"))
    return queries.join(found, "query_id", "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0)))


def securities_asof(queries: DataFrame, securities: DataFrame, tickers: DataFrame) -> DataFrame:
    """queries (query_id, entity_id, as_of) with the entity's securities valid then, each with its ticker as of the date
    (the latest history row valid then, else the security's own) and whether it is tradable (not yet delisted)."""
    s = securities.select("entity_id", "security_id", F.col("ticker").alias("base_ticker"), F.col("valid_from").alias("s_from"), F.col("valid_to").alias("s_to"), "delisted_at")
    held = queries.join(s, "entity_id").where(valid_at("as_of", "s_from", "s_to"))
    t = tickers.select("security_id", F.col("identifier_value").alias("t_value"), F.col("valid_from").alias("t_from"), F.col("valid_to").alias("t_to"))
    named = held.join(t.withColumnRenamed("security_id", "t_security"), (F.col("security_id") == F.col("t_security")) & valid_at("as_of", "t_from", "t_to"), "left")
    keys = ["query_id", "entity_id", "as_of", "security_id", "base_ticker", "delisted_at"]
    out = named.groupBy(*keys).agg(F.max_by("t_value", "t_from").alias("t_value"))
    return out.select("query_id", "entity_id", "as_of", "security_id", F.coalesce("t_value", "base_ticker").alias("ticker"), (F.col("delisted_at").isNull() | (F.col("as_of") < F.col("delisted_at"))).alias("tradable"))


def in_universe(rows: DataFrame, membership: DataFrame, universe: str) -> DataFrame:
    """rows (security_id, as_of, ...) with in_universe: whether a membership of the universe covers the date."""
    m = membership.where(F.col("universe_name") == universe).select(F.col("security_id").alias("_s"), "membership_start", "membership_end")
    keys = rows.select("security_id", "as_of").distinct()
    hit = keys.join(m, (F.col("security_id") == F.col("_s")) & valid_at("as_of", "membership_start", "membership_end"), "left_semi").withColumn("_in", F.lit(True))
    return rows.join(hit, ["security_id", "as_of"], "left").withColumn("in_universe", F.coalesce("_in", F.lit(False))).drop("_in")


def resolve_filings(filings: DataFrame, history: DataFrame, entities: DataFrame, securities: DataFrame, membership: DataFrame, universe: str) -> DataFrame:
    """Filings (query_id, cik, as_of) to entity, securities, tickers, tradability and membership in one pass."""
    named = filings.withColumn("cik", normal_cik(F.col("cik")))
    found = entity_asof(named, history, entities).where("n_entities = 1").select("query_id", "entity_id", "as_of")
    tickers = history.where("identifier_type = 'ticker'").select("security_id", "identifier_value", "valid_from", "valid_to")
    return in_universe(securities_asof(found, securities, tickers), membership, universe)
