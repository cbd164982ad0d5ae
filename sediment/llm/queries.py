"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .oracles import COLLOCATIONS, LICENSES, MERKLE


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(documents(spark, sf_dir), str(public_tokenizers.path("word_bpe_49k.json")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    out = mix(documents(spark, sf_dir), carry=["doc_id"])
    at = lambda i: F.round(F.get("takes", F.lit(i))["position"], 6)
    return out.select("doc_id", "size", "source_size", "target", "taken", at(0).alias("first_position"), at(1).alias("second_position"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(documents(spark, sf_dir), 8, carry=["doc_id"])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import dedup

    return dedup(documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import similar_groups

    return similar_groups(documents(spark, sf_dir), k=3, num=90, den=100)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import held_out, identify, train

    docs = documents(spark, sf_dir)
    learns = ~held_out() & F.col("doc_id").isNotNull()
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), train(docs, learns)).drop("text")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir)).drop("removed")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(documents(spark, sf_dir))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(documents(spark, sf_dir))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(documents(spark, sf_dir)).drop("found")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_language_id": op7_language_id,
    "op8_fingerprints": op8_fingerprints,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_html_text": op10_html_text,
    "op11_collocations": op11_collocations,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_license_scan": op13_license_scan,
}

ORACLE_SQL = {
    "op4_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, o.owner IS NOT NULL AND o.owner < k.doc_id AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op5_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, (count(*) OVER (PARTITION BY sha))::BIGINT AS group_size,
       doc_id = first_value(doc_id) OVER g AS kept, sha AS text_sha256
FROM n WINDOW g AS (PARTITION BY sha ORDER BY n DESC, doc_id)
""",
    "op2_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))) AS o
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
fill(k, rate) AS (
  SELECT 0, (SELECT 1.5::DOUBLE * sum(source_size) / sum(weight) FROM w)
  UNION ALL
  SELECT k + 1, (SELECT (1.5::DOUBLE * sum(source_size) - sum(CASE WHEN weight * rate >= 2 * source_size THEN 2.0::DOUBLE * source_size ELSE 0 END))
                        / nullif(sum(CASE WHEN weight * rate >= 2 * source_size THEN 0 ELSE weight END), 0) FROM w)
  FROM fill WHERE k < 60 AND rate IS NOT NULL),
t AS (SELECT *, least(2.0::DOUBLE * source_size, weight * (SELECT max(rate) FROM fill)) AS target,
             CASE r % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS a, CASE r % 3 WHEN 0 THEN -1.0 WHEN 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS b FROM w),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.a, t.b, floor(t.target)::BIGINT AS goal,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, least(greatest(goal - pos, 0), size) AS w1, least(greatest(goal - pos - source_size, 0), size) AS w2,
         CASE WHEN target > 0 THEN pos / target END AS f1, CASE WHEN target > 0 THEN (pos + source_size) / target END AS f2 FROM p),
x AS (
  SELECT *, round(2 * f1 / (a + sqrt(greatest(a * a + 2 * b * f1, 0))), 6) AS p1,
         CASE WHEN w2 > 0 THEN round(2 * f2 / (a + sqrt(greatest(a * a + 2 * b * f2, 0))), 6) END AS p2 FROM q)
SELECT doc_id, size, source_size, target, (w1 + w2)::BIGINT AS taken, CASE WHEN w1 > 0 THEN p1 WHEN w2 > 0 THEN p2 END AS first_position,
       CASE WHEN w1 > 0 THEN p2 END AS second_position FROM x
""",
    "op11_collocations": COLLOCATIONS,
    "op12_merkle_manifest": MERKLE,
    "op13_license_scan": LICENSES,
}
