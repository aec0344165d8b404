"""Queries p1, p3, p4 and p5 over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import asof_versions, json_field
from ..operators.intervals import continuous_periods
from ..operators.orphans import orphan_counts, orphan_references
from ..sources.tables import table
from ..streaming.changefeed import apply_journal


def _ms(properties: str, name: str) -> F.Column:
    """Epoch ms from JSON, written as number or as digit string; null if absent, null or neither."""
    return F.expr(f"try_cast(get_json_object({properties}, '$.{name}') as bigint)")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "facts").select("id", "src", "dst", F.col("created_at").alias("t"))
    edges = table(spark, sf_dir, "edges").select("id", "src", "dst", _ms("properties", "recorded_at").alias("t"))

    def refs(rows: DataFrame, name: str, parent: str) -> DataFrame:
        ends = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("ref")) for f in ("src", "dst")])
        return rows.select(F.lit(name).alias("ref_table"), F.col("id").alias("record_id"), "t", F.lit(parent).alias("parent_table"), F.inline(ends))

    entities = table(spark, sf_dir, "entities").select(
        F.lit("entities").alias("parent_table"), "id", F.col("created_at").alias("since"), F.col("expired_at").alias("until")
    )
    nodes = table(spark, sf_dir, "nodes").select(
        F.lit("nodes").alias("parent_table"), "id", _ms("properties", "recorded_at").alias("since"), _ms("properties", "deleted_at").alias("until")
    )
    return orphan_references(refs(facts, "facts", "entities").unionByName(refs(edges, "edges", "nodes")), entities.unionByName(nodes))


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(p1_found(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    episodes = (
        table(spark, sf_dir, "episodes")
        .select(F.col("id").alias("episode_id"), json_field(F.col("properties"), "entity_id").alias("entity_id"), "occurred_at")
        .filter(F.col("entity_id").isNotNull())
        .distinct()
    )
    return (
        asof_versions(episodes, table(spark, sf_dir, "entities"), "entity_id", "occurred_at")
        .filter(F.col("version_created_at").isNotNull())
        .select("episode_id", "entity_id", "version_created_at")
        .distinct()
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuous_periods(table(spark, sf_dir, "facts"), "src", "valid_at", "invalid_at")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_journal(spark, f"{sf_dir}/state_journal_deltas.parquet")


P1_SQL = """
WITH refs AS (
  SELECT DISTINCT ref_table, record_id, field, ref, t FROM (
    SELECT 'facts' AS ref_table, id AS record_id, 'src' AS field, src AS ref, created_at AS t FROM facts
    UNION ALL SELECT 'facts', id, 'dst', dst, created_at FROM facts
    UNION ALL SELECT 'edges', id, 'src', src, TRY_CAST(json_extract_string(properties, '$.recorded_at') AS BIGINT) FROM edges
    UNION ALL SELECT 'edges', id, 'dst', dst, TRY_CAST(json_extract_string(properties, '$.recorded_at') AS BIGINT) FROM edges)
  WHERE ref IS NOT NULL),
parents AS (
  SELECT 'facts' AS ref_table, id, created_at AS since, expired_at AS until FROM entities
  UNION ALL
  SELECT 'edges', id, TRY_CAST(json_extract_string(properties, '$.recorded_at') AS BIGINT),
         TRY_CAST(json_extract_string(properties, '$.deleted_at') AS BIGINT) FROM nodes),
judged AS (
  SELECT r.ref_table, r.record_id, r.field, r.ref, r.t, count(p.id) AS n,
         count(*) FILTER (WHERE p.id IS NOT NULL AND p.since <= r.t) AS known,
         count(*) FILTER (WHERE p.id IS NOT NULL AND p.since <= r.t AND (p.until IS NULL OR p.until > r.t)) AS live
  FROM refs r LEFT JOIN parents p ON p.ref_table = r.ref_table AND p.id = r.ref
  GROUP BY ALL),
found AS (
  SELECT DISTINCT ref_table, record_id, field,
    CASE WHEN n = 0 THEN 'missing' WHEN t IS NULL THEN NULL WHEN known = 0 THEN 'late' WHEN live = 0 THEN 'deleted' END AS reason,
    coalesce(strftime(make_timestamp(t * 1000), '%Y-%m'), 'unknown') AS period
  FROM judged)
"""

ORACLES = {
    "p1_found": P1_SQL + "SELECT ref_table, record_id, field, reason, period FROM found WHERE reason IS NOT NULL",
    "p1_counts": P1_SQL
    + "SELECT ref_table, period, reason, count(*) AS n_refs FROM found WHERE reason IS NOT NULL GROUP BY ref_table, period, reason",
    "p3_found": """
WITH e AS (
  SELECT DISTINCT id AS episode_id, json_extract_string(properties, '$.entity_id') AS entity_id, occurred_at AS t
  FROM episodes WHERE json_extract_string(properties, '$.entity_id') IS NOT NULL),
m AS (
  SELECT e.episode_id, e.entity_id, v.created_at AS version_created_at,
    row_number() OVER (PARTITION BY e.episode_id, e.entity_id, e.t ORDER BY v.valid_at DESC NULLS LAST, v.created_at DESC) AS rn
  FROM e JOIN entities v ON v.id = e.entity_id AND v.created_at <= e.t AND (v.valid_at IS NULL OR v.valid_at <= e.t)
    AND (v.invalid_at IS NULL OR v.invalid_at > e.t OR v.expired_at > e.t))
SELECT DISTINCT episode_id, entity_id, version_created_at FROM m WHERE rn = 1""",
    "p4_found": """
WITH i AS (
  SELECT DISTINCT src, coalesce(valid_at, -9000000000000000) AS s, coalesce(invalid_at, 9000000000000000) AS e FROM facts
  WHERE src IS NOT NULL AND (valid_at IS NULL OR invalid_at IS NULL OR invalid_at > valid_at)),
r AS (SELECT *, max(e) OVER (PARTITION BY src ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM r),
p AS (SELECT src, grp, min(s) AS s, max(e) AS e FROM g GROUP BY src, grp),
n AS (SELECT *, lead(s) OVER (PARTITION BY src ORDER BY s) AS nxt FROM p)
SELECT src, 'period' AS kind, CASE WHEN s = -9000000000000000 THEN -1 ELSE s END AS start_ms,
       CASE WHEN e = 9000000000000000 THEN -1 ELSE e END AS end_ms FROM n
UNION ALL SELECT src, 'gap', e, nxt FROM n WHERE nxt IS NOT NULL""",
    "p5_found": """
WITH d AS (
  SELECT *, row_number() OVER (PARTITION BY store_id, generation ORDER BY received_at DESC) AS rn
  FROM (SELECT DISTINCT store_id, generation, upserted_documents, deleted_document_ids, received_at FROM state_journal_deltas)),
w AS (SELECT * FROM d WHERE rn = 1),
u AS (
  SELECT store_id, generation, i AS place, upserted_documents[i].document_id AS document_id, upserted_documents[i].document_hash AS document_hash
  FROM (SELECT *, unnest(range(1, len(upserted_documents) + 1)) AS i FROM w)),
x AS (SELECT store_id, generation, 0 AS place, unnest(deleted_document_ids) AS document_id, NULL AS document_hash FROM w),
l AS (
  SELECT *, row_number() OVER (PARTITION BY store_id, document_id ORDER BY generation DESC, place DESC) AS rn
  FROM (SELECT * FROM u UNION ALL SELECT * FROM x) WHERE document_id IS NOT NULL)
SELECT store_id, document_id, document_hash FROM l WHERE rn = 1 AND place > 0""",
}

QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found}
