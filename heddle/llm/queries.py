"""Queries p2, p6, p7, p8 and p9 over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage, table
from .mix import mixture, mixture_report
from .neighbors import decoded_vectors, live_codes, nearest, sound_vectors
from .pack import fill_report, pack
from .repetition import repetition, repetitive
from .split import split_cases, split_faults, split_violations
from .tokens import spread, token_count

DIM = 64
#: Words that a document may say twice in one go.
LONGEST = 50


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "node_vectors").select(F.lit("node_vectors").alias("collection"), F.col("node_id").alias("item"), "vector")
    codes = live_codes(table(spark, sf_dir, "tvim_delta_segments"))
    return sound_vectors(spread(nodes), DIM).unionByName(decoded_vectors(codes, "tvim", DIM))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest(_collections(spark, sf_dir), min_cos=0.8)
    return near.select("collection", F.least("item", "other").alias("item_a"), F.greatest("item", "other").alias("item_b")).distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_cases(spread(table(spark, sf_dir, "chunk_cases"))).filter(F.col("piece").isNotNull()).select("case_id", "piece", "start", "stop", "text", "cut")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_faults(split_cases(spread(table(spark, sf_dir, "chunk_cases"))))


def p6_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces that break a rule of the splitting, judged without the splitter: there should be none."""
    cases = table(spark, sf_dir, "chunk_cases")
    return split_violations(cut_lineage(split_cases(spread(cases)), "pieces"), cases)


def _token_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut_lineage(documents.select("doc_id", token_count(F.col("text")).alias("tokens")), "sizes")


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_token_sizes(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p7_pack(spark, sf_dir))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixture(documents, table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_report(p8_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select("doc_id", "n_words", "n_repeated", F.round("share", 6).alias("share"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetitive(_measured(spark, sf_dir)).select("doc_id").distinct()


def p9_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over either limit: the repeated share, or the longest phrase said twice."""
    found = repetitive(_measured(spark, sf_dir), max_longest=LONGEST)
    return found.select("doc_id", F.round("share", 6).alias("share"), "longest_repeat", "repeats")


# fixed values: the Unicode white space characters in a class of the SQL engine's regular expressions
_WS = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

_P9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z]+(?:[-./][0-9a-z]+)*') AS words FROM documents),
g AS (
  SELECT doc_id, i, list_aggregate(words[i:i+5], 'string_agg', ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1))) AS i FROM w)),
b AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) AS rn FROM g) WHERE rn > 1),
c AS (SELECT DISTINCT doc_id, i + o AS place FROM b, range(0, 6) t(o)),
n AS (SELECT doc_id, count(*) AS n_repeated FROM c GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(words) AS INTEGER) AS n_words, CAST(coalesce(n_repeated, 0) AS INTEGER) AS n_repeated FROM w LEFT JOIN n USING (doc_id))
"""

ORACLES = {
    "p6_found": rf"""
WITH t AS (SELECT DISTINCT case_id, regexp_replace(regexp_replace(text, '^[{_WS}]+', ''), '[{_WS}]+$', '') AS t, char_limit, chunks FROM chunk_cases),
f AS (
  SELECT case_id, 'oversized' AS fault FROM t WHERE length(t) > char_limit
  UNION ALL SELECT case_id, 'unbreakable' FROM t WHERE len(list_filter(regexp_split_to_array(t, '[{_WS}]'), lambda x: length(x) > char_limit)) > 0
  UNION ALL SELECT case_id, 'chunk_over_limit' FROM t WHERE chunks IS NOT NULL AND len(list_filter(chunks, lambda x: length(x) > char_limit)) > 0
  UNION ALL SELECT case_id, 'chunks_differ' FROM t WHERE chunks IS NOT NULL AND coalesce(array_to_string(chunks, ''), '') <> t)
SELECT DISTINCT case_id, fault FROM f""",
    "p6_violations": "SELECT case_id, CAST(char_limit AS INTEGER) AS piece, '' AS rule FROM chunk_cases WHERE false",
    "p9_shares": _P9_SQL + "SELECT doc_id, n_words, n_repeated, round(CASE WHEN n_words > 0 THEN n_repeated / n_words ELSE 0 END, 6) AS share FROM s",
    "p9_found": _P9_SQL + "SELECT doc_id FROM s WHERE n_words >= 20 AND n_repeated >= 0.3 * n_words",
}

QUERIES = {
    "p2_found": p2_found,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p6_violations": p6_violations,
    "p7_pack": p7_pack,
    "p7_fill": p7_fill,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
    "p9_limited": p9_limited,
}
