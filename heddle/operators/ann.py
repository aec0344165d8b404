"""Cluster-pruned and two-stage vector search.

Centroids come from a bounded sample, every row is assigned; a query scans the
clusters nearest to it only. Scores stay exact, only recall is approximate.
"""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..functions.binding import let
from ..sources.tables import cut_lineage
from .vector_search import CORPUS_BLOCK, QUERY_BLOCK, exact_topk, packed, scored_blocks, top_k

MAX_CLUSTERS, MAX_ROUNDS, SAMPLE = 4096, 10, 50_000
#: Recall that a probe count must reach, and rows it is measured on.
RECALL, TRIALS = 0.9, 400


def cluster_count(rows: int) -> int:
    return max(1, min(rows, MAX_CLUSTERS, math.floor(math.sqrt(rows) + 0.5)))


def default_nprobe(clusters: int) -> int:
    return max(1, math.ceil(math.sqrt(clusters)))


def files_per_cluster(rows: int, clusters: int = 1, rows_per_file: int = 500_000) -> int:
    """Parts of a cluster's folder, so that a large cluster is not written by one task."""
    return max(1, math.ceil(rows / max(clusters, 1) / rows_per_file))


def use_clusters(rows: int, clusters: int, nprobe: int, filtered: bool, candidates: int | None = None) -> bool:
    """Whether pruning pays: not for filtered queries, nor when half of the rows would be scanned anyway."""
    pays = not filtered and rows >= 2 and clusters > 1 and nprobe < clusters
    return pays and (candidates is None or candidates * 2 < rows)


def fit_centroids(rows: np.ndarray, clusters: int, rounds: int = MAX_ROUNDS) -> np.ndarray:
    """Deterministic: the first row, then always the row least similar to all seeds so far; Lloyd rounds by dot product.

    Ties go to the lowest index; clusters that end empty are dropped.
    """
    if not len(rows):
        return rows
    seeds, nearest = [0], rows @ rows[0]
    while len(seeds) < min(clusters, len(rows)):
        seeds.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, rows @ rows[seeds[-1]])
    centers, own = rows[seeds].copy(), None
    for _ in range(rounds):
        now = np.argmax(rows @ centers.T, 1)
        if own is not None and (now == own).all():
            break
        own = now
        count = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, rows)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers[np.bincount(own, minlength=len(centers)) > 0]


def build_centroids(corpus: DataFrame, ident: str, vector: str = "vector", clusters: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """cluster_id, centroid; fitted on at most ``sample`` rows, the first by hash of the id."""
    n = corpus.count()
    share = int(min(1.0, sample / max(n, 1)) * (1 << 20))
    taken = corpus.filter(F.pmod(F.xxhash64(ident), F.lit(1 << 20)) <= share).select(ident, F.col(vector).cast("array<double>").alias("v")).orderBy(ident).limit(2 * sample).toPandas()["v"]
    rows = np.array([v for v in taken if v is not None and len(v)], np.float64)
    centers = fit_centroids(rows, clusters or cluster_count(n))
    return corpus.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cluster_id int, centroid array<double>")


def centroids_from_assignment(assigned: DataFrame, vector: str = "vector") -> DataFrame:
    """Means of the members per cluster, in doubles."""
    per_dim = (
        assigned.select("cluster_id", F.posexplode(V.doubles(F.col(vector))).alias("d", "x")).groupBy("cluster_id", "d").agg(F.avg("x").alias("x"))
    )
    return per_dim.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("centroid"))


def assign(corpus: DataFrame, centroids: DataFrame, ident: str, vector: str = "vector", digits: int = 9) -> DataFrame:
    """Adds ``cluster_id``, the centroid with the greatest dot product, ties to the lowest id.

    Centroids are at most ``MAX_CLUSTERS`` rows; they go to the tasks as one
    matrix, which is multiplied with each Arrow batch, without any shuffle. Rows
    whose vector is null or of another length fall to the lowest id.
    """
    every = [(r[0], r[1]) for r in centroids.select("cluster_id", "centroid").orderBy("cluster_id").limit(MAX_CLUSTERS + 1).collect()]
    if len(every) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    if not every:
        return corpus.withColumn("cluster_id", F.lit(None).cast("int"))
    ids, matrix = np.array([i for i, _ in every], np.int32), np.array([c for _, c in every], np.float64)
    at, columns = corpus.columns.index(vector), [c for c in corpus.columns if c != "cluster_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            fits = np.asarray(column.value_lengths().fill_null(0)) == matrix.shape[1]
            flat = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            own = np.full(batch.num_rows, ids[0], np.int32)
            if fits.any():
                own[fits] = ids[np.argmax(np.round(flat.reshape(-1, matrix.shape[1]) @ matrix.T, digits), 1)]
            kept = [batch.column(batch.schema.names.index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(own)], names=[*columns, "cluster_id"])

    schema = T.StructType([corpus.schema[c] for c in columns] + [T.StructField("cluster_id", T.IntegerType())])
    return corpus.mapInArrow(run, schema)


def probe(queries: DataFrame, centroids: DataFrame, sizes: DataFrame, nprobe: int, min_candidates: int, digits: int = 9) -> DataFrame:
    """query_id, cluster_id to scan: the ``nprobe`` nearest, and further ones while fewer than ``min_candidates`` rows."""
    pairs = queries.crossJoin(F.broadcast(centroids.join(sizes, "cluster_id"))).select(
        "query_id", "cluster_id", "n", F.round(V.dot(F.col("vector"), F.col("centroid")), digits).alias("s")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "cluster_id")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        pairs.withColumn("place", F.row_number().over(order)).withColumn("have", before)
        .filter((F.col("place") <= nprobe) | (F.col("have") < min_candidates)).select("query_id", "cluster_id")
    )


def probes_for_recall(assigned: DataFrame, centroids: DataFrame, k: int, ident: str = "document_id", vector: str = "vector", recall: float = RECALL, trials: int = TRIALS, digits: int = 9) -> int:
    """The fewest probes whose recall@k, less two standard errors, is at least ``recall``; all clusters if none are enough.

    About ``trials`` rows, the first by hash of the id, are searched exactly in
    all of ``assigned``, themselves left out; a neighbour counts as found from
    the place of its cluster in the order of its query on.
    """
    clusters, n = centroids.count(), assigned.count()
    share = int(min(1.0, trials / max(n, 1)) * (1 << 20))
    asked = assigned.filter(F.pmod(F.xxhash64(ident), F.lit(1 << 20)) <= share).select(F.col(ident).alias("query_id"), F.col(vector).alias("vector"))
    near = exact_topk(asked, assigned.select(ident, vector), k + 1, ident, vector).filter(F.col(ident) != F.col("query_id"))
    near = top_k(near.drop("rank"), k, ident).join(assigned.select(ident, "cluster_id"), ident).select("query_id", "cluster_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "cluster_id")
    places = asked.crossJoin(F.broadcast(centroids)).select("query_id", "cluster_id", F.round(V.dot(F.col("vector"), F.col("centroid")), digits).alias("s"))
    places = places.withColumn("place", F.row_number().over(order))
    found = near.join(places, ["query_id", "cluster_id"]).groupBy("query_id").agg(F.sort_array(F.collect_list("place")).alias("p")).collect()
    if len(found) < 2:
        return clusters
    for nprobe in range(1, clusters):
        each = np.array([np.mean(np.array(r["p"]) <= nprobe) for r in found])
        if each.mean() - 2 * each.std(ddof=1) / math.sqrt(len(each)) >= recall:
            return nprobe
    return clusters


def ann_topk(queries: DataFrame, assigned: DataFrame, centroids: DataFrame, k: int, nprobe: int | None = None, ident: str = "document_id", vector: str = "vector", digits: int = 6) -> DataFrame:
    """Exact scores over the probed clusters; ``assigned`` carries ``cluster_id`` (partition the table by it to prune files).

    Without ``nprobe`` the count comes from ``probes_for_recall``. Rows and
    queries are packed per cluster into blocks of bounded size, so a large
    cluster is many blocks and its vectors are not copied for every query; each
    pair of blocks returns its best k per query. Which clusters are asked for at
    all is known before the scan (at most ``MAX_CLUSTERS`` numbers).
    """
    sizes = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    wanted = cut_lineage(probe(queries, centroids, sizes, nprobe or probes_for_recall(assigned, centroids, k, ident, vector), k), "probes")
    clusters = [r[0] for r in wanted.select("cluster_id").distinct().limit(MAX_CLUSTERS).collect()]
    asked = wanted.join(queries, "query_id").select("query_id", "vector", "cluster_id")
    rows = assigned.filter(F.col("cluster_id").isin(clusters)).select(ident, F.col(vector).alias("vector"), "cluster_id")
    pairs = scored_blocks(packed(asked, "query_id", "vector", QUERY_BLOCK, group="cluster_id"), packed(rows, ident, "vector", CORPUS_BLOCK, group="cluster_id"), k, ident, digits=digits, grouped=True)
    return top_k(pairs, k, ident).select("query_id", "rank", "score", ident)


def rescore(coarse: DataFrame, originals: DataFrame, queries: DataFrame, k: int, ident: str = "document_id", digits: int = 6) -> DataFrame:
    """Exact scores for coarse candidates (query_id, id, score) where the original vector exists and is finite, else the coarse score."""
    exact = originals.select(F.col(ident), F.when(V.valid_vector(F.col("vector")), F.col("vector")).alias("__o"))
    asked = queries.select("query_id", F.col("vector").alias("__q"))
    scored = coarse.join(exact, ident, "left").join(asked, "query_id").select("query_id", ident, F.coalesce(V.dot(F.col("__q"), F.col("__o")), F.col("score")).alias("score"))
    return top_k(scored, k, ident, digits=digits).select("query_id", "rank", "score", ident)


def two_stage_topk(queries: DataFrame, corpus: DataFrame, k: int, oversample: float = 4.0, ident: str = "document_id", digits: int = 6) -> DataFrame:
    """Stage 1 ranks by int8 codes and keeps ceil(oversample x k), stage 2 scores those exactly."""
    if not math.isfinite(oversample) or oversample < 1:
        raise ValueError("oversample is a finite number of at least 1")
    coded = corpus.select(ident, let(V.int8_scale(F.col("vector")), lambda m: V.int8_decode(V.int8_encode(F.col("vector")), m)).alias("vector"))
    coarse = exact_topk(queries, coded, math.ceil(oversample * k), ident, digits=9).drop("rank")
    return rescore(coarse, corpus.select(ident, "vector"), queries, k, ident, digits)
