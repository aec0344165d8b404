"""The k most similar vectors of every vector, by sharded small-world graphs.

Equal directions are one class, so copies cost nothing and are answered
exactly. Classes are dealt to cells by their nearest centroid (fitted on
bounded samples, in two levels where there are many cells); a cell above
``shard_size`` is split by hash. One graph is built per shard. Every class
searches its own shard while the graph is built, then the shards of its next
nearest cells, which only hand back what can still be among its nearest; a
shard's answers are merged by cosine in double precision. How many cells are
searched is measured on some classes that are compared with all others.

What travels between tasks is packed: vectors as 8-bit codes where that is
exact (quantised collections), else as 32-bit floats, ids of graph points as
numbers, and one row per pair of shards rather than per vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut_lineage
from . import hnsw

#: Points per graph, searches per task, bound of a centroid sample.
SHARD_SIZE, BLOCK_SIZE, SAMPLE = 16_000, 40_000, 20_000
#: Share of the nearest that must lie in the cells searched, classes per collection on which it is measured, and most cells tried.
RECALL, TRIALS, MAX_PROBES = 0.98, 400, 256
#: Cells of one level; beyond it centroids form two levels of about the square root each.
FLAT_CELLS = 256
#: Centroids are broadcast; this many of 64 floats are 64 MB. With more than MAX_CELLS x SHARD_SIZE / 2 vectors, about two
#: billion, cells grow and are split by hash, every part of which is searched.
MAX_CELLS = 1 << 18
#: Sampled rows per centroid of the second level, and decimals by which directions count as equal.
PER_CENTROID, DECIMALS = 64, 5
PACKED_QUERIES = 8192

SOUND = "collection string, item string, cls binary, vec binary"


def _direction(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _blob(rows: np.ndarray) -> bytes:
    """Vectors as bytes: one per component where twice the component is a small whole number, else four."""
    twice = rows * 2
    if (np.abs(twice) <= 127).all() and (twice == np.rint(twice)).all():
        return b"\x01" + twice.astype(np.int8).tobytes()
    return b"\x04" + rows.astype(np.float32).tobytes()


def _rows(blob: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(blob, np.int8, offset=1) / np.float32(2) if blob[0] == 1 else np.frombuffer(blob, np.float32, offset=1)
    return flat.reshape(n, -1)


def _matrix(blobs: list[bytes]) -> np.ndarray:
    """The vectors of packed rows, one vector each."""
    return np.concatenate([_rows(b, 1) for b in blobs]) if len({b[:1] for b in blobs}) > 1 else _rows(blobs[0][:1] + b"".join(b[1:] for b in blobs), len(blobs))


def _sound(collections: list, items: list, rows: np.ndarray) -> pa.RecordBatch:
    """The rows that are finite and not all zero, with a key of their direction (``DECIMALS``)."""
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(rows.astype(np.float64), axis=1)
    keep = np.flatnonzero(np.isfinite(norm) & (norm > 0))
    rows = np.ascontiguousarray(rows[keep], np.float32)
    keys = np.round(_direction(rows) * 10**DECIMALS).astype(np.int64) if len(rows) else rows
    return pa.RecordBatch.from_arrays(
        [
            pa.array([collections[i] for i in keep], pa.string()),
            pa.array([items[i] for i in keep], pa.string()),
            pa.array([blake2b(k.tobytes(), digest_size=16).digest() for k in keys], pa.binary()),
            pa.array([r.tobytes() for r in rows], pa.binary()),
        ],
        names=["collection", "item", "cls", "vec"],
    )


def sound_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    """``vectors`` (collection, item, vector array<float>) without unsound rows.

    Null items, null vectors, null or non-finite numbers, other lengths than
    ``dim`` and all-zero vectors are left out: they take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            yield _sound(batch.column(0).to_pylist(), batch.column(1).to_pylist(), flat.reshape(-1, dim))

    kept = vectors.filter(F.col("item").isNotNull() & (F.size("vector") == dim))
    return kept.select("collection", "item", F.col("vector").cast("array<float>").alias("vector")).mapInArrow(run, SOUND)


def live_codes(segments: DataFrame) -> DataFrame:
    """The codes that stand once all delta segments are applied: id, bit_width, dim, code, scale.

    Segments apply by seq, each seq once (of differing sound deliveries of one
    seq the greater content counts), removals before upserts, a later upsert of
    an id in the list before an earlier one. A segment whose codes do not have
    exactly ids x dim x bit_width / 8 bytes has no effect at all. Null lists are
    empty, rows with a null seq, bit_width or dim are damaged.
    """
    ids = F.coalesce("upsert_stable_ids", F.array().cast("array<bigint>"))
    codes = F.coalesce("upsert_codes", F.lit(b""))
    width = F.expr("cast(dim as bigint) * bit_width div 8")
    s = (
        segments.filter(F.col("seq").isNotNull() & F.col("bit_width").isin(2, 4) & (F.col("dim") > 0) & (F.col("dim") * F.col("bit_width") % 8 == 0))
        .filter(F.length(codes) == F.size(ids) * width)
        .groupBy("seq")
        .agg(
            F.max(
                F.struct(
                    "bit_width", "dim", ids.alias("ids"), codes.alias("codes"), F.coalesce("upsert_scales", F.array().cast("array<float>")).alias("scales"),
                    F.coalesce("removed_stable_ids", F.array().cast("array<bigint>")).alias("removed"),
                )
            ).alias("s")
        )
        .select("seq", "s.*", F.expr("cast(s.dim * s.bit_width div 8 as int)").alias("w"))
    )
    removed = s.select("seq", F.explode("removed").alias("id")).select("id", "seq", F.lit(-1).alias("place"), *[F.lit(None).cast(t).alias(n) for n, t in (("bit_width", "int"), ("dim", "int"), ("code", "binary"), ("scale", "float"))])
    upserts = s.select("seq", "bit_width", "dim", "w", "codes", "scales", F.posexplode("ids").alias("place", "id")).select(
        "id", "seq", "place", "bit_width", "dim", F.expr("substring(codes, place * w + 1, w)").alias("code"), F.get("scales", F.col("place")).alias("scale")
    )
    return (
        upserts.unionByName(removed)
        .filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max_by(F.struct("bit_width", "dim", "code", "scale"), F.struct("seq", "place")).alias("c"))
        .select("id", "c.*")
        .filter(F.col("code").isNotNull())
    )


def decoded_vectors(codes: DataFrame, collection: str, dim: int) -> DataFrame:
    """Vectors of ``live_codes`` as sound vectors; items are the ids in decimal."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for bits, rows in part.groupby("bit_width"):
                per = 8 // bits
                raw = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
                shifts = np.arange(per, dtype=np.uint8) * bits
                values = ((raw[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(len(rows), -1)
                mid = (2**bits - 1) / 2
                # only the direction counts: the scale's sign keeps it exact, a scale of 0 or NaN makes the row unsound
                scale = rows["scale"].to_numpy(np.float64)
                sign = np.where(np.isfinite(scale), np.sign(scale), np.nan)
                vectors = ((values - mid) * sign[:, None]).astype(np.float32)
                yield _sound([collection] * len(rows), rows["id"].astype("int64").astype(str).tolist(), vectors).to_pandas()

    return codes.filter((F.col("dim") == dim) & F.col("scale").isNotNull()).mapInPandas(run, SOUND)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sound rows with their vectors as ``_blob``."""
    for batch in batches:
        blobs = [_blob(np.frombuffer(b, np.float32)) for b in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blobs, pa.binary())], names=["collection", "item", "cls", "vec"])


# --- cells


def _centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample."""
    centers = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(rounds):
        own = np.argmax(sample @ centers.T, 1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1)
        centers = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-12)[:, None], centers)
    return centers.astype(np.float32)


@dataclass
class Cells:
    """The centroids of a collection: ``leaves`` in the order of the cell numbers, and above them ``top`` if there are two levels."""

    leaves: np.ndarray | None
    top: np.ndarray | None
    begin: np.ndarray
    subs: np.ndarray
    asked: np.ndarray  # searches that come to each cell per cell searched beside the own one, as estimated

    @property
    def count(self) -> int:
        return len(self.subs)

    def near(self, units: np.ndarray, probes: int) -> np.ndarray:
        """The cells nearest to each unit row, nearest first; -1 where there are fewer."""
        if self.leaves is None:
            return np.zeros((len(units), 1), np.int32)
        if self.top is None:
            return hnsw._top(units @ self.leaves.T, probes).astype(np.int32)
        tops = hnsw._top(units @ self.top.T, probes)
        row, cell, sim = [], [], []
        for t in np.unique(tops):
            asks = np.flatnonzero((tops == t).any(1))
            lo, hi = self.begin[t], self.begin[t + 1]
            best = hnsw._top(units[asks] @ self.leaves[lo:hi].T, probes)
            row.append(np.repeat(asks, best.shape[1]))
            cell.append((best + lo).ravel())
            sim.append(np.take_along_axis(units[asks] @ self.leaves[lo:hi].T, best, 1).ravel())
        row, cell, sim = np.concatenate(row), np.concatenate(cell), np.concatenate(sim)
        order = np.lexsort((cell, -sim, row))
        row, cell = row[order], cell[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        out = np.full((len(units), probes), -1, np.int32)
        out[row[place < probes], place[place < probes]] = cell[place < probes]
        return out


def _sample(rows: DataFrame, collections: dict[str, int], wanted: dict[str, int]) -> DataFrame:
    """About ``wanted`` distinct directions of each collection, chosen by the hash of their class."""
    share = {c: int(min(1.0, wanted[c] / max(n, 1)) * (1 << 30)) for c, n in collections.items()}
    chosen = F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) <= F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("collection"))
    return rows.filter(F.col("collection").isin(list(share)) & chosen).groupBy("collection", "cls").agg(F.min("vec").alias("vec"))


def _fit_cells(rows: DataFrame, shard_size: int, flat_cells: int) -> dict[str, Cells]:
    """Cells of every collection; a collection that fits one graph needs no sample.

    At most ``SAMPLE`` rows of a collection come to the driver. Where there are
    two levels, the second is fitted by one task per centroid of the first, and
    the driver receives the centroids.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy("collection").agg(F.approx_count_distinct("cls", 0.02)).collect()}
    wanted = {c: min(MAX_CELLS, max(1, math.ceil(n / (shard_size / 2)))) for c, n in sizes.items()}
    one = lambda n: Cells(None, None, np.array([0, 1]), np.array([max(1, math.ceil(n / shard_size))]), np.array([n]))
    made = {c: one(n) for c, n in sizes.items() if wanted[c] == 1}
    large = {c: n for c, n in sizes.items() if wanted[c] > 1}
    if not large:
        return made
    taken = _sample(rows, large, dict.fromkeys(large, SAMPLE)).orderBy("collection", "cls").toPandas()
    tops, units = {}, {}
    for collection, part in taken.groupby("collection"):
        units[collection] = _direction(_matrix(part["vec"].tolist())).astype(np.float32)
        cells = wanted[collection]
        tops[collection] = _centroids(units[collection], min(len(part), cells if cells <= flat_cells else math.ceil(math.sqrt(cells))))
    deep = {c: n for c, n in large.items() if wanted[c] > flat_cells}
    leaves: dict[str, list] = {c: [None] * len(tops[c]) for c in deep}
    share: dict[str, list] = {c: [None] * len(tops[c]) for c in deep}
    if deep:
        level = _sample(rows, deep, {c: PER_CENTROID * wanted[c] for c in deep}).mapInPandas(_by_top({c: tops[c] for c in deep}), "collection string, top int, vec binary")
        for r in level.groupBy("collection", "top").applyInPandas(_second_level(), "collection string, top int, centroids binary, counts array<int>").collect():
            leaves[r["collection"]][r["top"]] = np.frombuffer(r["centroids"], np.float32).reshape(len(r["counts"]), -1)
            share[r["collection"]][r["top"]] = np.array(r["counts"], float)
    for c, n in large.items():
        if c in deep:
            parts = [x if x is not None else tops[c][i : i + 1] for i, x in enumerate(leaves[c])]
            counts = np.concatenate([x if x is not None else np.zeros(1) for x in share[c]])
            begin = np.cumsum([0] + [len(x) for x in parts])
            model = Cells(np.concatenate(parts), tops[c], begin, counts, counts)
            held = counts / counts.sum() * n
            asked = 2 * held
        else:
            model = Cells(tops[c], None, np.array([0]), np.zeros(len(tops[c])), np.zeros(len(tops[c])))
            near = model.near(units[c], min(8, len(tops[c])))
            times = n / len(near)
            held, later = (np.bincount(x[x >= 0], minlength=len(tops[c])) * times for x in (near[:, 0], near[:, 1:].ravel()))
            asked = np.maximum(later / max(1, near.shape[1] - 1), held)
        model.subs, model.asked = np.maximum(1, np.ceil(held / shard_size)).astype(int), asked
        made[c] = model
    return made


def _by_top(tops: dict[str, np.ndarray]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for collection, rows in part.groupby("collection"):
                own = np.argmax(_direction(_matrix(rows["vec"].tolist())).astype(np.float32) @ tops[collection].T, 1)
                yield pd.DataFrame({"collection": collection, "top": own.astype(np.int32), "vec": rows["vec"].to_numpy()})

    return run


def _second_level():
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec", kind="stable")
        units = _direction(_matrix(part["vec"].tolist())).astype(np.float32)
        centers = _centroids(units, max(1, round(len(units) / PER_CENTROID)))
        counts = np.bincount(np.argmax(units @ centers.T, 1), minlength=len(centers))
        return pd.DataFrame({"collection": [part["collection"].iloc[0]], "top": [part["top"].iloc[0]], "centroids": [centers.tobytes()], "counts": [counts.tolist()]})

    return run


def _dealt(cells: dict[str, Cells]):
    """Adds the own cell of each class and its part of that cell."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for collection, rows in part.groupby("collection"):
                own = cells[collection].near(_direction(_matrix(rows["vec"].tolist())).astype(np.float32), 1)[:, 0]
                number = np.array([int.from_bytes(c[:4], "little") for c in rows["cls"]], np.int64)
                yield rows.assign(cell=own.astype(np.int32), sub=(number % cells[collection].subs[own]).astype(np.int32))

    return run


# --- graphs and searches

PLACE = ["collection", "cell", "sub"]
GRAPH = (
    "collection string, cell int, sub int, classes binary, items array<string>, counts binary, vecs binary, layers array<binary>, widths array<int>, own_at binary, own_cos binary"
)
ASKED = "collection string, cell int, sub int, block int, from_cell int, from_sub int, at binary, vecs binary, least binary"
HITS = "collection string, cell int, sub int, at binary, which binary, cos binary, items array<string>, counts binary"
ANSWER = "collection string, cls binary, others array<string>, cos array<double>"


def _found(points: np.ndarray, layers: list[np.ndarray], asked: np.ndarray, k: int, exact: bool, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines in double precision, 6 decimals) of the k nearest points per query, -1 and -2 pad."""
    low, q = points.astype(np.float32), asked.astype(np.float32)
    ids = np.concatenate([hnsw._top(q[i : i + 512] @ low.T, k) for i in range(0, len(q), 512)]) if exact else hnsw.search(low, layers, q, k, own=own)
    cos = np.full(ids.shape, -2.0)
    for i in range(0, len(ids), 8192):
        part = ids[i : i + 8192]
        cos[i : i + 8192] = np.where(part >= 0, np.round(np.einsum("ij,ikj->ik", asked[i : i + 8192], points[np.maximum(part, 0)]), 6), -2.0)
    return ids, cos


def _build(k: int, exact: bool):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cls", kind="stable")  # the keys are hashes: as good as random, and the same on every run
        vecs = _matrix(part["vec"].tolist())
        points = _direction(vecs)
        layers = [] if exact else hnsw.build(points.astype(np.float32))
        me = np.arange(len(points))
        ids, cos = _found(points, layers, points, k + 2, exact, me)
        cos[ids == me[:, None]] = -2.0
        order = np.argsort(-cos, axis=1, kind="stable")[:, : k + 1]
        ids, cos = np.take_along_axis(ids, order, 1), np.take_along_axis(cos, order, 1)
        first = part.iloc[0]
        return pd.DataFrame(
            {
                "collection": [first["collection"]], "cell": [first["cell"]], "sub": [first["sub"]],
                "classes": [b"".join(part["cls"])], "items": [[i for items in part["items"] for i in items]], "counts": [np.array([len(i) for i in part["items"]], np.int32).tobytes()],
                "vecs": [_blob(vecs)], "layers": [[x.tobytes() for x in layers]], "widths": [[x.shape[1] for x in layers]],
                "own_at": [np.where(cos > -2, ids, -1).astype(np.int32).tobytes()], "own_cos": [cos.tobytes()],
            }
        )

    return run


def _blocks(cells: dict[str, Cells], probes: dict[str, int], block_size: int) -> dict[str, np.ndarray]:
    """Tasks among which the searches in each cell are dealt."""
    return {c: np.maximum(1, np.ceil((probes[c] - 1) * m.asked / block_size)).astype(int) for c, m in cells.items()}


def _trial_hits(asked: dict[str, tuple[list, np.ndarray]], k: int, min_cos: float):
    """For each asked class its nearest points in each graph, with the cell: the exact search of a few against all."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for g in part.itertuples():
                if g.collection not in asked:
                    continue
                names, queries = asked[g.collection]
                n = len(g.counts) // 4
                sims = queries @ _direction(_rows(g.vecs, n)).astype(np.float32).T
                own = {g.classes[i * 16 : i * 16 + 16]: i for i in range(n)}
                for q, name in enumerate(names):
                    if name in own:
                        sims[q, own[name]] = -2.0
                best = hnsw._top(sims, min(k, n))
                cos = np.take_along_axis(sims, best, 1)
                q, place = np.nonzero(cos >= max(min_cos, -1.5))
                yield pd.DataFrame({"collection": g.collection, "q": q.astype(np.int32), "cos": cos[q, place].astype(float), "cell": np.int32(g.cell)})

    return run


def measured_probes(rows: DataFrame, graphs: DataFrame, cells: dict[str, Cells], k: int, min_cos: float = -2.0, recall: float = RECALL, trials: int = TRIALS) -> dict[str, int]:
    """The fewest cells per collection in which ``recall`` of the nearest (with at least ``min_cos``) are found, less two standard errors.

    About ``trials`` classes of each collection, chosen by hash, are compared
    with all others. A collection in which they have no such neighbours gets as
    many cells as needed for their nearest of any cosine.
    """
    many = {c: m for c, m in cells.items() if m.count > 1}
    probes = {c: 1 for c in cells}
    if not many:
        return probes
    sizes = {c: max(1, round(m.asked.sum())) for c, m in many.items()}
    taken = _sample(rows, sizes, dict.fromkeys(many, trials)).toPandas()
    asked = {c: ([bytes(x) for x in p["cls"]], _direction(_matrix(p["vec"].tolist())).astype(np.float32)) for c, p in taken.groupby("collection")}
    best = Window.partitionBy("collection", "q").orderBy(F.desc("cos"), "cell")

    def found(least: float) -> pd.DataFrame:
        near = graphs.select("collection", "cell", "counts", "classes", "vecs").mapInPandas(_trial_hits(asked, k, least), "collection string, q int, cos double, cell int")
        return near.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k).select("collection", "q", "cell").toPandas()

    hits = found(min_cos)
    few = [c for c in asked if (hits["collection"] == c).sum() < 50]
    if few and min_cos > -1:
        other = found(-2.0)
        hits = pd.concat([hits[~hits["collection"].isin(few)], other[other["collection"].isin(few)]])
    for c, own in hits.groupby("collection"):
        near = many[c].near(asked[c][1], min(MAX_PROBES, many[c].count))
        place = np.array([np.flatnonzero(near[q] == cell)[0] if (near[q] == cell).any() else near.shape[1] for q, cell in zip(own["q"], own["cell"])])
        query = own["q"].to_numpy()
        probes[c] = near.shape[1]
        for p in range(1, near.shape[1]):
            each = np.array([np.mean(place[query == q] < p) for q in np.unique(query)])
            if each.mean() - 2 * each.std(ddof=1) / math.sqrt(len(each)) >= recall if len(each) > 1 else each.all():
                probes[c] = p
                break
    return probes


def _ask(cells: dict[str, Cells], k: int, probes: dict[str, int], blocks: dict[str, np.ndarray], min_cos: float):
    """The searches that the points of a graph start in other shards, packed by shard.

    With each goes the least cosine that can still matter: that of its k-th best hit so far.
    """
    names = [c.split(" ")[0] for c in ASKED.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for g in part.itertuples():
                model = cells[g.collection]
                n = len(g.counts) // 4
                vecs = _rows(g.vecs, n)
                near = model.near(_direction(vecs).astype(np.float32), probes[g.collection])
                best = np.frombuffer(g.own_cos).reshape(n, -1)
                least = np.maximum(best[:, k - 1] if best.shape[1] >= k else np.full(n, -2.0), min_cos)
                out = []
                for cell in np.unique(near[near >= 0]).tolist():
                    at = np.flatnonzero((near == cell).any(1))
                    for sub in range(int(model.subs[cell])):
                        if (cell, sub) == (g.cell, g.sub):
                            continue
                        for i in range(0, len(at), PACKED_QUERIES):
                            some = at[i : i + PACKED_QUERIES]
                            block = (g.cell * 31 + g.sub + i // PACKED_QUERIES) % int(blocks[g.collection][cell])
                            out.append((g.collection, cell, sub, block, g.cell, g.sub, some.astype(np.int32).tobytes(), _blob(vecs[some]), least[some].tobytes()))
                if out:
                    yield pd.DataFrame(out, columns=names)

    return run


def _begins(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for each begin as many as its size."""
    return np.repeat(begin - _begins(size), size) + np.arange(size.sum())


def _search(k: int, exact: bool):
    names = [c.split(" ")[0] for c in HITS.split(", ")]

    def run(graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(graphs) or not len(queries):
            return pd.DataFrame([], columns=names)
        g = graphs.iloc[0]
        counts, flat = np.frombuffer(g["counts"], np.int32), np.asarray(g["items"], object)
        begin = _begins(counts)
        points = _direction(_rows(g["vecs"], len(counts)))
        layers = [np.frombuffer(x, np.int32).reshape(-1, w) for x, w in zip(g["layers"], g["widths"])]
        out = []
        for q in queries.itertuples():
            at = np.frombuffer(q.at, np.int32)
            ids, cos = _found(points, layers, _direction(_rows(q.vecs, len(at))), k + 1, exact)
            row, col = np.nonzero((ids >= 0) & (cos >= np.frombuffer(q.least)[:, None]))
            hit, which = np.unique(ids[row, col], return_inverse=True)
            items = flat[_ranges(begin[hit], counts[hit])]
            out.append((q.collection, q.from_cell, q.from_sub, at[row].tobytes(), which.astype(np.int32).tobytes(), cos[row, col].tobytes(), items.tolist(), counts[hit].tobytes()))
        return pd.DataFrame(out, columns=names)

    return run


def _merge(k: int, min_cos: float):
    """The k + 1 best items of every class of a graph: its own members, hits of its own graph, hits of others."""

    def run(graphs: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        g = graphs.iloc[0]
        counts, flat = np.frombuffer(g["counts"], np.int32), np.asarray(g["items"], object)
        n, begin = len(counts), _begins(np.frombuffer(g["counts"], np.int32))
        near, near_cos = np.frombuffer(g["own_at"], np.int32).reshape(n, -1), np.frombuffer(g["own_cos"]).reshape(n, -1)
        row, col = np.nonzero((near >= 0) & (near_cos >= min_cos))
        lists = [(np.arange(n), np.arange(n), np.ones(n), begin, counts, flat), (row, near[row, col], near_cos[row, col], begin, counts, flat)]
        for h in hits.itertuples():
            sizes = np.frombuffer(h.counts, np.int32)
            lists.append((np.frombuffer(h.at, np.int32), np.frombuffer(h.which, np.int32), np.frombuffer(h.cos), _begins(sizes), sizes, np.asarray(h.items, object)))
        who = np.concatenate([np.repeat(q, size[w]) for q, w, _, _, size, _ in lists])
        cos = np.concatenate([np.repeat(c, size[w]) for _, w, c, _, size, _ in lists])
        item = np.concatenate([names[_ranges(b[w], size[w])] if len(w) else np.empty(0, object) for _, w, _, b, size, names in lists])
        known, code = np.unique(item, return_inverse=True)
        order = np.lexsort((-cos, code, who))
        who, cos, code = who[order], cos[order], code[order]
        fresh = np.r_[True, (who[1:] != who[:-1]) | (code[1:] != code[:-1])]
        who, cos, code = who[fresh], cos[fresh], code[fresh]
        order = np.lexsort((code, -cos, who))
        who, cos, code = who[order], cos[order], code[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) <= k
        who, cos, code = who[keep], cos[keep], code[keep]
        cuts = np.searchsorted(who, np.arange(1, n))
        classes = [g["classes"][i * 16 : i * 16 + 16] for i in range(n)]
        return pd.DataFrame({"collection": g["collection"], "cls": classes, "others": np.split(known[code], cuts), "cos": np.split(cos, cuts)})

    return run


def nearest(
    sound: DataFrame, k: int = 5, shard_size: int = SHARD_SIZE, probes: int | None = None, block_size: int = BLOCK_SIZE, min_cos: float = -2.0, exact: bool = False, flat_cells: int = FLAT_CELLS
) -> DataFrame:
    """The ``k`` most similar others of every item of its collection: collection, item, other, cos.

    Cosines are rounded to 6 decimals, equal ones rank by the smaller item; only
    those of at least ``min_cos`` are returned. Directions that agree to 5
    decimals are one class, whose members have cosine 1 to one another. Exact
    duplicate rows count once; an item with several different vectors takes part
    with each of them but is never its own neighbour. A collection with a single
    item has no rows. Collections may differ in their dimension. Recall is
    measured in the tests and README; with ``exact`` every class is compared
    with all classes of its collection instead, which is quadratic work.
    """
    rows = cut_lineage(sound.mapInArrow(_packed, SOUND), "vectors")
    cells = _fit_cells(rows, shard_size, flat_cells)
    members = rows.select("collection", "item", "cls").distinct()
    smallest = Window.partitionBy("collection", "cls").orderBy("item")
    named = (
        members.withColumn("rn", F.row_number().over(smallest)).filter(F.col("rn") <= k + 1)
        .groupBy("collection", "cls").agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    classes = rows.groupBy("collection", "cls").agg(F.min("vec").alias("vec")).join(named, ["collection", "cls"])
    shards = sum(int(c.subs.sum()) for c in cells.values())
    width = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * shards)  # so that a task seldom gets two graphs
    graphs = cut_lineage(
        classes.mapInPandas(_dealt(cells), "collection string, cls binary, vec binary, items array<string>, cell int, sub int").repartition(width, *PLACE).groupBy(*PLACE).applyInPandas(_build(k, exact), GRAPH),
        "graphs",
    )
    if exact:
        chosen = {c: m.count for c, m in cells.items()}
    else:
        chosen = {c: min(probes, m.count) for c, m in cells.items()} if probes else measured_probes(rows, graphs, cells, k, min_cos)
    blocks = _blocks(cells, chosen, block_size)
    asked = graphs.select("collection", "cell", "sub", "counts", "vecs", "own_cos").mapInPandas(_ask(cells, k, chosen, blocks, min_cos), ASKED)
    where = [*PLACE, "block"]
    several = [(c, i, int(n)) for c, of in blocks.items() for i, n in enumerate(of) if n > 1]  # at most MAX_CELLS rows a collection
    dealt = F.broadcast(rows.sparkSession.createDataFrame(several, "collection string, cell int, blocks int"))
    targets = graphs.select("collection", "cell", "sub", "classes", "items", "counts", "vecs", "layers", "widths").join(dealt, ["collection", "cell"], "left")
    targets = targets.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    width = max(width, 3 * sum(int((m.subs * blocks[c]).sum()) for c, m in cells.items()))
    hits = targets.repartition(width, *where).groupBy(*where).cogroup(asked.repartition(width, *where).groupBy(*where)).applyInPandas(_search(k, exact), HITS)
    sources = graphs.select("collection", "cell", "sub", "classes", "items", "counts", "own_at", "own_cos")
    answers = sources.groupBy(*PLACE).cogroup(hits.groupBy(*PLACE)).applyInPandas(_merge(k, min_cos), ANSWER)
    top = F.arrays_zip("others", "cos")
    return (
        members.join(answers, ["collection", "cls"])
        .select("collection", "item", F.inline(F.slice(F.filter(top, lambda t: t["others"] != F.col("item")), 1, k)))
        .withColumnRenamed("others", "other")
        .filter(F.col("cos") >= min_cos)
    )
