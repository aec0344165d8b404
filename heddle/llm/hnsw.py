"""A navigable small-world graph in flat arrays, built and searched in lockstep.

Layer 0 holds all points, layer l the first 1/``SCALE``^l of them (points come
in an order that is as good as random), down to a topmost layer of at most
``TOP`` points, whatever the size of the graph. A search enters at the best of
these few and descends layer by layer, taking the best points found in one
layer as entry points of the next; a search for a point of the graph itself may
enter layer 0 at that point. Every layer is one int32 array with a row of
neighbours per point, -1 where there are fewer. Insertions and searches handle
a block of points at a time: each step expands the best few unexpanded
candidates of every search at once, so numpy does the work and not the
interpreter.
"""

from __future__ import annotations

import numpy as np

SCALE, TOP, STARTS = 8, 64, 8
DEGREE, DEGREE_UPPER = 28, 16
BEAM_BUILD, BEAM_SEARCH, EXPAND = 40, 48, 8
BLOCK = 256


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    if sims.shape[1] <= k:
        return np.argsort(-sims, axis=1, kind="stable")
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    inner = np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, inner, 1)


def search_layer(points: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities), best first, of up to ``beam`` points near each query; -1 and -inf pad.

    ``starts`` holds entry points per query (-1: none). Points outside ``links`` are not reached.
    """
    b, n = len(queries), len(links)
    seen = np.zeros((b, n + 1), bool)  # the last column stands for "no point"
    seen[:, n] = True
    row = np.arange(b)[:, None]
    ids = np.full((b, beam), -1, np.int64)
    sims = np.full((b, beam), -np.inf, np.float32)
    done = np.ones((b, beam), bool)

    def offer(active: np.ndarray, new: np.ndarray) -> None:
        at = row[active]
        new = np.where(new < 0, n, new)
        new = np.sort(new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = n
        new = np.where(seen[at, new], n, new)
        seen[at, new] = True
        got = np.matmul(points[np.minimum(new, len(points) - 1)], queries[active][:, :, None])[:, :, 0]
        got[new == n] = -np.inf
        all_ids = np.concatenate([ids[active], np.where(new == n, -1, new)], 1)
        all_sims = np.concatenate([sims[active], got], 1)
        all_done = np.concatenate([done[active], new == n], 1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam] if all_sims.shape[1] > beam else np.tile(np.arange(all_sims.shape[1]), (len(all_sims), 1))
        w = best.shape[1]
        ids[active, :w] = np.take_along_axis(all_ids, best, 1)
        sims[active, :w] = np.take_along_axis(all_sims, best, 1)
        done[active, :w] = np.take_along_axis(all_done, best, 1)

    active = np.arange(b)
    offer(active, starts)
    while True:
        open_sims = np.where(done[active], -np.inf, sims[active])
        going = open_sims.max(1) > -np.inf
        active, open_sims = active[going], open_sims[going]
        if not len(active):
            break
        pick = np.argpartition(-open_sims, min(EXPAND, beam) - 1, axis=1)[:, :EXPAND]
        chosen = np.where(np.take_along_axis(open_sims, pick, 1) > -np.inf, np.take_along_axis(ids[active], pick, 1), -1)
        done[active[:, None], pick] = True
        around = np.where(chosen[:, :, None] >= 0, links[chosen], -1).reshape(len(active), -1)
        offer(active, around)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _diverse(points: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates (best first) those nearer to the row's point than to any kept one, then the best others."""
    b, c = ids.shape
    cand = points[np.maximum(ids, 0)]
    mutual = np.matmul(cand, cand.transpose(0, 2, 1))
    kept = np.zeros((b, c), bool)
    closest = np.full((b, c), -np.inf, np.float32)
    count = np.zeros(b, np.int64)
    for j in range(c):
        take = (ids[:, j] >= 0) & (sims[:, j] > closest[:, j]) & (count < degree)
        kept[:, j] = take
        count += take
        closest = np.where(take[:, None], np.maximum(closest, mutual[:, j]), closest)
    # kept ones first, the rest by similarity
    order = np.argsort(np.where(ids < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(ids, order, 1)
    if out.shape[1] < degree:
        out = np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)
    return out


def _link(points: np.ndarray, links: np.ndarray, new: np.ndarray, near: np.ndarray, degree: int) -> None:
    """Enters the new points' neighbour rows and the links back to them."""
    links[new] = near
    source = np.repeat(new, near.shape[1])
    target = near.ravel()
    ok = target >= 0
    source, target = source[ok], target[ok]
    order = np.lexsort((source, target))
    source, target = source[order], target[order]
    touched, first, count = np.unique(target, return_index=True, return_counts=True)
    for lo in range(0, len(touched), 4 * BLOCK):
        at, begin, size = touched[lo : lo + 4 * BLOCK], first[lo : lo + 4 * BLOCK], count[lo : lo + 4 * BLOCK]
        width = int(size.max())
        spread = np.arange(width)
        back = np.where(spread < size[:, None], source[np.minimum(begin[:, None] + spread, len(source) - 1)], -1)
        cand = np.concatenate([links[at], back], 1)
        cand = np.sort(cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        sims = np.matmul(points[np.maximum(cand, 0)], points[at][:, :, None])[:, :, 0]
        sims[cand < 0] = -np.inf
        best = _top(sims, min(cand.shape[1], 3 * degree))
        links[at] = _diverse(points, np.take_along_axis(cand, best, 1), np.take_along_axis(sims, best, 1), degree)


def build(points: np.ndarray) -> list[np.ndarray]:
    """Neighbour arrays of the layers, layer 0 first. ``points``: unit rows in random order."""
    n = len(points)
    sizes = [n]
    while sizes[-1] > TOP:
        sizes.append(-(-sizes[-1] // SCALE))
    layers: list[np.ndarray] = [None] * len(sizes)
    for level in range(len(sizes) - 1, -1, -1):
        degree = DEGREE if level == 0 else DEGREE_UPPER
        links = np.full((sizes[level], degree), -1, np.int32)
        at = 0
        while at < sizes[level]:
            # the first block is compared exhaustively, later ones double the graph at most
            block = np.arange(at, min(sizes[level], at + (2 * BLOCK if at < 8 * BLOCK else 4 * BLOCK)))
            own = points[block] @ points[block].T
            np.fill_diagonal(own, -np.inf)
            own[np.triu_indices(len(block), 1)] = -np.inf if at else own[np.triu_indices(len(block), 1)]
            inside = _top(own, min(16, len(block)))
            ids, sims = block[inside], np.take_along_axis(own, inside, 1)
            if at:
                found = [search_layer(points, links[:at], points[block[i : i + BLOCK]], _descend(points, layers, level, points[block[i : i + BLOCK]], at), BEAM_BUILD) for i in range(0, len(block), BLOCK)]
                ids = np.concatenate([np.concatenate([f[0] for f in found]), ids], 1)
                sims = np.concatenate([np.concatenate([f[1] for f in found]), sims], 1)
            best = _top(sims, min(BEAM_BUILD, sims.shape[1]))
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            ids[np.isneginf(sims)] = -1
            _link(points, links, block, _diverse(points, ids, sims, degree).astype(np.int32), degree)
            at = block[-1] + 1
        layers[level] = links
    return layers


def _descend(points: np.ndarray, layers: list[np.ndarray], level: int, queries: np.ndarray, below: int | None = None) -> np.ndarray:
    """Entry points of a layer: the nearest found in the layers above it; ``below`` limits them to points that are linked already."""
    top = len(layers) - 1
    limit = below if below is not None else len(layers[level])
    reach = min(limit, len(layers[top])) if layers[top] is not None else min(limit, TOP)
    starts = _top(queries @ points[:reach].T, min(STARTS, reach))
    for up in range(top - 1, level, -1):
        starts = search_layer(points, layers[up], queries, starts, 2 * STARTS)[0][:, :STARTS]
    return np.where(starts < limit, starts, 0)


def search(points: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, k: int, beam: int = BEAM_SEARCH, own: np.ndarray | None = None) -> np.ndarray:
    """Ids of the k nearest points found per query, best first, -1 where there are fewer.

    ``own`` holds the queries' own points if they are part of the graph; the search then begins there.
    """
    out = np.full((len(queries), k), -1, np.int64)
    for i in range(0, len(queries), BLOCK):
        q = queries[i : i + BLOCK]
        starts = own[i : i + BLOCK, None] if own is not None else _descend(points, layers, 0, q)
        ids = search_layer(points, layers[0], q, starts, max(beam, k))[0][:, :k]
        out[i : i + len(q), : ids.shape[1]] = ids
    return out
