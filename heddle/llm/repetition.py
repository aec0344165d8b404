"""Repetition inside single documents, by suffix arrays over words.

All documents of a batch are concatenated, with a unique separator after each,
into one word sequence; prefix doubling sorts its suffixes and the ranks of each
round give the longest common prefixes. Within an interval of neighbouring
suffixes with a common prefix of at least ``window`` words every place is
matched with the place before it in the text that it agrees with longest: the
words it shares with that one are a maximal repeat. The union of these spans is
what the document repeats, and the longest of them its longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[0-9a-z]+(?:[-./][0-9a-z]+)*"
#: Words sorted together; bounds a task's memory. A longer document is a batch of its own.
BATCH_WORDS = 400_000

RESULT = "doc_id bigint, n_words int, n_repeated int, longest_repeat int, repeats int"


def suffix_ranks(seq: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``seq`` and the ranks after each doubling (prefixes of 1, 2, 4, ... words)."""
    n = len(seq)
    rank = _places(np.unique(seq, return_inverse=True)[1])
    rounds, width = [rank.astype(np.int32)], 1
    live = np.arange(n)
    while True:
        # only suffixes that share their rank with another one still need sorting
        count = np.bincount(rank, minlength=n)
        live = live[count[rank[live]] > 1]
        if not len(live):
            break
        after = np.where(live + width < n, rank[np.minimum(live + width, n - 1)] + 1, 0)
        order = np.lexsort((after, rank[live]))
        live, after = live[order], after[order]
        own = rank[live]
        first = np.r_[True, (own[1:] != own[:-1])]
        fresh = first | np.r_[True, after[1:] != after[:-1]]
        # ranks are places in the order: a group's rank is the number of suffixes before it
        start = np.maximum.accumulate(np.where(first, np.arange(len(live)), 0))
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0))
        rank = rank.copy()
        rank[live] = own + (head - start)
        width *= 2
        rounds.append(rank.astype(np.int32))
    return np.argsort(rank, kind="stable"), rounds


def _places(rank: np.ndarray) -> np.ndarray:
    """Ranks counted in places: the number of suffixes in earlier groups."""
    count = np.bincount(rank)
    return (np.cumsum(count) - count)[rank]


def common_prefixes(sa: np.ndarray, rounds: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix shares with its predecessor in the suffix array."""
    n = len(sa)
    a, b = sa[:-1].copy(), sa[1:].copy()
    shared = np.zeros(n, np.int64)
    total = np.zeros(n - 1, np.int64)
    for level in range(len(rounds) - 1, -1, -1):
        rank, width = rounds[level], 1 << level
        inside = (a < n) & (b < n)
        same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
        a[same] += width
        b[same] += width
        total[same] += width
    shared[1:] = total
    return shared


def earlier_matches(sa: np.ndarray, lcp: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of every place that agrees with an earlier one in at least ``window`` words, with the longest such agreement.

    The best earlier place is, among the suffixes of an interval, the nearest in
    either direction that lies earlier in the text; a stack finds both in one
    sweep. Intervals of two, by far the most, need no sweep.
    """
    again = lcp >= window
    head = np.flatnonzero(~again & np.r_[again[1:], False])  # the suffix before the first that shares enough with its predecessor
    tail = np.flatnonzero(again & ~np.r_[again[1:], False])
    pair = tail - head == 1
    places, lengths = [np.maximum(sa[head[pair]], sa[tail[pair]])], [lcp[tail[pair]]]
    for lo, hi in zip(head[~pair].tolist(), tail[~pair].tolist()):
        found_at, found = [], []
        stack: list[tuple[int, int]] = []
        for at, shared in zip(sa[lo : hi + 1].tolist(), [0, *lcp[lo + 1 : hi + 1].tolist()]):
            while stack and stack[-1][0] > at:
                later, before = stack.pop()
                found_at.append(later)
                found.append(max(before, shared))
                shared = min(before, shared)
            stack.append((at, shared))
        found_at += [at for at, _ in stack]
        found += [shared for _, shared in stack]
        places.append(np.array(found_at, np.int64))
        lengths.append(np.array(found, np.int64))
    at, length = np.concatenate(places), np.concatenate(lengths)
    return at[length >= window], length[length >= window]


def repeated_spans(seq: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(which words are repeated, length of the maximal repeat that begins at each place)."""
    n = len(seq)
    length_at = np.zeros(n, np.int64)
    if n < window + 1:
        return np.zeros(n, bool), length_at
    sa, rounds = suffix_ranks(seq)
    at, length = earlier_matches(sa, common_prefixes(sa, rounds), window)
    length_at[at] = length
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0, length_at


def measure(docs: list[np.ndarray], window: int) -> list[tuple[int, int, int, int]]:
    """(words, repeated words, longest repeat, repeated spans) of each document of word codes >= 0."""
    sizes = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(sizes + 1)
    seq = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    for d, end, size in zip(docs, ends, sizes):
        seq[end - size - 1 : end - 1] = d
    seq[ends - 1] = -1 - np.arange(len(docs))  # separators are all different, and the same word in two documents must differ
    owner = np.repeat(np.arange(len(docs)), sizes + 1)
    covered, length_at = repeated_spans(seq, window)
    words = np.bincount(owner, weights=covered, minlength=len(docs)).astype(int)
    begins = covered & ~np.r_[False, covered[:-1]]
    spans = np.bincount(owner, weights=begins, minlength=len(docs)).astype(int)
    longest = np.zeros(len(docs), np.int64)
    np.maximum.at(longest, owner, length_at)
    return [(int(n), int(c), int(x), int(s)) for n, c, x, s in zip(sizes, words, longest, spans)]


def _codes(docs: list) -> list[np.ndarray]:
    """Word codes that never agree between two documents."""
    if not docs:
        return []
    sizes = np.array([len(d) for d in docs], np.int64)
    flat = np.concatenate([np.asarray(d, np.int64) for d in docs]) if sizes.sum() else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(docs)), sizes)
    order = np.lexsort((flat, owner))
    changed = np.r_[True, (flat[order][1:] != flat[order][:-1]) | (owner[order][1:] != owner[order][:-1])] if len(flat) else np.empty(0, bool)
    codes = np.empty(len(flat), np.int64)
    codes[order] = np.cumsum(changed) - 1
    return np.split(codes, np.cumsum(sizes)[:-1])


def _measure_rows(window: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in RESULT.split(", ")]
        for part in parts:
            ids, docs, held, out = [], [], 0, []
            for doc_id, words in zip(part["doc_id"], part["words"]):
                if held and held + len(words) > BATCH_WORDS:
                    out += [(i, *m) for i, m in zip(ids, measure(_codes(docs), window))]
                    ids, docs, held = [], [], 0
                ids.append(doc_id)
                docs.append(words)
                held += len(words)
            out += [(i, *m) for i, m in zip(ids, measure(_codes(docs), window))] if ids else []
            yield pd.DataFrame(out, columns=names)

    return run


def repetition(documents: DataFrame, window: int = 6) -> DataFrame:
    """Per document: n_words, n_repeated, longest_repeat (words), repeats (spans), share.

    ``documents``: doc_id, text. Words are the matches of ``WORD`` in the
    lower-cased text, coded by 64-bit hashes before they leave the JVM. A word
    is repeated if it lies in a sequence of ``window`` words that began at an
    earlier word of the same text; overlapping occurrences count. Null, blank
    and shorter texts have share 0 and are kept. Whole texts are measured, each
    in one task; repeated rows of a document are measured each.
    """
    words = F.transform(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"({WORD})"), F.lit(1)), lambda w: F.xxhash64(w))
    coded = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), words.alias("words"))
    measured = coded.mapInPandas(_measure_rows(window), RESULT)
    return measured.withColumn("share", F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(F.lit(0.0)))


def repetitive(measured: DataFrame, min_words: int = 20, min_share: float = 0.3, max_longest: int | None = None) -> DataFrame:
    """Documents whose repeated share, or longest repeat if a limit is given, is too high."""
    over = F.col("n_repeated") >= F.lit(min_share) * F.col("n_words")
    if max_longest is not None:
        over = over | (F.col("longest_repeat") > max_longest)
    return measured.filter((F.col("n_words") >= min_words) & over)
