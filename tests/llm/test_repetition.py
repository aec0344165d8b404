import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm.repetition import WORD, _codes, common_prefixes, measure, repetition, repetitive, suffix_ranks

from ..conftest import rows


def brute(words, window):
    seen, hit = set(), set()
    for i in range(len(words) - window + 1):
        gram = tuple(words[i : i + window])
        if gram in seen:
            hit |= set(range(i, i + window))
        seen.add(gram)
    return len(hit)


def test_many_repeats_take_linear_time():
    """One phrase said 20,000 times is one large interval of the suffix array."""
    import time

    began = time.time()
    (n, covered, most, spans), = measure(_codes([np.tile(np.arange(9), 20_000)]), 6)
    assert (n, covered, most, spans) == (180_000, 179_991, 179_991, 1) and time.time() - began < 60


def longest(words):
    best = 0
    for i in range(len(words)):
        for j in range(i):
            n = 0
            while i + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            best = max(best, n)
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-2, 2), max_size=60), max_size=6), st.integers(2, 6))
def test_measure(docs, window):
    got = measure(_codes([np.array(d, np.int64) for d in docs]), window)
    for d, (n, covered, most, spans) in zip(docs, got):
        assert (n, covered) == (len(d), brute(d, window))
        assert most == (longest(d) if longest(d) >= window else 0)
        assert (spans > 0) == (covered > 0)
    assert len(got) == len(docs)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=50))
def test_suffix_array(seq):
    sa, rounds = suffix_ranks(np.array(seq))
    assert sa.tolist() == sorted(range(len(seq)), key=lambda i: seq[i:])
    lcp = common_prefixes(sa, rounds)
    for i in range(1, len(seq)):
        a, b = seq[sa[i - 1] :], seq[sa[i] :]
        assert lcp[i] == next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


DOC = "doc_id bigint, text string, words string, n_words int"


def test_documents(spark):
    phrase = "The quick brown fox jumps over-the/lazy dog. "
    texts = [phrase * 5, phrase + "nothing here is said twice but a few words are enough to fill it up to twenty", None, "", "a " * 6, "A b " * 40_000]
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"]: r for r in repetition(df).collect()}
    for i, t in enumerate(texts):
        words = re.findall(WORD, (t or "").lower())
        assert (got[i]["n_words"], got[i]["n_repeated"]) == (len(words), brute(words, 6))
        assert got[i]["share"] == (brute(words, 6) / len(words) if words else 0)
    assert rows(repetitive(repetition(df)), "doc_id") == [(0,), (5,)]
    assert rows(repetitive(repetition(df), min_share=2.0, max_longest=1000), "doc_id") == [(5,)]
    assert repetition(df.limit(0)).count() == 0
