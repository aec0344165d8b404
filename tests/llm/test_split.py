import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm.split import WHITE_SPACE, split_cases, split_faults, split_text, split_violations

from ..conftest import rows

TEXT = st.text(alphabet="ab. \n\t,!  　\U0001f600́‍-", max_size=300)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 60), st.integers(0, 70))
def test_pieces(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    overlap = min(overlap, limit - 1)
    assert all(0 < b - a <= limit for a, b, _ in pieces)
    assert (len(pieces) > 1) == (len(text) > limit)
    if text:
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (_, before, _), (a, b, _) in zip(pieces, pieces[1:]):
        assert a == max(0, before - overlap) and b > before  # shares exactly the overlap, adds something


def test_whole_text_without_overlap():
    text = "One sentence here. Another one, with a clause; done.\n\nA new paragraph follows it. " * 40
    pieces = split_text(text, 90, 0)
    assert "".join(text[a:b] for a, b, _ in pieces) == text
    assert all(kind != "forced" for *_, kind in pieces)
    assert {"paragraph"} <= {kind for *_, kind in pieces}


def test_cuts_prefer_strong_boundaries():
    text = "aaaa bbbb cccc dddd.\n\neeee ffff gggg hhhh"
    assert [(text[a:b], k) for a, b, k in split_text(text, 30, 0)] == [("aaaa bbbb cccc dddd.\n\n", "start"), ("eeee ffff gggg hhhh", "paragraph")]


def test_unbroken_runs_and_long_texts():
    assert [b - a for a, b, _ in split_text("x" * 100, 30, 5)] == [25, 30, 30, 30]
    long = "lorem ipsum " * 100_000
    assert max(b - a for a, b, _ in split_text(long, 500, 50)) <= 500


CASE = "case_id bigint, document_id string, text string, char_limit int, overlap int, chunks array<string>, cut string"


def test_cases(spark):
    cases = [
        (1, "d", "   short ", 10, 3, ["short"], "c"),
        (2, "d", "word " * 10, 12, None, None, "c"),
        (3, "d", "x" * 30, 10, 2, ["x" * 11, "x"], "c"),
        (4, "d", None, 10, 2, ["a", None], "c"),
        (5, "d", " \n ", 10, 2, [], "c"),
        (6, "d", "abc", None, 2, None, "c"),
        (7, "d", "abc", 0, 2, None, "c"),
        (1, "d", "   short ", 10, 3, ["short"], "c"),
    ]
    got = split_cases(spark.createDataFrame(cases, CASE))
    assert rows(split_faults(got)) == [(2, "oversized"), (3, "chunk_over_limit"), (3, "chunks_differ"), (3, "oversized"), (3, "unbreakable"), (4, "chunks_differ")]
    by_case = {c: [r["text"] for r in got.collect() if r["case_id"] == c] for c in range(1, 8)}
    assert by_case[1] == ["short", "short"] and by_case[4] == by_case[5] == [None] and by_case[6] == by_case[7] == []
    assert "".join(by_case[2]) == ("word " * 10).strip()
    assert split_cases(spark.createDataFrame([], CASE)).count() == 0


@pytest.mark.parametrize("c", ["\x1c", "​", "﻿"])
def test_what_is_no_white_space(c):
    assert c not in WHITE_SPACE and re.fullmatch(f"[{re.escape(WHITE_SPACE)}]", c) is None


def test_violations_are_seen(spark):
    """Sound pieces break no rule; each way of spoiling them is found."""
    from pyspark.sql import functions as F

    text = "One sentence here. Another one, with a clause; done.\n\nA new paragraph follows it. " * 3 + "y" * 70 + " end"
    cases = spark.createDataFrame([(1, "d", f"  {text} ", 40, 7, None, "c"), (2, "d", "short", 40, 7, None, "c"), (3, "d", " ", 40, 7, None, "c"), (4, "d", "z" * 90, 40, None, None, "c")], CASE)
    good = split_cases(cases)
    assert rows(split_violations(good, cases)) == []
    change = lambda name, value, of=3: good.withColumn(name, F.when((F.col("case_id") == 1) & (F.col("piece") == of), value).otherwise(F.col(name)))
    rules = lambda df: {r["rule"] for r in split_violations(df, cases).collect()}
    assert rules(change("text", F.lit("x"))) == {"other text"}
    assert {"over limit", "other text"} <= rules(change("text", F.repeat(F.lit("x"), F.lit(41))))
    assert "overlap" in rules(change("start", F.col("start") + 1)) and "begins late" in rules(change("start", F.lit(1), 0))
    assert rules(good.filter("not (case_id = 1 and piece = 3)")) >= {"overlap"}
    assert rules(good.filter("case_id <> 2")) == {"no piece"}
    assert "boundary missed" in rules(change("cut", F.lit("forced"))) and "no boundary" in rules(good.withColumn("cut", F.when(F.col("cut") == "forced", "space").otherwise(F.col("cut"))))
    last = good.groupBy("case_id").agg(F.max("piece").alias("last"))
    assert "ends early" in rules(good.join(last, "case_id").filter("case_id <> 1 or piece < last").drop("last"))
