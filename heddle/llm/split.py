"""Splitting oversized texts at natural boundaries, with overlap.

Recursive bisection: a stretch that is too long is cut at the strongest
boundary near its midpoint, halves still too long are cut again, and at the end
every piece but the first is extended to the left by the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE as SPACE_CLASS
from ..functions.text import trim_unicode

# fixed values: the characters with the Unicode property White_Space
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_SPACE = f"[{re.escape(WHITE_SPACE)}]"
_INLINE = f"[{re.escape(''.join(c for c in WHITE_SPACE if c not in '\n\r\u2028\u2029'))}]"
_BREAK = "(?:\r\n|[\n\r\u2028])"
_UNBROKEN = re.compile(f"[^{re.escape(WHITE_SPACE)}]+")
#: Where a cut may fall, strongest first: after blank lines, line ends, sentence ends, clause ends, white space.
BOUNDARIES = [
    re.compile(f"{_BREAK}(?:{_INLINE}*{_BREAK})+|\u2029"),
    re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028]"),
    re.compile(f"[.!?\u2026\u3002\uff01\uff1f][\"')\\]\xbb\u201d\u2019]*{_SPACE}+"),
    re.compile(f"[,;:\u2013\u2014]{_SPACE}+"),
    re.compile(f"{_SPACE}+"),
]
#: A combining mark, joiner, variation selector or skin tone should not begin a piece.
_ATTACHED = re.compile("[\u0300-\u036f\u200d\ufe00-\ufe0f\u20d0-\u20ff\U0001f3fb-\U0001f3ff]")
_JOINER = "\u200d"

PIECES = "case_id bigint, char_limit int, length int, longest_run int, faults array<string>, piece int, start int, stop int, text string, cut string"


def cut_points(text: str, limit: int, overlap: int) -> list[tuple[int, str]]:
    """Ascending cuts of ``text`` (offset, kind of boundary) such that every piece,
    once extended to the left by the overlap, has at most ``limit`` code points."""
    step = limit - overlap
    if len(text) <= limit:
        return []
    places = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]
    kinds = ("paragraph", "line", "sentence", "clause", "space")
    cuts, todo = [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= (limit if lo == 0 else step):
            continue
        cut, kind = _strongest(places, kinds, lo, hi)
        if cut is None:
            cut, kind = _forced(text, lo, hi, step), "forced"
        cuts.append((cut, kind))
        todo += [(lo, cut), (cut, hi)]
    return sorted(cuts)


def _strongest(places: list[list[int]], kinds: tuple[str, ...], lo: int, hi: int) -> tuple[int | None, str]:
    """The strongest boundary in the middle half, else the one of any strength nearest the midpoint."""
    from bisect import bisect_left

    middle, nearest = (lo + hi) // 2, (None, "")
    quarter = (hi - lo) // 4
    for at, kind in zip(places, kinds):
        i = bisect_left(at, middle)
        near = [p for p in at[max(0, i - 1) : i + 1] if lo < p < hi]
        if not near:
            continue
        best = min(near, key=lambda p: (abs(p - middle), p))
        if abs(best - middle) <= quarter:
            return best, kind
        if nearest[0] is None or abs(best - middle) < abs(nearest[0] - middle):
            nearest = best, kind
    return nearest


def _forced(text: str, lo: int, hi: int, step: int) -> int:
    """A cut inside an unbroken run, a multiple of the step from its start so that few pieces result."""
    cut = lo + max(1, round((hi - lo) / 2 / step)) * step
    if cut >= hi:
        cut = lo + (hi - lo) // 2
    for back in range(min(8, cut - lo - 1)):
        if not _ATTACHED.match(text[cut - back]) and text[cut - back - 1] != _JOINER:
            return cut - back
    return cut


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, stop, kind of the cut before it) of each piece; [] for an empty text."""
    if not text:
        return []
    overlap = max(0, min(overlap, limit - 1))
    cuts = cut_points(text, limit, overlap)
    begins = [(0, "start"), *cuts]
    ends = [c for c, _ in cuts] + [len(text)]
    return [(max(0, b - overlap) if i else 0, e, kind) for i, ((b, kind), e) in enumerate(zip(begins, ends))]


def faults_of(text: str, limit: int, chunks, pieces: int, longest: int) -> list[str]:
    found = []
    if pieces > 1:
        found.append("oversized")
    if longest > limit:
        found.append("unbreakable")
    if chunks is not None:
        whole = [c for c in chunks if c is not None]
        if any(len(c) > limit for c in whole):
            found.append("chunk_over_limit")
        if "".join(whole) != text:
            found.append("chunks_differ")
    return found


def _split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split(" ")[0] for c in PIECES.split(", ")]
    for part in parts:
        out = []
        for case, raw, limit, overlap, chunks in zip(part["case_id"], part["text"], part["char_limit"], part["overlap"], part["chunks"]):
            text = raw.strip(WHITE_SPACE)
            pieces = split_text(text, int(limit), int(overlap))
            longest = max((len(m.group()) for m in _UNBROKEN.finditer(text)), default=0)
            faults = faults_of(text, int(limit), chunks, len(pieces), longest)
            head = (case, int(limit), len(text), longest, faults)
            out += [(*head, i, a, b, text[a:b], kind) for i, (a, b, kind) in enumerate(pieces)] or [(*head, None, None, None, None, None)]
        frame = pd.DataFrame(out, columns=names)
        for c in ("piece", "start", "stop"):
            frame[c] = frame[c].astype("Int32")
        yield frame


def split_cases(cases: DataFrame) -> DataFrame:
    """Cuts every text into pieces of at most ``char_limit`` code points.

    ``cases``: case_id, text, char_limit, overlap, chunks (the pieces recorded
    by earlier tools, or null). One row per piece with its place in the text
    (trimmed of Unicode white space), the kind of cut before it, and per case the
    text's length, its longest unbroken run and the faults found: ``oversized``,
    ``unbreakable``, ``chunk_over_limit``, ``chunks_differ``. A piece shares its
    first ``overlap`` code points with the one before (all of that piece's text
    if it is shorter). Texts within the limit are one piece; blank texts are one
    row without piece; null texts count as blank. A null or negative overlap is
    0 and it is at most the limit less 1. Rows with a null limit or one below 1
    are ignored; null chunks in a list count as empty. Repeated rows are kept.
    """
    sound = cases.filter(F.col("char_limit") >= 1).select(
        F.col("case_id").cast("bigint").alias("case_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("char_limit").cast("int").alias("char_limit"),
        F.coalesce(F.col("overlap").cast("int"), F.lit(0)).alias("overlap"),
        "chunks",
    )
    return sound.mapInPandas(_split, PIECES)


def split_faults(pieces: DataFrame) -> DataFrame:
    """One row per case and fault, from the result of ``split_cases``."""
    return pieces.select("case_id", F.explode("faults").alias("fault")).distinct()


def split_violations(pieces: DataFrame, cases: DataFrame) -> DataFrame:
    """What is wrong with the pieces of ``split_cases``: case_id, piece, rule; empty if all is well.

    Works from the pieces alone, without the splitter, and expects every
    case_id once. Rules: ``over limit``; ``other text`` (not what the text has
    at that place); ``begins late``, ``ends early``; ``overlap`` (the piece does
    not start the asked-for overlap before the end of the piece before it);
    ``adds nothing``; ``no boundary`` (the cut before it is called natural, but
    no white space precedes it); ``boundary missed`` (the cut is a forced one
    although the piece before it holds a place where white space ends); ``no
    piece`` for a text that is not blank.
    """
    text = trim_unicode(F.coalesce("text", F.lit("")))
    asked = cases.filter(F.col("char_limit") >= 1).select("case_id", text.alias("whole"), F.greatest(F.lit(0), F.least(F.coalesce("overlap", F.lit(0)), F.col("char_limit") - 1)).alias("overlap"))
    order = Window.partitionBy("case_id").orderBy("piece")
    own = pieces.filter(F.col("piece").isNotNull()).select(
        "case_id", "piece", "start", "stop", "text", "cut", "char_limit",
        F.lag("stop").over(order).alias("cut_at"), F.coalesce(F.lag("stop", 2).over(order), F.lit(0)).alias("cut_before"), F.lead("stop").over(order).isNull().alias("last"),
    ).join(asked, "case_id")
    outer = f"[^{SPACE_CLASS[1:]}"
    stretch = F.substring("whole", F.col("cut_before") + 1, F.col("cut_at") - F.col("cut_before") + 1)
    rules = {
        "over limit": F.length("text") > F.col("char_limit"),
        "other text": F.col("text") != F.substring("whole", F.col("start") + 1, F.col("stop") - F.col("start")),
        "begins late": (F.col("piece") == 0) & (F.col("start") != 0),
        "ends early": F.col("last") & (F.col("stop") != F.length("whole")),
        "overlap": F.col("start") != F.greatest(F.lit(0), F.col("cut_at") - F.col("overlap")),
        "adds nothing": F.col("stop") <= F.coalesce("cut_at", F.lit(0)),
        "no boundary": ~F.col("cut").isin("start", "forced") & ~F.substring("whole", F.col("cut_at"), F.lit(1)).rlike(SPACE_CLASS),
        "boundary missed": (F.col("cut") == "forced") & stretch.rlike(f"{SPACE_CLASS}{outer}"),
    }
    broken = own.select("case_id", "piece", F.explode(F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))).alias("rule"))
    lost = asked.filter(F.length("whole") > 0).join(own.select("case_id"), "case_id", "left_anti").select("case_id", F.lit(None).cast("int").alias("piece"), F.lit("no piece").alias("rule"))
    return broken.unionByName(lost)
