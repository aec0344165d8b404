"""Comparing snapshots: artifact inventories and three-way sync states."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inventory_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """artifact, change (``added``, ``removed``, ``changed``) of two inventories (artifact, sha256)."""
    b, a = before.select("artifact", F.col("sha256").alias("b")), after.select("artifact", F.col("sha256").alias("a"))
    both = b.withColumn("in_b", F.lit(True)).join(a.withColumn("in_a", F.lit(True)), "artifact", "full_outer")
    change = (
        F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    )
    return both.select("artifact", change.alias("change")).filter(F.col("change").isNotNull())


#: Payload stores that a commit may carry beside its vectors.
STORES = ("text_id", "lexical_id")
SIDES = ("absent", "behind", "still", "moved")
PAIRS = ("apart", "twin", "equal", "richer", "mixed")

# The decision table: base, local, remote, how the two compare -> state; * is any, the first row that fits counts.
# fixed values: the names of the states
DECISIONS = """
*     absent  absent  *       in_sync
*     behind  *       *       unknown
*     *       behind  *       unknown
*     *       absent  *       local_ahead
*     absent  *       *       remote_ahead
*     *       *       twin    in_sync
*     *       *       equal   in_sync
*     *       *       richer  republish
*     *       *       mixed   unknown
none  *       *       *       unknown
known still   still   *       in_sync
known moved   still   *       local_ahead
known still   moved   *       remote_ahead
known moved   moved   *       diverged
"""


def _decisions() -> dict[str, str]:
    """The table with every * spelled out, by the four words joined."""
    rules = [line.split() for line in DECISIONS.split("\n") if line]
    fits = lambda rule, case: all(r in ("*", c) for r, c in zip(rule, case))
    cases = product(("known", "none"), SIDES, SIDES, PAIRS)
    return {" ".join(case): next(rule[4] for rule in rules if fits(rule, case)) for case in cases}


def _store_marks(a: str, b: str) -> Column:
    """One mark per payload store: ``=`` alike (or in neither), ``<`` only in b, ``>`` only in a, ``x`` different in both."""
    one = lambda x, y: F.when(x.eqNullSafe(y), "=").when(x.isNull(), "<").when(y.isNull(), ">").otherwise("x")
    return F.concat(*[one(F.col(f"{a}.{s}"), F.col(f"{b}.{s}")) for s in STORES])


def classify(states: DataFrame) -> DataFrame:
    """Adds ``state`` to rows with structs local, base and remote (null: absent).

    Each struct: generation, snapshot_id, logical_id, text_id, lexical_id; the
    last two name optional payload stores. Four words describe a row, and the
    state is looked up in ``DECISIONS``: whether a base is known; what each side
    did since (absent, behind: its generation is smaller than the base's, still:
    same commit without new or other stores, moved); and how local and remote
    compare (apart: other commits; twin: the same snapshot; richer: the same
    commit, local carries stores that remote lacks; equal: local adds nothing;
    mixed: their stores differ both ways or conflict).
    """

    def side(name: str) -> Column:
        alike = F.col(f"{name}.logical_id").eqNullSafe(F.col("base.logical_id")) & ~_store_marks(name, "base").rlike("[>x]")
        return (
            F.when(F.col(name).isNull(), "absent")
            .when(F.col(f"{name}.generation") < F.col("base.generation"), "behind")
            .when(alike, "still")
            .otherwise("moved")
        )

    marks = _store_marks("local", "remote")
    pair = (
        F.when(F.col("local").isNull() | F.col("remote").isNull() | ~F.col("local.logical_id").eqNullSafe(F.col("remote.logical_id")), "apart")
        .when(F.col("local.snapshot_id").eqNullSafe(F.col("remote.snapshot_id")), "twin")
        .when(marks.rlike("^[=<]*$"), "equal")
        .when(marks.rlike("^[=>]*$"), "richer")
        .otherwise("mixed")
    )
    words = F.concat_ws(" ", F.when(F.col("base").isNull(), "none").otherwise("known"), side("local"), side("remote"), pair)
    table = F.create_map(*[F.lit(x) for entry in _decisions().items() for x in entry])
    return states.withColumn("state", F.element_at(table, words))


def redact(documents: DataFrame) -> DataFrame:
    """A copy for transfer without raw text and tokens."""
    return documents.drop("text", "tokens")
