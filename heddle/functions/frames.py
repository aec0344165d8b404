"""Temporal frames over valid_at, invalid_at, created_at and expired_at (epoch ms, null = open)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class AsOf:
    """A point of view on bi-temporal rows; see the class methods."""

    def __init__(self, kind: str, valid: int | None = None, known: int | None = None):
        self.kind, self.valid, self.known = kind, valid, known

    @classmethod
    def now(cls) -> AsOf:
        """Neither ended nor superseded; a start in the future still counts."""
        return cls("now")

    @classmethod
    def now_valid(cls, t: int) -> AsOf:
        """Valid at t and on record at t."""
        return cls("now_valid", t, t)

    @classmethod
    def at(cls, t: int) -> AsOf:
        """Valid at t, by all that is on record today."""
        return cls("at", t)

    @classmethod
    def at_known(cls, valid: int, known: int) -> AsOf:
        """Valid at one time by what was on record at another; ends recorded later do not count."""
        return cls("at_known", valid, known)

    @classmethod
    def all(cls) -> AsOf:
        return cls("all")

    @classmethod
    def parse(cls, value: Any, clock: int) -> AsOf:
        """None, "now_valid"/"strict", "all"/"history" in any case, a time or a (valid, known) pair."""
        if value is None:
            return cls.now()
        if isinstance(value, AsOf):
            return value
        if isinstance(value, bool):
            raise TypeError("a boolean is no time")
        if isinstance(value, int):
            return cls.at(value)
        if isinstance(value, str) and value.strip().lower() in ("now_valid", "strict"):
            return cls.now_valid(clock)
        if isinstance(value, str) and value.strip().lower() in ("all", "history"):
            return cls.all()
        if isinstance(value, tuple) and len(value) == 2 and all(isinstance(x, int) and not isinstance(x, bool) for x in value):
            return cls.at_known(*value)
        raise ValueError(f"not a temporal frame: {value!r}")

    def predicate(self, prefix: str = "") -> Column:
        """Two-valued Column over the four time columns, whose names may carry a prefix."""
        start, end, created, expired = (F.col(f"{prefix}{c}") for c in ("valid_at", "invalid_at", "created_at", "expired_at"))
        started = lambda t: start.isNull() | (start <= t)
        open_at = lambda c, t: c.isNull() | (c > t)
        held = lambda t: F.coalesce(created <= t, F.lit(False)) & open_at(expired, t)
        if self.kind == "now":
            return is_live(prefix)
        if self.kind == "all":
            return F.lit(True)
        if self.kind == "at":
            return started(self.valid) & open_at(end, self.valid)
        if self.kind == "now_valid":
            return started(self.valid) & open_at(end, self.valid) & held(self.known)
        end_unknown = F.coalesce(expired > self.known, F.lit(False))
        return started(self.valid) & held(self.known) & (end_unknown | open_at(end, self.valid))


def is_live(prefix: str = "") -> Column:
    return F.col(f"{prefix}expired_at").isNull() & F.col(f"{prefix}invalid_at").isNull()


def encode_ts(ms: Column, open_tag: str) -> Column:
    """Text that sorts like the time: ``a`` for an open start, ``b`` and 20 digits, ``c`` for an open end."""
    shifted = ms.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(ms.isNull(), F.lit(open_tag)).otherwise(F.concat(F.lit("b"), F.lpad(shifted.cast("string"), 20, "0")))
