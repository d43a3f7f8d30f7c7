"""Scalar functions; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad18(c: Column) -> Column:
    """An id padded to 18 with zeros on the left; longer ids stay (``lpad`` alone would cut them)."""
    return F.when(F.length(c) < 18, F.lpad(c, 18, "0")).otherwise(c)


def strip_zeros(c: Column) -> Column:
    return F.regexp_replace(c, "^0+", "")


def same_id(a: Column, b: Column) -> Column:
    """Ids are equal in any spelling: raw, padded or without zeros in front."""
    return pad18(a) == pad18(b)


def tier(rank: Column, null_tier: str = "null") -> Column:
    """Tier of a rank; what is in none is NULL, or ``beginner``."""
    named = F.when(rank >= 27, "master").when(rank.between(21, 26), "advanced").when(rank.between(15, 20), "intermediate")
    if null_tier == "beginner":
        return named.otherwise("beginner")
    return named.when(rank.between(0, 14), "beginner")


def tier_order(c: Column) -> Column:
    return F.when(c == "global", 1).when(c == "master", 2).when(c == "advanced", 3).when(c == "intermediate", 4).when(c == "beginner", 5)


def share(part: Column, total: Column) -> Column:
    """100 * part / total as a double; NULL if the total is zero."""
    return F.try_divide(part.cast("double") * 100, total.cast("double"))


def hundredths(part: Column, total: Column) -> Column:
    """100 * part / total in hundredths, rounded half up in whole numbers; NULL if the total is zero."""
    p, n = part.cast("long"), F.nullif(total.cast("long"), F.lit(0).cast("long"))
    up = p * 20000 + n
    return ((up - F.pmod(up, 2 * n)) / (2 * n)).cast("long")


def winrate(wins: Column, losses: Column, digits: int | None = None) -> Column:
    if digits is None:
        return share(wins, wins + losses)
    if digits != 2:
        raise ValueError("two digits or none")
    return hundredths(wins, wins + losses) / F.lit(100.0)


def format_id(c: Column) -> Column:
    """``xxxx-xxxx-xxxx`` for ids of 12 characters or more; the third part runs to the end."""
    parts = F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 4), F.substring(c, 9, 1 << 20))
    return F.when(F.length(c) >= 12, parts).otherwise(c)


def valid_player_id(c: Column) -> Column:
    """Trimmed, 1 to 12 letters and digits."""
    t = F.trim(c)
    return F.coalesce(t.rlike("^[A-Za-z0-9]+$") & (F.length(t) <= 12), F.lit(False))


def utc_date(seconds: Column, with_seconds: bool = True) -> Column:
    """Epoch seconds as ``MM/dd/yyyy HH:mm:ss UTC`` or ``MM/dd/yyyy HH:mm``; the session's time zone has to be UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "MM/dd/yyyy HH:mm:ss 'UTC'" if with_seconds else "MM/dd/yyyy HH:mm")
