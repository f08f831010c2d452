"""Refusals: a bad parameter or an oversized result raises, and is never cut short in silence."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The SQLSTATE of a refused request, and the caps on rows and ids.
SQLSTATE = "22023"
ROW_CAP, IDS_ANONYMOUS, IDS_SIGNED_IN = 1000, 3, 50


class Refused(ValueError):
    """A request that is refused, with the state that clients test for."""

    sqlstate = SQLSTATE


def row_cap(df: DataFrame, name: str, paging: bool = False, cap: int = ROW_CAP) -> DataFrame:
    """``df``, or a refusal if it has more rows than ``cap`` and isn't a page. Counts ``cap + 1`` rows at most."""
    if not paging and df.limit(cap + 1).count() > cap:
        raise Refused(f"{name}: more than {cap} rows; narrow the request")
    return df


def panel_ids(ids: Sequence[str], signed_in: bool = False) -> None:
    most = IDS_SIGNED_IN if signed_in else IDS_ANONYMOUS
    if len(ids) > most:
        raise Refused(f"{len(ids)} ids; at most {most}")


def panel_universe(n_ids: int, family: str | None, families: Sequence[str], signed_in: bool = False) -> None:
    if family is not None and family not in families:
        raise Refused(f"unknown family {family}")
    if n_ids == 0 and (family is None or not signed_in):
        raise Refused("a universe needs a family and a signed-in caller")


def one_of(value: str | None, allowed: Sequence[str], name: str) -> None:
    if value is not None and value not in allowed:
        raise Refused(f"{name} must be one of {', '.join(allowed)}")


def between(value: float, low: float, high: float, name: str) -> None:
    if not low <= value <= high:
        raise Refused(f"{name} must be from {low} to {high}")


def window(start: date, end: date, earliest: date | None = None) -> None:
    """A refusal if the window is empty or begins before a break of the series."""
    if start > end or earliest and start < earliest:
        raise Refused(f"window {start} to {end} isn't served")


def exactly_one(**given) -> None:
    if sum(v is not None for v in given.values()) != 1:
        raise Refused(f"exactly one of {', '.join(given)} is needed")


def date_cursor(text: str | None) -> date | None:
    if text is None:
        return None
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise Refused(f"cursor {text!r} isn't a date")
    try:
        return date.fromisoformat(text)
    except ValueError as e:
        raise Refused(str(e)) from None


def panel_cursor(text: str | None) -> tuple[date, str, str, str] | None:
    """The parts of a cursor date|id|metric|class."""
    if text is None:
        return None
    parts = text.split("|")
    if len(parts) != 4:
        raise Refused(f"cursor {text!r} doesn't have four parts")
    return (date_cursor(parts[0]), *parts[1:])


def nav_cursor(text: str | None, ids: Sequence[str]) -> tuple[date, str] | None:
    """The parts of a cursor date|class of one entity's values; with several entities it can't be told which it is of."""
    if text is None:
        return None
    if len(ids) != 1:
        raise Refused("a cursor needs exactly one id")
    day, bar, name = text.partition("|")
    if not bar:
        raise Refused(f"cursor {text!r} doesn't have two parts")
    return date_cursor(day), name


def unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``df``, or a refusal if a key occurs twice."""
    if not df.groupBy(*keys).count().filter(F.col("count") > 1).isEmpty():
        raise Refused(f"{name}: keys {', '.join(keys)} aren't unique")
    return df
