"""Date parsing, formatting and the points in time that date tests compare with."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, functions as F

EPOCH = "EPOCH"
_UNITS = {"Y": "years", "M": "months", "D": "days", "h": "hours", "m": "minutes", "s": "seconds"}
_POINT = re.compile(r"(NOW|TODAY)\s*(?:([-+])\s*(\d+)\s*([YMDhms]))?\s*(\*)?")
#: Letters of patterns that Spark formats but won't parse: weekday names, and text months with their locales.
_TEXTUAL = re.compile(r"E|MMM|a|z|Z|X|O|V")


def is_epoch(format: str | None) -> bool:
    return not format or format.upper() == EPOCH


def _unquoted(format: str) -> str:
    return re.sub(r"'[^']*'", "", format)


_CODES = {"y": "%Y", "u": "%Y", "M": "%m", "d": "%d", "H": "%H", "h": "%I", "m": "%M", "s": "%S", "S": "%f", "E": "%a", "a": "%p", "z": "%Z", "Z": "%z", "X": "%z"}
_LONG = {"yy": "%y", "MMM": "%b", "MMMM": "%B", "EEEE": "%A"}


def _strptime(format: str) -> str:
    """A Java date pattern as one of Python's, for patterns with names in them."""
    out = []
    for quoted, letters, _, other in re.findall(r"'([^']*)'|(([A-Za-z])\3*)|(.)", format):
        if letters:
            if letters[0] not in _CODES:
                raise ValueError(f"pattern letter {letters[0]} isn't supported in {format!r}")
            out.append(_LONG.get(letters, _CODES[letters[0]]))
        else:
            out.append((quoted or other).replace("%", "%%"))
    return "".join(out)


def parse(v: Column, format: str | None, zone: str = "UTC") -> Column:
    """A timestamp, or null where the text doesn't fit. Patterns are Java's; missing time of day is midnight. A zone
    relabels: the text's wall time is taken to be in it."""
    v = F.trim(v)
    if is_epoch(format):
        return F.timestamp_millis(F.when(v.rlike(r"\A-?\d+\z"), v.try_cast("bigint")))
    if is_textual(format):
        return instant(F.get(walls(F.array(v), [format])[0], F.lit(0)), zone)
    wall, like = F.try_to_timestamp(v, F.lit(format)), _shape(format)
    return _relabelled(wall if like is None else F.when(v.rlike(like), wall), zone)


def is_textual(format: str | None) -> bool:
    """Whether a pattern has names in it, which Spark writes but doesn't read."""
    return not is_epoch(format) and bool(_TEXTUAL.search(_unquoted(format)))


def walls(texts: Column, formats: list[str]) -> Column:
    """For each of some textual patterns the wall times, as text, of an array of texts; null where one doesn't fit. All
    are read by one Python function."""
    patterns = [_strptime(f) for f in formats]

    def one(x: str | None, pattern: str) -> str | None:
        try:
            t = datetime.strptime(x.strip(), pattern)
        except (AttributeError, ValueError):
            return None
        return (t if t.tzinfo is None else t.astimezone(UTC)).strftime("%Y-%m-%d %H:%M:%S.%f")

    @F.pandas_udf("array<array<string>>")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda xs: None if xs is None else [[one(x, p) for x in xs] for p in patterns])

    return read(texts)


def _shape(format: str) -> str | None:
    """A regular expression that every text of a numeric pattern matches; None for a pattern with other letters or with
    options. Each text that isn't a date costs Spark an exception with its stack, many times what a date costs."""
    out = []
    for quoted, letters, _, other in re.findall(r"'([^']*)'|(([A-Za-z])\3*)|(.)", format, re.S):
        if letters:
            if letters[0] not in "yuMdHhkKmsS":
                return None
            if out[-1:] != ["[-+0-9]*"]:
                out.append("[-+0-9]*")
        elif other and other in "[]{}#'":
            return None
        else:
            out += ["." if c.isalpha() or ord(c) > 126 else re.escape(c) for c in quoted or other or "'"]
    return r"(?s)\A" + "".join(out) + r"\z"


def instant(wall: Column, zone: str = "UTC") -> Column:
    """The instant at which a zone's clocks show a time, given as text."""
    return _relabelled(F.try_to_timestamp(wall.cast("string")), zone)


def _relabelled(wall: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall.cast("timestamp_ntz")).cast("timestamp")


def day(t: Column, zone: str = "UTC") -> Column:
    """The start of the day that an instant falls on in a zone."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), t.cast("timestamp_ntz"))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), F.date_trunc("day", local).cast("timestamp_ntz")).cast("timestamp")


def _shift(t: datetime, sign: str | None, n: str | None, unit: str | None) -> datetime:
    if not sign:
        return t
    k = int(n) * (1 if sign == "+" else -1)
    name = _UNITS[unit]
    if name in ("years", "months"):
        return (pd.Timestamp(t) + pd.DateOffset(**{name: k})).to_pydatetime()
    return t + timedelta(**{name: k})


def point(text: str, zone: str = "UTC", now: datetime | None = None) -> tuple[Column, bool]:
    """The instant that a test names, and whether it is a day. NOW and TODAY, each with an offset such as -2D, are fixed
    when the plan is built; a star after them moves with each run of the query. Else a date, with time or without."""
    match = _POINT.fullmatch(text.strip())
    if match:
        base, sign, n, unit, floating = match.groups()
        if floating:
            t = F.current_timestamp()
            t = day(t, zone) if base == "TODAY" else t
            if sign:
                part = {"Y": "years", "M": "months", "D": "days", "h": "hours", "m": "mins", "s": "secs"}[unit]
                t = t + F.make_interval(**{part: F.lit(int(n) * (1 if sign == "+" else -1))})
            return t, base == "TODAY"
        at = (now or datetime.now(UTC)).astimezone(ZoneInfo(zone))
        if base == "TODAY":
            at = at.replace(hour=0, minute=0, second=0, microsecond=0)
        return F.lit(_shift(at, sign, n, unit).astimezone(UTC)), base == "TODAY"
    if text.strip().startswith(("NOW", "TODAY")):
        raise ValueError(f"{text!r}: an offset is a sign, a number and a unit of Y M D h m s")
    for layout in ("%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d"):
        try:
            at = datetime.strptime(text.strip(), layout).replace(tzinfo=ZoneInfo(zone))
        except ValueError:
            continue
        return F.lit(at.astimezone(UTC)), False
    raise ValueError(f"{text!r} is no date")


def write(t: Column, format: str | None, zone: str = "UTC") -> Column:
    """A timestamp as text; without a format, milliseconds since the epoch."""
    if is_epoch(format):
        return F.unix_millis(t).cast("string")
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), t.cast("timestamp_ntz")), format)
