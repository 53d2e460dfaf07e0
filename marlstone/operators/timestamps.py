"""Mixed timestamp texts to UTC microseconds.

Each text is reduced to a mask of character classes of the same length. A mask is
compiled once into a parser (field positions), and all texts of one mask are then
converted together: digits by position arithmetic, names by a lookup of the distinct
spellings, local times by binary search in a zone's transition table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from marlstone.functions.keys import BLANKS

MICRO = 1_000_000
NONE = np.iinfo(np.int64).min

#: English month names (their first three letters decide).
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
MONTH_NAMES = {m: i + 1 for i, m in enumerate(
    "january february march april may june july august september october november december".split())} | MONTHS | {"sept": 9}
DAY_NAMES = {"mon", "tue", "wed", "thu", "fri", "sat", "sun", "tues", "wednes", "thur", "thurs", "satur"} | {
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"}

#: Bare numbers count from 1970 in a unit that the number of their digits tells: up to so many digits, so many per second.
#: So any instant from 1973 to 5138 is read, in seconds, milli-, micro- or nanoseconds; shorter numbers name none.
EPOCH_LEAST_DIGITS = 9
EPOCH_UNITS = ((11, 1), (14, 1_000), (17, 1_000_000), (20, 1_000_000_000))

_TIME = r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?"
_TAIL = (
    r"(?: *(?P<ap>AA)(?![A/]))?"
    r"(?: *(?P<zl>A)(?![A/]))?"
    r"(?: *(?P<zn>A{3,}(?:[/_-]A+)*))?"
    r"(?: *(?P<off>[+-]99(?::?99(?::?99)?)?))?"
    r"(?: *[\[(](?P<zb>A[A/_+9-]*)[\])])?$"
)
_GRAMMARS = {
    "ymd": r"^(?P<Y>9999)(?P<ds>[-/.])(?P<M>99?)(?P=ds)(?P<D>99?)(?:(?: +|(?P<t>A) ?)" + _TIME + ")?" + _TAIL,
    "compact": r"^(?P<Y>9999)(?P<M>99)(?P<D>99)(?:(?P<t>A)| )(?P<h>99)(?P<mi>99)(?:(?P<s>99)(?:[.,](?P<f>9+))?)?" + _TAIL,
    "numeric": r"^(?P<p>99?)(?P<ds>[/.-])(?P<q>99?)(?P=ds)(?P<Y>9999)(?:,? +" + _TIME + ")?" + _TAIL,
    "dmy_name": r"^(?:(?P<wd>A{3,9}),? +)?(?P<D>99?)[ -](?P<mon>A{3,9})\.?,?[ -](?P<Y>9999)(?:,? +" + _TIME + ")?" + _TAIL,
    "mdy_name": r"^(?:(?P<wd>A{3,9}),? +)?(?P<mon>A{3,9})\.? +(?P<D>99?),? +(?P<Y>9999)(?:,? +" + _TIME + ")?" + _TAIL,
    "epoch": r"^(?P<n>9{9,20})(?:\.(?P<f>9+))?$",
}
_COMPILED = {k: re.compile(v) for k, v in _GRAMMARS.items()}


class _Classes(dict):
    def __missing__(self, c: int) -> str:
        ch = chr(c)
        out = "A" if ch.isalpha() else ch
        self[c] = out
        return out


_CLASSES = _Classes({ord(c): "9" for c in "0123456789"})
_SPELL = {ord(c): " " for c in BLANKS} | {0x2212: "-", 0x2010: "-", 0x2011: "-", 0x2013: "-"}


def shape_mask(text: str) -> str:
    """Mask of the same length: 9 for digits, A for letters, the character itself otherwise."""
    return text.translate(_CLASSES)


@lru_cache(maxsize=65536)
def parser_of(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """The grammar that a mask fits and the place of each field in it; None where none fits."""
    for name, pattern in _COMPILED.items():
        m = pattern.match(mask)
        if m:
            return name, {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


def tz_version() -> str:
    """Version of the zone data that the transition tables were built from."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except Exception:
        return "system"


@lru_cache(maxsize=1024)
def zone_table(zone: str) -> tuple[np.ndarray, np.ndarray, dict[str, int]] | None:
    """Transition table of an IANA zone over 1900 to 2100, None for an unknown name.

    Returns thresholds (local microseconds from which the next offset holds), offsets in
    seconds (one more than thresholds) and the zone's abbreviations since 1970. The
    threshold of a change is its instant plus the larger of both offsets: a local time that
    occurs twice then takes the earlier offset, and a skipped one moves forward by the gap.
    """
    from zoneinfo import ZoneInfo

    try:
        z = ZoneInfo(zone)
    except Exception:
        return None
    utc = timezone.utc
    start, end, step = datetime(1900, 1, 1, tzinfo=utc), datetime(2100, 1, 1, tzinfo=utc), timedelta(days=7)

    def look(t: datetime) -> tuple[int, str]:
        at = t.astimezone(z)
        return int(at.utcoffset().total_seconds()), at.tzname()

    thresholds, t, (off, abbr) = [], start, look(start)
    offsets, names = [off], {}
    while t < end:
        nxt = t + step
        o2, a2 = look(nxt)
        if (o2, a2) != (off, abbr):
            lo, hi = t, nxt
            while hi - lo > timedelta(seconds=1):
                mid = lo + (hi - lo) / 2
                mid = mid.replace(microsecond=0)
                if mid == lo:
                    break
                lo, hi = (mid, hi) if look(mid) == (off, abbr) else (lo, mid)
            if o2 != off:
                thresholds.append((int(hi.timestamp()) + max(off, o2)) * MICRO)
                offsets.append(o2)
            off, abbr = o2, a2
        if nxt.year >= 1970 and abbr[:1].isalpha():
            names[abbr.upper()] = off
        t = nxt
    return np.array(thresholds, dtype=np.int64), np.array(offsets, dtype=np.int64), names


def abbreviations(zones: Iterable[str]) -> dict[str, int]:
    """Offsets in seconds of the zones' abbreviations; one that two zones use differently is left out."""
    seen: dict[str, set[int]] = {}
    for zone in sorted({z for z in zones if z}):
        t = zone_table(zone)
        for name, off in (t[2] if t else {}).items():
            seen.setdefault(name, set()).add(off)
    return {k: next(iter(v)) for k, v in seen.items() if len(v) == 1} | {"UTC": 0, "GMT": 0, "UT": 0}


def _digits(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    a, b = span
    out = np.zeros(len(codes), dtype=np.int64)
    for i in range(a, b):
        out = out * 10 + (codes[:, i].astype(np.int64) - 48)
    return out


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970 of a civil date (proleptic Gregorian)."""
    y = y - (m <= 2)
    era = np.floor_divide(y, 400)
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    doe = yoe * 365 + yoe // 4 - yoe // 100 + doy
    return era * 146097 + doe - 719468


_LENGTHS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def _real_date(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    inside = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return inside & (d <= _LENGTHS[np.where(inside, m, 1)] + ((m == 2) & leap))


def _named(texts: np.ndarray, span: tuple[int, int], of) -> np.ndarray:
    """of(distinct spelling) for each text; NONE where it gives None."""
    a, b = span
    part = np.array([t[a:b] for t in texts])
    distinct, inverse = np.unique(part, return_inverse=True)
    values = [of(str(x)) for x in distinct]
    return np.array([NONE if v is None else v for v in values], dtype=np.int64)[inverse]


def _local_to_utc(local: np.ndarray, zones: np.ndarray) -> np.ndarray:
    out = np.full(len(local), NONE, dtype=np.int64)
    for zone in set(zones.tolist()):
        at = zones == zone
        t = zone_table(zone)
        if t is not None:
            out[at] = local[at] - t[1][np.searchsorted(t[0], local[at], side="right")] * MICRO
    return out


def _convert(texts: np.ndarray, mask: str, zones: np.ndarray, day_first: np.ndarray, abbr: dict[str, int]) -> np.ndarray:
    """UTC microseconds of texts that share a mask; NONE where they name no instant."""
    n = len(texts)
    found = parser_of(mask)
    if found is None:
        return np.full(n, NONE, dtype=np.int64)
    kind, at = found
    codes = np.array(texts, dtype=f"U{len(mask)}").view(np.uint32).reshape(n, len(mask))
    num = lambda k, default=0: _digits(codes, at[k]) if k in at else np.full(n, default, dtype=np.int64)
    micros = np.zeros(n, dtype=np.int64)
    if "f" in at:
        a, b = at["f"]
        b = min(b, a + 6)
        micros = _digits(codes, (a, b)) * 10 ** (6 - (b - a))
    if kind == "epoch":
        return _epoch(texts, at)
    good = np.ones(n, dtype=bool)
    y = num("Y")
    if kind == "numeric":
        p, q = num("p"), num("q")
        dmy, mdy = _real_date(y, q, p), _real_date(y, p, q)
        dotted = mask[at["ds"][0]] == "."
        known = np.array([x is True or x is False for x in day_first])
        first = np.array([x is True for x in day_first])
        # without a known habit: dots mean day first, else only one order may be a date
        first = np.where(known, first, dotted | (dmy & ~mdy))
        good &= known | dotted | (dmy != mdy) | (dmy & mdy & (p == q))
        m, d = np.where(first, q, p), np.where(first, p, q)
    else:
        d = num("D")
        m = _named(texts, at["mon"], lambda s: MONTH_NAMES.get(s.lower())) if "mon" in at else num("M")
        if "wd" in at:
            good &= _named(texts, at["wd"], lambda s: 1 if s.lower() in DAY_NAMES else None) != NONE
    good &= _real_date(y, m, d)
    if "t" in at:
        good &= _named(texts, at["t"], lambda s: 1 if s in "Tt" else None) != NONE
    h, mi, s = num("h"), num("mi"), num("s")
    if "ap" in at:
        ap = _named(texts, at["ap"], lambda s: {"AM": 0, "PM": 12}.get(s.upper()))
        good &= (ap != NONE) & (h >= 1) & (h <= 12)
        h = h % 12 + np.where(ap == 12, 12, 0)
    good &= (h <= 23) & (mi <= 59) & (s <= 59)
    m, d = np.where(good, m, 1), np.where(good, d, 1)
    local = (_days(y, m, d) * 86400 + h * 3600 + mi * 60 + s) * MICRO + micros
    if "zl" in at:
        good &= _named(texts, at["zl"], lambda s: 1 if s in "Zz" else None) != NONE
    if "off" in at:
        def offset(s: str) -> int | None:
            x = s[1:].replace(":", "").ljust(6, "0")
            hh, mm, ss = int(x[:2]), int(x[2:4]), int(x[4:6])
            return None if hh > 18 or mm > 59 or ss > 59 else (hh * 3600 + mm * 60 + ss) * (-1 if s[0] == "-" else 1)

        off = _named(texts, at["off"], offset)
        good &= off != NONE
        utc = local - np.where(good, off, 0) * MICRO
    elif "zl" in at:
        utc = local
    elif "zb" in at or "zn" in at:
        a, b = at["zb" if "zb" in at else "zn"]
        names = np.array([t[a:b] for t in texts], dtype=object)
        fixed = np.array([abbr.get(x.upper(), NONE) if "/" not in x else NONE for x in names], dtype=np.int64)
        utc = np.where(fixed != NONE, local - np.where(fixed != NONE, fixed, 0) * MICRO, NONE)
        rest = fixed == NONE
        if rest.any():
            utc[rest] = _local_to_utc(local[rest], names[rest])
    else:
        utc = _local_to_utc(local, zones)
    return np.where(good, utc, NONE)


def _epoch(texts: np.ndarray, at: dict[str, tuple[int, int]]) -> np.ndarray:
    a, b = at["n"]
    unit = next(u for digits, u in EPOCH_UNITS if b - a <= digits)
    out = []
    for t in texts:
        frac = t[at["f"][0]: at["f"][1]] if "f" in at else ""
        out.append(int(t[a:b] + (frac + "000000")[:6]) // unit)  # from millionths of the unit
    return np.array(out, dtype=np.int64)


def to_utc_micros(texts: pd.Series, zones: pd.Series, day_first: pd.Series, abbr: dict[str, int]) -> np.ndarray:
    """UTC microseconds of each text, NONE where it names no instant (numpy in, numpy out)."""
    out = np.full(len(texts), NONE, dtype=np.int64)
    groups: dict[str, list[int]] = {}
    clean: list[str] = []
    for i, t in enumerate(texts.tolist()):
        t = t.translate(_SPELL).strip() if isinstance(t, str) else ""
        clean.append(t)
        if t:
            groups.setdefault(shape_mask(t), []).append(i)
    every = np.array(clean, dtype=object)
    zone = np.array([z if isinstance(z, str) and z else "UTC" for z in zones.tolist()], dtype=object)
    first = np.array([None if x is None or x != x else bool(x) for x in day_first.tolist()], dtype=object)
    for mask, rows in groups.items():
        at = np.array(rows)
        out[at] = _convert(every[at], mask, zone[at], first[at], abbr)
    return out


def utc_micros(text: Column, zone: Column, day_first: Column, zones: Iterable[str]) -> Column:
    """Column of UTC microseconds; null where the text is null, empty or names no instant.

    ``zone`` is the zone of texts without one (null: UTC), ``day_first`` tells numeric dates
    (null: dots mean day first, slashes count only if one order gives a date), ``zones`` are
    those whose abbreviations are understood.
    """
    abbr = abbreviations(zones)

    @F.pandas_udf(LongType())
    def convert(texts: pd.Series, zone_ids: pd.Series, first: pd.Series) -> pd.Series:
        found = to_utc_micros(texts, zone_ids, first, abbr)
        return pd.Series(found, dtype="Int64").mask(found == NONE)

    # marked so, else a filter on the result is pushed down and parses every text twice
    return convert.asNondeterministic()(text, zone, day_first)


def with_utc_micros(df: DataFrame, text: str, writer: Column, writers: DataFrame, name: str = "utc_us") -> DataFrame:
    """df with a column of UTC microseconds, read by the habits of each row's writer.

    ``writers`` is the table of writers (writer, zone_id, day_first), fixed in size; it is
    joined, and its zone names are gathered for the abbreviations (at most 4096).
    A writer that is null or not in the table counts as UTC without a habit.
    """
    habits = writers.where(F.col("writer").isNotNull()).groupBy(F.col("writer").alias("_writer")).agg(
        F.min("zone_id").alias("_zone"), F.min("day_first").alias("_first"))
    zones = [r[0] for r in writers.select("zone_id").where("zone_id is not null").distinct().limit(4097).collect()]
    if len(zones) > 4096:
        raise ValueError("more than 4096 zones in the table of writers")
    joined = df.withColumn("_w", writer).join(habits, F.col("_w") == F.col("_writer"), "left")
    return joined.withColumn(name, utc_micros(F.col(text), F.col("_zone"), F.col("_first"), zones)).drop(
        "_w", "_writer", "_zone", "_first")
