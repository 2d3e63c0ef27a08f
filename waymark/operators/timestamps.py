"""Timestamps of mixed notation, precision and zone, brought to microseconds since 1970 in UTC.

How it works: each text is reduced to a shape mask (digit -> 9, letter -> A, white space -> blank, anything else
stays). A mask is matched against the grammar once per worker and compiled to character positions. All texts of a
batch that share a mask become one code point matrix, and fields, checks, calendar arithmetic and zone look-ups are
array operations over it. Zones are resolved through a transition table that the driver builds once, stamps with the
version of its zone data and ships to all executors, so that no two executors can disagree.

Results for unusual input: null, empty, relative or unknown text gives null; so do dates and times that don't exist,
clock times that a zone skips, unknown zone names, a missing zone where the text needs one, and a missing day order
where the text needs one. A clock time that occurs twice is the earlier instant. Texts may be of any length: fractions
are cut to microseconds before masks are made, and no other part of a notation can be long.
"""

from __future__ import annotations

import functools
import importlib.resources
import io
import os
import re
import struct
import zoneinfo
from collections.abc import Callable
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEPT_MASKS, _KEPT_LENGTH = 20_000, 200  # masks that a worker remembers, and how long one of them may be

# Usual offsets of zone abbreviations, in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "met": 60, "mest": 120,
    "eet": 120, "eest": 180, "msk": 180, "wat": 60, "cat": 120, "sast": 120, "eat": 180, "pkt": 300, "ist": 330, "npt": 345,
    "sgt": 480, "hkt": 480, "awst": 480, "jst": 540, "kst": 540, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660,
    "nzst": 720, "nzdt": 780, "ast": -240, "adt": -180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420,
    "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]

_OFF = r" ?(?P<sign>[+\-−])(?P<oh>99)(?::?(?P<om>99))?"
_NAME = r" ?(?P<zone>A[A/_+\-9]*)"
_BRACKET = r" ?\[(?P<bracket>A[A/_+\-9]*)\]"
_ZONE = f"(?:(?:{_OFF}|{_NAME})?(?:{_BRACKET})?)"
_CLOCK = r"(?P<H>99?):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?"
_HALF = r"(?: ?(?P<half>AA)(?!A))?"

#: name -> expression over masks. Groups name the fields; the name decides how the date is read.
GRAMMAR = {
    name: re.compile(text)
    for name, text in {
        "ymd": rf"(?P<Y>9999)-(?P<m>99)-(?P<d>99)(?:(?P<t>[A _]){_CLOCK}{_ZONE})?",
        "ymd_basic": rf"(?P<Y>9999)(?P<m>99)(?P<d>99)(?P<t>A)(?P<H>99)(?P<M>99)(?:(?P<S>99)(?:[.,](?P<f>9+))?)?{_ZONE}",
        "ymd_digits": r"(?P<Y>9999)(?P<m>99)(?P<d>99)(?:(?P<H>99)(?P<M>99)(?P<S>99)?)?",
        "ymd_slash": rf"(?P<Y>9999)/(?P<m>99?)/(?P<d>99?)(?: {_CLOCK}{_HALF}{_ZONE})?",
        "slash": rf"(?P<p>99?)/(?P<q>99?)/(?P<Y>9999|99)(?:,? {_CLOCK}{_HALF}{_ZONE})?",
        "dot": rf"(?P<d>99?)\.(?P<m>99?)\.(?P<Y>9999|99)(?:,? {_CLOCK}{_HALF}{_ZONE})?",
        "day_month": rf"(?:(?P<w>A{{3,9}}),? )?(?P<d>99?)(?P<j>[ \-])(?P<b>A{{3,9}})\.?(?P<k>[ \-])(?P<Y>9999|99)(?:,? {_CLOCK}{_HALF}{_ZONE})?",
        "month_day": rf"(?:(?P<w>A{{3,9}}),? )?(?P<b>A{{3,9}})\.? (?P<d>99?),? (?P<Y>9999)(?:,? {_CLOCK}{_HALF}{_ZONE})?",
        "ctime": rf"(?P<w>A{{3,9}}),? (?P<b>A{{3,9}})  ?(?P<d>99?) {_CLOCK}(?:{_OFF}|{_NAME})? (?P<Y>9999)",
        "month": r"(?P<Y>9999)-(?P<m>99)",
        "year": r"(?P<Y>9999)",
        "ordinal": rf"(?P<Y>9999)-(?P<o>999)(?:(?P<t>[A _]){_CLOCK}{_ZONE})?",
        "week": rf"(?P<Y>9999)-?(?P<W>A)(?P<wk>99)(?:-?(?P<wd>9))?(?:(?P<t>[A _]){_CLOCK}{_ZONE})?",
        "epoch": r"(?P<s>9{9,11})(?:\.(?P<f>9+))?",
        "epoch_ms": r"(?P<s>9{10})(?P<f>999)",
        "epoch_us": r"(?P<s>9{10})(?P<f>999999)",
        "epoch_ns": r"(?P<s>9{10})(?P<f>999999999)",
    }.items()
}


def parser_of(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """The notation and field positions that a mask stands for; None if no notation has it."""
    return (_kept_parser if len(mask) <= _KEPT_LENGTH else _parser)(mask)


def _parser(mask: str) -> tuple[str, dict[str, tuple[int, int]]] | None:
    for name, expression in GRAMMAR.items():
        if match := expression.fullmatch(mask):
            return name, {k: match.span(k) for k, v in match.groupdict().items() if v is not None}
    return None


_kept_parser = functools.lru_cache(_KEPT_MASKS)(_parser)


def tidied(text: Column) -> Column:
    """Without outer white space, and without digits beyond the sixth of a fraction: after a point or comma no notation has
    more than four digits otherwise."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), "([.,][0-9]{6})[0-9]+", "$1")


def mask_of(text: Column) -> Column:
    """The shape mask, made inside the JVM. Letters and white space are those of Unicode, digits those of ASCII."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), r"\p{L}", "A"), r"(?U)\s", " ")


# ---------------------------------------------------------------------------------------------- zones


class ZoneTable:
    """Transitions of every zone up to LAST: UTC seconds at which an offset (seconds) begins to hold.

    Rules depend only on a year's first weekday and length: later years are read as their like in the last 28 years of the
    table before 2129, in which each kind of year occurs (and the dates that some zones list one by one are over).

    About 600 zones with at most a few hundred transitions each: some megabytes, whatever the size of the data."""

    LAST = 2130
    _LIKE = np.arange(2101 - 1970, 2129 - 1970).astype("datetime64[Y]")

    def __init__(self, version: str, zones: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.version, self.zones = version, zones
        self.folded = {k.lower(): k for k in zones}

    @classmethod
    def build(cls) -> ZoneTable:
        version, names, read = zone_source()
        return cls(version, {name: _transitions(name, read(name)) for name in names})

    def find(self, name: str) -> tuple[np.ndarray, np.ndarray] | None:
        key = name if name in self.zones else self.folded.get(name.lower())
        return None if key is None else self.zones[key]

    def to_utc(self, name: str, local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTC seconds of clock seconds, and which of them exist. Of two instants the earlier one."""
        found = self.find(name)
        if found is None:
            return local, np.zeros(len(local), bool)
        starts, offsets = found
        shift = self._shift(local)
        local = local - shift
        ends = np.append(starts[1:], np.iinfo(np.int64).max)
        at = np.searchsorted(starts, local, "right") - 1
        best, known = np.full(len(local), np.iinfo(np.int64).max), np.zeros(len(local), bool)
        for step in (-1, 0, 1):
            k = np.clip(at + step, 0, len(starts) - 1)
            utc = local - offsets[k]
            good = (utc >= starts[k]) & (utc < ends[k])
            best, known = np.where(good, np.minimum(best, utc), best), known | good
        return np.where(known, best + np.where(known, shift, 0), best), known

    @classmethod
    def _shift(cls, local: np.ndarray) -> np.ndarray:
        """Seconds from the like of each clock time's year to that year: 0 up to 2128."""
        out = np.zeros(len(local), np.int64)
        late = local >= (datetime(2129, 1, 1) - datetime(1970, 1, 1)).days * 86400
        if late.any():
            years = local[late].astype("datetime64[s]").astype("datetime64[Y]")
            day = lambda y: y.astype("datetime64[D]").astype(np.int64)
            sort = lambda y: day(y) % 7 * 2 + (day(y + 1) - day(y) == 366)
            like = np.zeros(14, np.int64)
            like[sort(cls._LIKE)] = day(cls._LIKE)
            out[late] = (day(years) - like[sort(years)]) * 86400
        return out


def _written_version(folder: str) -> str | None:
    """The release that a folder of zone files says it is."""
    for name, pattern in (("tzdata.zi", r"# version (\S+)"), ("+VERSION", r"(\S+)"), ("version", r"(\S+)")):
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                if match := re.match(pattern, f.readline()):
                    return match[1]
    return None


def zone_source() -> tuple[str, list[str], Callable[[str], bytes]]:
    """Version, zone names and reader of one release: the first folder of the system's that names its release, or the package."""
    for folder in zoneinfo.TZPATH:
        if version := _written_version(folder):
            path = lambda name, folder=folder: os.path.join(folder, *name.split("/"))
            names = sorted(n for n in zoneinfo.available_timezones() if os.path.isfile(path(n)))

            def read(name: str) -> bytes:
                with open(path(name), "rb") as f:
                    return f.read()

            if names:
                return version, names, read
    root = importlib.resources.files("tzdata")
    names = (root / "zones").read_text(encoding="utf-8").split()
    import tzdata

    return tzdata.IANA_VERSION, sorted(names), lambda name: root.joinpath("zoneinfo", *name.split("/")).read_bytes()


def _transitions(name: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Those listed in the zone's file, then, where its last rule has summer time, those up to LAST."""
    at = 0
    for width in (4, 8):  # the second part of the file repeats the first in 64 bits
        isutc, isstd, leap, times, types, chars = struct.unpack(">6l", data[at + 20 : at + 44])
        at += 44
        starts = np.frombuffer(data, f">i{width}", times, at).astype(np.int64)
        at += width * times
        kinds = np.frombuffer(data, np.uint8, times, at)
        at += times
        offsets = [struct.unpack(">l", data[at + 6 * i : at + 6 * i + 4])[0] for i in range(types)]
        dst = [data[at + 6 * i + 4] for i in range(types)]
        at += 6 * types + chars + leap * (width + 4) + isstd + isutc
    first = next((i for i in range(types) if not dst[i]), 0) if times and types > 1 else 0
    starts = np.append(np.int64(-(1 << 60)), starts)
    held = np.append(np.int64(offsets[first]), np.array(offsets, np.int64)[kinds] if times else np.zeros(0, np.int64))
    if b"," in data[at:]:
        zone, epoch = zoneinfo.ZoneInfo.from_file(io.BytesIO(data), name), datetime(1970, 1, 1)

        def offset(seconds: int) -> int:
            utc = (epoch + timedelta(seconds=seconds)).replace(tzinfo=zone)
            return round((zone.fromutc(utc).replace(tzinfo=None) - utc.replace(tzinfo=None)).total_seconds())

        more, after, low = [], [], max(int(starts[-1]), 0)
        last = (datetime(ZoneTable.LAST, 1, 1) - epoch).days * 86400
        now = int(held[-1])
        while low < last:
            high = low + 20 * 86400
            if (new := offset(high)) != now:
                a, b = low, high
                while b - a > 1:
                    c = (a + b) // 2
                    a, b = (c, b) if offset(c) == now else (a, c)
                more.append(b)
                after.append(new)
                now = new
            low = high
        starts, held = np.append(starts, np.array(more, np.int64)), np.append(held, np.array(after, np.int64))
    return starts, held


@functools.lru_cache(1)
def zone_table() -> ZoneTable:
    return ZoneTable.build()


# ---------------------------------------------------------------------------------------------- conversion


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970 of proleptic Gregorian dates."""
    months = (y - 1970) * 12 + (m - 1)
    return months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1


def _month_length(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 1, 12) - 1] + ((m == 2) & leap)


def _of_words(words: np.ndarray, table: dict[str, int]) -> np.ndarray:
    """Each distinct word is looked up once."""
    distinct, back = np.unique(words, return_inverse=True)
    return np.array([table.get(str(w).lower(), -1) for w in distinct], np.int64)[back]


_MONTH_NUMBERS = {w: i for i, m in enumerate(MONTHS, 1) for w in (m, m[:3])} | {"sept": 9}
_WEEKDAY_NUMBERS = {w: i for i, d in enumerate(WEEKDAYS) for w in (d, d[:3])} | {"tues": 1, "thur": 3, "thurs": 3}


def convert(mask: str, texts: list[str], zones: np.ndarray, day_first: np.ndarray, table: ZoneTable) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds of texts that share a mask, and which of them denote an instant."""
    n = len(texts)
    none = np.zeros(n, np.int64), np.zeros(n, bool)
    parser = parser_of(mask)
    if parser is None:
        return none
    kind, at = parser
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(n, len(mask))

    def number(name: str) -> np.ndarray:
        a, b = at[name]
        return (chars[:, a:b].astype(np.int64) - 48) @ (10 ** np.arange(b - a - 1, -1, -1, dtype=np.int64))

    def words(name: str) -> np.ndarray:
        a, b = at[name]
        return np.ascontiguousarray(chars[:, a:b]).view(f"<U{b - a}").ravel()

    def is_in(name: str, letters: str) -> np.ndarray:
        return np.isin(chars[:, at[name][0]], [ord(c) for c in letters])

    ok, zero = np.ones(n, bool), np.zeros(n, np.int64)
    micros = zero
    if "f" in at:
        a, b = at["f"]
        b = min(b, a + 6)
        micros = ((chars[:, a:b].astype(np.int64) - 48) @ (10 ** np.arange(b - a - 1, -1, -1, dtype=np.int64))) * 10 ** (6 - (b - a))
    if kind.startswith("epoch"):
        return number("s") * 1_000_000 + micros, ok

    y = number("Y")
    if at["Y"][1] - at["Y"][0] == 2:
        y = y + 2000
    if kind == "ordinal":
        o = number("o")
        day = _days(y, zero + 1, o)
        ok &= (o >= 1) & (o <= 337 + _month_length(y, zero + 2))
    elif kind == "week":
        wk, wd = number("wk"), number("wd") if "wd" in at else zero + 1
        fourth = _days(y, zero + 1, zero + 4)
        monday = fourth - (fourth + 3) % 7
        after = _days(y + 1, zero + 1, zero + 4)
        day = monday + (wk - 1) * 7 + wd - 1
        ok &= is_in("W", "Ww") & (wk >= 1) & (monday + (wk - 1) * 7 < after - (after + 3) % 7) & (wd >= 1) & (wd <= 7)
    else:
        d = number("d") if "d" in at else zero + 1
        if kind == "slash":
            p, q = number("p"), number("q")
            first = day_first == 1
            d, m = np.where(first, p, q), np.where(first, q, p)
            ok &= day_first >= 0
        elif "b" in at:
            m = _of_words(words("b"), _MONTH_NUMBERS)
        else:
            m = number("m") if "m" in at else zero + 1
        ok &= (m >= 1) & (m <= 12) & (d >= 1) & (d <= _month_length(y, m))
        day = _days(y, np.clip(m, 1, 12), d)
    ok &= y >= 1
    if "w" in at:
        ok &= _of_words(words("w"), _WEEKDAY_NUMBERS) >= 0
    if "j" in at:
        ok &= chars[:, at["j"][0]] == chars[:, at["k"][0]]
    if "t" in at:
        ok &= is_in("t", "Tt _")
    if "H" not in at:
        return day * 86_400_000_000, ok

    hour, minute, second = number("H"), number("M"), number("S") if "S" in at else zero
    if "half" in at:
        half = _of_words(words("half"), {"am": 0, "pm": 12})
        ok &= (half >= 0) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + half
    ok &= (hour < 24) & (minute < 60) & (second < 60)
    local = day * 86400 + hour * 3600 + minute * 60 + second

    named = np.full(n, None, object)  # the zone whose clock it is; None: the offset holds
    offset = zero
    if "sign" in at:
        oh, om = number("oh"), number("om") if "om" in at else zero
        ok &= (oh < 24) & (om < 60)
        offset = np.where(is_in("sign", "+"), 1, -1) * (oh * 60 + om)
        if "bracket" in at:
            ok &= np.array([w.lower() in ABBREVIATIONS or table.find(w) is not None for w in words("bracket")], bool)
    elif "zone" in at or "bracket" in at:
        name = words("zone" if "zone" in at else "bracket")
        distinct, back = np.unique(name, return_inverse=True)
        minutes = np.array([ABBREVIATIONS.get(str(w).lower(), 1 << 20) for w in distinct], np.int64)[back]
        offset = np.where(minutes < 1 << 20, minutes, 0)
        named = np.where(minutes < 1 << 20, None, name.astype(object))
    else:
        named = np.array(zones, object)
        ok &= np.array([z is not None for z in named], bool)
    utc = local - offset * 60
    codes, names = pd.factorize(named)  # -1 where no zone's clock is meant
    for i, zone in enumerate(names):
        rows = np.flatnonzero(codes == i)
        utc[rows], good = table.to_utc(str(zone), local[rows])
        ok[rows] &= good
    return np.where(ok, utc, 0) * 1_000_000 + micros, ok


def utc_micros(texts: pd.Series, masks: pd.Series, zones: pd.Series, day_first: pd.Series, table: ZoneTable) -> pd.Series:
    """A batch: one conversion for each distinct mask in it."""
    out = pd.array([pd.NA] * len(texts), dtype="Int64")
    text, zone = texts.to_numpy(object), np.array([z if isinstance(z, str) else None for z in zones], object)
    order = np.array([1 if v is True or v == 1 else 0 if v is False or v == 0 else -1 for v in day_first], np.int64)
    codes, shapes = pd.factorize(masks)
    sort = np.argsort(codes, kind="stable")
    bounds = np.searchsorted(codes[sort], np.arange(len(shapes) + 1))
    for i, mask in enumerate(shapes):
        rows = sort[bounds[i] : bounds[i + 1]]
        if parser_of(mask) is None:
            continue
        values, ok = convert(mask, list(text[rows]), zone[rows], order[rows], table)
        out[rows[ok]] = values[ok]
    return pd.Series(out)


def with_utc_micros(df: DataFrame, text: str, zone: str, day_first: str, out: str = "utc_us", table: ZoneTable | None = None) -> DataFrame:
    """df with column `out`: the instant that `text` denotes, as microseconds since 1970 in UTC, finer digits cut off.

    zone and day_first name the columns with the clock's zone and the order of numeric dates of each row's sender. An
    existing column of the name `out` is replaced; all other columns are kept as they are. The column's metadata name the
    release of the zone data (zone_data) that all executors used."""
    held = table or zone_table()
    shipped = df.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("long")
    def instants(t: pd.Series, m: pd.Series, z: pd.Series, f: pd.Series) -> pd.Series:
        return utc_micros(t, m, z, f, shipped.value)

    # Tidying and masking happen in the JVM. Called non-deterministic so that a filter on the result doesn't repeat it.
    instants = instants.asNondeterministic()
    found = instants(tidied(F.col(text)), mask_of(tidied(F.col(text))), F.col(zone), F.col(day_first))
    return df.withColumn(out, found.alias(out, metadata={"zone_data": held.version}))
