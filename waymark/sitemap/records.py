"""Column functions over sitemap records: change frequency, priority, modification time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD_LIMIT, BYTE_LIMIT = 50_000, 52_428_800
ENTRY = "loc string, lastmod timestamp, lastmod_offset_min int, priority float, changefreq string"
INDEX = "loc string, lastmod timestamp, lastmod_offset_min int"

# The change frequencies, and the length of each in hours (months and years have a fixed length).
FREQUENCIES = {"always": None, "hourly": 1, "daily": 24, "weekly": 168, "monthly": 720, "yearly": 8760, "never": None}
# The priorities that have a name; one that isn't given is the average one.
LEAST_PRIORITY, AVERAGE_PRIORITY, MOST_PRIORITY = 0.0, 0.5, 1.0
_TRIM = r"(?U)^\s+|\s+$"


def entry(loc: Column, modified: Column | None = None, offset_min: Column | None = None, priority: Column | None = None, changefreq: Column | None = None) -> Column:
    """struct of the columns of ENTRY; what isn't given is null. Null if loc is."""
    given = {"loc": loc, "lastmod": modified, "lastmod_offset_min": offset_min, "priority": priority, "changefreq": changefreq}
    return _record(ENTRY, given)


def index(loc: Column, modified: Column | None = None, offset_min: Column | None = None) -> Column:
    """struct of the columns of INDEX; what isn't given is null. Null if loc is."""
    return _record(INDEX, {"loc": loc, "lastmod": modified, "lastmod_offset_min": offset_min})


def _record(schema: str, given: dict) -> Column:
    fields = [f.split() for f in schema.split(", ")]
    values = [(F.lit(None) if given[n] is None else given[n]).cast(t).alias(n) for n, t in fields]
    return F.when(given["loc"].isNotNull(), F.struct(*values))


def effective_priority(value: Column) -> Column:
    """The value if it is a valid priority, else the average one."""
    return F.coalesce(priority(value), F.lit(AVERAGE_PRIORITY).cast("float"))


def frequency(text: Column) -> Column:
    """One of the seven frequencies in lower case, or null."""
    name = F.lower(F.regexp_replace(text, _TRIM, ""))
    return F.when(name.isin(list(FREQUENCIES)), name)


def next_date(freq: Column, date: Column) -> Column:
    """When a record is due again; null for `always` and `never`."""
    hours = F.lit(None).cast("int")
    for name, h in FREQUENCIES.items():
        if h is not None:
            hours = F.when(freq == name, F.lit(h)).otherwise(hours)
    return date + F.make_dt_interval(hours=hours)


def is_outdated(freq: Column, date: Column, now: Column) -> Column:
    return F.when(freq == "always", True).when(freq == "never", False).otherwise(next_date(freq, date) <= now)


def priority(value: Column) -> Column:
    """The value if it is from 0 to 1, else null (NaN too)."""
    return F.when(~F.isnan(value) & value.between(0.0, 1.0), value)


def clamped_priority(value: Column) -> Column:
    """The nearest value from 0 to 1; NaN becomes 0, null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(F.nanvl(value, F.lit(0.0).cast("float")), F.lit(0.0).cast("float")), F.lit(1.0).cast("float")))


def parsed_priority(text: Column) -> Column:
    """A decimal number from 0 to 1 without blanks around it, as a float; else null."""
    return priority(F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("float")))


def priority_text(value: Column) -> Column:
    """With one decimal."""
    return F.format_number(value, 1)


_LASTMOD = r"^(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d(?::\d\d(?:\.\d{1,9})?)?)(Z|[+-]\d\d:?\d\d))?$"


def lastmod(text: Column, strict: bool = False) -> tuple[Column, Column]:
    """Instant and offset in minutes of a modification time. A date alone is midnight UTC, or null if strict."""
    day, clock, zone = (F.regexp_extract(text, _LASTMOD, i) for i in (1, 2, 3))
    clock = F.when(clock == "", "00:00:00").when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(F.substring(clock, 1, 15))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.when(zone.isin("", "Z"), 0).otherwise(sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")))
    found = text.rlike(_LASTMOD) & ((zone != "") if strict else F.lit(True))
    local = F.try_to_timestamp(F.when(found, F.concat(day, F.lit(" "), clock, F.lit("Z"))))
    instant = local - F.make_dt_interval(mins=minutes)
    return instant, F.when(instant.isNotNull(), minutes.cast("int"))


def lastmod_text(instant: Column, offset_min: Column) -> Column:
    """ISO 8601 with two decimals, in the zone of the offset (UTC where that is null)."""
    minutes = F.coalesce(offset_min, F.lit(0))
    shown = F.date_format(instant + F.make_dt_interval(mins=minutes), "yyyy-MM-dd'T'HH:mm:ss.SS")
    sign = F.when(minutes < 0, "-").otherwise("+")
    hour, minute = (F.lpad(x.cast("string"), 2, "0") for x in (F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60))
    zone = F.when(minutes == 0, "Z").otherwise(F.concat(sign, hour, F.lit(":"), minute))
    return F.concat(shown, zone)


def escape(text: Column) -> Column:
    """Text for XML."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&apos;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text
