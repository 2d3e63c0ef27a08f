"""Column functions over URLs, paths and path patterns. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENCODED = r'[^\x21-\x7e]|["<>]'


def normalize_path(path: Column) -> Column:
    """A leading `/`, and controls, blanks, `"`, `<`, `>` and all that isn't ASCII percent-encoded; `%` stays. Null stays null."""
    encoded = F.transform(
        F.split(path, ""), lambda c: F.when(c.rlike(_ENCODED), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", r"%$1")).otherwise(c)
    )
    plain = F.when(path.rlike(_ENCODED), F.array_join(encoded, "")).otherwise(path)
    return F.when(plain.startswith("/"), plain).otherwise(F.concat(F.lit("/"), plain))


def url_path(url: Column) -> Column:
    """Path, query and fragment of a URL."""
    return F.regexp_replace(url, r"(?i)^\s*[a-z][a-z0-9+.\-]*://[^/?#]*", "")


def pattern_kind(pattern: Column) -> Column:
    """prefix, ending, universal, both; null for patterns that can't be compiled (a `$` that isn't the last character)."""
    at, star = F.instr(pattern, "$"), pattern.contains("*")
    return (
        F.when((at > 0) & (at < F.length(pattern)), None)
        .when((at > 0) & star, "both").when(at > 0, "ending").when(star, "universal").otherwise("prefix")
    )


def like_pattern(pattern: Column) -> Column:
    """The pattern for LIKE with escape `!`. Null for patterns that can't be compiled."""
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([!%_])", "!$1"), r"\*+", "%")
    return F.when(pattern_kind(pattern).isNotNull(), F.when(pattern.endswith("$"), escaped).otherwise(F.concat(escaped, F.lit("%"))))


def is_universal(pattern: Column) -> Column:
    """Whether a pattern matches every path: `/`, `/*` or `/*$`, runs of stars taken as one."""
    return F.regexp_replace(pattern, r"\*+", "*").isin("/", "/*", "/*$")


def _tidy(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")


def robots_url(url: Column) -> Column:
    """Where a URL's host keeps its robots.txt: scheme, host in lower case and port, without user data. Null on error."""
    tidy = _tidy(url)
    scheme = F.lower(F.regexp_extract(tidy, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    authority = F.regexp_extract(tidy, r"(?i)^https?://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, "^.*@", ""))
    host = F.when(scheme == "http", F.regexp_replace(host, r":0*80$", "")).otherwise(F.regexp_replace(host, r":0*443$", ""))
    host = F.regexp_replace(host, ":$", "")
    ok = robots_url_error(url).isNull()
    return F.when(ok, F.concat(scheme, F.lit("://"), host, F.lit("/robots.txt")))


def robots_url_error(url: Column) -> Column:
    """Url (none at all), CannotBeBase (such as mailto:), WrongScheme, or null."""
    tidy = _tidy(url)
    scheme = F.lower(F.regexp_extract(tidy, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.regexp_replace(F.regexp_extract(tidy, r"(?i)^https?://([^/?#]*)", 1), "^.*@", "")
    return (
        F.when(url.isNull() | (scheme == ""), "Url")
        .when(~scheme.isin("http", "https") & ~tidy.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:/"), "CannotBeBase")
        .when(~scheme.isin("http", "https"), "WrongScheme")
        .when(~host.rlike(r"(?i)^[^\s<>\[\]|\\^%:]+(:[0-9]{0,5})?$"), "Url")
    )


def absolute_url(url: Column) -> Column:
    """An http(s) URL with scheme and host in lower case, no default port, a path and an encoded rest; null if it isn't one."""
    tidy = _tidy(url)
    root = F.regexp_replace(robots_url(url), "/robots[.]txt$", "")
    rest = F.regexp_replace(tidy, r"(?i)^https?://[^/?#]*", "")
    return F.when(root.isNotNull(), F.concat(root, normalize_path(rest)))
