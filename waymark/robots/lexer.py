"""Robots documents as rows of directives.

Text is handled as Latin-1, one character a byte, so that no byte sequence can fail; each value is then read as UTF-8 and
is null where it isn't valid. Content over LIMIT bytes isn't read. Null content has no directives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 512_000

# The spellings of each directive that are understood.
SPELLINGS = {
    "user-agent": ["user-agent", "user agent", "useragent"],
    "allow": ["allow", "alow", "allaw"],
    "disallow": ["disallow", "dissallow", "dissalow", "disalow", "diasllow", "disallaw"],
    "crawl-delay": ["crawl-delay", "crawl delay", "crawldelay"],
    "sitemap": ["sitemap", "site-map", "site map"],
}
_KEYS = "|".join(s for spellings in SPELLINGS.values() for s in spellings)
_LINE = rf"(?i)^[ \t]*({_KEYS})(?:[ \t]*:|[ \t]+)([^#]*)"


def lines(content: Column) -> Column:
    """The lines of a document as an array: cut at the limit, zero bytes as line ends, without a byte order mark."""
    text = F.decode(F.substring(content, 1, LIMIT), "ISO-8859-1")
    text = F.regexp_replace(F.translate(text, "\0", "\n"), "^ï?»?¿?", "")
    text = F.regexp_replace(text, r"(?:\r*\n|\r+)\z", "")
    return F.split(text, r"\r*\n|\r+")


def kind_and_value(line: Column) -> Column:
    """struct(kind, value) of one line; kind is `unknown` for all that isn't a directive."""
    key = F.lower(F.regexp_extract(line, _LINE, 1))
    raw = F.regexp_extract(line, _LINE, 2)
    text = F.encode(raw, "ISO-8859-1").cast("string")
    value = F.when(F.is_valid_utf8(text), F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    kind = F.lit("unknown")
    for name, spellings in SPELLINGS.items():
        kind = F.when(key.isin(spellings), name).otherwise(kind)
    empty = (kind == "disallow") & (value == "")
    whole = F.encode(line, "ISO-8859-1").cast("string")
    return F.struct(
        F.when(empty, "allow").otherwise(kind).alias("kind"),
        F.when(kind == "unknown", F.when(F.is_valid_utf8(whole), whole)).when(empty, "/").otherwise(value).alias("value"),
    )


def lex(documents: DataFrame, key: str = "robots_id", content: str = "content") -> DataFrame:
    """key, pos, kind, value of each line of each document. No shuffle."""
    split = documents.where(F.length(content) > 0).select(key, F.posexplode(lines(F.col(content))).alias("pos", "_line"))
    return split.select(key, "pos", kind_and_value(F.col("_line")).alias("_d")).select(key, "pos", "_d.kind", "_d.value")
