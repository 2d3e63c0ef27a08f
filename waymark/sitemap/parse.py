"""Sitemap documents as rows: plain text, URL sets, indexes.

A record is kept if its location is an absolute http(s) URL. A document gives at most RECORD_LIMIT records, and none from
beyond BYTE_LIMIT (of plain text, none that begins beyond it); `over_limits` tells which documents have more, and `missing`
which documents can't be read at all, so that nothing is left out without a row that says so. Damage in one record loses
that record; a mismatched end tag ends the document, what came before stays. Null and empty documents have no records and
no kind. Lines that aren't valid UTF-8 are no URLs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape as _html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.paths import absolute_url
from waymark.sitemap.records import BYTE_LIMIT, RECORD_LIMIT, frequency, lastmod, parsed_priority
from waymark.storage import materialise

FIELDS = {"urlset": ("url", ("loc", "lastmod", "changefreq", "priority")), "sitemapindex": ("sitemap", ("loc", "lastmod"))}
_TOKENS = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|<(/?)([^\s/>]+)[^>]*?(/?)>|([^<]+)", re.S)
_ENTITY = re.compile(r"&(?:#[0-9]+|#x[0-9a-fA-F]+|amp|lt|gt|quot|apos);")


def kind(content: Column) -> Column:
    """urlset, sitemapindex, plain, or null for a document without text."""
    text = content.cast("string")
    leading = r"(?s)\G(?:[\s\x{FEFF}]++|<!--.*?-->|<\?.*?\?>|<![^>]*>)"  # one after the other from the beginning, however long
    root = F.lower(F.regexp_extract(F.regexp_replace(F.substring(text, 1, BYTE_LIMIT), leading, ""), r"^<([A-Za-z:]+)", 1))
    return F.when(root.isin("urlset", "sitemapindex"), root).when(F.trim(text) != "", F.when(root == "", "plain"))


def _lines(content: Column) -> Column:
    """The lines of plain text as an array, each as bytes in Latin-1, so that no byte sequence can fail. The last line break
    begins no line."""
    text = F.decode(content.cast("binary"), "ISO-8859-1")
    return F.when(F.length(text) > 0, F.split(F.regexp_replace(text, "\r?\n\\z", ""), "\r?\n"))


def plain_records(documents: DataFrame, key: str = "url", content: str = "content", record_limit: int = RECORD_LIMIT, byte_limit: int = BYTE_LIMIT) -> DataFrame:
    """key, pos, loc of each line that is a URL. Every line counts for the limit, also blank ones."""
    begun = F.length(F.regexp_replace(F.decode(F.substring(F.col(content).cast("binary"), 1, byte_limit), "ISO-8859-1"), "[^\n]+", "")) + 1
    lines = F.slice(_lines(F.col(content)), F.lit(1), F.least(begun, F.lit(record_limit)))
    rows = documents.select(key, F.posexplode(lines).alias("pos", "_line")).select(key, "pos", F.encode("_line", "ISO-8859-1").cast("string").alias("_line"))
    return rows.where(F.is_valid_utf8("_line")).select(key, "pos", absolute_url(F.col("_line")).alias("loc")).where("loc is not null")


def over_limits(documents: DataFrame, key: str = "url", content: str = "content", record_limit: int = RECORD_LIMIT, byte_limit: int = BYTE_LIMIT) -> DataFrame:
    """key, error (EntryLimit or ByteLimit) and over (how many records or bytes too many) of each document beyond a limit.

    Records of plain text are its lines, those of XML the tags that open one, comments and character data left out."""
    body = F.col(content).cast("string")
    bare = F.regexp_replace(body, r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>", "")
    of = kind(F.col(content))
    tags = lambda t: F.regexp_count(bare, F.lit(rf"(?i)<{t}(?=[\s>])"))
    records = F.when(of == "plain", F.size(_lines(F.col(content)))).when(of == "urlset", tags("url")).when(of == "sitemapindex", tags("sitemap"))
    found = F.array(
        F.struct(F.lit("EntryLimit").alias("error"), (records - record_limit).cast("long").alias("over")),
        F.struct(F.lit("ByteLimit").alias("error"), (F.octet_length(F.col(content)) - byte_limit).cast("long").alias("over")),
    )
    return documents.select(key, F.inline(found)).where("over > 0")


def _unescaped(text: str) -> str | None:
    """None if an ampersand begins no entity of XML."""
    if "&" not in text:
        return text
    return _html(text) if "&" not in _ENTITY.sub("", text) else None


def tokens_to_records(text: str, root: str) -> Iterator[tuple]:
    """The fields of each record. Tags of fields are matched as they stand, at depth three; the last text of a field holds."""
    tag, fields = FIELDS[root]
    path: list[str] = []
    current: dict[str, str | None] | None = None
    for match in _TOKENS.finditer(text):
        close, name, empty, chars = match.groups()
        if name is None:
            if chars and current is not None and len(path) == 3 and path[:2] == [root, tag] and path[2] in fields and chars.strip():
                current[path[2]] = _unescaped(chars)
            continue
        if empty:
            continue
        if not close:
            name = root if not path and name.lower() == root else name
            if name.lower() == tag:
                current = {}
            path.append(name)
            continue
        if not path or (path[-1] != name and not (len(path) == 1 and name.lower() == root)):
            return
        path.pop()
        if name.lower() == tag and current is not None:
            yield tuple(current.get(f) for f in fields)
            current = None
    if current is not None:
        yield tuple(current.get(f) for f in fields)


def _raw(root: str, key: str):
    fields = FIELDS[root][1]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, content in zip(batch["_key"], batch["_content"], strict=True):
                rows: list[tuple] = []
                for pos, record in enumerate(tokens_to_records(bytes(content[:BYTE_LIMIT]).decode("utf-8", "replace"), root)):
                    if pos == RECORD_LIMIT:
                        break
                    rows.append((k, pos, *record))
                yield pd.DataFrame(rows, columns=[key, "pos", *fields])

    return read


def xml_records(documents: DataFrame, root: str = "urlset", key: str = "url", content: str = "content", strict_lastmod: bool = False, known: bool = False) -> DataFrame:
    """key, pos and the fields of each record of the documents of one kind. The documents are read where they lie.

    known: all documents are known to be of that kind."""
    mine = (documents if known else documents.where(kind(F.col(content)) == root)).select(F.col(key).alias("_key"), F.col(content).cast("binary").alias("_content"))
    of_key = documents.schema[key].dataType.simpleString()
    raw = mine.mapInPandas(_raw(root, key), f"{key} {of_key}, pos int, " + ", ".join(f"{f} string" for f in FIELDS[root][1]))
    instant, offset = lastmod(F.col("lastmod"), strict_lastmod)
    out = raw.select(
        key, "pos", absolute_url(F.col("loc")).alias("loc"), instant.alias("lastmod"), offset.alias("lastmod_offset_min"),
        *([parsed_priority(F.col("priority")).alias("priority"), frequency(F.col("changefreq")).alias("changefreq")] if root == "urlset" else []),
    )
    return out.where("loc is not null")


def _reached(roots: DataFrame, documents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """root, key, _kind of each document that is a root or a child of a root that is an index (_kind null: it isn't there, or
    is none); and the kinds of all documents. Kinds are found once."""
    kinds = materialise(documents.select(F.col(key).alias("_doc"), kind(F.col("content")).alias("_kind"), F.lit(True).alias("_there")), "kinds")
    top = roots.select(F.col(key).alias("root")).where("root is not null").distinct().join(kinds, F.col("root") == F.col("_doc"), "left")
    top = materialise(top.select("root", F.col("root").alias(key), "_kind", "_there"), "roots")
    indexes = documents.join(top.where("_kind = 'sitemapindex'").select(key), key, "left_semi")
    children = xml_records(indexes, "sitemapindex", key, known=True).select(F.col(key).alias("root"), F.col("loc").alias(key)).distinct()
    children = children.join(kinds, F.col(key) == F.col("_doc"), "left").select("root", key, "_kind", "_there")
    return materialise(top.unionByName(children), "reached"), kinds


def expand(roots: DataFrame, documents: DataFrame, key: str = "url") -> DataFrame:
    """root, url and the fields of each entry reachable from the root sitemaps.

    A root is a URL set, a plain list, or an index whose children are those; an index inside an index is ignored, and so
    are documents that aren't there (see `missing`). The depth is two, so two joins do. Only documents that are reached are
    parsed."""
    reached, _ = _reached(roots, documents, key)
    pages = reached.where("_kind in ('urlset', 'plain')")
    of = lambda k: documents.join(pages.where(F.col("_kind") == k).select(key).distinct(), key, "left_semi")
    entries = xml_records(of("urlset"), "urlset", key, known=True).unionByName(plain_records(of("plain"), key), allowMissingColumns=True)
    return pages.select("root", key).join(entries, key).select("root", key, "loc", "lastmod", "lastmod_offset_min", "priority", "changefreq")


def missing(roots: DataFrame, documents: DataFrame, key: str = "url") -> DataFrame:
    """root, url, error of each root and child that gives no entries: `missing` (it isn't there), `unknown` (it is no sitemap)
    or `nested` (an index inside an index)."""
    reached, _ = _reached(roots, documents, key)
    nested = (F.col("_kind") == "sitemapindex") & (F.col(key) != F.col("root"))
    error = F.when(F.col("_there").isNull(), "missing").when(F.col("_kind").isNull(), "unknown").when(nested, "nested")
    return reached.select("root", key, error.alias("error")).where("error is not null")
