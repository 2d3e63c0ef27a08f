"""Robots documents from rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.paths import normalize_path

_TRIM = r"(?U)^\s+|\s+$"


def comment(text: Column) -> Column:
    """Lines trimmed, blank ones dropped, `# ` before those that don't begin with `#`. Null and blank give null."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.regexp_replace(x, _TRIM, "")), lambda x: x != "")
    marked = F.transform(lines, lambda x: F.when(x.startswith("#"), x).otherwise(F.concat(F.lit("# "), x)))
    return F.nullif(F.array_join(marked, "\n"), F.lit(""))


def _listed(label: str, values: Column) -> Column:
    return F.nullif(F.array_join(F.transform(values, lambda v: F.concat(F.lit(f"{label}: "), v)), "\n"), F.lit(""))


def group_text(agents: Column, allow: Column, disallow: Column, delay: Column, header: Column | None = None, footer: Column | None = None) -> Column:
    """One group. Without agents it is for `*`; without rules it allows everything."""
    empty = F.array().cast("array<string>")
    names = F.array_sort(F.array_distinct(F.transform(F.coalesce(agents, empty), lambda a: F.regexp_replace(a, _TRIM, ""))))
    yes, no = (F.transform(F.coalesce(x, empty), normalize_path) for x in (allow, disallow))
    none = (F.size(yes) == 0) & (F.size(no) == 0)
    return F.concat_ws(
        "\n",
        comment(header) if header is not None else F.lit(None).cast("string"),
        _listed("User-Agent", F.when(F.size(names) == 0, F.array(F.lit("*"))).otherwise(names)),
        F.concat(F.lit("Crawl-Delay: "), delay.cast("string")),
        _listed("Disallow", no),
        F.when(none, F.lit("Allow: *")).otherwise(_listed("Allow", yes)),
        comment(footer) if footer is not None else F.lit(None).cast("string"),
    )


def robots_text(groups: DataFrame, key: str, pos: str, text: str, sitemaps: DataFrame | None = None, header: str | None = None, footer: str | None = None) -> DataFrame:
    """key and txt: the groups of each document in order, parted by blank lines; then its sitemaps (key, sitemap), if given.

    A document is bounded by what crawlers read of it (see lexer.LIMIT)."""
    out = groups.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, text))), lambda g: g[text]), "\n\n").alias("_groups"))
    maps = F.lit(None).cast("string")
    if sitemaps is not None:
        out = out.join(sitemaps.groupBy(key).agg(F.array_sort(F.collect_set("sitemap")).alias("_maps")), key, "left")
        maps = _listed("Sitemap", F.col("_maps"))
    parts = [comment(F.lit(header)), F.col("_groups"), maps, comment(F.lit(footer))]
    return out.select(key, F.concat_ws("\n\n", *parts).alias("txt"))
