"""Verdicts of policies over paths: as a column function over a policy's rule array (few rules), or as joins (many)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.paths import normalize_path, url_path


def matches(rule: Column, path: Column) -> Column:
    """Whether a compiled rule holds for a normalised path; plain prefixes and endings need no LIKE."""
    pattern = rule["pattern"]
    return (
        F.when(rule["kind"] == "prefix", path.startswith(pattern))
        .when(rule["kind"] == "ending", F.concat(path, F.lit("$")) == pattern)
        .otherwise(F.call_function("like", path, rule["like_pattern"], F.lit("!")))
    )


def first_rule(rules: Column, path: Column) -> Column:
    """The rule that decides a normalised path, or null."""
    return F.try_element_at(F.filter(rules, lambda r: matches(r, path)), F.lit(1))


def try_allowed(always: Column, rules: Column, path: Column) -> Column:
    """true, false, or null where no rule matches. The robots document itself is allowed, save where one verdict holds for all."""
    normal = normalize_path(path)
    return F.when(always.isNotNull(), always).when(normal == "/robots.txt", True).otherwise(first_rule(rules, normal)["allow"])


def allowed(always: Column, rules: Column, path: Column) -> Column:
    """try_allowed, and true where no rule matches."""
    return F.coalesce(try_allowed(always, rules, path), F.lit(True))


_GRAM = 4


def _anchors(pattern: Column) -> Column:
    """struct(sort, text): what a path must hold for a rule to match. `head`: it begins with the text, which stands before the
    first `*` or `$`. `gram`: where the head is `/` alone, it holds the text, the end of the longest literal piece, of at
    most _GRAM characters. `exact`: it is the text. `any`: the rule has no literal at all and matches every path, or (`/$`) one."""
    head = F.regexp_extract(pattern, r"^[^*$]*", 0)
    pieces = F.split(F.regexp_replace(F.regexp_replace(pattern, r"^/(?=[*$])|\$$", ""), r"\*+", "*"), "\\*")
    longest = F.array_max(F.transform(pieces, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    plain = pattern.rlike(r"^/\*+\$?$") | (pattern == "/")
    return (
        F.when(plain, F.struct(F.lit("any").alias("sort"), F.lit("").alias("text")))
        .when(pattern.rlike(r"^[^*]*\$$"), F.struct(F.lit("exact").alias("sort"), head.alias("text")))
        .when((F.length(head) <= 1) & (longest != ""), F.struct(F.lit("gram").alias("sort"), F.right(longest, F.lit(_GRAM)).alias("text")))
        .otherwise(F.struct(F.lit("head").alias("sort"), head.alias("text")))
    )


def _grams(path: Column, n: Column) -> Column:
    """All pieces of n characters of a path."""
    return F.when(F.length(path) >= n, F.transform(F.sequence(F.lit(1), F.length(path) - n + 1), lambda i: F.substring(path, i, n)))


def decide(paths: DataFrame, rules: DataFrame, key: list[str], ident: str) -> DataFrame:
    """key, ident, len, allow of the deciding rule of each path that any rule matches.

    paths: key, ident and path (normalised); rules: key, pattern, like_pattern, kind, len, allow. Each distinct path of a
    key is decided once. Each rule has an anchor, a text that a path must begin with or hold, so that by a hash join on key
    and anchor a path meets only rules whose anchor it has: no join compares all pairs, and the join's keys are spread also
    where one key holds most paths. Beginnings are cut only in the lengths that a key's anchors have. Only rules with a `*`
    are compared as patterns, after a look for what stands behind the last `*`. Rules without any literal match all paths of
    their key: the first of them counts, once a key."""
    anchor = _anchors(F.col("pattern"))
    tail = F.regexp_extract("pattern", r"([^*$]*)\$?$", 1)
    indexed = rules.where("kind is not null").select(*key, anchor.alias("_a"), tail.alias("_tail"), "like_pattern", "kind", (F.col("len") * 2 + F.col("allow").cast("int")).alias("_rank"))
    indexed = indexed.select(*key, "_a.sort", "_a.text", "_tail", "like_pattern", "kind", "_rank")
    whole = indexed.where("sort = 'any'").groupBy(*key).agg(F.max("_rank").alias("_whole"))
    indexed = indexed.where("sort <> 'any'")
    # at most the longest rule's length, and _GRAM
    lengths = indexed.groupBy(*key).agg(F.collect_set(F.when(F.col("sort") == "head", F.length("text"))).alias("_heads"), F.collect_set(F.when(F.col("sort") == "gram", F.length("text"))).alias("_ns"))
    distinct = paths.select(*key, "path").distinct()
    heads = F.transform(F.filter("_heads", lambda n: n <= F.length("path")), lambda n: F.struct(F.lit("head").alias("sort"), F.left(F.col("path"), n).alias("text")))
    grams = F.array_distinct(F.flatten(F.filter(F.transform("_ns", lambda n: _grams(F.col("path"), n)), lambda x: x.isNotNull())))
    exact = F.array(F.struct(F.lit("exact").alias("sort"), F.col("path").alias("text")))
    held = F.concat(heads, exact, F.transform(grams, lambda g: F.struct(F.lit("gram").alias("sort"), g.alias("text"))))
    met = distinct.join(lengths, key).select(*key, "path", F.inline(held)).join(indexed, [*key, "sort", "text"])
    # a plain prefix or ending holds as its anchor does; only the others need the path again
    like = F.call_function("like", "path", "like_pattern", F.lit("!"))
    holds = (
        F.when(F.col("kind").isin("prefix", "ending"), True)
        .when(F.col("kind") == "both", F.endswith("path", "_tail") & like).otherwise(F.contains("path", "_tail") & like)
    )
    best = met.where(holds).groupBy(*key, "path").agg(F.max("_rank").alias("_rank"))
    rows = paths.select(*key, ident, "path").join(best, [*key, "path"], "left").join(whole, key, "left")
    rows = rows.select(*key, ident, F.greatest("_rank", "_whole").alias("_rank")).where("_rank is not null")
    return rows.select(*key, ident, F.shiftright("_rank", 1).alias("len"), (F.col("_rank") % 2 == 1).alias("allow"))


def verdicts(policies: DataFrame, urls: DataFrame, key: str = "robots_id", url: str = "loc", ident: str = "entry_id") -> DataFrame:
    """urls with agent, verdict (nullable) and allowed, for each policy of their document. ident is unique in urls."""
    rows = urls.join(policies.select(key, "agent", "always"), key).withColumn("path", normalize_path(url_path(F.col(url))))
    rules = policies.where("always is null").select(key, "agent", F.inline("rules"))
    found = decide(rows.where("always is null and path <> '/robots.txt'").select(key, "agent", ident, "path"), rules, [key, "agent"], ident)
    rows = rows.join(found.drop("len"), [key, "agent", ident], "left")
    verdict = F.when(F.col("always").isNotNull(), F.col("always")).when(F.col("path") == "/robots.txt", True).otherwise(F.col("allow"))
    return rows.withColumns({"verdict": verdict, "allowed": F.coalesce(verdict, F.lit(True))}).drop("always", "path", "allow")
