"""The policy that a document gives to an agent.

`policies` works on documents, `grouped`, `captured` and `rules_of` on tables of directives. A document is at most LIMIT
bytes, so windows and arrays by document are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.paths import is_universal, like_pattern, normalize_path, pattern_kind
from waymark.robots import lexer

# The labels of what came of fetching a robots document.
ACCESS = ["Successful", "Redirect", "Unavailable", "Unreachable"]
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def access_label(text: Column) -> Column:
    """One of ACCESS, whatever the case and the blanks around it; null for any other text."""
    name = F.initcap(F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")))
    return F.when(name.isin(ACCESS), name)


def delay_seconds(value: Column) -> Column:
    """Seconds as a double; null unless a finite number that isn't negative."""
    number = F.when(value.rlike(_NUMBER), F.try_cast(value, "double") if hasattr(F, "try_cast") else value.try_cast("double"))
    return F.when((number >= 0) & (number < float("inf")), number)


def grouped(directives: DataFrame, key: str = "robots_id") -> DataFrame:
    """key, pos, kind, value, grp: directives with the number of their group (0: before any agent line).

    Agent lines that follow each other open one group; only rules and delays end such a run. Agents are in lower case;
    agent lines whose value isn't valid text are left out."""
    member = directives.where("kind in ('user-agent', 'allow', 'disallow', 'crawl-delay') and not (kind = 'user-agent' and value is null)")
    order = Window.partitionBy(key).orderBy("pos")
    opens = (F.col("kind") == "user-agent") & ~F.coalesce(F.lag("kind").over(order) == "user-agent", F.lit(False))
    rows = member.withColumn("_opens", opens.cast("int"))
    value = F.when(F.col("kind") == "user-agent", F.lower("value")).otherwise(F.col("value"))
    return rows.select(key, "pos", "kind", value.alias("value"), F.sum("_opens").over(order).cast("int").alias("grp"))


def selected_agents(groups: DataFrame, agents: DataFrame, documents: DataFrame, key: str = "robots_id") -> DataFrame:
    """key, agent, selected: for each document and requested agent the longest agent of the document that begins its name.

    `*` where there is none. agents has one column, agent: a handful of names, not data."""
    wanted = F.lower(F.regexp_replace("agent", r"(?U)^\s+|\s+$", ""))
    asked = documents.select(key).distinct().crossJoin(F.broadcast(agents.select("agent").distinct()))
    named = groups.where("kind = 'user-agent'").groupBy(key).agg(F.collect_set("value").alias("_agents"))
    fit = F.filter(F.col("_agents"), lambda a: wanted.startswith(a))
    best = F.array_max(F.transform(fit, lambda a: F.struct(F.octet_length(a).alias("n"), a.alias("a"))))["a"]
    return asked.join(named, key, "left").select(key, "agent", F.coalesce(best, F.lit("*")).alias("selected"))


def captured(groups: DataFrame, selected: DataFrame, key: str = "robots_id") -> DataFrame:
    """key, agent, selected, pos, kind, value: the rules and delays that hold for each requested agent."""
    of = groups.where("kind = 'user-agent'").groupBy(key, "grp").agg(F.collect_set("value").alias("_agents"))
    rules = groups.where("kind <> 'user-agent'").join(of, [key, "grp"], "left").join(selected, key)
    hit = F.when(F.col("grp") == 0, F.col("selected") == "*").otherwise(F.array_contains("_agents", F.col("selected")))
    return rules.where(hit).select(key, "agent", "selected", "pos", "kind", "value")


def rules_of(held: DataFrame, key: str = "robots_id") -> DataFrame:
    """key, agent, pos, pattern (normalised), allow, like_pattern, kind, len of each valid rule."""
    rows = held.where("kind in ('allow', 'disallow') and value is not null")
    rows = rows.select(key, "agent", "pos", normalize_path(F.col("value")).alias("pattern"), (F.col("kind") == "allow").alias("allow"))
    rows = rows.withColumns({"like_pattern": like_pattern(F.col("pattern")), "kind": pattern_kind(F.col("pattern")), "len": F.octet_length("pattern")})
    return rows.where("kind is not null")


def sorted_rules(rules: Column) -> Column:
    """Longest first, of equal length allowing ones first."""
    return F.sort_array(rules, asc=False)


def always(rules: Column) -> Column:
    """true or false where the rules come to one verdict for all paths, else null."""
    return F.when(F.forall(rules, lambda r: r["allow"]), True).when(
        F.forall(rules, lambda r: ~r["allow"]) & F.exists(rules, lambda r: is_universal(r["pattern"])), False
    )


def policies(documents: DataFrame, agents: DataFrame, optimal: bool = False, key: str = "robots_id", content: str = "content") -> DataFrame:
    """key, agent, selected, always, rules (null where always is set), crawl_delay, sitemaps of each document and agent.

    With a column `access` in documents (see access_label), redirected and unavailable documents allow everything,
    unreachable ones nothing; all others, those with an unknown label too, are read.
    A document is handled within its row: no shuffle, and streams of documents will do. agents has one column, agent: a
    handful of names."""
    access = access_label(F.col("access")) if "access" in documents.columns else F.lit(None).cast("string")
    every = F.transform(lexer.lines(F.coalesce(F.col(content), F.lit(b""))), lexer.kind_and_value)
    rows = documents.select(key, access.alias("_access"), every.alias("_all"))
    lower = lambda x: F.when(x["kind"] == "user-agent", F.lower(x["value"])).otherwise(x["value"])
    members = F.filter("_all", lambda x: x["kind"].isin("user-agent", "allow", "disallow", "crawl-delay") & ((x["kind"] != "user-agent") | x["value"].isNotNull()))
    maps = F.filter("_all", lambda x: (x["kind"] == "sitemap") & x["value"].rlike("^[A-Za-z][A-Za-z0-9+.-]*:."))
    rows = rows.select(key, "_access", F.transform(members, lambda x: F.struct(x["kind"].alias("kind"), lower(x).alias("value"))).alias("_m"), F.transform(maps, lambda x: x["value"]).alias("sitemaps"))
    opens = lambda x, i: F.when((x["kind"] == "user-agent") & ((i == 0) | (F.get("_m", i - 1)["kind"] != "user-agent")), i)
    rows = rows.withColumns({"_starts": F.array_compact(F.transform("_m", opens)), "_names": F.array_distinct(F.transform(F.filter("_m", lambda x: x["kind"] == "user-agent"), lambda x: x["value"]))})
    rows = rows.withColumn("_groups", F.transform("_starts", lambda s, j: F.struct(s.alias("at"), (F.coalesce(F.get("_starts", j + 1), F.size("_m")) - s).alias("n"))))
    rows = rows.crossJoin(F.broadcast(agents.select("agent").distinct()))
    wanted = F.lower(F.regexp_replace("agent", r"(?U)^\s+|\s+$", ""))
    longest = F.array_max(F.transform(F.filter("_names", lambda a: wanted.startswith(a)), lambda a: F.struct(F.octet_length(a).alias("n"), a.alias("a"))))["a"]
    rows = rows.withColumn("selected", F.coalesce(longest, F.lit("*")))
    mine = F.filter("_groups", lambda g: F.exists(F.slice("_m", g["at"] + 1, g["n"]), lambda x: (x["kind"] == "user-agent") & (x["value"] == F.col("selected"))))
    unassigned = F.slice("_m", F.lit(1), F.when(F.col("selected") == "*", F.coalesce(F.get("_starts", F.lit(0)), F.size("_m"))).otherwise(0))
    rows = rows.withColumn("_held", F.concat(unassigned, F.flatten(F.transform(mine, lambda g: F.slice("_m", g["at"] + 1, g["n"])))))
    said = F.filter("_held", lambda x: x["kind"].isin("allow", "disallow") & x["value"].isNotNull())
    rows = rows.withColumn("_said", F.transform(said, lambda x: F.struct(normalize_path(x["value"]).alias("pattern"), (x["kind"] == "allow").alias("allow"))))
    made = F.transform("_said", lambda x: F.struct(F.octet_length(x["pattern"]).alias("len"), x["allow"].alias("allow"), x["pattern"].alias("pattern"), like_pattern(x["pattern"]).alias("like_pattern"), pattern_kind(x["pattern"]).alias("kind")))
    seconds = F.transform(F.filter("_held", lambda x: x["kind"] == "crawl-delay"), lambda x: delay_seconds(x["value"]))
    least = F.aggregate(seconds, F.lit(None).cast("double"), lambda held, s: F.when(s.isNotNull(), F.least(held, s)))  # one that isn't valid forgets those before
    rows = rows.withColumns({"_rules": sorted_rules(F.filter(made, lambda r: r["kind"].isNotNull())), "_delay": least})
    fixed = F.when(F.col("_access").isin("Redirect", "Unavailable"), True).when(F.col("_access") == "Unreachable", False)
    free = fixed.isNull()
    one = F.when(~free, fixed).otherwise(always(F.col("_rules")) if optimal else F.lit(None).cast("boolean"))
    out = rows.select(
        key, "agent", F.when(free, F.col("selected")).otherwise(F.col("agent")).alias("selected"), one.alias("always"), "_rules",
        F.when(free, F.col("_delay")).alias("crawl_delay"), F.when(free, F.col("sitemaps")).otherwise(F.array().cast("array<string>")).alias("sitemaps"),
    )
    return out.select(key, "agent", "selected", "always", F.when(F.col("always").isNull(), F.col("_rules")).alias("rules"), "crawl_delay", "sitemaps")


def from_always(allow: bool, agent: Column) -> list[Column]:
    """The columns selected, always, rules, crawl_delay, sitemaps of a policy with one verdict; the agent stays as it is."""
    none = F.lit(None).cast("array<struct<len:int,allow:boolean,pattern:string,like_pattern:string,kind:string>>")
    return [
        agent.alias("selected"), F.lit(allow).alias("always"), none.alias("rules"), F.lit(None).cast("double").alias("crawl_delay"),
        F.array().cast("array<string>").alias("sitemaps"),
    ]


def same_policy(a: Column, b: Column, agent: bool = True) -> Column:
    """Whether two policies (structs of selected, always, rules, crawl_delay, sitemaps) are equal; with agent=False, but for
    the agent they were selected by. Rules are equal if pattern and verdict are. Null equals null."""
    essence = lambda r: F.struct(r["allow"], r["pattern"])
    equal = a["always"].eqNullSafe(b["always"]) & F.transform(a["rules"], essence).eqNullSafe(F.transform(b["rules"], essence))
    equal = equal & a["crawl_delay"].eqNullSafe(b["crawl_delay"]) & a["sitemaps"].eqNullSafe(b["sitemaps"])
    return equal & a["selected"].eqNullSafe(b["selected"]) if agent else equal


def rule_count(rules: Column) -> Column:
    """How many rules a policy has; null where it is one verdict for all."""
    return F.when(rules.isNotNull(), F.size(rules))


def to_json(user_agent: Column, always_: Column, rules: Column, crawl_delay: Column, sitemaps: Column) -> Column:
    """A policy as text for a cache."""
    patterns = lambda allow: F.transform(F.filter(rules, lambda r: r["allow"] == allow), lambda r: r["pattern"])
    seconds = F.floor(crawl_delay)
    delay = F.when(crawl_delay.isNotNull(), F.struct(seconds.alias("secs"), F.round((crawl_delay - seconds) * 1e9).cast("int").alias("nanos")))
    return F.to_json(F.struct(
        user_agent.alias("user_agent"), always_.alias("always"), patterns(True).alias("allow"), patterns(False).alias("disallow"),
        delay.alias("crawl_delay"), sitemaps.alias("sitemaps"),
    ))


_CACHED = "user_agent string, always boolean, allow array<string>, disallow array<string>, crawl_delay struct<secs:bigint,nanos:int>, sitemaps array<string>"


def from_json(text: Column) -> Column:
    """struct(selected, always, rules, crawl_delay, sitemaps, error) of a cached policy.

    error says why a text is no policy: `invalid` (no JSON, or no agent), `duplicate` (a field stands twice), `both` (`always`
    beside a list of rules), `missing` (neither `always` nor both lists); the rest is null then. Unknown fields don't matter.
    Patterns are normalised; those that can't be compiled are dropped; the rules are sorted anew."""
    p = F.from_json(text, _CACHED)
    names = [c.split()[0] for c in _CACHED.split(", ")]
    # a quote within a JSON string has a backslash before it, so only a field's name can stand like this
    twice = F.greatest(*[F.regexp_count(text, F.lit(rf'(?<!\\)"{n}"\s*:')) for n in names]) > 1
    any_, all_ = p["allow"].isNotNull() | p["disallow"].isNotNull(), p["allow"].isNotNull() & p["disallow"].isNotNull()

    def made(patterns: Column, allow: bool) -> Column:
        normal = F.transform(F.filter(patterns, lambda x: x.isNotNull()), normalize_path)
        rules = F.transform(normal, lambda x: F.struct(
            F.octet_length(x).alias("len"), F.lit(allow).alias("allow"), x.alias("pattern"), like_pattern(x).alias("like_pattern"), pattern_kind(x).alias("kind")))
        return F.filter(rules, lambda r: r["kind"].isNotNull())

    error = (
        F.when(text.isNull() | p.isNull() | p["user_agent"].isNull(), "invalid").when(twice, "duplicate")
        .when(p["always"].isNotNull() & any_, "both").when(p["always"].isNull() & ~all_, "missing")
    )
    good = lambda c: F.when(error.isNull(), c)
    rules = good(F.when(p["always"].isNull(), sorted_rules(F.concat(made(p["allow"], True), made(p["disallow"], False)))))
    return F.struct(good(p["user_agent"]).alias("selected"), good(p["always"]).alias("always"), rules.alias("rules"),
        good(p["crawl_delay"]["secs"] + p["crawl_delay"]["nanos"] / 1e9).alias("crawl_delay"), good(p["sitemaps"]).alias("sitemaps"), error.alias("error"))
