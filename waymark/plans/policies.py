"""Queries of the robots operators: over a few written documents, and over rules and locations of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions.paths import like_pattern, normalize_path, pattern_kind, robots_url, robots_url_error, url_path
from waymark.operators.line_errors import loaded_lines
from waymark.plans.preparation import _LINES, table
from waymark.robots import build, lexer, match, policy
from waymark.storage import materialise

AGENTS = ["*", "korbot", "Selbot/2.1", "dorbot-images-large", "torfetch", "zed"]
SAMPLES = [
    (1, "Disallow: /archive\nUser-agent: dorbot\nUser-agent: dorbot-images\nDisallow: /press\nSitemap: https://a.example/s.xml\nUser-agent: korbot\nAllow: /press\nDisallow: /*\n"),
    (2, "# first\r\nUser-Agent : Korbot # c\r\nDissalow: /*.html$\r\nAllow: /news/\r\nDisallow: /n\r\n\r\nUser-agent: *\rDisallow: /shop\rCrawl-delay: 5\r"),
    (3, "user agent: *\nCrawl-delay: 5\nCrawl-delay: x\nCrawl-delay: 7\nDisallow:\nuseragent: torfetch\nCRAWL delay 2.5\nCrawldelay: 9\nDisallow: /d$x\nDisallow: /docs*a*2$\n"),
    (4, "User-agent: selbot\nDisallow: /\nAllow: /$\nAllow: /blog/*\nUser-agent:\nDisallow: /help\nSite-map: https://b.example/1.xml#f\nSite map: https://b.example/2.xml\n"),
    (5, "User-agent: *\nAllow: /\nAllow: /press\n"),
    (6, "User-agent: *\nDisallow: /*\nDisallow: /jobs\njunk line\nUser-agent: korbot\nallowed: q\nCrawl-delay: 1e1\n"),
    (7, "User-agent: dorbot-images\nDisallow: /caf\u00e9\nDisallow: /a_b%20\nUser-agent: torfetch\nDisallow: /archive/*-\nAllow: /archive/c\nUser-agent: dorbot-images\nDisallow: /jobs\n"),
    (8, ""),
]


def samples(spark: SparkSession) -> DataFrame:
    rows = [(i, bytearray(t.encode())) for i, t in SAMPLES]
    return spark.createDataFrame(rows, "robots_id long, content binary")


def agents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a,) for a in AGENTS], "agent string")


def sample_policies(spark: SparkSession, optimal: bool = False) -> DataFrame:
    return policy.policies(samples(spark), agents(spark), optimal)


def loaded_policies(spark: SparkSession, sf_dir: str, optimal: bool = False) -> DataFrame:
    return policy.policies(loaded_documents(spark, sf_dir), agents(spark), optimal)


def host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host_id, line_id, robots_id, agent, pattern (normalised), allow of the valid rule lines."""
    rules = loaded_lines(table(spark, sf_dir, "raw_lines"), "rule", keep=("host_id",))
    return rules.select("host_id", "line_id", "robots_id", "agent", normalize_path(F.col("pattern")).alias("pattern"), (F.lower("allow") == "true").alias("allow"))


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entry_listings").where("loc is not null").select("entry_id", "host_id", "loc")


def by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, path, len and allow of the deciding one of all rules of its host, whatever their agent."""
    rules = host_rules(spark, sf_dir).select("host_id", "pattern", "allow").distinct()
    rules = rules.withColumns({"like_pattern": like_pattern(F.col("pattern")), "kind": pattern_kind(F.col("pattern")), "len": F.octet_length("pattern")})
    paths = located(spark, sf_dir).select("host_id", "entry_id", normalize_path(url_path(F.col("loc"))).alias("path"))
    return paths.join(match.decide(paths, rules, ["host_id"], "entry_id"), ["host_id", "entry_id"], "left").select("entry_id", "path", "len", "allow")


def robots_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robots_try_verdict(spark, sf_dir).select("entry_id", F.coalesce("verdict", F.lit(True)).alias("allowed"))


def robots_try_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_host(spark, sf_dir).select("entry_id", F.when(F.col("path") == "/robots.txt", True).otherwise(F.col("allow")).alias("verdict"))


def robots_first_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_host(spark, sf_dir).where("len is not null").select("entry_id", "len", "allow")


def robots_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexer.lex(samples(spark))


def robots_lex_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexer.lex(loaded_documents(spark, sf_dir))


def robots_lex_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexer over texts that weren't meant for it: how many lines of each kind."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return lexer.lex(texts, "doc_id").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def _groups(spark: SparkSession, documents: DataFrame) -> DataFrame:
    groups = policy.grouped(lexer.lex(documents))
    held = policy.captured(groups, policy.selected_agents(groups, agents(spark), documents))
    return policy.rules_of(held).join(held.select("robots_id", "agent", "pos", "selected"), ["robots_id", "agent", "pos"]).select("robots_id", "agent", "selected", "pos", "pattern", "allow")


def robots_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, samples(spark))


def robots_groups_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, materialise(loaded_documents(spark, sf_dir), "robots"))


def robots_text_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = located(spark, sf_dir).withColumn("robots_id", F.pmod("entry_id", F.lit(len(SAMPLES))) + 1)
    return match.verdicts(sample_policies(spark), urls).select("entry_id", "agent", "verdict", "allowed")


def robots_text_verdict_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each URL by one of the documents of its host: of n in order, number entry_id modulo n.

    A document has few rules, so they travel with its policies; match.verdicts would shuffle each URL once an agent."""
    documents = materialise(loaded_documents(spark, sf_dir), "robots")
    keys = documents.select("robots_id", F.substring_index("robots_id", "/", 1).cast("long").alias("host_id"))
    of = Window.partitionBy("host_id")
    numbered = keys.select("*", (F.row_number().over(of.orderBy("robots_id")) - 1).cast("long").alias("_k"), F.count(F.lit(1)).over(of).alias("_n"))
    numbered = materialise(numbered, "numbered")
    urls = located(spark, sf_dir).join(numbered.select("host_id", "_n").distinct(), "host_id").withColumn("_k", F.pmod("entry_id", "_n")).drop("_n")
    urls = urls.join(numbered.drop("_n"), ["host_id", "_k"]).select("entry_id", "robots_id", url_path(F.col("loc")).alias("path"))
    rows = urls.join(policy.policies(documents, agents(spark)).select("robots_id", "agent", "always", "rules"), "robots_id")
    policy_path = F.col("always"), F.col("rules"), F.col("path")
    return rows.select("entry_id", "agent", match.try_allowed(*policy_path).alias("verdict"), match.allowed(*policy_path).alias("allowed"))


def robots_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column functions over paths: a document has a handful of rules, which travel with its policies."""
    urls = located(spark, sf_dir).select("entry_id", (F.pmod("entry_id", F.lit(len(SAMPLES))) + 1).alias("robots_id"), url_path(F.col("loc")).alias("path"))
    rows = urls.join(F.broadcast(sample_policies(spark)), "robots_id")  # a row a sample and agent
    policy_path = F.col("always"), F.col("rules"), F.col("path")
    return rows.select("entry_id", "agent", match.try_allowed(*policy_path).alias("verdict"), match.allowed(*policy_path).alias("allowed"))


def robots_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each agent's policy of a document is that of `*`: as a whole, and but for the agent."""
    held = loaded_policies(spark, sf_dir).select("robots_id", "agent", F.struct("selected", "always", "rules", "crawl_delay", "sitemaps").alias("_p"))
    by = held.groupBy("robots_id").agg(F.map_from_entries(F.collect_list(F.struct("agent", "_p"))).alias("_by"))  # an entry an agent
    one, star = F.element_at("_by", F.col("agent")), F.element_at("_by", F.lit("*"))
    rows = by.select("robots_id", "_by", F.explode(F.map_keys("_by")).alias("agent"))
    return rows.select("robots_id", "agent", policy.same_policy(one, star).alias("same"), policy.same_policy(one, star, agent=False).alias("same_rules"))


def robots_cache_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached texts made from the rule lines, one sort of damage after the other: what each is found to be."""
    rules = host_rules(spark, sf_dir).select("line_id", F.to_json(F.array("pattern")).alias("p"), "agent")
    a = F.concat(F.lit('{"user_agent":'), F.get(F.split(F.to_json(F.struct("agent")), ":", 2), F.lit(1)))  # {"agent":"x"} -> "x"}
    head = F.regexp_replace(a, r"\}$", "")
    texts = [
        F.concat(head, F.lit(',"allow":'), "p", F.lit(',"disallow":[],"x":1}')), F.concat(head, F.lit(',"always":true,"allow":'), "p", F.lit("}")),
        F.concat(head, F.lit(',"allow":'), "p", F.lit("}")), F.concat(head, F.lit(',"allow":'), "p", F.lit(',"allow":[],"disallow":[]}')),
        F.concat(head, F.lit(',"always":')), F.concat(head, F.lit(',"always":false}')),
    ]
    case = F.pmod("line_id", F.lit(len(texts)))
    text = F.element_at(F.array(*texts), case.cast("int") + 1)
    back = rules.select("line_id", policy.from_json(text).alias("_p"))
    return back.select("line_id", "_p.error", "_p.always", F.coalesce(F.size("_p.rules"), F.lit(-1)).alias("n_rules"))


def _delay(policies: DataFrame) -> DataFrame:
    return policies.where("crawl_delay is not null").select("robots_id", "agent", "crawl_delay")


def robots_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delay(sample_policies(spark))


def robots_delay_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delay(loaded_policies(spark, sf_dir))


def _sitemaps(policies: DataFrame) -> DataFrame:
    return policies.where("agent = '*'").select("robots_id", F.posexplode("sitemaps").alias("pos", "sitemap"))


def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sitemaps(sample_policies(spark))


def sitemap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots_id (host_id/part) and content: the sitemaps of each host, in as many documents as keep within the lexer's limit."""
    maps = table(spark, sf_dir, "index_listings").where(r"not loc rlike '[#\r\n]|^\\s|\\s$|^$'").select("host_id", "loc").distinct()
    so_far = F.sum(F.octet_length("loc") + 10).over(Window.partitionBy("host_id").orderBy("loc").rowsBetween(Window.unboundedPreceding, 0))
    robots_id = F.concat_ws("/", F.col("host_id").cast("string"), F.floor(so_far / (lexer.LIMIT // 2)).cast("string"))
    maps = materialise(maps.select(robots_id.alias("robots_id"), F.col("loc").alias("sitemap")), "maps")
    groups = maps.select("robots_id", F.lit(0).alias("pos")).distinct().withColumn("text", build.group_text(F.lit(None), F.lit(None), F.lit(None), F.lit(None).cast("string")))
    return build.robots_text(groups, "robots_id", "pos", "text", maps).select("robots_id", F.encode("txt", "UTF-8").alias("content"))


def robots_sitemaps_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sitemaps(policy.policies(sitemap_documents(spark, sf_dir), agents(spark)))


def _policy_stats(policies: DataFrame) -> DataFrame:
    """n_rules is -1 where one verdict holds for all."""
    n = F.coalesce(policy.rule_count(F.col("rules")), F.lit(-1))
    return policies.select("robots_id", "agent", "selected", "always", n.alias("n_rules"), F.when(n >= 0, n == 0).alias("is_empty"))


def robots_policy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy_stats(sample_policies(spark, True))


def robots_policy_stats_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy_stats(loaded_policies(spark, sf_dir, True))


def robots_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.lit("User-agent: *\nDisallow: /docs\n"), "UTF-8")
    documents = table(spark, sf_dir, "hosts").select(F.col("host_id").alias("robots_id"), F.col("access_result").alias("access"), text.alias("content"))
    held = policy.policies(documents, agents(spark).where("agent = '*'"))
    urls = located(spark, sf_dir).withColumnRenamed("host_id", "robots_id")
    return match.verdicts(held, urls).select("entry_id", "allowed")


def robots_wildcard_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = loaded_lines(table(spark, sf_dir, "raw_lines"), "rule").select("line_id", normalize_path(F.col("pattern")).alias("pattern"))
    return raw.select("line_id", "pattern", pattern_kind(F.col("pattern")).alias("kind"), like_pattern(F.col("pattern")).alias("like_pattern"))


def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(spark, sf_dir).select("entry_id", normalize_path(url_path(F.col("loc"))).alias("normalized"))


def robots_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(spark, sf_dir).select("entry_id", robots_url(F.col("loc")).alias("robots_url"), robots_url_error(F.col("loc")).alias("error"))


_UNFIT_AGENT = r"agent rlike '[#\r\n]|^\\s|\\s$|^$'"


def _clean_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""Rules whose agent and pattern can stand in a robots document as they are."""
    rules = host_rules(spark, sf_dir).where(rf"not {_UNFIT_AGENT} and not pattern rlike '[#\r\n]'")
    return rules.select(F.concat(F.col("host_id").cast("string"), F.lit("/"), "robots_id").alias("robots_id"), F.lower("agent").alias("agent"), "pattern", "allow").distinct()


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _clean_rules(spark, sf_dir).groupBy("robots_id", "agent").agg(
        F.array_sort(F.collect_set(F.when(F.col("allow"), F.col("pattern")))).alias("allow"),
        F.array_sort(F.collect_set(F.when(~F.col("allow"), F.col("pattern")))).alias("disallow"),
    )
    text = build.group_text(F.array("agent"), F.col("allow"), F.col("disallow"), F.lit(None).cast("int"), F.lit("one group"))
    groups = rules.select("robots_id", "agent", text.alias("text"))
    return build.robots_text(groups, "robots_id", "agent", "text", header="made from rules", footer="# end")


def loaded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots_id (host_id/robots_id) and content: a document of all loaded rule and delay lines that can stand in one.

    An agent's group holds each of its delays; an empty one stands first, so that it doesn't undo a number."""
    rules = _clean_rules(spark, sf_dir).select("robots_id", "agent", F.struct("allow", "pattern").alias("_rule"), F.lit(None).cast("string").alias("_delay"))
    delays = loaded_lines(table(spark, sf_dir, "raw_lines"), "delay", keep=("host_id",)).where(f"not {_UNFIT_AGENT}")
    delays = delays.select(F.concat(F.col("host_id").cast("string"), F.lit("/"), "robots_id").alias("robots_id"), F.lower("agent").alias("agent"), F.lit(None).cast("struct<allow:boolean,pattern:string>").alias("_rule"), F.col("crawl_delay").alias("_delay"))
    held = rules.unionByName(delays).groupBy("robots_id", "agent").agg(F.array_sort(F.collect_set("_rule")).alias("_rules"), F.array_sort(F.collect_set("_delay")).alias("_delays"))
    patterns = lambda allow: F.transform(F.filter("_rules", lambda r: r["allow"] == allow), lambda r: r["pattern"])
    delay = F.when(F.size("_delays") > 0, F.array_join("_delays", "\nCrawl-Delay: "))
    groups = held.select("robots_id", "agent", build.group_text(F.array("agent"), patterns(True), patterns(False), delay, F.lit("one group")).alias("text"))
    return build.robots_text(groups, "robots_id", "agent", "text", header="made from rules", footer="# end").select("robots_id", F.encode("txt", "UTF-8").alias("content"))


def robots_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir)


def robots_build_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = built(spark, sf_dir).select("robots_id", F.encode("txt", "UTF-8").alias("content"))
    held = policy.policies(documents, agents(spark))
    return held.select("robots_id", "agent", "selected", F.size("rules").alias("n_rules"))


def _cache_roundtrip(p: DataFrame) -> DataFrame:
    text = policy.to_json(F.col("selected"), F.col("always"), F.col("rules"), F.col("crawl_delay"), F.col("sitemaps"))
    back = p.select("robots_id", "agent", policy.from_json(text).alias("_p"))
    many = lambda allow: F.size(F.filter("_p.rules", lambda r: r["allow"] == allow))
    size = lambda c: F.when(F.col("_p.rules").isNotNull(), c).otherwise(-1)
    return back.select("robots_id", "agent", "_p.selected", "_p.always", size(many(True)).alias("n_allow"), size(many(False)).alias("n_disallow"),
        "_p.crawl_delay", F.size("_p.sitemaps").alias("n_sitemaps"), "_p.error")


def robots_cache_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache_roundtrip(sample_policies(spark, True))


def robots_cache_roundtrip_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cache_roundtrip(loaded_policies(spark, sf_dir, True))


QUERIES = {
    q.__name__: q
    for q in (
        robots_verdict, robots_try_verdict, robots_first_rule, robots_lex, robots_lex_documents, robots_groups, robots_text_verdict, robots_delay,
        robots_sitemaps, robots_policy_stats, robots_access, robots_wildcard_kind, path_normalize, robots_location, robots_build,
        robots_build_parse, robots_cache_roundtrip, robots_lex_loaded, robots_groups_loaded, robots_text_verdict_loaded, robots_delay_loaded, robots_sitemaps_loaded,
        robots_policy_stats_loaded, robots_cache_roundtrip_loaded, robots_relative, robots_equal, robots_cache_errors,
    )
}

# ---------------------------------------------------------------------------------------------- the same in SQL


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f"E'{escaped}'"


def norm_sql(p: str) -> str:
    return rf"""(SELECT CASE WHEN q LIKE '/%' THEN q ELSE '/' || q END FROM (SELECT CASE WHEN regexp_matches(p, '[^\x21-\x7e]|["<>]') THEN array_to_string(
      list_transform(string_split(p, ''), lambda c: CASE WHEN regexp_matches(c, '[^\x21-\x7e]|["<>]') THEN regexp_replace(hex(c), '(..)', '%\1', 'g') ELSE c END), '') ELSE p END AS q FROM (SELECT {p} AS p)))"""


def kind_sql(p: str) -> str:
    return f"CASE WHEN strpos({p}, '$') > 0 AND strpos({p}, '$') < length({p}) THEN NULL WHEN strpos({p}, '$') > 0 AND contains({p}, '*') THEN 'both' WHEN strpos({p}, '$') > 0 THEN 'ending' WHEN contains({p}, '*') THEN 'universal' ELSE 'prefix' END"


def like_sql(p: str) -> str:
    return rf"CASE WHEN ({kind_sql(p)}) IS NOT NULL THEN regexp_replace(regexp_replace(regexp_replace({p}, '\$$', ''), '([!%_])', '!\1', 'g'), '\*+', '%', 'g') || CASE WHEN {p} LIKE '%$' THEN '' ELSE '%' END END"


def path_sql(u: str) -> str:
    return rf"regexp_replace({u}, '(?i)^\s*[a-z][a-z0-9+.\-]*://[^/?#]*', '')"


_KEYS = "|".join(s for spellings in lexer.SPELLINGS.values() for s in spellings)
_CASES = " ".join(f"WHEN k IN ({', '.join(repr(s) for s in spellings)}) THEN '{name}'" for name, spellings in lexer.SPELLINGS.items())


def directives_sql(source: str, key: str) -> str:
    """CTEs up to directives, of a source with columns key and txt."""
    return rf"""
cut AS (SELECT {key}, regexp_split_to_array(regexp_replace(regexp_replace(replace(txt, chr(0), chr(10)), '^\xEF\xBB\xBF', ''), '(?:\r*\n|\r+)\z', ''), '\r*\n|\r+') AS l FROM {source} WHERE txt <> ''),
lined AS (SELECT {key}, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM cut),
keyed AS (SELECT *, lower(regexp_extract(line, '(?i)^[ \t]*({_KEYS})(?:[ \t]*:|[ \t]+)([^#]*)', 1)) AS k,
  regexp_replace(regexp_extract(line, '(?i)^[ \t]*({_KEYS})(?:[ \t]*:|[ \t]+)([^#]*)', 2), '^\s+|\s+$', '', 'g') AS v FROM lined),
kinds AS (SELECT *, CASE {_CASES} ELSE 'unknown' END AS kind0 FROM keyed),
directives AS (SELECT {key}, pos::INT AS pos, CASE WHEN kind0 = 'disallow' AND v = '' THEN 'allow' ELSE kind0 END AS kind,
  CASE WHEN kind0 = 'unknown' THEN line WHEN kind0 = 'disallow' AND v = '' THEN '/' ELSE v END AS value FROM kinds)"""


_SAMPLES = "samples(robots_id, txt) AS (VALUES " + ", ".join(f"({i}::BIGINT, {_text(t)})" for i, t in SAMPLES) + ")"
_AGENTS = "agents(agent) AS (VALUES " + ", ".join(f"('{a}')" for a in AGENTS) + ")"
_POLICY = rf"""WITH {_SAMPLES}, {_AGENTS}, {directives_sql("samples", "robots_id")},
member AS (SELECT * FROM directives WHERE kind IN ('user-agent', 'allow', 'disallow', 'crawl-delay')),
opened AS (SELECT *, CASE WHEN kind = 'user-agent' AND coalesce(lag(kind) OVER (PARTITION BY robots_id ORDER BY pos), '') <> 'user-agent' THEN 1 ELSE 0 END AS o FROM member),
groups AS (SELECT robots_id, pos, kind, CASE WHEN kind = 'user-agent' THEN lower(value) ELSE value END AS value, sum(o) OVER (PARTITION BY robots_id ORDER BY pos) AS grp FROM opened),
selected AS (SELECT s.robots_id, a.agent, coalesce((SELECT arg_max(g.value, strlen(g.value)) FROM groups g WHERE g.robots_id = s.robots_id AND g.kind = 'user-agent' AND starts_with(lower(trim(a.agent)), g.value)), '*') AS selected FROM samples s CROSS JOIN agents a),
held AS (SELECT g.robots_id, s.agent, s.selected, g.pos, g.kind, g.value FROM groups g JOIN selected s ON s.robots_id = g.robots_id WHERE g.kind <> 'user-agent' AND
  CASE WHEN g.grp = 0 THEN s.selected = '*' ELSE EXISTS (SELECT 1 FROM groups u WHERE u.robots_id = g.robots_id AND u.grp = g.grp AND u.kind = 'user-agent' AND u.value = s.selected) END),
rules0 AS (SELECT robots_id, agent, selected, pos, kind = 'allow' AS allow, {norm_sql("value")} AS pattern FROM held WHERE kind IN ('allow', 'disallow')),
rules AS (SELECT *, {like_sql("pattern")} AS lp FROM rules0 WHERE ({kind_sql("pattern")}) IS NOT NULL),
numbers AS (SELECT robots_id, agent, pos, CASE WHEN regexp_full_match(value, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') AND try_cast(value AS DOUBLE) >= 0 THEN try_cast(value AS DOUBLE) END AS s FROM held WHERE kind = 'crawl-delay'),
delays AS (SELECT n.robots_id, n.agent, min(n.s) AS crawl_delay FROM numbers n WHERE n.s IS NOT NULL AND NOT EXISTS (SELECT 1 FROM numbers b WHERE b.robots_id = n.robots_id AND b.agent = n.agent AND b.s IS NULL AND b.pos > n.pos) GROUP BY ALL),
maps AS (SELECT robots_id, row_number() OVER (PARTITION BY robots_id ORDER BY pos) - 1 AS pos, value AS sitemap FROM directives WHERE kind = 'sitemap'),
counted AS (SELECT s.robots_id, s.agent, s.selected, count(r.pos) AS n, count(r.pos) FILTER (r.allow) AS yes, count(r.pos) FILTER (regexp_replace(r.pattern, '\*+', '*', 'g') IN ('/', '/*', '/*$')) AS wide
  FROM selected s LEFT JOIN rules r ON r.robots_id = s.robots_id AND r.agent = s.agent GROUP BY ALL),
stats AS (SELECT *, CASE WHEN yes = n THEN true WHEN yes = 0 AND wide > 0 THEN false END AS always FROM counted)
"""
_HOST = rf"""{_LINES}, rules AS (SELECT *, {like_sql("pattern")} AS lp FROM (SELECT DISTINCT host_id, {norm_sql("j.f[3]")} AS pattern, lower(j.f[4]) = 'true' AS allow FROM judged j JOIN raw_lines USING (line_id) WHERE reason IS NULL AND j.feed = 'rule') WHERE ({kind_sql("pattern")}) IS NOT NULL),
paths AS (SELECT entry_id, host_id, {norm_sql(path_sql("loc"))} AS path FROM entry_listings WHERE loc IS NOT NULL),
hit AS (SELECT p.entry_id, any_value(p.path) AS path, arg_max(r.allow, strlen(r.pattern) * 2 + r.allow::INT) AS allow, max(strlen(r.pattern)) AS len FROM paths p LEFT JOIN rules r ON r.host_id = p.host_id AND p.path LIKE r.lp ESCAPE '!' GROUP BY p.entry_id)
"""
_CLEAN = rf"""{_LINES}, clean AS (SELECT DISTINCT host_id::VARCHAR || '/' || j.f[1] AS robots_id, lower(j.f[2]) AS agent, {norm_sql("j.f[3]")} AS pattern, lower(j.f[4]) = 'true' AS allow
  FROM judged j JOIN raw_lines USING (line_id) WHERE reason IS NULL AND j.feed = 'rule' AND NOT regexp_matches(j.f[2], '[#\r\n]|^\s|\s$|^$') AND NOT regexp_matches({norm_sql("j.f[3]")}, '[#\r\n]'))
"""
_TIDY = r"regexp_replace(regexp_replace(loc, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '[\t\n\r]', '', 'g')"
ORACLES = {
    "robots_verdict": _HOST + "SELECT entry_id, CASE WHEN path = '/robots.txt' THEN true ELSE coalesce(allow, true) END AS allowed FROM hit",
    "robots_try_verdict": _HOST + "SELECT entry_id, CASE WHEN path = '/robots.txt' THEN true ELSE allow END AS verdict FROM hit",
    "robots_first_rule": _HOST + "SELECT entry_id, len::INT AS len, allow FROM hit WHERE len IS NOT NULL",
    "robots_lex": f"WITH {_SAMPLES}, {directives_sql('samples', 'robots_id')} SELECT * FROM directives",
    "robots_lex_documents": f"WITH texts AS (SELECT doc_id, text AS txt FROM documents), {directives_sql('texts', 'doc_id')} SELECT doc_id, kind, count(*) AS n FROM directives GROUP BY ALL",
    "robots_groups": _POLICY + "SELECT robots_id, agent, selected, pos, pattern, allow FROM rules",
    "robots_text_verdict": _POLICY + f""", paths AS (SELECT entry_id, entry_id % {len(SAMPLES)} + 1 AS robots_id, {norm_sql(path_sql("loc"))} AS path FROM entry_listings WHERE loc IS NOT NULL),
hit AS (SELECT p.entry_id, s.agent, any_value(p.path) AS path, arg_max(r.allow, strlen(r.pattern) * 2 + r.allow::INT) AS allow FROM paths p JOIN selected s ON s.robots_id = p.robots_id
  LEFT JOIN rules r ON r.robots_id = p.robots_id AND r.agent = s.agent AND p.path LIKE r.lp ESCAPE '!' GROUP BY ALL)
SELECT entry_id, agent, CASE WHEN path = '/robots.txt' THEN true ELSE allow END AS verdict, CASE WHEN path = '/robots.txt' THEN true ELSE coalesce(allow, true) END AS allowed FROM hit""",
    "robots_delay": _POLICY + "SELECT robots_id, agent, crawl_delay FROM delays",
    "robots_sitemaps": _POLICY + "SELECT robots_id, pos, sitemap FROM maps",
    "robots_policy_stats": _POLICY + "SELECT robots_id, agent, selected, always, CASE WHEN always IS NULL THEN n ELSE -1 END AS n_rules, CASE WHEN always IS NULL THEN n = 0 END AS is_empty FROM stats",
    "robots_access": rf"""SELECT entry_id, CASE lower(access_result) WHEN 'redirect' THEN true WHEN 'unavailable' THEN true WHEN 'unreachable' THEN false
  ELSE NOT starts_with({norm_sql(path_sql("loc"))}, '/docs') END AS allowed FROM entry_listings JOIN hosts USING (host_id) WHERE loc IS NOT NULL""",
    "robots_wildcard_kind": _LINES + f"SELECT line_id, pattern, {kind_sql('pattern')} AS kind, {like_sql('pattern')} AS like_pattern FROM (SELECT line_id, {norm_sql('f[3]')} AS pattern FROM judged WHERE reason IS NULL AND feed = 'rule')",
    "path_normalize": f"SELECT entry_id, {norm_sql(path_sql('loc'))} AS normalized FROM entry_listings WHERE loc IS NOT NULL",
    "robots_location": rf"""WITH t AS (SELECT entry_id, {_TIDY} AS u FROM entry_listings WHERE loc IS NOT NULL),
s AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme, regexp_replace(regexp_extract(u, '(?i)^https?://([^/?#]*)', 1), '^.*@', '') AS host FROM t),
e AS (SELECT *, CASE WHEN scheme = '' THEN 'Url' WHEN scheme NOT IN ('http', 'https') AND NOT regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.\-]*:/') THEN 'CannotBeBase' WHEN scheme NOT IN ('http', 'https') THEN 'WrongScheme'
  WHEN NOT regexp_matches(host, '(?i)^[^\s<>\[\]|\\^%:]+(:[0-9]{{0,5}})?$') THEN 'Url' END AS error FROM s)
SELECT entry_id, CASE WHEN error IS NULL THEN scheme || '://' || regexp_replace(regexp_replace(lower(host), CASE scheme WHEN 'http' THEN ':0*80$' ELSE ':0*443$' END, ''), ':$', '') || '/robots.txt' END AS robots_url, error FROM e""",
    "robots_build": _CLEAN + r""", g AS (SELECT robots_id, agent, '# one group' || chr(10) || 'User-Agent: ' || agent || coalesce(chr(10) || string_agg('Disallow: ' || pattern, chr(10) ORDER BY pattern) FILTER (NOT allow), '')
  || coalesce(chr(10) || string_agg('Allow: ' || pattern, chr(10) ORDER BY pattern) FILTER (allow), '') AS t FROM clean GROUP BY robots_id, agent)
SELECT robots_id, '# made from rules' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY agent) || chr(10) || chr(10) || '# end' AS txt FROM g GROUP BY robots_id""",
    "robots_build_parse": _CLEAN + rf""", {_AGENTS}, docs AS (SELECT DISTINCT robots_id FROM clean), fit AS (SELECT d.robots_id, a.agent, arg_max(c.agent, strlen(c.agent)) AS hit FROM docs d CROSS JOIN agents a LEFT JOIN clean c ON c.robots_id = d.robots_id AND starts_with(lower(a.agent), c.agent) GROUP BY ALL),
ok AS (SELECT * FROM clean WHERE ({kind_sql("pattern")}) IS NOT NULL)
SELECT f.robots_id, f.agent, coalesce(f.hit, '*') AS selected, (SELECT count(*) FROM ok c WHERE c.robots_id = f.robots_id AND c.agent = coalesce(f.hit, '*'))::INT AS n_rules FROM fit f""",
    "robots_cache_roundtrip": _POLICY + """SELECT s.robots_id, s.agent, s.selected, s.always, CASE WHEN s.always IS NULL THEN s.yes ELSE -1 END AS n_allow, CASE WHEN s.always IS NULL THEN s.n - s.yes ELSE -1 END AS n_disallow,
  d.crawl_delay, (SELECT count(*) FROM maps m WHERE m.robots_id = s.robots_id) AS n_sitemaps, NULL::VARCHAR AS error FROM stats s LEFT JOIN delays d ON d.robots_id = s.robots_id AND d.agent = s.agent""",
}

# the same over the documents that are made from the loaded lines
_LOADED = rf"""samples AS ({_CLEAN}, waits AS (SELECT DISTINCT host_id::VARCHAR || '/' || j.f[1] AS robots_id, lower(j.f[2]) AS agent, j.f[3] AS delay
  FROM judged j JOIN raw_lines USING (line_id) WHERE reason IS NULL AND j.feed = 'delay' AND NOT regexp_matches(j.f[2], '[#\r\n]|^\s|\s$|^$')),
said AS (SELECT robots_id, agent, string_agg('Disallow: ' || pattern, chr(10) ORDER BY pattern) FILTER (NOT allow) AS no, string_agg('Allow: ' || pattern, chr(10) ORDER BY pattern) FILTER (allow) AS yes FROM clean GROUP BY ALL),
waited AS (SELECT robots_id, agent, string_agg('Crawl-Delay: ' || delay, chr(10) ORDER BY delay) AS d FROM waits GROUP BY ALL),
g AS (SELECT robots_id, agent, concat_ws(chr(10), '# one group', 'User-Agent: ' || agent, d, no, CASE WHEN no IS NULL AND yes IS NULL THEN 'Allow: *' ELSE yes END) AS t FROM said FULL JOIN waited USING (robots_id, agent))
SELECT robots_id, '# made from rules' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY agent) || chr(10) || chr(10) || '# end' AS txt FROM g GROUP BY robots_id)"""
for _name in ("robots_lex", "robots_groups", "robots_delay", "robots_policy_stats", "robots_cache_roundtrip"):
    ORACLES[f"{_name}_loaded"] = ORACLES[_name].replace(_SAMPLES, _LOADED, 1)
_NUMBERED = f"""paths AS (SELECT e.entry_id, n.robots_id, {norm_sql(path_sql("e.loc"))} AS path FROM entry_listings e JOIN (SELECT robots_id, string_split(robots_id, '/')[1]::BIGINT AS host_id,
  row_number() OVER (PARTITION BY string_split(robots_id, '/')[1] ORDER BY robots_id) - 1 AS k, count(*) OVER (PARTITION BY string_split(robots_id, '/')[1]) AS n FROM samples) n ON n.host_id = e.host_id AND e.entry_id % n.n = n.k WHERE e.loc IS NOT NULL),
hit AS"""
_text_verdict = ORACLES["robots_text_verdict"].replace(_SAMPLES, _LOADED, 1)
ORACLES["robots_text_verdict_loaded"] = _text_verdict[: _text_verdict.index("paths AS (")] + _NUMBERED + _text_verdict.split("hit AS", 1)[1]
_MAPPED = r"""samples AS (WITH m AS (SELECT *, floor(sum(strlen(loc) + 10) OVER (PARTITION BY host_id ORDER BY loc) / 256000)::BIGINT AS part
  FROM (SELECT DISTINCT host_id, loc FROM index_listings WHERE NOT regexp_matches(loc, '[#\r\n]|^\s|\s$|^$')))
SELECT host_id::VARCHAR || '/' || part AS robots_id, 'User-Agent: *' || chr(10) || 'Allow: *' || chr(10) || chr(10) || string_agg('Sitemap: ' || loc, chr(10) ORDER BY loc) AS txt FROM m GROUP BY ALL)"""
ORACLES["robots_sitemaps_loaded"] = ORACLES["robots_sitemaps"].replace(_SAMPLES, _MAPPED, 1)
ORACLES["robots_relative"] = ORACLES["robots_text_verdict"]
ORACLES["robots_equal"] = _POLICY.replace(_SAMPLES, _LOADED, 1) + """, essence AS (SELECT s.robots_id, s.agent, s.selected, d.crawl_delay,
  coalesce((SELECT string_agg(r.pattern || chr(10) || r.allow, chr(10) ORDER BY r.pattern, r.allow) FROM rules r WHERE r.robots_id = s.robots_id AND r.agent = s.agent), '') AS r
  FROM selected s LEFT JOIN delays d ON d.robots_id = s.robots_id AND d.agent = s.agent)
SELECT a.robots_id, a.agent, b.selected = a.selected AND b.r = a.r AND a.crawl_delay IS NOT DISTINCT FROM b.crawl_delay AS same, b.r = a.r AND a.crawl_delay IS NOT DISTINCT FROM b.crawl_delay AS same_rules
FROM essence a JOIN essence b ON b.robots_id = a.robots_id AND b.agent = '*'"""
ORACLES["robots_cache_errors"] = _LINES + f"""SELECT line_id, CASE line_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'both' WHEN 2 THEN 'missing' WHEN 3 THEN 'duplicate' WHEN 4 THEN 'invalid' END AS error,
  CASE WHEN line_id % 6 = 5 THEN false END AS always, CASE WHEN line_id % 6 = 0 THEN CASE WHEN ({kind_sql(norm_sql("f[3]"))}) IS NULL THEN 0 ELSE 1 END ELSE -1 END AS n_rules
FROM judged WHERE reason IS NULL AND feed = 'rule'"""
