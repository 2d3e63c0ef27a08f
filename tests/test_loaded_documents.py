"""The documents that the `_loaded` queries read hold what the tables' lines say."""

import os

import pytest
from pyspark.sql import functions as F
from waymark.plans import policies, preparation
from waymark.robots import lexer, policy

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGER), reason="the tables aren't here")


def test_every_rule_and_delay_reaches_a_document(spark):
    directives = lexer.lex(policies.loaded_documents(spark, SMALL))
    fit = ~F.col("agent").rlike(r"[#\r\n]|^\s|\s$|^$")
    delays = preparation.loaded_lines(preparation.table(spark, SMALL, "raw_lines"), "delay", keep=("host_id",)).where(fit)
    assert directives.where("kind = 'crawl-delay'").count() == delays.select("host_id", "robots_id", F.lower("agent"), "crawl_delay").distinct().count() > 0
    rules = policies._clean_rules(spark, SMALL)
    only_delays = delays.select(F.concat_ws("/", "host_id", "robots_id").alias("robots_id"), F.lower("agent").alias("agent")).distinct().join(rules, ["robots_id", "agent"], "left_anti")
    assert directives.where("kind in ('allow', 'disallow')").count() == rules.count() + only_delays.count()


def test_the_queries_follow_the_tables(spark):
    for name in ("robots_lex", "robots_delay", "robots_sitemaps"):
        small, larger = (policies.QUERIES[f"{name}_loaded"](spark, folder).count() for folder in (SMALL, LARGER))
        assert 0 < small < larger, name


def test_an_empty_delay_undoes_no_number(spark):
    text = "User-Agent: *\nCrawl-Delay: \nCrawl-Delay: 5\nCrawl-Delay: 7\n"
    documents = spark.createDataFrame([("1/1", bytearray(text.encode()))], "robots_id string, content binary")
    assert policy.policies(documents, policies.agents(spark).where("agent = '*'")).first().crawl_delay == 5
