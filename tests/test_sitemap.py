from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F
from waymark import counting
from waymark.sitemap import build, parse, records
from waymark.sources.files import read_documents, read_robots, write_documents
from waymark.streaming.documents import stream_directives, stream_documents, stream_entries

HEAD = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'


def doc(spark, *texts):
    return spark.createDataFrame([(f"https://d/{i}", bytearray(t.encode()) if t is not None else None) for i, t in enumerate(texts)], "url string, content binary")


def entries(spark, *bodies):
    return [(r.loc, r.lastmod, r.lastmod_offset_min, r.priority, r.changefreq) for r in parse.xml_records(doc(spark, *bodies)).orderBy("url", "pos").collect()]


def locs(spark, body):
    return [e[0] for e in entries(spark, HEAD + body)]


def test_urlset(spark):
    body = HEAD + "<url><loc>https://melti.example/a/b?c=1</loc><changefreq> Weekly </changefreq><lastmod>2021-03-04T05:06:07.5+01:00</lastmod><priority>0.7</priority></url><url><loc>https://b.example</loc><lastmod>2022-09-08</lastmod><priority> 0.6 </priority></url></urlset>"
    got = entries(spark, body)
    assert got[0][:3] == ("https://melti.example/a/b?c=1", datetime(2021, 3, 4, 4, 6, 7, 500000), 60) and round(got[0][3], 6) == 0.7 and got[0][4] == "weekly"
    assert got[1] == ("https://b.example/", datetime(2022, 9, 8), 0, None, None)


def test_records_and_damage(spark):
    assert locs(spark, "<url><lastmod>x</lastmod></url><url><loc><![CDATA[https://a.a/]]></loc></url><url><loc>https://b.b/<!-- c -->tail</loc></url>") == []
    assert locs(spark, "<url><loc>https://a.a/</loc><loc>https://b.b/</loc></url><URL><loc>https://c.c/</loc></URL><url><image:loc>https://d.d/</image:loc></url>") == ["https://b.b/"]
    assert locs(spark, "<url><loc>https://a.a/?x=1&y</loc></url><url><loc>https://b.b/?x=1&amp;y</loc></url></urlset>") == ["https://b.b/?x=1&y"]
    assert locs(spark, "<url><loc>https://a.a/</loc></url><url><loc>https://b.b/</loc></wrong></url><url><loc>https://c.c/</loc></url>") == ["https://a.a/"]
    assert locs(spark, "<url><loc>https://a.a/</loc></url><url><loc>https://b.b/</loc>") == ["https://a.a/", "https://b.b/"]
    assert parse.xml_records(doc(spark, None, "", "x")).count() == 0
    assert [e[0] for e in entries(spark, "<!-- c --><URLSET><url><loc>https://a.a/</loc></url></URLSET>")] == ["https://a.a/"]


def test_record_limit(spark):
    body = HEAD + "".join(f"<url><loc>https://a.a/{i}</loc></url>" for i in range(50_001)) + "</urlset>"
    assert parse.xml_records(doc(spark, body)).count() == 50_000
    assert parse.plain_records(doc(spark, "\n".join(f"https://a.a/{i}" for i in range(50_001)))).count() == 50_000


def test_plain_and_kinds(spark):
    got = parse.plain_records(doc(spark, "https://a.a/1\r\n  https://a.a/2\n\nnope\nftp://x/\n")).orderBy("pos").collect()
    assert [(r.pos, r["loc"]) for r in got] == [(0, "https://a.a/1"), (1, "https://a.a/2")]
    kinds = doc(spark, HEAD, '﻿<?xml version="1.0"?>\n<SitemapIndex >', "https://a.a", "<html>", "", None).select("url", parse.kind(F.col("content")))
    assert [r[1] for r in rows(kinds)] == ["urlset", "sitemapindex", "plain", None, None, None]


def test_expand(spark):
    index = lambda *u: '<sitemapindex xmlns="x">' + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    one = lambda u: f"{HEAD}<url><loc>{u}</loc></url></urlset>"
    docs = doc(spark, index("https://d/1", "https://d/2", "https://d/5", "https://d/missing"), one("https://a.a/1"), "https://a.a/2\nhttps://a.a/3", one("https://a.a/4"), "<html>", index("https://d/3"))
    roots = spark.createDataFrame([("https://d/0",), ("https://d/3",), ("https://d/4",), ("https://d/none",), ("https://d/0",)], "url string")
    assert rows(parse.expand(roots, docs).select("root", "loc")) == [("https://d/0", "https://a.a/1"), ("https://d/0", "https://a.a/2"), ("https://d/0", "https://a.a/3"), ("https://d/3", "https://a.a/4")]
    assert parse.expand(roots.where("false"), docs).count() == 0


def test_build_round_trip(spark):
    data = [(1, "https://a.a/?x=1&y=<2>", datetime(2022, 9, 8, 14, 43, 13, 129000), -240, 0.25, "daily"), (1, "https://a.a/2", None, None, None, None), (1, None, None, None, 0.5, None), (2, "https://b.b/'\"", datetime(2020, 1, 1), 345, 1.0, None)]
    df = spark.createDataFrame(data, "host_id int, " + records.ENTRY)
    xml = build.entry_sitemaps(df).orderBy("host_id").collect()
    assert xml[0].xml == "﻿" + HEAD + "<url><loc>https://a.a/2</loc></url><url><loc>https://a.a/?x=1&amp;y=&lt;2&gt;</loc><lastmod>2022-09-08T10:43:13.12-04:00</lastmod><priority>0.2</priority><changefreq>daily</changefreq></url></urlset>"
    back = parse.xml_records(spark.createDataFrame(xml).select("host_id", "xml"), "urlset", "host_id", "xml")
    assert rows(back.select("host_id", "loc", "lastmod", "lastmod_offset_min"))[1:] == [(1, "https://a.a/?x=1&y=%3C2%3E", datetime(2022, 9, 8, 14, 43, 13, 120000), -240), (2, "https://b.b/'%22", datetime(2020, 1, 1), 345)]
    assert build.plain_sitemaps(df).where("host_id = 2").first().txt == "https://b.b/'\"\n"
    assert build.entry_sitemaps(df.where("false")).count() == 0


def test_shards_keep_both_limits(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, 1).otherwise(2).alias("host_id"), F.concat(F.lit("https://a.a/"), "id").alias("loc"))
    files = build.sharded(df, "host_id", F.octet_length("loc"), 100, 900).groupBy("host_id", "shard").agg(F.count("*").alias("n"), F.sum(F.octet_length("loc")).alias("b"))
    assert files.where("n > 100 or b > 900").count() == 0 and files.agg(F.sum("n")).first()[0] == 3000


def test_frequency_and_priority(spark):
    day = datetime(2022, 9, 12, 12)
    df = spark.createDataFrame([(" Monthly ", day), ("always", day), ("never", day), ("hourly", day), ("sometimes", day), (None, None)], "f string, d timestamp").withColumn("f", records.frequency(F.col("f")))
    got = df.select("f", records.next_date(F.col("f"), F.col("d")), records.is_outdated(F.col("f"), F.col("d"), F.lit(datetime(2022, 10, 12, 12)))).collect()
    assert [tuple(r) for r in got] == [("monthly", datetime(2022, 10, 12, 12), True), ("always", None, True), ("never", None, False), ("hourly", datetime(2022, 9, 12, 13), True), (None, None, None), (None, None, None)]
    text = spark.createDataFrame([(t,) for t in ("0.6", "1.5", " 0.6 ", "NaN", "0.6d", "", None, "1", ".5")], "t string").select(records.parsed_priority(F.col("t")).alias("p"))
    assert [None if r.p is None else round(r.p, 3) for r in text.collect()] == [0.6, None, None, None, None, None, None, 1.0, 0.5]
    number = spark.createDataFrame([(2.6,), (-1.0,), (float("nan"),), (None,), (0.6,)], "x float").select(records.clamped_priority(F.col("x")).alias("c"), records.priority(F.col("x")).alias("p"))
    assert [(None if r.c is None else round(r.c, 3), r.p is None) for r in number.collect()] == [(1.0, True), (0.0, True), (0.0, True), (None, True), (0.6, False)]
    shown = spark.createDataFrame([(0.25,), (0.75,), (1.0,)], "x float").select(records.priority_text(F.col("x")).alias("t"))
    assert [r.t for r in shown.collect()] == ["0.2", "0.8", "1.0"]


def test_counting(spark):
    df = spark.createDataFrame([("Hello World!", "ab"), (None, "é")], "r string, w string")
    seen, counter = counting.observed(df, F.col("r"), F.col("w"), (1, 0))
    seen.collect()
    assert counter.get == {"reader_bytes": 13, "writer_bytes": 4, "total_bytes": 17}
    assert rows(counting.byte_counts(df, F.lit("all"), F.col("r"), F.col("w"))) == [("all", 12, 4, 16)]


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"User-agent: *\nDisallow: /x\n")
    (tmp_path / "in/b.xml").write_text(HEAD + "<url><loc>https://a.a/</loc></url></urlset>")
    assert read_documents(spark, str(tmp_path / "in")).count() == 2 and read_robots(spark, str(tmp_path / "in"), "*.txt").count() == 1
    for name, stream in (("d", stream_directives(stream_documents(spark, str(tmp_path / "in"), "*.txt"))), ("e", stream_entries(stream_documents(spark, str(tmp_path / "in"), "*.xml")))):
        query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert [(r.kind, r.value) for r in spark.table("d").orderBy("pos").collect()] == [("user-agent", "*"), ("disallow", "/x")]
    assert [r["loc"] for r in spark.table("e").collect()] == ["https://a.a/"]
    write_documents(spark.createDataFrame([("h", "x\ny")], "name string, content string"), str(tmp_path / "out"))
    data = [("h", b"x\ny"), ("d/k.txt", "é".encode()), ("d/e", b""), (None, b"x"), ("n", None)]
    assert write_documents(spark.createDataFrame(data, "name string, content binary"), f"file://{tmp_path}/out") == (3, 5)
    assert {str(f.relative_to(tmp_path / "out")): f.read_bytes() for f in (tmp_path / "out").rglob("*") if f.is_file()} == {k: v for k, v in data[:3]}


def test_no_file_is_over_its_limits(spark):
    data = [(1, f"https://a.a/{i:03d}" + "x" * (500 if i < 40 else 0)) for i in range(400)]  # large records, then small ones
    df = spark.createDataFrame(data, "host_id int, loc string")
    files = build.sharded(df, "host_id", F.octet_length("loc"), 50, 2_000).groupBy("host_id", "shard").agg(F.count("*").alias("n"), F.sum(F.octet_length("loc")).alias("b"))
    assert files.where("n > 50 or b > 2000").count() == 0 and files.agg(F.sum("n")).first()[0] == 400


def test_a_long_comment_before_the_root(spark):
    long = "<!-- " + "x <urlset> " * 10_000 + "-->"
    body = "<url><loc>https://a.a/1</loc></url></urlset>"
    docs = doc(spark, long + HEAD + body, "<!-- c -->\n" * 9_000 + HEAD + body, "a <!-- b --> <urlset>", long)
    assert [r[1] for r in rows(docs.select("url", parse.kind(F.col("content"))))] == ["urlset", "urlset", "plain", "plain"]
    assert parse.xml_records(docs).count() == 2


def test_over_limits_and_what_is_missing(spark):
    many = HEAD + "<!-- <url> -->" + "".join(f"<url><loc>https://a.a/{i}</loc></url>" for i in range(50_001)) + "</urlset>"
    docs = doc(spark, many, "\n".join(["https://a.a/1"] * 50_002) + "\n", "https://a.a/1", None)
    assert rows(parse.over_limits(docs)) == [("https://d/0", "EntryLimit", 1), ("https://d/1", "EntryLimit", 2)]
    assert rows(parse.over_limits(docs, record_limit=10**6, byte_limit=700_000).select("url", "error")) == [("https://d/0", "ByteLimit"), ("https://d/1", "ByteLimit")]
    index = lambda *u: '<sitemapindex xmlns="x">' + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    docs = doc(spark, index("https://d/1", "https://d/2", "https://d/9"), "<html>", index("https://d/3"))
    roots = spark.createDataFrame([("https://d/0",), ("https://d/2",), ("https://d/8",), (None,)], "url string")
    assert rows(parse.missing(roots, docs)) == [("https://d/0", "https://d/1", "unknown"), ("https://d/0", "https://d/2", "nested"), ("https://d/0", "https://d/9", "missing"), ("https://d/2", "https://d/3", "missing"), ("https://d/8", "https://d/8", "missing")]


def test_plain_limits_and_invalid_lines(spark):
    data = [("k", bytearray(b"https://a.a/1\nhttps://a.a/\xff\nhttps://a.a/3\nhttps://a.a/4\n"))]
    docs = spark.createDataFrame(data, "url string, content binary")
    found = lambda **o: [r["loc"][-1] for r in parse.plain_records(docs, **o).orderBy("pos").collect()]
    assert found() == ["1", "3", "4"] and found(record_limit=3) == ["1", "3"]
    assert found(byte_limit=1) == ["1"] and found(byte_limit=27) == ["1"] and found(byte_limit=28) == ["1", "3"] and found(byte_limit=41) == ["1", "3"] and found(byte_limit=42) == ["1", "3", "4"]


def test_constructors(spark):
    df = spark.createDataFrame([("https://a", 0.7), (None, 0.1), ("https://b", 7.0)], "u string, p float")
    got = [r.e for r in df.select(records.entry(F.col("u"), priority=records.effective_priority(F.col("p"))).alias("e")).collect()]
    assert got[1] is None and got[0]["loc"] == "https://a" and [round(g.priority, 2) for g in (got[0], got[2])] == [0.7, 0.5]
    assert df.select(records.index(F.col("u")).alias("i")).schema["i"].dataType.simpleString() == "struct<loc:string,lastmod:timestamp,lastmod_offset_min:int>"
    lines = spark.createDataFrame([("d", 0, "ab"), ("d", 1, "é"), ("e", 0, None)], "k string, n int, t string")
    assert rows(counting.consumed(lines, "k", "n", "t").select("k", "n", "consumed")) == [("d", 0, 3), ("d", 1, 6), ("e", 0, 1)]
