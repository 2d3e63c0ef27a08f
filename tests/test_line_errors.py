import csv
import random
import re
from itertools import product

import pytest
from conftest import rows
from pyspark.sql import functions as F
from waymark.operators.line_errors import FEEDS, cheapest_parse, cheapest_parses, failed_lines, fields_of, loaded_lines, valid_delay, valid_loc, valid_pattern

STRICT = re.compile(r'(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*"))*')


def test_fields_of_is_the_strict_grammar():
    for n in range(7):
        for chars in product('",a', repeat=n):
            line = "".join(chars)
            fields = fields_of(line)
            assert (fields is not None) == bool(STRICT.fullmatch(line)), line
            if fields is not None and line:
                assert fields == next(csv.reader([line])), line
            assert (cheapest_parse(line, 2)[0] == 0) == (fields is not None), line


def test_cost_is_the_least_number_of_edits():
    def edits(line):
        yield from (line[:i] + line[i + 1 :] for i in range(len(line)) if line[i] == '"')
        yield from (line[:i] + '"' + line[i:] for i in range(len(line) + 1))

    draw = random.Random(2)
    lines = ["".join(draw.choice('"",ab') for _ in range(draw.randint(1, 8))) for _ in range(300)]
    for line, (got, gap, operations) in zip(lines, cheapest_parses(lines, 2), strict=True):
        level, cost = {line}, 0
        while not any(STRICT.fullmatch(x) for x in level):
            level, cost = {y for x in level for y in edits(x)}, cost + 1
        assert got == cost, line
        assert gap == min(abs(len(fields_of(x)) - 2) for x in level if STRICT.fullmatch(x)), line
        assert sum("quote" in o for o in operations) == cost and sum("delimiter" in o for o in operations) == gap, (line, operations)


def test_edits_of_a_line_without_quotes_are_its_gap():
    for columns in (1, 3, 4):
        for n in range(8):
            line = "a," * n + "b"
            assert cheapest_parse(line, columns)[:2] == (0, abs(n + 1 - columns))


def apply_edits(line, operations):
    out = list(line)
    for edit, place in sorted(((o.rsplit(" at ", 1)[0], int(o.rsplit(" at ", 1)[1])) for o in operations), key=lambda e: -e[1]):
        if edit == "insert quote":
            out.insert(place, '"')
        elif edit == "delete quote":
            assert out.pop(place) == '"'
    return "".join(out)


def test_quote_edits_mend_the_line():
    draw = random.Random(5)
    lines = ["".join(draw.choice('""",,ab ') for _ in range(draw.randint(1, 30))) for _ in range(500)]
    for line, (quotes, gap, operations) in zip(lines, cheapest_parses(lines, 3), strict=True):
        mended = apply_edits(line, operations)
        assert STRICT.fullmatch(mended) and abs(len(fields_of(mended)) - 3) == gap, (line, operations)


@pytest.mark.parametrize(("line", "reason"), [
    ("1,*,5", None), ("1,*,5\r\n", None), ('"1","a,""b",".5"', None), ("1,*,", None), ("1,*,-0", None), ('1,"mel\nti",+3', None),
    ("1,*", "column_count"), ("", "column_count"), ("\r", "column_count"), ("1,*,5,", "column_count"), (None, "column_count"),
    ('1,"*,5', "quoting"), ('1,"*"x,5', "quoting"), ('1, "*",5', "quoting"), ('1,a"b', "quoting"), ('"', "quoting"),
    ("1,*,5s", "invalid_value"), ("1,*,-1", "invalid_value"), ("1,*,inf", "invalid_value"), ("1,*,1e999", "invalid_value"), ("1,*,５", "invalid_value"),
    ("1,*, 5", "invalid_value"), ("1,*,1_000", "invalid_value"), ("1,*,.", "invalid_value"), ("1,*,0x10", "invalid_value"),
])
def test_reasons(spark, line, reason):
    df = spark.createDataFrame([(1, "delay", line)], "line_id long, feed string, line string")
    assert [r.reason for r in failed_lines(df).collect()] == [reason] * (reason is not None)
    assert loaded_lines(df, "delay").count() == (reason is None)


def judged(spark, check, values):
    return [bool(r[0]) for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(check(F.col("v"))).collect()]


def test_values(spark):
    good = ["http://a", "HTTPS://A-b.c:65535/x y"[:-2], "https://a?q", "https://a#", "http://a:080/", "http://a:0", "https://a:0065535"]
    bad = ["", "http://", "https:///a", "ftp://a", "http:/a", " http://a", "http://a b", "http://a/　", "http://a:65536", "http://a:100000", "http://a:", "http://é", "http://a_b", "http://a/\n", "http://a\n", "http://[::1]/", "mailto:a", "httpſ://a"]
    assert all(judged(spark, valid_loc, good)) and not any(judged(spark, valid_loc, bad))
    assert all(judged(spark, valid_pattern, ["", "/", "/*$", "$", "a$"])) and not any(judged(spark, valid_pattern, ["$$", "/$x", "$a$"]))
    assert all(judged(spark, valid_delay, ["", "0", "-0", "10.", ".5", "1E-1", "+3"]))
    assert not any(judged(spark, valid_delay, ["+", "e5", "NaN", "1 ", "1e", "1e999", "1d", "0x1", "-1", "1\n"]))


def test_tables(spark):
    data = [(1, "delay", "7,*,5", "x", 9), (2, "delay", '"7,*,5', "x", 9), (3, "entry", "http://a,,,\r\n", "x", 9), (4, "entry", "a,,,", "x", 9), (5, None, "a", "x", 9), (6, "rule", None, "x", 9), (7, "rule", '1,k,"a,b",true', "x", 9), (8, "other", 'a"', "x", 9), (9, "delay", "é" * 20000 + '"', "x", 9)]
    df = spark.createDataFrame(data, "line_id long, feed string, line string, reason string, robots_id int")
    got = failed_lines(df)
    assert rows(got.select("line_id", "reason")) == [(2, "quoting"), (4, "invalid_value"), (5, "column_count"), (6, "column_count"), (8, "quoting"), (9, "quoting")]
    assert got.where("line_id = 2").first().detail in ("delete quote at 0", "insert quote at 2", "insert quote at 3")
    assert rows(loaded_lines(df, "rule")) == [(7, "1", "k", "a,b", "true")]
    assert rows(loaded_lines(df, "entry").select("line_id", "changefreq")) == [(3, "")]
    assert rows(failed_lines(df.where("false"))) == [] and rows(loaded_lines(df.where("false"), "delay")) == []


def test_details_and_one_python_pass(spark):
    lines = ["1,*", "1,*,5,6,7", '1,"*,5', '1,a"b', "", '1,"*"', '1,"a","b",c', '1,"*"' + ',"x"' * 3000, "1,*,9" + '"' * 5000]
    df = spark.createDataFrame([(i, "delay", x) for i, x in enumerate(lines)], "line_id long, feed string, line string")
    got = failed_lines(df)
    detail = {r.line_id: (r.reason, r.detail) for r in got.collect()}
    assert [detail[i] for i in (0, 1, 4, 5)] == [("column_count", "insert 1 delimiter"), ("column_count", "delete 2 delimiters"), ("column_count", "insert 2 delimiters"), ("column_count", "insert delimiter at 5")]
    assert detail[6][1].startswith("delete delimiter at ") and detail[7][1].count("delete delimiter") == 2999 and detail[8][0] == "quoting"
    assert failed_lines(df.limit(0)).count() == 0 and set(FEEDS) == {"entry", "rule", "delay"}
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
