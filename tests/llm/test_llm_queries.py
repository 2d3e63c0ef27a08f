import os

import pytest

queries = pytest.importorskip("waymark.llm.queries")
pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    if name not in queries.ORACLES:
        assert df.count() > 0
        return
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    answer = con.execute(queries.ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(answer.fetchall())


def test_every_document_has_ids(spark):
    assert queries.p6_ids(spark, FOLDER).where("ids is not null").count() == queries.table(spark, FOLDER, "documents").count()
