from pathlib import Path

import duckdb
import pytest

from quire.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def data():
    if not DATA.exists():
        pytest.skip("no test tables here")
    return str(DATA)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, data, name):
    c = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    theirs = c.execute(queries.SQL[name])
    names = [x[0] for x in theirs.description]
    got = queries.QUERIES[name](spark, data)
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == sorted(theirs.fetchall(), key=repr)


COLUMNS = {
    "p1_found": ["translation_id", "defect_type"], "p4_found": ["fragment_id", "region_id"], "p7_found": ["doc_id", "item_id"],
    "p6_containers": ["budget_id", "doc_id", "piece", "container_id", "container_offset", "item_offset", "n_tokens"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, data, name):
    got = queries.QUERIES[name](spark, data)
    held = got.collect()
    assert got.columns == COLUMNS[name] and held and len({tuple(r) for r in held}) == len(held)


def test_every_text_has_its_place(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet").select("doc_id").distinct().count()
    places = queries.p6_containers(spark, data).groupBy("budget_id").agg({"doc_id": "count"})
    assert {r[0] for r in places.collect()} == {1, 2, 3, 4}
    per = queries.p6_containers(spark, data).select("budget_id", "doc_id").distinct().groupBy("budget_id").count().collect()
    assert all(r["count"] == documents for r in per)
