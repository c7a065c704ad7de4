import pytest

from docketry.llm.queries import oracle_sql, queries

from ..conftest import SMALL

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(queries()))
def test_runs_on_the_small_tables(spark, name):
    assert queries()[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_agrees_with_sql(spark, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    rel = con.sql(oracle_sql()[name])
    df = queries()[name](spark, SMALL).select(*rel.columns)
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_every_record_has_one_split(spark):
    out = queries()["p1_splits"](spark, SMALL)
    assert out.count() == out.select("gold_id").distinct().count()
    assert out.filter("section_id is not null").groupBy("section_id").agg({"split": "min"}).count() == out.filter("section_id is not null").select("section_id", "split").distinct().count()
