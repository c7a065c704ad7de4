import math
import os
import subprocess
import sys
from pathlib import Path

import pytest

from .conftest import SMALL

duckdb = pytest.importorskip("duckdb")
ROOT = Path(__file__).resolve().parent.parent


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, (int, bool, str)) else str(v)


def _catalogue():
    from docketry.operators.queries import queries as multi
    from docketry.plans import catalogue

    return catalogue.queries() | multi(), catalogue.oracle_sql()


NAMES = sorted(_catalogue()[0]) if os.path.isdir(SMALL) else []


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(SMALL):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    queries, sql = _catalogue()
    df = queries[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    if name in sql:
        rel = con.sql(sql[name])
        at = [rel.columns.index(c) for c in cols]
        assert sorted(rel.columns) == cols
        assert got == sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=repr)


def test_core_needs_no_training_subpackage():
    code = "import sys; sys.modules['docketry.llm'] = None; import docketry.plans.catalogue as c, docketry.operators.queries; print(len(c.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) > 40
    for p in (ROOT / "docketry").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "docketry.llm" not in p.read_text() and "from .llm" not in p.read_text() and "from ..llm" not in p.read_text()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_job_entry(spark, tmp_path, capsys):
    from docketry.__main__ import main

    assert main(["list"]) == 0 and "q_link_top1" in capsys.readouterr().out
    assert main(["nothing"]) == 2
    assert main(["q_scope_funnel", SMALL, str(tmp_path / "o"), "csv"]) == 0 and spark.read.option("header", True).csv(str(tmp_path / "o")).count() > 0


def test_top3_is_registered_and_begins_with_top1(spark):
    queries, sql = _catalogue()
    assert "q_link_top3" in sql
    top = [tuple(r) for r in queries["q_link_top3"](spark, SMALL).collect()]
    assert sorted(r[:3] for r in top if r[3] == 1) == sorted(map(tuple, queries["q_link_top1"](spark, SMALL).collect())) and max(r[3] for r in top) == 3
