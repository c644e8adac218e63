"""The driver's contract: every query with SQL equals DuckDB's result on small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from jobs import queries as jobs
from tideline.operators.selection import preset
from tideline.plans import catalogue, oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
QUERIES, ORACLE_SQL = catalogue.QUERIES | jobs.QUERIES, oracle.ORACLE_SQL | jobs.ORACLE_SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def tidy(rows):
    cell = lambda v: (None if v != v else round(v, 5) + 0.0) if isinstance(v, float) else v
    return sorted((tuple((k, cell(r[k])) for k in sorted(r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert tidy(got.to_dict("records")) == tidy(want.to_dict("records"))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_wide_full_row_holds_the_rows_that_sql_proves(spark, duck):
    got = {r.seg: r.asDict() for r in catalogue.QUERIES["wide_full_row"](spark, SF).collect()}
    seen = set()
    for name in ("wide_sql_row", "ms_features_fixed"):
        want = duck.execute(oracle.ORACLE_SQL[name]).df()
        seen |= set(want.columns)
        assert sorted(got) == sorted(want.seg)
        for row in want.to_dict("records"):
            for k in set(row) & set(got[row["seg"]]):
                mine, v = got[row["seg"]][k], row[k]
                assert (mine is None and v != v) or mine == pytest.approx(v, abs=2e-5), (name, k)
    whole = set(next(iter(got.values())))
    assert whole == {"seg", *preset("full").computable()} and all(k.startswith(("plv", "rasm")) for k in whole - seen)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_works_without_llm(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "tideline.llm.queries", None)  # its import raises ImportError
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry_module.queries()) == set(QUERIES) and set(entry_module.oracle_sql()) == set(ORACLE_SQL)


def test_clusters_must_name_a_shared_folder():
    from types import SimpleNamespace

    from tideline.session import shared_dir

    session = lambda master, at: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: at), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(session("local[2]", None)).startswith("file:/") and shared_dir(session("yarn", "hdfs:/x/")) == "hdfs:/x"
    with pytest.raises(RuntimeError):
        shared_dir(session("yarn", None))
