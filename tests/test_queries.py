"""The queries against their SQL on the smallest tables, if they are there."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")

SOME = ["p3_found", "p3_paths", "p4_found", "p4_by_month", "module_rollup", "import_resolution", "cycles_len3", "calls_upsert_merge", "debt_breakdown", "contracts_eval", "genome_score", "session_windows", "redundancy_top5"]


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in DATA.iterdir():
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", SOME)
def test_equal(spark, con, name):
    df = entry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(entry.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)


#: What the SQL of queries that work on all rows leaves out.
CUTS = {"file_status": " where c.project_id = 3", "keyword_refs": " where id % 100 = 0", "module_mermaid": " where starts_with(x.module, '3:')"}


@pytest.mark.parametrize("name", CUTS)
def test_equal_over_all_rows(spark, con, name):
    df = entry.queries()[name](spark, str(DATA))
    sql = entry.oracle_sql()[name]
    assert sql.count(CUTS[name]) == 1
    rel = con.sql(sql.replace(CUTS[name], ""))
    at = [list(rel.columns).index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_hash_embedding_has_the_dimension_of_the_operator(spark):
    from codeloom.functions.embedding import DIM, embed

    e = entry.queries()["hash_embedding"](spark, str(DATA))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = e.limit(5).collect()
    assert DIM == 768 and got and all(list(r.embedding) == embed(text[r.doc_id]) for r in got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
