"""The queries of the tools against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from maskwright.plans import large, registry, tools

AT = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(round(v[k], 9) if isinstance(v[k], float) else v[k]) for k in order) for v in values)


QUERIES, SQL = registry.queries() | tools.queries() | large.queries(), registry.oracle_sql() | tools.oracle_sql() | large.oracle_sql()


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


# all_findings and no_context hold what the query of each type returns
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("detect_") or n == "detect_br_cep"))
def test_against_sql(spark, name):
    if not os.path.isdir(AT):
        pytest.skip("no tables here")
    db = duckdb.connect()
    for t in ("documents", "conversations", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    want = db.execute(SQL[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, AT)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
