"""The diffs of documents against their SQL, on texts that the tables don't have."""

import duckdb
import pytest

from maskwright.plans import large, tools
from tests.test_oracles import rows

TEXTS = [None, "", "\n", "\n\n", "a", "a\n", "a\nb\n\n", "a\r\nb\r", "++ x\n++ b/y\n", "diff --git a b\n@@ -1 +1,9 @@", "\ufeffa\u2028b\x85c\n\x00", "x" * 30_000 + "\n", "z\n" * 9000, "mail a@example.com\n"]
QUERIES, SQL = tools.queries() | large.queries(), tools.oracle_sql() | large.oracle_sql()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    docs = [(k, t) for k, t in enumerate(TEXTS)] + [(190 + k, t) for k, t in enumerate(TEXTS)] + [(5, "again\n"), (-7, "below\nzero"), (2**53 + 1, "large\n")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["diff_added_lines", "diff_all_added_lines", "diff_findings", "diff_chunk_lines", "diff_file_lines"])
def test_odd_documents(spark, table, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{table}/documents.parquet/*.parquet'")
    want = db.execute(SQL[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, table)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
