"""Every registered query over the small tables, against DuckDB where it has a twin."""

import duckdb
import pytest

from oracle_harness import table_digest
from sievekit.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got = table_digest(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == table_digest(columns, cur.fetchall())[0]


#: Queries whose rows are not one per document; their own tests count them.
OTHER_ROWS = {"op11_conversation_repair", "op12_ranked_search", "op13_packing"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - OTHER_ROWS))
def test_one_row_per_input(spark, name):
    table = "pages" if name.startswith("op3_") else "documents"
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_entry_lists_the_pipeline():
    import __spark_entry__ as entry

    assert {"pipeline", *QUERIES} <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())
