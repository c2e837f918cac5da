"""A few registered queries against their SQL; tools/check_queries.py runs all of them."""

from pathlib import Path

import pytest

import __spark_entry__ as registry
from tools.check_queries import rows_of

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["b2_namespace", "c3_validate_tests", "d3_incident_view", "l3_incident_counts", "l5_orphans", "j14_request_rules"]


def test_every_query_has_sql():
    assert set(registry.ORACLES) == set(registry.QUERIES)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables not present")
@pytest.mark.parametrize("name", SAMPLE)
def test_rows_equal_sql(spark, name):
    con = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    frame = registry.queries()[name](spark, FOLDER)
    cursor = con.execute(registry.oracle_sql()[name])
    assert rows_of(frame.columns, frame.collect()) == rows_of([c[0] for c in cursor.description], cursor.fetchall())
