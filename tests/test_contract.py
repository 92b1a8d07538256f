"""A sample of the registered queries against their SQL at the smallest scale."""

import glob
import os
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_queries import canonical  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["zscore_events", "statistical_visits", "missing_or_impossible", "all_rules", "repeated_by_slices",
          "exact_copies", "near_copies_parts", "ensemble_max_conflict", "explained_findings", "finding_summary", "advice",
          "reviewed_findings", "findings_per_day", "price_histogram"]


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    import pandas as pd
    got = contract.queries()[name](spark, FOLDER).toPandas()
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cursor = con.execute(contract.oracle_sql()[name])
    want = pd.DataFrame(cursor.fetchall(), columns=[c[0] for c in cursor.description])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.astype(object).where(got.notna(), None)) == \
        canonical(want.astype(object).where(want.notna(), None))
