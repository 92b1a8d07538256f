"""Queries on stored findings and the whole run on the visits."""

import datetime

from plumbline.plans import catalog


def test_severities_of_all_stored_findings(spark, tmp_path):
    rows = [(i, 1, 1, 1, 1.0, 1.0, discount, "F", 0.0, "N", datetime.datetime(1998, 1, 1))
            for i, discount in enumerate([0.1, 0.09, 0.07, 0.01])]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                "l_extendedprice double, l_discount double, l_linestatus string, l_tax double, "
                                "l_returnflag string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["severity"]: r["n"] for r in catalog.QUERIES["severity_counts"](spark, str(tmp_path)).collect()}
    assert got == {"CRITICAL": 2, "HIGH": 1, "MEDIUM": 0, "LOW": 1}


def test_full_analysis_reads_all_columns(spark):
    got = catalog.QUERIES["full_analysis"](spark, "/root/testdata/sf0.001")
    columns = {r["column_name"] for r in got.select("column_name").distinct().collect()}
    assert "end_date" in columns or "start_date" in columns, columns
    statistical = got.where("detection_method LIKE '%statistical%'").select("column_name").distinct().collect()
    assert {r["column_name"] for r in statistical} - {"heart_rate", "systolic_bp", "weight"}, statistical
