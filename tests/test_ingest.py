"""Many CSV files in one go."""

import hashlib

import pytest

from plumbline.sources.ingest import accepted, ingest


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.csv": "id,name,x\n1,Ann,2.5\n2,,n/a\n3,\"Lee, Bob\",4\n1,2,3,4\n4\n",
        "b.csv": "﻿k;k;;flag\n001;x;1;true\n\n002;y;2;FALSE\n",
        "c.csv": "k;k;;flag\n",
        "d.csv": "\n \n",
        "e.csv": "only\n1\n2\n",
        "f.csv": "id\tq\n1\t\"say \"\"no\"\"\"\n",
        "g.csv": "id\tq\n1\t\"say \"\"no\"\"\"\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "h.csv").write_bytes("id,städt\n1,Köln\n".encode("latin-1"))
    return tmp_path


def test_records_of_differing_files(spark, folder):
    got = {r["path"].rsplit("/", 1)[1]: r for r in ingest(spark, str(folder / "*.csv"), 2).collect()}
    assert len(got) == 8
    a = got["a.csv"]
    assert (a["delimiter"], a["header"], a["rows"], a["bad_lines"], a["problem"]) == (",", ["id", "name", "x"], 4, 1, None)
    assert a["types"] == {"id": "long", "name": "string", "x": "double"} and a["missing"] == {"id": 0, "name": 2, "x": 2}
    assert a["preview"] == [{"id": "1", "name": "Ann", "x": "2.5"}, {"id": "2", "name": None, "x": None}]
    assert a["file_hash"] == hashlib.sha256((folder / "a.csv").read_bytes()).hexdigest()
    b = got["b.csv"]
    assert b["header"] == ["k", "k.1", "column_2", "flag"] and b["rows"] == 2
    assert b["types"] == {"k": "long", "k.1": "string", "column_2": "long", "flag": "boolean"}
    assert got["c.csv"]["problem"] == "Uploaded CSV file contains no data rows" and got["c.csv"]["types"] is None
    assert got["d.csv"]["problem"] == "Uploaded file is empty" and got["d.csv"]["length"] == 3
    assert got["e.csv"]["problem"] == "CSV must contain at least 2 columns" and got["e.csv"]["rows"] == 2
    assert got["f.csv"]["preview"] == [{"id": "1", "q": 'say "no"'}]
    assert got["h.csv"]["encoding"] == "ISO-8859-1" and got["a.csv"]["encoding"] == "UTF-8"


def test_known_files_are_marked(spark, folder):
    records = ingest(spark, str(folder / "*.csv"))
    known = spark.createDataFrame([("old", hashlib.sha256((folder / "e.csv").read_bytes()).hexdigest())],
                                  "path string, file_hash string")
    got = {r["path"].rsplit("/", 1)[1]: r["duplicate_of"] for r in accepted(records, known).collect()}
    assert got["e.csv"] == "old" and got["g.csv"].endswith("/f.csv") and got["f.csv"] is None and len(got) == 8


def test_a_file_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id,v\n" + "".join(f"{i},{i / 2 if i % 10 else 'NA'}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        r = ingest(spark, str(tmp_path / "*.csv"), 3).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert r["rows"] == 20_000 and r["missing"] == {"id": 0, "v": 2000} and r["types"] == {"id": "long", "v": "double"}
    assert [p["id"] for p in r["preview"]] == ["0", "1", "2"]
