"""The log of review marks and its compaction."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from plumbline.plans import catalog
from plumbline.sources import reviews, sinks

SCHEMA = "row_key long, column_name string, severity string, anomaly_score double"
MARK = "analysis_id string, row_key long, column_name string, marked_at date, is_reviewed boolean, review_note string"


@pytest.fixture
def store(spark, tmp_path):
    path = str(tmp_path / "store")
    for name in ("a1", "a2", "a3"):
        rows = [(i, "x", "HIGH", 0.7) for i in range(4)] + [(None, "y", "LOW", 0.4)]
        sinks.write_findings(spark.createDataFrame(rows, SCHEMA), f"{path}/findings", name, "2024-01-01")
    return path


def mark(spark, path, batch, *rows):
    full = [(a, k, c, dt.date(2024, 1, d), r, n) for a, k, c, d, r, n in rows]
    reviews.append_marks(spark.createDataFrame(full, MARK), path, batch)


def state(spark, path, folder="read"):
    found = reviews.read_findings(spark, path) if folder == "read" else spark.read.parquet(f"{path}/findings")
    return {(r["analysis_id"], r["row_key"], r["column_name"]): (r["is_reviewed"], r["review_note"], r["is_false_positive"])
            for r in found.collect()}


def files(path, analysis):
    folder = f"{path}/findings/analysis_id={analysis}"
    return {f: os.stat(f"{folder}/{f}").st_mtime_ns for f in os.listdir(folder) if f.endswith(".parquet")}


def test_the_later_mark_counts(spark, store):
    assert len(state(spark, store)) == 15 and reviews.compact(spark, store) == 0
    mark(spark, store, 1, ("a1", 0, "x", 5, True, "seen"), ("a1", None, "y", 5, True, None), ("a9", 0, "x", 5, True, "none"))
    mark(spark, store, 2, ("a1", 0, "x", 6, None, "again"), ("a1", 1, "x", 6, True, "old"), ("a2", 2, "x", 6, True, "b"))
    mark(spark, store, 3, ("a1", 0, "x", 2, False, "late"))
    want = state(spark, store)
    assert want["a1", 0, "x"] == (True, "again", False) and want["a1", None, "y"] == (True, None, False)
    assert want["a3", 0, "x"] == (False, None, False)
    untouched, rewritten = files(store, "a3"), files(store, "a1")
    assert reviews.compact(spark, store) == 2
    assert state(spark, store, "stored") == state(spark, store) == want
    assert files(store, "a3") == untouched and files(store, "a1") != rewritten
    mark(spark, store, 4, ("a1", 0, "x", 3, False, "later batch, older date"), ("a1", 3, "x", 3, True, "new"))
    assert state(spark, store)["a1", 0, "x"] == (True, "again", False) and state(spark, store)["a1", 3, "x"][1] == "new"
    assert reviews.compact(spark, store) == 1 and reviews.compact(spark, store) == 0
    assert state(spark, store, "stored")["a1", 0, "x"] == (True, "again", False)


@pytest.mark.parametrize("fails", ["staged", "done"])
def test_an_interrupted_compaction_is_taken_up(spark, store, monkeypatch, fails):
    mark(spark, store, 1, ("a1", 0, "x", 5, True, "seen"), ("a2", 1, "x", 5, True, "seen"))
    want = state(spark, store)
    record = reviews._record

    def stop(spark, path, step, batch, staged):
        if step == fails:
            raise RuntimeError("lost")
        record(spark, path, step, batch, staged)

    monkeypatch.setattr(reviews, "_record", stop)
    with pytest.raises(RuntimeError):
        reviews.compact(spark, store)
    monkeypatch.setattr(reviews, "_record", record)
    assert state(spark, store) == want
    mark(spark, store, 2, ("a3", 2, "x", 7, True, "meanwhile"))
    both = state(spark, store)
    reviews.compact(spark, store)
    reviews.compact(spark, store)
    assert state(spark, store, "stored") == both and reviews.compact(spark, store) == 0


def test_a_batch_that_is_stored_again_replaces_itself(spark, store):
    mark(spark, store, 1, ("a1", 0, "x", 5, True, "wrong"))
    mark(spark, store, 1, ("a1", 0, "x", 5, True, "right"))
    assert state(spark, store)["a1", 0, "x"][1] == "right"
    with pytest.raises(Exception, match="marked_at"):
        reviews.append_marks(spark.range(1).select(F.lit("a").alias("analysis_id"), F.col("id").alias("row_key"),
                                                   F.lit("x").alias("column_name")), store)


@pytest.mark.parametrize("name", ["findings_written", "marks_on_read", "marks_compacted"])
def test_findings_that_are_used_several_times_are_made_once(spark, monkeypatch, name):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        made.add(1)
        return text

    found = spark.createDataFrame(
        [(1, "a", "HIGH", "s"), (2, "a", "CRITICAL", "s"), (3, "b", "LOW", "s")],
        "row_key long, column_name string, severity string, score_text string").withColumn("note", counted("severity"))
    monkeypatch.setattr(catalog, "visit_findings", lambda *_: found)
    counts = {}
    for r in catalog.QUERIES[name](spark, "").collect():
        counts[r["analysis_id"]] = counts.get(r["analysis_id"], 0) + r["n"]
    assert counts == ({"a1": 1, "a2": 3} if name == "findings_written" else {"a1": 3, "a2": 3, "a3": 3})
    assert made.value == 3


def test_compaction_keeps_no_second_copy_of_the_findings(spark, store):
    mark(spark, store, 1, ("a1", 0, "x", 5, True, "seen"), ("a2", 1, "x", 5, True, "seen"))
    want = state(spark, store)
    assert reviews.compact(spark, store) == 2
    assert state(spark, store, "stored") == want
    assert not [f for f in os.listdir(store) if f.startswith("staged")]


@pytest.mark.parametrize("one_by_one", [0, 1, 2])
def test_many_marked_analyses_are_merged_at_once(spark, store, monkeypatch, one_by_one):
    monkeypatch.setattr(reviews, "ONE_BY_ONE", one_by_one)
    mark(spark, store, 1, ("a1", 0, "x", 5, True, "seen"), ("a3", None, "y", 5, True, "seen"))
    want = state(spark, store)
    assert reviews.compact(spark, store) == 2 and state(spark, store, "stored") == want


def test_a_move_that_was_interrupted_is_taken_up(spark, store, monkeypatch):
    mark(spark, store, 1, ("a1", 0, "x", 5, True, "seen"), ("a2", 1, "x", 5, True, "seen"))
    want = state(spark, store)
    monkeypatch.setattr(reviews, "_moved", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        reviews.compact(spark, store)
    monkeypatch.undo()
    os.rename(f"{store}/findings/analysis_id=a1", f"{store}/lost")  # taken away, the new one not yet in its place
    assert reviews.compact(spark, store) == 2 and reviews.compact(spark, store) == 0
    assert state(spark, store, "stored") == want
