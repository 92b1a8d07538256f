"""Fingerprints of files that are not held in memory as a whole."""

import hashlib

from plumbline.sources import files


def test_large_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "WHOLE_BYTES", 1000)
    texts = {"small.bin": b"abc" * 100, "even.bin": b"\x00\xff" * 500, "large one + ü%20.bin": bytes(range(256)) * 50, "none.bin": b""}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # above it a file as one value is an error
    try:
        got = [(r.length, r.file_hash) for r in files.file_fingerprint(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert sorted(got) == sorted((len(d), hashlib.sha256(d).hexdigest()) for d in texts.values() if d)


def test_large_files_of_other_stores_are_streams(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "WHOLE_BYTES", 1000)
    data = bytes(range(256)) * 60
    (tmp_path / "a b.bin").write_bytes(data)
    assert files._hashed_as_stream(spark, f"file:{tmp_path}/a b.bin") == hashlib.sha256(data).hexdigest()
