"""Document fingerprints by Order MinHash (operator 2).

A text's items are its k-mers of code points, each with the number of its occurrence so far. Every coordinate has a hash
function of its own, takes the ``TUPLE`` items with the smallest values, puts them in the order in which they stand in
the text and hashes that tuple. Two texts agree on a coordinate with a chance that falls with their edit distance; a
text whose parts change places loses coordinates, as it would not with plain MinHash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, windows

KMER = 7
TUPLE = 2
COORDINATES = 64
#: Rows that one range of neighbouring doc_ids holds, on average.
RANGE_ROWS = 2000
_CHUNK = 4096
_SEED = np.random.default_rng(7141).integers(0, 2**32, (2, COORDINATES), dtype=np.uint32)
_XOR, _TIMES = _SEED[0][:, None], (_SEED[1] | np.uint32(1))[:, None]
_LOWEST = -2**63


def numbered_kmers(text: str) -> np.ndarray:
    """32-bit hashes of (k-mer, number of its occurrence), in text order; a shorter text is one k-mer."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    if not len(codes):
        return np.empty(0, np.uint32)
    kmers = windows(codes, min(KMER, len(codes))) >> np.uint64(24)
    n = len(kmers)
    if n < 1 << 24:  # k-mer and place in one number: sorts faster than an index
        keys = np.sort((kmers << np.uint64(24)) | np.arange(n, dtype=np.uint64))
        order, kmers = (keys & np.uint64(0xFFFFFF)).astype(np.int64), keys >> np.uint64(24)
    else:
        order = np.argsort(kmers, kind="stable")
        kmers = kmers[order]
    places = np.arange(n)
    first = np.maximum.accumulate(np.where(np.concatenate([[True], kmers[1:] != kmers[:-1]]), places, 0))
    out = np.empty(n, np.uint32)
    numbers = (places - first).astype(np.uint64)
    out[order] = (mixed(kmers + numbers * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    return out


def fingerprint(text: str) -> np.ndarray:
    """``COORDINATES`` 32-bit hashes of ordered tuples; equal texts have equal ones."""
    items = numbered_kmers(text)
    if not len(items):
        return np.full(COORDINATES, 2**32 - 1, np.uint32)
    rows, values, places = np.arange(COORDINATES), [], []
    for at in range(0, len(items), _CHUNK):
        part = (items[at:at + _CHUNK] ^ _XOR) * _TIMES
        for _ in range(min(TUPLE, part.shape[1])):
            low = part.argmin(axis=1)
            values.append(part[rows, low])
            places.append(low + at)
            part[rows, low] = 2**32 - 1
    values, places = np.stack(values, 1), np.stack(places, 1)
    if values.shape[1] > TUPLE:
        least = np.argsort(values, axis=1, kind="stable")[:, :TUPLE]
        places = np.take_along_axis(places, least, 1)
    chosen = items[np.sort(places, axis=1)].astype(np.uint64)
    total = np.zeros(COORDINATES, np.uint64)
    for i in range(chosen.shape[1]):
        total = mixed(total * np.uint64(0x100000001B3) + chosen[:, i] + np.uint64(1))
    return (total >> np.uint64(32)).astype(np.uint32)


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    return float((one == two).mean())


def written(mark: np.ndarray) -> str:
    return mark.astype(">u4").tobytes().hex()


def _ranges(docs: DataFrame, key: str) -> list[tuple[int, int]]:
    """(lowest, highest) doc_id of consecutive ranges, the highest range first; one pair per ``RANGE_ROWS`` rows."""
    ids = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LOWEST)).alias("at"))
    parts = max(1, -(-ids.count() // RANGE_ROWS))
    met = ids.repartitionByRange(parts, "at").groupBy(F.spark_partition_id()).agg(F.min("at"), F.max("at")).collect()
    return sorted(((r[1], r[2]) for r in met), reverse=True)


def _dealt(ranges: list[tuple[int, int]]):
    """Send each document to its range, and the first one of a range also to the range above, as its next document."""
    lows = [low for low, _ in reversed(ranges)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = {high: i - 1 for i, (_, high) in enumerate(ranges)}  # the highest of all is next to the lowest: -1
        for batch in batches:
            at, rows, to, extra = batch.column(1).to_pylist(), [], [], []
            for row, value in enumerate(at):
                place = len(lows) - 1 - (bisect_left(lows, value + 1) - 1)
                rows.append(row)
                to.append(place)
                extra.append(False)
                if value in heads:
                    rows.append(row)
                    to.append(heads[value] % len(ranges))
                    extra.append(True)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(to, pa.int32()),
                                              pa.array(extra)], [*batch.schema.names, "range", "extra"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; each is compared with the one that follows it in its range."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    before = None  # (range, doc_id, text, fingerprint) of the row before
    for batch in batches:
        out: list[list] = [[] for _ in names]
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        places, extras = batch.column("range").to_pylist(), batch.column("extra").to_pylist()
        for doc, text, place, extra in zip(ids, texts, places, extras, strict=True):
            if extra and (before is None or before[0] != place):
                continue  # a second row with the doc_id of the next range's first
            mark = fingerprint(text)
            if before is not None and before[0] == place:
                _, one, own, own_mark = before
                half = len(own) // 2
                edited = own[:len(own) - half] + text[:half]
                edited_mark = fingerprint(edited)
                for column, value in zip(out, (
                        one, len(own), hashlib.sha256(edited.encode()).hexdigest(), written(own_mark),
                        written(edited_mark), likeness(own_mark, edited_mark), likeness(own_mark, mark)), strict=True):
                    column.append(value)
            before = None if extra else (place, doc, text, mark)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], batch.schema.field("doc_id").type), pa.array(out[1], pa.int64()),
             *(pa.array(c, pa.string()) for c in out[2:5]), *(pa.array(c, pa.float64()) for c in out[5:])], names)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_chars and fingerprint of every text; a null text is empty. Other columns of ``docs`` are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, texts)), pa.int64()),
                 pa.array([written(fingerprint(t)) for t in texts], pa.string())], ["doc_id", "n_chars", "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_chars long, fingerprint string")


def edited_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each document held against an edited form of itself and against the next document.

    The next document is the one below in descending doc_id (rows with equal doc_id by text; rows without doc_id last;
    after the last, the first). The edited text has the last floor(n_chars / 2) code points replaced by the first as
    many, or all, of the next. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next (shares of equal coordinates). A null text is empty. Texts are shuffled once, by ranges of doc_id whose
    bounds alone return to the driver. Other columns are not read; an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(_LOWEST)).alias("at"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = _ranges(docs, key)
    dealt = given.mapInArrow(_dealt(ranges), f"doc_id {kind}, at long, text string, range int, extra boolean")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(ranges) // 4)
    rows = dealt.repartition(parts, "range").sortWithinPartitions("range", "extra", F.desc("at"), "text")
    return rows.mapInArrow(_compared, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                                      "edited_fingerprint string, near_edited double, near_next double")
