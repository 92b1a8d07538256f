"""MinHash near-duplicate documents by an inverted join on signature coordinates (operator 1).

Documents are posted under each (coordinate, value) of their signature. Two documents whose word shingles have a
Jaccard similarity of at least 0.75 agree on at least ``MATCHES`` of ``COORDINATES`` coordinates but for a chance of
1e-5 at a similarity of just 0.75, and far less above. Prefix merging: with coordinates ordered by how many documents share the value, rarest first, such a pair must
meet in the first ``COORDINATES - MATCHES + 1`` of both documents, so only those lists are merged. Skip merging: the
remaining, longest lists are never read; the count of a pair that has met is completed by looking its two signatures
up. Pairs above the match threshold are confirmed on their full shingle sets.

Documents with equal shingle sets are one class before anything is posted. A list is not expanded into all pairs:
every member is first compared with the smallest member only, and in a second pass members of a list are compared only
where the components found so far still differ, which loses no link between different components. Of these only pairs are
made whose shingles, rarest first, allow a link (``common._alike``), so that a group of documents that are somewhat alike
does not meet itself pair by pair. What is left is signed anew with ``FINE`` coordinates, which tell pairs below 0.6 from
pairs above 0.75.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SKETCH_LONGS, WordHashes, linked, saved, small, windows

SHINGLE_WORDS = 5
COORDINATES = 64
MATCHES = 32
#: Coordinates of the second signature, 4 bits of each, and how many a pair must share. A pair of just 0.75 shares 196 on
#: average, as differing ones agree by chance in one of 16, with a deviation of 6.8: it is missed with a chance of 1e-5.
FINE, FINE_MATCHES = 16 * SKETCH_LONGS, 167
#: Documents per Arrow batch that goes back, so that sets of long texts stay small in memory.
BATCH = 1000
_SEED = np.random.default_rng(20240).integers(0, 2**32, (2, COORDINATES), dtype=np.uint32)
_FINE_SEED = np.random.default_rng(20241).integers(0, 2**32, (2, FINE), dtype=np.uint32)
_XOR, _TIMES = _SEED[0][:, None], (_SEED[1] | np.uint32(1))[:, None]


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle, an empty one has none."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(hashes.of(words), min(SHINGLE_WORDS, len(words))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of each of ``COORDINATES`` hash functions over the set."""
    low = np.full(COORDINATES, 2**32 - 1, np.uint32)
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(values), 1 << 15):
        np.minimum(low, ((values[at:at + (1 << 15)] ^ _XOR) * _TIMES).min(axis=1), out=low)
    return low


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and the second signature as longs of 4-bit coordinates."""
    xor, times = _FINE_SEED[0][:, None], (_FINE_SEED[1] | np.uint32(1))[:, None]
    for batch in batches:
        rows = []
        for shingles in batch.column(1):
            low = np.full(FINE, 2**32 - 1, np.uint32)
            values = (shingles.values.to_numpy().view(np.uint64) >> np.uint64(32)).astype(np.uint32)
            for at in range(0, len(values), 1 << 14):
                np.minimum(low, ((values[at:at + (1 << 14)] ^ xor) * times).min(axis=1), out=low)
            bits = (low * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.uint8)
            rows.append((bits[::2] | bits[1::2] << 4).view(np.int64))
        words = np.stack(rows) if rows else np.empty((0, SKETCH_LONGS), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(words[:, i]) for i in range(SKETCH_LONGS))],
                                         ["node", *(f"w{i}" for i in range(SKETCH_LONGS))])


def _fine(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The second signature of each of ``nodes``."""
    schema = "node long, " + ", ".join(f"w{i} long" for i in range(SKETCH_LONGS))
    return sets.join(nodes, "node", "left_semi").select("node", "shingles").mapInArrow(_sketches, schema)


def _halves(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a set as two signed longs."""
    digest = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        counts, high, low, marks = [], [], [], []
        for text in batch.column(1).to_pylist():
            shingles = shingle_set(text, hashes)
            counts.append(len(shingles))
            for half, value in zip((high, low), _halves(shingles), strict=True):
                half.append(value)
            if len(shingles):
                marks.append(signature(shingles))
        sizes = np.where(np.array(counts, np.int64) > 0, COORDINATES, 0)
        flat = np.concatenate(marks).view(np.int32) if marks else np.empty(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
             pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))],
            ["doc_id", "n_shingles", "set_high", "set_low", "signature"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            sets = [shingle_set(text, hashes) for text in batch.column(0).slice(at, BATCH).to_pylist()]
            high, low = zip(*map(_halves, sets), strict=True)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            yield pa.RecordBatch.from_arrays(
                [pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                          pa.array(np.concatenate(sets).view(np.int64)))],
                ["set_high", "set_low", "shingles"])


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b), those with enough equal coordinates and a Jaccard similarity of 0.75 or more."""
    side = classes.select("node", "n_shingles", "signature")
    matches = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x)
    near = (pairs.join(side.toDF("a", "n_a", "s_a"), "a").join(side.toDF("b", "n_b", "s_b"), "b")
            .where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)").where(matches >= MATCHES)
            .select("a", "b", "n_a", "n_b"))
    met = near.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    met = met.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("x", "y")).cast("long").alias("common"))
    return met.where("100 * common >= 75 * (n_a + n_b - common)").select("a", "b")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Links join documents whose sets of five-word shingles have a Jaccard similarity of at least 0.75. Null or empty
    texts, and texts without words, have an empty set and are linked with nothing. Every row is a document of its own,
    also where doc_id repeats; a row without doc_id counts for links, and its component_id is null only if no row
    reachable has one. Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, n_shingles long, set_high long, set_low long, "
    given = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    marked = saved(given.mapInArrow(_signatures, schema + "signature array<int>"))
    classes = saved(marked.where("n_shingles > 0").groupBy("set_high", "set_low").agg(
        F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature")).withColumn("node", F.monotonically_increasing_id()))
    tokens = classes.select("node", F.posexplode("signature").alias("i", "v")).select(
        "node", F.expr("shiftleft(cast(i as bigint), 32) | (cast(v as bigint) & 4294967295)").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    # coordinates that no other document shares come first in the order, so of m shared ones m - MATCHES + 1 are prefix
    prefix = (tokens.join(shared, "token").groupBy("node")
              .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
              .where(F.size("t") >= MATCHES)
              .select("node", F.explode(F.slice("t", F.lit(1), F.size("t") - (MATCHES - 1))).alias("t")))
    posted = saved(prefix.select("node", F.col("t.token").alias("token")))
    members = saved(posted.select("node").distinct().join(classes, "node").select("node", "doc", "set_high", "set_low"))
    # a doc_id may repeat with another text, so the set decides which class a text stands for
    wanted = small(members.select(F.col("doc").alias("member")).distinct(), 16)
    texts = given.join(wanted, F.col("doc_id").eqNullSafe(F.col("member")), "left_semi").select("text")
    sets = saved(texts.mapInArrow(_sets, "set_high long, set_low long, shingles array<bigint>")
                 .join(members, ["set_high", "set_low"]).groupBy("node").agg(F.first("shingles").alias("shingles")))
    found = linked(posted, lambda pairs: _confirmed(pairs, classes, sets),
                   classes.select("node", F.col("n_shingles").alias("n")),
                   lambda nodes: sets.join(nodes, "node").select("node", F.explode("shingles").alias("element")),
                   lambda nodes: _fine(nodes, sets), FINE_MATCHES)
    lowest = (classes.select("node", "doc").join(found, "node").groupBy("root").agg(F.min("doc").alias("lowest")))
    named = classes.select("node", "set_high", "set_low", "doc").join(found, "node", "left").join(lowest, "root", "left")
    named = named.select("set_high", "set_low", F.coalesce("lowest", "doc").alias("lowest"))
    joined = marked.drop("signature").join(named, ["set_high", "set_low"], "left")
    component = F.coalesce("lowest", "doc_id")  # texts without words are in no class
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"))
