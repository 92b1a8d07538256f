"""Benchmark decontamination by a broadcast hash set of normalised n-grams (operator 8)."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, WordHashes, windows

WINDOW_WORDS = 13
#: Words of benchmark items in one broadcast; a larger benchmark is scanned for in blocks of whole items.
BLOCK_WORDS = 4_000_000
#: A document is contaminated when a word is hit and hits times this reach its words.
HIT_SHARE = 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text: str | None) -> list[bytes]:
    """Runs of lower-cased ASCII letters, digits and all non-ASCII characters."""
    return (text or "").encode().translate(WORD_BYTES).split()


class Windows:
    """The windows of benchmark items: by length, sorted hashes, and for each hash its words and the items with it."""

    def __init__(self, known: dict[tuple[int, int], dict[tuple[bytes, ...], set[str]]]):
        self.known, by_size = known, defaultdict(list)
        for size, value in known:
            by_size[size].append(value)
        self.sorted = {size: np.array(sorted(found), np.uint64) for size, found in by_size.items()}

    @staticmethod
    def table(items: list[tuple[str, list[bytes]]]) -> dict:
        """Plain data of the items' windows, for a broadcast."""
        hashes, known = WordHashes(), {}
        for item, words in items:
            size = min(WINDOW_WORDS, len(words))
            for at, value in enumerate(windows(hashes.of(words), size).tolist() if words else []):
                known.setdefault((size, value), {}).setdefault(tuple(words[at:at + size]), set()).add(item)
        return known

    def hits(self, words: list[bytes], hashes: WordHashes) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of occurring windows, each confirmed word by word, and the items they belong to."""
        spans, items = [], set()
        coded = hashes.of(words)
        for size, table in self.sorted.items():
            found = windows(coded, size)
            if not len(found):
                continue
            at = np.searchsorted(table, found)
            at[at == len(table)] = 0
            for start in np.flatnonzero(table[at] == found).tolist():
                owners = self.known[size, int(found[start])].get(tuple(words[start:start + size]))
                if owners:
                    spans.append((start, start + size))
                    items |= owners
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items as (item_id as text, words), in blocks of at most ``BLOCK_WORDS`` words or one item."""
    block, size = [], 0
    rows = benchmark.select(F.col(item).cast("string"), text).where(F.col(text).isNotNull())
    for name, content in rows.toLocalIterator(prefetchPartitions=True):
        words = words_of(content)
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((name, words))
        size += len(words)
    yield block


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHashes(), Windows(shared.value)
        for batch in batches:
            counts, spans, items = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found, owners = table.hits(words, hashes)
                counts.append(len(words))
                spans.append([{"first": a, "last": b} for a, b in found])
                items.append(sorted(o for o in owners if o is not None))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(spans, kind),
                 pa.array(items, pa.list_(pa.string()))], [*batch.schema.names, "n_words", "spans", "items"])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the ranges and items that several blocks have found in a document."""
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            row["spans"] = [{"first": a, "last": b}
                            for a, b in merged([(s["first"], s["last"]) for s in row["spans"]])]
            row["items"] = sorted(set(row["items"]))
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id",
              item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text, n_words, spans (word ranges first..last, last excluded), items.

    A span covers words inside an occurrence of 13 consecutive words of an item, or of a whole shorter item. Null and
    empty texts have no words; items without words hit nothing; items without item_id hit but are not named. Repeated
    rows each get their row. Other columns are not read.
    """
    sc = docs.sparkSession.sparkContext
    given = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = (f"doc_id {docs.schema[key].dataType.simpleString()}, text string, n_words long, "
              "spans array<struct<first: long, last: long>>, items array<string>")
    scans = [given.mapInArrow(_scan(sc.broadcast(Windows.table(block))), schema)
             for block in _blocks(benchmark, item, item_text)]
    if len(scans) == 1:
        return scans[0]
    # a block is a pass over all documents; ranges meet by document, and a text in several rows has them once
    found, keys = None, ["doc_id", F.sha2("text", 256).alias("digest")]
    for scan in scans:
        part = scan.where("size(items) > 0 or size(spans) > 0").select(*keys, "spans", "items").dropDuplicates(
            ["doc_id", "digest"])
        found = part if found is None else found.unionAll(part)
    met = found.groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans"),
                                                F.flatten(F.collect_list("items")).alias("items"))
    met = met.mapInArrow(_joined, met.schema).toDF("k", "d", "s", "i")
    base = scans[0].select("doc_id", "text", "n_words")
    return base.join(met, F.col("doc_id").eqNullSafe(F.col("k")) & (F.sha2("text", 256) == F.col("d")), "left").select(
        "doc_id", "text", "n_words", F.coalesce("s", F.array().cast(met.schema["s"].dataType)).alias("spans"),
        F.coalesce("i", F.array().cast("array<string>")).alias("items"))


def judged(hits: DataFrame) -> DataFrame:
    """doc_id, text, n_words, n_hit, n_items, items_sha256, contaminated, spans, items of the rows of ``find_hits``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["last"] - s["first"])
    rows = hits.select("*", n_hit.alias("n_hit"))
    return rows.select("doc_id", "text", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                       F.expr(f"n_hit > 0 and {HIT_SHARE} * n_hit >= n_words").alias("contaminated"), "spans", "items")


def _without(text: str | None, spans: list[dict]) -> str | None:
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text.translate(_UPPER))]
    out, at = [], 0
    for span in spans:
        out.append(text[at:places[span["first"]][0]])
        at = places[span["last"] - 1][1]
    return "".join([*out, text[at:]])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [_without(t, s) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text",
                   key: str = "doc_id") -> DataFrame:
    """doc_id and text without contaminated documents (``remove="documents"``) or without hit spans (``"spans"``).

    Removed spans end at word borders; text between words of a span goes with them, all other text stays as it is.
    """
    hits = find_hits(docs, benchmark, text, key)
    if remove == "documents":
        return judged(hits).where("not contaminated").select("doc_id", "text")
    if remove != "spans":
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    return hits.select("doc_id", "text", "spans").mapInArrow(
        _removed, f"doc_id {docs.schema[key].dataType.simpleString()}, text string")
