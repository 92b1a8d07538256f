"""Removal of repeated byte strings by deep-shallow suffix sorting (operator 7).

Every window of ``LENGTH`` bytes has an anchor: its ``GRAM``-byte gram with the smallest hash, the first of equal ones.
Equal windows have equal anchors in the same place, so suffixes need to be ordered only among occurrences of the same
anchor. The bytes around an occurrence that its own windows cover are its context. Anchors that occur once are done;
a context that occurs twice has all its windows repeated; only contexts that differ at a shared anchor are sorted:
the suffixes at which their windows begin first by multikey quicksort, one 8-byte character after the other, down to a
shallow depth, and groups that still agree there by blind tries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, mixed, saved

LENGTH = 200
GRAM = 100
#: Characters of 8 bytes that multikey quicksort compares before blind tries take over.
SHALLOW = 4
#: Contexts of one anchor that a task sorts; windows of anchors with more are counted by their hash, over all tasks.
HOT_CONTEXTS = 20_000
#: Contexts that are sorted at a time, and windows of a text that are hashed at a time.
_SORTED, _BLOCK = 20_000, 1 << 20
#: Windows that are ordered at a time, and bytes of texts whose contexts are held at a time, if no single one has more.
_WINDOWS, _TEXTS = 400_000, 4 << 20
_PLACE = np.uint64(_BLOCK * 2 - 1)


def _grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` bytes, by doubling."""
    part, width, done, out = codes.astype(np.uint64) + np.uint64(1), 1, 0, None
    while size:
        power = np.uint64(pow(0x9E3779B97F4A7C15, width, 1 << 64))
        if size & 1:
            out = part if out is None else out[:len(part) - done] * power + part[done:done + len(out)]
            done += width
        size >>= 1
        if size:
            part, width = part[:-width] * power + part[width:], width * 2
    return mixed(out)


def anchors(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor place, its hash, and the first and last window start that it is the anchor of, in blocks of a text."""
    codes = np.frombuffer(text, np.uint8)
    span = LENGTH - GRAM + 1
    for at in range(0, len(codes) - LENGTH + 1, _BLOCK):
        hashes = _grams(codes[at:at + _BLOCK + LENGTH - 1], GRAM)
        low, width = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), 1
        while 2 * width <= span:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        if width < span:
            low = np.minimum(low[:width - span], low[span - width:])
        places = (low & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        last = np.append(first[1:], len(places)) - 1
        yield places[first] + at, hashes[places[first]], first + at, last + at


def _of_text(text: bytes) -> tuple[np.ndarray, ...]:
    parts = list(anchors(text))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 4


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs whose texts have ``_TEXTS`` bytes at most, a longer text by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(upto):
        end = max(at + 1, int(np.searchsorted(upto, _TEXTS + (upto[at - 1] if at else 0), "right")))
        yield batch.slice(at, end - at)
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchor hashes and how often a batch of texts has them."""
    for batch in batches:
        found = [_of_text((t or "").encode())[1].astype(np.uint64) for piece in _pieces(batch, "text")
                 for t in piece.column(0).to_pylist()]
        values, counts = np.unique(np.concatenate(found), return_counts=True) if found else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(values, np.uint64).view(np.int64)),
                                          pa.array(np.array(counts, np.int64))], ["anchor", "n"])


def _occurrences(wanted, with_text: bool):
    """Occurrences of wanted anchors (all, if None): place, window starts before it, and the context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if wanted is None else wanted.value
        for whole in batches:
            for piece in _pieces(whole, "text"):
                yield part(piece, table)

    def part(batch: pa.RecordBatch, table: np.ndarray | None) -> pa.RecordBatch:
        rows, columns, contexts, digests = [], [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            code = (text or "").encode()
            found = _of_text(code)
            if table is not None and len(found[1]):
                near = np.searchsorted(table, found[1])
                near[near == len(table)] = 0
                found = tuple(c[table[near] == found[1]] for c in found) if len(table) else tuple(c[:0] for c in found)
            place, anchor, first, last = found
            rows.append(np.full(len(place), row))
            columns.append(np.stack([place, anchor.astype(np.uint64).view(np.int64), place - last, place - first]))
            for p, a, b in zip(place.tolist(), first.tolist(), last.tolist(), strict=True):
                context = code[a:b + LENGTH]
                digests.append(xxhash.xxh3_128_intdigest(context, p - a))
                if with_text:
                    contexts.append(context)
        rows = pa.array(np.concatenate(rows) if rows else [], pa.int64())
        place, anchor, low, high = np.concatenate(columns, axis=1) if columns else np.empty((4, 0), np.int64)
        out = {c: batch.column(c).take(rows) for c in ("doc_id", "digest")} | {
            "place": place, "anchor": anchor, "low": low.astype(np.int32), "high": high.astype(np.int32),
            "c1": [(d >> 64) - 2**63 for d in digests], "c2": [(d & (2**64 - 1)) - 2**63 for d in digests]}
        if with_text:
            out["context"] = pa.array(contexts, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) if isinstance(v, list) else v if isinstance(
            v, pa.Array) else pa.array(v) for v in out.values()], list(out))

    return run


def multikey_groups(buffer: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> Iterator[np.ndarray]:
    """Order suffixes by group and then 8-byte character after character to ``SHALLOW``; yields, in order, the members
    of every group that still agrees. A group that is down to one suffix is closed and not compared further."""
    eight = np.lib.stride_tricks.sliding_window_view(buffer, 8)
    index = np.argsort(groups, kind="stable")
    groups = groups[index]
    for depth in range(SHALLOW + 1):
        fresh = np.concatenate([[True], groups[1:] != groups[:-1]])
        number = np.cumsum(fresh) - 1
        sizes = np.bincount(number)
        opened = sizes[number] > 1
        index, groups = index[opened], number[opened]
        if depth == SHALLOW or not len(index):
            break
        character = eight[starts[index] + 8 * depth].reshape(-1, 8).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((character, groups))
        index, groups, character = index[order], groups[order], character[order]
        parted = np.concatenate([[True], (groups[1:] != groups[:-1]) | (character[1:] != character[:-1])])
        groups = np.cumsum(parted)
    if len(index):
        yield from np.split(index, np.flatnonzero(groups[1:] != groups[:-1]) + 1)


def equal_in_trie(strings: list[bytes]) -> list[list[int]]:
    """Order strings in a blind trie and return the sets of equal ones.

    Inner nodes have only a depth and one branch per byte there. A string walks down by its bytes at those depths, blind
    to all others, to some leaf; one comparison with that leaf gives the depth at which it must branch off.
    """
    root, length = [0], len(strings[0])  # a leaf is a list of equal strings, an inner node (depth, branches)
    found = [root]
    for i in range(1, len(strings)):
        one, node, path = strings[i], root, []
        while isinstance(node, tuple):
            path.append(node)
            depth, branches = node
            node = branches.get(one[depth]) or next(iter(branches.values()))
        other = strings[node[0]]
        if one == other:
            node.append(i)
            continue
        differing = int.from_bytes(one, "big") ^ int.from_bytes(other, "big")
        depth = length - (differing.bit_length() + 7) // 8
        above = None
        for step in path:
            if step[0] >= depth:
                break
            above = step
        leaf = [i]
        found.append(leaf)
        below = root if above is None else above[1].get(one[above[0]])
        if isinstance(below, tuple) and below[0] == depth:
            below[1][one[depth]] = leaf
            continue
        inner = (depth, {other[depth]: below, one[depth]: leaf})
        if above is None:
            root = inner
        else:
            above[1][one[above[0]]] = inner
    return [leaf for leaf in found if len(leaf) > 1]


def repeated_windows(contexts: list[bytes], anchor: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of each context, the least and the largest distance from anchor back to the start of a window that another
    context of the same anchor has too; (-1, -1) where there is none.

    Windows at different distances never meet, so some distances are done at a time.
    """
    lengths = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(lengths) - lengths
    buffer = np.frombuffer(b"".join(contexts), np.uint8)
    number = np.unique(anchor, return_inverse=True)[1]
    out = np.full((len(contexts), 2), -1, np.int64)
    step = max(1, _WINDOWS // max(1, len(contexts)))
    for least in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1, step):
        _repeated_between(least, least + step - 1, contexts, buffer, begin, number, low, high, out)
    return out


def _repeated_between(least: int, most: int, contexts: list[bytes], buffer: np.ndarray, begin: np.ndarray, number: np.ndarray,
                      low: np.ndarray, high: np.ndarray, out: np.ndarray) -> None:
    """Take the windows at distances from ``least`` to ``most`` into ``out``, see ``repeated_windows``."""
    top = np.minimum(high, most)
    sizes = np.maximum(top - np.maximum(low, least) + 1, 0)
    if not sizes.any():
        return
    owner = np.repeat(np.arange(len(contexts)), sizes)
    back = top[owner] - (np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    inside = high[owner] - back
    for group in multikey_groups(buffer, begin[owner] + inside, number[owner] * (LENGTH + 1) + back):
        members, at = owner[group].tolist(), inside[group].tolist()
        windows = [contexts[m][a:a + LENGTH] for m, a in zip(members, at, strict=True)]
        distance = int(back[group[0]])
        for same in equal_in_trie(windows):
            for i in same:
                m = members[i]
                out[m, 0] = distance if out[m, 0] < 0 else min(out[m, 0], distance)
                out[m, 1] = max(out[m, 1], distance)


def _sorted_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by anchor; whole anchors are sorted together, some thousand contexts at a time."""
    names = ["anchor", "low", "high", "c1", "c2", "context"]
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]).select(names)
        rest = table if rest is None else pa.concat_tables([rest, table])
        if rest.num_rows >= _SORTED:
            anchor = rest.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchor != anchor[-1], False)) if anchor[0] != anchor[-1] else 0
            if cut:
                yield _sorted_part(rest.slice(0, cut))
                rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield _sorted_part(rest)


def _sorted_part(table: pa.Table) -> pa.RecordBatch:
    low, high = (table.column(c).to_numpy().astype(np.int64) for c in ("low", "high"))
    found = repeated_windows(table.column("context").to_pylist(), table.column("anchor").to_numpy(), low, high)
    some = found[:, 0] >= 0
    return pa.RecordBatch.from_arrays(
        [pa.array(table.column("c1").to_numpy()[some]), pa.array(table.column("c2").to_numpy()[some]),
         pa.array(found[some, 0].astype(np.int32)), pa.array(found[some, 1].astype(np.int32))],
        ["c1", "c2", "least", "most"])


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit hash of every window of contexts of hot anchors."""
    for batch in batches:
        for row in range(batch.num_rows):
            r = batch.slice(row, 1).to_pylist()[0]
            count = r["high"] - r["low"] + 1
            digests = [xxhash.xxh3_128_intdigest(r["context"][i:i + LENGTH], r["high"] - i) for i in range(count)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["c1"]] * count, pa.int64()), pa.array([r["c2"]] * count, pa.int64()),
                 pa.array([r["high"] - i for i in range(count)], pa.int32()),
                 pa.array([(d >> 64) - 2**63 for d in digests], pa.int64()),
                 pa.array([(d & (2**64 - 1)) - 2**63 for d in digests], pa.int64())], ["c1", "c2", "back", "w1", "w2"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            met: list[dict] = []
            for s in sorted(spans, key=lambda s: (s["first"], s["last"])):
                if met and s["first"] <= met[-1]["last"]:
                    met[-1]["last"] = max(met[-1]["last"], s["last"])
                else:
                    met.append(s)
            out.append(met)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)],
                                         ["doc_id", "digest", "spans"])


def _scan(docs: DataFrame, kind: str, wanted: DataFrame, with_text: bool) -> DataFrame:
    """Occurrences of wanted anchors; a set that is too large to broadcast is joined instead."""
    schema = (f"doc_id {kind}, digest long, place long, anchor long, low int, high int, c1 long, c2 long"
              + ", context binary" * with_text)
    if wanted.count() * 8 > BROADCAST_BYTES // 2:
        return docs.mapInArrow(_occurrences(None, with_text), schema).join(wanted, "anchor", "left_semi")
    values = np.array([r[0] for r in wanted.toLocalIterator()], np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(values))
    return docs.mapInArrow(_occurrences(shared, with_text), schema)


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Maximal byte ranges covered by strings of ``LENGTH`` bytes that also start elsewhere: doc_id, digest, spans.

    digest is the 64-bit hash of the text; documents without such a range have no row.
    """
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    counts = given.select("text").mapInArrow(_counted, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    wanted = saved(counts.where("n > 1").select("anchor"))
    met = saved(_scan(given, kind, wanted, with_text=False))
    contexts = saved(met.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("n")))
    groups = saved(contexts.groupBy("anchor").agg(F.count("*").alias("contexts"), F.min("n").alias("least"))
                   .where("contexts > 1 and least = 1"))
    hard = saved(_scan(given, kind, groups.select("anchor"), with_text=True).groupBy("anchor", "low", "high", "c1", "c2")
                 .agg(F.first("context").alias("context")))
    hot = groups.where(F.col("contexts") > HOT_CONTEXTS).select("anchor")
    single = hard.join(hot, "anchor", "left_anti")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = single.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(
        _sorted_contexts, "c1 long, c2 long, least int, most int")
    if not hot.isEmpty():
        marks = hard.join(hot, "anchor", "left_semi").mapInArrow(
            _window_hashes, "c1 long, c2 long, back int, w1 long, w2 long")
        again = marks.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
        found = found.unionAll(marks.join(again, ["w1", "w2"], "left_semi").groupBy("c1", "c2").agg(
            F.min("back").alias("least"), F.max("back").alias("most")))
    # a context that occurs again has all its windows repeated, whatever the sorting says
    known = contexts.where("n > 1").select("c1", "c2", F.lit(0).alias("least"), F.lit(LENGTH).alias("most"))
    known = known.unionAll(found).groupBy("c1", "c2").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    spans = met.join(known, ["c1", "c2"]).select("doc_id", "digest", F.struct(
        (F.col("place") - F.least("most", "high")).alias("first"),
        (F.col("place") - F.greatest("least", "low") + LENGTH).alias("last")).alias("span"))
    return spans.groupBy("doc_id", "digest").agg(F.collect_list("span").alias("spans")).mapInArrow(
        _merged, f"doc_id {kind}, digest long, spans array<struct<first: long, last: long>>")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in (piece for whole in batches for piece in _pieces(whole, "text")):
        out: list[list] = [[] for _ in names[1:]]
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            code, at, kept = (text or "").encode(), 0, []
            for s in spans or []:
                kept.append(code[at:s["first"]])
                at = s["last"]
            kept = b"".join([*kept, code[at:]])
            for column, value in zip(out, (len(code), len(code) - len(kept), len(spans or []),
                                           hashlib.sha256(kept).hexdigest(), kept), strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out, kinds)], names)


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (remaining bytes) of every row of ``docs``.

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else, in the same document or
    another; strings never cross documents and are judged on the input. Null texts are empty. Repeated rows are
    documents of their own, so all their long strings are repeated. Other columns are not read; an empty table gives an
    empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    spans = saved(repeated_spans(docs, text, key))
    size = spans.agg(F.sum(F.size("spans") * 16 + 40)).first()[0] or 0
    side = spans.toDF("k", "d", "spans")
    given = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = given.join(F.broadcast(side) if size <= BROADCAST_BYTES else side,
                      F.col("doc_id").eqNullSafe(F.col("k")) & (F.xxhash64("text") == F.col("d")), "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(
        _kept, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
