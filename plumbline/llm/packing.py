"""Best-fit packing of token sequences by hierarchical residual packing (operator 5).

Documents are cut only where they exceed the capacity. Pieces are dealt to nodes of bounded size by a hash. Every node
packs best-fit, largest first, emits bins that are nearly full and passes the others up as items; ``FAN_IN`` nodes meet
in one node of the next level and pack again. A node passes up no more pieces than its share of its parent, the
emptiest bins first, so every node of every level is bounded, whatever the lengths.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import saved

CAPACITY = 2048
#: Pieces that one node of the lowest level packs, on average.
NODE_PIECES = 32_768
FAN_IN = 8
#: Share of the capacity from which a bin is nearly full and leaves the tree.
NEARLY_FULL = 0.995
#: Text runs without a space or line break whose ids a Python worker remembers; emptied when full.
REMEMBERED_RUNS = 600_000
#: Letters that need no normalising but for their case, then at most one mark: the model can be asked directly.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
#: Byte-level models write a byte as the character of that number if it is visible, else as the next one from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
PIECES = "doc_id {0}, piece int, start long, length long, ids_crc32 long"


class RunIds(dict):
    """Ids, as little-endian 32-bit bytes, of runs of text between spaces and line breaks.

    The tokenizer drops white space and no rule of it looks across it, so the ids of a text are those of its runs.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to the tasks
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.marks = dict(zip(("", ".", ","), self._encoded(["", ".", ","]), strict=True))
        self.plain = _PLAIN if self._plain_words_hold() else None

    def _plain_words_hold(self) -> bool:
        """Whether the model's own ids of a plain word, in byte characters, are the tokenizer's."""
        probe = ["Word", "naïveté,", "ÀÿñÇß.", "x"]
        try:
            return all(self._plain(_PLAIN.fullmatch(w)) == self._encoded([w])[0] for w in probe)
        except Exception:  # a model without these calls
            return False

    def _encoded(self, runs: list[str]) -> list[bytes]:
        codes = self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)
        return [pack_ids(f"<{len(code)}I", *code.ids) for code in codes]

    def _plain(self, match: re.Match) -> bytes:
        word, mark = match.groups()
        word = word.lower() if word.isascii() else word.lower().encode().decode("latin-1").translate(_BYTE_CHARACTERS)
        ids = [t.id for t in self.tokenize(word)]
        return pack_ids(f"<{len(ids)}I", *ids) + self.marks[mark]

    @classmethod
    def of_worker(cls, path: str) -> RunIds:
        """The table of this Python worker, which outlives a task."""
        if getattr(cls, "kept", (None,))[0] != path:
            cls.kept = path, cls(path)
        return cls.kept[1]

    def learn(self, texts: list[list[str]]) -> None:
        fresh = set().union(*texts).difference(self)
        if len(self) + len(fresh) > REMEMBERED_RUNS:
            self.clear()
            fresh = set().union(*texts)
        rest = []
        for run in fresh:
            if self.plain and (match := self.plain.fullmatch(run)):
                self[run] = self._plain(match)
            else:
                rest.append(run)
        for at in range(0, len(rest), 4096):
            self.update(zip(rest[at:at + 4096], self._encoded(rest[at:at + 4096]), strict=True))

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 500):
            runs = [text.replace("\n", " ").split(" ") for text in texts[at:at + 500]]
            self.learn(runs)
            for one in runs:
                yield b"".join(map(self.__getitem__, one))


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = RunIds.of_worker(path)
        for batch in batches:
            keys, out = batch.column(0), {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for row, ids in enumerate(table.ids(texts)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    out["row"].append(row)
                    out["piece"].append(piece)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["crc"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [keys.take(pa.array(out["row"], pa.int32())), pa.array(out["piece"], pa.int32()),
                      *(pa.array(out[k], pa.int64()) for k in ("start", "length", "crc"))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY,
                 end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids."""
    given = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = PIECES.format(docs.schema[key].dataType.simpleString()) + (", ids array<int>" if with_ids else "")
    return given.mapInArrow(_cut(tokenizer, capacity, end_id, with_ids), schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every item, and the number of bins; ``lengths`` in the order in which items are to be packed.

    The bins with a given room form a stack, and the set of rooms in use is one integer of bits, so the tightest bin
    that takes an item is found with one shift and one lowest set bit.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, count = 0, 0
    for i, length in enumerate(lengths.tolist()):
        fitting = used >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            one = rooms[room].pop()
            if not rooms[room]:
                used &= ~(1 << room)
        else:
            one, room = count, capacity
            count += 1
        bins[i], offsets[i] = one, capacity - room
        if left := room - length:
            rooms[left].append(one)
            used |= 1 << left
    return bins, offsets, count


def _pack_node(level: int, capacity: int, passed: int):
    """Pack the items of a node; an item is a bin of the level below (or a piece), its rows keep their place in it."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bin", "offset"], kind="stable")
        old = rows["bin"].to_numpy()
        item = np.concatenate([[0], np.cumsum(old[1:] != old[:-1])])
        sizes = np.bincount(item, weights=rows["length"]).astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        bins, offsets, count = best_fit(sizes[order], capacity)
        place, base = np.empty_like(bins), np.empty_like(bins)
        place[order], base[order] = bins, offsets
        filled = np.bincount(place, weights=sizes, minlength=count)
        pieces = np.bincount(place[item], minlength=count)
        emptiest = np.argsort(filled, kind="stable")
        rises = np.zeros(count, bool)
        rises[emptiest] = np.cumsum(pieces[emptiest]) <= passed
        rises &= filled < NEARLY_FULL * capacity
        node = int(rows["node"].iloc[0])
        rows["offset"] += base[item]
        rows["bin"] = (np.int64(level) << np.int64(58)) + (np.int64(node) << np.int64(24)) + place[item]
        rows["done"] = ~rises[place[item]]
        return rows

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, node_pieces: int = NODE_PIECES) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset, gapless within a sequence.

    Repeated pieces are packed once each; an empty table gives an empty result.
    """
    pieces = saved(pieces)
    nodes = max(1, -(-pieces.count() // node_pieces))
    # every piece starts as a bin of its own; row numbers are fixed, as the pieces are written
    spread = pieces.select("*", F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("long").alias("offset"),
                           F.lit(False).alias("done"))
    spread = spread.withColumn("node", F.pmod(F.xxhash64("bin"), F.lit(nodes).cast("long")))
    schema, level, done = spread.schema, 1, None
    while True:
        passed = 0 if nodes == 1 else node_pieces // FAN_IN
        packed = saved(spread.groupBy("node").applyInPandas(_pack_node(level, capacity, passed), schema))
        done = packed.where("done") if done is None else done.unionAll(packed.where("done"))
        if nodes == 1:
            break
        nodes = -(-nodes // FAN_IN)
        spread = packed.where("not done").withColumn("node", F.floor(F.col("node") / FAN_IN))
        level += 1
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id",
                   capacity: int = CAPACITY, node_pieces: int = NODE_PIECES) -> DataFrame:
    """Pack the ids of every text, each followed by id 0, into sequences of at most ``capacity`` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the single
    id 0. Repeated rows and rows without doc_id are packed like others. Other columns of ``docs`` are not read.
    ``sequences`` gives the packed ids themselves.
    """
    return pack(token_pieces(docs, tokenizer, text, key, capacity), capacity, node_pieces)


def sequences(docs: DataFrame, tokenizer: str, packed: DataFrame, text: str = "text", key: str = "doc_id",
              capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences: sequence_id and its ids in order. doc_id must be unique and not null."""
    pieces = token_pieces(docs, tokenizer, text, key, capacity, with_ids=True).select("doc_id", "piece", "ids")
    return (packed.join(pieces, ["doc_id", "piece"]).groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
            .select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids")))
