"""SentencePiece encoding and decoding by vectorised merge rounds (operator 11).

Texts are cut where no piece of the vocabulary could reach across: between white space and what stands before it, and
between any two characters that stand side by side in no piece. The cuts of a batch lie one after another in flat numpy
arrays. In every round each cut finds the best rank among its adjacent pairs, all its leftmost non-overlapping pairs of
that rank merge at once, and the arrays are compacted, until no cut has a pair left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from sentencepiece import SentencePieceProcessor

#: What the library writes for a space inside pieces.
SPACE = "▁"
#: Cuts whose ids a Python worker remembers, emptied when full, and the longest cut that is remembered.
REMEMBERED, REMEMBERED_CHARS = 400_000, 40
#: Code points and ids handled together, but for a text that is longer by itself.
TOGETHER = 1 << 21
_NEVER = np.int64(1) << np.int64(40)


class PieceModel:
    """Pair ranks, character symbols and pieces of a BPE model, read through the library's own accessors.

    A symbol is the id of a piece; a character without a piece is the symbol ``size + code point`` and merges with
    nothing. Models with another algorithm, a normalisation, or user-defined or unused pieces are refused.
    """

    def __init__(self, path: str):
        library = SentencePieceProcessor(model_file=path)
        self.size = size = library.get_piece_size()
        pieces = library.id_to_piece(list(range(size)))
        self.byte_of = {i: int(pieces[i][3:5], 16) for i in range(size) if library.is_byte(i)}
        self.control = {i for i in range(size) if library.is_control(i)}
        self.unknown, self.end = library.unk_id(), library.eos_id()
        special = self.control | set(self.byte_of) | {self.unknown}
        spec = _normalizer(library.serialized_model_proto())
        if spec != _PLAIN_SPEC or any(library.is_unused(i) for i in range(size)):
            raise ValueError(f"the model in {path} is no plain BPE model with a prefix space: {spec}")
        ids = {p: i for i, p in enumerate(pieces) if i not in special}
        # equal scores share a rank; a lower rank merges first
        _, rank = np.unique([-library.get_score(i) for i in range(size)], return_inverse=True)
        self.rank = rank.astype(np.int64)
        splits = [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p))
                  if p[:k] in ids and p[k:] in ids]
        left, right, merged = (np.array(x, np.int64) for x in (zip(*splits, strict=True) if splits else ((), (), ())))
        keys = self._key(left, right)
        order = np.argsort(keys)
        self.pairs, self.merged = keys[order], merged[order]
        self.symbol = np.arange(0x110000, dtype=np.int64) + size
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        beside = {p[k:k + 2] for p in ids for k in range(len(p) - 1)}
        self.beside = np.sort(self._key(*(self.symbol[[ord(p[k]) for p in beside]] for k in (0, 1))))
        # a piece is made one at a time in a cut if another piece that holds it ranks no lower, or ranks are shared:
        # then what the first merge makes possible may come before the second
        self.one_by_one = np.zeros(size, bool)
        for part in (left, right):
            self.one_by_one[part[self.rank[merged] <= self.rank[part]]] = True
        made = np.unique(merged)
        shared = np.bincount(self.rank[made], minlength=self.rank.max() + 1) > 1
        self.one_by_one[made[shared[self.rank[made]]]] = True
        space_ends = all(SPACE not in p.lstrip(SPACE) for p in ids)
        line_alone = not any("\n" in p for p in ids)
        self.cut = re.compile(r"(?s) *[^ \n]+| +|\n" if space_ends and line_alone else
                              r"(?s) *[^ ]+| +" if space_ends else r"(?s).+").findall
        byte_ids = {b: i for i, b in self.byte_of.items()}
        self.bytes_as_ids = [byte_ids.get(b, self.unknown) for b in range(256)]
        self.falls_back = len(self.byte_of) == 256
        self.written = [b"" if i in self.control else library.decode([i]).encode() if i == self.unknown else
                        bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(pieces)]
        self.bytes_here = np.zeros(size, bool)
        self.bytes_here[list(self.byte_of)] = True
        self.known: dict[str, bytes] = {}

    @classmethod
    def of_worker(cls, path: str) -> PieceModel:
        """The model of this Python process, which outlives a task."""
        if getattr(cls, "kept", (None,))[0] != path:
            cls.kept = path, cls(path)
        return cls.kept[1]

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left * np.int64(self.size + 0x110000) + right

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of adjacent pairs; the rank is ``_NEVER`` where a pair is no piece."""
        keys = self._key(left, right)
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        hit = self.pairs[at] == keys
        piece = np.where(hit, self.merged[at], 0)
        return np.where(hit, self.rank[piece], _NEVER), piece

    def merge_rounds(self, symbols: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and the place of the first character of each; ``cut`` numbers the cuts, rising."""
        place = np.arange(len(symbols))
        done_symbols, done_places = [], []
        inside = np.append(cut[1:] == cut[:-1], False)
        rank, piece = np.full(len(symbols), _NEVER), np.zeros(len(symbols), np.int64)
        at = np.flatnonzero(inside)
        if len(at):
            rank[at], piece[at] = self._ranked(symbols[at], symbols[at + 1])
        while len(symbols):
            starts = np.flatnonzero(np.append(True, cut[1:] != cut[:-1]))
            sizes = np.diff(np.append(starts, len(cut)))
            best = np.minimum.reduceat(rank, starts)
            live = np.repeat(best < _NEVER, sizes)
            if not live.all():  # cuts without a pair are finished
                done_symbols.append(symbols[~live])
                done_places.append(place[~live])
                symbols, place, cut, rank, piece = (x[live] for x in (symbols, place, cut, rank, piece))
                continue
            chosen = rank == np.repeat(best, sizes)
            # of chosen pairs that overlap in a row, every second one merges, from the left
            spots = np.flatnonzero(chosen)
            first = np.append(True, np.diff(spots) > 1)
            run = np.maximum.accumulate(np.where(first, np.arange(len(spots)), 0))
            taken = (np.arange(len(spots)) - run) % 2 == 0
            lone = self.one_by_one[piece[spots]]
            if lone.any():
                opening = np.append(True, cut[spots[1:]] != cut[spots[:-1]])
                taken &= opening | ~np.repeat(np.logical_or.reduceat(lone, np.flatnonzero(opening)),
                                              np.diff(np.append(np.flatnonzero(opening), len(spots))))
            spots = spots[taken]
            symbols[spots] = piece[spots]
            keep = np.ones(len(symbols), bool)
            keep[spots + 1] = False
            spots = (np.cumsum(keep) - 1)[spots]
            symbols, place, cut, rank, piece = (x[keep] for x in (symbols, place, cut, rank, piece))
            # the pairs that end or begin at a merged symbol are new
            fresh = np.unique(np.concatenate([spots, spots[spots > 0] - 1]))
            rank[fresh] = _NEVER
            fresh = fresh[fresh + 1 < len(cut)]
            fresh = fresh[cut[fresh] == cut[fresh + 1]]
            rank[fresh], piece[fresh] = self._ranked(symbols[fresh], symbols[fresh + 1])
        if not done_places:
            return symbols, place
        place = np.concatenate(done_places)
        order = np.argsort(place, kind="stable")
        return np.concatenate(done_symbols)[order], place[order]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of every word as little-endian 32-bit integers."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        symbols, word = self.symbol[points], np.repeat(np.arange(len(words)), lengths)
        keys = self._key(symbols[:-1], symbols[1:])
        at = np.minimum(np.searchsorted(self.beside, keys), len(self.beside) - 1)
        apart = (self.beside[at] != keys) | (word[1:] != word[:-1])
        symbols, place = self.merge_rounds(symbols, np.concatenate([[0], np.cumsum(apart)]))
        word = word[place]
        unknown = symbols >= self.size
        if unknown.any():
            symbols, word = self._with_unknown(symbols, word, unknown)
        ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
        raw = symbols.astype("<i4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _with_unknown(self, symbols: np.ndarray, word: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the ids of their bytes; where the model has none, a run of them is unknown."""
        if not self.falls_back:
            again = unknown & np.append(False, unknown[:-1] & (word[1:] == word[:-1]))
            return np.where(unknown, self.unknown, symbols)[~again], word[~again]
        coded = [chr(s).encode() for s in (symbols[unknown] - self.size).tolist()]
        times = np.ones(len(symbols), np.int64)
        times[unknown] = [len(c) for c in coded]
        out, expanded = np.repeat(symbols, times), np.repeat(unknown, times)
        out[expanded] = np.array(self.bytes_as_ids)[np.frombuffer(b"".join(coded), np.uint8)]
        return out, np.repeat(word, times)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, with the end id."""
        end = np.array([self.end], "<i4").tobytes()
        cuts = [self.cut(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        fresh = list(set().union(*cuts).difference(self.known))
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = list(set().union(*cuts))
        table = dict(zip(fresh, self._encode_words([w.replace(" ", SPACE) for w in fresh]), strict=True)) if fresh else {}
        self.known.update(table)
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, c)) + end, "<i4") for c in cuts]
        for long in [w for w in table if len(w) > REMEMBERED_CHARS]:
            del self.known[long]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a row of ids, as the library decodes it: control ids are silent, the space that opens the text
        goes, and a run of bytes is read as UTF-8, every byte that is no part of a character as U+FFFD."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < self.size:
            raise ValueError("id outside of the vocabulary")
        silent = np.isin(ids, list(self.control))
        first = int(np.argmin(silent)) if len(ids) else 0
        parts = list(map(self.written.__getitem__, ids.tolist()))
        if parts and parts[first].startswith(b" ") and ids[first] != self.unknown and ids[first] not in self.byte_of:
            parts[first] = parts[first][1:]
        try:
            if not (silent[first:-1].any() and self.bytes_here[ids].any()):  # a control id would part a run of bytes
                return b"".join(parts).decode()
        except UnicodeDecodeError:
            pass
        out, run = [], b""
        for part, byte in zip(parts, self.bytes_here[ids].tolist(), strict=True):
            if byte:
                run += part
            else:
                out += [_readable(run), part.decode()]
                run = b""
        return "".join([*out, _readable(run)])


def _readable(run: bytes) -> str:
    out = []
    while run:
        try:
            out.append(run.decode())
            break
        except UnicodeDecodeError as wrong:
            out += [run[:wrong.start].decode(), "�"]
            run = run[wrong.start + 1:]
    return "".join(out)


#: Algorithm BPE, no character map, prefix space, white space kept and written as ``SPACE``.
_PLAIN_SPEC = {"model": 2, "map": b"", "prefix": 1, "remove": 0, "escape": 1}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields (number, value) of one protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at:at + size]
            at += size


def _normalizer(model: bytes) -> dict:
    """What of the model's settings changes texts; the accessors of the library do not tell these."""
    found = _PLAIN_SPEC | {"model": 1, "remove": 1}  # the format's defaults
    for number, value in _fields(model):
        if number == 2:
            found["model"] = dict(_fields(value)).get(3, 1)
        elif number == 3:
            names = {2: "map", 3: "prefix", 4: "remove", 5: "escape"}
            found |= {names[n]: v for n, v in _fields(value) if n in names}
    return found


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold ``TOGETHER`` units at most, or one row."""
    first = total = 0
    for i, size in enumerate(sizes):
        if total + size > TOGETHER and i > first:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def encode(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``ids`` of every row: the ids of its whole text and the end id, no sampling.

    A null or empty text has the end id alone. Rows are independent, so repeated rows and rows without doc_id are
    encoded like others; other columns are not read; an empty table gives an empty result. ``model`` is the path of the
    model file on every machine.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceModel.of_worker(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _slices([len(t) for t in texts]):
                ids = table.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(np.concatenate(ids)))], ["doc_id", "ids"])

    given = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids. Null ids give a null text, no ids an empty one; null elements and ids
    outside of the vocabulary end in an error."""
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceModel.of_worker(model)
        for batch in batches:
            rows = batch.column(at)
            for a, b in _slices(rows.value_lengths().fill_null(0).to_pylist()):
                part = rows.slice(a, b - a)
                values, offsets = part.values.to_numpy(), part.offsets.to_numpy()
                texts = [table.decode(values[x:y]) if some else None for x, y, some in
                         zip(offsets[:-1], offsets[1:], part.is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(texts, pa.string())],
                                                 [*batch.schema.names, name])

    return encoded.mapInArrow(run, StructType([*encoded.schema, StructField(name, StringType())]))
