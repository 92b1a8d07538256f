"""Personal data replaced by keyed surrogates (operator 10).

Entities are found by patterns. Equal entities get equal surrogates in all documents (coreference), different ones get
different surrogates (distinctness): surrogates are drawn by a keyed hash from the forms of the entity's own type, then
held against all other surrogates and all real entities, and drawn anew until no two meet. A surrogate keeps what its
type shows: script, letter case, digits and punctuation; gender of a name; check digits that hold or do not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Draws before the search for a free surrogate is given up with an error.
MAX_DRAWS = 40

# fixed values: titles by gender, then first names by script and gender
TITLES = {"m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "господин"),
          "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Sra", "госпожа"),
          "n": ("Dr", "Prof", "Professor")}
FIRST_NAMES = {
    ("latin", "m"): "Adam Bruno Carl David Edgar Felix Georg Hugo Ivan Jonas Karl Louis Marco Noah Oscar Paul".split(),
    ("latin", "f"): "Anna Berta Clara Diana Elena Flora Greta Helen Irene Julia Karla Laura Maria Nora Olga Paula".split(),
    ("latin", "n"): "Alex Ash Casey Charlie Dana Jamie Jordan Kim Lee Morgan Robin Sam Sasha Taylor Toni Val".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Иван Кирилл Лев Максим Павел".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга".split(),
    ("cyrillic", "n"): "Женя Саша Валя Шура Слава Паша".split()}
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ka ke la le li ma me mo na ne no ra re ri sa se ta te to va".split(),
             "cyrillic": "ба бе во га да де ка ле ли ма ме но ра ре ри са се та те то".split()}

_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+"
_TITLE = "|".join(t for group in TITLES.values() for t in group)
#: Patterns in order of precedence; a later one takes only what earlier ones have left.
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b")),
    ("secret", re.compile(r"(?i)\b(?:token|password|passwd|secret|api[_-]?key)\b\s*[=:]\s*[\"']?"
                          r"(?P<value>[A-Za-z0-9_\-+/]{6,})")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("card", re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,5}(?!\w)")),
    ("name", re.compile(rf"\b(?:{_TITLE})\.? (?P<value>{_NAME}(?:[ -]{_NAME}){{0,2}})")),
)
_GENDER = {t: g for g, group in TITLES.items() for t in group}


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, value) of the entities of a text, in order, without overlaps; a name's type has its gender."""
    taken: list[tuple[int, int, str, str]] = []
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text or ""):
            start, end = m.span("value" if "value" in pattern.groupindex else 0)
            if all(end <= a or start >= b for a, b, _, _ in taken):
                full = f"name_{_GENDER[re.match(r'\w+', m[0])[0]]}" if kind == "name" else kind
                taken.append((start, end, full, text[start:end]))
    return sorted(taken)


def canonical(kind: str, value: str) -> str:
    """The form under which mentions are one entity: letter case of addresses and marks inside numbers don't count."""
    if kind == "email":
        return value.lower()
    if kind in ("phone", "card", "iban"):
        return re.sub(r"[^0-9A-Za-z+]", "", value)
    return value


class Draw:
    """A stream of numbers that the key, the entity and the draw's number fix."""

    def __init__(self, key: bytes, kind: str, entity: str, draw: int):
        self.seed, self.count = (kind, entity, draw), 0
        self.state = hashlib.blake2b(repr(self.seed).encode(), key=hashlib.sha256(key).digest()).digest()

    def below(self, n: int) -> int:
        self.count += 1
        word = hashlib.blake2b(self.state + self.count.to_bytes(4, "little"), digest_size=8).digest()
        return int.from_bytes(word, "little") % n


def _luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _like(c: str, draw: Draw) -> str:
    """A character of the same class: digit, or letter of the same script and case; others stay."""
    for low, high in (("0", "9"), ("a", "z"), ("A", "Z"), ("а", "я"), ("А", "Я"), ("α", "ω"), ("Α", "Ω")):
        if low <= c <= high:
            while (new := chr(ord(low) + draw.below(ord(high) - ord(low) + 1))) in "ς΢":
                pass
            return new
    return c


def _digits(value: str, draw: Draw, checked: bool) -> str:
    """Other digits in the same places, the first not 0; if ``checked``, a Luhn sum that holds just as before."""
    old = [int(c) for c in value]
    new = [draw.below(10) for _ in old]
    new[0] = 1 + draw.below(9) if old[0] else 0
    if checked:
        holds = _luhn(old)
        new[-1] = next(d for d in (new[-1:] if not holds else []) + list(range(10))
                       if _luhn([*new[:-1], d]) == holds)
    return "".join(map(str, new))


def surrogate(key: bytes, kind: str, entity: str, draw_number: int) -> str:
    """The surrogate of a canonical entity, in canonical form, at the given draw."""
    draw = Draw(key, kind, entity, draw_number)
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels = domain.split(".")
        hosts = ["".join(_like(c, draw) for c in label) for label in labels[:-1]]
        return "".join(_like(c, draw) for c in local) + "@" + ".".join([*hosts, labels[-1]])
    if kind == "ip":
        return ".".join(str((1, 1 + draw.below(9), 10 + draw.below(90), 100 + draw.below(156))[len(part)])
                        for part in entity.split("."))
    if kind == "card":
        return _digits(entity, draw, checked=True)
    if kind == "phone":
        kept = len(re.match(r"\+?1?", entity)[0]) if entity.startswith("+1") else int(entity.startswith("+"))
        return entity[:kept] + _digits(entity[kept:], draw, checked=False)
    if kind == "iban":
        return entity[:2] + "".join(_like(c, draw) for c in entity[2:])
    if kind.startswith("name"):
        script = "cyrillic" if re.search("[а-яА-ЯёЁ]", entity) else "latin"
        parts = re.split("([ -])", entity)
        # a single name after a title is a family name; of several, the first is a first name
        out = [p if p in " -" else "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))]
                                           for _ in range(2 + draw_number // 4 + draw.below(2))).capitalize() for p in parts]
        if len(parts) > 1:
            names = FIRST_NAMES[script, kind[-1]]
            out[0] = names[draw.below(len(names))]
        return "".join(out)
    return "".join(_like(c, draw) if draw_number < MAX_DRAWS // 2 or not c.isalpha() else c for c in entity)


def in_format(kind: str, mention: str, new: str) -> str:
    """The canonical surrogate in the form of a mention: its marks between characters, its letter case."""
    if kind in ("phone", "card", "iban"):
        given = iter(new)
        return "".join(next(given) if re.match(r"[0-9A-Za-z+]", c) else c for c in mention)
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(mention, new, strict=True))
    return new


def _detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("type", pa.string()),
                               ("entity", pa.string())]))
    for batch in batches:
        rows, found = [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            if got := entities(text):
                rows.append(row)
                found.append([{"first": a, "last": b, "type": t, "entity": canonical(t, v)} for a, b, t, v in got])
        take = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take),
                                          pa.array(found, kind)], ["doc_id", "digest", "found"])


def assigned(mentions: DataFrame, secret: bytes) -> DataFrame:
    """type, entity, surrogate of every distinct (type, entity), no surrogate twice in a type and none a real entity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values, draws = (batch.column(i).to_pylist() for i in range(3))
            made = [surrogate(secret, *row) for row in zip(kinds, values, draws, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())],
                                             ["type", "entity", "draw", "surrogate"])

    def drawn(rows: DataFrame) -> DataFrame:
        return rows.select("type", "entity", "draw").mapInArrow(run, "type string, entity string, draw int, surrogate string")

    real = saved(mentions.select("type", "entity").distinct())
    rows = saved(drawn(real.select("*", F.lit(0).alias("draw"))))
    for _ in range(MAX_DRAWS):
        # the smallest entity keeps a surrogate that several have drawn
        first = rows.groupBy("type", "surrogate").agg(F.min("entity").alias("owner"), F.count("*").alias("n"))
        clash = rows.join(first.where("n > 1"), ["type", "surrogate"]).where("entity <> owner").select("type", "entity")
        taken = rows.join(real.withColumnRenamed("entity", "surrogate"), ["type", "surrogate"], "left_semi")
        again = saved(clash.unionAll(taken.select("type", "entity")).distinct())
        if again.isEmpty():
            return rows.select("type", "entity", "surrogate")
        redrawn = drawn(rows.join(again, ["type", "entity"], "left_semi").withColumn("draw", F.col("draw") + 1))
        rows = saved(rows.join(again, ["type", "entity"], "left_anti").unionAll(redrawn))
    raise ValueError(f"no distinct surrogates after {MAX_DRAWS} draws")


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, kinds = [], [], []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            out, at = [], 0
            for e in sorted(found or [], key=lambda e: e["first"]):
                out += [text[at:e["first"]], in_format(e["type"], text[e["first"]:e["last"]], e["surrogate"])]
                at = e["last"]
            texts.append(text if not found else "".join([*out, text[at:]]))
            counts.append(len(found or []))
            kinds.append(",".join(sorted({e["type"] for e in found or []})))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                                          pa.array(kinds, pa.string())], ["doc_id", "text", "n_entities", "types"])


def with_surrogates(docs: DataFrame, secret: bytes, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text with surrogates, n_entities, types (sorted, comma-joined) of every row of ``docs``.

    A null text stays null and has no entities. Rows are told apart by doc_id and text, so repeated rows and rows
    without doc_id each get their row. Other columns are not read; an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    digest = F.xxhash64("text", F.length("text"))
    found = saved(given.select("doc_id", "text", digest.alias("digest")).mapInArrow(
        _detected, f"doc_id {kind}, digest long, found array<struct<first: int, last: int, type: string, entity: string>>"))
    mentions = found.dropDuplicates(["doc_id", "digest"]).select("doc_id", "digest", F.inline("found"))
    names = assigned(mentions, secret)
    place = F.struct("first", "last", "type", "surrogate")
    by_doc = mentions.join(names, ["type", "entity"]).groupBy("doc_id", "digest").agg(F.collect_list(place).alias("found"))
    by_doc = by_doc.toDF("k", "d", "found")
    rows = given.join(by_doc, F.col("doc_id").eqNullSafe(F.col("k")) & (digest == F.col("d")), "left")
    return rows.select("doc_id", "text", "found").mapInArrow(
        _replaced, f"doc_id {kind}, text string, n_entities long, types string")
