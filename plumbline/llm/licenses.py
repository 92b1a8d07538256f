"""License scans by a positional index of rare words (operator 6), in DataFrame functions only.

Templates are licence notices and short phrases. In every file only words of a template with the highest inverse
document frequency are looked up; all their places, shifted by the position in the template, say where the template may
begin. Begins are then held against all words of the template at their relative positions, and a label needs its
mandatory key phrases in their places there. A begin that counts has every mandatory word in its place, so the rarest of
them finds all such begins; a notice without mandatory words is looked up by as many words as a begin cannot all lack.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a notice's summed IDF that has to stand in its place.
COVERED = 0.6
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``notice``: normalised words. ``phrases``: mandatory runs of words of the notice. ``base``: counted places."""

    label: str
    notice: str
    phrases: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    def required(self) -> set[int]:
        """Positions that the key phrases cover; of a base phrase, all."""
        words, out = self.words, set(range(len(self.words))) if self.base else set()
        for phrase in self.phrases:
            part = phrase.split()
            at = next(i for i in range(len(words)) if words[i:i + len(part)] == part)
            out |= set(range(at, at + len(part)))
        return out


# fixed values: phrases and labels that every scan has, then notices of common licences
TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3",
             ("gnu general public license version 3",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2",
             ("gnu general public license version 2",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
             ("mozilla public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             ("redistribution and use",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("unencumbered software",)),
)


def file_words(text: Column) -> Column:
    """Words of a whole text, A-Z in lower case; the Kelvin sign is kept from becoming an ASCII k."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(lowered, NOT_WORD, -1), "")


def word_weights(docs: DataFrame, text: str, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """IDF of the templates' words over all rows; as many values as the templates have words."""
    lexicon = sorted({w for t in templates for w in t.words})
    known = F.array(*map(F.lit, lexicon))
    found = docs.select(F.explode(F.concat(F.array_intersect(file_words(F.col(text)), known), F.array(F.lit("")))).alias(
        "word")).groupBy("word").agg(F.count("*").alias("files")).collect()
    files = {r["word"]: r["files"] for r in found}
    total = files.get("", 0)  # every row has the empty word once
    return {w: math.log((total + 1) / (files.get(w, 0) + 1)) + 1e-6 for w in lexicon}


def _less(place: int):
    return lambda i: i - place


def _begins(word: str, places: list[int]) -> Column:
    """Where a template may begin, by the places of ``word`` in the file and its positions in the template."""
    at = F.filter(F.transform("words", lambda w, i: F.when(w == word, i)), lambda i: i.isNotNull())
    shifted = [F.transform(at, _less(p)) for p in places]
    return shifted[0] if len(shifted) == 1 else F.array_distinct(F.concat(*shifted))


def _looked_up(template: Template, weights: dict[str, float]) -> list[int]:
    """Positions of the template of which every begin that counts has at least one in its place."""
    words, required = template.words, template.required()
    rarest = sorted(required or range(len(words)), key=lambda i: (-weights[words[i]], words[i], i))
    if required:
        return rarest[:1]
    taken, spare = [], (1 - COVERED) * sum(weights[w] for w in words)
    for i in rarest:
        taken.append(i)
        spare -= weights[words[i]]
        if spare < -1e-9:
            break
    return taken


def _found(template: Template, weights: dict[str, float]) -> Column:
    """Array of (begin, cover) of a template in the file: cover is the share of its IDF that stands in its place."""
    words, total = template.words, sum(weights[w] for w in template.words)
    required = template.required()
    own = [_begins(words[p], [p]) for p in _looked_up(template, weights)]
    begins = own[0] if len(own) == 1 else F.array_distinct(F.concat(*own))

    def stands(s: Column, i: int) -> Column:
        return F.get("words", s + i).eqNullSafe(F.lit(words[i]))

    def complete(s: Column) -> Column:
        whole = F.lit(True)
        for i in sorted(required, key=lambda i: (-weights[words[i]], i)):
            whole = whole & stands(s, i)
        return whole

    def cover(s: Column) -> Column:
        if len(required) == len(words):
            return F.lit(1.0)
        return sum((F.when(stands(s, i), F.lit(weights[w])).otherwise(0.0) for i, w in enumerate(words)),
                   F.lit(0.0)) / F.lit(total)

    places = F.filter(begins, complete)
    return F.transform(places, lambda s: F.struct(s.cast("long").alias("begin"),
                                                  F.least(cover(s), F.lit(1.0)).alias("cover")))


def _named(t: Template):
    return lambda m: F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), m["begin"].alias("begin"),
                              m["cover"].alias("cover"))


def license_scan(docs: DataFrame, text: str = "text", key: str = "doc_id",
                 templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, matches (array of label, base, begin, cover).

    A null text is empty and has no words. Notices count from a cover of ``COVERED``. Repeated rows and rows without
    doc_id each get their row; other columns are not read. An empty table gives an empty result.
    """
    weights = word_weights(docs, text, templates)
    known = F.array(*map(F.lit, sorted(weights)))
    words = docs.select(F.col(key).alias("doc_id"), file_words(F.col(text)).alias("words"))
    words = words.select("*", F.array_intersect("words", known).alias("present"))
    kind = "array<struct<label: string, base: boolean, begin: bigint, cover: double>>"
    each = []
    for t in templates:
        found = F.transform(_found(t, weights), _named(t))
        rare = sorted({t.words[i] for i in _looked_up(t, weights)})
        each.append(F.when(F.arrays_overlap("present", F.array(*map(F.lit, rare))), found).otherwise(
            F.array().cast(kind)))
    matches = F.when(F.size("present") > 0, F.concat(*each)).otherwise(F.array().cast(kind))
    rows = words.select("doc_id", F.size("words").cast("long").alias("n_words"), matches.alias("matches"))
    return rows.withColumn("matches", F.filter("matches", lambda m: m["base"] | (m["cover"] >= COVERED)))


def labelled(scan: DataFrame) -> DataFrame:
    """Digest of ``license_scan``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.filter("matches", lambda m: m["base"])
    rows = scan.select("doc_id", "n_words", "matches", base.alias("b"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.col(c)["label"])), ",")
    return rows.select("doc_id", "n_words", F.size("b").cast("long").alias("n_base"),
                       F.array_min(F.col("b")["begin"]).alias("first_word"),
                       F.array_max(F.col("b")["begin"]).alias("last_word"), joined("b").alias("base_labels"),
                       joined("matches").alias("labels"),
                       F.coalesce(F.array_max(F.col("matches")["cover"]), F.lit(0.0)).alias("score"))
