"""Merkle manifest of a table, with proofs by octopus multiproofs (operator 12).

Rows are leaves; the leaves of a group are ordered and every ``FAN`` consecutive nodes become their hash, level by level,
until one is left; the subroots of all groups, ordered by group, become the root likewise. Digests are lowercase hex
SHA-256 over concatenated hex texts.

Leaves are numbered through range partitions, so no group has to fit in a task, and trees are built in blocks of
``FAN ** DEEP`` nodes. For proofs, every block of leaves finds the smallest set of node coordinates that it cannot derive
from its own leaves, the coordinates of all blocks are fetched in one join, and the block derives what its leaves share
and writes out each leaf's own proof.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import saved, small

FAN = 8
#: Levels that one block holds above its leaves: a block has ``FAN ** DEEP`` of them.
DEEP = 4
BLOCK = FAN ** DEEP
#: Rows of a range partition, on average, where there are more than the shuffle partitions make of them.
CHUNK_ROWS = 200_000
NODES = "g string, level int, idx long, hash string"


def digest(*values: Column) -> Column:
    """Digest of a row: of each value ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*map(part, values)), 256)


def _parent(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def _above(n: int) -> int:
    """Nodes on the level above ``n`` nodes."""
    return -(-n // FAN)


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``idx``, the place in ``order`` within the group ``g``, and ``n``, the rows of the group."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // CHUNK_ROWS)
    # the number of a row is its partition and its place there, so it rises with the order once it is written
    ranged = rows.repartitionByRange(parts, "g", *order).sortWithinPartitions("g", *order)
    ranged = saved(ranged.withColumn("at", F.monotonically_increasing_id()))
    chunk = F.shiftright("at", 33)
    runs = ranged.groupBy("g", chunk.alias("chunk")).agg(F.min("at").alias("first"), F.count("*").alias("c"))
    # a group has one row for each range partition it touches
    before = Window.partitionBy("g").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    runs = saved(runs.select("g", "chunk", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"),
                             F.sum("c").over(Window.partitionBy("g")).alias("n")))
    joined = ranged.withColumn("chunk", chunk).join(small(runs, 80), ["g", "chunk"])
    return joined.withColumn("idx", F.col("at") - F.col("first") + F.col("before")).drop("at", "chunk", "first", "before")


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes above one block of nodes; ``n`` is the number of nodes of the group on the level of ``rows``."""
    rows = rows.sort_values("idx")
    g, level, first, n = (rows[c].iloc[0] for c in ("g", "level", "idx", "n"))
    hashes, out = rows["hash"].tolist(), []
    for up in range(1, DEEP + 1):
        if n == 1:
            break
        hashes = [_parent(hashes[i:i + FAN]) for i in range(0, len(hashes), FAN)]
        n, first = _above(n), first // FAN
        out += [(g, level + up, first + i, h, n) for i, h in enumerate(hashes)]
    return pd.DataFrame(out, columns=["g", "level", "idx", "hash", "n"])


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """All nodes of the trees over ``leaves`` (g, idx, hash, n), ``DEEP`` levels to a table, lowest first: g, level,
    idx, hash, n, where n is the number of nodes on the level."""
    tables = [leaves.select("g", F.lit(0).alias("level"), "idx", "hash", F.col("n").cast("long").alias("n"))]
    while True:
        top = tables[-1].where((F.col("n") > 1) & (F.col("level") == DEEP * (len(tables) - 1)))
        if top.isEmpty():
            return tables
        tables.append(saved(top.groupBy("g", F.floor(F.col("idx") / BLOCK)).applyInPandas(_built, NODES + ", n long")))


@dataclass
class Manifest:
    """``leaves``: g, idx, n, leaf and the columns of the rows that were kept. ``groups``: g, n, subroot, and the place
    ``top`` of the subroot among ``top_n``. ``nodes`` and ``top_nodes``: tables of g, level, idx, hash. ``root`` is one
    row with the root, none for an empty table."""

    leaves: DataFrame
    groups: DataFrame
    nodes: list[DataFrame]
    top_nodes: list[DataFrame]
    root: DataFrame


def manifest(docs: DataFrame, columns: list[str], key: str = "doc_id", group: str = "lang",
             keep: dict[str, Column] | None = None) -> Manifest:
    """The trees over the rows of ``docs``: a leaf is the digest of ``columns``, a group the rows with equal ``group``.

    A null group is a group of its own and comes first, as a null ``key`` does in its group. Rows with equal key are in
    order of their digest; equal rows are leaves of their own with equal digests. ``keep`` names what else is kept of
    each row. Columns that are not named are not read. An empty table has no nodes and no root.
    """
    group_key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = saved(docs.select(group_key.alias("g"), F.col(key).alias("key"), digest(*map(F.col, columns)).alias("leaf"),
                             *(c.alias(f"keep_{name}") for name, c in (keep or {}).items()),
                             F.monotonically_increasing_id().alias("id")))
    leaves = saved(_numbered(rows, [F.col("key").asc_nulls_first(), F.col("leaf"), F.col("id")]).drop("id"))
    nodes = _levels(leaves.withColumnRenamed("leaf", "hash"))
    subroots = nodes[0].where("n = 1")
    for table in nodes[1:]:
        subroots = subroots.unionByName(table.where("n = 1"))
    # the subroots are the leaves of one more tree
    subroots = saved(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "hash"))
    numbered = saved(_numbered(subroots, [F.col("of")]))
    top_nodes = _levels(numbered)
    root = top_nodes[0].where("n = 1")
    for table in top_nodes[1:]:
        root = root.unionByName(table.where("n = 1"))
    sizes = leaves.groupBy("g").agg(F.max("n").alias("n"))
    groups = saved(sizes.join(numbered.select(F.col("of").alias("g"), F.col("idx").alias("top"),
                                              F.col("n").alias("top_n"), F.col("hash").alias("subroot")), "g"))
    strip = lambda tables: [t.select("g", "level", "idx", "hash") for t in tables]
    return Manifest(leaves, groups, strip(nodes), strip(top_nodes), root.select(F.col("hash").alias("root")))


def missing(places: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Coordinates (level, idx) that the proofs of the leaves ``places`` of ``n`` need beside what those leaves give:
    children of nodes on the way to the root that are neither leaves of ``places`` nor above one of them."""
    out, level, known = [], 0, np.unique(places)
    while n > 1:
        parents = np.unique(known // FAN)
        children = (parents[:, None] * FAN + np.arange(FAN)).ravel()
        needed = np.setdiff1d(children[children < n], known, assume_unique=True)
        out += [(level, i) for i in needed.tolist()]
        known, n, level = parents, _above(n), level + 1
    return out


def _derived(known: dict[int, str], n: int, fetched: dict[tuple[int, int], str]) -> tuple[list[dict[int, str]], str]:
    """Nodes by level, from leaves and fetched nodes, and the root."""
    levels = []
    while n > 1:
        level = len(levels)
        parents, whole = {}, dict(known)
        for parent in {i // FAN for i in known}:
            for i in range(parent * FAN, min(n, parent * FAN + FAN)):
                if i not in whole:
                    whole[i] = fetched[level, i]
            parents[parent] = _parent([whole[i] for i in range(parent * FAN, min(n, parent * FAN + FAN))])
        levels.append(whole)
        known, n = parents, _above(n)
    return levels, next(iter(known.values()))


def _siblings(levels: list[dict[int, str]], idx: int, n: int) -> str:
    out = []
    for nodes in levels:
        first = idx - idx % FAN
        out += [nodes[i] for i in range(first, min(n, first + FAN)) if i != idx]
        idx, n = idx // FAN, _above(n)
    return "".join(out)


def _expand(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
    """Proofs of the leaves of one block from its leaves and what it has fetched."""
    own: tuple[dict, dict] = ({}, {})
    for tree, level, idx, value in zip(*(fetched[c].to_pylist() for c in ("tree", "level", "idx", "hash")), strict=True):
        own[tree][level, idx] = value
    n, top, top_n = (leaves[c][0].as_py() for c in ("n", "top", "top_n"))
    places = leaves["idx"].to_pylist()
    levels, subroot = _derived(dict(zip(places, leaves["leaf"].to_pylist(), strict=True)), n, own[0])
    above, root = _derived({top: subroot}, top_n, own[1])
    shared = _siblings(above, top, top_n)
    added = {"subroot": [subroot] * len(places), "root": [root] * len(places),
             "proof": [_siblings(levels, i, n) + shared for i in places]}
    leaves = leaves.drop_columns(["block"])
    for name, values in added.items():
        leaves = leaves.append_column(name, pa.array(values, pa.string()))
    return leaves


def proofs(made: Manifest, leaves: DataFrame | None = None) -> DataFrame:
    """The columns of ``leaves`` (of all leaves of ``made``, or any rows of them) with ``top``, ``top_n``, ``subroot``,
    ``root`` and ``proof``: the siblings' digests one after another, level by level up to the root, left to right."""
    leaves = made.leaves if leaves is None else leaves
    groups = small(made.groups.select("g", "top", "top_n"), 60)
    leaves = leaves.join(groups, "g").withColumn("block", F.floor(F.col("idx") / BLOCK))
    # at most BLOCK places in a block
    blocks = leaves.groupBy("g", "block").agg(F.collect_set("idx").alias("places"), F.max("n").alias("n"),
                                              F.max("top").alias("top"), F.max("top_n").alias("top_n"))

    def coordinates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for g, block, places, n, top, top_n in frame[["g", "block", "places", "n", "top", "top_n"]].itertuples(
                    index=False, name=None):
                rows += [(g, block, 0, g, *c) for c in missing(np.asarray(places), n)]
                rows += [(g, block, 1, "", *c) for c in missing(np.array([top]), top_n)]
            yield pd.DataFrame(rows, columns=["of", "block", "tree", "g", "level", "idx"])

    wanted = saved(blocks.mapInPandas(coordinates, "of string, block long, tree int, g string, level int, idx long"))
    reach = {(r["tree"], r["table"]) for r in wanted.select(  # one row for each table of nodes
        "tree", F.when(F.col("level") == 0, 0).otherwise(F.ceil(F.col("level") / DEEP)).alias("table")).distinct().collect()}
    met = made.nodes[0].where("false").select(F.lit(0).alias("tree"), "*")
    for tree, tables in enumerate((made.nodes, made.top_nodes)):
        for at, table in enumerate(tables):
            if (tree, at) in reach:
                met = met.unionByName(table.select(F.lit(tree).alias("tree"), "*"))
    fetched = met.join(small(wanted, 80), ["tree", "g", "level", "idx"])
    fetched = saved(fetched.select(F.col("of").alias("g"), "block", "tree", "level", "idx", "hash"))
    added = [StructField(name, StringType()) for name in ("subroot", "root", "proof")]
    schema = StructType([*leaves.drop("block").schema, *added])
    return leaves.groupBy("g", "block").cogroup(fetched.groupBy("g", "block")).applyInArrow(_expand, schema)


def fold(leaf: str, proof: str, idx: int, n: int, top: int, top_n: int) -> str:
    """The root that a leaf and its proof give."""
    at = 0
    for place, count in ((idx, n), (top, top_n)):
        while count > 1:
            nth = place % FAN
            width = min(count - (place - nth), FAN) - 1
            end = at + 64 * width
            cut = at + 64 * nth
            leaf = sha256((proof[at:cut] + leaf + proof[cut:end]).encode()).hexdigest()
            place, count, at = place // FAN, _above(count), end
    return leaf


def folded(proven: DataFrame, leaf: str = "leaf", name: str = "folded_root") -> DataFrame:
    """``proven`` with the root recomputed from the column ``leaf`` and the proof alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = zip(*(batch.column(c).to_pylist() for c in (leaf, "proof", "idx", "n", "top", "top_n")), strict=True)
            roots = pa.array([fold(*row) for row in given], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, roots], [*batch.schema.names, name])

    return proven.mapInArrow(run, StructType([*proven.schema, StructField(name, StringType())]))
