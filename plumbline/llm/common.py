"""What several operators share: written intermediate tables, checked broadcasts, connected components, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import checkpoint_folder, shuffles_removed

#: A side is broadcast only when its counted rows times the given width stay below this.
BROADCAST_BYTES = 32 << 20
#: Rounds in which the members of a list meet one leader, before those that are still apart meet each other.
LEADER_ROUNDS = 8
#: Elements of sets that meet at a time, as what is shuffled of them is a multiple of them; more are dealt into slices,
#: ``MOST_SLICES`` at most.
SLICE_ELEMENTS, MOST_SLICES = 2_000_000, 8
#: Longs of a sketch; each holds 16 coordinates of 4 bits.
SKETCH_LONGS = 16
#: Words whose hash a Python worker remembers; the table is emptied when it is full.
REMEMBERED_WORDS = 400_000
#: A-Z to lower case, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As LOWER, and every ASCII byte that is no letter or digit becomes a space.
WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in LOWER)


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage, survives lost executors, and takes less room than an RDD checkpoint. What the write has shuffled is
    removed when the table is there, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, width: int) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted, of ``width`` bytes fit ``BROADCAST_BYTES``; else as it is."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find: connected components of edges (a, b) as (node, root), root the smallest node.

    Large-star and small-star steps alternate until no edge changes; every step is grouping with map-side minima and
    equi-joins, so no component is gathered in one task. Nodes without an edge do not appear.
    """
    state = None
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        pairs = saved(pairs)
        now = pairs.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if now == state or now["n"] == 0:
            break
        state = now
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = (large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
                                             .alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def linked(posted: DataFrame, confirm: Callable[[DataFrame], DataFrame], sizes: DataFrame,
           elements: Callable[[DataFrame], DataFrame],
           sketches: Callable[[DataFrame], DataFrame] | None = None, agreed: int = 0) -> DataFrame:
    """Components (node, root) of the confirmed links between nodes that share a token of ``posted`` (token, node).

    ``confirm`` keeps the pairs (a, b) that are links: sets of n (``sizes``: node, n) elements with a Jaccard similarity of
    3 / 4 or more. No list is expanded into all its pairs. In a round every member of a list meets one leader of it, first
    the one with most postings, if their components still differ; rounds go on while they take away a quarter of the
    pairs left or more and pairs left outnumber the postings. Then members meet whose components still differ, so no
    link between components is lost: inside their lists if the pairs left are at most as many as the postings, else only
    pairs are made whose ``elements`` (of the nodes given: node, element, each once) allow a link, see ``_alike``.
    ``sketches`` may give for the nodes that are left the columns w0, w1 and so on, ``SKETCH_LONGS`` longs of 4-bit
    coordinates; of these, links agree on ``agreed`` or more.
    """
    near = "7 * least(n, n_a) >= 3 * (n + n_a) and root <> r_a"
    weights = posted.groupBy("node").agg(F.count("*").alias("w"))
    base = saved(posted.join(sizes, "node").join(weights, "node").select("token", "node", "n", "w"))
    total, rooted, links, tested = base.count(), base.withColumn("root", F.col("node")), None, None

    def still_open(rows: DataFrame) -> tuple[DataFrame, int]:
        """Rows of lists with several components, and how many pairs of members these keep apart."""
        lists = saved(rows.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(
            ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs")).where("pairs > 0"))
        return (rows.join(lists.select("token"), "token", "left_semi").select("token", "node", "n", "w", "root"),
                lists.agg(F.sum("pairs")).first()[0] or 0)

    lists, left = still_open(rooted)
    for turn in range(LEADER_ROUNDS):
        order = [F.lit(0) if turn else -F.col("w"), F.xxhash64("node", F.lit(turn)).alias("h")]
        leader = lists.groupBy("token").agg(F.min(F.struct(*order, "node", "n", "root")).alias("first"))
        leader = leader.select("token", F.col("first.node").alias("a"), F.col("first.n").alias("n_a"),
                               F.col("first.root").alias("r_a"))
        pairs = lists.join(leader, "token").where(near).select(
            F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        pairs = saved(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        fresh = saved(confirm(pairs))
        tested = pairs if tested is None else tested.unionAll(pairs)
        links = fresh if links is None else links.unionAll(fresh)
        roots = components(links).withColumnRenamed("node", "member")
        rooted = saved(base.join(roots, F.col("node") == F.col("member"), "left").select(
            "token", "node", "n", "w", F.coalesce("root", "node").alias("root")))
        before, (lists, left) = left, still_open(rooted)
        if left <= total or 4 * left > 3 * before:
            break
    if left <= total:
        across = _apart(lists).where(near).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        across = across.distinct().join(tested, ["a", "b"], "left_anti")
        return saved(components(links.unionAll(saved(confirm(saved(across))))))
    # a node has a bounded number of tokens
    nodes = saved(lists.groupBy("node", "n", "root").agg(F.collect_list("token").alias("t")))
    alike = saved(_alike(nodes.select("node", "n", "root"), elements(nodes.select("node"))))
    words = [f"w{i}" for i in range(SKETCH_LONGS)] if sketches is not None else []
    if words:
        some = alike.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        nodes = saved(nodes.join(sketches(some).select("node", *words), "node"))
    side, other = nodes.select("node", "t", *words), nodes.select("node", "t", *words).toDF("a", "t_a", *(f"{w}_a" for w in words))
    agree = f"{16 * len(words)} - ({' + '.join(map(_differing, words))}) >= {agreed}" if words else "true"
    met = alike.join(other, "a").join(side, (F.col("b") == F.col("node")) & F.expr(f"{agree} and arrays_overlap(t, t_a)"))
    across = met.select("a", "b").join(tested, ["a", "b"], "left_anti")
    return saved(components(links.unionAll(saved(confirm(saved(across))))))


def _apart(lists: DataFrame) -> DataFrame:
    """Pairs of members (node, n, root and a, n_a, r_a) of the same list (``lists``: token, node, n, root) whose roots differ.

    Members of a list's largest component do not meet each other, so what is joined stays below twice the pairs.
    """
    held = lists.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(
        F.max(F.struct("c", "root")).alias("most")).select("token", F.col("most.root").alias("main"))
    members = lists.join(held, "token").select("token", "node", "n", "root", (F.col("root") == F.col("main")).alias("main"))
    others = members.where("not main").select("token", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("r_a"))
    return others.join(members, "token").where("root <> r_a and (main or a < node)")


def _slices(total: int) -> int:
    """Parts in which so many elements are shuffled one after the other."""
    return max(1, min(MOST_SLICES, -(-total // SLICE_ELEMENTS)))


def _in_slices(rows: DataFrame, by: str, slices: int, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``made`` of the rows of each slice of ``by``, written one after the other."""
    whole = None
    for i in range(slices):
        part = rows if slices == 1 else rows.where(F.pmod(F.xxhash64(F.lit(slices), by), F.lit(slices)) == i)
        part = saved(made(part))
        whole = part if whole is None else whole.unionAll(part)
    return whole


def _alike(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, n, root) with different roots whose sets may have a similarity of 3 / 4.

    Sets of n and m elements, n <= m, that similar have c = 3 / 7 (n + m) elements or more in common. With the elements of
    every set in one order, rarest first, the first common one is then among the first n - c + 1 of the one and the first
    m - c + 1 of the other, and at its places as many elements are still to come in both. Sets meet by the elements in
    these prefixes, the larger one with a prefix for each class of sizes that the smaller one may have. What many sets
    share stands behind what tells them apart, so a group of sets that are somewhat alike does not meet pair by pair, and
    of the component that a list holds most of members do not meet each other.
    """
    slices = _slices(nodes.agg(F.sum("n")).first()[0] or 0)
    several = saved(elements.groupBy("element").agg(F.count("*").alias("c")).where("c > 1"))

    def prefixes(part: DataFrame) -> DataFrame:
        shared = part.join(several, "element").groupBy("node").agg(
            F.sort_array(F.collect_list(F.struct("c", "element"))).alias("s"))
        # elements that no other set has come first and meet nothing; ``alone`` of them
        sets = nodes.join(shared, "node").withColumn("alone", F.col("n") - F.size("s"))
        sets = sets.withColumn("s", F.expr("slice(s, 1, greatest(0, cast(n div 4 + 1 - alone as int)))")).where("size(s) > 0")
        return sets.select("node", "n", "root", F.posexplode("s").alias("i", "s"), "alone").select(
            "node", "n", "root", F.col("s.element").alias("element"), (F.col("alone") + F.col("i") + 1).alias("at"))

    rows = _in_slices(elements, "node", slices, prefixes)
    met = _in_slices(rows, "element", slices, _meeting)
    return met if slices == 1 else met.distinct()


def _meeting(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets with different roots that meet in ``rows`` (node, n, root, element, at), see ``_alike``."""
    size_class = "cast(floor(20 * ln({})) as int)".format
    lists = rows.groupBy("element", "root").agg(F.count("*").alias("c")).groupBy("element").agg(
        F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    rows = saved(rows.join(lists.select("element", F.col("most.root").alias("main")), "element"))
    # members of the main component are met in part 1 by others only; all members meet the others in part 0
    smaller = rows.where("at <= n div 7 + 1").select(
        "element", F.expr(size_class("n")).alias("size"), F.expr("explode(if(root = main, array(0), array(0, 1)))").alias("part"),
        F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("r_a"), F.col("at").alias("at_a"))
    larger = rows.select("*", F.expr(f"explode(sequence({size_class('ceil(0.75D * n)')}, {size_class('n')}))").alias("size"))
    least = "greatest(cast(floor(exp(size / 20.0D) * (1 - 1e-9D)) as bigint), 3 * n div 4)"
    larger = larger.where(f"at <= (4 * n - 3 * {least}) div 7 + 1").select(
        "element", "size", F.expr("if(root = main, 1, 0)").alias("part"), "node", "n", "root", "at")
    return smaller.join(larger, ["element", "size", "part"]).where(
        "root <> r_a and 4 * n_a >= 3 * n and (n_a < n or n_a = n and a < node) and "
        "7 * (1 + least(n_a - at_a, n - at)) >= 3 * (n_a + n)").select(
        F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def _differing(word: str) -> str:
    """SQL of the number of 4-bit coordinates in which a sketch's ``word`` differs from that of the other side."""
    x = f"({word} ^ {word}_a)"
    folded = f"({x} | shiftright({x}, 1) | shiftright({x}, 2) | shiftright({x}, 3))"
    return f"bit_count({folded} & 1229782938247303441L)"  # the lowest bit of each coordinate


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + n]
    return mixed(total)
