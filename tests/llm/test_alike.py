import numpy as np

from plumbline.llm.common import _alike


def _pairs(spark, sets, roots):
    nodes = spark.createDataFrame([(i, len(s), roots[i]) for i, s in enumerate(sets)], "node long, n long, root long")
    rows = spark.createDataFrame([(i, int(x)) for i, s in enumerate(sets) for x in s], "node long, element long")
    return [(r.a, r.b) for r in _alike(nodes, rows).collect()]


def _links(sets, roots):
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if roots[i] != roots[j]
            and 7 * len(sets[i] & sets[j]) >= 3 * (len(sets[i]) + len(sets[j]))}


def test_no_link_between_components_is_lost(spark):
    rng = np.random.default_rng(1)
    sets = []
    for size in (1, 2, 3, 4, 5, 7, 8, 20, 61, 150):
        for _ in range(3):
            base = rng.integers(0, 5 * size, size)
            for cut in (0.0, 0.05, 0.1, 0.14, 0.2, 0.25):  # sizes differ by up to a quarter, and some elements are new
                kept = base[:max(1, round(size * (1 - cut)))]
                sets += [set(kept), set(kept) | set(rng.integers(0, 9 * size, round(size * cut / 2)))]
    roots = [int(x) for x in rng.integers(0, len(sets) // 3, len(sets))]
    found = _pairs(spark, sets, roots)
    assert len(found) == len(set(found)) and all(roots[a] != roots[b] for a, b in found)
    wanted = _links(sets, roots)
    assert len(wanted) > 100 and wanted <= set(found)


def test_sets_that_are_only_somewhat_alike_do_not_meet_pair_by_pair(spark):
    rng = np.random.default_rng(2)
    near = [set(range(140)) - set(rng.choice(140, 5, False)) | {1000 * i + k for k in range(1000, 1005)} for i in range(60)]
    far = [set(range(140)) - set(rng.choice(140, 25, False)) | {1000 * i + k for k in range(1000, 1025)} for i in range(60, 120)]
    sets, roots = near + far, [0] * 60 + list(range(60, 120))  # some 0.65 of a far set is in any other
    assert _links(sets, roots) == set()
    assert len(_pairs(spark, sets, roots)) <= 60  # of 5,370 pairs with different roots
