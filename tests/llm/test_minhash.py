from collections import Counter
from itertools import combinations

import numpy as np

from stratafill.llm.minhash import bag_minhash, near_duplicates
from stratafill.llm.words import mix
from tests.llm.brute import bag, groups_of, weighted_jaccard

SF = "/root/testdata/sf0.001/documents.parquet"


def test_components_are_equal_as_often_as_bags_are_similar():
    rng = np.random.default_rng(5)
    items = mix(np.arange(60, dtype=np.uint64) + np.uint64(99))
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    a[:20] = b[:20]
    texts = np.concatenate([np.zeros(60, int), np.ones(60, int)])
    weights = np.concatenate([a, b])
    some = weights > 0
    both = np.concatenate([items, items])
    got = bag_minhash(texts[some], both[some], weights[some], 2, 20000)
    assert np.isfinite(got).all()
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((got[0] == got[1]).mean() - want) < 0.015


def test_groups_match_brute_force(spark):
    docs = spark.read.parquet(SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base = max((t for _, t in rows if len(t) < 3000), key=len).split(" ")
    for k in range(40):  # a group whose members are near to the base, less so to each other
        own = list(base)
        own[(k * 7) % len(own)] = f"other{k}"
        if k % 3 == 0:
            own[(k * 11 + 3) % len(own)] = f"more{k}"
        rows.append((10_000 + k, " ".join(own)))
    rows += [(None, "a b c d e f g h"), (None, "a b c d e f g h"), (7, None), (8, ""), (9, "..."),
             (20_000, "one two"), (20_001, "One, two!"), (20_002, "one")]
    made = spark.createDataFrame(
        [(i, t, "x") for i, t in rows], "doc_id bigint, text string, cid string")
    got = near_duplicates(made).collect()
    bags = [(i, t, bag(t)) for i, t in dict.fromkeys(rows)]
    assert len(got) == len(bags)
    links = [(x, y) for x, y in combinations(range(len(bags)), 2)
             if weighted_jaccard(bags[x][2], bags[y][2]) >= 0.8]
    want = groups_of(len(bags), links)
    assert Counter(Counter(want).values()) == Counter(Counter(r.group_id for r in got).values())
    ids = {}
    for r in got:
        ids.setdefault(r.group_id, []).append(r._id)
    expected = {}
    for k, g in enumerate(want):
        expected.setdefault(g, []).append(bags[k][0])
    order = lambda x: sorted(x, key=str)
    assert sorted(map(str, map(order, ids.values()))) == sorted(map(str, map(order, expected.values())))
    assert sum(r.keep for r in got) == len(set(want))


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
