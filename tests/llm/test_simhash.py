"""SimHash groups against a plain version that compares all pairs."""

import random
import re

import numpy as np
import pyarrow.parquet as pq
import xxhash

import __spark_entry__ as entry
from stratafill.llm import simhash
from stratafill.llm.bktree import Forest, star_links
from stratafill.llm.simhash import near_duplicates, near_prints, shard_masks
from tests.llm.brute import LOWER, groups_of

SF = "/root/testdata/sf0.001"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = ([" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
                or ([" ".join(words)] if words else []))
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=2):
    links = [(i, j) for i in range(len(prints)) for j in range(i)
             if (prints[i] ^ prints[j]).bit_count() <= radius]
    return groups_of(len(prints), links)


def near_family(rng, center, n, flips):
    out = {center}
    while len(out) < n:
        x = rng.choice(sorted(out))
        for _ in range(rng.randint(1, flips)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_trees_find_all_near_prints():
    rng = random.Random(2)
    prints = np.array(sorted(set(near_family(rng, 5, 600, 4))
                             | {rng.getrandbits(64) for _ in range(600)}), np.uint64)
    tree = np.array([rng.randrange(3) for _ in prints])
    _, tree = np.unique(tree, return_inverse=True)
    forest = Forest(prints, tree)
    for radius in (0, 2, 5):
        query, node = forest.near(prints, forest.roots[tree], radius)
        want = {(i, j) for i in range(len(prints)) for j in range(len(prints)) if tree[i] == tree[j]
                and (int(prints[i]) ^ int(prints[j])).bit_count() <= radius}
        got = list(zip(query.tolist(), node.tolist(), strict=True))
        assert len(got) == len(set(got)) and set(got) == want
    assert len(Forest(prints[:0], tree[:0]).near(prints[:0], tree[:0], 2)[0]) == 0


def test_a_search_leaves_out_most_of_a_tree():
    rng = np.random.default_rng(4)
    prints = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    forest = Forest(prints, np.zeros(len(prints), int))
    asked = []
    whole = forest.prints
    forest.prints = type("Counted", (), {
        "__getitem__": lambda _, at: asked.append(len(at)) or whole[at]})()
    forest.near(prints[:200], np.repeat(forest.roots, 200), 2)
    assert sum(asked) < 0.1 * 200 * len(prints)


def test_star_links_keep_components():
    rng = random.Random(9)
    a, b = (np.array([rng.randrange(400) for _ in range(300)]) for _ in "ab")
    x, y = star_links(a, b)
    first = groups_of(400, list(zip(a.tolist(), b.tolist(), strict=True)))
    assert first == groups_of(400, list(zip(x.tolist(), y.tolist(), strict=True)))
    assert len(set(x.tolist())) == len(x)


def test_masks_let_near_prints_meet():
    rng = random.Random(3)
    for n in (10, 10**8, 10**11, 10**15):
        masks = [m % (1 << 64) for m in shard_masks(n, 2)]
        bits = min(m.bit_count() for m in masks)
        assert n >> bits <= simhash.SHARD_MEAN
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            assert any(x & m == y & m for m in masks)


def groups_found(links, prints):
    at = {signed(p): i for i, p in enumerate(prints)}
    return groups_of(len(prints), [(at[r.a], at[r.b]) for r in links.collect()])


def test_small_and_large_shards_give_the_same_groups(spark, monkeypatch):
    rng = random.Random(8)
    prints = sorted(set(near_family(rng, 77, 500, 3)) | set(near_family(rng, 1 << 63, 200, 2))
                    | {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1})
    rows = spark.createDataFrame([(signed(p),) for p in prints], "print bigint")
    want = plain_groups(prints)
    assert groups_found(near_prints(rows), prints) == want
    monkeypatch.setattr(simhash, "TREE_PRINTS", 16)
    monkeypatch.setattr(simhash, "ROUND_PRINTS", 300)
    assert groups_found(near_prints(rows), prints) == want


def test_odd_rows(spark):
    rows = [(5, None, "x"), (4, "", "x"), (None, " \t\n", "x"), (7, "One two", "x"),
            (6, "one\vTWO", "x"), (None, "alone é", "x"), (None, "alone É", "x"),
            (9, "word " * 20_000, "x"), (8, "WORD word word", "x"), (8, "WORD word word", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, print string")
    got = sorted((r._id is None, r._id, r.print, r.component_id) for r in
                 near_duplicates(docs).collect() if r._id is not None)
    a, b = signed(plain_print("one two")), signed(plain_print("word word word"))
    assert got == [(False, 4, 0, 4), (False, 5, 0, 4), (False, 6, a, 6), (False, 7, a, 6),
                   (False, 8, b, 8), (False, 8, b, 8), (False, 9, b, 8)]
    nulls = sorted((r.print, r.component_id is None) for r in near_duplicates(docs).collect()
                   if r._id is None)
    assert nulls == sorted([(0, False), (signed(plain_print("alone é")), True),
                            (signed(plain_print("alone É")), True)])
    assert near_duplicates(docs.limit(0)).count() == 0


def test_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    prints = [plain_print(d["text"]) for d in docs]
    groups = plain_groups(prints)
    least = {}
    for d, g in zip(docs, groups, strict=True):
        least[g] = min(least.get(g, d["doc_id"]), d["doc_id"])
    want = {d["doc_id"]: (f"{p:016x}", least[g])
            for d, p, g in zip(docs, prints, groups, strict=True)}
    got = entry.queries()["op13_simhash"](spark, SF).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
