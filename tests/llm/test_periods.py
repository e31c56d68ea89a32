"""Periodic runs against a plain search of every period."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq

import __spark_entry__ as entry
from stratafill.llm.periods import periodic_runs, runs_of

SF = "/root/testdata/sf0.001"


def plain_runs(words, least):
    """(start, period, end) of every run, by start and period."""
    smallest, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                smallest.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, q, e) for (s, e), q in smallest.items())


def assert_same(texts, least):
    bounds = np.cumsum([0, *map(len, texts)])
    found = runs_of(np.array([w for t in texts for w in t], np.int64), bounds, least)
    got = [[] for _ in texts]
    for text, start, end, period in found.tolist():
        got[text].append((start - bounds[text], period, end - bounds[text]))
    assert got == [plain_runs(t, least) for t in texts]


def test_all_short_texts_of_two_words():
    for n in (1, 2, 7, 14):
        assert_same(list(itertools.product((0, 1), repeat=n)), 1)


def test_touching_and_nested_repeats():
    rng = random.Random(7)
    texts = [(r * 20)[:20 + a] + (r * 20)[:20 + b] + (r * 9)[1:9]
             for a in range(6) for b in range(6) for r in ([0, 1], [0], [0, 1, 1])]
    for _ in range(600):
        text = []
        while len(text) < 90:
            p = rng.randint(1, 25)
            root = [rng.randint(0, 2) for _ in range(p)]
            text += (root * 6)[:rng.randint(p, 4 * p)]
            text[rng.randrange(len(text))] = rng.randint(0, 3)
        texts.append(text)
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
    for least in (1, 12):
        assert_same([*texts, b, [0] * 200, [], [5]], least)


def test_odd_rows(spark):
    long = "x " * 30_000 + "end " + "a b c " * 5000
    rows = [(1, None, "p"), (2, "", "p"), (None, " \t\n\x0b ", "p"), (None, "a " * 12, "p"),
            (3, "a\tb\na  b a\x0cb a b a b a b", "p"), (3, "a\tb\na  b a\x0cb a b a b a b", "p"),
            (4, long, "p"), (5, "a\u00a0a " * 3, "p")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    got = sorted((r._id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed)
                 for r in periodic_runs(docs).collect())
    pair = (3, 12, [(0, 12, 2)], "a b")
    assert got == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (0, 0, [], ""), (0, 12, [(0, 12, 1)], "a"), pair, pair,
        (4, 45_001, [(0, 30_000, 1), (30_001, 15_000, 3)], "x end a b c"),
        (5, 3, [], "a\u00a0a a\u00a0a a\u00a0a")])
    assert periodic_runs(docs.limit(0)).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark):
    got = {r.doc_id: r for r in entry.queries()["op11_periods"](spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert len(got) == len(docs)
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        n, h = len(words), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 2500:
            continue  # the plain search takes the square of the length
        runs = plain_runs(words, 12)
        dropped = {i for s, q, e in runs for i in range(s + q, e)}
        best = min(((s - e, s, q) for s, q, e in runs), default=None)
        r = got[d["doc_id"]]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == sha("".join(f"{s},{e - s},{q}\n" for s, q, e in runs))
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in dropped))
        want = best and (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        assert (r.start, r.length, r.period, r.exponent_milli) == (want or (None,) * 4)
