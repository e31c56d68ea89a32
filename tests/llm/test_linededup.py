import random

import numpy as np
import pyarrow as pa

from stratafill.llm import linededup
from tests.llm.brute import words


def similar(a, b):
    common = len(a & b)
    return common / (len(a) + len(b) - common) >= 0.8 - 1e-9


def brute(rows):
    """Lines to remove per row, the rows in order."""
    lines = [(i, k, frozenset(words(x))) for i, (_, t) in enumerate(rows)
             for k, x in enumerate((t or "").split("\n")) if words(x)]
    gone = [set() for _ in rows]
    for p, (i, k, w) in enumerate(lines):
        if any(similar(w, o) for _, _, o in lines[:p]):
            gone[i].add(k)
    return gone


def test_near_copies_of_a_line(spark):
    """A large family of lines near to each other, some only to a few of them."""
    rng = random.Random(3)
    common = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(120):
        line = list(common)
        for _ in range(rng.randrange(6)):
            line[rng.randrange(40)] = rng.choice([f"v{rng.randrange(30)}", f"u{i}"])
        rows.append((i, "\n".join([" ".join(line), f"alone {i} of the rest", " ".join(line[:25])])))
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    gone = brute(rows)
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
            for i, t in rows}
    got = {r.doc_id: r.text for r in linededup.dedup_lines(made).collect()}
    assert got == want
    assert 0 < sum(map(len, gone)) < 240
    # the list of a frequent word in several parts
    cut = linededup.dedup_lines(made, list_rows=16)
    assert {r.doc_id: r.text for r in cut.collect()} == want


def test_odd_rows(spark):
    """Nulls, empty and repeated rows, columns with the names used inside, order of null ids."""
    rows = [(None, "one two three\n\nfour", 1, "x"), (3, "One, two three!\nfive", 2, "y"),
            (3, "One, two three!\nfive", 2, "y"), (4, None, None, None), (5, "", 5, ""),
            (6, "\n...\n", 6, "z"), (7, "five\nsix six", 7, None)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, line int, gone string")
    got = linededup.dedup_lines(made)
    assert got.columns == ["doc_id", "text", "line", "gone", "_lines", "_removed", "_links"]
    key = lambda r: str((r[0], r[2]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted([
        (None, "one two three\n\nfour", 1, "x", 2, 0, 0), (3, "five", 2, "y", 2, 1, 0),
        (3, "five", 2, "y", 2, 1, 0), (4, None, None, None, 0, 0, 0), (5, "", 5, "", 0, 0, 0),
        (6, "\n...\n", 6, "z", 0, 0, 0), (7, "six six", 7, None, 2, 1, 0)], key=key)
    assert linededup.dedup_lines(made.limit(0)).count() == 0
    long = " ".join(f"w{i}" for i in range(60_000))
    made = spark.createDataFrame(
        [(1, long), (2, "short\n" + long + " more"), (3, long[:350_000])], "doc_id int, text string")
    assert {r.doc_id: (r._lines, r._removed, r._links) for r in linededup.dedup_lines(made).collect()
            } == {1: (1, 0, 0), 2: (2, 1, 1), 3: (1, 1, 1)}


def test_all_links_of_a_family(spark):
    """Both sides of every link count, also where each line has many partners."""
    rng = random.Random(5)
    common = [f"w{k}" for k in range(40)]
    rows = [(None, None), (500, ""), (501, "...\n")]
    for i in range(150):
        line = list(common)
        for _ in range(rng.randrange(5)):
            line[rng.randrange(40)] = rng.choice([f"v{rng.randrange(30)}", f"u{i}"])
        rows.append((i, "\n".join([" ".join(line), "", f"alone {i} of the rest", " ".join(line[::-1])])))
    rows.append(rows[-1])
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = {i: [frozenset(words(x)) for x in (t or "").split("\n") if words(x)] for i, t in rows}
    every = {w for held in sets.values() for w in held}
    links = {w: sum(similar(w, o) for o in every if o != w) for w in every}
    assert sum(links.values()) > 20 * len(every)
    plain = {r.doc_id: r for r in linededup.dedup_lines(made).collect()}
    for list_rows in (linededup.LIST_ROWS, 16):
        got = linededup.dedup_lines(made, all_links=True, list_rows=list_rows).collect()
        assert len(got) == len(rows)
        named = {}
        for r in got:
            own = sets[r.doc_id]
            assert r._matches == sum(links[w] for w in own) and len(r._classes) == len(own)
            assert r._class_matches == [links[w] for w in own]
            assert all(named.setdefault(c, w) == w for c, w in zip(r._classes, own, strict=True))
            assert tuple(r)[:5] == tuple(plain[r.doc_id])
        assert len(named) == len(every)
    empty = linededup.dedup_lines(made.limit(0), all_links=True)
    assert empty.count() == 0


def test_the_query_gives_classes_and_links(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    got = entry.queries()["op3_linededup"](spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    of_class = {}
    for r in got:
        own = [frozenset(words(x)) for x in texts[r.doc_id].split("\n") if words(x)]
        assert len(r.class_ids) == r.n_lines == len(own)
        of_class.update(zip(own, r.class_ids, strict=True))
    assert len(set(of_class.values())) == len(of_class)
    by_word = {}
    for w in of_class:
        for x in w:
            by_word.setdefault(x, []).append(w)
    links = {w: sum(similar(w, o) for o in {o for x in w for o in by_word[x]} if o != w)
             for w in of_class}
    assert any(links.values())
    for r in got:
        own = [frozenset(words(x)) for x in texts[r.doc_id].split("\n") if words(x)]
        assert r.n_matches == sum(links[w] for w in own)
        assert r.class_matches == [links[w] for w in own]


def test_tallies_never_say_more_than_the_words_that_differ():
    """Their distance is a lower bound, also where a part holds over 16 words, and a near one."""
    rng = random.Random(7)
    far = []
    for size in (1, 5, 40, 150, 900):
        for _ in range(40):
            one = {f"a{rng.randrange(3 * size)}" for _ in range(size)}
            two = {w for w in one if rng.random() < 0.9} | {f"b{k}" for k in range(rng.randrange(9))}
            other = {f"c{rng.randrange(1 << 40)}" for k in range(len(one))}
            made = linededup.Lines(pa.array(["\n".join(" ".join(sorted(x)) for x in (one, two, other))]))
            low, high = linededup._tallies(made)
            apart = [int(sum(linededup._apart(x[:1], x[i:i + 1])[0] for x in (low, high)))
                     for i in range(len(made))]
            assert apart[0] == 0 and len(apart) == 3
            assert apart[1] <= len(one ^ two) and apart[2] <= len(one ^ other)
            if size == 150:
                far.append(apart[2])
    # Jaccard 0.8 leaves two sets of 100 words no more than 22 that differ
    assert min(far) > 22


def test_long_lines_that_share_few_words_are_no_candidates(spark, monkeypatch):
    """Lines without a match are not looked up again with all of their candidates."""
    rng = random.Random(11)
    known = [f"w{k}" for k in range(1000)]
    rows = [(i, " ".join(rng.sample(known, 200))) for i in range(100)]
    rows.append((100, rows[3][1] + " end"))
    staged, stage = {}, linededup.stage

    def watched(df, name, *more):
        made = stage(df, name, *more)
        staged[name] = made.count()
        return made
    monkeypatch.setattr(linededup, "stage", watched)
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert [r.doc_id for r in got.where("_removed > 0").collect()] == [100]
    assert staged["line_rest"] < 20  # of 98 that parity bits left


def test_lists_are_shuffled_as_packed_columns():
    """A row per bucket and hand-on, not per entry; each list is in one bucket, with all entries."""
    rng = np.random.default_rng(3)
    entries = np.zeros(20_000, linededup._ENTRY)
    entries["word"] = rng.integers(0, 500, len(entries))
    entries["place"], entries["parts"] = 1, 1
    entries["parts"][entries["word"] == 7] = 3
    n = 400
    batches = [pa.RecordBatch.from_pydict({
        "cid": pa.array(range(i * n, (i + 1) * n), pa.int64()), "n": pa.array([9] * n, pa.int32()),
        "low": pa.array([-i] * n, pa.int64()), "high": pa.array([i] * n, pa.int64()),
        "asks": pa.array([i % 2 == 0] * n),
        "prefixes": [x.tobytes() for x in np.split(part, n)]})
        for i, part in enumerate(np.split(entries, 5))]
    whole = [linededup._listed(b, None) for b in batches]
    assert sum(len(x["word"]) for x in whole) == sum(
        b.column("rows")[0].as_py() for b in linededup._count_listed(batches))
    packed = list(linededup._list_words(None, 10)(batches))
    assert sum(p.num_rows for p in packed) <= 10 * len(packed) and len(packed) == 1
    found = [linededup._unpacked([p.slice(i, 1)]) for p in packed for i in range(p.num_rows)]
    lists = [set(zip(x["word"].tolist(), x["part"].tolist(), strict=True)) for x in found]
    assert sum(map(len, lists)) == len(set().union(*lists))  # none in two buckets

    def rows(held):
        return sorted(r for x in held for r in zip(*(x[c].tolist() for c in x), strict=True))
    assert rows(found) == rows(whole)
