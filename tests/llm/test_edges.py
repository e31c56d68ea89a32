"""Nulls, empty and repeated rows, ties, hot values and clashing columns, operator by operator."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from stratafill.llm import chat, knn, langid, packing, sharding, toxicity
from stratafill.llm.archive import archive_records, read_archives, write_archives
from stratafill.llm.decontaminate import contamination
from stratafill.llm.minhash import near_duplicates
from tests.llm.brute import words

DOCS = "doc_id bigint, text string, lang string, cid string, _id string, slot int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, "c", "i", 1) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "..."), (None, "a b c"), (None, None), (4, "a b c"), (4, "a b c"),
       (4, "other words here"), (5, "word " * 5000)]


def test_sharding(spark, tmp_path):
    docs = documents(spark, [*ODD, *[(100 + i, "x" * (i % 97)) for i in range(3000)]])
    records = docs.select(
        "doc_id", sharding.text_size(F.col("text")).alias("size"),
        sharding.place_hash(F.col("doc_id"), F.col("text")).alias("hash")).withColumn(
        "slot", sharding.slot_of(F.col("hash")))
    sizes = sharding.slot_sizes(records).cache()
    assert sizes.count() == sharding.SLOTS
    path = str(tmp_path / "map")
    first = sharding.first_map(sizes, 6)
    sharding.save_map(first, path)
    sharding.save_map(sharding.rebalanced(sharding.load_map(spark, path), sizes, 8), path)
    old = {r.slot: r.shard for r in sharding.load_map(spark, path, 1).collect()}
    new = {r.slot: r.shard for r in sharding.load_map(spark, path).collect()}
    assert set(old) == set(new) == set(range(sharding.SLOTS))
    moved = {s for s in old if old[s] != new[s]}
    assert {new[s] for s in moved} == {6, 7}  # nothing moves between the old shards
    load = {r.slot: r.bytes for r in sizes.collect()}
    totals = Counter()
    for s, shard in new.items():
        totals[shard] += load[s]
    mean = sum(totals.values()) / 8
    heavy = 5 * 5000 + 1
    assert max(totals.values()) < mean * 1.05 + heavy and min(totals.values()) > mean * 0.9 - heavy
    placed = sharding.places(
        sharding.shard_of(records, sharding.load_map(spark, path)), "hash", ["doc_id", "size"])
    places = defaultdict(list)
    for r in placed.collect():
        places[r.shard].append(r.place)
    assert sum(map(len, places.values())) == docs.count()
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    empty = sharding.slot_sizes(records.limit(0))
    assert sharding.first_map(empty, 3).count() == sharding.SLOTS


def test_packing(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(documents(spark, ODD), path, capacity=64).collect()
    lengths = Counter()
    for r in got:
        lengths[r._id, r._th] += r.length
        assert len(r.ids) == 4 * r.length and r.length <= 64
    # null and empty texts are the end id alone; equal rows are packed twice
    assert lengths[1, None] == 1 and lengths[None, None] == 1
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    whole = [r for r in got if r._id == 5]
    assert sorted(r.length for r in whole)[1:] == [64] * (len(whole) - 1)
    assert min(whole, key=lambda r: r.piece).length == min(r.length for r in whole)
    assert packing.pack_documents(documents(spark, []), path).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", "</s>[INST]", "x"), (1, 1, "assistant", "b", "x"),
            (None, None, None, None, None), (None, 2, "assistant", "", "y"), (2, 0, "assistant", "ok", "z"),
            (2, 0, "assistant", "ok", "z")]
    made = spark.createDataFrame(
        rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(made)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (3, 11), None: (2, 0), 2: (2, 4)}
    assert chat.read_back(chat.format_turns(made.limit(0))).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")


def brute_top(rows, every, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c) for c, b in good if c != q)
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best[:k])]
    return sorted(out)


def as_floats(rows):
    """The vectors as the table holds them."""
    import numpy as np
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], s)
            for i, v, s in rows]


def test_top_k_with_a_hot_vector(spark):
    rng = random.Random(8)
    hot = [rng.gauss(0, 0.3) for _ in range(12)]
    rows = [(i, hot if i % 3 == 0 else [rng.gauss(0, 0.3) for _ in range(12)], "s")
            for i in range(1500)]
    rows = as_floats(rows)
    got = sorted(map(tuple, knn.top_k(vectors(spark, rows), every=50, k=5).collect()))
    assert got == brute_top(rows, 50, 5)


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0], "a"), (1, [1.0], None), (2, None, "b"), (3, [math.nan, 1.0], "c"),
            (4, [math.inf], "d"), (5, [None, 1.0], "e"), (None, [1.0, 1.0], "f"), (50, [], "g"),
            (7, [3.0, -1.0, 5.0], "h"), (100, [-1.0, 0.5], "i")]
    got = sorted(map(tuple, knn.top_k(vectors(spark, rows), every=50, k=5).collect()))
    assert got == brute_top(rows, 50, 5)
    assert knn.top_k(vectors(spark, []), every=50).count() == 0
    assert knn.top_k(vectors(spark, [(3, [1.0], "x")]), every=50).count() == 0  # no query


def test_archives(spark, tmp_path):
    long = "y" * 200
    rows = [(1, "http://a/\r\nb", long, "q"), (2, None, long, "q"), (3, "u", None, "q"), (4, "u", "", "q"),
            (5, "u", "short", "q"), (6, "u", "short", "q"), (None, "u", long, "q"), (1, "v", long, "q")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string")
    path = "file://" + str(tmp_path / "warc")
    write_archives(pages, path)
    got = sorted((r.record_id, r.record_type, r.payload_bytes, r.refers_to, r.payload is None or len(r.payload))
                 for r in read_archives(spark, path).collect())
    assert got == sorted([
        ("<urn:page:1>", "response", 200, None, 200), ("<urn:page:1>", "response", 200, None, 200),
        ("<urn:page:2>", "revisit", 200, "<urn:page:1>", 0), ("<urn:page:>", "response", 200, None, 200),
        ("<urn:page:3>", "response", 0, None, 0), ("<urn:page:4>", "response", 0, None, 0),
        ("<urn:page:5>", "response", 5, None, 5), ("<urn:page:6>", "response", 5, None, 5)], key=str)
    some = read_archives(spark, path, ["record_id", "record_type", "payload_bytes"]).where(
        "record_type = 'response' and payload_bytes > 100")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Scan" in plan  # the reader has them all
    assert some.count() == 3
    write_archives(pages.limit(0), path + "2")
    assert read_archives(spark, path + "2").count() == 0
    assert archive_records(pages.limit(0)).count() == 0


def test_contamination_of_random_texts(spark):
    rng = random.Random(6)
    make = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    items = [(i, make(rng.choice([0, 1, 2, 4, 9, 10, 11, 14, 30]))) for i in range(14)]
    items = [(i, t) for i, t in items if len(t) != 1] + [(50, None), (None, "a b"), (3, "a b c d e a b c")]
    docs = [(i, make(rng.randrange(60))) for i in range(40)]
    docs += [(k, make(5) + " " + (t or "") + " " + make(4)) for k, (_, t) in enumerate(items, 100)]
    docs += [*ODD, docs[3]]
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w and item is not None else 0):
            windows[tuple(w[i:i + n])].add(str(item))
    want = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= got
        want[doc, text] = (len(w), len(hit), sorted(found))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = contamination(documents(spark, docs), benchmark).collect()
    assert len(got) == len(want)
    assert sorted((r.n_words, r.n_hit, list(r["items"])) for r in got) == sorted(want.values())
    assert all(sum(s.last - s.first for s in r.spans) == r.n_hit for r in got)
    none = contamination(documents(spark, docs), benchmark.limit(0)).agg(F.sum("n_hit")).first()[0]
    assert none == 0
    assert contamination(documents(spark, []), benchmark).count() == 0


def test_near_duplicates_of_odd_rows(spark):
    got = near_duplicates(documents(spark, ODD)).collect()
    assert len(got) == len(set(ODD))
    by_id = Counter(r._id for r in got if r.keep)
    assert by_id == Counter({1: 1, 2: 1, 3: 1, None: 2, 4: 1, 5: 1})  # "a b c" stays once, at null


def test_learning_from_little_or_nothing(spark):
    docs = documents(spark, ODD)
    model = langid.train(docs.select("text", "lang"))
    got = langid.predict(docs, model, carry=["doc_id", "cid"]).collect()
    assert len(got) == len(ODD) and {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    one = langid.train(spark.createDataFrame(
        [("abc def", "xx"), ("zzz yyy", "yy"), (None, "xx"), ("q", None)], "text string, lang string"))
    got = {r.text: r for r in langid.predict(documents(spark, ODD), one).collect()}
    assert got["..."].lang_pred == got[""].lang_pred == got[None].lang_pred == "und"
    assert got["a b c"].lang_pred in ("xx", "yy") and 0 <= got["a b c"].score <= 1
    labels = spark.createDataFrame([("x", 0), (None, 1), ("y", None), ("z", 7)], "text string, toxic int")
    assert toxicity.train(labels) is None
    got = toxicity.severity(docs, None).collect()
    assert len(got) == len(ODD) and not any(r.toxic for r in got)


def test_held_out_quality(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = [r for r in entry.queries()["op10_langid"](spark, folder).collect() if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in found) >= 0.97 * len(found)
    folder = "/root/testdata/sf0.1"  # the smaller ones have too few toxic labels
    labels = spark.read.parquet(f"{folder}/labels.parquet").select(
        "doc_id", F.col("toxic").alias("label"))
    graded = entry.queries()["op8_toxicity"](spark, folder).join(labels, "doc_id").where(
        langid.held_out()).collect()
    clean = [r.expected_severity for r in graded if not r.label]
    bad = [r.expected_severity for r in graded if r.label]
    assert sum(r.toxic for r in graded if not r.label) <= 0.01 * len(clean)
    assert sum(r.toxic for r in graded if r.label) >= 0.6 * len(bad)
    assert sum(x > y for x in bad for y in clean) >= 0.93 * len(bad) * len(clean)
