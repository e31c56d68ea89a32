from collections import defaultdict

import corpus_pipeline
from tests.llm.brute import bag, weighted_jaccard, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF).cache()
        seen[name] = docs.collect()
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in seen[name])
    names = [n for n, _ in corpus_pipeline.STAGES]
    sizes = [len({r.doc_id for r in seen[n]}) for n in names]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 150
    # no two documents that stay are near duplicates
    bags = [bag(r.text) for r in seen["minhash_near_dedup"]]
    assert all(weighted_jaccard(a, b) < 0.8 for i, a in enumerate(bags) for b in bags[:i])
    # no line that stays comes twice
    lines = [frozenset(words(x)) for r in seen["line_dedup"] for x in r.text.split("\n") if words(x)]
    assert len(lines) == len(set(lines))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i:i + 10]) for i in range(len(w) - 9)}
    hit = lambda r: any(tuple(w[i:i + 10]) in windows for w in [words(r.text)]
                        for i in range(len(w) - 9))
    assert {r.doc_id for r in seen["minhash_near_dedup"] if not hit(r)} == {
        r.doc_id for r in seen["benchmark_decontamination"]}
    fill = defaultdict(int)
    for r in seen["best_fit_packing"]:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_near_dedup_of_repeated_rows(spark):
    rows = [(1, "a b c d e f g")] * 40 + [(None, "h i j k l m n")] * 40 + [(2, "x y z u v w t")]
    made = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, source string")
    got = corpus_pipeline.near_dedup(spark, made, SF)
    assert sorted(map(str, got.collect())) == sorted(str(r) for r in set(made.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_first" in plan


ODD_ROWS = [
    (None, "one two three four five six seven"), (None, None), (1, ""), (2, None), (3, "..."),
    (4, "the same words here again and more of them"), (4, "the same words here again and more of them"),
    (5, "the same words here again and more of them\nand a line of its own for this one"),
    (6, "word " * 30_000), (7, "a line\n\n\n"), (8, "1 2 3 4 5")]
CLASHING = ["score", "Lang_Pred", "_lines", "_removed", "_links", "_id", "_th", "_kept_0"]


def odd_documents(spark, rows):
    fields = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(
        [(i, t, "en" if k % 2 else None, "s", -1, *[f"{c}{k}" for c in CLASHING])
         for k, (i, t) in enumerate(rows)],
        f"doc_id bigint, text string, lang string, source string, n_chars int, {fields}")


def test_odd_rows_and_clashing_columns_in_every_stage(spark):
    docs = odd_documents(spark, ODD_ROWS)
    given = {r.score: r.asDict() for r in docs.collect()}
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and got.schema["n_chars"] == docs.schema["n_chars"]
        rows = left[name] = got.collect()
        for r in rows:
            for c in CLASHING:
                assert r[c] == given[r.score][c], (name, c)
            assert r.doc_id == given[r.score]["doc_id"]
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = {n: sorted(int(r.score[5:]) for r in rows) for n, rows in left.items()}
    words_of = {k for k, (_, t) in enumerate(ODD_ROWS) if words(t or "")}
    assert set(kept["language_id"]) <= words_of - {10}  # no letter in the last one
    # rows that repeat a document share what becomes of it
    assert kept["line_dedup"] == [0, 5, 6, 7, 8, 9, 10]
    assert kept["minhash_near_dedup"] in (
        [k for k in range(11) if k != 5], [k for k in range(11) if k != 6])
    assert kept["benchmark_decontamination"] == list(range(11))
    packed = corpus_pipeline.packing(spark, docs, SF).collect()
    assert sorted(r.doc_id or 0 for r in packed if r.piece == 0) == sorted(
        i or 0 for i, _ in ODD_ROWS)
    assert corpus_pipeline.packing(spark, docs.limit(0), SF).count() == 0
