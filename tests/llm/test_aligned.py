"""Alignment against a plain version that encodes whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from stratafill.llm import aligned
from stratafill.llm.aligned import align_documents, byte_level_tokens, piece_tokens
from stratafill.llm.perfecthash import PerfectHash, buckets_for, place_bucket

SF = "/root/testdata/sf0.001"
A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    a_bytes, b_bytes = byte_level_tokens(a), piece_tokens(b)
    cut, docs = [], Counter()
    for text in texts:
        x = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        if text and not (b"".join(a_bytes[i] for i in x) == b"".join(b_bytes[i] for i in y)
                         == (" " + text).encode()):
            x, y = [], []
        ends = [np.cumsum([0, *(len(t[i]) for i in z)]).tolist() for t, z in
                ((a_bytes, x), (b_bytes, y))]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups = [(x[ends[0].index(p):ends[0].index(q)], y[ends[1].index(p):ends[1].index(q)])
                  for p, q in zip(both, both[1:], strict=False)]
        cut.append((x, y, groups))
        docs.update({(i, j) for g, h in groups for i in g for j in h})
    best = defaultdict(int)
    for (i, _), n in docs.items():
        best[i] = max(best[i], n)
    out = []
    for x, y, groups in cut:
        links = [(i, j) for g, h in groups for i in g for j in h]
        out.append((len(x), len(y), len(groups), len(links),
                    sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links),
                    ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)))
    return out


ODD = [None, "", " ", "\n", "a\n", "\nword", "a  b\tc \n d\r\ne", " lead", "trail ", "x▁y ok",
       "<|endoftext|> </s> <s>[INST]", "café naïve  nb 　wide", " line sep",
       "tab\u0085next it's we'll 12 345.6", "\U0001f600 emoji‍ \x00\x1f null", "a b\na b\na b",
       "A" * 3000, "word " * 2000 + "\n" * 50, "a b c d e", "a b c d e"]


def fields(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)


@pytest.mark.parametrize("slice_pairs", [4_000_000, 60])
def test_odd_rows(spark, slice_pairs):
    rows = [(None if i % 5 == 0 else i, t, i) for i, t in enumerate(ODD)]
    rows.append(rows[7])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_a int")
    got = align_documents(docs, A, B, slice_pairs=slice_pairs).collect()
    texts = [t for _, t, _ in rows]
    want = Counter((i, *x) for (i, _, _), x in zip(rows, plain(texts), strict=True))
    assert Counter((r._id, *fields(r)) for r in got) == want
    assert align_documents(docs.limit(0), A, B).count() == 0


def test_memory_that_is_dropped_changes_nothing(monkeypatch):
    own = aligned.Aligner(A, B)
    want = [x[6] for x in plain(ODD)]
    for limit in (1 << 30, 1):
        monkeypatch.setattr(aligned, "REMEMBERED_BYTES", limit)
        for k in range(0, len(ODD), 7):
            part = aligned.AlignedPiece(own, pa.array(ODD[k:k + 7], pa.string()))
            assert part.groups().to_pylist() == want[k:k + 7]
        assert aligned.AlignedPiece(own, pa.array(ODD)).groups().to_pylist() == want
    assert len(own.known) < 100


def test_query(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    want = {d["doc_id"]: x for d, x in zip(docs, plain([d["text"] for d in docs]), strict=True)}
    got = entry.queries()["op12_alignment"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        *numbers, groups = want[r.doc_id]
        assert list(r[1:7]) == numbers
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


def test_perfect_hash():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 40, 100_000))
    buckets = buckets_for(len(keys))
    rows = [r for b in range(buckets) for r in place_bucket(b, keys[keys % buckets == b])]
    names = ["bucket", "level", "places", "taken", "keys"]
    table = pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    numbering = PerfectHash(table, buckets)
    assert sorted(numbering.numbers(keys)) == list(range(len(keys)))
    others = np.setdiff1d(rng.integers(0, 1 << 40, 10_000), keys)
    assert (numbering.numbers(others) == -1).all()
    assert len(PerfectHash(table.slice(0, 0), 1).numbers(keys)) == len(keys)
