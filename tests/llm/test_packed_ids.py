"""Packed sequences carry the token ids of their documents."""

from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stratafill.llm import packing, queries

SF = "/root/testdata/sf0.001"


def test_the_last_stage_gives_the_ids(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    texts = {d["doc_id"]: d["text"] for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = corpus_pipeline.packing(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length
        pieces[r.doc_id].append((r.piece, r.start, ids))
        sequences[r.sequence_id].append((r.offset, ids))
    assert set(pieces) == set(texts)
    for doc, parts in pieces.items():
        ids = np.concatenate([x for _, _, x in sorted(parts, key=lambda p: p[0])]).tolist()
        assert ids == [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
    for parts in sequences.values():
        parts.sort(key=lambda p: p[0])
        assert [o for o, _ in parts] == np.cumsum([0, *[len(x) for _, x in parts]])[:-1].tolist()
        assert sum(len(x) for _, x in parts) <= 2048


def test_the_digest_is_of_written_ids(spark, monkeypatch):
    asked = []

    def seen(*args, **kwargs):
        asked.append(kwargs.get("with_ids", True))
        return pack(*args, **kwargs).withColumn("ids_crc32", F.lit(-1))

    pack = queries.pack_documents
    monkeypatch.setattr(queries, "pack_documents", seen)
    got = queries.op2_packing(spark, SF)
    assert asked == [True] and got.where("ids_crc32 is null or ids_crc32 < 0").isEmpty()


def test_ids_are_widened_without_text_expressions(spark):
    """Turning them into hex and back took more time than all other steps after the tokenizer."""
    ids = [np.array(x, "<u2") for x in ([], [0], [1, 2, 65535], [50256] * 2048)]
    rows = spark.createDataFrame(
        [(i, x.tobytes(), -i) for i, x in enumerate(ids)], "n int, ids binary, sequence_id bigint")
    wide = packing.widened(rows.repartition(2))
    assert "regexp" not in wide._jdf.queryExecution().executedPlan().toString()
    got = {r.n: (np.frombuffer(r.ids, "<u4").tolist(), r.sequence_id) for r in wide.collect()}
    assert got == {i: (x.tolist(), -i) for i, x in enumerate(ids)}
