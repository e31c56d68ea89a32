"""Parts that need no session: packing plan, chat grammar, archives, vectors, gradients."""

import gzip
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratafill.llm import chat, knn, packing, tokens, toxicity, warc
from stratafill.llm.ftrl import Ftrl
from stratafill.llm.langid import fit_temperature, softmax
from stratafill.llm.words import words_of
from tests.llm.brute import words

# --- packing -------------------------------------------------------------------------------


def best_fit(lengths, capacity):
    """Sequences of best fit, one piece after another, longest first."""
    room = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= x]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - x)
        else:
            room.append(capacity - x)
    return len(room)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.data())
def test_plan_is_best_fit_and_whole(capacity, data):
    counts = data.draw(st.dictionaries(st.integers(1, capacity), st.integers(1, 40), max_size=12))
    steps = packing.plan(counts, capacity)
    ranks = {x: [] for x in counts}
    sequences = {}
    for length, low, high, first, at, each in steps:
        for rank in range(low, high):
            k, nth = divmod(rank - low, each)
            ranks[length].append(rank)
            sequences.setdefault(first + k, []).append((at + nth * length, length))
    assert all(sorted(ranks[x]) == list(range(n)) for x, n in counts.items())
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    lengths = [x for x, n in counts.items() for _ in range(n)]
    assert len(sequences) == best_fit(lengths, capacity)


def test_plan_does_not_follow_the_number_of_pieces():
    rng = random.Random(1)
    small = {x: rng.randrange(1, 50) for x in range(1, 2049)}
    large = {x: n * 10**9 for x, n in small.items()}
    assert len(packing.plan(large, 2048)) < 30_000


def test_unit_tokens_equal_the_tokenizer(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, plain = tokens.UnitTokens(path), Tokenizer.from_file(path)
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", 20_000)
    rng = random.Random(2)
    parts = ["word", "don't", "it's", "é", "日本", "12", "3.5", "_", "...", "\n", "\n\n", "\t", " ",
             "  ", " ", " ", "<|endoftext|>", "a\nb", "x\r\ny", "'", "ﬁ", "\x1c", "\x85"]
    texts = ["", " ", "a b", *["".join(rng.choice([*parts, " "]) for _ in range(rng.randrange(30)))
                              for _ in range(1500)],
             *[" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 20))) for _ in range(1500)]]
    for some in (texts, list(reversed(texts))):
        want = [x.ids for x in plain.encode_batch(some, add_special_tokens=False)]
        for k in range(0, len(some), 700):
            units, first = own(pa.array(some[k:k + 700]))
            edges = units.edges[first].tolist()
            assert [units.flat[i:j].tolist() for i, j in zip(edges, edges[1:], strict=False)] \
                == want[k:k + 700]


# --- chat ----------------------------------------------------------------------------------

_BITS = ["[ROLE]", "[TEXT]", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "/s>", "s>",
         "TEXT]", "ROLE]", "<\\/s>", "[\\\\TEXT]", "a", "\n", "é"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(*[st.lists(st.sampled_from(_BITS), max_size=7).map("".join)] * 2),
                max_size=4))
def test_conversations_read_back(turns):
    made = [chat.format_turn(role, text) for role, text in turns]
    assert chat.parse("".join(block for block, _, _ in made)) == turns
    for (_, text), (block, first, last) in zip(turns, made, strict=True):
        assert chat.unescape(block[first:last]) == text


def test_plain_turns_are_not_escaped_and_broken_text_is_refused():
    assert chat.format_turn("user", r"a \ [b] <c>")[0] == r"[ROLE]user[TEXT]a \ [b] <c></s>"
    with pytest.raises(ValueError):
        chat.parse("[ROLE]user[TEXT]open")


# --- archives ------------------------------------------------------------------------------


def record(i, kind="response", payload=b"body"):
    return {"record_id": f"<urn:page:{i}>", "record_type": kind, "target_uri": "http://x/\r\ny",
            "payload_bytes": len(payload), "payload_digest": "sha256:00", "refers_to": None,
            "payload": payload}


ROWS = [record(1), record(2, "revisit"), record(3, payload=b"x" * 300_000),
        record(4, payload=b"\r\n\r\nWARC/1.1\r\n" * 50), record(5, payload=b"")]


def read(data, wanted=lambda v: True, payload=True):
    return list(warc.records(io.BytesIO(data), wanted, payload))


@pytest.mark.parametrize("pack", [lambda x: x, warc.gzip_member, gzip.compress])
def test_records_read_back(pack):
    data = b"".join(pack(warc.record_bytes(r)) for r in ROWS)
    got = read(data)
    assert [r["record_id"] for r in got] == [r["record_id"] for r in ROWS]
    assert [r["payload"] for r in got] == [b"" if r["record_type"] == "revisit" else r["payload"]
                                           for r in ROWS]
    some = read(data, lambda v: v["record_id"].endswith("3>"))
    assert len(some) == 1 and some[0]["payload"] == ROWS[2]["payload"]
    assert all(r["payload"] is None for r in read(data, payload=False))
    if pack is not warc.gzip_member:
        return
    assert gzip.decompress(data) == b"".join(map(warc.record_bytes, ROWS))  # ordinary gzip too


def test_unwanted_payloads_are_not_decoded():
    members = [warc.gzip_member(warc.record_bytes(r)) for r in ROWS]
    broken = bytearray(members[2])
    broken[len(broken) // 2:-8] = bytes(len(broken) - 8 - len(broken) // 2)
    data = b"".join([*members[:2], bytes(broken), *members[3:]])
    assert len(read(data, payload=False)) == len(ROWS)
    with pytest.raises(zlib.error):
        read(data)


# --- vectors -------------------------------------------------------------------------------


def test_products_are_exact():
    a = np.array([[2**20, -3], [1, 2]])
    assert knn.products(a, a).tolist() == [[2**40 + 9, 2**20 - 6], [2**20 - 6, 5]]
    big = np.array([[2.0**40, 2.0**40], [1.0, -1.0]])
    assert knn.products(big, big).tolist() == [[2**63 - 1, 0], [0, 2]]


def test_whole_vectors_of_different_lengths():
    column = pa.array([[0.5, -0.001], [1.0], []], pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([column], names=["vector"])
    assert knn.whole_vectors(batch, 2).tolist() == [[128, -1], [256, 0], [0, 0]]


# --- learning ------------------------------------------------------------------------------


def test_ordinal_gradient_is_the_slope():
    rng = np.random.default_rng(4)
    for _ in range(50):
        cuts = np.sort(rng.normal(size=3))
        score, grade = rng.normal(), rng.integers(0, 4)

        def loss(s, c, grade=grade):
            above = np.concatenate([[1.0], 1 / (1 + np.exp(-(s - c))), [0.0]])
            return -np.log(above[grade] - above[grade + 1])

        by_score, by_cut = toxicity.cumulative_gradient(score, cuts, grade)
        h = 1e-6
        assert by_score == pytest.approx((loss(score + h, cuts) - loss(score - h, cuts)) / 2 / h, abs=1e-4)
        for k in range(3):
            step = np.eye(3)[k] * h
            want = (loss(score, cuts + step) - loss(score, cuts - step)) / 2 / h
            assert by_cut[k] == pytest.approx(want, abs=1e-4)


def test_ftrl_starts_at_given_weights_and_stays_sparse():
    w = np.array([0.5, -1.0, 0.0])
    ftrl = Ftrl(w, 0.1, 1.0, 0.01, 0.1)
    assert ftrl.weights(slice(None)) == pytest.approx(w)
    ftrl.step(np.array([2]), w[2:], np.array([0.005]))
    assert ftrl.weights(slice(None))[2] == 0.0


def test_temperature_repairs_overconfidence():
    rng = np.random.default_rng(3)
    z = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=p) for p in softmax(z)])
    assert fit_temperature(z * 5, labels) == pytest.approx(5, rel=0.15)
    assert fit_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


# --- words ---------------------------------------------------------------------------------


def test_words_of_odd_texts():
    texts = ["", "Ab c", None, "a", "b", "...", "é É 9z", "x" * 5000, " end", "one\x7ftwo\x00three"]
    found = words_of(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        a, b = found.bounds[i], found.bounds[i + 1]
        got = found.bytes_of(a, b).decode().split()
        assert got == words(text)
    same = words_of(pa.array(["x ab", "AB", "ab y"])).hashes
    assert same[1] == same[2] == same[3] and len(set(same.tolist())) == 3
