"""Language identification: sparse multinomial logistic regression on character n-grams.

Letters are lower-cased, everything else is one blank. Runs of one to three characters are hashed
into a fixed number of features, weighted by log term frequency and inverse document frequency
and scaled to unit length. Follow-the-regularised-leader (FTRL-proximal) with an elastic net
learns the weights: the L1 part leaves most at exactly zero. A temperature, fitted on rows that
took no part in learning, turns scores into calibrated probabilities.

Document frequencies cover every learnable row. The classifier learns from a bounded sample, in
a fixed number of blocks whose weights are averaged after each round (parameter mixing), so the
rounds run as Spark tasks and only weights of a fixed size come to the driver.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafill.llm.common import share_drawn
from stratafill.llm.ftrl import Ftrl
from stratafill.llm.words import SMALL_PIECE, buffers, per_piece
from stratafill.sources.staging import release, stage

FEATURES = 1 << 16
SIZES = (1, 2, 3)
SAMPLE_PER_LANGUAGE = 3000  # rows a language is learned from, at most (about)
MOST_LANGUAGES = 128  # of 65,536 weights each
BLOCKS = 6
ROUNDS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Of each code point, its lower case if it is a letter, else a blank (0)."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of the texts, and where each text begins and the last ends."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.zeros(len(data) + 1, np.int64)  # characters before each byte
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    return _folded()[points], begins[offsets]


def features(piece: pa.Array):
    """Per text: its hashed n-grams with their counts, and whether it has a letter."""
    points, bounds = code_points(*buffers(piece))
    letters = points != 0
    hashed = []
    value = np.zeros(len(points), np.uint32)
    for k in range(max(SIZES)):
        n = len(points) - k
        if n <= 0:
            break
        value = (value[:n] + points[k:]) * np.uint32(0x9E3779B1)
        value ^= value >> np.uint32(15)
        if k + 1 in SIZES:
            some = letters[:n].copy()
            for j in range(1, k + 1):
                some |= letters[j:n + j]
            slot = ((value * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 16)).astype(np.int64)
            hashed.append((np.where(some, slot, -1), k))
    for i in range(len(bounds) - 1):
        first, last = bounds[i], bounds[i + 1]
        parts = [slot[first:max(first, last - k)] for slot, k in hashed]
        counts = np.bincount(np.concatenate(parts) + 1 if parts else bounds[:0],
                             minlength=FEATURES + 1)
        held = np.flatnonzero(counts[1:])
        yield held, counts[1:][held], bool(letters[first:last].any())


@dataclass
class Model:
    """``weights`` (features, languages) and ``bias`` apply to unit tf-idf vectors."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, held: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[held]
        norm = np.sqrt((x * x).sum())
        return x / norm if norm > 0 else x

    def scores(self, held: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(held, counts) @ self.weights[held] + self.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _document_frequency(batches):
    """Texts per feature in the partition, and at feature -1 the number of texts."""
    seen, n = np.zeros(FEATURES, np.int64), 0
    for batch in per_piece(lambda piece: piece, most=SMALL_PIECE)(batches):
        for held, _, _ in features(batch.column("text")):
            seen[held] += 1
            n += 1
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(some, -1)), pa.array(np.append(seen[some], n))],
        names=["feature", "n"])


def _learn_block(model):
    """Learn from a block's rows; give the weights that are not zero."""
    def run(table: pa.Table) -> pa.Table:
        start: Model = model.value
        labels = {x: i for i, x in enumerate(start.languages)}
        ftrl = Ftrl(np.vstack([start.weights, start.bias]), ALPHA, BETA, L1, L2)
        table = table.sort_by([("order", "ascending"), ("text", "ascending")])
        langs = table.column("lang").to_pylist()
        weights = table.column("weight").to_pylist()
        done = 0
        for batch in table.select(["text"]).combine_chunks().to_batches():
            for piece in per_piece(lambda p: p, most=SMALL_PIECE)([batch]):
                for held, counts, _ in features(piece.column("text")):
                    x = np.append(start.vector(held, counts), 1.0)
                    held = np.append(held, FEATURES)
                    w = ftrl.weights(held)
                    error = softmax(x @ w)
                    error[labels[langs[done]]] -= 1
                    ftrl.step(held, w, np.outer(x, weights[done] * error))
                    done += 1
        w = ftrl.weights(slice(None))
        feature, language = np.nonzero(w)
        return pa.table({"feature": pa.array(feature, pa.int32()),
                         "language": pa.array(language, pa.int32()),
                         "w": pa.array(w[feature, language])})
    return run


def _raw_scores(model):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        own: Model = model.value
        labels = {x: i for i, x in enumerate(own.languages)}
        z = [own.scores(held, counts).tolist() for held, counts, _ in
             features(piece.column("text"))]
        return pa.RecordBatch.from_arrays(
            [pa.array(z, pa.list_(pa.float64())),
             pa.array([labels[x] for x in piece.column("lang").to_pylist()], pa.int32()),
             piece.column("weight")],
            names=["z", "label", "weight"])
    return per_piece(run, most=SMALL_PIECE)


def fit_temperature(z: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The temperature with the least log loss, by golden section over its logarithm."""
    if not len(z):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(z / np.exp(t))[np.arange(len(labels)), labels]
        return -np.average(np.log(np.maximum(p, 1e-300)), weights=weights)

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(rows: DataFrame) -> Model:
    """Learn from ``rows`` (text, lang): every row for document frequencies, a sample for weights.

    The sample is the SAMPLE_PER_LANGUAGE rows of a language with the least hash of their text
    (about; it is drawn by a cut of the hash, not by sorting). A tenth of it is left out of
    learning and sets the temperature. Each row weighs what it stands for, the rows of its language
    by those drawn, so languages are as frequent as among all distinct rows. Rows with a null text
    or language are ignored. Of more than MOST_LANGUAGES languages, those with the most distinct
    rows are learned (ties: the smaller name), which bounds the model.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).dropna()
    order = F.xxhash64("text", "lang")
    # equal rows are learned from once
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count_distinct(order).alias("n"))
             .orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    languages = sorted(sizes)
    found = (rows.select("text").mapInArrow(_document_frequency, "feature bigint, n bigint")
             .groupBy("feature").agg(F.sum("n").alias("n")).toArrow()).to_pydict()
    df = np.zeros(FEATURES + 1, np.int64)
    df[np.array(found["feature"], np.int64)] = found["n"]  # the number of texts comes last
    model = Model(languages, np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0,
                  np.zeros((FEATURES, len(languages))), np.zeros(len(languages)))
    if not languages:
        return model

    drawn = F.lit(False)
    for lang, n in sizes.items():
        drawn |= (F.col("lang") == lang) & share_drawn(order, SAMPLE_PER_LANGUAGE, n)
    sample = stage(rows.where(drawn).distinct().withColumns({
        "order": order, "part": F.pmod(F.shiftright(order, 24), F.lit(10 * BLOCKS)).cast("int")}),
        "language_sample")
    # weighed by what was drawn, 1 on average
    found = {r.lang: r.n for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    mean = sum(sizes[x] for x in found) / max(1, sum(found.values()))
    weight = F.lit(0.0)
    for lang, n in found.items():
        weight = F.when(F.col("lang") == lang, F.lit(sizes[lang] / n / mean)).otherwise(weight)
    drawn_rows, sample = sample, sample.withColumn("weight", weight)
    learned = sample.where(F.col("part") >= BLOCKS).withColumn("block", F.col("part") % BLOCKS)
    for _ in range(ROUNDS):
        now = spark.sparkContext.broadcast(model)
        parts = learned.groupBy("block").applyInArrow(
            _learn_block(now), "feature int, language int, w double")
        total = parts.groupBy("feature", "language").agg(F.sum("w").alias("w")).toArrow().to_pydict()
        w = np.zeros((FEATURES + 1, len(languages)))
        if total["w"]:
            w[np.array(total["feature"]), np.array(total["language"])] = np.array(total["w"])
        blocks = max(1, learned.select("block").distinct().count())
        model = Model(languages, model.idf, w[:-1] / blocks, w[-1] / blocks)
    now = spark.sparkContext.broadcast(model)
    held = sample.where(F.col("part") < BLOCKS).mapInArrow(
        _raw_scores(now), "z array<double>, label int, weight double").toArrow().to_pydict()
    model.temperature = fit_temperature(
        np.array(held["z"], float).reshape(-1, len(languages)), np.array(held["label"], int),
        np.array(held["weight"], float))
    release(drawn_rows)
    return model


def _predict(model, with_text: bool):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        own: Model = model.value
        lang, score = [], []
        for held, counts, letters in features(piece.column("text")):
            if not letters or not own.languages:
                lang.append(UNKNOWN)
                score.append(0.0)
                continue
            p = softmax(own.scores(held, counts) / own.temperature)
            best = int(p.argmax())
            lang.append(own.languages[best])
            score.append(float(p[best]))
        return pa.RecordBatch.from_arrays(
            [piece.column("row"), *([piece.column("text")] if with_text else []),
             pa.array(lang, pa.string()), pa.array(score, pa.float64())],
            names=["row", *(["text"] if with_text else []), "lang_pred", "score"])
    return per_piece(run, most=SMALL_PIECE)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", carry: list[str] | None = None
            ) -> DataFrame:
    """The columns ``carry`` (default: all) of each row, with lang_pred and score.

    Of languages with one score, the first by name is predicted.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing
    could be learned. The score is the calibrated probability of the predicted language. Columns
    of ``docs`` with these two names are replaced.
    """
    now = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size per language
    kept = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score")]
    # the text goes to Python once
    once = text_col in kept and docs.schema[text_col].dataType == T.StringType()
    sent = [c for c in kept if not (once and c == text_col)]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(c) for c in sent]).alias("row"),
                         F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([
        packed.schema["row"], *([T.StructField("text", T.StringType())] if once else []),
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    found = packed.mapInArrow(_predict(now, once), schema)
    return found.select(*[F.col("text").alias(c) if once and c == text_col
                          else F.col("row")[c].alias(c) for c in kept], "lang_pred", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """A fifth of the documents by their id; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
