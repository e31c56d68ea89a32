"""Severity of toxic texts by cumulative-link ordinal regression.

A text is the set of its words and of the first bytes of its longer words (which keep a stem
together), hashed, each weighted by log(1 + count). Grades 0 < 1 < ... < K
share one weight vector w; ordered thresholds t1 < ... < tK cut the score:

    P(grade >= k | x) = 1 / (1 + exp(-(w x - t_k)))

so the expected severity is the sum of those probabilities. The thresholds are t1 plus positive
steps, learned through their logarithms. FTRL with an elastic net learns w and the thresholds in
a fixed number of blocks, whose results are averaged after each round.

Labels that only say toxic or not are graded first: words that toxic texts hold more often than
others (by the z-score of the log odds, over all labelled rows) are marks, and toxic texts are
cut into grades at the quantiles of their number of marks.

Equal rows count once. Where a class is sampled, each of its rows stands for as many as were left
out: it weighs 1 / share in learning, so the odds of the classes, and with them the scores and the
cut at a half, are those of the whole table at every size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafill.llm.common import KEY, document_key, share_drawn
from stratafill.llm.ftrl import Ftrl
from stratafill.llm.words import per_piece, words_of
from stratafill.sources.staging import release, stage

FEATURE_BITS = 20
FEATURES = 1 << FEATURE_BITS
PREFIXES = (5, 7, 9)     # bytes
LEAST_TEXTS = 5          # a word of fewer labelled texts is no feature
MARK_Z = 4.0
GRADES = 4               # 0 (not toxic) to 3
SAMPLE_PER_CLASS = 6000  # toxic and other rows to learn from, at most (about)
BLOCKS = 4
ROUNDS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.2, 0.1


def features(column: pa.Array):
    """Per text its hashed words and beginnings of words, with their counts."""
    words = words_of(column)
    parts = [(words.hashes, words.bounds)]
    for size in PREFIXES:
        at, value = words.prefix_hashes(size)
        parts.append((value, np.searchsorted(at, words.bounds)))
    slots = [((value >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), bounds)
             for value, bounds in parts]
    for i in range(len(words.bounds) - 1):
        yield np.unique(np.concatenate([s[b[i]:b[i + 1]] for s, b in slots]), return_counts=True)


@dataclass
class Model:
    weights: np.ndarray                 # a weight per feature
    first: float = 0.0                  # t1
    steps: np.ndarray = field(default_factory=lambda: np.zeros(GRADES - 2))  # logs of t(k+1) - tk
    known: np.ndarray | None = None     # features that may be used

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.steps))])

    def vector(self, held: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        use = self.known[held]
        return held[use], np.log1p(counts[use])

    def at_least(self, held: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, ..., K."""
        held, x = self.vector(held, counts)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[held] - self.thresholds, -40, 40)))


def cumulative_gradient(score: float, thresholds: np.ndarray, grade: int) -> tuple[float, np.ndarray]:
    """Of -log P(grade): by the score, and by each threshold."""
    above = 1 / (1 + np.exp(-np.clip(score - thresholds, -40, 40)))
    upper = np.concatenate([[1.0], above])[grade]
    lower = np.concatenate([above, [0.0]])[grade]
    p = max(upper - lower, 1e-12)
    by_threshold = np.zeros(len(thresholds))
    slope = above * (1 - above)
    if grade > 0:
        by_threshold[grade - 1] = slope[grade - 1] / p
    if grade < len(thresholds):
        by_threshold[grade] = -slope[grade] / p
    return -float(by_threshold.sum()), by_threshold


def _count_texts(batches):
    """Texts per feature and class in the partition; feature -1 counts texts."""
    seen = np.zeros((2, FEATURES + 1), np.int64)
    for batch in per_piece(lambda piece: piece)(batches):
        labels = batch.column("toxic").to_pylist()
        for label, (held, _) in zip(labels, features(batch.column("text")), strict=True):
            seen[label, held] += 1
            seen[label, FEATURES] += 1
    for label in (0, 1):
        some = np.flatnonzero(seen[label])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), label, np.int32)), pa.array(some),
             pa.array(seen[label, some])], names=["toxic", "feature", "n"])


def _marks(marked):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        n = [int(counts[marked.value[held]].sum()) for held, counts in features(piece.column("text"))]
        return pa.RecordBatch.from_arrays(
            [piece.column(c) for c in ("text", "toxic", "order")] + [pa.array(n, pa.int64())],
            names=["text", "toxic", "order", "marks"])
    return per_piece(run)


def _learn_block(model):
    def run(table: pa.Table) -> pa.Table:
        start: Model = model.value
        k = GRADES - 1
        ftrl = Ftrl(start.weights, ALPHA, BETA, L1, L2)
        # thresholds and steps: the same rule without the sparse part
        cuts = Ftrl(np.append(start.first, start.steps), ALPHA, BETA, 0.0, 0.0)
        every = np.arange(k)
        table = table.sort_by([("order", "ascending"), ("text", "ascending")])
        grades = table.column("grade").to_pylist()
        weights = table.column("weight").to_pylist()
        done = 0
        for batch in table.select(["text"]).combine_chunks().to_batches():
            for piece in per_piece(lambda p: p)([batch]):
                for held, counts in features(piece.column("text")):
                    held, x = start.vector(held, counts)
                    w, c = ftrl.weights(held), cuts.weights(every)
                    now = Model(w, float(c[0]), np.clip(c[1:], -6, 6))
                    by_score, by_cut = cumulative_gradient(
                        float(x @ w), now.thresholds, grades[done])
                    by_score, by_cut = weights[done] * by_score, weights[done] * by_cut
                    ftrl.step(held, w, by_score * x)
                    # a step moves its own threshold and all higher ones
                    tail = np.cumsum(by_cut[::-1])[::-1]
                    cuts.step(every, c, np.append(tail[0], tail[1:] * np.exp(now.steps)))
                    done += 1
        some = np.flatnonzero(ftrl.n)
        w = ftrl.weights(some)
        c = cuts.weights(every)
        return pa.table({"feature": pa.array(np.concatenate([some, FEATURES + every]), pa.int32()),
                         "w": pa.array(np.concatenate([w, c]))})
    return run


def train(rows: DataFrame) -> Model | None:
    """Learn from ``rows`` (text, toxic 0 or 1): all for word statistics, a sample for weights.

    Gives None if either class is absent. Rows with a null are ignored, equal rows count once.
    The sample is drawn by a cut of a hash of the text, about SAMPLE_PER_CLASS rows of each
    class, and weighted by what it stands for (1 on average), so it has the odds of all rows.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("text").cast("string"), F.col("toxic").cast("int")).dropna()
    rows = stage(rows.where("toxic in (0, 1)").distinct(), "toxic_rows")
    found = rows.mapInArrow(_count_texts, "toxic int, feature bigint, n bigint").groupBy(
        "toxic", "feature").agg(F.sum("n").alias("n")).toArrow()  # 2 * FEATURES at most
    seen = np.zeros((2, FEATURES + 1), np.int64)
    seen[found.column("toxic").to_numpy(), found.column("feature").to_numpy()] = (
        found.column("n").to_numpy())
    texts = seen[:, FEATURES]
    if not texts.all():
        release(rows)
        return None
    n = seen[:, :FEATURES]
    odds = np.log((n[1] + 0.5) / (texts[1] - n[1] + 0.5)) - np.log(
        (n[0] + 0.5) / (texts[0] - n[0] + 0.5))
    error = np.sqrt(sum(1 / (n[c] + 0.5) + 1 / (texts[c] - n[c] + 0.5) for c in (0, 1)))
    marked = spark.sparkContext.broadcast(odds / error >= MARK_Z)  # a bit per feature
    known = n.sum(axis=0) >= LEAST_TEXTS

    order = F.xxhash64("text")
    drawn = [(F.col("toxic") == c) & share_drawn(order, SAMPLE_PER_CLASS, int(texts[c]))
             for c in (0, 1)]
    found = rows.where(drawn[0] | drawn[1]).withColumn("order", order)
    held = stage(found.mapInArrow(
        _marks(marked), "text string, toxic int, order bigint, marks bigint"), "toxic_sample")
    release(rows)
    # weighed by what was drawn, 1 on average
    taken = {r.toxic: r.n for r in held.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    mean = sum(int(texts[c]) for c in taken) / max(1, sum(taken.values()))
    each = [float(texts[c]) / taken.get(c, 1) / mean for c in (0, 1)]
    sample = held.withColumn("weight", F.when(F.col("toxic") == 1, each[1]).otherwise(each[0]))
    cuts = [i / (GRADES - 1) for i in range(1, GRADES - 1)]
    found = sample.where("toxic = 1").agg(F.percentile("marks", F.array(*map(F.lit, cuts)))).first()
    grade = F.lit(1)
    for cut in found[0] or []:
        grade = grade + F.when(F.col("marks") > cut, 1).otherwise(0)
    graded = sample.select(
        "text", "order", "weight", F.when(F.col("toxic") == 1, grade).otherwise(0).alias("grade"),
        F.pmod(F.shiftright("order", 24), F.lit(BLOCKS)).cast("int").alias("block"))
    model = Model(np.zeros(FEATURES), first=1.0, known=known)
    for _ in range(ROUNDS):
        now = spark.sparkContext.broadcast(model)
        total = graded.groupBy("block").applyInArrow(
            _learn_block(now), "feature int, w double").groupBy("feature").agg(
            F.avg("w").alias("w")).toArrow()  # over the blocks that have the feature
        w = np.zeros(FEATURES + GRADES - 1)
        w[total.column("feature").to_numpy()] = total.column("w").to_numpy()
        model = Model(w[:FEATURES], float(w[FEATURES]), np.clip(w[FEATURES + 1:], -6, 6), known)
    release(held)
    return model


def _grade(model):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        own: Model | None = model.value
        p = (np.array([own.at_least(held, counts) for held, counts in
                       features(piece.column("text"))]).reshape(-1, GRADES - 1)
             if own else np.zeros((piece.num_rows, GRADES - 1)))
        # the likeliest grade: differences of the cumulative probabilities
        each = -np.diff(np.column_stack([np.ones(len(p)), p, np.zeros(len(p))]), axis=1)
        return pa.RecordBatch.from_arrays(
            [*[piece.column(c) for c in KEY], pa.array(each.argmax(axis=1).astype(np.int32)),
             pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 0] >= 0.5)],
            names=[*KEY, "grade", "expected_severity", "toxic_score", "toxic"])
    return per_piece(run)


def severity(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: _id, _th, grade, expected_severity, toxic_score, toxic.

    ``toxic_score`` is P(grade >= 1) and ``toxic`` whether it is a half or more. A null or empty
    text has no words and is graded by the thresholds alone; without a model all is 0 and false.
    No shuffle; other columns play no part.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"),
                        *[c.alias(n) for n, c in document_key(docs, id_col, text_col).items()])
    now = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    return texts.mapInArrow(_grade(now), "_id bigint, _th bigint, grade int, "
                            "expected_severity double, toxic_score double, toxic boolean")
