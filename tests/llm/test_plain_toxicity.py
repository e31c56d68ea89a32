"""Severity grades against a plain fit of the same rule, and odd rows with a trained model."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratafill.llm import toxicity
from stratafill.llm.toxicity import ALPHA, BETA, L1, L2


def counted(text):
    (held, counts), = toxicity.features(pa.array([text]))
    return dict(zip(held.tolist(), counts.tolist(), strict=True))


def rows_of(n):
    rng = random.Random(3)
    plain, bad = [f"plain{i}" for i in range(12)], ["vile", "nasty", "awful"]
    return [(" ".join(rng.choices(plain, k=6) + [rng.choice(bad) for _ in range(rng.randint(1, 5) * t)]
                      + [f"own{k}"]), t) for k, t in enumerate([0, 0, 0, 1] * n)]


def rule(z, n, l1, l2):
    return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((BETA + math.sqrt(n)) / ALPHA + l2)


def logistic(x):
    return 1 / (1 + math.exp(-x))


class Plain:
    """FTRL over scores and thresholds t1, t1 + exp(s1), ..., one text after another."""

    def __init__(self, known):
        self.known, self.z, self.n = known, Counter(), Counter()
        self.cz, self.cn = [-1.0 * BETA / ALPHA, 0.0, 0.0], [0.0] * 3

    def vector(self, text):
        return {f: math.log1p(c) for f, c in counted(text).items() if f in self.known}

    def cuts(self):
        c = [rule(z, n, 0.0, 0.0) for z, n in zip(self.cz, self.cn, strict=True)]
        steps = [math.exp(min(max(s, -6), 6)) for s in c[1:]]
        return c, steps, [c[0], c[0] + steps[0], c[0] + sum(steps)]

    def score(self, x):
        return sum(v * rule(self.z[f], self.n[f], L1, L2) for f, v in x.items())

    def learn(self, text, grade):
        x = self.vector(text)
        c, steps, t = self.cuts()
        above = [1.0, *[logistic(self.score(x) - u) for u in t], 0.0]
        p = max(above[grade] - above[grade + 1], 1e-12)
        by = [0.0] * 3
        for k, sign in ((grade, 1), (grade + 1, -1)):
            if 1 <= k <= 3:
                by[k - 1] = sign * above[k] * (1 - above[k]) / p
        self._follow(self.z, self.n, {f: -sum(by) * v for f, v in x.items()},
                     lambda z, n: rule(z, n, L1, L2))
        moved = [sum(by), sum(by[1:]) * steps[0], by[2] * steps[1]]
        self._follow(self.cz, self.cn, dict(enumerate(moved)), lambda z, n: rule(z, n, 0.0, 0.0))

    @staticmethod
    def _follow(z, n, gradient, weight):
        for f, g in gradient.items():
            w, grown = weight(z[f], n[f]), n[f] + g * g
            z[f] += g - (math.sqrt(grown) - math.sqrt(n[f])) / ALPHA * w
            n[f] = grown


def test_a_plain_fit_gives_the_same_severity(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCKS", 1)
    monkeypatch.setattr(toxicity, "ROUNDS", 1)
    rows = rows_of(30)
    made = spark.createDataFrame(rows, "text string, toxic int")
    in_class = [[counted(t) for t, c in rows if c == k] for k in (0, 1)]
    seen = [Counter(f for x in texts for f in x) for texts in in_class]
    marked = set()
    for f in seen[0] | seen[1]:
        a, b = ((seen[k][f] + 0.5, len(in_class[k]) - seen[k][f] + 0.5) for k in (1, 0))
        z = (math.log(a[0] / a[1]) - math.log(b[0] / b[1])) / math.sqrt(sum(1 / v for v in (*a, *b)))
        if z >= toxicity.MARK_Z:
            marked.add(f)
    marks = {t: sum(n for f, n in counted(t).items() if f in marked) for t, _ in rows}
    cuts = np.quantile([marks[t] for t, c in rows if c], [1 / 3, 2 / 3])
    plain = Plain({f for f in seen[0] | seen[1] if seen[0][f] + seen[1][f] >= toxicity.LEAST_TEXTS})
    for r in sorted(made.select(F.xxhash64("text").alias("o"), "text", "toxic").collect()):
        plain.learn(r.text, r.toxic and 1 + int(sum(marks[r.text] > cuts)))
    model = toxicity.train(made)
    docs = spark.createDataFrame(list(enumerate(t for t, _ in rows)), "doc_id int, text string")
    for r in toxicity.severity(docs, model).collect():
        score, t = plain.score(plain.vector(rows[r._id][0])), plain.cuts()[2]
        p = [logistic(score - u) for u in t]
        assert abs(r.toxic_score - p[0]) < 1e-9 and abs(r.expected_severity - sum(p)) < 1e-9
        assert r.toxic == (p[0] >= 0.5)


def test_odd_rows_with_a_trained_model(spark):
    model = toxicity.train(spark.createDataFrame(
        [*rows_of(30), (None, 1), ("x", None), ("x", 7)], "text string, toxic int"))
    rows = [(1, None), (2, ""), (None, "vile nasty awful vile"), (3, "..."), (4, "vile " * 40_000),
            (5, "plain1 plain2"), (5, "plain1 plain2")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id int, text string, grade string")
    got = toxicity.severity(docs, model).collect()
    assert len(got) == len(rows)
    by = {r._id: r for r in got}
    assert by[None].toxic and by[4].toxic and not by[5].toxic
    empty = {(r.grade, r.toxic_score) for r in got if r._id in (1, 2, 3)}
    assert len(empty) == 1 and not by[1].toxic
    assert toxicity.severity(docs.limit(0), model).count() == 0
