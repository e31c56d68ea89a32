"""Language identification against a plain fit of the same rule."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratafill.llm import langid


def grams(text):
    """Runs of 1 to 3 characters with a letter, by their hash, where all but letters are blanks."""
    (held, counts, _), = langid.features(pa.array([text]))
    folded = "".join(c.lower() if c.isalpha() else " " for c in text)
    plain = Counter(folded[i:i + n] for n in langid.SIZES for i in range(len(folded) - n + 1)
                    if folded[i:i + n].strip())
    assert sum(plain.values()) == counts.sum() and len(held) <= len(plain)
    return dict(zip(held.tolist(), counts.tolist(), strict=True))


def vector(text, df, n):
    x = {g: math.log1p(k) * (math.log((1 + n) / (1 + df[g])) + 1) for g, k in grams(text).items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {g: v / norm for g, v in x.items()} if norm else x


def weight(z, n):
    if abs(z) <= langid.L1:
        return 0.0
    return -(z - math.copysign(langid.L1, z)) / (
        (langid.BETA + math.sqrt(n)) / langid.ALPHA + langid.L2)


def softmax(scores):
    e = np.exp(np.array(scores) - max(scores))
    return e / e.sum()


def test_a_plain_fit_gives_the_same_probabilities(spark, monkeypatch):
    monkeypatch.setattr(langid, "BLOCKS", 1)
    monkeypatch.setattr(langid, "ROUNDS", 1)
    rng = random.Random(4)
    rows = [(" ".join(rng.choices(words, k=rng.randint(1, 6))), lang)
            for lang, words in (("xx", ["abab", "ba", "cab", "no"]), ("yy", ["oho", "no", "hoc"]))
            for _ in range(60)]
    made = spark.createDataFrame(rows, "text string, lang string")
    order = F.xxhash64("text", "lang")
    drawn = sorted((r.o, r.text, r.lang, r.part) for r in made.distinct().select(
        order.alias("o"), "text", "lang",
        F.pmod(F.shiftright(order, 24), F.lit(10)).alias("part")).collect())
    df, n = Counter(g for t, _ in rows for g in grams(t)), len(rows)
    langs = ["xx", "yy"]
    z, seen = Counter(), Counter()

    def scores(x):
        return [sum(v * weight(z[g, k], seen[g, k]) for g, v in x.items()) for k in (0, 1)]

    for _, text, lang, part in drawn:
        if part < 1:
            continue
        x = vector(text, df, n) | {None: 1.0}  # with the bias
        p = softmax(scores(x))
        for g, v in x.items():
            for k in (0, 1):
                step = v * (p[k] - (langs[k] == lang))
                w, grown = weight(z[g, k], seen[g, k]), seen[g, k] + step * step
                # all steps of a text use the weights before it
                z[g, k] += step - (math.sqrt(grown) - math.sqrt(seen[g, k])) / langid.ALPHA * w
                seen[g, k] = grown
    model = langid.train(made)
    asked = [t for t, _ in rows[:20]] + ["", "12", "abab oho", "zzz"]
    got = langid.predict(spark.createDataFrame(
        [(i, t) for i, t in enumerate(asked)], "doc_id int, text string"), model).collect()
    for r in got:
        if not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == (langid.UNKNOWN, 0.0)
            continue
        p = softmax(np.array(scores(vector(r.text, df, n) | {None: 1.0})) / model.temperature)
        assert r.lang_pred == langs[int(p.argmax())]
        assert abs(r.score - p.max()) < 1e-9
