"""Language ID against the same model worked out number by number."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.llm import language_id

from .helpers import documents


def grams(text):
    """How often each n-gram of 1 to 3 characters stands in a text, as a hashed column."""
    plain = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
    if not plain:
        return Counter()
    plain = f" {plain} "
    return Counter(column(plain[k : k + n]) for n in (1, 2, 3) for k in range(len(plain) - n + 1))


def column(gram, known={}):  # noqa: B006 - what was hashed before
    if gram not in known:
        known[gram] = int(language_id._columns(np.array([ord(c) for c in gram], np.uint32))[-1])
    return known[gram]


def softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


class Learned:
    """FTRL-proximal on plain numbers: rows are (doc_id, text, lang) in the order of training."""

    def __init__(self, rows):
        rows = [(t, lang) for _, t, lang in rows if t is not None and lang is not None]
        held = Counter(c for t, _ in rows for c in grams(t))
        self.idf = lambda c: math.log((1 + len(rows)) / (1 + held[c])) + 1
        data = [(lang, self.values(t)) for t, lang in rows if grams(t)]
        self.names = sorted({lang for lang, _ in data})
        self.z, self.n = {}, {}
        hold = max(1, int(0.2 * len(data))) if len(data) >= 10 else 0
        for _ in range(2):
            for lang, x in data[hold:]:
                p = softmax(self.raw(x))
                w = {c: [self.weight(c, k) for k in range(len(self.names))] for c in x}
                for k, name in enumerate(self.names):
                    for c, v in x.items():
                        g = (p[k] - (name == lang)) * v
                        before = self.n.get((c, k), 0.0)
                        self.z[c, k] = self.z.get((c, k), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / 0.5 * w[c][k]
                        self.n[c, k] = before + g * g
        kept = [(self.names.index(lang), self.raw(x)) for lang, x in data[:hold]]
        loss = lambda t: -sum(math.log(max(softmax([v / t for v in raw])[y], 1e-12)) for y, raw in kept)
        self.t = min((0.2 * 100 ** (k / 3000) for k in range(3001)), key=loss) if kept else 1.0

    def values(self, text):
        counts = grams(text)
        total = sum(counts.values())
        return {c: n / total * self.idf(c) * 4 for c, n in counts.items()} | {"bias": 1.0}

    def weight(self, c, k):
        z = self.z.get((c, k), 0.0)
        return 0.0 if abs(z) <= 1e-3 else (math.copysign(1e-3, z) - z) / ((1 + math.sqrt(self.n.get((c, k), 0.0))) / 0.5 + 1e-4)

    def raw(self, x):
        return [sum(v * self.weight(c, k) for c, v in x.items()) for k in range(len(self.names))]

    def predict(self, text):
        """Probabilities by language; none for a text without letters."""
        return dict(zip(self.names, softmax([v / self.t for v in self.raw(self.values(text))]), strict=True)) if grams(text) else {}


def out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def learned(spark, rows):
    """The model of rows (doc_id, text, lang, source); training runs in the order of a hash of the ids."""
    ids = spark.createDataFrame([(r[0],) for r in rows], "doc_id long")
    order = {r.doc_id: r.o for r in ids.select("doc_id", F.xxhash64("doc_id", F.lit(11)).alias("o")).collect()}
    return Learned(sorted(((i, t, lang) for i, t, lang, _ in rows if not out(i)), key=lambda r: order[r[0]]))


def mixed(seed, n, names="abcdef"):
    """Texts in made-up languages that share letters, each with words of others, so that no model is sure of all."""
    rng = random.Random(seed)
    letters = {x: rng.sample("aeioustrnlédmü", 8) for x in names}
    word = lambda x: "".join(rng.choice(letters[x]) for _ in range(rng.randrange(2, 7)))
    rows = []
    for i in range(n):
        own, noise = names[i % len(names)], rng.choice((0.1, 0.5, 0.9))
        text = " ".join(word(rng.choice(names) if rng.random() < noise else own) for _ in range(rng.randrange(1, 30)))
        rows.append((i, text + rng.choice(("", "!! 12", " 3.5 ")), None if i % 13 == 12 else own, f"s{i % 3}"))
    return rows + [(n, None, "a", "s0"), (n + 1, "12 !!", "b", None), (n + 2, "", None, "s1"), (n + 3, "É" * 3, None, None)]


@pytest.mark.parametrize("seed,n", [(1, 90), (2, 9)])
def test_model_equals_brute_force(spark, seed, n):
    rows = mixed(seed, n)
    model = learned(spark, rows)
    got = {r.doc_id: r for r in language_id.identify(documents(spark, rows)).collect()}
    unsure = 0
    for i, text, *_ in rows:
        want = model.predict(text)
        best = max(want, key=want.get, default="und")
        assert got[i].held_out == out(i) and got[i].score == pytest.approx(want.get(best, 0.0), abs=2e-3), i
        assert want.get(got[i].lang_pred, 0.0) == pytest.approx(want.get(best, 0.0), abs=2e-3) and (got[i].lang_pred == "und") == (not want)
        unsure += 0 < want.get(best, 0.0) < 0.6
    assert n < 20 or unsure > 5
