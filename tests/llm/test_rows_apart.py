import random
from collections import Counter

import corpus_pipeline as P

from .helpers import documents, words


def test_rows_with_one_doc_id_are_judged_apart(spark):
    rng = random.Random(3)
    texts = [" ".join(words(rng, 60, 5000)) for _ in range(4)]
    rows = [(1, texts[0], "en", "s0"), (1, texts[1], "en", "s0"), (2, texts[1], "en", "s0"), (None, texts[2], "en", "s0"), (None, texts[2], "en", "s1"), (None, texts[3], "en", "s0"), (3, texts[3], "en", "s0")]
    got = P.keep_one_of_each(spark, documents(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, texts.index(r.text)) for r in got) == [(0, 2), (1, 0), (1, 1), (3, 3)]


def test_mix_takes_rows_apart(spark, tmp_path):
    rng = random.Random(4)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(None if i % 3 == 0 else i % 7, " ".join(words(rng, rng.randrange(5, 40))), "en", f"s{i % 3 if i % 5 else 0}") for i in range(150)]
    rows += [rows[9]] * 3
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(t.split())
    # Targets by raising the water level in small steps: at most two passes over a source, weights 3, 1, 2, 1.5 of all words.
    weight, level = {"s0": 3, "s1": 1, "s2": 2}, 0.0
    while sum(min(2 * size[s], level * w) for s, w in weight.items()) < 1.5 * sum(size.values()):
        level += 0.1
    got, times = Counter(), Counter()
    for r in P.mix(spark, documents(spark, rows), str(tmp_path)).collect():
        got[r.source] += len(r.text.split())
        times[(r.doc_id, r.text, r.source)] += 1
    here = Counter((i, t, s) for i, t, _, s in rows)
    assert all(n <= 2 * here[k] for k, n in times.items())
    assert all(abs(got[s] - min(2 * size[s], level * w)) <= 40 for s, w in weight.items())
