import random
import re

import corpus_pipeline as P
from corvid.llm import _common, shingle_dedup

from .helpers import documents, words
from .test_dedup import WORD, brute_components, brute_simhash


def similar(a, b):
    """Whether two texts' sets of five-word shingles have a similarity of 0.8 or more."""
    sets = []
    for t in (a, b):
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))  # op5's case: no other letters
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    return 5 * len(sets[0] & sets[1]) >= 4 * len(sets[0] | sets[1])


def edited(seed=7):
    """Texts and copies of them with some words replaced, copies of copies too; short ones, blanks and repeats."""
    rng = random.Random(seed)
    texts = []
    for i in range(120):
        w = words(rng, rng.choice([3, 40, 90, 200]), 5000)
        if i % 4 and texts:
            w = (rng.choice(texts[-6:]) or "x").split()
            for _ in range(rng.randrange(0, 1 + len(w) // 35)):
                w[rng.randrange(len(w))] = f"changed{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    out = [(i, t, ("en", "fr")[i % 2], f"s{i % 3}") for i, t in enumerate(texts)]
    return out + [(500, None, None, "s0"), (501, " \n", "en", "s0"), (502, texts[0].upper(), "en", "s1"), (502, texts[0].upper(), "en", "s1")]


def kept(rows):
    fps, t = brute_simhash(rows), [r[1] for r in rows]
    root = brute_components(len(rows), lambda a, b: similar(t[a], t[b]) or bin(fps[a] ^ fps[b]).count("1") <= 2)
    only = brute_components(len(rows), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    assert len(set(only)) > len(set(root)) + 5  # fingerprints alone miss many
    return sorted(rows[k][0] for k in set(root))


def test_near_dedup_equals_brute_force(spark):
    rows = edited()
    got = P.keep_one_of_each(spark, documents(spark, rows), "")
    assert got.columns == list(P.COLUMNS)
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)


def test_near_dedup_in_small_tiles(spark, monkeypatch):
    rows = edited(8)
    for name in ("TILE", "STAR"):
        monkeypatch.setattr(shingle_dedup, name, 2)
    got = P.keep_one_of_each(spark, documents(spark, rows), "")
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)


def test_sieve_passes_all_that_match(spark, monkeypatch):
    table = spark.range(20_000).selectExpr("id * 7919 - 3000000 as k", "id as v")
    keys = table.where("v % 10 = 0").select("k").withColumnRenamed("k", "key").withColumnRenamed("key", "k")
    for most in (1 << 28, 1 << 16):  # with too few bits more pass, none is lost
        monkeypatch.setattr(_common, "SIEVE_MOST", most)
        got = {r.v for r in _common.sieved(table.repartition(5), keys, "k").collect()}
        assert set(range(0, 20_000, 10)) <= got and len(got) < (2_500 if most > 1 << 16 else 20_000)
    assert _common.sieved(table, keys.where("false"), "k").count() == 0 and _common.sieved(table.where("false"), keys, "k").count() == 0
