import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from corvid.llm import _graph, embedding_dedup, simhash_dedup, substring_dedup
from corvid.llm._graph import stars

from .helpers import corpus, documents, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substrings(rows):
    big, low = 1 << 62, {}
    texts = [(big if i is None else i, i, WORD.findall(t or "")) for i, t, _, _ in rows]
    for i, _, w in texts:
        for k in range(len(w) - 12):
            s = tuple(w[k : k + 13])
            low[s] = min(low.get(s, big), i)
    out = []
    for i, name, w in texts:
        gone = set()
        for k in range(len(w) - 12):
            if low[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((name, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = substring_dedup.deduplicate(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute_substrings(rows)
    for r in got:  # the texts and spans agree with the counts
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.removed) == r.n_removed


def test_substrings_with_tiny_groups(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(substring_dedup, "GROUP", 1)  # every gram is frequent: whole paths are prefixes
    got = substring_dedup.deduplicate(documents(spark, rows), texts=False).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_substrings(rows)


def test_subtrees_equal_brute_force():
    """Leaves of several groups at every window, frequent paths read in pieces included."""
    rng = np.random.default_rng(3)
    window = 5
    leaves = []
    for k in range(300):
        own = k % 5 == 0
        n = window if own else int(rng.integers(window, 2 * window))
        w = [f"w{x}" for x in rng.integers(0, 2, n)]
        leaves.append((k % 7 if not own else 100 + k % 2, " ".join(w) + " ", -1 if own else int(rng.integers(0, min(3, n - 3))), int(rng.integers(0, 40))))
    leaves.sort(key=lambda x: (x[0], x[3]))
    window_of = lambda x, d: tuple(x[1].split()[max(x[2], 0) - d :][:window])
    places = lambda x: [d for d in range(max(x[2], 0) + 1) if len(window_of(x, d)) == window]
    low = {}
    for x in leaves:
        for d in places(x):
            key = (x[0], d, window_of(x, d))
            low[key] = min(low.get(key, 99), x[3])
    want = {k: m for k, x in enumerate(leaves) if (m := sum(1 << d for d in places(x) if low[(x[0], d, window_of(x, d))] < x[3]))}
    table = pa.table({"prefix": [x[0] for x in leaves], "words": pa.array([x[1].encode() for x in leaves]), "before": pa.array([x[2] for x in leaves], pa.int32()), "blob": pa.array([0] * 300, pa.int32()), "leaf": pa.array(range(300), pa.int32()), "low": [x[3] for x in leaves]})
    held = substring_dedup.BUILD, substring_dedup.GRAM
    substring_dedup.GRAM = 3
    try:
        for build, batch in ((1, 1), (2, 3), (8, 7), (1000, 64), (1000, 1000)):
            substring_dedup.BUILD = build
            got = {r["leaf"]: r["late"] for b in substring_dedup._late(iter(table.to_batches(max_chunksize=batch)), window) for r in b.to_pylist()}
            assert got == want
    finally:
        substring_dedup.BUILD, substring_dedup.GRAM = held


def test_suffixes_stand_in_word_order():
    paths = np.array([[1, 2, 3], [1, 2, 4], [0, 9, 9], [1, 2, 3], [1, -1, -1], [1, 2, 3]])
    tree = substring_dedup.Tree(np.array([0, 0, 0, 0, 0, 1]), paths)
    assert tree.order.tolist() == [2, 4, 0, 3, 1, 5] and tree.common.tolist() == [0, 1, 3, 2, -1]
    assert [len(set(tree.node(k).tolist())) for k in range(4)] == [2, 3, 4, 5]


def test_rows_with_one_doc_id(spark):
    rng = random.Random(5)
    passage = " ".join(words(rng, 30))
    rows = [(None, f"{passage} a{i % 3}", "en", "s") for i in range(20)] + [(4, f"x{i % 4} {passage}", "en", "s") for i in range(12)] + [(2, f"{passage} {passage}", "en", "s"), (1, " ".join(["a"] * 60), "en", "s"), (3, "b " + " ".join(["a"] * 20), "en", "s")]
    got = substring_dedup.deduplicate(documents(spark, rows), texts=False).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_substrings(rows)


def test_substrings_of_nothing(spark):
    assert substring_dedup.deduplicate(documents(spark, []).where("false")).count() == 0


def brute_simhash(rows):
    fps = []
    for i, t, _, _ in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        h = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in s], np.uint64)
        ones = [(int(((h >> np.uint64(b)) & np.uint64(1)).sum())) for b in range(64)]
        fps.append(sum(1 << b for b in range(64) if 2 * ones[b] > len(h)))
    return fps


def brute_components(n, linked):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a in range(n):
            for b in range(a):
                if linked(a, b) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


@pytest.mark.parametrize("at_once", [0, 1 << 17])
def test_simhash_equals_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(_graph, "AT_ONCE", at_once)
    rows = [(i, t.upper() if t and i and i % 5 == 0 else t, l, s) for i, t, l, s in corpus(4)]
    fps = brute_simhash(rows)
    root = brute_components(len(rows), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    ids = [r[0] for r in rows]
    low = {r: min(ids[k] for k in range(len(rows)) if root[k] == r and ids[k] is not None) for r in set(root) if any(ids[k] is not None for k in range(len(rows)) if root[k] == r)}
    want = sorted(((ids[k], f"{fps[k]:016x}", low.get(root[k])) for k in range(len(rows))), key=repr)
    got = simhash_dedup.cluster(documents(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_gray_index_finds_all(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) for _ in range(4))])
    near = np.unique(np.concatenate([near, near[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))]))
    index = simhash_dedup.GrayIndex(near)
    for most in (0, 1, 2, 3):
        found = {(int(near[q]), int(index.fps[m])) for qs, ms in index.search(near, most) for q, m in zip(qs, ms, strict=True)}
        want = {(int(a), int(b)) for a in near for b in near[np.bitwise_count(near ^ a) <= most]}
        assert found == want


def test_simhash_blocks_link_across(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    chain = [base]
    for _ in range(5):
        chain.append(chain[-1] ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)))
    fps = np.unique(np.concatenate(chain))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = [(r.a, r.b) for r in simhash_dedup.links(df, 2, block=64).collect()]
    root = {int(x): int(x) for x in fps.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    for k, x in enumerate(fps):
        for y in fps[np.bitwise_count(fps ^ x) <= 2]:
            assert find(int(x.view(np.int64))) == find(int(y.view(np.int64)))
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 64 for a, b in edges) and len({find(x) for x in root}) >= 300


@pytest.mark.parametrize("at_once", [0, 1 << 17])
def test_stars_of_long_chains_and_hubs(spark, monkeypatch, at_once):
    monkeypatch.setattr(_graph, "AT_ONCE", at_once)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {(r.a, r.b) for r in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 61)} | {(1000 + i, 1000) for i in range(1, 50)}
    assert stars(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, key int, links string").repartition(3)


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(40):
            x = rng.normal(size=24)
            for _ in range(rng.integers(1, 6)):
                rows.append((k, (x + rng.normal(size=24) * rng.choice([0, 0.02, 0.1])).astype(np.float32).tolist(), label))
                k += 1
    x = rng.normal(size=24)
    rows += [(k + i, (x + rng.normal(size=24) * 0.01).astype(np.float32).tolist(), 2) for i in range(300)]  # a large group
    rows += [(5000, None, 0), (5001, [], 0), (5002, [0.0] * 24, 0), (5003, [float("nan")] * 24, 0), (5004, [None] + [1.0] * 23, 0), (5005, rows[0][1], 0), (5006, [1.0, 2.0], 0), (5007, [2.0, 4.0], 0), (0, rows[0][1], 0)]
    ok = lambda r: r[2] is not None and r[1] and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1])
    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if ok(r) else None for r in rows]
    link = lambda a, b: unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98
    n = [sum(link(a, b) for b in range(len(rows)) if b != a) for a in range(len(rows))]
    root = brute_components(len(rows), link)
    low = {r: min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root)}
    want = sorted((rows[k][0], n[k], low[root[k]], rows[k][0] == low[root[k]]) for k in range(len(rows)))
    got = sorted(tuple(r) for r in embedding_dedup.deduplicate(vectors(spark, rows), tile=64).collect())
    assert got == want
    assert embedding_dedup.deduplicate(vectors(spark, rows).where("false")).count() == 0
