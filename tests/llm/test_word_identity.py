"""Words that share a hash are still different words."""

import numpy as np
import pytest

from corvid.llm import _common, _tokens, best_fit_packing, substring_dedup, token_counts

from .helpers import documents
from .test_dedup import brute_substrings


def twins():
    """Two words of 1,024 bytes on which every polynomial hash modulo 2^64 agrees."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    return a, b


def test_hashes_of_long_twins_differ():
    a, b = twins()
    data = np.frombuffer((a + b + "ab").encode(), np.uint8)
    h = _common.word_hashes(data, np.array([0, 1024, 0, 2048]), np.array([1024, 2048, 2, 2050]))
    assert h[0] != h[1] and h[2] == h[3]


@pytest.fixture(params=[False, True])
def colliding(request, monkeypatch):
    """Once as it is, once with a hash under which very many words meet."""
    if request.param:
        monkeypatch.setattr(_common, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    return request.param


def test_ids_of_twins(colliding):
    a, b = twins()
    words = _tokens.WordIds(_tokens.WORD_TOKENIZER)
    for text in (f"{a} {b} one two, {a} three", f"{b} {a} two six", f"one two; {b}, café {a}."):
        data = np.frombuffer(text.encode(), np.uint8)
        ids, at = words.ids(data, np.array([0, len(data)]))
        assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids and at.tolist() == [0, len(ids)]


def test_passages_that_differ_in_a_twin(spark):
    a, b = twins()
    same = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{same} {a}", "en", "s"), (2, f"{same} {b}", "en", "s"), (3, f"x {same} {a} y", "en", "s")]
    got = substring_dedup.deduplicate(documents(spark, rows), texts=False).collect()
    assert sorted(map(tuple, got), key=repr) == brute_substrings(rows) and [r.n_removed for r in sorted(got)] == [0, 0, 13]


def test_packing_and_counts_of_twins(spark):
    a, b = twins()
    rows = [(1, f"{a} {b}", "en", "s"), (2, f"{b} {a} {b}", "en", "s")]
    words = _tokens.word_ids()
    want = {i: len(words.tokenizer.encode(t, add_special_tokens=False).ids) for i, t, *_ in rows}
    assert {r.doc_id: r.n_tokens for r in token_counts.count(documents(spark, rows)).collect()} == want
    packed = best_fit_packing.pack(documents(spark, rows), with_ids=True).collect()
    ids = {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.piece)):
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert ids == {i: [*words.tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t, *_ in rows}
