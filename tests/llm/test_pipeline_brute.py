"""Every stage of the pipeline, and the whole of it, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from corvid.llm._tokens import WORD_TOKENIZER

from .helpers import documents
from .test_dedup import WORD, brute_components, brute_simhash
from .test_language_brute import learned, mixed
from .test_near_copies import similar
from .test_text_operators import FORMS, brute_targets, luhn

GOOD = {"email": lambda m, d: True, "ip": lambda m, d: all(int(p) <= 255 for p in m.split(".")), "card": lambda m, d: 13 <= len(d) <= 19 and luhn(d), "phone": lambda m, d: 9 <= len(d) <= 15}


def identified(spark, rows):
    model = learned(spark, rows)
    out = []
    for i, t, _, s in rows:
        p = model.predict(t)
        best = max(p, key=p.get, default=None)
        if best and p[best] >= 0.3:
            out.append((i, t, best, s))
    return out


def one_of_each(rows):
    fps, t = brute_simhash(rows), [r[1] for r in rows]
    root = brute_components(len(rows), lambda a, b: similar(t[a], t[b]) or bin(fps[a] ^ fps[b]).count("1") <= 2)
    return [min(r for k, r in enumerate(rows) if root[k] == c) for c in sorted(set(root))]


def redacted(rows):
    out = []
    for i, t, lang, s in rows:
        for kind, form in FORMS.items():
            t = re.sub(form, lambda m: f"[{kind.upper()}]" if GOOD[kind](m[0], re.sub("[^0-9]", "", m[0])) else m[0], t)  # noqa: B023
        out.append((i, t, lang, s))
    return out


def mix(rows, quality):
    """Rows as often as they are taken, whole passes first, then the front of the sampling order."""
    size = {r: len(WORD.findall(r[1])) for r in rows}
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None] * any(r[3] is None for r in rows)
    sizes = {n: sum(size[r] for r in rows if r[3] == n) for n in names}
    out = Counter()
    for name, target in brute_targets(sizes).items():
        mine = []
        for r in (r for r in rows if r[3] == name):
            drawn = hashlib.md5(f"20240:{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()
            weight = {None: 1.0, 0: 0.5, 1: 2.0}[quality.get(r[0])]
            mine.append((-math.log((int(drawn[:13], 16) + 0.5) / 2**52) / weight, r))
        whole = min(2, int(target // sizes[name])) if sizes[name] else 0
        rest = target - whole * sizes[name]
        for _, r in sorted(mine, key=lambda x: x[0]):
            part = max(0, min(size[r], rest))
            rest -= size[r]
            out[r] = min(2, whole + (size[r] > 0 and 2 * part >= size[r]))
    return list(out.elements())


def pieces(rows):
    plain, out = Tokenizer.from_file(public_tokenizers.path(WORD_TOKENIZER)), []
    for i, t, *_ in rows:
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4")
        out += [(i, p, lo, len(ids[lo : lo + 4096]), zlib.crc32(ids[lo : lo + 4096].tobytes())) for p, lo in enumerate(range(0, len(ids), 4096))]
    return out


def corpus():
    """Documents in six languages with near copies, personal data, a long text, nulls and blanks."""
    rng, rows = random.Random(21), []
    for i, t, lang, s in mixed(5, 150):
        if t and i % 5 == 4:
            t += rng.choice((" a@b.co now", " 4111 1111 1111 1111", " +1 (555) 010-9999 x", " at 10.0.0.255,", " 999.1.1.1 and 4111 1111 1111 1112"))
        rows.append((i, t, lang, s))
        if t and i % 6 == 5:
            w = t.split() * 3
            near = w[:-1] + ["changed"]
            rows += [(300 + i, " ".join(w), lang, "s1"), (500 + i, " ".join(near).upper(), lang, None), (700 + i, " ".join(w), lang, "s0")]
    return rows + [(900, " ".join(rng.choice(rows)[1] or "x" for _ in range(200)), "a", "s2")]


def told(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source) for r in df.collect()), key=repr)


def test_stages_and_run_equal_brute_force(spark, tmp_path):
    rows = corpus()
    quality = {i: i % 2 for i, *_ in rows if i % 3 == 0}
    spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(P.STAGES)
    steps = {"language_id": lambda x: identified(spark, x), "near_dedup": one_of_each, "pii": redacted, "mixing": lambda x: mix(x, quality)}
    assert list(stages) == [*steps, "packing"]
    for name, brute in steps.items():
        got = stages[name](spark, documents(spark, rows), str(tmp_path))
        assert got.columns == list(P.COLUMNS)
        want = brute(rows)
        assert told(got) == sorted(want, key=repr), name
        assert sorted(want, key=repr) != sorted(rows, key=repr)  # each stage has something to do
        rows = want
    packed = stages["packing"](spark, documents(spark, rows), str(tmp_path)).collect()
    whole = P.run(spark, str(tmp_path)).collect()
    for got in (packed, whole):
        assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(pieces(rows))
        filled = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == filled.get(r.sequence_id, 0)
            filled[r.sequence_id] = r.offset + r.length
        assert max(filled.values()) <= 4096 and len(filled) <= -(-sum(r.length for r in got) // 4096) + 1
