import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvid.llm import best_fit_packing, language_id, pii, source_mixing, token_counts, topk_search, url_filters
from corvid.llm._tokens import WORD_TOKENIZER

from .helpers import corpus, documents

# ---------------------------------------------------------------- language ID

SAID = {
    "en": "the house is on the hill and the people who live there are going to the market with their children this morning",
    "de": "das haus steht auf dem hügel und die leute die dort wohnen gehen heute morgen mit ihren kindern auf den markt",
    "fr": "la maison est sur la colline et les gens qui y vivent vont au marché avec leurs enfants ce matin",
}


def test_language_held_out_accuracy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.permutation(SAID[l].split())[:12]) + "!! 123", None if i % 10 == 9 else l, "s") for i, l in enumerate(list(SAID) * 60)]
    rows += [(900, None, "en", None), (901, "123 !!", "en", "s"), (902, "", None, "s"), (903, "le chat " * 60_000, None, "s"), (None, SAID["de"], None, "s"), (3, rows[3][1], "en", "s")]
    got = {(r.doc_id, r.lang_pred): r for r in language_id.identify(documents(spark, rows)).collect()}
    by_id = {k[0]: r for k, r in got.items()}
    assert by_id[900].lang_pred == by_id[901].lang_pred == by_id[902].lang_pred == "und" and by_id[900].score == 0
    assert by_id[903].lang_pred == "fr" and by_id[None].lang_pred == "de"
    out = [(by_id[i].lang_pred, list(SAID)[i % 3], by_id[i]) for i in range(180)]
    held = [(p, t) for p, t, r in out if r.held_out]
    assert held and np.mean([p == t for p, t in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in by_id.items() if i is not None)
    assert all(0 <= r.score <= 1 for r in by_id.values())


def test_language_without_labels(spark):
    got = language_id.identify(documents(spark, [(1, "text", None, "s")])).collect()
    assert (got[0].lang_pred, got[0].score) == ("und", 0.0)
    assert language_id.identify(documents(spark, []).where("false")).count() == 0


def test_language_parts_agree(monkeypatch):
    text = SAID["fr"] * 30
    whole = np.bincount(np.concatenate(list(language_id._features(text))), minlength=language_id.COLUMNS)
    monkeypatch.setattr(language_id, "PART", 50)
    assert (np.bincount(np.concatenate(list(language_id._features(text))), minlength=language_id.COLUMNS) == whole).all()


# ---------------------------------------------------------------- personal data


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 % 10 + int(c) * 2 // 10 for i, c in enumerate(reversed(d))) % 10 == 0


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


ODD = [
    "a@b.c_d@e.f x@y.z", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.004", "4111 1111 1111 1111, 4111-1111-1111-1111x 411111111111111", "+1 (555) 010-9999 +12 +1 234567890123456",
    "é" * 7 + " a@b.co ☃ +49 30 1234567", "", None, "x" * 50_000 + "@b.c " + "1.2.3.4 " * 700, "a@" + "b." * 20_000 + "c", "9" * 50_000, "a@b.c@d.e@f.g " * 5, "😀😀 +1 555 010 99 99😀 4111111111111111", "no data here",
]


def test_pii_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    noise = ["".join(rng.choice(list("ab1.2@-+ 4()"), 200)) for _ in range(60)]
    rows = [(i, t, None, None) for i, t in enumerate(ODD + noise)]
    got = {r.doc_id: r for r in pii.report(documents(spark, rows)).collect()}
    for i, t, _, _ in rows:
        want = brute_pii(t)
        listed = [f"{k}:{a}:{b}" for k, a, b in want]
        assert got[i].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), (i, t and t[:100])
        assert [getattr(got[i], f"n_{k}") for k in FORMS] == [sum(x[0] == k for x in want) for k in FORMS]
        assert set(listed) <= set(got[i].spans.split(",")) | {""} and (not listed or got[i].spans.startswith(",".join(listed)))


def test_pii_checks_and_context(spark):
    rows = [(1, "iban DE89 3704 0044 0532 0130 00 AND GB82WEST12345698765432", None, None), (2, "DE89 3704 0044 0532 0130 01", None, None), (3, "ssn 123-45-6789", None, None), (4, "part 123-45-6789", None, None)]
    got = {r.doc_id: r.spans for r in pii.report(documents(spark, rows)).collect()}
    assert got == {1: "iban:5:32,iban:37:59", 2: "", 3: "ssn:4:15", 4: ""}


def test_context_on_both_sides(spark):
    far = "x" * 60
    texts = {
        "078-05-1120 is my social security number": [(0, 11)], "ssn: 078-05-1120, 078-05-1121 and 078-05-1122": [(5, 16), (18, 29), (34, 45)], "078-05-1120 078-05-1121 078-05-1122 tax": [(0, 11), (12, 23), (24, 35)],
        f"ssn {far} 078-05-1120 {far} tax": [], "078-05-1120": [], "mass 078-05-1120": [], "é_ssn 078-05-1120 SSN": [(6, 17)], "ssn 000-05-1120 666-05-1120 078-05-1120": [(28, 39)],
    }
    texts |= {"ssn " + " ".join(["078-05-1120"] * 8): [(4 + 12 * k, 15 + 12 * k) for k in range(4)], " ".join(["078-05-1120"] * 9) + " tax": [(12 * k, 12 * k + 11) for k in range(5, 9)]}
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r.spans for r in pii.report(documents(spark, rows)).collect()}
    # By hand: a word anywhere in the 48 code points before or after.
    for i, (t, spans) in enumerate(texts.items()):
        found = [(m.start(), m.end()) for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", t) if not re.match("000|666", m[0]) and re.search(r"(?:^|[^a-z0-9_])(?:ssn|social security|identity|tax)", f"{t[max(0, m.start() - 48) : m.start()]} {t[m.end() : m.end() + 48]}".lower())]
        assert found == spans and got[i] == ",".join(f"ssn:{a}:{b}" for a, b in spans), t
    red = {r.doc_id: r.text for r in pii.redact(documents(spark, rows).withColumn("__pii_cut", F.lit(1))).collect()}
    assert red[1] == "ssn: [SSN], [SSN] and [SSN]" and red[4] == "078-05-1120"


def test_redaction(spark):
    rows = [(1, "mail a@b.co, card 4111 1111 1111 1111 or +1 555 010 9999.", None, None), (2, "clean 2024-01-02 text 3.14", None, None), (3, None, None, None), (4, "4111 1111 1111 1112", None, None)]
    df = documents(spark, rows)
    got = pii.redact(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "mail [EMAIL], card [CARD] or [PHONE].", 2: rows[1][1], 3: None, 4: rows[3][1]}
    assert pii.report(df.where("false")).count() == 0


# ---------------------------------------------------------------- URLs


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "nohost": ("", "", None, "allow"), "HTTP://A.Net/x": ("a.net", "/x", "net/", "block"), "x://net?q": ("net", "", None, "allow"),
        "x://EXAMPLE.net/en/a?b": ("example.net", "/en/a", "example.net/en/", "allow"), "x://sub.example.com/de/": ("sub.example.com", "/de/", "example.com/de/", "block"),
        "x://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "x://a.org/fr/#f": ("a.org", "/fr/", "org/fr/", "allow"), "x://a.com/casino/b": ("a.com", "/casino/b", None, "block"),
        "x://a.net/EN/": ("a.net", "/EN/", "net/", "block"), "http://é.NET/ü\n?x": ("é.net", "/ü\n", "net/", "block"), "": ("", "", None, "allow"), "x://y/" + "a/" * 20_000: ("y", "/" + "a/" * 20_000, None, "allow"),
    }
    df = spark.createDataFrame([(i % 3, u, "h", "p") for i, u in enumerate(cases)], "page_id long, url string, host string, path string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(df).collect()}
    assert got == cases
    assert url_filters.judge(df.where("false")).count() == 0


def test_url_rules_agree_with_all_rules_run(spark):
    rng = np.random.default_rng(3)
    names = ["a", "bb", "net", "shop", "ads", "x1"]
    rules = tuple(url_filters.host_rule(("block", "allow")[i % 2], ".".join(rng.choice(names, rng.integers(1, 3))), "/" + "".join(rng.choice(["", "a/", "bb/"], 1))) for i in range(40))
    rules = tuple({r.name: r for r in rules}.values()) + (url_filters.pattern_rule("p", "block", r"/x1(?:/|$)", "x1"),)
    urls = [f"http://{'.'.join(rng.choice(names, rng.integers(1, 4)))}/{'/'.join(rng.choice(names, rng.integers(0, 3)))}" for _ in range(300)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    by_table = spark.createDataFrame([(r.name, r.verdict, r.pattern, list(r.tokens), r.host_rule) for r in rules], url_filters.RULE_TABLE)
    clashing = df.withColumns({"_filed": F.lit(1), "best": F.lit(2), "token": F.lit(3), "rule": F.lit("x")})
    judged = url_filters.judge(df, rules=rules).collect()
    for other in (url_filters.judge(clashing, rules=rules), url_filters.judge_by_table(clashing, by_table)):
        assert {"_filed", "best", "token"} <= set(other.columns) and len(set(other.columns)) == len(other.columns)
        assert sorted(map(tuple, other.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr) == sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judged), key=repr)
    for r in judged:
        at = r.host + r.path
        fit = [x for x in rules if re.search(x.pattern, at)]
        hosts = [x for x in fit if x.host_rule]
        best = max(hosts, key=lambda x: (len(x.name), x.verdict == "block", x.name), default=None)
        assert r.rule == (best.name if best else None)
        assert r.verdict == (best.verdict if best else "block" if fit else "allow")
    with pytest.raises(ValueError):
        url_filters.pattern_rule("x", "block", ".*")


# ---------------------------------------------------------------- tokens and packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(WORD_TOKENIZER))


def test_packing(spark, tokenizer):
    rows = corpus(5) + [(2000, "a<|endoftext|>b don't É x\u0301 9.9 Σ. İ", None, None)]
    packed = best_fit_packing.pack(documents(spark, rows), with_ids=True)
    got = packed.collect()
    want = []
    for i, t, _, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, p, lo, len(ids[lo : lo + 4096]), zlib.crc32(ids[lo : lo + 4096].tobytes())) for p, lo in enumerate(range(0, len(ids), 4096))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length, r.ids))
    whole = {r.sequence_id: r.ids for r in best_fit_packing.sequences(packed).collect()}
    for s, parts in by_seq.items():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and whole[s] == [x for p in sorted(parts) for x in p[2]]
    assert len(by_seq) <= -(-sum(r.length for r in got) // 4096) + 1
    assert best_fit_packing.pack(documents(spark, []).where("false")).count() == 0


@pytest.mark.parametrize("mu,sigma,n", [(6.7, 0.8, 20_000), (6.0, 1.2, 20_000), (7.3, 0.5, 5_000), (8.5, 0.2, 300), (2.0, 1.0, 50)])
def test_packing_plan(mu, sigma, n):
    lengths = np.minimum(4096, np.random.default_rng(n).lognormal(mu, sigma, n).astype(int) + 1)
    hist = np.bincount(lengths, minlength=4097)
    ranges, total = best_fit_packing.make_plan(hist, 4096)
    used, place = np.zeros(total, int), {}
    for length, first, count, sequence, offset in ranges:
        assert place.get(length, 0) == first
        place[length] = first + count
        used[sequence : sequence + count] += length
    assert (np.bincount(list(place), weights=list(place.values()), minlength=4097) == hist).all() and used.max() <= 4096 and used.sum() == lengths.sum()
    halves = int((lengths > 2048).sum())
    assert total <= 1.02 * max(-(-lengths.sum() // 4096), halves) + 1


def test_nnls_is_optimal():
    rng = np.random.default_rng(4)
    a, b = rng.random((12, 30)), rng.random(12)
    x = best_fit_packing.nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and (slope <= 1e-6).all() and np.abs(slope[x > 0]).max() < 1e-6


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_separator_scan(spark, block, monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 3)
    rng, rows, want = np.random.default_rng(block), [], []
    for f in range(4):
        ids = rng.integers(0, 5, rng.integers(0, 60)).astype("<u2")
        ids = np.append(ids, [0]).astype("<u2") if f == 3 else ids
        rows += [(f"f{f}", k, bytearray(ids[lo : lo + block].tobytes())) for k, lo in enumerate(range(0, max(1, len(ids)), block))]
        start = n = 0
        for p in np.flatnonzero(ids == 0):
            want.append((f"f{f}", n, start, int(p) - start))
            start, n = int(p) + 1, n + 1
        if start < len(ids):
            want.append((f"f{f}", n, start, len(ids) - start))
    got = token_counts.scan(spark.createDataFrame(rows, "file string, block long, data binary"), end=0).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    ids = np.array([5, 6, 9, 9, 7, 9, 8], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    for opened in (token_counts._opened, lambda uri: None):  # by ranges, and as Spark reads them
        monkeypatch.setattr(token_counts, "_opened", opened)
        got = token_counts.scan(token_counts.blocks_of_files(spark, str(tmp_path), block=2), end=9).collect()
        assert sorted(r.n_tokens for r in got) == [0, 1, 1, 2]
        assert {(r.file.rsplit("/")[-1], r.document, r.start) for r in got} == {("a.bin", 0, 0), ("a.bin", 1, 3), ("a.bin", 2, 4), ("a.bin", 3, 6)}
        (tmp_path / "c.odd").write_bytes(b"abc")
        with pytest.raises(Exception, match="whole number"):
            token_counts.blocks_of_files(spark, str(tmp_path)).collect()
        (tmp_path / "c.odd").unlink()


def test_token_counts_without_files(spark, monkeypatch):
    rows = corpus(7)
    want = sorted((repr(r.doc_id), r.n_tokens) for r in token_counts.count(documents(spark, rows)).collect())
    made = token_counts.write_tokens(documents(spark, rows))
    assert made.where("data is not null").count() == 0 and made.agg(F.sum("size")).first()[0] == 2 * (len(rows) + sum(n for _, n in want))
    monkeypatch.setattr(token_counts, "_opened", lambda uri: None)
    assert sorted((repr(r.doc_id), r.n_tokens) for r in token_counts.count(documents(spark, rows)).collect()) == want


def test_token_counts(spark):
    plain = Tokenizer.from_file(public_tokenizers.path(WORD_TOKENIZER))
    plain.encode_special_tokens = True
    rows = corpus(6) + [(2000, "a<|endoftext|>b", None, None)]
    got = token_counts.count(documents(spark, rows)).collect()
    want = [(i, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in rows]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(want, key=repr)
    assert token_counts.count(documents(spark, []).where("false")).count() == 0


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    w = {s: weights[k % 3] for k, s in enumerate(sizes)}
    target, full, left = {}, set(), 1.5 * sum(sizes.values())
    while True:
        total = sum(w[s] for s in sizes if s not in full)
        target |= {s: left * w[s] / total for s in sizes if s not in full}
        over = {s for s in sizes if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        full |= over
        if full == set(sizes):
            return target


def test_mixing(spark):
    rows = [r for seed in (7, 8, 9) for r in ((None if i is None else i + seed * 10_000, t, l, s) for i, t, l, s in corpus(seed))]
    rows += [(9, "x " * 9, None, "\U0001f600"), (10, "y", None, "\uffee"), (11, " ", None, "z")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, *_ in rows if i is not None and i % 3 == 0] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = source_mixing.mix(documents(spark, rows), labels).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = {s: sum(size(t) for _, t, _, x in rows if x == s) for s in names}
    want = brute_targets(sizes)
    assert sorted(r.size for r in got) == sorted(size(t) for _, t, _, _ in rows)
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1 and all(0 <= r.taken <= 2 * r.size for r in mine)
    again = source_mixing.mix(documents(spark, rows).repartition(5), labels).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert source_mixing.mix(documents(spark, []).where("false"), labels).count() == 0


def test_mixing_prefers_quality(spark):
    rows = [(i, "w " * 10, None, "a" if i < 1000 else "b") for i in range(4000)]
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    got = source_mixing.mix(documents(spark, rows), labels).where("source = 'b'").groupBy((F.col("doc_id") % 2).alias("q")).agg(F.sum("taken").alias("n")).collect()
    more = {r.q: r.n - 15_000 for r in got}  # beyond one whole pass
    assert sum(more.values()) == 10_000 and more[1] > 2 * more[0] > 0


# ---------------------------------------------------------------- search


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), rng.normal(size=16).astype(np.float32).tolist()) for i in rng.permutation(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(500, None), (550, []), (600, [float("inf")] * 16), (650, [None] * 16), (700, [0.0] * 16), (750, [1.0, 2.0]), (801, [3.0, -1.0]), rows[0], (None, rows[1][1]), (50, rows[2][1])]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id long, embedding array<float>, rank int, score string")
    able = {(i, tuple(x)) for i, x in rows if i is not None and x and all(c is not None and np.isfinite(c) for c in x)}
    codes = [(i, np.floor(256 * np.array(x, float)).astype(int)) for i, x in able]
    want = []
    for q, a in codes:
        if q % 50 == 0:
            want += [(q, i, int(a @ b)) for i, b in codes if i != q and len(a) == len(b)]
    best = []
    for q in {q for q, *_ in want}:
        mine = sorted((-s, i) for p, i, s in want if p == q)[:5]
        best += [(q, k + 1, i, -s) for k, (s, i) in enumerate(mine)]
    assert sorted(tuple(r) for r in topk_search.search(df).collect()) == sorted(best)
    assert topk_search.search(df.where("false")).count() == 0


def test_bit_sliced_sums_are_exact():
    rng = np.random.default_rng(9)
    codes = rng.integers(-300, 300, (131, 9))
    index = topk_search.BitSlicedIndex(codes, dropped=0)
    for _ in range(20):
        w = rng.integers(-300, 300, 9)
        total = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:131].astype(np.int64) << i for i, s in enumerate(index.sums(w)))
        high = (1 << index.bits) - 1
        assert (total + sum(w[d] * index.low[d] if w[d] >= 0 else w[d] * (index.low[d] + high) for d in range(9)) == codes @ w).all()
