"""Hand-made documents that hold what operators must bear: nulls, blanks, ties, repeats, clashing columns."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long, salt int, row string, block int, size long, rank int, key string, blob int"


def documents(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    data = [(i, t, l, s, None if t is None else len(t), 1, "r", 2, 3, 4, "k", 5) for i, t, l, s in rows]
    return spark.createDataFrame(data, DDL).repartition(3)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1, n=60):
    """Texts with exact copies, near copies, a common passage, odd white space, nulls and one long text."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 25))
    out = []
    for i in range(n):
        w = words(rng, rng.randrange(1, 120))
        t = " ".join(w)
        if i % 3 == 0:
            t = f"{t} {passage}\n{t[:20]}"
        if i % 7 == 0 and out:
            t = out[rng.randrange(len(out))][1] or ""
        if i % 11 == 0 and out and out[-1][1]:
            v = out[-1][1].split()
            v[rng.randrange(len(v))] = "changed"
            t = "\t ".join(v)
        out.append((i, t, ("en", "fr")[i % 2], f"s{i % 4}"))
    out += [(1000, None, None, None), (1001, "", "en", ""), (1002, " \t\n\x0b\x0c\r ", "en", "s1"), (1003, "ünï ☃ 😀\u00a0x", "fr", "s2"), (1004, " ".join(words(rng, 30_000)), "en", "s0"), (5, out[5][1], "en", "s0"), (None, passage, "fr", "s0")]
    return out
