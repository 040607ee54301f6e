import re

import corpus_pipeline as P
from corvid.llm import simhash_dedup

from .helpers import documents

EN = "the house is on the hill and the people who live there are going to the market with their children this morning and every evening"
FR = "la maison est sur la colline et les gens qui y vivent vont au marché avec leurs enfants ce matin et tous les soirs de la semaine"


def rows():
    out = []
    for i in range(60):
        w = (EN if i % 2 else FR).split()
        k = (i * 5) % 11
        out.append((i, " ".join(w[k:] + w[:k] + [f"n{chr(97 + i % 26)}{chr(97 + i // 26)}"] * 2 + w[i % 7 :]), ("fr", "en")[i % 2], f"s{i % 3}"))
    return out + [(100, out[3][1], "en", "s0"), (101, "123 456 !!", "en", "s0"), (102, None, None, None), (103, out[4][1] + " a@b.co 4111 1111 1111 1111", "fr", "s1"), (104, "", None, "s1"), (3, out[3][1], "en", "s0")]


def test_stages(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark, rows())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    made = {}
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, str(tmp_path)))
        made[name] = docs
        if name != "packing":
            assert docs.columns == list(P.COLUMNS)
    ids = {n: [r.doc_id for r in df.select("doc_id").collect()] for n, df in made.items()}
    kept = {i for i, t, *_ in rows() if t and re.search("[a-z]", t)}
    assert set(ids["language_id"]) == kept and len(ids["language_id"]) == len(rows()) - 3
    cluster = {r.doc_id: r.component_id for r in simhash_dedup.cluster(made["language_id"]).collect()}
    assert sorted(ids["near_dedup"]) == sorted({c for c in cluster.values()})
    assert 100 not in ids["near_dedup"] and ids["near_dedup"].count(3) == 1
    texts = {r.doc_id: r for r in made["pii"].collect()}
    assert len(texts) == len(ids["near_dedup"]) and all("a@b.co" not in r.text and r.n_chars == len(r.text) for r in texts.values())
    assert set(ids["mixing"]) <= set(texts) and max(map(ids["mixing"].count, set(ids["mixing"]))) <= 2
    by_doc = sorted(r.doc_id for r in made["packing"].where("piece = 0").collect())
    assert by_doc == sorted(ids["mixing"])
    assert P.run(spark, str(tmp_path)).count() == made["packing"].count()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    documents(spark, rows()).where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
