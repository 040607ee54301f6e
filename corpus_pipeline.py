"""The corpus pipeline: language ID, near-dedup, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents: doc_id, text, lang, source, n_chars. Between stages rows are written
as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm import best_fit_packing, language_id, pii, shingle_dedup, source_mixing
from corvid.llm._common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose best language has a lower score are rejected, as are those without letters.
LEAST_SCORE = 0.3


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language stay; lang becomes it. Without any label there is nothing to judge by and all stay."""
    docs = _columns(docs)
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    if not model.languages:
        return docs
    known = language_id.predict(docs, model).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _columns(known.withColumn("lang", F.col("lang_pred")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays (nulls last; of rows that share it, the one with the smallest hash).

    Copies link at five-word shingles with a similarity of 0.8 or more, and by op5's fingerprints.
    """
    docs = _columns(docs).withColumn("row", F.xxhash64(*COLUMNS))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    keepers = written(shingle_dedup.cluster(docs).groupBy("component").agg(first).select(F.col("first.row").alias("row")))
    # Rows that are equal in all columns share a hash: one stays.
    kept = docs.join(keepers, "row", "left_semi").groupBy("row").agg(F.first(F.struct(*COLUMNS)).alias("kept"))
    return _columns(kept.select("kept.*"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows."""
    done = pii.redact(_columns(docs))
    return _columns(done.withColumn("n_chars", F.length("text").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them (0 to 2 times each); the one at a source's cut whole or not at all, whichever is nearer."""
    docs = _columns(docs).withColumn("row", F.xxhash64(*COLUMNS))
    # Rows that are equal in all columns share a hash: what they are taken together is taken of one.
    mixed = source_mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("row",)).groupBy("row").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    times = docs.join(mixed, "row").groupBy("row", "copies").agg(F.first(F.struct(*COLUMNS)).alias("kept"))
    return _columns(times.select("kept.*", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences (see op10)."""
    return best_fit_packing.pack(_columns(docs))


STAGES = [("language_id", keep_identified), ("near_dedup", keep_one_of_each), ("pii", redact), ("mixing", mix), ("packing", pack)]

#: Learned models, fingerprint components and token plans have no SQL form; tests hold every stage and the whole run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on sf_dir's documents, each on what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
