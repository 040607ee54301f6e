r"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

DataFrame functions only. Each document draws an exponential key, scaled by its quality
weight (-ln(u) / w, with u from the MD5 of its id and text: reruns agree); in the order of its keys a
source is a weighted sample without replacement of any size. A source's target is first
met with whole passes over the source (epochs); the rest is the front of that order, cut
where its prefix sum reaches the budget.

The prefix sum runs in two levels: a monotone bucket of the key, then the keys within a
bucket. Sums of buckets are made before the shuffle, so a source with a third of all rows
is spread over as many tasks as there are buckets and never sorted in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

#: Weights of the sources in order, repeating; what they share, as a part of all sizes; most passes over a source.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2
#: Quality weights of documents labelled good, bad and not at all.
GOOD, BAD, UNKNOWN = 2.0, 0.5, 1.0
#: Buckets of keys within a source, at least; four for each shuffle partition where that is more.
BUCKETS = 256


def word_count(text: Column) -> Column:
    """Number of words; possessive, so that a very long word is read once."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target from a table source, source_size.

    The limit of resharing is the water level v at which the sum of min(epochs * size,
    v * weight) is the total to share: in order of epochs * size / weight, sources are full
    while the level that would result without them still exceeds their own. The table has
    one row for each source; its windows need no partitions.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    most = F.col("source_size").cast("double") * epochs
    t = sizes.withColumn("total", total).withColumn("weight", weight).withColumn("most", most).withColumn("ratio", F.col("most") / F.col("weight"))
    before = F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.col("total") - F.coalesce(before, F.lit(0.0))) / left)
    t = t.withColumn("full", F.col("level") >= F.col("ratio"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("ratio"), F.col("level")))).over(Window.partitionBy())["level"]
    t = t.withColumn("level", level)
    return t.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight"))).alias("target"))


def sampled(docs: DataFrame, seed: int, weights: tuple[float, ...], share: float, epochs: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, copies (and what is carried), for each row of doc_id, source, size, drawn, quality_weight."""
    buckets = max(BUCKETS, 4 * C.partitions(docs.sparkSession))
    # u in (0, 1) from 52 bits of the hash; the key's bucket is monotone in the key.
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "drawn")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    keyed = docs.withColumn("key", -F.log(u) / F.col("quality_weight"))
    base = C.written(keyed.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * buckets).cast("int")).drop("quality_weight", "drawn"))
    in_bucket = C.written(base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    goal = targets(in_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, epochs)
    upto = in_bucket.select("source", "bucket", (F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")).alias("bucket_before"))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(epochs), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    plan = upto.join(goal, upto["source"].eqNullSafe(goal["source"])).select(
        upto["source"].alias("s"), F.col("bucket").alias("b"), "bucket_before", "source_size", "target", whole.alias("epochs"),
        F.greatest(F.lit(0.0), F.round(F.col("target") - whole * F.col("source_size"), 6)).alias("rest"),
    )
    # Running size within the bucket, then what the buckets before it hold.
    run = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1))
    ordered = base.withColumn("run", F.coalesce(run, F.lit(0)))
    joined = ordered.join(plan, ordered["source"].eqNullSafe(plan["s"]) & (ordered["bucket"] == plan["b"]))
    part = F.greatest(F.lit(0.0), F.least(F.col("size").cast("double"), F.col("rest") - F.col("bucket_before") - F.col("run")))
    more = F.round(part).cast("long")
    taken = F.least(F.col("epochs") * F.col("size") + more, F.lit(epochs) * F.col("size"))
    copies = F.least(F.lit(epochs), F.col("epochs") + F.when(F.col("size") > 0, (part * 2 >= F.col("size")).cast("long")).otherwise(0))
    return joined.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), copies.cast("int").alias("copies"), *carry)


def label_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with quality_weight from labels (doc_id, quality); a document with several labels takes the best."""
    best = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_q"))
    weight = F.when(F.col("_q") >= 1, GOOD).when(F.col("_q") < 1, BAD).otherwise(UNKNOWN)
    return docs.join(best, docs["doc_id"] == best["_id"], "left").withColumn("quality_weight", weight).drop("_id", "_q")


def mix(docs: DataFrame, labels: DataFrame, text: str = "text", source: str = "source", seed: int = 20240, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (and source, copies, columns to carry) for each row.

    size counts the words of the whole text (null: 0). Sources stand in order of code
    points, null last; an empty string is a source like any other. taken is the number of
    words that the mix takes, repeats counted: passes * size, and for the front of the
    sampling order once more, the document at the cut in part. A source of size 0 has
    target 0. Each row is a document of its own; rows that repeat a doc_id, or have none,
    draw by their texts, and only rows equal in both draw the same key. An empty table gives
    an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("drawn"), *carry)
    return sampled(label_weights(slim, labels), seed, weights, share, epochs, carry)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all of ``documents``."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB's form of the query: each source in the order of its keys, cut where the running size meets the rest of the target.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    (('0x' || substr(md5('20240:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), l AS (
  SELECT doc_id AS i, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), k AS (
  SELECT d.*, -ln(u) / CASE WHEN q >= 1 THEN 2.0 WHEN q < 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS key FROM d LEFT JOIN l ON i = doc_id
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s
), v AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), t AS (
  SELECT source, source_size, CASE WHEN level >= ratio THEN most ELSE least(most, arg_min(CASE WHEN level < ratio THEN level END, CASE WHEN level < ratio THEN ratio END) OVER () * weight) END AS target FROM v
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size))::BIGINT ELSE 0 END AS epochs FROM t
), o AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, greatest(0, round(p.target - p.epochs * p.source_size, 6)) AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, least(epochs * size + round(greatest(0, least(size, rest - run)))::BIGINT, 2 * size)::BIGINT AS taken FROM o
"""
