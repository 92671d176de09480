"""Mixing sources to target weights by capped water-filling and seeded repetitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.llm.common import prepare, without, written


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def cycle_weights(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sizes (source, size, ...) with weight: the cycle dealt to the sources by code point, null last. One row a source."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), F.pmod(place, len(cycle)) + 1))


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """sources (source, size long, weight int) with target: the total of all sizes shared by weight, no source above
    max_epochs times its size, the excess reshared by weight among the others until none is above.

    Each round asks Spark for three sums; rows never come to the driver. Rounds are as many as the steps in which
    sources reach their cap.
    """
    cap = F.col("size") * max_epochs
    total = sources.agg(F.sum("size")).first()[0] or 0
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else cap < F.lit(level) * F.col("weight")
        n, fixed, weight = sources.agg(
            F.count_if(over),
            F.sum(F.when(over, cap).otherwise(0)),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))),
        ).first()
        if n == clamped or not weight:
            break
        clamped, level = n, (total - fixed) / weight
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    full = F.lit(float(level)) * F.col("weight")
    return sources.withColumn("target", F.when(cap < full, cap.cast("double")).otherwise(full))


def _order(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))


def plan_mix(docs: DataFrame, seed: int, max_epochs: int, cycle: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(sized: doc_id, source, size; plan: a row for each source with source_size, target, whole, last).

    Each document of a source is taken `whole` times, and once more if its place in the seeded order is not after
    `last`: the places up to the one whose middle word is still within the fraction that is left.
    """
    prepare(docs.sparkSession)
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"))
    plan = written(water_fill(written(cycle_weights(totals, cycle), "sources"), max_epochs), "targets")
    plan = plan.select(
        _source_key().alias("sk"),
        F.col("size").alias("source_size"),
        "target",
        F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long").alias("whole"),
    ).withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size"))
    # Places in two steps, so that no source is sorted in one task: sums by ranges of the order, then inside a range.
    digits = max(2, math.ceil(math.log(max(sized.count(), 1) / 4096 + 1, 16)))
    placed = sized.select(_source_key().alias("sk"), "doc_id", "size", _order(seed).alias("place"))
    placed = placed.withColumn("range", F.substring("place", 1, digits))
    before = W.partitionBy("sk").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = placed.groupBy("sk", "range").agg(F.sum("size").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = W.partitionBy("sk", "range").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    last = (
        placed.join(ranges.select("sk", "range", "start"), ["sk", "range"])
        .withColumn("passed", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(plan.select("sk", "quota"), "sk")
        .where((F.col("quota") > 0) & (2 * F.col("passed") + F.col("size") <= 2 * F.col("quota")))
        .groupBy("sk")
        .agg(F.max("place").alias("last"))
    )
    return sized, written(plan.join(last, "sk", "left").drop("quota"), "plan")


def _copies(df: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    more = F.coalesce(_order(seed) <= F.col("last"), F.lit(False)).cast("long")
    return df.withColumn("sk", _source_key()).join(plan, "sk").withColumn("copies", F.col("whole") + more)


def mix_sources(docs: DataFrame, seed: int = 7, max_epochs: int = 3, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """docs repeated as the mix takes them: each row 0 to max_epochs times, the columns unchanged.

    Sources by code point (null last, a source of its own) weigh 1, 2, 3, repeating. Null and empty texts have size 0
    and are repeated like others of their source, which at its cap are taken max_epochs times; a source without any word has a
    target of 0 and is not taken. Rows of one doc_id are taken alike; a null doc_id has a place as any
    other. Reruns agree. An empty table gives an empty table.
    """
    _, plan = plan_mix(docs, seed, max_epochs, cycle)
    row = docs.select(F.struct("*").alias("_row"), "doc_id", "source")
    out = _copies(row, plan, seed).where("copies > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select("_row.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sized, plan = plan_mix(docs, 7, 3, (1, 2, 3))
    out = _copies(sized, plan, 7)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w,
         source_size * 3 AS cap FROM sums),
ranked AS (
  SELECT *, sum(cap) OVER o AS caps, sum(w) OVER o AS ws, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w
  FROM weighed WINDOW o AS (ORDER BY cap / w, source ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT total::DOUBLE / all_w AS level FROM ranked
  UNION SELECT (total - caps)::DOUBLE / (all_w - ws) FROM ranked WHERE ws < all_w),
-- the level at which the shares, each cut at its cap, make up the whole
best AS (
  SELECT level FROM levels, weighed GROUP BY level
  ORDER BY abs(sum(least(cap, level * w)) - (SELECT sum(source_size) FROM sums)), level LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN cap < level * w THEN cap::DOUBLE ELSE level * w END AS target FROM weighed, best),
placed AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('7:' || s.doc_id), s.doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN 2 * passed + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
