"""Mixing sources to target weights by capped water-filling. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stored

#: Fixed values of the production mix.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of the sources (columns key, source_size) as columns weight, target.

    Water-filling in closed form: by rising cap/weight, the first sources are clamped at
    max_epochs times their size, and the level that the rest share by weight is the lowest
    prefix at which no source is above its cap. The input has a row for each source.
    """
    order = Window.orderBy("key")
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * max_epochs)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    levels = (
        ranked.withColumn("clamped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") - F.col("clamped")) / F.col("open_weight"))
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    first = F.min(F.when(fits.isNotNull(), F.struct(F.col("cap") / F.col("weight"), "key", "level")))
    return (
        levels.withColumn("fill", first.over(whole)["level"])
        .withColumn(
            "target",
            F.least(F.col("cap").cast("double"), F.coalesce(F.col("fill") * F.col("weight"), F.col("cap").cast("double"))),
        )
        .select("key", "source_size", "weight", "target")
    )


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    bucket_digits: int = 3,
    size: Column | None = None,
    row_col: str | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs(doc_id, text, source).

    Each source is taken floor(target / size) times whole; of the rest, whole documents are
    taken once more in the order of a seeded hash until the target is reached (a document
    counts as inside if its middle is), so a source misses its target by half a document at
    most. Sources are ordered by code point, null last, and get the weights in turn.
    A null text has size 0 and is never taken more than its repetitions of 0 words. Null ids
    and repeated rows are ordinary rows. Empty input gives no rows. A column row_col that numbers
    the rows is carried through.
    Hot sources: positions in a source are sums over hash buckets (16**bucket_digits a source)
    and then inside a bucket, so no task holds a whole source. The hash is of id and text, so rows
    of one id (or none) spread as well; rows that repeat both are one row until the end, when
    their copies take the places one after the other (with row_col each is a row of its own).
    """
    row = [row_col] if row_col else []
    base = docs.select(
        *row,
        F.col("doc_id").cast("long").alias("doc_id"),
        (size if size is not None else n_words(F.col("text"))).alias("size"),
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))).alias("key"),
        F.md5(
            F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
        ).alias("draw"),
    )
    if row_col:
        base = base.withColumn("n", F.lit(1).cast("long"))
    else:
        base = base.groupBy("doc_id", "size", "key", "draw").agg(F.count("*").alias("n"))
    base = stored(base.withColumn("bucket", F.substring("draw", 1, bucket_digits)), "mix-sizes")
    buckets = base.groupBy("key", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("bucket_size"))
    targets = source_targets(buckets.groupBy("key").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    ahead = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(
        buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
        .join(targets, "key")
        .select("key", "bucket", "start", "source_size", "target"),
        "mix-starts",
    )
    inside = Window.partitionBy("key", "bucket").orderBy("draw", "doc_id", "size", *row).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = base.withColumn("upto", F.sum(F.col("size") * F.col("n")).over(inside)).join(starts, ["key", "bucket"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    middle = F.col("start") + F.col("upto") - F.col("size") * (F.col("n") - F.col("copy")) - F.col("size") / 2
    return (
        placed.withColumn("times", F.floor(ratio))
        .withColumn("extra", middle < F.col("target") - F.col("times") * F.col("source_size"))
        .select(
            *row,
            "doc_id",
            "size",
            F.col("source_size").cast("long").alias("source_size"),
            F.col("target").cast("double").alias("target"),
            (F.col("size") * (F.col("times") + F.col("extra").cast("int"))).cast("long").alias("taken"),
        )
    )


SQL = r"""
WITH base AS (
  SELECT doc_id,
         len(list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda w: w <> ''))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS draw
  FROM documents),
src AS (SELECT key, sum(size)::BIGINT AS source_size FROM base GROUP BY key),
ranked AS (
  SELECT key, source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS cap FROM src),
levels AS (
  SELECT *, cap / weight AS r,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ranked),
fill AS (SELECT arg_min(level, (r, key)) AS fill FROM levels WHERE level * weight <= cap),
targets AS (
  SELECT key, source_size, least(cap::DOUBLE, coalesce(fill * weight, cap::DOUBLE)) AS target FROM levels, fill),
placed AS (
  SELECT b.*, source_size, target,
         sum(size) OVER (PARTITION BY key ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END)::BIGINT AS times
  FROM base b JOIN targets USING (key))
SELECT doc_id, size, source_size, target,
       (size * (times + (upto::DOUBLE - size / 2 < target - times * source_size)::INT))::BIGINT AS taken
FROM placed
"""
