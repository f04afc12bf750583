"""A corpus pipeline of five stages over `documents`.

Stages read doc_id, text, source and lang; other columns pass through all but the last untouched,
whatever their names: helper columns take names that the table does not have.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written and read again as the next one's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinreel.llm import exact_dedup, mixing, ngram_join, piece_codec, toxicity
from twinreel.llm.common import free_names, read, settled, stored, without
from twinreel.llm.entry import piece_model

#: Near duplicates: shingles of five words, similarity 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


#: Encoded units that a worker remembers, in each of two halves, and words that are scored: stages
#: share an executor's memory.
UNITS, WORDS = 150_000, 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; rows without an id are judged as well.

    Null and empty texts are judged as empty ones and stay; long ones are judged whole.
    """
    return toxicity.toxicity_filter(docs, docs, read(spark, sf_dir, "labels"), memory=WORDS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the smallest id stays; of rows that repeat id and text, one
    (any of them, with its own other columns). A null text is an empty one."""
    (key,) = free_names(docs.columns, "tw_key")
    columns = ["doc_id", "text_sha256", "kept", "n_repeats"]
    verdicts = settled(spark, lambda: exact_dedup.exact_dedup(docs, stay="min").select(columns), "pipeline-exact")
    place = lambda i, sha: F.concat(F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), sha)
    of = verdicts.withColumn(key, place(F.col("doc_id"), F.col("text_sha256")))
    keyed = docs.withColumn(key, place(F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    # a repeated row that stays is kept once and dropped once: its key is not gone
    gone = stored(of.groupBy(key).agg(F.max("kept").alias("kept")).filter("NOT kept").select(key), "pipeline-gone")
    left = without(keyed, gone, key)
    again = stored(of.filter("kept AND n_repeats > 1").select(key).distinct(), "pipeline-again")
    if again.limit(1).count():
        once = without(left, again, key)
        left = once.union(left.join(again, key, "left_semi").dropDuplicates([key]).select(left.columns))
    return left.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest id (null last).

    Rows are grouped by a number of their own, so rows that repeat an id or have none are judged
    each by its own text. Rows without words link with nothing and stay.
    """
    (row,) = free_names(docs.columns, "tw_row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    groups = ngram_join.ngram_join(numbered, NEAR_WORDS, NEAR_PERCENT, id_col=row)
    later = groups.filter("component_id < doc_id").select(F.col("doc_id").alias("row"), "component_id")
    members = stored(later.union(later.select("component_id", "component_id").distinct()), "pipeline-members")
    named = members.join(numbered.select(F.col(row).alias("row"), "doc_id"), "row")
    best = named.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "row")).alias("best"))
    gone = members.join(best.select(F.col("best.row").alias("row")), "row", "left_anti").select(F.col("row").alias(row))
    return without(numbered, stored(gone, "pipeline-near"), row).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it does not take go.

    Documents without words are taken no words of and go too. Repetitions of a row are equal in
    all columns.
    """
    row, mixed_row, times, turn = free_names(docs.columns, "tw_row", "tw_mixed", "tw_times", "tw_turn")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    often = (F.col("taken") / F.col("size")).cast("int").alias(times)
    mixed = lambda: mixing.mix(numbered, row_col=row).filter("taken > 0").select(F.col(row).alias(mixed_row), often)
    found = settled(spark, mixed, "pipeline-mix")
    joined = numbered.join(found.hint("merge"), F.col(row) == F.col(mixed_row))
    return joined.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each remaining document and repetition: its ids and what they decode to, as digests."""
    return piece_codec.encode_decode(docs, piece_model(), memory=UNITS, remember=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The toxicity model and the encoder cannot be said in SQL; tests hold run() to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-docs")
    return STAGES[-1][1](spark, docs, sf_dir)
