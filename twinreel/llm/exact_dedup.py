"""Exact dedup: one row stays of all rows with byte-identical text.

Shuffles only hashes of the whole corpus. Texts move only of rows whose 128-bit hash occurs more
than once; they are combined in each task before they move, so a text that a third of all rows
share costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marked, salted_join, stored


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stay: str = "max", hash_bytes: int = 16, full_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_repeats for each row of docs.

    stay: which id of a group stays, "max" or "min" (the smallest stable id).
    A null text is the empty text. A null id orders below every id for "max" and above every id
    for "min"; a group of null ids only keeps one of them (keep_id null). Rows that repeat id
    and text count in group_size, and one of them is kept. Other columns are not read.
    Method: group by 128 bits of a content hash; inside the groups of more than one row bytes are
    compared: texts are classes under (hash, text). The whole hash tells a slim row its class;
    where two classes of a group share even that, its rows are dealt out by text instead.
    hash_bytes and full_bytes shorten the hashes, for tests of such collisions.
    """
    best = {"max": F.max, "min": F.min}[stay]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    whole = F.unhex(F.sha2("t", 256))
    hashed = base.withColumn("sha", whole).withColumn("h", F.substring("sha", 1, hash_bytes)).withColumn("full", F.substring("sha", 1, full_bytes))
    rows = hashed.groupBy("doc_id", "sha", "h", "full").agg(F.count("*").alias("copies"))
    repeated = stored(rows.groupBy("h").agg(F.sum("copies").alias("n")).filter("n > 1").select("h"), "exact-groups")
    # of rows that the bitmap lets through in error each is a class of one: that changes nothing
    of_text = marked(hashed, repeated, "h").groupBy("h", "t").agg(F.count("*").alias("n"), best("doc_id").alias("keep"), F.max("full").alias("full"))
    classes = stored(of_text.select("h", "full", "n", "keep"), "exact-classes")
    unclear = classes.groupBy("h", "full").agg(F.count("*").alias("texts")).filter("texts > 1").select("h", "full")
    unclear = stored(unclear, "exact-unclear")
    if unclear.limit(1).count():
        doubtful = hashed.join(unclear, ["h", "full"], "left_semi")
        own = doubtful.groupBy("h", "t").agg(F.count("*").alias("n"), best("doc_id").alias("keep"))
        by_text = doubtful.groupBy("doc_id", "sha", "h", "t").agg(F.count("*").alias("copies")).join(own, ["h", "t"]).select("doc_id", "sha", "copies", "n", "keep")
        rows, classes = (x.join(unclear, ["h", "full"], "left_anti") for x in (rows, classes))
    out = salted_join(rows, classes.withColumn("grouped", F.lit(True)), ["h", "full"], "n", ["doc_id"], "left").select(
        "doc_id", "sha", "copies", F.coalesce("n", F.lit(1)).alias("n"), F.when(F.col("grouped"), F.col("keep")).otherwise(F.col("doc_id")).alias("keep")
    )
    if unclear.limit(1).count():
        out = out.unionByName(by_text)
    return (
        out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(
            "doc_id",
            F.col("keep").alias("keep_id"),
            F.col("n").cast("long").alias("group_size"),
            ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep"))).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
            F.col("copies").alias("n_repeats"),
        )
    )


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256,
       count(*) OVER (PARTITION BY doc_id, coalesce(text, '')) AS n_repeats
FROM documents
"""
