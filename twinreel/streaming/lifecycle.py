"""Running comparisons: cancelling, progress, saved presets, and import of saved results."""

from __future__ import annotations

import json
import time
import zipfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters, ranking
from ..sources import tables


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs started inside carry the tag: cancel(spark, tag) from another thread ends them."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str | None = None) -> None:
    """End the jobs of a tag, or all."""
    if tag:
        spark.sparkContext.cancelJobsWithTag(tag)
    else:
        spark.sparkContext.cancelAllJobs()


class Progress:
    """Hands on reports of (stage, done, total) at most every `least` seconds, and the last one."""

    def __init__(self, report, least: float = 0.3, clock=time.monotonic):
        self.report, self.least, self.clock, self.last = report, least, clock, None

    def __call__(self, stage: str, done: int, total: int) -> bool:
        now = self.clock()
        due = self.last is None or now - self.last >= self.least or done >= total
        if due:
            self.last = now
            self.report(stage, done, total)
        return due


def spark_progress(spark: SparkSession, report: Progress) -> None:
    """Report the tasks of the stages that run now."""
    tracker = spark.sparkContext.statusTracker()
    for stage in tracker.getActiveStageIds():
        if info := tracker.getStageInfo(stage):
            report(info.name, info.numCompletedTasks, info.numTasks)


def preset_filter(rows: DataFrame, preset: str) -> DataFrame:
    """rows with checked after a saved selection (JSON): filter, identity mode and date order.

    Names: fileType (0 all, 1 videos, 2 images), minMb, maxMb, contains, lacks, from, to,
    skipChecked, identical, dates, expression (of the rows; replaces the rest).
    """
    p = json.loads(preset)
    if p.get("expression"):
        return filters.check_by_expression(rows, p["expression"])
    found = filters.custom_filter(
        rows, p.get("minMb", 0), p.get("maxMb", 1 << 40), p.get("contains", []), p.get("lacks", []), p.get("from", 0), p.get("to", 100), p.get("skipChecked", False)
    )
    if kind := p.get("fileType", 0):
        found = found.filter("NOT is_image" if kind == 1 else "is_image")
    picked = ranking.custom_selection(found, p.get("identical", 0), p.get("dates", 0)).select("group_id", "pos", F.col("checked").alias("picked_"))
    return rows.join(picked, ["group_id", "pos"], "left").withColumn("checked", F.coalesce("picked_", "checked")).drop("picked_")


def expression_help(rows: DataFrame) -> list[tuple[str, str]]:
    """Names and types that an expression over rows may use."""
    return [(f.name, f.dataType.simpleString()) for f in rows.schema.fields]


def key_of(text: Column) -> Column:
    """The name under which a text's data are stored: xxHash64 (seed 0) of its UTF-16 form, as hex."""

    @F.pandas_udf("string")
    def hashed(values):
        import xxhash

        return values.map(lambda v: None if v is None else f"{xxhash.xxh64_intdigest(v.encode('utf-16-le')):016x}")

    return hashed(text)


def imported_results(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Rows of a saved result file: a JSON document, or an archive with one named scan.json.

    The archive is a user's file on the driver; only that member is read, whatever names others
    have. Null items are dropped.
    """
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as archive:
            text = archive.read("scan.json").decode("utf-8-sig")
    else:
        text = open(path, encoding="utf-8-sig").read()
    return tables.result_items(spark.createDataFrame([(text,)], "value string"), item)
