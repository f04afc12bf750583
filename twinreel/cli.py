"""Commands: python -m twinreel.cli scan|compare|scan-and-compare|mark|db ... over catalogs in Parquet."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import compare, maintenance, ranking
from .settings import Settings
from .sources import sinks, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="twinreel", description="Find near-duplicate media in a catalog.")
    verbs = p.add_subparsers(dest="verb", required=True)
    for name in ("scan", "compare", "scan-and-compare"):
        v = verbs.add_parser(name)
        v.add_argument("--catalog", required=True, help="catalog table")
        v.add_argument("--settings", help="JSON file of settings")
        if name != "compare":
            v.add_argument("--include", action="append", required=True, help="folder to list; may be repeated")
            v.add_argument("--exclude", action="append", default=[])
        if name != "scan":
            v.add_argument("--output", required=True, help="table of duplicate rows")
    v = verbs.add_parser("mark")
    v.add_argument("--results", required=True, help="table of result rows")
    v.add_argument("--strategy", default="lowest_quality")
    v.add_argument("--output", required=True, help="table of the plan: nothing is done to files")
    v = verbs.add_parser("db").add_subparsers(dest="action", required=True)
    for name in ("clean", "clear", "export"):
        a = v.add_parser(name)
        a.add_argument("--catalog", required=True)
        if name == "clean":
            a.add_argument("--include", action="append", required=True)
        if name == "clear":
            a.add_argument("--yes", action="store_true")
        if name == "export":
            a.add_argument("--output", required=True)
            a.add_argument("--diagnostic", action="store_true", help="without paths: frames and hashes only")
    return p


def _listing(spark: SparkSession, s: Settings, folders: list[str], excluded: list[str]):
    rows = None
    for folder in maintenance.normalised_paths(folders):
        found = tables.listing(spark, folder, s.include_images, s.include_subdirectories, tuple(maintenance.normalised_paths(excluded)))
        rows = found if rows is None else rows.unionByName(found)
    return rows.dropDuplicates(["path"])


def run(argv: list[str], spark: SparkSession) -> int:
    """Run one command; 0 when it was done, 1 when there was nothing to do or no consent."""
    a = parser().parse_args(argv)
    text = open(a.settings, encoding="utf-8").read() if getattr(a, "settings", None) else None
    s = Settings.from_json(text)
    if a.verb in ("scan", "scan-and-compare"):
        files = _listing(spark, s, a.include, a.exclude)
        old = spark.read.parquet(a.catalog) if tables.exists(spark, a.catalog) else spark.createDataFrame([], files.schema)
        facts = ["folder", "file_size", "date_modified", "is_image"]
        cached = [c for c in old.columns if c not in ("path", *facts)]
        sinks.write_once(tables.upserted(old, files, "path", facts, cached).drop("change"), a.catalog)
    if a.verb in ("compare", "scan-and-compare"):
        catalog = spark.read.parquet(a.catalog)
        if "gray" not in catalog.columns:
            print("the catalog holds no frames yet: sample them first", file=sys.stderr)
            return 1
        sinks.write_once(compare.find_duplicates(catalog, s), a.output)
    if a.verb == "mark":
        strategy = S.strategy_name(a.strategy)
        if strategy is None:
            print(f"no strategy {a.strategy}; one of {', '.join(ranking.STRATEGIES)}", file=sys.stderr)
            return 1
        rows = ranking.with_best_flags(spark.read.parquet(a.results))
        gone = ranking.to_delete(rows, strategy).select("group_id", "pos", F.lit(True).alias("checked"))
        marked = rows.drop("checked").join(gone, ["group_id", "pos"], "left").withColumn("checked", F.coalesce("checked", F.lit(False)))
        sinks.write_once(sinks.action_plan(marked, "delete"), a.output)
    if a.verb == "db":
        catalog = spark.read.parquet(a.catalog)
        if not catalog.limit(1).count():
            return 0 if a.action == "clear" else 1
        if a.action == "clear":
            if not a.yes:
                return 1
            sinks.write_once(maintenance.cleared(catalog), a.catalog)
        if a.action == "clean":
            from .operators.filters import cleaned_catalog

            sinks.write_once(cleaned_catalog(catalog, _listing(spark, s, a.include, [])), a.catalog)
        if a.action == "export":
            out = sinks.diagnostic_export(catalog) if a.diagnostic else sinks.catalog_json(catalog).select("json")
            sinks.write_once(out, a.output, "json" if a.diagnostic else "text")
    return 0


def main() -> None:
    session = SparkSession.builder.appName("twinreel").getOrCreate()
    sys.exit(run(sys.argv[1:], session))


if __name__ == "__main__":
    main()
