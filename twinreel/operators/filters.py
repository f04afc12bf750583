"""Predicates over catalog entries and result rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..settings import MANUALLY_EXCLUDED, METADATA_ERROR, REPARSE_POINT, THUMBNAIL_ERROR, TOO_DARK, Settings

_any = lambda conditions: reduce(lambda a, b: a | b, conditions, F.lit(False))


def in_black_list(folder: Column, entries: tuple[str, ...]) -> Column:
    """A folder entry covers itself and what is below; a pattern without a separator any path
    segment; one with a separator the whole folder. Letters in any case."""
    tests, low = [], F.lower(folder)
    for entry in entries:
        if "*" in entry or "?" in entry:
            tests.append(S.glob(folder, entry) if "/" in entry else F.exists(F.split(folder, "/"), lambda s, e=entry: S.glob(s, e)))
        else:
            plain = entry.rstrip("/").lower()
            tests.append((low == plain) | low.startswith(plain + "/"))
    return _any(tests)


def in_include_list(folder: Column, entries: tuple[str, ...], below: bool = True) -> Column:
    """Below an entry (case counts); what starts with a dot directly below it is left out."""
    tests = []
    for entry in entries:
        root = entry.rstrip("/")
        inside = folder.startswith(root + "/") & ~folder.startswith(root + "/.")
        tests.append((folder == root) | inside if below else folder == root)
    return _any(tests)


def entry_reason(s: Settings, path: Column, folder: Column, is_image: Column, flags: Column, size: Column, exists: Column) -> Column:
    """Why an entry takes no part: the first reason in order, null for a valid entry."""
    rules: list[tuple[Column, str]] = []
    if not s.include_images:
        rules.append((is_image, "images_disabled"))
    if s.black_list:
        rules.append((in_black_list(folder, s.black_list), "black_list"))
    if not s.scan_entire_catalog and s.include_list:
        rules.append((~in_include_list(folder, s.include_list, s.include_subdirectories), "not_included"))
    rules += [
        (flags.bitwiseAND(F.lit(MANUALLY_EXCLUDED)) != 0, "manually_excluded"),
        (flags.bitwiseAND(F.lit(TOO_DARK)) != 0, "too_dark"),
    ]
    if not s.include_missing:
        rules.append((~exists, "missing"))
    rules.append((~F.is_valid_utf8(path), "path_encoding"))
    if s.size_filter:
        mb = S.whole_megabytes(size)
        rules.append(((mb < s.min_size_mb) | (mb > s.max_size_mb), "size"))
    if s.path_contains:
        rules.append((~_any(S.glob(path, p) for p in s.path_contains), "path_contains"))
    if s.ignore_reparse_points:
        rules.append((flags.bitwiseAND(F.lit(REPARSE_POINT)) != 0, "reparse_point"))
    if s.path_not_contains:
        rules.append((_any(S.glob(path, p) for p in s.path_not_contains), "path_not_contains"))
    out = F.when(*((rules[0][0], F.lit(rules[0][1]))))
    for test, name in rules[1:]:
        out = out.when(test, name)
    return out


def comparable(flags: Column, has_media: Column, is_image: Column, frames: Column, wanted: int) -> Column:
    """Has media data, no failed sampling, and enough frames (an image needs none)."""
    return has_media & (flags.bitwiseAND(F.lit(THUMBNAIL_ERROR)) == 0) & (is_image | (frames >= wanted))


def cleaned_catalog(catalog: DataFrame, listing: DataFrame) -> DataFrame:
    """Without missing files and failed entries; dark ones stay."""
    alive = catalog.join(listing.select("path").distinct(), "path", "left_semi")
    return alive.filter(F.col("flags").bitwiseAND(F.lit(METADATA_ERROR | THUMBNAIL_ERROR)) == 0)


def reason_counts(entries: DataFrame, samples: int = 5) -> DataFrame:
    """reason, n and the first `samples` paths of each reason."""
    order = Window.partitionBy("reason").orderBy("path")
    top = entries.filter("reason IS NOT NULL").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= samples)
    few = top.groupBy("reason").agg(F.array_sort(F.collect_list("path")).alias("samples"))
    return entries.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")).join(few, "reason")


def groups_with_hit(rows: DataFrame, hit: Column, group: str = "group_id") -> DataFrame:
    """All rows of the groups in which any row is hit (a semi-join on the group)."""
    return rows.join(rows.filter(hit).select(group).distinct(), group, "left_semi")


def result_filter(rows: DataFrame, needle: str | None, images: bool | None, low: float, high: float, only_checked: bool) -> DataFrame:
    """Rows of groups that a path text hits, of one type, in a range of similarity, of checked groups."""
    whole, out = rows, rows.filter(F.col("similarity").between(low, high))
    in_groups = lambda df, hit: df.join(whole.filter(hit).select("group_id").distinct(), "group_id", "left_semi")
    if needle:
        out = in_groups(out, S.path_matches(F.col("path"), needle))
    if images is not None:
        out = out.filter(F.col("is_image") == images)
    return in_groups(out, F.col("checked")) if only_checked else out


def custom_filter(rows: DataFrame, min_mb: int, max_mb: int, contains: list[str], lacks: list[str], low: float, high: float, skip_checked: bool) -> DataFrame:
    """All patterns of `contains`, none of `lacks`, size and similarity in range."""
    mb = S.whole_megabytes(F.col("size"))
    keep = mb.between(min_mb, max_mb) & F.col("similarity").between(low, high) & ~_any(S.glob(F.col("path"), p) for p in lacks)
    for p in contains:
        keep = keep & S.glob(F.col("path"), p)
    if skip_checked:
        rows = rows.join(rows.filter("checked").select("group_id").distinct(), "group_id", "left_anti")
    return rows.filter(keep)


def allowed_expression(df: DataFrame, text: str) -> Column:
    """A user's predicate over the columns of df, made a Column; other names and subqueries fail."""
    import re

    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    if re.search(r"\b(select|from|java_method|reflect|try_reflect)\b|;", bare, re.I):
        raise ValueError("only an expression over the row is allowed")
    column = F.expr(text)
    if df.select(column.alias("x")).schema["x"].dataType.typeName() != "boolean":
        raise ValueError("the expression must be true or false")
    return column


def check_by_expression(rows: DataFrame, text: str, spare_whole_groups: bool = True) -> DataFrame:
    """checked where the expression holds; a group in which it holds everywhere keeps its first row."""
    hit = F.coalesce(allowed_expression(rows, text), F.lit(False))
    group = Window.partitionBy("group_id")
    first = F.row_number().over(group.orderBy("pos")) == 1
    whole = F.bool_and(F.col("hit")).over(group)
    out = rows.withColumn("hit", hit)
    return out.withColumn("checked", F.col("hit") & ~(whole & first & F.lit(spare_whole_groups))).drop("hit")
