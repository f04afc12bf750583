"""Catalog maintenance, ingest decisions and the state of results. All return new tables: sinks
decide what is rewritten."""

from __future__ import annotations

import os.path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..settings import AUDIO_ERROR, MANUALLY_EXCLUDED, METADATA_ERROR, NO_AUDIO_TRACK, SILENT_AUDIO, THUMBNAIL_ERROR, TOO_DARK, Settings

#: Version of the hashes of images; older ones are made again.
IMAGE_HASHES = 1


def missing_entries(catalog: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    """Entries whose file is gone. key: what tells files apart; where paths repeat, the entry's own
    number does."""
    there = listing.select(F.col(key).alias("there_")).distinct()
    return catalog.join(there, F.col(key).eqNullSafe(F.col("there_")), "left_anti")


def found_entries(catalog: DataFrame, wanted: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Catalog rows of the wanted paths (with ignore_case, in any case: one row for each)."""
    if not ignore_case:
        return catalog.join(wanted.select("path").distinct(), "path", "left_semi")
    return catalog.join(wanted.select(F.lower("path").alias("low_")).distinct(), F.lower("path") == F.col("low_"), "left_semi")


def without_entries(catalog: DataFrame, gone: DataFrame) -> DataFrame:
    """The catalog without the entries of the paths of `gone`."""
    return catalog.join(gone.select("path").distinct(), "path", "left_anti")


def cleared(catalog: DataFrame) -> DataFrame:
    return catalog.limit(0)


def clearing(catalog: DataFrame) -> DataFrame:
    """folder, entries, bytes: what cleared() takes away, so that it can be shown before it is done."""
    return catalog.groupBy("folder").agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def excluded(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    """The entries of these paths flagged as excluded by hand."""
    hit = paths.select("path", F.lit(True).alias("hit_")).distinct()
    flag = F.when(F.coalesce("hit_", F.lit(False)), K.with_flag(F.col("flags"), MANUALLY_EXCLUDED)).otherwise(F.col("flags"))
    return catalog.join(hit, "path", "left").withColumn("flags", flag).drop("hit_").select(catalog.columns)


def moved(catalog: DataFrame, moves: DataFrame) -> DataFrame:
    """The catalog after entries have moved (path, new_path): keyed by path, so an entry that had
    the new path before gives way to the one that moves there."""
    plan = moves.select("path", "new_path").filter("new_path IS NOT NULL AND path <> new_path").distinct()
    plan = plan.groupBy("path").agg(F.min("new_path").alias("new_path"))
    stays = catalog.join(plan.select(F.col("new_path").alias("path")), "path", "left_anti").unionByName(
        catalog.join(plan.select(F.col("new_path").alias("path")), "path", "left_semi").join(plan.select("path"), "path", "left_semi")
    )
    out = stays.join(plan, "path", "left").withColumn("path", F.coalesce("new_path", "path")).drop("new_path")
    return out.select(catalog.columns)


def moved_preview(catalog: DataFrame, old: str, new: str) -> DataFrame:
    """path, new_path of the entries below a folder that has moved."""
    from ..functions.scalars import relocated

    return catalog.filter(F.col("path").startswith(old)).select("path", relocated(F.col("path"), old, new).alias("new_path"))


def migrated_images(catalog: DataFrame, version: int, cached: list[str]) -> DataFrame:
    """Images of an older hash version lose what is cached of them and their too-dark flag."""
    if version >= IMAGE_HASHES:
        return catalog
    out = catalog
    for c in cached:
        out = out.withColumn(c, F.when(~F.col("is_image"), F.col(c)))
    return out.withColumn("flags", F.when(F.col("is_image"), K.with_flag(F.col("flags"), TOO_DARK, False)).otherwise(F.col("flags")))


def frame_version(frame: Column) -> Column:
    """2 for frames of 32 x 32, 1 for those of 16 x 16 (no hash can be made of them), else null."""
    return F.when(F.octet_length(frame) == 1024, 2).when(F.octet_length(frame) == 256, 1)


def unmarked(blacklist: DataFrame, entries: list[int]) -> DataFrame:
    """The blacklist without these entries."""
    return blacklist.filter(~F.col("entry_id").isin(entries))


def with_not_a_match(rows: DataFrame, blacklist: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """(rows without the group, blacklist with the group's paths as a new entry)."""
    entry = F.xxhash64(F.lit("group"), "group_id").alias("entry_id")
    marked = rows.filter(F.col("group_id") == group).select(entry, "path").distinct()
    return rows.filter(F.col("group_id") != group), blacklist.select("entry_id", "path").unionByName(marked)


def gather_plan(catalog: DataFrame, s: Settings, retry_failed: bool = False) -> DataFrame:
    """idx, action, missing, audio: what an ingest has still to do for each valid entry.

    Entries with a reason or a failed sampling are skipped; others lack nothing ("cached"), have
    no media facts yet ("probe"), or lack the frames of some positions ("sample"). missing:
    seconds whose frame is not in the cache; audio: whether a fingerprint has to be made.
    """
    failed = (F.col("flags").bitwiseAND(F.lit(THUMBNAIL_ERROR)) != 0) & F.lit(not retry_failed)
    at = [K.sample_second(F.col("duration"), p, s.max_sampling_s) for p in K.sample_positions(s.thumbnail_count)]
    wanted = F.when(F.col("is_image"), F.array(F.lit(0.0))).otherwise(F.array(*at))
    lacks = F.filter(wanted, lambda x: ~F.coalesce(F.array_contains("cached_seconds", x), F.lit(False)))
    no_audio = F.col("flags").bitwiseAND(F.lit(NO_AUDIO_TRACK | AUDIO_ERROR | SILENT_AUDIO)) != 0
    action = (
        F.when(F.col("reason").isNotNull(), F.concat(F.lit("skip: "), "reason")).when(failed, "skip: failed sampling")
        .when(~F.col("is_image") & ~F.col("has_media"), "probe").when(F.size(lacks) > 0, "sample").otherwise("cached")
    )
    goes = ~action.startswith("skip")
    audio = goes & F.lit(s.partial_clips) & ~F.col("is_image") & ~no_audio & ~F.col("has_fp")
    return catalog.select("idx", action.alias("action"), F.when(goes, lacks).otherwise(F.array().cast("array<double>")).alias("missing"), F.coalesce(audio, F.lit(False)).alias("audio"))


def sampled_flags(flags: Column, frames: Column, decoded: Column) -> Column:
    """Flags after sampling: a failure where nothing was decoded, too dark where all new frames are."""
    dark = (F.size(frames) > 0) & F.forall(frames, lambda x: ~K.is_bright(x))
    return F.when(~decoded, K.with_flag(flags, THUMBNAIL_ERROR)).when(dark, K.with_flag(flags, TOO_DARK)).otherwise(flags)


def probed_flags(flags: Column, facts: Column) -> Column:
    """Flags after probing: a metadata error where no facts were read."""
    return F.when(facts.isNull(), K.with_flag(flags, METADATA_ERROR)).otherwise(flags)


def needs_thumbnails(thumbnails: Column, width: Column, placeholder: Column, required: int) -> Column:
    """No thumbnail, only the placeholder, or extracted smaller than is now required."""
    none = thumbnails.isNull() | (F.size(thumbnails) == 0)
    only = (F.size(thumbnails) == 1) & F.coalesce(F.get(thumbnails, 0) == placeholder, F.lit(False))
    return F.coalesce(none | only | (F.lit(required > 0) & (width > 0) & (width < required)), F.lit(True))


def appended_blobs(store: DataFrame, new: DataFrame) -> DataFrame:
    """(key, data) of a store after appending what it lacks; empty data counts as lacking."""
    there = store.filter(F.octet_length("data") > 0)
    fresh = new.filter(F.octet_length("data") > 0).groupBy("key").agg(F.min("data").alias("data"))
    return there.unionByName(fresh.join(there.select("key"), "key", "left_anti"))


def missing_blobs(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Rows whose key has no data in the store."""
    return rows.join(store.filter(F.octet_length("data") > 0).select("key").distinct(), "key", "left_anti")


def with_thumbnails(rows: DataFrame, frames: DataFrame, positions: list[float], placeholder: Column) -> DataFrame:
    """rows (idx, duration) with thumbnails: frames (idx, second, frame) at the positions, failed
    ones left out, the placeholder where none is left."""
    asked = rows.select("idx", F.explode(F.array(*(F.col("duration") * F.lit(p) for p in positions))).alias("second"))
    got = asked.join(frames, ["idx", "second"]).groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("second", "frame"))).alias("x"))
    shots = F.coalesce(F.transform("x", lambda f: f["frame"]), F.array(placeholder))
    return rows.join(got, "idx", "left").withColumn("thumbnails", shots).withColumn("n_failed", len(positions) - F.coalesce(F.size("x"), F.lit(0))).drop("x")


def accounted(results: DataFrame) -> DataFrame:
    """done, failed, freed of a batch's results (ok, size); an unknown size frees nothing."""
    return results.agg(
        F.count_if(F.col("ok")).alias("done"), F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.greatest("size", F.lit(0)))), F.lit(0)).alias("freed"),
    )


def remaining_seconds(elapsed: Column, processed: Column, total: Column) -> Column:
    """Time left at the pace so far; null before anything is processed."""
    return F.try_divide(elapsed * (total - processed), processed)


def undone(states: DataFrame, changes: DataFrame, steps: int, history: int = 200) -> DataFrame:
    """(key, checked) after the last `steps` changes (step, key, old) are taken back; at most the
    last `history` steps can be. Of a key the oldest of the changes taken back counts."""
    last = changes.agg(F.max("step").alias("last"))
    back = changes.join(F.broadcast(last)).filter(F.col("step") > F.col("last") - min(steps, history))
    old = back.groupBy("key").agg(F.min_by("old", "step").alias("old"))
    return states.join(old, "key", "left").select("key", F.coalesce("old", "checked").alias("checked"))


def latest_lines(lines: DataFrame, n: int, part: str = "thread", order: str = "at") -> DataFrame:
    """The last n lines of each thread."""
    place = F.row_number().over(Window.partitionBy(part).orderBy(F.desc(order)))
    return lines.withColumn("r_", place).filter(F.col("r_") <= n).drop("r_")


def normalised_paths(paths: list[str]) -> list[str]:
    """Folders as absolute paths without a separator at the end, each once, in their order."""
    return list(dict.fromkeys(os.path.abspath(p.strip()) for p in paths if p and p.strip()))


def finished(rows: DataFrame, blacklist: DataFrame, criteria: list[str] | None = None) -> DataFrame:
    """Results when a comparison is done: blacklisted groups go, best members are marked, and a
    preset of criteria checks all but the best of each group."""
    from . import joins, ranking

    left = rows.join(joins.blacklisted_groups(rows, blacklist), "group_id", "left_anti")
    best = ranking.with_best_flags(ranking.without_singletons(ranking.dealt(left)))
    return ranking.check_lowest_quality(best, criteria) if criteria is not None else best
