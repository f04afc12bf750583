"""Whole comparisons: from a catalog to duplicate rows, visually and by parts of the sound.

A catalog row has idx (its place in the scan), path, folder, is_image, has_media, flags, duration,
file_size, dev, ino, gray (map of seconds -> frame bytes), phash and fp (32-bit blocks as longs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..settings import SILENT_AUDIO, Settings
from ..sources.tables import cut
from . import filters, grouping, joins, ranking, tiles


def snapshot(catalog: DataFrame, s: Settings) -> DataFrame:
    """Comparable entries with frames (one binary of all sampled positions) and phash.

    Images have the frame of second 0, videos that of each position; an entry that lacks one is
    left out.
    """
    at = [K.sample_second(F.col("duration"), p, s.max_sampling_s) for p in K.sample_positions(s.thumbnail_count)]
    gray = lambda second: F.try_element_at("gray", second)
    frames = F.when(F.col("is_image"), F.array(gray(F.lit(0.0)))).otherwise(F.array(*(gray(x) for x in at)))
    fits = filters.comparable(F.col("flags"), F.col("has_media"), F.col("is_image"), F.size(F.coalesce("gray", F.create_map())), s.thumbnail_count)
    out = catalog.filter(fits).withColumn("frames_", frames).filter(~F.exists("frames_", lambda x: x.isNull()))
    # concatenation of binaries as hexadecimal text: whole frames in their order
    whole = F.unhex(F.array_join(F.transform("frames_", lambda x: F.hex(x)), ""))
    return out.withColumn("n_frames", F.size("frames_")).withColumn("frames", whole).drop("frames_", "gray")


#: Stripes of rows of pixels whose mean brightness bounds the difference of frames from below.
STRIPES = 8
#: Rows under one candidate key that one tile holds; a key with more is split into tiles.
CROWDED = 2_000


def stripe_means(batches):
    """mapInArrow: (idx, n_frames, frames) -> idx, means: of each of STRIPES equal parts of the
    frames, in bytes. Mirrored frames have the same ones, as parts are of whole rows of pixels;
    where rows do not divide so, each part stands for the whole."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        out = []
        for n, f in zip(batch.column("n_frames").to_pylist(), batch.column("frames").to_pylist(), strict=True):
            x = np.frombuffer(f, np.uint8)
            whole = len(x) and n * int(round((len(x) / n) ** 0.5)) % STRIPES == 0
            out.append(x.reshape(STRIPES, -1).mean(axis=1).tolist() if whole else [float(x.mean())] * STRIPES if len(x) else None)
        yield pa.RecordBatch.from_arrays([batch.column("idx"), pa.array(out, pa.list_(pa.float64()))], ["idx", "means"])


def cells(s: Settings):
    """mapInArrow: (idx, n_frames, frames) -> idx, m_, c_: the cell of the mean of the frames' bytes, and of
    how far those of their halves are apart. Similar frames, mirrored or not, are in neighbouring
    cells of each; left-out pixels have no such bound, and all are in one cell."""
    masked, width = s.ignore_black_pixels or s.ignore_white_pixels, max(s.gray_limit * 1.000001, 1e-4) * 256

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for n, f in zip(batch.column("n_frames").to_pylist(), batch.column("frames").to_pylist(), strict=True):
                x = np.frombuffer(f, np.uint8)
                if masked or not len(x):
                    out.append((0, 0))
                    continue
                whole = n * int(round((len(x) / n) ** 0.5)) % STRIPES == 0
                upper, lower = x.reshape(2, -1).mean(axis=1) if whole else (x.mean(), x.mean())
                out.append((int(np.floor((upper + lower) / 2 / width)), int(np.floor((upper - lower) / 2 / width))))
            yield pa.RecordBatch.from_arrays([batch.column("idx"), *(pa.array([c[k] for c in out], pa.int64()) for k in (0, 1))], ["idx", "m_", "c_"])

    return run


def candidate_pairs(rows: DataFrame, s: Settings, within: str | None = None, gates: bool = True) -> DataFrame:
    """a, b, is_image, bits: pairs a < b that may be similar; bits for videos compared by hashes.

    Only ids and facts meet, no frames. Frames are points of a space with the mean difference of
    bytes as its metric, and no pair is farther apart there than its distances to a fixed frame
    are: all black, and black above and white below, give a grid of two dimensions, and the means
    of stripes a sum that bounds the difference once more. Videos in hash mode meet under a
    duration and one of as many parts of the hash as may differ, and one more; images keep the
    grid. Left-out pixels have no such bound: durations and folders alone deal those out. A
    crowded key is split into tiles, so that no task meets all of it.
    """
    apart = not (s.ignore_black_pixels or s.ignore_white_pixels)
    own, probes = joins.duration_buckets(s, F.col("duration"))
    image, zero = F.col("is_image"), F.lit(0).cast("long")
    hashed = ~image & F.lit(s.use_phash)
    facts = rows.withColumn("folder_key", joins.folder_key(F.col("folder"), s.folder_depth))
    if apart:
        means = rows.select(F.col("idx").cast("long").alias("idx"), "n_frames", "frames").mapInArrow(stripe_means, "idx long, means array<double>")
        facts = facts.drop("frames").join(means.withColumnRenamed("idx", "idx_"), F.col("idx") == F.col("idx_"), "left").drop("idx_")
        half = lambda at: F.aggregate(F.slice("means", at, STRIPES // 2), F.lit(0.0), lambda t, x: t + x) / (STRIPES // 2)
        cell = lambda x: F.floor(x / 256 / F.lit(max(s.gray_limit * 1.000001, 1e-4)))
        upper, lower = half(1), half(STRIPES // 2 + 1)
        spots = [F.when(hashed | F.col("means").isNull(), zero).otherwise(cell(x)) for x in ((upper + lower) / 2, (upper - lower) / 2)]
    else:
        facts, spots = facts.drop("frames").withColumn("means", F.lit(None).cast("array<double>")), [zero, zero]
    near = lambda x: F.when(hashed | F.col("means").isNull(), F.array(x)).otherwise(F.sequence(x - 1, x + 1))
    parts = s.phash_bits + 1
    ends = [round(64 * i / parts) for i in range(parts + 1)]
    piece = lambda h, i: F.shiftrightunsigned(h, ends[i]).bitwiseAND(F.lit((1 << (ends[i + 1] - ends[i])) - 1 if ends[i + 1] - ends[i] < 64 else -1))
    part = lambda i: F.struct(F.lit(i).alias("part"), piece(F.col("phash"), i).cast("long").alias("value"))
    # hashes without one, and rows compared by frames, have a single part
    pieces = F.when(hashed & F.col("phash").isNotNull(), F.array(*map(part, range(parts)))).otherwise(F.array(F.struct(F.lit(0).alias("part"), zero.alias("value"))))
    d_own = F.when(image | F.lit(not gates), zero).otherwise(own)
    d_probe = F.when(image | F.lit(not gates), F.array(zero)).otherwise(probes)
    facts = facts.filter(~hashed | F.col("phash").isNotNull()).withColumn("piece", F.explode(pieces))
    facts = cut(facts.select("*", spots[0].alias("m_"), spots[1].alias("c_"), F.col("piece.part").alias("p_"), F.col("piece.value").alias("v_")).drop("piece"))
    keys = ["is_image", "d_", "m_", "c_", "p_", "v_"] + ([within] if within else [])
    if gates and s.folder_match == "same":
        keys.append("folder_key")
    kept = ["idx", "duration", "file_size", "dev", "ino", "phash", "n_frames", "means"] + ["folder_key"] * ("folder_key" not in keys)
    side = lambda df, x: df.select(*keys, "tile", *(F.col(c).alias(f"{c}_{x}") for c in kept))
    b = facts.withColumn("d_", d_own)
    crowded = cut(b.groupBy(*keys).agg(F.ceil(F.count("*") / CROWDED).cast("int").alias("tiles")).filter("tiles > 1"))
    # nulls among the keys match nothing, here as in the join of both sides
    b = b.join(crowded, keys, "left").withColumn("tile", F.coalesce(F.pmod(F.xxhash64("idx"), F.col("tiles")), zero))
    a = facts.withColumn("d_", F.explode(d_probe)).withColumn("m_", F.explode(near(F.col("m_")))).withColumn("c_", F.explode(near(F.col("c_"))))
    a = a.join(crowded, keys, "left").withColumn("tile", F.explode(F.sequence(zero, F.coalesce("tiles", F.lit(1)).cast("long") - 1)))
    met = side(a, "a").join(side(b, "b"), [*keys, "tile"]).filter("idx_a < idx_b")
    if gates:
        close = F.abs(F.col("duration_a") - F.col("duration_b")) <= F.least(joins.tolerance(s, F.col("duration_a")), joins.tolerance(s, F.col("duration_b")))
        met = met.filter(image | close)
        if s.folder_match == "different":
            met = met.filter("folder_key_a <> folder_key_b")
        if s.exclude_hard_links:
            fact = lambda x: {"dev": F.col(f"dev_{x}"), "ino": F.col(f"ino_{x}"), "size": F.col(f"file_size_{x}"), "duration": F.when(~image, F.col(f"duration_{x}"))}
            met = met.filter(joins.not_hard_links(fact("a"), fact("b")))
    bits = F.when(hashed, K.hamming(F.col("phash_a"), F.col("phash_b")))
    first = F.lit(parts)
    for i in reversed(range(parts)):  # a pair counts at the first part that agrees
        first = F.when(piece(F.col("phash_a"), i) == piece(F.col("phash_b"), i), F.lit(i)).otherwise(first)
    total = F.aggregate(F.zip_with("means_a", "means_b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, x: t + x) / (STRIPES * 256)
    may = F.coalesce(total <= s.gray_limit * 1.000001 + 1e-9, F.lit(True)) & (F.col("n_frames_a") == F.col("n_frames_b"))
    met = met.withColumn("bits", bits).filter(F.when(hashed, (F.col("bits") <= s.phash_bits) & (F.col("p_") == first)).otherwise(may))
    return met.select(F.col("idx_a").cast("long").alias("a"), F.col("idx_b").cast("long").alias("b"), "is_image", "bits", F.col("n_frames_a").alias("n_frames"))


def similar_pairs(rows: DataFrame, s: Settings, within: str | None = None, gates: bool = True) -> DataFrame:
    """a, b, difference, flags: pairs a < b of snapshot rows that the similarity predicate holds for.

    Images meet images and videos videos, whose durations must be near; the folder gate and the
    hard-link test apply (not with gates=False, which compares what shares the column `within`).
    Frames are compared in tiles (see tiles), which meet by durations and cells of brightness; videos
    in hash mode meet under parts of their hashes (see candidate_pairs).
    """
    framed = rows.filter("is_image") if s.use_phash else rows
    own, probes = joins.duration_buckets(s, F.col("duration"))
    zero = F.lit(0).cast("long")
    still = F.col("is_image") | F.lit(not gates)
    spots = framed.select(F.col("idx").cast("long").alias("idx"), "n_frames", "frames").mapInArrow(cells(s), "idx long, m_ long, c_ long")
    framed = framed.withColumn("folder_key", joins.folder_key(F.col("folder"), s.folder_depth)).withColumn("idx", F.col("idx").cast("long")).join(spots, "idx")
    buckets = {"bucket": F.when(still, zero).otherwise(own), "low": F.when(still, zero).otherwise(F.array_min(probes)), "high": F.when(still, zero).otherwise(F.array_max(probes))}
    keys = ["is_image"] + ([within] if within else []) + ["folder_key"] * (gates and s.folder_match == "same")
    columns = ["n_frames", "frames", "m_", "c_", *buckets, *dict.fromkeys([*keys, *tiles.FACTS])]
    found = tiles.similar_in_tiles(framed.withColumns(buckets).withColumn("id", F.col("idx")).select("id", *columns), s, keys, gates)
    if s.use_phash:
        met = cut(candidate_pairs(rows.filter("NOT is_image"), s, within, gates))
        found = found.unionByName(met.select("a", "b", (F.col("bits") / 64).alias("difference"), F.lit(0).alias("flags")))
    return found


def find_duplicates(catalog: DataFrame, s: Settings) -> DataFrame:
    """group_id, idx, path, difference, similarity, flags: the duplicate rows of a catalog.

    Eligible entries become snapshots, similar pairs pass the gates, groups are formed and split
    as in grouping.duplicate_groups_near; representatives are compared without gates and mirror.
    """
    rows = cut(snapshot(catalog, s))
    pairs = cut(similar_pairs(rows, s))
    hashed = ~F.col("is_image") & F.lit(s.use_phash)
    points = rows.select(
        F.col("idx").alias("node"), F.when(hashed, 0).otherwise(F.col("n_frames")).alias("n"), F.when(hashed, F.unhex(F.lpad(F.hex("phash"), 16, "0"))).otherwise(F.col("frames")).alias("point")
    )
    found = grouping.duplicate_groups_near(pairs, points, grouping.nearness(s))
    return found.join(rows.select(F.col("idx").alias("member"), "path"), "member").select(
        "group_id", F.col("member").alias("idx"), "path", "difference", ((1 - F.col("difference")) * 100).alias("similarity"), "flags"
    )


def clip_candidates(catalog: DataFrame, grouped: DataFrame) -> DataFrame:
    """Videos with a usable fingerprint that no visual group holds."""
    fp = F.col("fp")
    usable = ~F.col("is_image") & (F.col("flags").bitwiseAND(F.lit(SILENT_AUDIO)) == 0) & fp.isNotNull() & (F.size(fp) >= 2) & ~K.is_silent(fp)
    return catalog.filter(usable).join(grouped.select("path").distinct(), "path", "left_anti")


def longest_first(rows: DataFrame) -> DataFrame:
    """rows with place: 0 for the longest, ties in scan order."""
    return ranking.ordinals(rows, [F.desc("duration"), F.asc("idx")], "place")


def verified_clips(claims: DataFrame, catalog: DataFrame, frames: DataFrame, s: Settings) -> DataFrame:
    """Claims (source, clip, similarity, at) whose frames agree at the matched place.

    frames: idx, second, frame. A clip is looked at in one to three places; places too near an end
    and missing frames do not count, and a claim without any passes.
    """
    length = catalog.select("idx", "duration")
    both = claims.join(length.toDF("source", "source_s"), "source").join(length.toDF("clip", "clip_s"), "clip")
    times = both.withColumn("t", F.explode(joins.sample_seconds(F.col("clip_s")))).withColumn("source_t", F.col("at") + F.col("t"))
    times = times.filter((F.col("source_t") < F.col("source_s") - 0.1) & (F.col("t") < F.col("clip_s") - 0.1))
    shot = lambda idx, second, name: frames.select(F.col("idx").alias(idx), F.col("second").alias(second), F.col("frame").alias(name))
    seen = times.join(shot("source", "source_t", "x"), ["source", "source_t"]).join(shot("clip", "t", "y"), ["clip", "t"])
    compared = seen.withColumn("frame_similarity", 1 - K.gray_difference(F.col("x"), F.col("y"))).select("source", "clip", "frame_similarity")
    return joins.visual_gate(claims, compared, s.partial_visual_similarity)


def find_partial_clips(catalog: DataFrame, s: Settings, grouped: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """group_id, idx, path, difference, similarity, flags, at: sources and the clips found in them.

    Each clip counts for the longest source that has it; grouped: rows of visual groups, whose
    paths take no part; frames: where given (and asked for), claims must agree with them.
    """
    rows = cut(clip_candidates(catalog, grouped))
    places = cut(longest_first(rows.select("idx", "duration", "path")))
    found = joins.partial_clips(rows.select("idx", "duration", "fp"), s)
    source = places.select(F.col("idx").alias("source"), F.col("place"))
    claims = cut(ranking.first_claims(found.join(source, "source"), order="place"))  # read twice: as sources, as clips
    if s.partial_require_visual and frames is not None:
        claims = verified_clips(claims, rows, frames, s).withColumn("group_id", F.col("source"))
    out = ranking.clip_rows(claims.select("group_id", "source", "clip", "similarity", "at"))
    return out.join(places.select(F.col("idx").alias("member"), "path"), "member").select(
        "group_id", F.col("member").alias("idx"), "path", "difference", ((1 - F.col("difference")) * 100).alias("similarity"), "flags", "at"
    )


def all_results(visual: DataFrame, partial: DataFrame) -> DataFrame:
    """Visual and partial rows in one table; kind tells them apart, as group ids are of each."""
    return visual.withColumn("at", F.lit(0)).withColumn("kind", F.lit("visual")).unionByName(partial.withColumn("kind", F.lit("partial")))


def explained_clip_pairs(pairs: DataFrame, s: Settings) -> DataFrame:
    """For pairs (duration, flags, fp of _a and _b) the first gate of the clip search that fails."""
    longer = F.col("duration_a") >= F.col("duration_b")
    pick = lambda c: (F.when(longer, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")), F.when(longer, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")))
    (d_s, d_c), (f_s, f_c), (flag_s, flag_c) = pick("duration"), pick("fp"), pick("flags")
    ratio = F.try_divide(d_c, d_s)
    unusable = lambda fp: fp.isNull() | (F.size(fp) < 2)
    silent = lambda fp, flags: K.is_silent(fp) | (flags.bitwiseAND(F.lit(SILENT_AUDIO)) != 0)
    best = K.best_alignment(f_c, f_s, s.partial_similarity)
    failed = (
        F.when((d_s < 1) | (d_c < 1), "too_short").when(ratio < s.partial_min_ratio, "ratio").when(ratio >= 0.95, "same_length")
        .when(unusable(f_s) | unusable(f_c), "no_fingerprint").when(silent(f_s, flag_s) | silent(f_c, flag_c), "silent")
        .when(F.size(f_c) >= F.size(f_s), "blocks").when(best.isNull(), "audio")
    )
    return pairs.withColumn("failed_at", failed).withColumn("at", F.when(failed.isNull(), best["at"]))
