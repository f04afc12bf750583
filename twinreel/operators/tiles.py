"""Pairs of similar frames, all of two tiles of rows at once.

Tiles hold the rows of a key, a duration bucket and a cell of brightness; tiles meet by these, and
only then are their frames fetched. Inside a pair of tiles numpy adds up the differences pixel by
pixel for all pairs: no pair is a row of its own before it is known to be similar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..settings import FLIPPED, Settings
from ..sources.tables import cut

#: Rows of a tile, and pairs whose sums are held at once.
TILE, AT_ONCE = 2_000, 1 << 18
#: Tiles up to which each is looked at with every other one, and read again for it.
READ_AGAIN = 20_000
#: Bytes of an Arrow batch of pairs of tiles, unless the session sets its own.
BATCH_BYTES = 16_000_000
#: Facts of an item beside its id, n_frames and frames that gates look at.
FACTS = {"duration": "double", "file_size": "long", "dev": "long", "ino": "long", "folder_key": "string"}
NONE = -(2**63)


def exact_differences(x, y, s: Settings):
    """Of pairs of frames (pair, position, row, column): the mean over the positions of mean absolute
    differences over 256; with pixels left out, a frame without any pixel left gives nan."""
    import numpy as np

    apart = np.abs(x.astype(np.int32) - y.astype(np.int32)).astype(np.float64)
    if not (s.ignore_black_pixels or s.ignore_white_pixels):
        return apart.mean(axis=(2, 3)).mean(axis=1) / 256
    keep = np.ones(x.shape, bool)
    if s.ignore_black_pixels:
        keep &= (x > K.BLACK) & (y > K.BLACK)
    if s.ignore_white_pixels:
        keep &= (x < K.WHITE) & (y < K.WHITE)
    with np.errstate(invalid="ignore", divide="ignore"):
        return ((apart * keep).sum(axis=(2, 3)) / keep.sum(axis=(2, 3)) / 256).mean(axis=1)


def sums(x, y, n: int, s: Settings):
    """For rows x and y of pixels (place after place), n frames each: for each frame, the differences of all pairs of
    rows added up, and the pixels that count (a number, or with pixels left out one for each pair)."""
    import numpy as np

    black, white, pixels = s.ignore_black_pixels, s.ignore_white_pixels, x.shape[1]
    fine = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0))) <= 255
    kind, run = (np.int16, 128) if fine else (np.int64, pixels)
    total = np.int32 if fine and pixels * 255 < 2**30 else np.int64
    x, y = np.ascontiguousarray(x.T, dtype=kind), np.ascontiguousarray(y.T, dtype=kind)
    shape = (x.shape[1], y.shape[1])
    one, part = np.empty(shape, kind), np.empty(shape, kind)
    if black or white:
        bits = lambda v: -(((v > K.BLACK) | (not black)) & ((v < K.WHITE) | (not white))).astype(kind)  # noqa: E731 - all bits where a pixel counts
        kept_x, kept_y, mask, few = bits(x), bits(y), np.empty(shape, kind), np.empty(shape, kind)
    out = []
    for k in range(n):
        apart, left, ends = np.zeros(shape, total), pixels // n, (k * pixels // n, (k + 1) * pixels // n)
        if black or white:
            left = np.zeros(shape, total)
        for start in range(*ends, run):
            part.fill(0)
            if black or white:
                few.fill(0)
            for p in range(start, min(ends[1], start + run)):
                if black or white:
                    np.subtract(x[p][:, None], y[p][None, :], out=one)
                    np.abs(one, out=one)
                    np.bitwise_and(kept_x[p][:, None], kept_y[p][None, :], out=mask)
                    np.subtract(few, mask, out=few)
                    np.bitwise_and(one, mask, out=one)
                else:  # the difference is twice the greater one less both
                    np.maximum(x[p][:, None], y[p][None, :], out=one)
                np.add(part, one, out=part)
            apart += part
            if black or white:
                left += few
        if not (black or white):
            apart *= 2
            for one_side, by in ((x, (slice(None), None)), (y, (None, slice(None)))):
                apart -= one_side[slice(*ends)].sum(axis=0, dtype=total)[by]
        out.append((apart, left))
    return out


def may_be_near(x, y, n: int, s: Settings, held=None):
    """For rows x and y of pixels, n frames each: which pairs may be within the limit; held: their sums, if known."""
    import numpy as np

    held = held or sums(x, y, n, s)
    if not (s.ignore_black_pixels or s.ignore_white_pixels):
        total = held[0][0] if n == 1 else sum(apart.astype(np.int64) for apart, _ in held)
        return total <= s.gray_limit * 256 * x.shape[1] * (1 + 1e-9) + 1e-6
    with np.errstate(invalid="ignore", divide="ignore"):
        return sum(apart / left for apart, left in held) <= s.gray_limit * 256 * n * (1 + 1e-9) + 1e-6


def summed_differences(held, i, j, s: Settings):
    """As exact_differences, of the pairs of rows i and j, from sums: the same numbers in the same order of steps."""
    import numpy as np

    apart = np.stack([one[i, j] for one, _ in held], axis=1).astype(np.float64)
    if not (s.ignore_black_pixels or s.ignore_white_pixels):
        return (apart / held[0][1]).mean(axis=1) / 256
    with np.errstate(invalid="ignore", divide="ignore"):
        return (apart / np.stack([left[i, j] for _, left in held], axis=1) / 256).mean(axis=1)


def compared(s: Settings, gates: bool, video: bool = True):
    """mapInArrow: pairs of tiles (a_items, b_items, same) -> a, b, difference, flags of similar pairs.

    Mirrored frames count if the plain ones do not, or less than they. gates: durations near (of
    videos), folders apart and hard links out, as the settings ask.
    """
    limit, folders = s.gray_limit, {}

    def items(side):
        """{(n, size): (ids, frames, facts)} of a tile."""
        import numpy as np
        import pyarrow as pa

        frames = side.field("frames")
        ids, n = side.field("id").to_numpy(zero_copy_only=False), side.field("n_frames").to_numpy(zero_copy_only=False)
        read = (lambda f: np.frombuffer(f, np.uint8)) if pa.types.is_binary(frames.type) else (lambda f: np.array(f, np.int64))
        rows = [read(f) for f in frames.to_pylist()]
        facts = {}
        for c in FACTS if gates else ():
            col = side.field(c)
            if c == "folder_key":  # a number for each, none below 0
                facts[c] = np.array([-1 if x is None else folders.setdefault(x, len(folders)) for x in col.to_pylist()], np.int64)
            else:
                facts[c] = col.fill_null(float("nan") if c == "duration" else NONE).to_numpy(zero_copy_only=False)
        kinds: dict = {}
        for i in np.argsort(facts["duration"], kind="stable").tolist() if gates else range(len(ids)):
            if len(rows[i]):
                kinds.setdefault((int(n[i]), len(rows[i])), []).append(i)
        return {k: (ids[at], np.stack([rows[i] for i in at]).astype(np.int16 if rows[at[0]].dtype == np.uint8 else np.int64), {c: v[at] for c, v in facts.items()}) for k, at in kinds.items()}

    def tolerance(d):
        import numpy as np

        if s.duration_percent == 0:
            return np.full(len(d), float(max(s.duration_min_s, s.duration_max_s)))
        t = d * (s.duration_percent / 100.0)
        t = np.maximum(t, float(s.duration_min_s)) if s.duration_min_s > 0 else t
        return np.minimum(t, float(s.duration_max_s)) if s.duration_max_s > 0 else t

    def passes(f, i, g, j, image):
        import numpy as np

        ok = np.ones(len(i), bool)
        if not image:
            x, y = f["duration"][i], g["duration"][j]
            ok &= np.abs(x - y) <= np.minimum(tolerance(x), tolerance(y))
        if s.folder_match == "different":
            x, y = f["folder_key"][i], g["folder_key"][j]
            ok &= (x != y) & (x >= 0) & (y >= 0)
        if s.exclude_hard_links:
            alike = (f["dev"][i] == g["dev"][j]) & (f["ino"][i] == g["ino"][j])
            x, y = f["file_size"][i], g["file_size"][j]
            alike &= (x == y) | (x == NONE) | (y == NONE)
            if not image:
                x, y = f["duration"][i], g["duration"][j]
                alike &= (x == y) | (np.isnan(x) & np.isnan(y))
            ok &= ~alike
        return ok

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def meet(a, b, n, size, same, image):
            (ids_a, x, f), (ids_b, y, g) = a, b
            side = int(round((size / n) ** 0.5))
            shaped = lambda v: v.reshape(len(v), n, side, side)
            mirror = (lambda v: np.ascontiguousarray(shaped(v)[..., ::-1]).reshape(len(v), size)) if s.compare_flipped else None
            step = max(1, AT_ONCE // len(y) // n)
            for low in range(0, len(x), step):
                some = x[low : low + step]
                first, end = low if same else 0, len(y)  # of a tile with itself each pair once
                if gates and not image:  # by rising durations
                    length, longest = g["duration"], f["duration"][low : low + step][-1]
                    reach = float(tolerance(np.array([longest]))[0]) * (1 + 1e-9) + 1e-6
                    first = max(first, int(np.searchsorted(length, f["duration"][low] - reach)))
                    end = int(np.searchsorted(length, longest + reach, "right")) if longest == longest else end
                others = y[first:end]
                if not len(others):
                    continue
                plain = sums(some, others, n, s)
                near = may_be_near(some, others, n, s, plain)
                if mirror:
                    turned = sums(mirror(some), others, n, s)
                    near |= may_be_near(some, others, n, s, turned)
                if same:
                    near &= np.arange(low, low + len(some))[:, None] < np.arange(first, end)[None, :]
                near &= ids_a[low : low + step, None] != ids_b[None, first:end]
                i, j = np.nonzero(near)
                if gates and len(i):
                    ok = passes(f, i + low, g, j + first, image)
                    i, j = i[ok], j[ok]
                if not len(i):
                    continue
                flags = np.zeros(len(i), np.int32)
                best = summed_differences(plain, i, j, s)
                best = np.where(best <= limit, best, np.nan)
                if mirror:
                    other = summed_differences(turned, i, j, s)
                    better = (other <= limit) & (np.isnan(best) | (other < best))
                    best, flags = np.where(better, other, best), np.where(better, FLIPPED, 0).astype(np.int32)
                ok = ~np.isnan(best)
                u, v = ids_a[i[ok] + low], ids_b[j[ok] + first]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(best[ok]), pa.array(flags[ok])], ["a", "b", "difference", "flags"])

        for batch in batches:
            for k in range(batch.num_rows):
                same, image = batch.column("same")[k].as_py(), batch.column("image")[k].as_py()
                a = items(batch.column("a_items")[k].values)
                b = a if same else items(batch.column("b_items")[k].values)
                for n, size in a.keys() & b.keys():
                    yield from meet(a[n, size], b[n, size], n, size, same, image)

    return run


def tiles_files(spark) -> int:
    """Files that tiles are dealt to; each pair of these is a task."""
    return max(16, min(64, 4 * spark.sparkContext.defaultParallelism))


def similar_in_tiles(rows: DataFrame, s: Settings, keys: list[str], gates: bool = False) -> DataFrame:
    """a, b, difference, flags: pairs a < b of rows that agree in the keys and whose frames are similar.

    rows: id (a whole number, each once), n_frames, frames (binary, or an array of ints without
    nulls), the keys; with gates also FACTS, low and high (of the buckets of durations that a row
    may meet), and always is_image, bucket, m_, c_ (its cell of brightness: neighbours meet).
    """
    spark = rows.sparkSession
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, spark.conf.get(name, str(BATCH_BYTES)))
    spots = ["bucket", "m_", "c_"]
    at = [*keys, *(c for c in ["is_image", *spots] if c not in keys)]
    item = F.struct(F.col("id"), F.col("n_frames"), F.col("frames"), *(F.col(c).cast(t).alias(c) for c, t in FACTS.items() if gates))
    # where only different folders meet, a crowded one has tiles of its own, and those do not meet each other
    apart = gates and s.folder_match == "different"
    held = cut(rows.select(*at, "low", "high", item.alias("item"), *[F.col("folder_key").alias("folder")] * apart))
    folder = []
    if apart:
        folder = ["folder"]
        own = cut(held.groupBy(*at, "folder").agg(F.count("*").alias("n_")).filter(F.col("n_") > TILE)).withColumn("own", F.lit(True)).drop("n_")
        held = held.join(own, [*at, "folder"], "left").withColumn("folder", F.when(F.col("own"), F.col("folder"))).drop("own")
    many = cut(held.groupBy(*at, *folder).agg(F.ceil(F.count("*") / TILE).alias("tiles")).filter("tiles > 1"))
    same = [F.col(f"held.{c}").eqNullSafe(F.col(f"many.{c}")) for c in [*at, *folder]]
    part = F.coalesce(F.pmod(F.xxhash64("item.id"), F.col("tiles")), F.lit(0).cast("long"))
    tiles = held.alias("held").join(many.alias("many"), same, "left").select("held.*", part.alias("part"))
    tiles = tiles.groupBy(*at, *folder, "part").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("item").alias("items"))
    tiles = cut(tiles.repartition(tiles_files(spark)).withColumn("no", F.monotonically_increasing_id()))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    kinds = "a long, b long, difference double, flags int"
    if tiles.count() <= READ_AGAIN:
        # a nested loop over files that both sides read again: an equi-join would move each tile once for each pair
        x, y = (tiles.select(*(F.col(c).alias(f"{c}_{k}") for c in [*at, *folder, "no", "low", "high"]), F.col("items").alias(f"{k}_items")) for k in "ab")
        # each pair once, in an order that has nothing to do with files: so all pairs of files have as much to do
        met = (F.xxhash64("no_a") <= F.xxhash64("no_b")) & F.col("bucket_b").between(F.col("low_a"), F.col("high_a"))
        for c in at:
            if c != "bucket":
                met &= F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) <= 1 if c in spots else F.col(f"{c}_a") == F.col(f"{c}_b")
        met &= ~F.coalesce(F.col("folder_a") == F.col("folder_b"), F.lit(False)) if folder else F.lit(True)
        pairs = x.join(y.hint("shuffle_replicate_nl"), met)
        return pairs.select("a_items", "b_items", F.expr("no_a = no_b").alias("same"), F.col("is_image_a").alias("image")).mapInArrow(compared(s, gates), kinds)
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    a = tiles.withColumn("bucket", F.explode(F.sequence("low", "high"))).withColumn("m_", near("m_")).withColumn("c_", near("c_")).select(*at, F.col("no").alias("no_a"))
    met = cut(a.join(tiles.select(*at, F.col("no").alias("no_b")), at).filter("no_a <= no_b").select("no_a", "no_b", F.col("is_image").alias("image")))
    fetch = lambda x: tiles.select(F.col("no").alias(f"no_{x}"), F.col("items").alias(f"{x}_items"))
    pairs = met.join(fetch("a"), "no_a").join(fetch("b"), "no_b").repartition(tasks)
    pairs = pairs.select("a_items", "b_items", F.expr("no_a = no_b").alias("same"), "image")
    return pairs.mapInArrow(compared(s, gates), kinds)


def gray_pairs(rows: DataFrame, s: Settings, block: list[str], id_col: str, frame: str) -> DataFrame:
    """a, b, difference, flags: pairs of frames (arrays of ints) within the gray limit that agree in
    the block columns; flags: 1 only or better mirrored."""
    zero = F.lit(0).cast("long")
    left_out = 0 if s.ignore_black_pixels else 255 if s.ignore_white_pixels else None
    values = F.col(frame) if left_out is None else F.transform(frame, lambda x: F.coalesce(x, F.lit(left_out)))
    rows = rows.filter(F.col(id_col).isNotNull() & F.col(frame).isNotNull() & ~F.exists(values, lambda x: x.isNull()))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), *block, F.lit(1).alias("n_frames"), values.alias("frames"))
    spot = {c: zero for c in ("bucket", "m_", "c_", "low", "high")} | {"is_image": F.lit(True)}
    return similar_in_tiles(rows.withColumns(spot), s, block)
