"""Similarity, band, containment and relocation joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..settings import Settings, clip_bits
from ..sources.tables import cut
from .tiles import BATCH_BYTES


def tolerance(s: Settings, duration: Column) -> Column:
    """Allowed difference of durations: a share, at least the minimum, at most the maximum (if
    set); a share of 0 means the greater of both for all."""
    if s.duration_percent == 0:
        return F.lit(float(max(s.duration_min_s, s.duration_max_s)))
    t = duration * F.lit(s.duration_percent / 100.0)
    if s.duration_min_s > 0:
        t = F.greatest(t, F.lit(float(s.duration_min_s)))
    return F.least(t, F.lit(float(s.duration_max_s))) if s.duration_max_s > 0 else t


def duration_buckets(s: Settings, d: Column, width: float | None = None) -> tuple[Column, Column]:
    """The bucket of a duration, and those in which durations within its tolerance lie."""
    tol = tolerance(s, d)
    if width is None and s.duration_percent > 0 and s.duration_max_s <= 0:
        step = F.lit(1 + s.duration_percent / 100.0)
        bucket = lambda x: F.floor(F.log(F.greatest(x, F.lit(1.0))) / F.log(step))
    else:
        size = F.lit(float(width or max(1.0, s.duration_max_s or s.duration_min_s)))
        bucket = lambda x: F.floor(x / size)
    return bucket(d), F.sequence(bucket(d - tol), bucket(d + tol))


def band_join(rows: DataFrame, s: Settings, id_col: str = "idx", duration_col: str = "duration", width: float | None = None) -> DataFrame:
    """Pairs a < b whose durations differ by no more than the smaller tolerance of the two.

    Durations fall into buckets whose width grows with them (one logarithmic step is the share
    allowed), so a row probes at most a few buckets at any length: an equi-join and a residual
    filter instead of comparing all pairs.
    """
    tol = tolerance(s, F.col(duration_col))
    own, probes = duration_buckets(s, F.col(duration_col), width)
    left = rows.withColumn("bucket", F.explode(probes))
    a = left.select("bucket", *(F.col(c).alias(f"{c}_a") for c in rows.columns), tol.alias("tol_a"))
    b = rows.select(own.alias("bucket"), *(F.col(c).alias(f"{c}_b") for c in rows.columns), tol.alias("tol_b"))
    near = F.abs(F.col(f"{duration_col}_a") - F.col(f"{duration_col}_b")) <= F.least("tol_a", "tol_b")
    return a.join(b, "bucket").filter((F.col(f"{id_col}_a") < F.col(f"{id_col}_b")) & near).drop("bucket", "tol_a", "tol_b")


def folder_key(folder: Column, depth: int) -> Column:
    """The last `depth` segments of a folder in lower case: equal keys are the same folder."""
    parts = F.filter(F.split(F.lower(folder), "/"), lambda x: x != "")
    return F.array_join(F.slice(F.reverse(parts), 1, depth), "/")


def folder_gate(s: Settings, a: Column, b: Column) -> Column:
    if s.folder_match == "none":
        return F.lit(True)
    same = folder_key(a, s.folder_depth) == folder_key(b, s.folder_depth)
    return same if s.folder_match == "same" else ~same


def not_hard_links(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """False for two names of one file: same device, inode, size and duration."""
    return ~(a["dev"].eqNullSafe(b["dev"]) & a["ino"].eqNullSafe(b["ino"]) & (a["size"] == b["size"]) & a["duration"].eqNullSafe(b["duration"]))


#: Rows of a block that one tile of pairs_within holds.
TILE_ROWS = 3_500


def pairs_within(rows: DataFrame, block: list[str], id_col: str) -> DataFrame:
    """Pairs a < b of rows that agree in the block columns.

    A crowded block is dealt into tiles, whose pairs are keys of their own: however few blocks
    there are, all tasks list pairs, and a row moves once for each tile of its block.
    """
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c not in block]
    crowded = cut(rows.groupBy(*block).agg(F.ceil(F.count("*") / TILE_ROWS).alias("tiles_")).filter("tiles_ > 1"))
    zero = F.lit(0).cast("long")
    # a null among the blocks or ids is in no pair
    dealt = rows.dropna(subset=[*block, id_col]).join(crowded, block, "left").withColumn("tiles_", F.coalesce("tiles_", F.lit(1).cast("long")))
    dealt = dealt.withColumn("tile_", F.pmod(F.xxhash64(id_col), F.col("tiles_")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keys = [*block, "p_", "q_"]
    side = lambda x, p, q: dealt.select(*block, p.alias("p_"), q.alias("q_"), *(F.col(c).alias(f"{c}_{x}") for c in kept)).repartition(tasks, *keys)
    x = side("x", F.col("tile_"), F.explode(F.sequence("tile_", F.col("tiles_") - 1)))
    y = side("y", F.explode(F.sequence(zero, "tile_")), F.col("tile_"))
    first = F.col(f"{id_col}_x") < F.col(f"{id_col}_y")
    met = x.join(y.hint("merge"), keys).filter(first | ((F.col("p_") < F.col("q_")) & (F.col(f"{id_col}_x") > F.col(f"{id_col}_y"))))
    pick = lambda c, one, two: F.when(first, F.col(f"{c}_{one}")).otherwise(F.col(f"{c}_{two}"))
    return met.select(*block, *(pick(c, "x", "y").alias(f"{c}_a") for c in kept), *(pick(c, "y", "x").alias(f"{c}_b") for c in kept))


def hamming_join(rows: DataFrame, bits: int, id_col: str = "idx", hash_col: str = "phash") -> DataFrame:
    """Pairs a < b of 64-bit hashes that differ in at most `bits` bits, exactly.

    Hashes that differ in so few bits agree in one of bits + 1 bands: an equi-join on (band,
    value), each pair counted at the first band that it agrees in. Made for small budgets.
    """
    n = bits + 1
    ends = [round(64 * i / n) for i in range(n + 1)]
    value = lambda h, i: F.shiftrightunsigned(h, ends[i]).bitwiseAND(F.lit((1 << (ends[i + 1] - ends[i])) - 1 if ends[i + 1] - ends[i] < 64 else -1))
    h = F.col(hash_col)
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("band"), value(h, i).cast("long").alias("value")) for i in range(n))))
    banded = rows.select(F.col(id_col).alias("id"), h.alias("h"), keys.alias("k")).select("id", "h", "k.band", "k.value")
    a = banded.select("band", "value", F.col("id").alias("a"), F.col("h").alias("h_a"))
    b = banded.select("band", "value", F.col("id").alias("b"), F.col("h").alias("h_b"))
    met = a.join(b, ["band", "value"]).filter((F.col("a") < F.col("b")) & (K.hamming(F.col("h_a"), F.col("h_b")) <= bits))
    first = F.lit(n)
    for i in reversed(range(n)):
        first = F.when(value(F.col("h_a"), i) == value(F.col("h_b"), i), F.lit(i)).otherwise(first)
    return met.filter(F.col("band") == first).select("a", "b", K.hamming(F.col("h_a"), F.col("h_b")).alias("bits"))


#: Blocks of fingerprints that one tile of partial_clips holds of either side; four times as many where spectra tell
#: places, as those of clips are made once for each group of sources.
TILE_BLOCKS = 100_000


#: Bytes of spectra that are held at once of either side; longer items go plane by plane.
SPECTRA_BYTES = 32_000_000
#: Sources of differing transform lengths that are still compared together, and places of pairs held at once.
SOURCES_AT_ONCE, PLACES_AT_ONCE = 128, 1 << 19
PLANES = (14, 16, 20, 24, 28, 32)


def planes_for(similarity: float, blocks: int) -> int:
    """How many of the 32 bit planes to compare first, for clips of `blocks` blocks or more.

    The planes left out can add a block's worth of equal bits each, no more. With as many planes
    as here, fingerprints that have nothing in common stay below what is asked for even so, by six
    standard deviations of a sum of coin flips.
    """
    asked = 64 * similarity - 32  # equal less differing bits of a block
    for k in PLANES[:-1]:
        if (asked - (32 - k)) * blocks >= 6 * (k * blocks) ** 0.5:
            return k
    return PLANES[-1]


def transform_length(n: int) -> int:
    """The least length from n on, of 8 or more, whose transform is fast: a power of two times 8, 9, 10, 12 or 15 over 8."""
    power = 1 << max(3, (n - 1).bit_length() - 1)
    return next(x for x in (power * k // 8 for k in (8, 9, 10, 12, 15, 16)) if x >= n)


#: Differing bits of two adjacent blocks up to which two of their eight parts must agree.
WINDOW_BITS = 6
#: Pairs of windows that are looked at for each pair of items before spectra are cheaper, and at once.
WINDOWS_A_PAIR, WINDOWS_AT_ONCE = 64, 1 << 20


def window_places(sources, clips, bits: int, most: int):
    """Pairs of windows, two adjacent blocks each, that differ in at most `bits` (of WINDOW_BITS) bits:
    (source, clip, place) of each, in items (idx, duration, blocks); None beyond `most` pairs looked at.

    All windows of sources meet every other one of clips. Eight parts take four bits of either block;
    as many bits leave two parts equal, so windows meet under pairs of parts and count at the first.
    """
    import itertools

    import numpy as np

    def windows(group, step):
        fps = [x[2] for x in group]
        size = np.array([len(fp) for fp in fps])
        flat = np.concatenate(fps).astype(np.uint64)
        owner = np.repeat(np.arange(len(fps)), size)
        offset = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        at = np.flatnonzero((offset + 1 < size[owner]) & (offset % step == 0))
        word = flat[at] | flat[at + 1] << np.uint64(32)
        parts = [((word >> np.uint64(4 * i) & np.uint64(15)) | (word >> np.uint64(32 + 4 * i) & np.uint64(15)) << np.uint64(4)).astype(np.uint16) for i in range(8)]
        return word, owner[at], offset[at], parts

    word_s, owner_s, offset_s, parts_s = windows(sources, 1)
    word_c, owner_c, offset_c, parts_c = windows(clips, 2)
    part = [np.uint64(15 << 4 * i | 15 << (32 + 4 * i)) for i in range(8)]
    looked, found = 0, []
    for i, j in itertools.combinations(range(8), 2):
        key_s, key_c = parts_s[i] | parts_s[j] << np.uint16(8), parts_c[i] | parts_c[j] << np.uint16(8)
        order = np.argsort(key_s, kind="stable")
        held = np.bincount(key_s, minlength=1 << 16)
        start, n = (np.cumsum(held) - held)[key_c], held[key_c]
        ends = np.cumsum(n)
        looked += int(n.sum())
        if looked > most:
            return None
        low = 0
        while low < len(n):
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + WINDOWS_AT_ONCE, "right")))
            m = n[low:high]
            c = np.repeat(np.arange(low, high), m)
            t = order[np.arange(len(c)) + np.repeat(start[low:high] - (ends[low:high] - m - before), m)]
            low = high
            apart = word_s[t] ^ word_c[c]
            ok = np.flatnonzero(np.bitwise_count(apart) <= bits)
            for k in range(j):
                if k != i:
                    ok = ok[apart[ok] & part[k] != 0]
            t, c = t[ok], c[ok]
            found.append(np.stack([owner_s[t], owner_c[c], offset_s[t] - offset_c[c]]))
    return np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)


def clip_search(s: Settings):
    """Batches of tiles (sources, clips) to source, clip, similarity, at.

    Of clips with few bits to spare, some two adjacent blocks of a place that counts differ in
    WINDOW_BITS bits or fewer: the bits of such places are counted (see window_places). For the
    others, and where windows are too much alike, spectra tell places. The equal less differing bits at all places of all pairs of a tile come from one product of
    spectra: the bits of a block are planes of +1 and -1, and their correlations add up. Some
    planes bound the sum of all from above, in single precision with room for its error; where
    the bound reaches what is asked for the bits of that place are counted.
    """
    ratio_least, similarity = s.partial_min_ratio, s.partial_similarity

    def search(batches):
        import numpy as np
        import pyarrow as pa

        #: Of each byte, its bits as +1 and -1.
        signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32) * 2 - 1

        def rows(side):
            """Items (idx, duration, blocks) by rising length, without a copy into lists."""
            fp = side.field("fp")
            ends = fp.offsets.to_numpy()
            blocks = fp.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint32)
            ids, lasts = side.field("idx").to_numpy(zero_copy_only=False), side.field("duration").to_numpy(zero_copy_only=False)
            found = [(int(ids[k]), float(lasts[k]), blocks[ends[k] - ends[0] : ends[k + 1] - ends[0]]) for k in range(len(side))]
            return sorted(found, key=lambda x: (len(x[2]), x[0]))

        def spectra(group, length, planes, conjugate):
            """Frequencies x items x planes."""
            out, some = np.empty((length // 2 + 1, len(group), planes.stop - planes.start), np.complex64), np.zeros((32, length), np.float32)
            for k, (_, _, fp) in enumerate(group):
                some[:, : len(fp)] = signs[fp.astype("<u4").view(np.uint8)].reshape(len(fp), 32).T
                some[:, len(fp) :] = 0
                out[:, k] = np.fft.rfft(some[planes], axis=1).T
            return np.conj(out, out=out) if conjugate else out

        def whole(group, length, k, conjugate):
            """The spectra of the first k planes, or None where they are too large to be held at once."""
            return spectra(group, length, slice(0, k), conjugate) if 4 * length * k * len(group) <= SPECTRA_BYTES else None

        def correlated(sources, clips, held_s, held_c, length, k):
            """Places x sources x clips: the sum of the correlations of the first k planes."""
            if held_s is not None and held_c is not None:
                total = held_s @ held_c.transpose(0, 2, 1)
            else:
                total = sum(spectra(sources, length, slice(p, p + 1), False) @ spectra(clips, length, slice(p, p + 1), True).transpose(0, 2, 1) for p in range(k))
            return np.fft.irfft(total, length, axis=0)

        def counted(sources, clips, i, j, place):
            """Differing bits of clips j at the places of sources i."""
            (flat_s, first_s), (flat_c, first_c) = ((np.concatenate([x[2] for x in g]), np.cumsum([0] + [len(x[2]) for x in g])) for g in (sources, clips))
            n = np.diff(first_c)[j]
            ends, apart, low = np.cumsum(n), np.zeros(len(i), np.int64), 0
            while low < len(i):
                before = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + 1_000_000, "right")))
                start, some = ends[low:high] - n[low:high] - before, slice(low, high)
                run = np.arange(int(ends[high - 1]) - before) - np.repeat(start, n[some])
                x = flat_s[np.repeat(first_s[i[some]] + place[some], n[some]) + run] ^ flat_c[np.repeat(first_c[j[some]], n[some]) + run]
                apart[some] = np.add.reduceat(np.bitwise_count(x), start, dtype=np.int64)
                low = high
            return apart

        def by_windows(sources, clips):
            """The record batch of a tile whose clips are all `few`; None where windows are too much alike."""
            r = max(clip_bits(similarity, len(c[2])) // (len(c[2]) // 2) for c in clips)
            places = window_places(sources, clips, r, WINDOWS_A_PAIR * len(sources) * len(clips))
            if places is None:
                return None
            (ids_s, ids_c), (d_s, d_c), (n_s, n_c) = (tuple(np.array([f(x) for x in g]) for g in (sources, clips)) for f in (lambda x: x[0], lambda x: x[1], lambda x: len(x[2])))
            i, j, place = places
            ratio = d_c[j] / d_s[i]
            ok = (place >= 0) & (place + n_c[j] <= n_s[i]) & (n_c[j] < n_s[i]) & (ids_s[i] != ids_c[j]) & (ratio >= ratio_least) & (ratio < 0.95)
            i, j, place = np.unique(places[:, ok], axis=1) if ok.any() else places[:, ok]
            first_s, first_c = np.cumsum(n_s) - n_s, np.cumsum(n_c) - n_c
            flat_s, flat_c = (np.concatenate([x[2] for x in g]) for g in (sources, clips))
            apart = np.zeros(len(i), np.int64)
            for n in np.unique(n_c[j]).tolist():
                of = np.flatnonzero(n_c[j] == n)
                for low in range(0, len(of), step := max(1, 1_000_000 // n)):
                    k, run = of[low : low + step], np.arange(n)
                    apart[k] = np.bitwise_count(flat_s[(first_s[i[k]] + place[k])[:, None] + run] ^ flat_c[first_c[j[k]][:, None] + run]).sum(axis=1, dtype=np.int64)
            budget = np.array([clip_bits(similarity, n) for n in n_c.tolist()])
            k = np.flatnonzero(apart <= budget[j])
            k = k[np.lexsort((place[k], apart[k], j[k], i[k]))]
            pair = i[k] * len(clips) + j[k]
            k = k[np.flatnonzero(np.diff(pair, prepend=-1))]  # the best place of each pair
            columns = [ids_s[i[k]], ids_c[j[k]], 1 - apart[k] / (32 * n_c[j[k]]), place[k].astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["source", "clip", "similarity", "at"])

        def tile(sources, clips):
            most, least = max(x[1] for x in sources), min(x[1] for x in sources)
            clips = [c for c in clips if len(c[2]) < len(sources[-1][2]) and c[1] / least >= ratio_least and c[1] / most < 0.95]
            few = [c for c in clips if clip_bits(similarity, len(c[2])) // (len(c[2]) // 2) <= WINDOW_BITS]
            if few and (found := by_windows(sources, few)) is not None:
                yield found
                clips = [c for c in clips if clip_bits(similarity, len(c[2])) // (len(c[2]) // 2) > WINDOW_BITS]
            yield from by_spectra(sources, clips)

        def by_spectra(sources, clips):
            """Sources of about one length at once, longest first; clips' spectra are made once for each such group."""
            stop = len(sources)
            while stop and clips:
                length = transform_length(len(sources[stop - 1][2]))
                most = max(1, SPECTRA_BYTES // (128 * length))
                start = stop - 1
                while start and stop - start < most and (stop - start < SOURCES_AT_ONCE or transform_length(len(sources[start - 1][2])) == length):
                    start -= 1
                group, stop = sources[start:stop], start
                shortest, longest = min(x[1] for x in group), max(x[1] for x in group)
                fit = [c for c in clips if len(c[2]) < len(group[-1][2]) and c[1] / shortest >= ratio_least and c[1] / longest < 0.95]
                k = planes_for(similarity, len(fit[0][2])) if fit else 0
                held = whole(group, length, k, False) if fit else None
                for at in range(0, len(fit), most):
                    yield from of_length(group, fit[at : at + most], held, length, k)

        def of_length(group, part, whole_s, length, k):
            whole_c = whole(part, length, k, True)
            wide = max(1, min(len(part), int((PLACES_AT_ONCE / length) ** 0.5)))
            high = max(1, PLACES_AT_ONCE // length // wide)
            cut_out = lambda held, low, n: None if held is None else held[:, low : low + n]
            for p in range(0, len(group), high):
                for q in range(0, len(part), wide):
                    yield from near(group[p : p + high], part[q : q + wide], cut_out(whole_s, p, high), cut_out(whole_c, q, wide), length, k)

        def near(group, part, held_s, held_c, length, k):
            ids_s, d_s, n_s = (np.array([f(x) for x in group]) for f in (lambda x: x[0], lambda x: x[1], lambda x: len(x[2])))
            ids_c, d_c, n_c = (np.array([f(x) for x in part]) for f in (lambda x: x[0], lambda x: x[1], lambda x: len(x[2])))
            ratio = d_c[None, :] / d_s[:, None]
            met = (ids_s[:, None] != ids_c[None, :]) & (ratio >= ratio_least) & (ratio < 0.95) & (n_c[None, :] < n_s[:, None])
            if not met.any():
                return
            same = correlated(group, part, held_s, held_c, length, k)
            budget = np.trunc((np.float32(1) - np.float32(similarity)) * (n_c * 32).astype(np.float32))
            asked = 32 * n_c - 2 * budget - (32 - k) * n_c - (2 + 1e-4 * 32 * n_c)
            # places at the ends count here too: those of a pair that may be near are told apart below
            i, j = np.nonzero(met & (same.max(axis=0) >= asked))
            found = []
            for low in range(0, len(i), step := max(1, PLACES_AT_ONCE // length)):
                u, v = i[low : low + step], j[low : low + step]
                place, pair = np.nonzero((same[:, u, v] >= asked[v]) & (np.arange(length)[:, None] <= (n_s[u] - n_c[v])))
                u, v = u[pair], v[pair]
                apart = counted(group, part, u, v, place)
                ok = apart <= budget[v]
                u, v, place, apart, pair = u[ok], v[ok], place[ok], apart[ok], pair[ok]
                best = np.lexsort((place, apart, pair))
                best = best[np.flatnonzero(np.diff(pair[best], prepend=-1))]  # the first place of least difference
                found.append((ids_s[u[best]], ids_c[v[best]], 1 - apart[best] / (32 * n_c[v[best]]), place[best].astype(np.int32)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["source", "clip", "similarity", "at"])

        for batch in batches:
            for k in range(batch.num_rows):
                yield from tile(rows(batch.column("sources")[k].values), rows(batch.column("clips")[k].values))

    return search


def partial_clips(items: DataFrame, s: Settings) -> DataFrame:
    """source, clip, similarity, at: items whose fingerprint is found inside a longer one's.

    items: idx (whole numbers), duration, fp (32-bit blocks as longs). Sources are at least a
    second, clips from partial_min_ratio up to below 0.95 of them and shorter in blocks.
    Candidates meet on logarithmic duration buckets, all of them, in tiles of bounded size that are
    written once; every task reads its tiles of either side from there, so pairs of tiles take no
    disk, and those none of whose lengths fit are left out. The place is the first of least
    difference. The work grows with the square of a bucket: no block of two similar fingerprints
    need be equal, so no key brings all of them together in few; from a similarity of about 0.9 on
    parts of adjacent blocks leave few places to look at, below it half of the bit planes settle
    most pairs at the default similarity.
    """
    import math

    usable = items.filter(
        F.col("idx").isNotNull() & (F.size("fp") >= 2) & ~K.is_silent(F.col("fp")) & ~F.exists("fp", lambda x: x.isNull()) & (F.col("duration") >= 1) & ~F.isnan("duration")
    ).select(F.col("idx").cast("long").alias("idx"), F.col("duration").cast("double").alias("duration"), "fp", F.floor(F.log2("duration")).alias("bucket"))
    reach = math.ceil(math.log2(1 / s.partial_min_ratio))
    size = TILE_BLOCKS if clip_bits(s.partial_similarity, 2) <= WINDOW_BITS else 4 * TILE_BLOCKS
    parts = usable.groupBy("bucket").agg(F.ceil(F.sum(F.size("fp")) / size).cast("int").alias("parts"))
    dealt = usable.withColumn("blocks", F.size("fp")).join(F.broadcast(parts), "bucket").withColumn("part", F.pmod(F.xxhash64("idx"), F.col("parts")))
    tiles = dealt.groupBy("bucket", "part").agg(
        F.collect_list(F.struct("idx", "duration", "fp")).alias("rows"), *(f(c).alias(f"{c}_{n}") for c in ("duration", "blocks") for n, f in (("min", F.min), ("max", F.max)))
    )
    spark = items.sparkSession
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, spark.conf.get(name, str(BATCH_BYTES)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    tiles = cut(tiles.repartition(tasks))
    source, clip = tiles.select(*(F.col(c).alias(f"{c}_s") for c in tiles.columns if c not in ("part", "rows")), F.col("rows").alias("sources")), tiles.withColumnRenamed("rows", "clips")
    reached = F.col("bucket").between(F.col("bucket_s") - reach, F.col("bucket_s"))
    fits = (F.col("blocks_min") < F.col("blocks_max_s")) & (F.col("duration_min") / F.col("duration_max_s") < 0.95)
    fits &= F.col("duration_max") / F.col("duration_min_s") >= F.lit(float(s.partial_min_ratio))
    # a nested loop over files that both sides read again: an equi-join would move each tile once for each pair
    met = source.join(clip.hint("shuffle_replicate_nl"), reached & fits)
    found = met.select("sources", "clips").mapInArrow(clip_search(s), "source long, clip long, similarity double, at int")
    return found.select(*(F.col(c).cast(items.schema["idx"].dataType) for c in ("source", "clip")), "similarity", "at")


def visual_gate(matches: DataFrame, frames: DataFrame, threshold: float) -> DataFrame:
    """Matches whose frames agree on the mean; a match without comparable frames passes.

    frames: source, clip, similarity of each sampled second (null where a frame is missing).
    """
    mean = frames.groupBy("source", "clip").agg(F.avg("frame_similarity").alias("visual"))
    return matches.join(mean, ["source", "clip"], "left").filter(F.coalesce(F.col("visual") >= threshold, F.lit(True)))


def sample_seconds(clip_duration: Column) -> Column:
    """The seconds at which a clip is looked at: three from nine seconds on, two from three on."""
    at = lambda *shares: F.array(*(clip_duration * F.lit(x) for x in shares))
    return F.when(clip_duration >= 9, at(0.25, 0.5, 0.75)).when(clip_duration >= 3, at(0.33, 0.66)).otherwise(at(0.5))


#: Entries from which on a path of a blacklist is common: groups are looked up by another one.
COMMON = 64


def blacklisted_groups(rows: DataFrame, blacklist: DataFrame) -> DataFrame:
    """group_id of groups all of whose paths are in one entry of the blacklist (entry_id, path).

    A group meets entries under one of its paths, a rare one if it has any; of these only entries
    that are no smaller and whose bits (one for each path, by its hash) hold all of the group's go
    on, and their paths are counted.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("path"), F.lit(64)).cast("int"))
    of_group = rows.filter("group_id IS NOT NULL").select("group_id", "path").repartition("group_id").distinct()
    black = blacklist.filter("path IS NOT NULL").select("entry_id", "path").repartition("entry_id").distinct()
    often = cut(blacklist.groupBy("path").agg(F.count("*").alias("often")).filter(F.col("often") > COMMON))
    met = F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "path")).alias("met")
    group = of_group.join(often, "path", "left").groupBy("group_id").agg(F.count("*").alias("size"), F.bit_or(bit).alias("bits"), F.count("path").alias("known"), met)
    group = group.filter("known = size").select("group_id", "size", "bits", F.col("met.path").alias("path"))
    whole = Window.partitionBy("entry_id")
    entry = black.withColumn("entry_size", F.count("*").over(whole)).withColumn("entry_bits", F.bit_or(bit).over(whole))
    may = (F.col("size") <= F.col("entry_size")) & (F.col("bits").bitwiseAND(F.bitwise_not("entry_bits")) == 0)
    may = group.join(entry, "path").filter(may).select("group_id", "entry_id", "size")
    held = black.select(F.col("entry_id").alias("of"), F.col("path").alias("held"))
    hits = may.filter("size > 1").join(of_group.select("group_id", F.col("path").alias("own")), "group_id")
    hits = hits.join(held, F.col("entry_id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("held")))
    hits = hits.groupBy("group_id", "entry_id", "size").agg(F.count("*").alias("hits")).filter("hits = size")
    return may.filter("size = 1").select("group_id").unionByName(hits.select("group_id")).distinct()


def pruned_blacklist(blacklist: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries all of whose paths exist."""
    marked = blacklist.join(listing.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    whole = marked.groupBy("entry_id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("whole")).filter("whole")
    return blacklist.join(whole.select("entry_id"), "entry_id", "left_semi")


def relocation_matches(missing: DataFrame, files: DataFrame) -> DataFrame:
    """path, new_path, confidence: files that may be the missing entries, by size; where several
    have it, by modification within 2 s, then by duration within 0.5 s.

    A file counts only where it is the one of its kind, so pairs are not listed: files are counted
    by size and value, and entries look up how many are near and which one that is.
    """
    m = missing.select("path", "size", F.col("modified").alias("m_old"), F.col("duration").alias("d_old"))
    f = files.select(F.col("path").alias("new_path"), "size", F.col("modified").alias("m_new"), F.col("duration").alias("d_new"))
    counted = lambda n, file: (F.count("*").alias(n), F.min("new_path").alias(file))

    def near(old: str, new: str, reach: float, n: str, file: str) -> DataFrame:
        """size, old, n, file: for each value that entries have, the files within reach of it."""
        at = lambda x: F.floor(F.col(x) / F.lit(reach))
        have = f.filter(F.col(new).isNotNull()).groupBy("size", new).agg(*counted("n_", "file_")).withColumn("at_", at(new))
        asked = m.select("size", old).filter(F.col(old).isNotNull()).distinct().withColumn("at_", F.explode(F.sequence(at(old) - 2, at(old) + 2)))
        met = asked.join(have, ["size", "at_"]).filter(F.abs(F.col(old) - F.col(new)) <= reach)
        return met.groupBy("size", old).agg(F.sum("n_").alias(n), F.min("file_").alias(file))

    c = m.join(f.groupBy("size").agg(*counted("n", "file")), "size")
    c = c.join(near("m_old", "m_new", 2, "n_t", "file_t"), ["size", "m_old"], "left").join(near("d_old", "d_new", 0.5, "n_l", "file_l"), ["size", "d_old"], "left")
    of = Window.partitionBy("path")
    c = c.select("path", *(x for k in ("", "_t", "_l") for x in (F.coalesce(f"n{k}", F.lit(0)).alias(f"n{k}"), f"file{k}")))
    c = c.select("*", *(F.sum(f"n{k}").over(of).alias(f"all{k}") for k in ("", "_t", "_l")))
    one = lambda k: F.col(f"n{k}") == 1  # noqa: E731 - the row, of those that share a path, that has it
    by = lambda k, label: F.when(one(k), F.struct(F.col(f"file{k}").alias("new_path"), F.lit(label).alias("confidence")))
    found = F.when(F.col("all") == 1, by("", "size")).when(F.col("all_t") == 1, by("_t", "size_time")).when(F.col("all_l") == 1, by("_l", "size_duration"))
    return c.withColumn("found", found).filter("found IS NOT NULL").select("path", "found.new_path", "found.confidence")


def explained_pairs(pairs: DataFrame, s: Settings, difference: Column) -> DataFrame:
    """For each pair, one column for each gate and the verdict of all."""
    d = F.abs(F.col("duration_a") - F.col("duration_b")) <= F.least(tolerance(s, F.col("duration_a")), tolerance(s, F.col("duration_b")))
    out = (
        pairs.withColumn("duration_ok", d).withColumn("folder_ok", folder_gate(s, F.col("folder_a"), F.col("folder_b")))
        .withColumn("difference", difference).withColumn("visual_ok", F.coalesce(F.col("difference") <= s.gray_limit, F.lit(False)))
    )
    failed = F.when(~F.col("duration_ok"), "duration").when(~F.col("folder_ok"), "folder").when(~F.col("visual_ok"), "visual")
    return out.withColumn("failed_at", failed).withColumn("duplicate", failed.isNull())
