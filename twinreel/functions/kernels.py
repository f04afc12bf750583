"""Kernels over frames, hashes and fingerprints as Column functions (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLACK, WHITE = 32, 240


def gray_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two byte frames over 256 (so 255/256 at most); null if empty."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.try_divide(total.cast("double"), F.size(a) * 256)


def gray_difference_masked(a: Column, b: Column, black: bool, white: bool) -> Column:
    """The same over pixels where neither frame is black (or white); null if no pixel is left."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    if black:
        pairs = F.filter(pairs, lambda p: (p["x"] > BLACK) & (p["y"] > BLACK))
    if white:
        pairs = F.filter(pairs, lambda p: (p["x"] < WHITE) & (p["y"] < WHITE))
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda s, p: s + F.abs(p["x"] - p["y"]).cast("long"))
    return F.try_divide(total.cast("double"), F.size(pairs) * 256)


def flip(frame: Column, side: int) -> Column:
    """Horizontal mirror of a side x side frame."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda r: F.reverse(F.slice(frame, r * side + 1, side)))
    return F.flatten(rows)


def dense_frame(rows: Column, width: int) -> Column:
    """Rows that may be padded at their end as one frame without padding."""
    return F.flatten(F.transform(rows, lambda r: F.slice(r, 1, width)))


def is_bright(frame: Column, dark_percent: float = 80) -> Column:
    """Whether less than dark_percent of the bytes are dark."""
    return F.lit(100.0) / F.size(frame) * F.size(F.filter(frame, lambda x: x <= BLACK)) < dark_percent


def median_of_64(values: Column) -> Column:
    ordered = F.array_sort(values)
    return (F.element_at(ordered, 32) + F.element_at(ordered, 33)) / 2


def median_signature(values: Column) -> Column:
    """64-bit hash: bit i is set where value i is above the median (the tail of the perceptual hash)."""

    def bits(median: Column) -> Column:
        one = F.lit(1).cast("long")
        marks = F.transform(values, lambda x, i: F.when(x > median, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(marks, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    # one-element transform: the median is computed once, not for each value
    return F.get(F.transform(F.array(median_of_64(values)), bits), 0)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def is_silent(fingerprint: Column) -> Column:
    return (F.size(fingerprint) > 0) & F.forall(fingerprint, lambda x: x == 0)


def audio_flags(flags: Column, fingerprint: Column) -> Column:
    """Flags after fingerprinting: error (null), no usable track (empty), silent."""
    from ..settings import AUDIO_ERROR, NO_AUDIO_TRACK, SILENT_AUDIO

    return (
        F.when(fingerprint.isNull(), flags.bitwiseOR(F.lit(AUDIO_ERROR)))
        .when(F.size(fingerprint) == 0, flags.bitwiseOR(F.lit(NO_AUDIO_TRACK)))
        .when(is_silent(fingerprint), flags.bitwiseOR(F.lit(SILENT_AUDIO)))
        .otherwise(flags)
    )


def has_any(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def has_all(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) == mask


def with_flag(flags: Column, mask: int, on: bool = True) -> Column:
    return flags.bitwiseOR(F.lit(mask)) if on else flags.bitwiseAND(F.lit(~mask))


def majority_vote(column: Column, bits: int = 32) -> Column:
    """Aggregate: each bit that more than half of the rows have (exact halves do not count)."""
    need = F.floor(F.count(column) / 2) + 1
    vote = lambda i: F.sum(F.shiftright(column, i).bitwiseAND(F.lit(1).cast("long"))) >= need
    out = F.lit(0).cast("long")
    for i in range(bits):
        out = out.bitwiseOR(F.when(vote(i), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


#: The pairs of pitch classes that the 32 bits of a chroma frame compare.
CHROMA_PAIRS = (
    [(i, (i + 1) % 12) for i in range(12)] + [(i, (i + 3) % 12) for i in range(12)] + [(i, (i + 6) % 12) for i in range(8)]
)


def chroma_code(chroma: Column) -> Column:
    out = F.lit(0).cast("long")
    for bit, (a, b) in enumerate(CHROMA_PAIRS):
        higher = F.get(chroma, a) > F.get(chroma, b)
        out = out.bitwiseOR(F.when(higher, F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def l2_normalised(values: Column) -> Column:
    """Values over their norm; all 0 where the sum of squares is below 1e-10."""
    square = F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)
    return F.when(square < 1e-10, F.transform(values, lambda _: F.lit(0.0))).otherwise(F.transform(values, lambda x: x / F.sqrt(square)))


def best_alignment(short: Column, long: Column, similarity: float) -> Column:
    """struct<bits, at>: where a short run of 32-bit blocks differs least from a longer one.

    Of equal places the first; null if there is none within the truncated float32 budget.
    """
    places = F.sequence(F.lit(0), F.size(long) - F.size(short))
    apart = lambda o: F.aggregate(
        F.zip_with(short, F.slice(long, o + 1, F.size(short)), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )
    best = F.array_min(F.transform(places, lambda o: F.struct(apart(o).alias("bits"), o.alias("at"))))
    blocks = F.size(short)
    one = F.lit(1.0).cast("float") - F.lit(similarity).cast("float")
    budget = (one.cast("float") * (blocks * 32).cast("float")).cast("float").cast("int")
    fits = (blocks > 0) & (F.size(short) <= F.size(long))
    return F.when(fits, F.when(best["bits"] <= budget, best))


def sample_positions(n: int) -> list[float]:
    """n evenly spaced positions between 0 and 1, added up in float32."""
    import numpy as np

    step, at, out = np.float32(1) / np.float32(n + 1), np.float32(0), []
    for _ in range(n):
        at = np.float32(at + step)
        out.append(float(at))
    return out


def sample_second(duration: Column, position: float, max_sampling: float = 0) -> Column:
    """Second at which a frame is sampled."""
    return (F.least(duration, F.lit(max_sampling)) if max_sampling > 0 else duration) * F.lit(position)
