"""Scalar functions over strings, sizes, dates and stream metadata."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def media_type(path: Column) -> Column:
    return F.when(extension(path).isin(VIDEO_EXTENSIONS), "video").when(extension(path).isin(IMAGE_EXTENSIONS), "image")


def bytes_text(n: Column) -> Column:
    """0 B, 512.0 B, 1.5 KB ..."""
    place = F.when(n < 1024, 0)
    for i in range(1, 6):
        place = place.when(n.cast("double") / 1024**i < 1024, i)
    place = place.otherwise(6)
    unit = F.element_at(F.array(*map(F.lit, "B KB MB GB TB PB EB".split())), place + 1)
    value = n.cast("double") / F.pow(F.lit(1024.0), place)
    return F.when(n == 0, "0 B").otherwise(F.concat(F.format_string("%.1f", value), F.lit(" "), unit))


def size_text(n: Column) -> Column:
    """The report's variant: ? below 0, whole bytes, one digit up to MB, two for GB."""
    return (
        F.when(n < 0, "?").when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024**2, F.format_string("%.1f KB", n / 1024.0)).when(n < 1024**3, F.format_string("%.1f MB", n / 1024.0**2))
        .otherwise(F.format_string("%.2f GB", n / 1024.0**3))
    )


def whole_megabytes(n: Column) -> Column:
    """Bytes over 1024 twice in float32, truncated."""
    kb = (n.cast("float") / F.lit(1024.0).cast("float")).cast("float")
    return (kb / F.lit(1024.0).cast("float")).cast("float").cast("long")


def duration_text(seconds: Column) -> Column:
    """The two leading units: 1d, 2h / 3h / 4m, 5s / 6s."""
    s = seconds.cast("long")
    d, h, m, r = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when(d > 0, F.when(h > 0, F.format_string("%dd, %dh", d, h)).otherwise(F.format_string("%dd", d)))
        .when(h > 0, F.when(m > 0, F.format_string("%dh, %dm", h, m)).otherwise(F.format_string("%dh", h)))
        .when(m > 0, F.format_string("%dm, %ds", m, r)).otherwise(F.format_string("%ds", r))
    )


def percent_diff_text(percent: Column, half_even: bool = False) -> Column:
    """Whole percents with their sign; exact halves go away from zero, or to the even number."""
    whole = F.bround(percent) if half_even else percent
    return F.when(F.abs(percent) < 0.5, "=").otherwise(F.format_string("%+.0f%%", whole))


def duration_diff_text(seconds: Column) -> Column:
    a = F.abs(seconds).cast("long")
    sign = F.when(seconds < 0, "-").otherwise("+")
    h, m, s = F.floor(a / 3600), F.floor(a % 3600 / 60), a % 60
    text = F.when(h >= 1, F.format_string("%dh%02dm%02ds", h, m, s)).when(a >= 60, F.format_string("%dm%02ds", m, s)).otherwise(F.format_string("%ds", s))
    return F.when(seconds == 0, "=").otherwise(F.concat(sign, text))


def csv_field(value: Column) -> Column:
    """Quoted where a field holds a comma, a quote or a line break."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[,"\\n\\r]'), quoted).otherwise(value)


def exif_timestamp(value: Column) -> Column:
    text = F.regexp_replace(value, r"^[\x00 ]+|[\x00 ]+$", "")
    return F.when(text.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")))


def whole_seconds(value: Column) -> Column:
    """A time without its milliseconds."""
    return F.date_trunc("second", value)


def creation_time(value: Column) -> Column:
    """A container's creation time: an ISO text, UTC where it names no zone; else null."""
    iso = value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$")
    zoned = F.when(value.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), value).otherwise(F.concat(value, F.lit("Z")))
    return F.when(iso, F.try_to_timestamp(zoned))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def folder_depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def join_path(a: Column, b: Column) -> Column:
    return F.concat(F.regexp_replace(a, "/+$", ""), F.lit("/"), F.regexp_replace(b, "^/+", ""))


def path_tail(path: Column, most: int) -> Column:
    return F.when(F.length(path) <= most, path).otherwise(F.concat(F.lit("..."), F.right(path, F.lit(most - 3))))


def relocated(path: Column, old: str, new: str) -> Column:
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path)


def hdr_format(transfer: Column, side_data: Column) -> Column:
    t, s = F.lower(F.coalesce(transfer, F.lit(""))), F.upper(F.coalesce(side_data, F.lit("")))
    return (
        F.when(t == "arib-std-b67", "HLG").when(t != "smpte2084", "")
        .when(s.contains("DOVI"), "Dolby Vision").when(s.contains("SMPTE2094"), "HDR10+").otherwise("HDR10")
    )


def hdr_rank(name: Column) -> Column:
    return F.when(name == "Dolby Vision", 4).when(name == "HDR10+", 3).when(name == "HDR10", 2).when(name == "HLG", 1).otherwise(0)


def frame_rate(ratio: Column) -> Column:
    """a/b as a float; -1 where it is no ratio."""
    part = lambda i: F.get(F.split(ratio, "/"), i).try_cast("double")
    return F.coalesce(F.try_divide(part(0), part(1)), F.lit(-1.0)).cast("float")


def probe_duration(value: Column) -> Column:
    """Whole seconds of "3.456" or "h:m:s"; null for anything else."""
    clock = F.split(value, ":")
    part = lambda i: F.get(clock, i).try_cast("double")
    return F.floor(F.coalesce(value.try_cast("double"), F.when(F.size(clock) == 3, part(0) * 3600 + part(1) * 60 + part(2))))


def clip_offset_text(flags: Column, seconds: Column) -> Column:
    text = F.format_string("@ %02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), (seconds % 60).cast("long"))
    return F.when((flags.bitwiseAND(F.lit(2)) != 0) & (seconds > 0), text).otherwise("")


def similarity_class(similarity: Column) -> Column:
    return F.when(similarity >= 99, "high").when(similarity >= 90, "medium").otherwise("low")


def fit_width(width: Column, height: Column, most: int) -> Column:
    """struct<width, height> scaled to `most`, halves to even, at least 1."""
    factor = F.greatest(width / F.lit(float(most)), height / F.lit(float(most)), F.lit(1.0))
    fit = lambda x: F.greatest(F.lit(1), F.bround(x / factor).cast("int"))
    return F.struct(fit(width).alias("width"), fit(height).alias("height"))


def glob_regex(pattern: str) -> str:
    """The regular expression of a simple pattern: * any run, ? one character, letters in any case."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return f"(?is)^{body}$"


def glob(value: Column, pattern: str) -> Column:
    return value.rlike(glob_regex(pattern))


def path_matches(path: Column, needle: str) -> Column:
    """Free text: a pattern if it has * or ?, else a part of the path, letters in any case."""
    if "*" in needle or "?" in needle:
        starred = needle if needle.startswith("*") else "*" + needle
        return glob(path, starred if starred.endswith("*") else starred + "*")
    return F.lower(path).contains(needle.lower())


#: Diagnostic texts by category; the first group with a hit counts.
ERROR_RULES = [
    ("hardware", [
        "lacking required capabilities", "hwaccel initiali", "failed setup for format", "no device available for decoder",
        "hwaccel transfer data failed", "cannot load nvcuda", "cannot load libcuda", "cannot load cuda", "hw_device_ctx", "device creation failed",
    ]),
    ("library", [
        "unable to load shared library", "could not load", "dllnotfound", "the installed ffmpeg major version does not match", "version mismatch",
    ]),
    ("codec", ["decoder not found", "unknown decoder", "no decoder for", "codec not currently supported"]),
    ("corrupt", [
        "moov atom not found", "invalid data found when processing input", "invalid nal unit size", "error splitting the input into nal units",
        "could not find codec parameters", "non-existing pps", "non-existing sps", "error while decoding", "partial file", "truncat",
    ]),
    ("access", ["permission denied", "no such file or directory", "operation not permitted", "protocol not found"]),
    ("hardware", ["generic error in an external library"]),
]
HINTS = {
    "hardware": "Turn hardware decoding off: the device cannot decode this file.",
    "corrupt": "The file seems cut off or damaged; see whether a player opens it.",
    "codec": "No decoder for this codec is installed.",
    "access": "The file cannot be read: rights, a lock, or its path.",
    "library": "The decoder libraries are missing or of another version.",
}


def error_category(text: Column) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for name, needles in ERROR_RULES:
        hit = F.lit(False)
        for needle in needles:
            hit = hit | low.contains(needle)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def error_hint(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, hint in HINTS.items():
        out = F.when(error_category(text) == name, hint).otherwise(out)
    return out


def arguments(text: Column) -> Column:
    """Words of a command line; double quotes keep blanks together."""
    return F.transform(F.regexp_extract_all(text, F.lit(r'((?:[^\s"]|"[^"]*")+)'), F.lit(1)), lambda a: F.replace(a, F.lit('"'), F.lit("")))


def without_lines(text: Column, benign: list[str]) -> Column:
    """The lines of a text in which none of the benign phrases occurs."""
    bad = lambda line: F.lower(line).rlike("|".join(re.escape(b.lower()) for b in benign))
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~bad(line)), "\n")


def strategy_name(value: str) -> str | None:
    """A keeper strategy by name in any spelling."""
    from ..operators.ranking import STRATEGIES

    plain = re.sub(r"[-_ ]", "", value or "").lower()
    return next((s for s in STRATEGIES if s.replace("_", "") == plain), None)
