"""Reports and exports of result rows and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def results_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    """group_id, json: a group's items by falling similarity."""
    item = F.struct((-F.col("similarity")).alias("o"), "pos", F.struct(*columns).alias("item"))
    items = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"])
    return rows.groupBy("group_id").agg(F.to_json(F.struct(F.col("group_id").cast("string").alias("GroupId"), items.alias("Items"))).alias("json"))


_fixed = lambda column, digits: F.format_string(f"%.{digits}f", F.col(column).cast("double"))
_text = lambda column: S.csv_field(F.coalesce(F.col(column).cast("string"), F.lit("")))
_truth = lambda column: F.when(F.col(column), "True").otherwise("False")
_plain = lambda column: F.col(column).cast("string")
#: Names of the result flags.
FLAG_NAMES = {0: "None", 1: "Flipped", 2: "PartialClip", 3: "Flipped, PartialClip"}

#: Columns of the report as CSV: header and field of each.
REPORT_COLUMNS = {
    "GroupId": lambda: _plain("group_id"), "Similarity": lambda: _fixed("similarity", 1), "Path": lambda: _text("path"), "Size": lambda: _plain("size"),
    "Duration": lambda: _fixed("duration", 3), "FrameSize": lambda: _text("frame_text"), "Format": lambda: _text("format"), "Fps": lambda: _fixed("fps", 2),
    "BitRateKbs": lambda: _plain("bitrate"), "AudioFormat": lambda: _text("audio_format"),
    "DateCreated": lambda: F.date_format("date_created", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSS'Z'"), "IsImage": lambda: _truth("is_image"),
    "Flags": lambda: F.element_at(F.create_map(*(F.lit(x) for kv in FLAG_NAMES.items() for x in kv)), F.col("flags")), "PartialClipOffset": lambda: _fixed("at", 0),
}
#: Columns of the table's CSV export; the last one only where marks exist.
TABLE_COLUMNS = {
    "GroupId": lambda: _plain("group_id"), "Path": lambda: _text("path"), "SizeBytes": lambda: _plain("size"), "Duration": lambda: clock("duration"),
    "Resolution": lambda: _text("frame_text"), "Fps": lambda: _plain("fps"), "BitrateKbs": lambda: _plain("bitrate"), "AudioFormat": lambda: _text("audio_format"),
    "AudioSampleRate": lambda: _plain("audio_sample_rate"), "Similarity": lambda: _plain("similarity"),
    "DateCreated": lambda: F.date_format("date_created", "yyyy-MM-dd HH:mm:ss"), "IsImage": lambda: _truth("is_image"), "Checked": lambda: _truth("checked"),
}
#: Byte order mark that starts the table's exports.
MARK = "\ufeff"


def clock(column: str):
    """Whole seconds as hh:mm:ss, with days before it where there are any."""
    n = F.col(column).cast("long")
    text = F.format_string("%02d:%02d:%02d", F.floor(n % 86400 / 3600), F.floor(n % 3600 / 60), n % 60)
    return F.when(n >= 86400, F.concat(F.floor(n / 86400).cast("string"), F.lit("."), text)).otherwise(text)


def results_csv(rows: DataFrame) -> DataFrame:
    """group_id, place, line: the report as CSV, by group and falling similarity; header apart:
    ",".join(REPORT_COLUMNS)."""
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("similarity"), "pos"))
    return rows.select("group_id", place.alias("place"), F.concat_ws(",", *(f() for f in REPORT_COLUMNS.values())).alias("line"))


def table_csv(rows: DataFrame, checked: bool = True) -> DataFrame:
    """group_id, pos, line: the table as CSV; header: MARK + ",".join(TABLE_COLUMNS)."""
    columns = [f() for name, f in TABLE_COLUMNS.items() if checked or name != "Checked"]
    return rows.select("group_id", "pos", F.concat_ws(",", *columns).alias("line"))


def results_text(rows: DataFrame) -> DataFrame:
    """group_no, place, text: the report's groups, numbered in the order of their ids: place 0 is
    the group's heading, then a row for each file with its details below it."""
    from ..operators.ranking import ordinals

    groups = ordinals(rows.groupBy("group_id").agg(F.count("*").alias("n")), [F.asc("group_id")], "no").withColumn("group_no", F.col("no") + 1)
    heads = groups.select("group_no", F.lit(0).alias("place"), F.format_string("Group %d (%d files):", "group_no", "n").alias("text"))
    offset = S.clip_offset_text(F.col("flags"), F.col("at"))
    best = F.when(F.col("best_bitrate") | F.col("best_frame_size"), " [best]").otherwise("")
    partial = F.when(F.length(offset) > 0, F.concat(F.lit(" [partial clip "), offset, F.lit("]"))).otherwise("")
    known = lambda c: F.coalesce(F.col(c), F.lit("?"))
    image = F.concat(F.lit(" " * 9), known("frame_text"), F.lit(", "), known("format"))
    film = F.concat(image, F.lit(", "), _fixed("fps", 2), F.lit(" fps, "), _plain("bitrate"), F.lit(" kbps, "), clock("duration"))
    first = F.concat(F.lit("  "), F.format_string("%6.1f%%  ", F.col("similarity").cast("double")), "path", best, partial)
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("similarity"), "pos"))
    files = rows.withColumn("place", place).join(groups.select("group_id", "group_no"), "group_id")
    lines = files.select("group_no", "place", F.concat(first, F.lit("\n"), F.when(F.col("is_image"), image).otherwise(film)).alias("text"))
    return heads.unionByName(lines)


def catalog_json(catalog: DataFrame, key: str = "path") -> DataFrame:
    """key, json: one document for each entry, all columns."""
    return catalog.select(key, F.to_json(F.struct(*catalog.columns)).alias("json"))


def blacklist_json(blacklist: DataFrame) -> DataFrame:
    """entry_id, json: each entry of a blacklist as a document of its own in the current form."""
    paths = F.array_sort(F.collect_set("path"))
    return blacklist.groupBy("entry_id").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.array(paths).alias("groups"))).alias("json"))


def cleanup_report(rows: DataFrame) -> DataFrame:
    """group_id, removed, kept, saved: what deleting the checked rows of each group would do."""
    paths = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("path"))))
    out = rows.groupBy("group_id").agg(
        paths(F.col("checked")).alias("removed"), paths(~F.col("checked")).alias("kept"), F.sum(F.when(F.col("checked"), F.greatest("size", F.lit(0))).otherwise(0)).alias("saved")
    )
    return out.filter(F.size("removed") > 0)


def action_plan(rows: DataFrame, action: str, by_similarity: bool = False) -> DataFrame:
    """path, action, target of the checked rows: links point to the first unchecked row of the
    group (or to the most similar existing one), and a group without one loses nothing. Nothing is
    done to files here."""
    if action != "link":
        return rows.filter("checked").select("group_id", "path", F.lit(action).alias("action"), F.lit(None).cast("string").alias("target"))
    left = rows.filter("NOT checked")
    order = F.struct((-F.col("similarity")).alias("o"), "pos", "path") if by_similarity else F.struct("pos", "path")
    if by_similarity:
        left = left.filter("size >= 0")
    keep = left.groupBy("group_id").agg(F.min_by("path", order).alias("target"))
    return rows.filter("checked").join(keep, "group_id").select("group_id", "path", F.lit("link").alias("action"), "target")


def numbered_names(rows: DataFrame, folder: str) -> DataFrame:
    """path, target: a name that occurs again gets _0, _1 ... before its extension."""
    name = F.element_at(F.split("path", "/"), -1)
    r = F.row_number().over(Window.partitionBy("name").orderBy("path"))
    named = rows.select("path", name.alias("name")).withColumn("r", r)
    again = F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("_"), (F.col("r") - 2).cast("string"), F.regexp_extract("name", r"(\.[^.]*)?$", 0))
    return named.select("path", F.concat(F.lit(folder + "/"), F.when(F.col("r") == 1, F.col("name")).otherwise(again)).alias("target"))


def diagnostic_export(catalog: DataFrame) -> DataFrame:
    """Entries without paths: a running id, duration, flags, frames in base64, hashes as numbers."""
    frames = F.transform(F.array_sort("gray"), lambda g: F.base64(g["frame"]))
    hashes = F.transform("phashes", lambda p: F.conv(F.hex(p["phash"]), 16, 10))
    from ..operators.ranking import ordinals

    return ordinals(catalog, [F.asc("path")], "id").select("id", "duration_s", "flags", frames.alias("frames"), hashes.alias("phashes"))


def write_once(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Replace an export as a whole: written beside it, then renamed over it. The old one goes
    only when the new one is complete; between the two renames the name is absent for a moment,
    and the old export is still there under a name of its own."""
    import uuid

    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    tag = uuid.uuid4().hex
    at, new, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new-{tag}", f"{path}.old-{tag}"))
    df.write.format(form).save(new.toString())
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = store.exists(at)
    if there and not store.rename(at, old) or not store.rename(new, at):
        raise OSError(f"{path} was not replaced")
    if there:
        store.delete(old, True)


def quarantined(spark, path: str) -> str | None:
    """Move an unreadable file aside, to a name that is free; returns that name."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        return None
    stamp = int(store.getFileStatus(at).getModificationTime() / 1000)
    for n in range(1000):
        name = f"{path}.corrupt-{stamp}" + (f"-{n}" if n else "")
        free = jvm.org.apache.hadoop.fs.Path(name)
        if not store.exists(free) and store.rename(at, free):
            return name
    raise OSError(f"no free name beside {path}")
