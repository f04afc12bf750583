"""Reading tables, cutting lineage, and the catalog's own formats."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Folders of tables that cut() has written, while their frames are in use here.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a session on one machine (tests)
    gets a temporary one; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written as a table to the shared folder and read back: lineage ends here.

    The planner then knows the table's real size. A checkpoint instead keeps the estimate of the
    plan before it, which each join multiplies: over the rounds of an iteration its digits double,
    until planning alone never ends. Tables go when the driver ends, or with dropped().
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, store = _store(spark, path)
    store.deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[back] = path
    return back


def dropped(df: DataFrame) -> None:
    """Delete the table of a frame that cut() gave; whatever reads it must be done."""
    if path := _WRITTEN.pop(df, None):
        where, store = _store(df.sparkSession, path)
        store.delete(where, True)


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


STREAM = (
    "struct<index:string,codec_name:string,codec_long_name:string,codec_type:string,pixel_format:string,width:int,height:int,"
    "sample_rate:int,channel_layout:string,bit_rate:bigint,frame_rate:float,channels:int,hdr_format:string>"
)
CATALOG = (
    "path string, folder string, gray array<struct<pos:int,key_seconds:double,frame:binary>>, duration_s double, "
    f"streams array<{STREAM}>, flags int, date_created timestamp, date_modified timestamp, file_size bigint, "
    "phashes array<struct<pos:int,phash:bigint>>, audio_fp array<bigint>"
)


def listing(spark: SparkSession, folder: str, images: bool = True, recursive: bool = True, excluded: tuple[str, ...] = ()) -> DataFrame:
    """path, folder, file_size, date_modified, is_image of the media files below a folder; contents
    are not read. Files below the excluded folders (whole names or patterns) are left out."""
    from ..functions.scalars import folder_of, media_type
    from ..operators.filters import in_black_list

    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    path = F.regexp_replace("path", "^file:/+", "/")
    files = files.select(path.alias("path"), folder_of(path).alias("folder"), F.col("length").alias("file_size"), F.col("modificationTime").alias("date_modified"))
    kind = media_type(F.col("path"))
    files = files.withColumn("is_image", kind == "image").filter(kind.isNotNull() & (F.lit(images) | (kind == "video")))
    return files.filter(~in_black_list(F.col("folder"), excluded)) if excluded else files


def upserted(catalog: DataFrame, files: DataFrame, key: str, facts: list[str], cached: list[str]) -> DataFrame:
    """The catalog after a listing: new files come in, files whose facts changed lose what was
    cached of them, others keep it, missing ones stay. Adds change: new, changed or kept."""
    a, b = catalog.select(key, *facts, *cached), files.select(key, *(F.col(c).alias(f"new_{c}") for c in facts))
    a = a.withColumn("in_a", F.lit(True))
    b = b.withColumn("in_b", F.lit(True))
    j = a.join(b, key, "full_outer")
    changed = F.lit(False)
    for c in facts:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
    change = F.when(F.col("in_a").isNull(), "new").when(F.col("in_b").isNotNull() & changed, "changed").otherwise("kept")
    j = j.withColumn("change", change)
    take = [F.when(F.col("change") == "kept", F.col(c)).otherwise(F.col(f"new_{c}")).alias(c) for c in facts]
    keep = [F.when(F.col("change") == "kept", F.col(c)).alias(c) for c in cached]
    return j.select(key, *take, *keep, "change")


def catalog_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an exported catalog: one document, or one entry a line."""
    return spark.read.schema(CATALOG).option("multiLine", True).json(path)


def catalog_entries(text: DataFrame, schema: str = CATALOG) -> DataFrame:
    """Entries of exported documents (column value), one each; what is no such document goes."""
    return text.select(F.from_json("value", schema).alias("e")).filter("e IS NOT NULL").select("e.*")


def blacklist_entries(text: DataFrame, keep: str | None = None) -> DataFrame:
    """entry_id, path (and the column keep) of a blacklist document (column value): a bare array of arrays, or an
    object with version and groups; anything else is empty."""
    groups = F.coalesce(
        F.from_json("value", "array<array<string>>"), F.from_json("value", "struct<version:int,groups:array<array<string>>>")["groups"]
    )
    own = [keep] if keep else []
    return text.select(*own, F.posexplode(groups).alias("entry_id", "paths")).select(*own, "entry_id", F.explode("paths").alias("path"))


def result_items(text: DataFrame, item: str) -> DataFrame:
    """Items of a result document: an array of groups, or an object with version and groups; null items go."""
    group = f"array<struct<GroupId:string,Items:array<{item}>>>"
    # an object read as an array would be an array of one
    bare = F.ltrim("value").startswith("[")
    groups = F.when(bare, F.from_json("value", group)).otherwise(F.from_json("value", f"struct<version:int,groups:{group}>")["groups"])
    rows = text.select(F.explode(groups).alias("g")).select("g.GroupId", F.explode("g.Items").alias("item")).filter("item IS NOT NULL")
    return rows.select(F.col("GroupId").alias("group_id"), "item.*")


PROBE = (
    "struct<streams:array<struct<index:string,codec_name:string,codec_long_name:string,codec_type:string,pix_fmt:string,width:int,height:int,"
    "sample_rate:string,channel_layout:string,bit_rate:string,r_frame_rate:string,channels:int,color_transfer:string,"
    "side_data_list:array<struct<side_data_type:string>>>>,format:struct<duration:string,bit_rate:string>>"
)


def probed(rows: DataFrame, column: str = "probe") -> DataFrame:
    """rows with duration_s and streams read from probe JSON; both null where it is no JSON.

    Stream 0 takes the container's bit rate if no stream has one.
    """
    from ..functions import scalars as S

    j = F.from_json(column, PROBE)
    none = ~F.exists(j["streams"], lambda s: s["bit_rate"].isNotNull())

    def stream(s, i):
        own = s["bit_rate"].try_cast("bigint")
        rate = F.when(none & (i == 0), j["format"]["bit_rate"].try_cast("bigint")).otherwise(own)
        side = F.array_join(F.transform(s["side_data_list"], lambda x: x["side_data_type"]), "|")
        return F.struct(
            s["index"].alias("index"), s["codec_name"].alias("codec_name"), s["codec_long_name"].alias("codec_long_name"),
            s["codec_type"].alias("codec_type"), s["pix_fmt"].alias("pixel_format"), s["width"].alias("width"), s["height"].alias("height"),
            s["sample_rate"].try_cast("int").alias("sample_rate"), s["channel_layout"].alias("channel_layout"), rate.alias("bit_rate"),
            S.frame_rate(s["r_frame_rate"]).alias("frame_rate"), s["channels"].alias("channels"), S.hdr_format(s["color_transfer"], side).alias("hdr_format"),
        )

    return rows.withColumn("duration_s", S.probe_duration(j["format"]["duration"])).withColumn("streams", F.transform(j["streams"], stream))


def result_row(streams):
    """Columns of a result row from an entry's streams: the video stream of most pixels, the
    audio stream of most channels (the first of equals); frame_size is width plus height."""

    def best(kind, measure):
        of = F.filter(streams, lambda s: s["codec_type"] == kind)
        ranked = F.transform(of, lambda s, i: F.struct(F.coalesce(measure(s), F.lit(0)).alias("m"), (-i).alias("i"), s.alias("s")))
        return F.get(F.reverse(F.array_sort(F.transform(ranked, lambda r: F.struct(r["m"].alias("m"), r["i"].alias("i"), F.struct(r["s"]["codec_name"], r["s"]["width"], r["s"]["height"], r["s"]["frame_rate"], r["s"]["bit_rate"], r["s"]["sample_rate"], r["s"]["channels"], r["s"]["hdr_format"]).alias("s"))))), 0)["s"]

    v, a = best("video", lambda s: s["width"] * s["height"]), best("audio", lambda s: s["channels"])
    kbps = lambda s: F.bround(s["bit_rate"].cast("decimal(18,3)") / 1000, 0).cast("decimal(18,0)")
    return {
        "format": F.coalesce(v["codec_name"], F.lit("<Unknown>")), "frame_size": v["width"] + v["height"], "fps": v["frame_rate"], "bitrate": kbps(v),
        "audio_format": F.coalesce(a["codec_name"], F.lit("<Unknown>")), "audio_sample_rate": a["sample_rate"], "audio_bitrate": kbps(a), "hdr_format": v["hdr_format"],
    }


def synthetic_catalog(spark: SparkSession, n: int, seed: int = 42, copies: int = 0) -> DataFrame:
    """n made-up entries with 32 x 32 frames; every `copies` consecutive ones share their frame."""
    base = spark.range(n).withColumn("original", F.floor(F.col("id") / copies) * copies if copies else F.col("id"))
    word = lambda i: F.unhex(F.sha2(F.concat_ws(":", F.lit(seed), "original", F.lit(i)), 512))
    return base.select(
        F.concat(F.lit("/library/"), (F.col("id") % 100).cast("string"), F.lit("/video"), F.col("id").cast("string"), F.lit(".mp4")).alias("path"),
        (5 + F.pmod(F.xxhash64(F.lit(seed), "original"), F.lit(3595))).cast("double").alias("duration_s"), F.concat(*(word(i) for i in range(16))).alias("frame"),
    )


def image_size(content):
    """struct<width, height> from the header of a PNG, GIF or BMP; null otherwise."""
    big = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("int")
    little = lambda at: big(at, 1) + big(at + 1, 1) * 256
    head = F.hex(F.substring(content, 1, 4))
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    return F.when(head == "89504E47", size(big(17, 4), big(21, 4))).when(head == "47494638", size(little(7), little(9))).when(
        head.startswith("424D"), size(little(19), little(23))
    )
