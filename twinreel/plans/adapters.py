"""The driver's tables as catalogs, frames, fingerprints and duplicate groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """idx, label, gray (8 x 8 bytes), stretched, values: embeddings as frames."""
    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    byte = lambda scale, base: F.transform("values", lambda x: F.floor(x * scale + base).cast("int"))
    gray = F.transform("values", lambda x: F.floor((x + 1) * 127.5).cast("int"))
    held = F.transform(byte(800.0, 128.0), lambda x: F.greatest(F.lit(0), F.least(F.lit(255), x)))
    return e.select("idx", "label", gray.alias("gray"), held.alias("stretched"), "values")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """idx, duration, fp: documents whose words are 32-bit blocks of a fingerprint."""
    d = read(spark, sf, "documents")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    block = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"))
    return d.select(F.col("doc_id").alias("idx"), F.coalesce("n_chars", F.length("text")).cast("double").alias("duration"), block.alias("fp"))


def groups(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows: the line items of an order are a duplicate group."""
    r = read(spark, sf, "lineitem")
    return r.select(
        F.col("l_orderkey").alias("group_id"), (((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey") % 1000) * 100 + F.col("l_quantity")).cast("long").alias("pos"),
        F.concat(F.lit("/lib/"), F.col("l_suppkey").cast("string"), F.lit("/"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit(".mp4")).alias("path"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("size"), F.col("l_quantity").cast("int").alias("duration"),
        (F.col("l_partkey") % 4 * 480).cast("int").alias("frame_size"), (F.col("l_linenumber") % 3 * 30).cast("int").alias("fps"),
        F.round(F.col("l_tax") * 100).cast("int").alias("bitrate"), (F.col("l_suppkey") % 3 * 22050).cast("int").alias("audio_sample_rate"),
        (F.lit(100) - F.round(F.col("l_discount") * 100)).cast("int").alias("similarity"), F.col("l_shipdate").alias("date_created"),
        (F.col("l_returnflag") == "R").alias("is_image"), (F.col("l_linestatus") == "O").alias("checked"), F.col("l_suppkey").alias("dev"), (F.col("l_partkey") % 50).alias("ino"),
        F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("codec"), (F.col("l_linenumber") % 2).cast("string"))).alias("format"), F.lower("l_returnflag").alias("audio_format"),
        F.when(F.col("l_suppkey") % 2 == 0, "stereo").otherwise("mono").alias("audio_channel"), (F.col("l_partkey") % 320).cast("int").alias("audio_bitrate"),
        (F.col("l_partkey") % 5).cast("int").alias("hdr_rank"), (F.col("l_partkey") % 2 * 2).cast("int").alias("flags"), (F.col("l_partkey") % 7000).cast("int").alias("at"),
        F.when(F.col("l_partkey") % 4 > 0, F.concat((F.col("l_partkey") % 4 * 320).cast("string"), F.lit("x"), (F.col("l_partkey") % 4 * 160).cast("string"))).alias("frame_text"),
        (F.col("l_partkey") % 11 > 0).alias("visible"),
    )


GROUPS_SQL = """
SELECT l_orderkey AS group_id, (((l_linenumber::BIGINT * 1000000 + l_partkey) * 1000 + l_suppkey % 1000) * 100 + l_quantity)::BIGINT AS pos,
       '/lib/' || l_suppkey || '/' || l_partkey || '_' || l_linenumber || '.mp4' AS path,
       round(l_extendedprice * 100)::BIGINT AS size, l_quantity::INT AS duration, (l_partkey % 4 * 480)::INT AS frame_size,
       (l_linenumber % 3 * 30)::INT AS fps, round(l_tax * 100)::INT AS bitrate, (l_suppkey % 3 * 22050)::INT AS audio_sample_rate,
       (100 - round(l_discount * 100))::INT AS similarity, l_shipdate AS date_created, l_returnflag = 'R' AS is_image,
       l_linestatus = 'O' AS checked, l_suppkey AS dev, l_partkey % 50 AS ino,
       CASE WHEN l_linenumber % 3 <> 0 THEN 'codec' || l_linenumber % 2 END AS format, lower(l_returnflag) AS audio_format,
       CASE WHEN l_suppkey % 2 = 0 THEN 'stereo' ELSE 'mono' END AS audio_channel, (l_partkey % 320)::INT AS audio_bitrate,
       (l_partkey % 5)::INT AS hdr_rank, (l_partkey % 2 * 2)::INT AS flags, (l_partkey % 7000)::INT AS "at",
       CASE WHEN l_partkey % 4 > 0 THEN (l_partkey % 4 * 320) || 'x' || (l_partkey % 4 * 160) END AS frame_text, l_partkey % 11 > 0 AS visible
FROM lineitem
"""


def twins(spark: SparkSession, sf: str) -> DataFrame:
    """groups() with each row once more, under another path, and every third copy of another size."""
    g = groups(spark, sf)
    copy = g.withColumn("pos", F.col("pos") + 10**13).withColumn("path", F.concat("path", F.lit(".copy")))
    return g.unionByName(copy.withColumn("size", F.when(F.col("pos") % 3 == 0, F.col("size") + 1).otherwise(F.col("size"))))


TWINS_SQL = f"""
SELECT * FROM ({GROUPS_SQL}) UNION ALL
SELECT * REPLACE (pos + 10000000000000 AS pos, path || '.copy' AS path, CASE WHEN (pos + 10000000000000) % 3 = 0 THEN size + 1 ELSE size END AS size) FROM ({GROUPS_SQL})
"""

FRAMES_SQL = """
SELECT vec_id AS idx, label, list_transform(embedding, lambda x: x::DOUBLE) AS values,
       list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5)::INT) AS gray,
       list_transform(embedding, lambda x: greatest(0, least(255, floor(x::DOUBLE * 800.0 + 128.0)::INT))) AS stretched
FROM embeddings
"""


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """path, folder, size, flags, is_image: pages as catalog entries."""
    p = read(spark, sf, "pages")
    path = F.regexp_replace("url", r"^https?:/", "")
    return p.select(
        F.col("page_id").alias("idx"), path.alias("path"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("folder"), (F.length("html") * 1000).cast("long").alias("size"),
        (F.col("page_id") % 20).cast("int").alias("flags"), (F.col("page_id") % 2 == 1).alias("is_image"), (F.col("page_id") % 7 != 0).alias("there"),
    )


CATALOG_SQL = r"""
SELECT page_id AS idx, regexp_replace(url, '^https?:/', '') AS path, regexp_extract(regexp_replace(url, '^https?:/', ''), '^(.*)/[^/]*$', 1) AS folder,
       (length(html) * 1000)::BIGINT AS size, (page_id % 20)::INT AS flags, page_id % 2 = 1 AS is_image, page_id % 7 <> 0 AS there
FROM pages
"""



def media(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog with frames: embeddings and a slightly brighter copy of each in another folder."""
    from ..functions import kernels as K

    f = frames(spark, sf).select("idx", "label", "gray", K.median_signature(F.col("values")).alias("phash"))
    brighter = F.transform("gray", lambda x, i: F.least(F.lit(255), x + (i + F.col("idx")) % 3).cast("int"))
    other = F.col("phash").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("idx") % 64).cast("int")))
    # the id last: inside a lambda an alias of the same select would be taken for it
    copy = f.withColumn("gray", brighter).withColumn("phash", other).withColumn("idx", F.col("idx") + 1000000)
    both = f.withColumn("copy", F.lit(0)).unionByName(copy.withColumn("copy", F.lit(1)))
    base = F.col("idx") % 1000000
    image = base % 4 == 0
    folder = F.concat(F.lit("/lib/"), F.col("label").cast("string"), F.when(F.col("copy") == 1, "/Copy").otherwise("/own"))
    duration = F.when(image, 0.0).otherwise((60 + base % 60 + F.col("copy")).cast("double"))
    byte = lambda xs: F.unhex(F.array_join(F.transform(xs, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    at = K.sample_positions(4)
    film = F.create_map(*(y for k, p in enumerate(at) for y in (duration * F.lit(p), byte(F.slice("gray", 16 * k + 1, 16)))))
    return both.select(
        "idx", "label", "copy", F.concat(folder, F.lit("/"), F.col("idx").cast("string"), F.lit(".mp4")).alias("path"), folder.alias("folder"), image.alias("is_image"),
        (base % 17 != 0).alias("has_media"), F.when(base % 19 == 0, 4).otherwise(0).alias("flags"), duration.alias("duration"), (base % 50).alias("file_size"),
        (base % 5).alias("dev"), (base % 10).alias("ino"), F.when(image, F.create_map(F.lit(0.0), byte("gray"))).otherwise(F.when(base % 23 != 0, film)).alias("gray"), "phash",
    )


MEDIA_SQL = f"""
SELECT idx, label, copy, '/lib/' || label || CASE WHEN copy = 1 THEN '/copy' ELSE '/own' END AS folder, idx % 1000000 % 4 = 0 AS is_image,
       CASE WHEN idx % 1000000 % 4 = 0 THEN 0 ELSE 60 + idx % 1000000 % 60 + copy END::DOUBLE AS duration, gray,
       idx % 1000000 % 50 AS file_size, idx % 1000000 % 5 AS dev, idx % 1000000 % 10 AS ino
FROM (SELECT idx, label, gray, 0 AS copy FROM ({FRAMES_SQL}) UNION ALL
      SELECT idx + 1000000, label, list_transform(range(1, 65), lambda i: least(255, gray[i] + (i - 1 + idx) % 3)::INT), 1 FROM ({FRAMES_SQL}))
WHERE idx % 1000000 % 17 <> 0 AND idx % 1000000 % 19 <> 0 AND (idx % 1000000 % 4 = 0 OR idx % 1000000 % 23 <> 0)
"""
