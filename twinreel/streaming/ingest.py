"""Incremental ingest by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order (aggregated before it moves, so a hot key is one row a task)."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("x")).select(key, "x.*").select(rows.columns)


#: Buckets of an upserted table: a batch rewrites only those that its keys fall into.
BUCKETS = 64


def _versions(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """bucket -> versions of it, from the folders version=V/bucket=B of a table."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{target}/version=*/bucket=*")
    found: dict[int, list[int]] = {}
    for status in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []:
        where = status.getPath()
        done = jvm.org.apache.hadoop.fs.Path(where.getParent(), "_SUCCESS")
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            found.setdefault(int(where.getName().split("=")[1]), []).append(int(where.getParent().getName().split("=")[1]))
    return found


def upserted_table(spark: SparkSession, target: str, schema, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a table that upsert_stream() keeps: of each bucket its newest whole version
    (older than `before`)."""
    paths = []
    for bucket, versions in _versions(spark, target).items():
        fit = [v for v in versions if before is None or v < before]
        if fit and (buckets is None or bucket in buckets):
            paths.append(f"{target}/version={max(fit)}/bucket={bucket}")
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str, order: str, interval: str | None = None, buckets: int = BUCKETS):
    """Take in the files under `source`: of each key the row that is last by order stays.

    The table at `target` is dealt into buckets by key. A batch reads the newest versions of the
    buckets that its keys fall into, from before it, and writes these anew; others are not read.
    A repeated batch writes the same version again, and versions two batches old go. Without an
    interval all files that are there now are taken in; with one ("5 minutes") the query goes on
    and is returned.
    """
    place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        new = latest(batch, key, order).persist()
        touched = [r["b"] for r in new.select(place.alias("b")).distinct().collect()]
        old = upserted_table(session, target, schema, epoch, touched)
        whole = latest(old.unionByName(new), key, order).withColumn("bucket", place)
        whole.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/version={epoch}")
        new.unpersist()
        jvm, conf = session.sparkContext._jvm, session.sparkContext._jsc.hadoopConfiguration()
        for bucket, versions in _versions(session, target).items():
            for v in sorted(versions)[:-2]:
                gone = jvm.org.apache.hadoop.fs.Path(f"{target}/version={v}/bucket={bucket}")
                gone.getFileSystem(conf).delete(gone, True)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    if interval:
        return writer.trigger(processingTime=interval).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


FINGERPRINT_STATE = "rest binary, frames binary, idx long, codes array<long>, emitted array<long>, next long, waiting array<struct<seq:long,samples:array<int>>>, latest long"


def fingerprint_stream(chunks: DataFrame, keep_s: int | None = None, late: str = "10 minutes") -> DataFrame:
    """path, next, fp, ended of a stream of audio chunks (path, seq from 0, samples array<int>).

    Chunks of a file may have any size and come in any order and batch: state holds the samples
    not yet framed, the filter, the codes of the open second and chunks that came too early. Each
    batch gives the fingerprint so far of the files that it touched; with its open second where
    nothing is waiting.

    keep_s: chunks then have a column arrived (timestamp), and a file of which nothing arrives for so
    many seconds of event time is given once more, as ended, and its state goes. Chunks that are
    `late` behind the newest are dropped. Without it state stays for good and nothing ends.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches: Iterator, state):
        import numpy as np
        import pandas as pd

        from ..sources.media import Fingerprint

        fp, due, waiting, latest = Fingerprint(), 0, {}, 0
        if state.exists:
            rest, frames, fp.index, codes, out, due, early, latest = state.get
            fp.rest = np.frombuffer(rest, np.float64)
            fp.frames = list(np.frombuffer(frames, np.float64).reshape(-1, 12))
            fp.codes, fp.out = list(codes), list(out)
            waiting = {x["seq"]: x["samples"] for x in early}
        ended = state.hasTimedOut
        for pdf in () if ended else batches:
            waiting |= dict(zip(pdf["seq"], pdf["samples"], strict=True))
            if keep_s is not None:
                latest = max(latest, int(pdf["arrived"].max().timestamp() * 1000))
        while due in waiting:
            fp.feed(np.asarray(waiting.pop(due), np.int64))
            due += 1
        frames = np.asarray(fp.frames, np.float64).tobytes() if fp.frames else b""
        if ended:
            state.remove()
        else:
            early = [(int(k), [int(x) for x in v]) for k, v in waiting.items()]
            state.update((fp.rest.tobytes(), frames, fp.index, list(fp.codes), list(fp.out), due, early, latest))
            if keep_s is not None:
                state.setTimeoutTimestamp(latest + keep_s * 1000)
        whole = list(fp.out)
        open_second = Fingerprint()
        open_second.codes = list(fp.codes)
        whole += open_second.finish() or []
        yield pd.DataFrame({"path": [key[0]], "next": [due], "fp": [whole], "ended": [ended]})

    timed = [] if keep_s is None else ["arrived"]
    slim = chunks.select("path", F.col("seq").cast("long").alias("seq"), F.col("samples").cast("array<int>").alias("samples"), *timed)
    if timed:
        slim = slim.withWatermark("arrived", late)
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return slim.groupBy("path").applyInPandasWithState(run, "path string, next long, fp array<bigint>, ended boolean", FINGERPRINT_STATE, "update", timeout)


def fingerprints(chunks: DataFrame) -> DataFrame:
    """path, fp of all chunks (path, seq, samples) of files, in a batch: one file in a task."""

    def run(key, pdf):
        import pandas as pd

        from ..sources.media import Fingerprint

        state = Fingerprint()
        for samples in pdf.sort_values("seq")["samples"]:
            state.feed(samples)
        return pd.DataFrame({"path": [key[0]], "fp": [state.finish()]})

    return chunks.groupBy("path").applyInPandas(run, "path string, fp array<bigint>")


def smoothed(frames: DataFrame, part: str, order: str, values) -> DataFrame:
    """frames with smooth: the five-tap filter over each array place, from the fifth frame on."""
    w = Window.partitionBy(part).orderBy(order)
    taps = (0.25, 0.5, 1.0, 0.5, 0.25)
    rows = frames.withColumn("v_", values)
    for back in range(1, 5):
        rows = rows.withColumn(f"v{back}_", F.lag("v_", back).over(w))
    names = ["v4_", "v3_", "v2_", "v1_", "v_"]
    add = lambda x, i: sum((F.get(F.col(n), i) * t for n, t in zip(names, taps, strict=True)), F.lit(0.0)) / sum(taps)
    out = rows.filter("v4_ IS NOT NULL").withColumn("smooth", F.transform("v_", add))
    return out.drop(*names)


def hopping_buckets(frames: DataFrame, size: int, hop: int, order: str, value: str, part: str) -> DataFrame:
    """part, bucket, n, total: rows by hops of `hop`, each hop covering `size` rows."""
    at = F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(part))
    rows = frames.withColumn("at", at).withColumn("n_rows", n)
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - size + 1) / hop)).cast("int")
    last = F.least(F.floor(F.col("at") / hop), F.floor((F.col("n_rows") - size) / hop)).cast("int")
    hops = rows.filter(first <= last).withColumn("bucket", F.explode(F.sequence(first, last)))
    return hops.groupBy(part, "bucket").agg(F.count("*").alias("n"), F.sum(value).alias("total"))
