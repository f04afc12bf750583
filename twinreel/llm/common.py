"""What several operators of this folder need: shared tables, worker state, text units."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import twinreel

# Executors need not have this package on their path: functions go to them by value.
cloudpickle.register_pickle_by_value(twinreel)

WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a session on one machine
    (tests) gets a temporary one; on a cluster that is an error, as executors share no /tmp."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        path = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and the planner
    knows the table's real size, so that it broadcasts it only below its threshold. Tables that
    drop_stored() does not delete go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return back


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As stored(), in as many buckets by key as a shuffle has partitions: rows are not moved to be
    written, nor to be joined by that key."""
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).format("parquet").option("path", path).saveAsTable(table)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(path)
    _NAMES[path] = table
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.table(table)


_TABLES: dict[str, list[str]] = {}
#: Names in the session's catalog by the tables' paths.
_NAMES: dict[str, str] = {}


def drop_stored(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that stored() has written after the first `since` ones; what still
    reads them must be done."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _TABLES.get(spark.sparkContext.applicationId, [])
    for path in paths[since:]:
        if path in _NAMES:
            spark.sql(f"DROP TABLE IF EXISTS {_NAMES.pop(path)}")
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    del paths[since:]


def settled(spark: SparkSession, build, name: str) -> DataFrame:
    """The rows of build(), stored; the tables that build() stored on its way are deleted."""
    since = len(_TABLES.get(spark.sparkContext.applicationId, []))
    out = stored(build(), name)
    paths = _TABLES[spark.sparkContext.applicationId]
    last = paths.pop()
    drop_stored(spark, since)
    paths.append(last)
    return out


#: Bytes of an Arrow batch of texts, unless the session sets its own.
BATCH_BYTES = 4_000_000


def text_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as texts have no bounded length: ten thousand of them are
    held by the executor and by its worker at once otherwise. A session's own setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, spark.conf.get(name, str(BATCH_BYTES)))


def worker_state(key: str, make):
    """One value per Python worker, kept between tasks until another operator makes its own: the
    stages of a pipeline share workers, and what one remembers is of no use to the next."""
    box = sys.modules.setdefault("_twinreel_worker", types.ModuleType("_twinreel_worker"))
    held = box.__dict__.setdefault("held", {})
    if key not in held:
        held.clear()
        trim()
        held[key] = make()
    return held[key]


def forget() -> None:
    """Drop what this worker remembers: workers that idle while later stages run keep theirs."""
    sys.modules.setdefault("_twinreel_worker", types.ModuleType("_twinreel_worker")).__dict__.setdefault("held", {}).clear()
    trim()


#: Most bits of the bitmap of marked(), as a power of two, and bits for each key. A bitmap of
#: 2**26 bits is a broadcast of a million rows of 12 bytes.
MARK_BITS, MARK_ROOM = 26, 8


def free_names(columns: list[str], *stems: str) -> list[str]:
    """Names for helper columns that no column has, in any case of letters: a stem, with as many
    underscores as that takes."""
    taken, out = {c.lower() for c in columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _bits_for(keys: DataFrame) -> int | None:
    """Size of the bitmap of `keys`; None where it would pass MARK_BITS: then every row moves."""
    bits = max(10, (keys.count() * MARK_ROOM * 2).bit_length() - 1)
    return bits if bits <= MARK_BITS else None


def _with_mark(rows: DataFrame, keys: DataFrame, key: str, bits: int, name: str) -> DataFrame:
    """rows with the column `name`: false where the key is certainly not in `keys`. The broadcast
    side is a bitmap in words of 64 bits. JVM only; helper columns have names that rows has not."""
    at, word, marks = free_names([*rows.columns, name], "tw_place", "tw_word", "tw_marks")
    place = F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))
    placed = lambda df: df.withColumn(at, place).withColumn(word, F.shiftright(at, 6).cast("int"))
    bit = f"shiftleft(1L, cast(`{at}` & 63 AS int))"
    bitmap = placed(keys.select(key).filter(F.col(key).isNotNull())).groupBy(word).agg(F.expr(f"bit_or({bit})").alias(marks))
    found = placed(rows).join(F.broadcast(bitmap), word, "left")
    flag = F.coalesce(F.expr(f"(`{marks}` & {bit}) <> 0"), F.lit(False)) & F.col(key).isNotNull()
    return found.withColumn(name, flag).drop(word, at, marks)


def parted(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key may be in `keys`, and those whose key certainly is not (None where the
    bitmap has no room for the keys: then all may)."""
    bits = _bits_for(keys)
    if bits is None:
        return rows, None
    (mark,) = free_names(rows.columns, "tw_mark")
    both = _with_mark(rows, keys, key, bits, mark)
    return both.filter(F.col(mark)).drop(mark), both.filter(~F.col(mark)).drop(mark)


def marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key may be in `keys`, so that those of the others need not move to a join.

    Rows let through in error go in the join that has to follow; with more keys than the bitmap
    has room for, all rows with a key are let through. Null keys go.
    """
    return parted(rows, keys, key)[0].filter(F.col(key).isNotNull())


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in `gone`; only rows that may go move to the anti-join (all, with
    more keys than the bitmap has room for)."""
    may, rest = parted(rows, gone, key)
    left = may.join(gone.select(key).hint("merge"), key, "left_anti").select(rows.columns)
    return left if rest is None else rest.select(rows.columns).union(left)


def marked_left_join(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """rows left-joined with `found`, which has a row for a key at most and no other column of
    rows; only rows whose key may be in `found` move (all, with more keys than the bitmap has
    room for)."""
    may, rest = parted(rows, found, key)
    hit = may.join(found.hint("merge"), key, "left")
    return hit if rest is None else hit.unionByName(rest, allowMissingColumns=True)


#: A key with more rows is dealt out to SALTS tasks in salted_join.
HOT_ROWS, SALTS = 10_000, 16


def salted_join(rows: DataFrame, found: DataFrame, key: list[str], n: str, spread: list[str], how: str = "inner") -> DataFrame:
    """rows joined with `found`, which has a row for a key at most, and in `n` how many rows have it.

    Rows of hot keys go to one of SALTS places by a hash of the columns `spread`, and the one row
    of `found` to all of them. A bitmap of the hot keys, at most one for HOT_ROWS rows, tells both
    sides which they are; where it errs both sides err alike.
    """
    mark, salt = free_names([*rows.columns, *found.columns], "tw_hot", "tw_salt")
    (one,) = free_names([*rows.columns, *found.columns], "tw_key")
    whole = lambda df: df.withColumn(one, F.xxhash64(*key))
    rows, found = whole(rows), whole(found)
    hot = found.filter(F.col(n) > HOT_ROWS).select(one)
    bits = _bits_for(hot)
    mark_ = lambda df: df.withColumn(mark, F.lit(True)) if bits is None else _with_mark(df, hot, one, bits, mark)
    dealt = mark_(rows).withColumn(salt, F.when(F.col(mark), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    every = F.when(F.col(mark), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    copied = mark_(found).withColumn(salt, F.explode(every))
    return dealt.drop(mark, one).join(copied.drop(mark, one), [*key, salt], how).drop(salt)


def trim() -> None:
    """Give a worker's unused memory back, so that it does not stay with an idle worker."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def n_words(text):
    """Words of a text as a column; null counts 0. JVM only.

    White space becomes one kind, and only starts of words are counted, so no array is built
    of the words' text.
    """
    blank = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(blank, " "), lambda w: w != "")).cast("long")
