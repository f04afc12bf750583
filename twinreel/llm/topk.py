"""Exact top-k inner-product search by distributed histogram selection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors of a packed candidate block and queries of a packed tile: a task holds one of each.
BLOCK, TILE = 2048, 1024
#: Query tiles that travel together to a part of the candidates (some 30 MB of 64 components).
GROUP = 64
#: Bits dropped from a score in each round of the histograms; the last must be 0.
SHIFTS = (12, 0)


def _vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """row, vec_id, v of the rows that take part; row tells rows apart that repeat an id."""
    ok = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ok).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
    )


def _pack(size: int, key: str):
    """mapInArrow: rows (key, row, vec_id, v) -> packed blocks (key, rows, ids, dim, kind, data).

    Components are whole numbers, held in the smallest of the numpy kinds that has room."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        waiting: dict = {}

        def block(k, members):
            dim = max((len(v) for _, _, v in members), default=0)
            data = np.zeros((len(members), dim))
            for i, (_, _, v) in enumerate(members):
                data[i, : len(v)] = np.floor(256.0 * np.asarray(v, dtype=np.float64))
            most = np.abs(data).max(initial=0)
            kind = "int16" if most < 2**15 else "float64"
            rows, ids = (np.array([m[x] for m in members], dtype=np.int64).tobytes() for x in (0, 1))
            return pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in (rows, ids)), pa.array([dim], pa.int32()), pa.array([kind]), pa.array([data.astype(kind).tobytes()], pa.binary())],
                [key, "rows", "ids", "dim", "kind", "data"],
            )

        for batch in batches:
            for k, row, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                members = waiting.setdefault(k, [])
                members.append((row, i, v))
                if len(members) == size:
                    yield block(k, waiting.pop(k))
        for k, members in waiting.items():
            yield block(k, members)

    return pack


def _scores(row):
    """(query rows, query ids, candidate ids, exact score matrix, mask of own pairs) of two blocks."""
    import numpy as np

    def matrix(side):
        n = len(row[f"{side}rows"]) // 8
        return np.frombuffer(row[f"{side}data"], dtype=row[f"{side}kind"]).reshape(n, row[f"{side}dim"]).astype(np.float64)

    q, c = matrix("q_"), matrix("")
    dim = min(q.shape[1], c.shape[1])
    q, c = q[:, :dim], c[:, :dim]
    most = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(dim, 1)
    if most < 2**24:  # exact in single floats
        s = (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    elif most < 2**53:
        s = (q @ c.T).astype(np.int64)
    else:  # beyond exact doubles: whole numbers of any size, held to the range of a long
        exact = np.array([[int(x) for x in r] for r in q], dtype=object) @ np.array([[int(x) for x in r] for r in c], dtype=object).T
        s = np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)
    q_rows, rows, q_ids, ids = (np.frombuffer(row[x], dtype=np.int64) for x in ("q_rows", "rows", "q_ids", "ids"))
    return q_rows, q_ids, ids, s, q_rows[:, None] == rows[None, :]


def _histogram(k: int, shift: int, upper: int | None):
    """mapInArrow: counts of a block's scores by (query, score >> shift), from the top down.

    Bins below the block's own k-th score cannot hold the global k-th one and stay out; the
    rest are complete. With upper, only scores of the bin that the round before chose count.
    """

    def histogram(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                qi, _, _, s, own = _scores(row)
                floor = np.iinfo(np.int64).min
                live = ~own
                if upper is not None:
                    chosen = dict(zip(row["t_ids"], row["t_bins"], strict=True))
                    bins = np.array([chosen.get(int(q), floor) for q in qi], dtype=np.int64)
                    live &= (s >> upper) == bins[:, None]
                out_q, out_b, out_n = [], [], []
                masked = np.where(live, s, floor)
                if masked.shape[1] > k:
                    least = np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k] >> shift
                else:
                    least = np.full(len(qi), floor >> shift)
                counted = live & ((masked >> shift) >= least[:, None])
                for at in np.nonzero(counted.any(axis=1))[0]:
                    bin_, n = np.unique(masked[at][counted[at]] >> shift, return_counts=True)
                    out_q += [int(qi[at])] * len(bin_)
                    out_b += bin_.tolist()
                    out_n += n.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_q, out_b, out_n)], ["query", "bin", "n"])

    return histogram


def _winners(k: int):
    """mapInArrow: pairs at or above the k-th score; of equals to it, a block's k smallest ids."""

    def winners(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                qi, q_ids, ci, s, own = _scores(row)
                chosen = dict(zip(row["t_ids"], row["t_bins"], strict=True))
                out = []
                for at, q in enumerate(qi.tolist()):
                    if q not in chosen:
                        continue
                    above = np.nonzero((s[at] > chosen[q]) & ~own[at])[0]
                    equal = np.sort(ci[(s[at] == chosen[q]) & ~own[at]])[:k]
                    name = int(q_ids[at])
                    out += [(q, name, int(ci[x]), int(s[at, x])) for x in above] + [(q, name, int(x), chosen[q]) for x in equal]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[j] for o in out], pa.int64()) for j in range(4)], ["query", "query_id", "vec_id", "score"]
                )

    return winners


def top_k(table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", shifts=SHIFTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query.

    Queries are the rows whose id is divisible by `every`, candidates all rows but the query's
    own; ties go to the smaller id, and a query with fewer candidates gets all. Components are
    floor(256 * x). Vectors null or with null or non-finite components, and rows without an id,
    take no part. Rows that repeat an id are queries and candidates of their own. Vectors of
    different lengths are compared over the shorter one. Empty input gives no rows.
    Method: every pair of blocks is scored in each round; rounds of histograms with ever finer
    bins give the exact k-th score of each query; a last round keeps what is not below it.
    No row travels but packed blocks, histogram counts and the winners. Query tiles are copied
    to the parts of the candidates; candidates once for every GROUP of tiles. Both are shuffled:
    the planner does not count the copies, and would send them all through the driver.
    """
    spark = table.sparkSession
    vectors = stored(_vectors(table, id_col, vector_col), "topk-vectors")
    queries = vectors.filter(F.col("vec_id") % every == 0)
    tiles = max(1, math.ceil(queries.count() / TILE))
    groups = math.ceil(tiles / GROUP)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tile_of = F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int")
    packed = "rows binary, ids binary, dim int, kind string, data binary"
    group_of = lambda tile: (tile / GROUP).cast("int").alias("group")
    packed_q = stored(
        queries.select(tile_of.alias("tile"), "row", "vec_id", "v").repartition(min(tiles, parts), "tile")
        .mapInArrow(_pack(TILE, "tile"), f"tile int, {packed}")
        .select("tile", group_of(F.col("tile")), *(F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "dim", "kind", "data"))),
        "topk-queries",
    )
    blocks = stored(
        vectors.select(F.lit(0).alias("k"), "row", "vec_id", "v").mapInArrow(_pack(BLOCK, "k"), f"k int, {packed}").drop("k"), "topk-blocks",
    )
    # more parts than blocks would only be more copies of the queries
    salts = max(1, min(math.ceil(2 * parts / groups), blocks.count()))
    salt_of = F.pmod(F.xxhash64("rows"), F.lit(salts)).cast("int")
    left = blocks.withColumn("salt", salt_of).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def pairs(chosen: DataFrame | None) -> DataFrame:
        q = packed_q
        if chosen is not None:
            of_tile = chosen.groupBy(F.pmod(F.xxhash64("query"), F.lit(tiles)).cast("int").alias("tile")).agg(
                F.collect_list("query").alias("t_ids"), F.collect_list("bin").alias("t_bins")
            )
            q = q.join(of_tile.hint("merge"), "tile")
        return left.join(q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge"), ["group", "salt"])

    chosen, above, last = None, None, None
    for shift in shifts:
        counts = pairs(chosen).mapInArrow(_histogram(k, shift, last), "query long, bin long, n long")
        counts = counts.groupBy("query", "bin").agg(F.sum("n").alias("n"))
        if above is None:
            counts = counts.withColumn("above", F.lit(0).cast("long"))
        else:
            counts = counts.join(above, "query")
        down = Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = counts.withColumn("upto", F.sum("n").over(down) + F.col("above"))
        # the first bin at which k are reached, or the lowest one if there are fewer than k
        best = seen.groupBy("query").agg(
            F.max(F.when(F.col("upto") >= k, F.struct("bin", (F.col("upto") - F.col("n")).alias("above")))).alias("hit"),
            F.min(F.struct("bin", (F.col("upto") - F.col("n")).alias("above"))).alias("low"),
        ).select("query", F.coalesce("hit", "low").alias("hit")).select("query", "hit.bin", "hit.above")
        chosen = stored(best, "topk-bins")
        above, last = chosen.select("query", "above"), shift
        chosen = chosen.select("query", "bin")
    found = pairs(chosen).mapInArrow(_winners(k), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
