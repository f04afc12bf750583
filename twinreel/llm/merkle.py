"""Merkle manifest of a dataset: an authentication path for each row, by tree traversal in blocks."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, stored

#: A block holds 2**BLOCK_HEIGHT consecutive nodes of a level: what one task holds at once.
BLOCK_HEIGHT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<sibling:string,on_left:boolean>>"
#: Ids whose CRC-32 this divides are tampered with in the check of tamper_check.
TAMPER = 7


def _joined(left: str | None, right: str | None) -> str | None:
    """Digest of a run of two nodes, or of one; None where there is none."""
    if left is None:
        return None
    return hashlib.sha256((left + (right or "")).encode()).hexdigest()


class Treehash:
    """The node of one height over the leaves from `start` on, built a unit of work at a time: a
    unit takes a leaf or joins two nodes, so no more than `height` + 1 nodes are held."""

    def __init__(self, height: int, start: int):
        self.height, self.next, self.stack = height, start, []

    def low(self) -> float:
        """Height of the lowest node that is held; infinite when the node is ready."""
        if not self.stack:
            return self.height
        low = self.stack[-1][0]
        return float("inf") if low == self.height else low

    def update(self, leaf) -> None:
        held = self.stack
        if len(held) > 1 and held[-1][0] == held[-2][0]:
            height, right = held.pop()
            held[-1] = (height + 1, _joined(held[-1][1], right))
        else:
            held.append((0, leaf(self.next)))
            self.next += 1


def top(leaves: list[str], height: int) -> str:
    """Root of the tree of a height over at most 2**height leaves; a run at the end may be one."""
    for _ in range(height):
        leaves = [_joined(leaves[i], leaves[i + 1] if i + 1 < len(leaves) else None) for i in range(0, len(leaves), 2)]
    return leaves[0]


def traverse(leaves: list[str], height: int):
    """The authentication path of each leaf in turn: siblings from the lowest level up, None where
    a node is alone in its run.

    Beside the leaves of the block only the current path and one stack for each height are held.
    After a leaf the heights whose subtree ends there take their next sibling from their stack,
    which starts on the one after; then 2 * height - 1 units of work go to the stack whose
    lowest node is lowest, so that each is ready when it is needed.
    """
    n, size = len(leaves), 1 << height
    leaf = lambda i: leaves[i] if i < n else None
    auth: list[str | None] = [None] * height
    stacks = [Treehash(h, 0) for h in range(height)]
    for h, own in enumerate(stacks):  # the first two nodes of each height: the sibling of leaf 0's way, and the next one
        beside = Treehash(h, 1 << h)
        for hash_ in (own, beside):
            while hash_.low() != float("inf"):
                hash_.update(leaf)
        auth[h] = beside.stack[0][1]
    for at in range(n):
        yield list(auth)
        for h in range(height):
            if (at + 1) % (1 << h):
                break
            auth[h] = stacks[h].stack[0][1]
            start = (at + 1 + (1 << h)) ^ (1 << h)
            stacks[h] = Treehash(h, start)
            if start >= size:  # no leaf of this block asks for it
                stacks[h].stack = [(h, None)]
        for _ in range(2 * height - 1):
            lows = [s.low() for s in stacks]
            lowest = min(lows)
            if lowest == float("inf"):
                break
            stacks[lows.index(lowest)].update(leaf)


def _levels(n: int) -> int:
    """Levels over n nodes."""
    return max(0, (n - 1).bit_length())


def leaf_digest(fields: dict[str, Column]) -> Column:
    """sha256 of the fields in order: '-' for null, else UTF-8 bytes' number, ':', value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, fields.values())).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to. JVM only: it shares no code with the traversal."""

    def up(node, step):
        both = F.when(step["on_left"], F.concat(step["sibling"], node)).otherwise(F.concat(node, F.coalesce(step["sibling"], F.lit(""))))
        return F.sha2(both.cast("binary"), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """sha256 of a proof's siblings, one after the other; levels without one add nothing."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["sibling"]), "").cast("binary"), 256)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with index (their place in their group, by `order`) and n (the group's size).

    Rows are sorted in ranges; only each range's part of each group (a row for each) is added up.
    """
    spread = rows.withColumn("salt", F.monotonically_increasing_id())  # equal rows may lie in several ranges
    keys = ["group", *order, "salt"]
    place = F.monotonically_increasing_id()  # range << 33 | place in it
    ranged = stored(spread.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", place).drop("salt"), name)
    part = F.shiftright("place", 33)
    parts = ranged.groupBy("group", part.alias("part")).agg(F.count("*").alias("size"), F.min("place").alias("first"))
    of = Window.partitionBy("group")
    before = F.sum("size").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.withColumn("start", F.coalesce(before, F.lit(0)) - F.col("first")).withColumn("n", F.sum("size").over(of))
    starts = stored(starts.select("group", "part", "start", "n"), name)
    found = ranged.withColumn("part", part).join(starts, ["group", "part"])
    return found.withColumn("index", F.col("start") + F.col("place")).drop("part", "place", "start")


def _with_block(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("index", height))


def _block_height(n: int, height: int) -> int:
    return min(height, _levels(n))


def block_roots(nodes: DataFrame, height: int) -> DataFrame:
    """group, index, n, digest of the next level but `height` - 1: one node for each block."""

    def join(key, table):
        import pyarrow as pa

        table = table.sort_by("index")
        n = table.column("n")[0].as_py()
        root = top(table.column("digest").to_pylist(), _block_height(n, height))
        return pa.table({"group": [key[0].as_py()], "index": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n >> height)], pa.int64()), "digest": [root]})

    few = _with_block(nodes.select("group", "index", "n", "digest"), height)
    return few.groupBy("group", "block").applyInArrow(join, "group string, index long, n long, digest string")


def descend(nodes: DataFrame, upper: DataFrame, height: int) -> DataFrame:
    """nodes(group, index, n, digest, ...) with subroot, root and their whole proofs.

    upper(group, index, subroot, root, proof) has the path that the nodes of a block share; each
    block's nodes meet it once, and the traversal adds the block's own levels below it.
    """
    fields = [f for f in nodes.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", subroot string, root string, proof {PROOF}"

    def walk(key, table, above):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("sibling", pa.string()), ("on_left", pa.bool_())]))
        table = table.sort_by("index")
        own = _block_height(table.column("n")[0].as_py(), height) if len(table) else 0
        shared = above.column("proof")[0].as_py()
        first = table.column("index")[0].as_py() if len(table) else 0
        proofs = []
        for i, path in enumerate(traverse(table.column("digest").to_pylist(), own)):
            steps = [{"sibling": s, "on_left": bool((first + i) >> h & 1)} for h, s in enumerate(path)]
            proofs.append(steps + shared)
        ends = {c: pa.array([above.column(c)[0].as_py()] * len(table), pa.string()) for c in ("subroot", "root")}
        out = {f.name: table.column(f.name) for f in fields} | ends | {"proof": pa.array(proofs, kind)}
        return pa.table(out)

    blocks = _with_block(nodes, height).groupBy("group", "block")
    return blocks.cogroup(upper.withColumnRenamed("index", "block").groupBy("group", "block")).applyInArrow(walk, schema)


def tree(nodes: DataFrame, height: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of block roots over nodes(group, index, n, digest), lowest first, and the one
    node that is left of each group. Only the size of the largest group goes to the driver."""
    levels, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(stored(block_roots(levels[-1], height), name))
        most = -(-most >> height)
    return levels[:-1] if len(levels) > 1 else [], levels[-1].select("group", "digest")


def manifest(docs: DataFrame, extra: dict[str, Column] | None = None, height: int = BLOCK_HEIGHT) -> DataFrame:
    """doc_id, lang, index, n, leaf, subroot, root, proof for each row of docs; `extra` columns too.

    A row's leaf covers FIELDS (other columns are not read). Leaves of a language ascend by
    doc_id (null first; of equal ids by digest, so that the order of rows plays no part) under its
    subroot; subroots in order of the language's bytes (null first) lie under the root. proof
    lists siblings from the leaf up with the side that they are on; a level where the node is
    alone has none. Null texts and empty ones have different leaves. Rows that repeat all FIELDS
    are leaves of their own, each with its place. A text is read once, where it lies, whatever
    its length. An empty table gives no rows.

    Blocks of 2**height nodes are traversed each by one task, level upon level, so languages of
    any size (one may hold all rows) are dealt out evenly.
    """
    group = F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("lang")))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", group.alias("group"), leaf_digest({c: F.col(c) for c in FIELDS}).alias("digest"),
        *(c.alias(k) for k, c in (extra or {}).items()),
    )
    spark = docs.sparkSession
    leaves = settled(spark, lambda: numbered(stored(base, "merkle-leaves"), ["doc_id", "digest"], "merkle-ranges"), "merkle-nodes")
    levels, subroots = tree(leaves, height, "merkle-levels")
    named = subroots.select(F.lit("").alias("group"), F.col("group").alias("key"), F.col("digest"))
    langs = stored(numbered(named, ["key"], "merkle-subroots"), "merkle-langs")
    top_levels, root = tree(langs, height, "merkle-top")
    none = F.array().cast(PROOF)
    upper = root.select("group", F.lit(0).cast("long").alias("index"), F.lit("").alias("subroot"), F.col("digest").alias("root"), none.alias("proof"))
    for nodes in reversed(top_levels or [langs]):
        upper = descend(nodes, upper, height)
    # below a language's subroot its path is shared by all of its leaves
    upper = upper.select(F.col("key").alias("group"), F.lit(0).cast("long").alias("index"), F.col("digest").alias("subroot"), "root", "proof")
    for nodes in reversed(levels[1:]):
        upper = descend(nodes, upper, height).select("group", "index", "subroot", "root", "proof")
    out = descend(leaves, stored(upper, "merkle-upper"), height)
    return out.select("doc_id", "lang", "index", "n", F.col("digest").alias("leaf"), "subroot", "root", "proof", *(extra or {}))


def tamper_check(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of docs.

    Where TAMPER divides the CRC-32 of the id, n_chars grows by 1 before the leaf is made again
    (null stays null, and a null id is not touched); folding it with the siblings of the manifest
    then leads to another root, and verified is false.
    """
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % TAMPER == 0, F.lit(False))
    changed = {c: F.col(c) for c in FIELDS} | {"n_chars": F.when(touched, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = manifest(docs, {"shown": F.when(touched, leaf_digest(changed))})
    back = found.withColumn("folded_root", folded(F.coalesce("shown", "leaf"), F.col("proof")))
    return back.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


_LEAF = "sha256({})".format(" || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in FIELDS))
SQL = f"""
WITH RECURSIVE base AS (
  SELECT *, list_transform(range(8 * length(doc_id::VARCHAR)), lambda i: (ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1)) >> (i % 8)::INT) & 1) AS bits FROM documents),
summed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bits::BIGINT[]),
           lambda c, b: xor(c >> 1, CASE WHEN xor(c & 1, b) = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS crc FROM base),
leaves AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS key, {_LEAF} AS leaf,
         CASE WHEN crc % {TAMPER} = 0 THEN {_LEAF.replace("n_chars::", "(n_chars + 1)::")} END AS shown
  FROM summed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM leaves),
nodes(level, key, idx, n, h) AS (
  SELECT 0, key, idx, n, leaf FROM placed
  UNION ALL
  SELECT level + 1, key, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY level, key, idx // 2, n),
langs AS (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, idx, n, h) AS (
  SELECT 0, idx, n, h FROM langs
  UNION ALL
  SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 2, n),
numbered AS (SELECT *, row_number() OVER (ORDER BY key, idx) AS doc FROM placed),
up(doc, key, level, idx, n, proof, h) AS (
  SELECT doc, key, 0, idx, n, '', coalesce(shown, leaf) FROM numbered
  UNION ALL
  SELECT doc, u.key, u.level + 1, u.idx // 2, (u.n + 1) // 2, proof || coalesce(s.h, ''), sha256(CASE WHEN u.idx % 2 = 1 THEN s.h || u.h ELSE u.h || coalesce(s.h, '') END)
  FROM up u LEFT JOIN nodes s ON s.key = u.key AND s.level = u.level AND s.idx = xor(u.idx, 1) WHERE u.n > 1),
over(doc, level, idx, n, proof, h) AS (
  SELECT doc, 0, l.idx, l.n, proof, u.h FROM up u JOIN langs l USING (key) WHERE u.n = 1
  UNION ALL
  SELECT doc, o.level + 1, o.idx // 2, (o.n + 1) // 2, proof || coalesce(s.h, ''), sha256(CASE WHEN o.idx % 2 = 1 THEN s.h || o.h ELSE o.h || coalesce(s.h, '') END)
  FROM over o LEFT JOIN tops s ON s.level = o.level AND s.idx = xor(o.idx, 1) WHERE o.n > 1)
SELECT p.doc_id, p.leaf, l.h AS subroot, r.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = r.h AS verified
FROM over o JOIN numbered p USING (doc) JOIN langs l ON l.key = p.key, (SELECT h FROM tops WHERE n = 1) r
WHERE o.n = 1
"""
