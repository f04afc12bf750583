"""N-gram Jaccard join: documents whose word-shingle sets are alike, and what they connect.

Sets are 64-bit hashes of shingles in sorted arrays. Sizes fall into bands; a tile takes one
band and what the next band holds within reach. Within a tile two sets that link differ in at
most k shingles, so of k + 1 segments of the hash range one is the same in both: its hash is
the key under which they meet, and no pair that links is lost. Where they meet, bitmaps of
parities bound the overlap from above by bit counts, and what remains is intersected exactly.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marked, settled, stored, text_batches, trim, worker_state

#: Upper end of a band over its lower end.
BAND = 1.5
#: One segment more for this many differences: room for empty segments.
SPARE = 6
#: Bits of a bitmap for each difference that a link allows, at least.
ROOM = 8
#: Words of a sketch, which goes along under each key; no bitmap is shorter.
SKETCH = 8
#: Entries of a worker's memory of word hashes; it starts anew beyond that.
MEMORY = 300_000
#: Rounds in which a key's most connected set meets the rest of the key, before tiles compare
#: what is still apart under a key.
HUBS = 3
#: Sets of a tile, and pairs that a worker holds before it drops repeated ones.
TILE, FLUSH = 512, 1_000_000


class Shingler(dict):
    """Word -> 64-bit hash, and texts -> sorted arrays of distinct shingle hashes."""

    def __missing__(self, word):
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value

    def shingles(self, text: str, words: int):
        import numpy as np

        parts = text.encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII blanks part
        if not parts:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, parts), np.uint64, len(parts))
        n = max(1, len(parts) - words + 1)
        width = min(words, len(parts))
        total = np.full(n, width * 0x9E37, np.uint64)
        for k in range(width):
            total = mixed(total + h[k : k + n])
        return np.unique(total)


def mixed(x):
    """A bijection of 64-bit numbers that spreads every bit."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bands(percent: int, most: int = 1 << 40) -> list[int]:
    """Lower ends of the bands: each BAND times the one before, and at least beyond its reach."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(int(ends[-1] * BAND), ends[-1] * 100 // percent + 1))
    return ends


def differences(upper: int, percent: int) -> int:
    """The most shingles in which two linked sets differ, if the smaller has fewer than upper.

    |A - B| + |B - A| <= (|A| + |B|) (100 - p) / (100 + p), and |B| <= 100 |A| / p.
    """
    return (upper - 1) * (100 - percent) // percent


def keys_of(sorted_hashes, percent: int, ends: list[int]):
    """The keys under which a set meets others: hashes of its segments in its tiles.

    Of m segments at least m - k are the same in both of a linked pair. m is so much above k
    that in nearly all sets fewer than m - k are empty, so that one that is the same holds
    something. Only sets with more empty segments than that can miss each other; they are cut
    once more by another hash for each empty segment, and meet if a second segment agrees.
    """
    import bisect

    import numpy as np

    size = len(sorted_hashes)
    band = bisect.bisect_right(ends, size) - 1
    tiles = [band] if band == 0 or size * percent >= 100 * ends[band] else [band - 1, band]
    out = []
    for tile in tiles:
        k = differences(ends[tile + 1], percent)
        if k == 0:  # only equal sets link, and those are one already
            continue
        m = k + 1 + k // SPARE
        first, empty = segment_sums(sorted_hashes, m, tile * 2 + 1)
        out.append(first)
        if len(empty) >= m - k:
            other = np.sort(mixed(sorted_hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
            second, blank = segment_sums(other, m, tile * 2 + 2)
            both = np.concatenate([second, mixed(blank.astype(np.uint64) + np.uint64(tile << 32))])
            out += [mixed(both + np.uint64(int(e) * 2 + 1)) for e in empty]
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def segment_sums(sorted_hashes, m: int, salt: int):
    """Hashes of the segments of a sorted set that hold anything, and the numbers of the rest."""
    import numpy as np

    segment = ((sorted_hashes >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    sums = np.add.reduceat(mixed(sorted_hashes + np.uint64(salt)), starts)
    present = segment[starts]
    key = mixed(sums + present * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt << 40))
    gone = np.ones(m, bool)
    gone[present.astype(np.int64)] = False
    return key, np.flatnonzero(gone)


def parity_words(hashes, percent: int):
    """A bitmap, as longs, in which each hash flips one bit: two bitmaps of one length differ in
    no more bits than their sets differ in elements.

    It has ROOM bits for each difference that a link allows, so that few differences meet in
    one bit and sets that are just not alike enough still show it. Lengths are powers of two:
    the exclusive or of a bitmap's halves is the bitmap of half its length.
    """
    import numpy as np

    allowed = 2 * len(hashes) * (100 - percent) // (100 + percent)
    bits = max(64 * SKETCH, 1 << (ROOM * allowed).bit_length())
    counts = np.bincount((mixed(hashes + np.uint64(77)) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1).view(np.int64)


def may_link(n_a, n_b, bits_a, bits_b, percent: int):
    """Column: whether bit counts leave room for a link. Overlap <= (n_a + n_b - apart) / 2.

    Of two bitmaps the longer is folded to the length of the other; lengths further apart than
    that leave the difference of the sizes.
    """
    words_a, words_b = F.size(bits_a), F.size(bits_b)

    def folded(words, n, other):
        half = (n / 2).cast("int")
        return F.when(n == 2 * other, F.zip_with(F.slice(words, 1, half), F.slice(words, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(words)

    left, right = folded(bits_a, words_a, words_b), folded(bits_b, words_b, words_a)
    apart = F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    apart = F.when((words_a <= 2 * words_b) & (words_b <= 2 * words_a), apart).otherwise(F.abs(n_a - n_b).cast("int"))
    total = n_a + n_b
    near = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    return near & (100 * (total - apart) >= percent * (total + apart))


def sketch(bits):
    """Columns s0, s1, ...: a bitmap folded to SKETCH words, whatever the set's size."""
    fold = "aggregate(sequence(0, size({0}) DIV {1} - 1), 0L, (s, j) -> s ^ {0}[j * {1} + {2}])"
    return {f"s{k}": F.coalesce(F.expr(fold.format(bits, SKETCH, k)), F.lit(0)) for k in range(SKETCH)}


def tile_pairs(batches, percent: int):
    """mapInArrow: rows (key, i, j, part, node, component, n, s0, ...), sorted by (key, i, j), one
    tile each -> pairs (a, b) of a tile whose sketches leave room for a link.

    A tile with i = j holds one part of a key's sets and compares all of it; one with i < j
    compares two parts with each other. Bit counts are those of may_link(). A pair that several
    tiles of a task hold comes out once (or once for every FLUSH pairs); no pair that the bit
    counts rule out leaves the worker.
    """
    import numpy as np
    import pyarrow as pa

    found, held = [], 0

    def compare(part, node, component, n, words):
        order = np.argsort(part, kind="stable")
        part, node, component, n, words = part[order], node[order], component[order], n[order], words[order]
        last = len(part)
        first = int(np.searchsorted(part, part[-1])) if part[0] != part[-1] else 0
        for low in range(0, first or last, 64):
            high = min(low + 64, first or last)
            right = first or low
            apart = np.bitwise_count(words[low:high, None, :] ^ words[None, right:, :]).sum(axis=2, dtype=np.int64)
            small, large = np.minimum(n[low:high, None], n[None, right:]), np.maximum(n[low:high, None], n[None, right:])
            ok = (100 * small >= percent * large) & ((100 + percent) * apart <= (100 - percent) * (small + large))
            ok &= component[low:high, None] != component[None, right:]
            if not first:
                ok &= np.arange(low, high)[:, None] < np.arange(right, last)[None, :]
            x, y = np.nonzero(ok)
            if len(x):
                x, y = node[low + x], node[right + y]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))

    def drained():
        rows = np.concatenate(found)
        found.clear()
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        rows = rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]]
        return rows, pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["a", "b"])

    rest = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
        key, i, j = columns[:3]
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        ends = cuts.tolist()
        for low, high in zip([0, *ends], ends):
            if high - low > 1:
                compare(*(c[low:high] for c in columns[3:7]), np.stack([c[low:high] for c in columns[7:]], 1).view(np.uint64))
        rest = [c[ends[-1] :] if ends else c for c in columns]
        if sum(map(len, found)) - held > FLUSH:
            rows, out = drained()
            if len(rows) > FLUSH:
                held = 0
                yield out
            else:
                found.append(rows)
                held = len(rows)
    if rest is not None and len(rest[0]) > 1:
        compare(*rest[3:7], np.stack(rest[7:], 1).view(np.uint64))
    if found:
        yield drained()[1]


def one_key_each(members: DataFrame) -> DataFrame:
    """(key, node) with one key of those that the very same nodes share: they meet under it."""
    own = members.groupBy("key").agg(
        F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.expr("bit_xor(xxhash64(node, 7))").alias("mix")
    )
    chosen = own.filter("size > 1").groupBy("size", "sum", "mix").agg(F.min("key").alias("key")).select("key")
    return members.join(stored(chosen, "join-keys"), "key").select("key", "node")


def linked(a, b, percent: int) -> bool:
    """Whether two sorted sets are at least percent alike."""
    import numpy as np

    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an edge table (a, b): least node reachable, by spreading the least
    label and then taking the label's label, until nothing changes."""
    both = stored(
        edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct(), "join-edges"
    )
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "join-labels")
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("label").alias("their"))
        spread = both.join(theirs, "other").groupBy("node").agg(F.min("their").alias("least"))
        lower = labels.join(spread, "node").select("node", "label", F.least("label", "least").alias("least"))
        up = labels.select(F.col("node").alias("least"), F.col("label").alias("jump"))
        jumped = stored(
            lower.join(up, "least", "left").select("node", F.least("least", "jump").alias("new"), "label"), "join-labels"
        )
        changed = jumped.filter("new <> label").limit(1).count()
        labels = jumped.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of `labels` with more links (a, b): only components that a new link
    joins are gone through again, not the links that they came from."""

    def place(rows: DataFrame, end: str) -> DataFrame:
        known = labels.select(F.col("node").alias(end), F.col("component").alias("known"))
        return rows.join(known, end, "left").withColumn(end, F.coalesce("known", end)).drop("known")

    between = stored(components(place(place(links, "a"), "b").filter("a <> b")), "join-between")
    further = between.select(F.col("node").alias("component"), F.col("component").alias("further"))
    moved = labels.join(further, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
    return moved.union(between.join(labels.select("node"), "node", "left_anti").select("node", "component"))


def ngram_join(
    docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """_joined() with its intermediate tables deleted: see there."""
    return settled(docs.sparkSession, lambda: _joined(docs, words, percent, id_col, text_col), "join-result")


def _joined(
    docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    Words are runs of anything but ASCII white space, with A-Z in lower case; a set holds the
    distinct shingles of `words` words, or the whole sequence of a shorter text. Two documents
    link when 100 * intersection >= percent * union; a component is all that links reach, named
    by its least id. Null and empty texts have no shingles and link with nothing. Rows with a
    null id link with nothing (component null). Rows that repeat an id with other texts keep
    each its own set and its links; what they reach is one component, as they share a document.
    An empty table gives no rows.

    The nodes are distinct sets (128 bits of sums of hashes), so copies are one before anything
    meets, and of keys with the same sets one is left. In each of HUBS rounds the set that meets
    most in all meets the rest of its key, and what links to it is one from then on; so copies
    of a text with small changes cost a row each for a key and not the square. Then all that is
    still apart under a key is compared in tiles of bounded size by bit counts. Nothing is
    dropped: every pair under a key is one component or compared.
    """
    text_batches(docs.sparkSession)
    ends = bands(percent)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def sums(sets):
        import numpy as np
        import pyarrow as pa

        return [pa.array([mixed(s + np.uint64(i)).sum(dtype=np.uint64).astype(np.int64) if len(s) else None for s in sets], pa.int64()) for i in (1, 2)]

    def describe(batches):
        import numpy as np
        import pyarrow as pa

        def lists(arrays):
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))

        shingler, none = worker_state("shingler", Shingler), np.zeros(0, np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sets = [shingler.shingles(text, words) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(s) for s in sets], pa.int64()), *sums(sets),
                        lists([parity_words(s, percent) if len(s) else none for s in sets]),
                        lists([keys_of(s, percent, ends) if len(s) else none for s in sets]),
                    ],
                    ["doc_id", "n_shingles", "h1", "h2", "bits", "keys"],
                )
        trim()

    described = stored(
        base.mapInArrow(describe, "doc_id long, n_shingles long, h1 long, h2 long, bits array<long>, keys array<long>"), "join-sets"
    )
    slim = described.select("doc_id", "n_shingles", "h1", "h2")
    named = described.filter("doc_id IS NOT NULL AND h1 IS NOT NULL")
    classes = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id())
    classes = stored(classes, "join-classes")
    # texts of one id are one document: their sets are linked from the start
    twice = named.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).filter("x <> y").select("doc_id")
    twice = stored(twice, "join-twice")
    labels = None
    if twice.limit(1).count():
        of_id = marked(named.select("doc_id", "h1", "h2"), twice, "doc_id").join(twice, "doc_id").distinct().join(classes, ["h1", "h2"])
        first = of_id.groupBy("doc_id").agg(F.min("node").alias("a"))
        labels = components(of_id.join(first, "doc_id").filter("a <> node").select("a", F.col("node").alias("b")))
    meets = named.select(F.explode("keys").alias("key"), "h1")
    shared = meets.groupBy("key").agg(F.min("h1").alias("least"), F.max("h1").alias("most")).filter("least <> most").select("key")
    shared = stored(shared, "join-shared")
    live = marked(meets, shared, "key").join(shared.hint("merge"), "key").distinct().join(classes, "h1").select("key", "node")
    live = stored(one_key_each(stored(live, "join-meets")), "join-live")
    of_node = live.select("node").distinct().join(classes, "node").select("node", "h1", "h2", "least")
    of_node = stored(of_node, "join-nodes")
    described_ids = of_node.select(F.col("least").alias("doc_id")).distinct()
    bits = marked(named.select("doc_id", "h1", "h2", "n_shingles", "bits"), described_ids, "doc_id")
    bits = bits.join(of_node.select("node", "h1", "h2", F.col("least").alias("doc_id")), ["doc_id", "h1", "h2"]).groupBy("node")
    bits = stored(bits.agg(F.max(F.struct(F.col("n_shingles").alias("n"), "bits")).alias("x")).select("node", "x.*").withColumns(sketch("bits")), "join-bits")

    def arrays(batches):
        import pyarrow as pa

        shingler = worker_state("shingler", Shingler)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sets = [shingler.shingles(t, words) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*sums(sets), pa.array([s.tobytes() for s in sets], pa.binary())], ["h1", "h2", "hashes"])

    def verify(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def side(table: DataFrame, name: str) -> DataFrame:
        return table.select(*(F.col(c).alias(name if c == "node" else f"{c}_{name}") for c in table.columns))

    whole = bits.select("node", "n", "bits")
    fields = ["n", *(f"s{k}" for k in range(SKETCH))]
    room = may_link(F.col("n_a"), F.col("n_b"), F.col("bits_a"), F.col("bits_b"), percent)
    for turn in range(HUBS + 1):
        at = live.withColumn("component", F.col("node")) if labels is None else live.join(labels, "node", "left").select(
            "key", "node", F.coalesce("component", "node").alias("component")
        )
        if turn or labels is not None:
            open_keys = at.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
            at = at.join(stored(open_keys, "join-open"), "key")
        at = stored(at, "join-live")
        crowd = stored(at.groupBy("key").agg(F.count("*").alias("crowd")), "join-crowd")
        if turn < HUBS:
            degree = at.join(crowd, "key").groupBy("node").agg(F.sum("crowd").alias("degree"))
            hubs = at.join(stored(degree, "join-degree"), "node").groupBy("key").agg(F.max(F.struct("degree", "node", "component")).alias("hub"))
            hubs = stored(hubs.select("key", F.col("hub.node").alias("hub"), F.col("hub.component").alias("hub_component")), "join-hubs")
            met = at.join(hubs, "key")
            pairs = met.filter("component <> hub_component").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
            live = stored(met.filter("node <> hub").select("key", "node"), "join-rest")
        else:
            tiles = F.ceil(F.col("crowd") / TILE).cast("int")
            part = F.pmod(F.xxhash64("node", "key"), F.col("tiles")).cast("int")
            dealt = (
                at.join(crowd, "key").join(bits.select("node", *fields), "node").withColumn("tiles", tiles).withColumn("part", part)
                .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
                .select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "component", *(F.coalesce(f, F.lit(0)).alias(f) for f in fields))
                .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            )
            pairs = dealt.mapInArrow(lambda batches: tile_pairs(batches, percent), "a long, b long")
        near = pairs.distinct().join(side(whole, "a"), "a").join(side(whole, "b"), "b").filter(room)
        near = stored(near.select("a", "b"), "join-pairs")
        if near.limit(1).count():
            wanted = stored(near.select(F.col("a").alias("node")).union(near.select("b")).distinct().join(of_node, "node"), "join-wanted")
            ids = stored(wanted.select(F.col("least").alias("doc_id")).distinct(), "join-ids")
            sets = marked(base, ids, "doc_id").join(ids.hint("merge"), "doc_id").select("text").mapInArrow(arrays, "h1 long, h2 long, hashes binary")
            sets = stored(sets.join(wanted, ["h1", "h2"]).groupBy("node").agg(F.min("hashes").alias("hashes")), "join-arrays")
            found = near.join(side(sets, "a"), "a").join(side(sets, "b"), "b").select("a", "b", "hashes_a", "hashes_b")
            found = stored(found.mapInArrow(verify, "a long, b long").distinct(), "join-links")
            if found.limit(1).count():
                labels = stored(components(found) if labels is None else extended(labels, found), "join-components")
        if not live.limit(1).count():
            break
    if labels is None:
        labels = classes.limit(0).select("node", F.col("node").alias("component"))
    reached = labels.join(classes, "node")
    least = reached.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = stored(reached.join(least, "component").select("h1", "h2", "component_id"), "join-named")
    # sets that link with nothing keep the least id of their own class
    of_class = classes.join(of_class, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("component_id", "least").alias("component_id"))
    out = slim.join(stored(of_class, "join-classed"), ["h1", "h2"], "left")
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
