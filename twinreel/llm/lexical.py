"""Ranked lexical search: MaxScore in each shard of documents, best scores of all shards merged."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_batches, trim

#: Results for each query.
BEST = 10
#: Bytes of queries that are searched for at once (one longer query is a block of its own), and of
#: texts in a shard; a shard's postings are held by one task.
QUERY_BYTES, SHARD_BYTES = 4_000_000, 16_000_000
#: Bytes of a text that are cut into terms at once.
SLICE = 1_000_000
#: Bytes of terms: letters, digits and all beyond ASCII, capitals A-Z as small ones; others are blanks.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(data: bytes) -> Iterator[list[bytes]]:
    """Lists of the terms of a text in UTF-8, in order. All bytes of characters beyond ASCII are
    term bytes, so terms of bytes are terms of characters."""
    if len(data) <= SLICE:
        yield data.translate(TERM_BYTES).split()
        return
    plain, at = data.translate(TERM_BYTES), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE)  # no term is cut
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, dict[bytes, int]]]]:
    """Blocks of (id, how often each term occurs) of bounded size, fetched a partition at a time."""
    block, size = [], 0
    for row in queries.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("data")).toLocalIterator():
        data = bytes(row["data"])
        if block and size + len(data) > QUERY_BYTES:
            yield block
            block, size = [], 0
        many: dict[bytes, int] = {}
        for some in terms(data):
            for t in some:
                many[t] = many.get(t, 0) + 1
        block.append((row["id"], many))
        size += len(data)
    if block:
        yield block


def corpus_counts(texts: DataFrame, known: dict[bytes, int]) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, terms in all, and for the numbers of known terms how many documents
    hold each. Every task adds up its own before rows move."""

    def run(batches):
        import pyarrow as pa

        total, length, df = 0, 0, [0] * len(known)
        for batch in batches:
            for data in batch.column(1):
                n, held = 0, set()
                for some in terms(data.as_py()):
                    n += len(some)
                    held.update(known.keys() & some)
                total, length = total + (n > 0), length + n
                for t in held:
                    df[known[t]] += 1
        found = [(i, n) for i, n in enumerate(df) if n] + [(-1, total), (-2, length)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["term", "n"])

    counted = {r["term"]: r["n"] for r in texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return counted.pop(-1, 0), counted.pop(-2, 0), counted


class Shard:
    """Postings of a shard's documents for the known terms: for each term its documents in order
    and the share of the term's weight that each adds to a score."""

    def __init__(self, known: dict[bytes, int], documents: int, length: int):
        self.known, self.documents, self.length = known, documents, length
        self.ids: list = []
        self.marks: list[int] = []  # 100 times the length penalty of each document
        self.codes: list = []
        self.bytes = 0

    def add(self, doc_id, data: bytes) -> None:
        import numpy as np

        n, found = 0, []
        for some in terms(data):
            n += len(some)
            found.append(np.array([self.known[t] for t in some if t in self.known], dtype=np.int64))
        if n:
            self.codes.append(np.concatenate(found) + (len(self.ids) << 32))
            self.ids.append(doc_id)
            self.marks.append(25 + 75 * n * self.documents // self.length)
        self.bytes += len(data)

    def postings(self) -> dict:
        """term -> (places of documents, shares in millionths, the greatest share)."""
        import numpy as np

        codes, tf = np.unique(np.concatenate([np.zeros(0, np.int64), *self.codes]), return_counts=True)
        if not len(codes):
            return {}
        doc, term = codes >> 32, codes & 0xFFFFFFFF
        share = 1_000_000_000 * tf // (1000 * tf + 8 * np.array(self.marks, dtype=np.int64)[doc])
        order = np.argsort(term, kind="stable")
        doc, term, share = doc[order], term[order], share[order]
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        ends = np.r_[starts[1:], len(term)]
        return {int(term[a]): (doc[a:b], share[a:b], int(share[a:b].max())) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}


def max_score(lists: list[tuple], floor: int) -> tuple:
    """(places, scores) of the documents whose score reaches `floor`.

    lists: (weight, places, shares, greatest share) of a query's terms. Terms are ordered by the
    most that they can add; the longest run of the weakest ones whose sum stays below the floor is
    non-essential: a document that holds none of the others cannot reach it. Documents of the
    essential lists are added up; non-essential lists are probed from the strongest to the
    weakest, only for documents that what is left can still bring to the floor.
    """
    import numpy as np

    ranked = sorted(lists, key=lambda x: x[0] * x[3])
    upto = np.cumsum([0] + [w * most for w, _, _, most in ranked], dtype=np.int64)  # what the first k can add
    first = max(0, int(np.searchsorted(upto, floor, side="left")) - 1)  # lists before it are non-essential
    if first >= len(ranked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    essential = ranked[first:]
    every = np.concatenate([p for _, p, _, _ in essential])
    places, at = np.unique(every, return_inverse=True)
    scores = np.zeros(len(places), np.int64)
    np.add.at(scores, at, np.concatenate([w * share for w, _, share, _ in essential]))
    for k in range(first - 1, -1, -1):
        able = scores + upto[k + 1] >= floor
        places, scores = places[able], scores[able]
        if not len(places):
            break
        w, held, share, _ = ranked[k]
        spot = np.minimum(np.searchsorted(held, places), len(held) - 1)
        scores = scores + np.where(held[spot] == places, w * share[spot], 0)
    able = scores >= max(floor, 1)
    return places[able], scores[able]


class Best:
    """The best results of one query so far: ids (null last among equal scores) and scores."""

    def __init__(self, size: int):
        self.size, self.held, self.floor = size, [], 1

    def add(self, ids: list, scores: list[int]) -> None:
        self.held = sorted([*self.held, *zip(scores, ids, strict=True)], key=lambda x: (-x[0], x[1] is None, x[1] or 0))[: self.size]
        if len(self.held) == self.size:
            self.floor = max(1, self.held[-1][0])  # an equal score may still come in by its id


def search_block(texts: DataFrame, block: list[tuple[int, dict[bytes, int]]], size: int) -> DataFrame:
    """item_id, query (its number in the block), doc_id, score: the best of each task's shards."""
    known: dict[bytes, int] = {}
    for _, many in block:
        for t in many:
            known.setdefault(t, len(known))
    documents, length, df = corpus_counts(texts, known)
    worth = {known[t]: weight(documents, df[known[t]]) for t in known if known[t] in df}
    asked = [(item, [(known[t], many * worth[known[t]]) for t, many in of.items() if worth.get(known[t])]) for item, of in block]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        best = [Best(size) for _ in asked]
        shard = Shard(known, documents, length)

        def close():
            nonlocal shard
            postings = shard.postings()
            for (_, wanted), kept in zip(asked, best, strict=True):
                lists = [(w, *postings[t]) for t, w in wanted if t in postings]
                if not lists:
                    continue
                places, scores = max_score(lists, kept.floor)
                if len(places) > size:  # all that equal the last one compete by their ids
                    least = np.partition(scores, -size)[-size]
                    places, scores = places[scores >= least], scores[scores >= least]
                kept.add([shard.ids[p] for p in places.tolist()], scores.tolist())
            shard = Shard(known, documents, length)

        for batch in batches:
            for doc_id, data in zip(batch.column(0), batch.column(1), strict=True):
                shard.add(doc_id.as_py(), data.as_py())
                if shard.bytes >= SHARD_BYTES:
                    close()
        close()
        rows = [(asked[q][0], q, doc, score) for q, kept in enumerate(best) for score, doc in kept.held]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "query", "doc_id", "score"])
        trim()

    return texts.mapInArrow(run, "item_id long, query long, doc_id long, score long")


def ranked_search(docs: DataFrame, queries: DataFrame, size: int = BEST, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for each query its `size` best documents with a score above 0.

    Scores are whole numbers; equal ones go by ascending doc_id (null last). Null and empty texts
    have no terms and are no documents; repeated rows are documents of their own, and repeated
    queries (or ids) have results of their own; a query without known terms has none. Empty
    tables give no rows. A long text is cut into terms slice by slice; the query table is read
    in blocks of bounded size, and each block makes two passes over all texts: one counts
    documents, lengths and the block's terms, one searches. Only counts of the block's terms go
    to the driver, and only `size` results of each query and task move.
    """
    spark: SparkSession = docs.sparkSession
    text_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    found = None
    for k, block in enumerate(query_blocks(queries, id_col, text_col)):
        some = search_block(texts, block, size).withColumn("block", F.lit(k))
        found = some if found is None else found.union(some)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("block", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).select("item_id", "rank", "doc_id", "score")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH asked AS (
  SELECT query, item_id, term, count(*) AS many
  FROM (SELECT row_number() OVER () AS query, item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
held AS (SELECT row_number() OVER () AS doc, doc_id, {_WORDS} AS words FROM documents),
texts AS (SELECT doc, doc_id, len(words)::BIGINT AS n FROM held WHERE len(words) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM texts),
postings AS (
  SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(words) AS term FROM held) SEMI JOIN asked USING (term) GROUP BY doc, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), total),
marks AS (SELECT doc, doc_id, 25 + (75 * n * docs) // length AS m FROM texts, total),
scores AS (
  SELECT query, item_id, doc, doc_id, sum(many * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN marks USING (doc) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= {BEST}
"""
