"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, marked, settled, stored, text_batches, trim

#: n-grams are of ORDER code points of CODE_BITS; documents are scored in blocks of BLOCK_CHARS.
ORDER, CODE_BITS, BLOCK_CHARS = 4, 21, 16_000_000
#: Code points that are read at once, whatever the length of texts.
SLICE = 500_000
#: Perplexities are compared in thousandths of their logarithm.
STEP = 1000
#: Documents outside these quantiles of the trusted texts of their language go; the upper bound also
#: leaves MARGIN times the distance from the median to it, as a small share has seen few texts.
LOW, HIGH, MARGIN = 0.003, 0.99, 0.25
#: One in HELD trusted documents, by a hash of the id, gives the upper threshold and trains nothing.
HELD = 4
#: A language with fewer held trusted documents goes by the threshold of all languages.
FEW = 8


def slices(texts: list[str], skip: list[bool] | None = None):
    """Lists of (number of the text, its part with the ORDER - 1 code points before it, or blanks),
    of about SLICE code points each. skip: texts that begin with the code points before them."""
    out, size = [], 0
    for i, text in enumerate(texts):
        text = text if skip and skip[i] else "\0" * (ORDER - 1) + text
        for low in range(0, max(1, len(text) - ORDER + 1), SLICE):
            part = text[low : low + SLICE + ORDER - 1]
            out.append((i, part))
            size += len(part)
            if size >= SLICE:
                yield out
                out, size = [], 0
    if out:
        yield out


def code_grams(parts: list[str], places: bool = False):
    """before, code, counts or places, sizes: the distinct n-grams of parts, one for each code
    point after the first ORDER - 1: the three before as one number, the code point, and how often
    each occurs, or which one each place has; and the parts' lengths without the first."""
    import numpy as np

    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(x) - ORDER + 1 for x in parts], dtype=np.int64)
    inside = np.ones(len(codes), dtype=bool)
    inside[(np.r_[0, np.cumsum(sizes + ORDER - 1)[:-1]][:, None] + np.arange(ORDER - 1)).ravel()[: len(parts) * (ORDER - 1)]] = False
    known, number = np.unique(codes, return_inverse=True)
    # numbers of code points fit 16 bits unless a few parts have more than 65,536 different ones
    if small := len(known) <= 1 << 16:
        one = number.astype(np.uint64)
        keys = one.copy()
        for k in range(1, ORDER):
            keys[k:] |= one[:-k] << np.uint64(16 * k)
        keys = keys[inside]
    else:
        keys = np.stack([np.r_[np.zeros(k, np.uint32), codes[: len(codes) - k]] for k in range(ORDER - 1, -1, -1)], 1)[inside]
    unique, found = np.unique(keys, axis=None if small else 0, **{"return_inverse" if places else "return_counts": True})
    part = (lambda k: known[(unique >> np.uint64(16 * k)) & np.uint64(0xFFFF)].astype(np.int64)) if small else lambda k: unique[:, ORDER - 1 - k].astype(np.int64)
    before = np.zeros(len(unique), dtype=np.int64)
    for k in range(ORDER - 1, 0, -1):
        before = (before << CODE_BITS) | part(k)
    return before, part(0), found.ravel(), sizes


def gram_counts(texts: DataFrame) -> DataFrame:
    """before, code, n: the n-grams of all rows of texts(text, sign), those of sign -1 taken off,
    summed in shards by n-gram."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                signs = part.column(1).to_pylist()
                for sign in (1, -1):
                    of = [t for t, s in zip(part.column(0).to_pylist(), signs, strict=True) if s == sign]
                    for some in slices(of):
                        before, code, n, _ = code_grams([x for _, x in some])
                        yield pa.RecordBatch.from_arrays([pa.array(before), pa.array(code), pa.array(n * sign, pa.int64())], ["before", "code", "n"])

    counted = texts.mapInArrow(count, "before long, code long, n long").groupBy("before", "code").agg(F.sum("n").alias("n"))
    return counted.filter("n > 0")


def _suffix(before, size: int):
    return before.bitwiseAND(F.lit((1 << (CODE_BITS * size)) - 1))


def gram_tables(counts: DataFrame) -> tuple[list, list, float]:
    """For each order: the probabilities (before, code, p) of its n-grams and the share (before,
    left) that each context leaves to the next lower order; last the probability below all.

    counts: before, code, n of the highest order; lower orders count distinct left neighbours.
    Each order has its three discounts from its counts of counts, and a context leaves what is
    taken off to the next lower order; below the unigrams all symbols are alike. The tables are
    sharded by n-gram and grow with the text.
    """
    levels = [stored(counts, "quality-grams")]
    for size in range(ORDER - 2, -1, -1):
        lower = levels[0].groupBy(_suffix(F.col("before"), size).alias("before"), "code").agg(F.count("*").alias("n"))
        levels.insert(0, stored(lower, "quality-grams"))
    below = 1 / (levels[0].count() + 1)
    grams, contexts = [], []
    for size, level in enumerate(levels):
        many = level.agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
        n1, n2, n3, n4 = many
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        d = [min(max(k - (k + 1) * y * b / a, 0.0), k) if a else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        off = F.when(F.col("n") == 1, F.lit(float(d[0]))).when(F.col("n") == 2, F.lit(float(d[1]))).otherwise(F.lit(float(d[2])))
        sums = level.groupBy("before").agg(F.sum("n").alias("total"), F.sum(off).alias("off"))
        sums = stored(sums.select("before", "total", (F.col("off") / F.col("total")).alias("left")), "quality-contexts")
        lower = F.lit(below)
        rows = level.join(sums, "before")
        if grams:
            rows = rows.withColumn("low", _suffix(F.col("before"), size - 1)).join(grams[-1].select(F.col("before").alias("low"), "code", F.col("p").alias("p_low")), ["low", "code"])
            lower = F.col("p_low")
        p = (F.col("n") - off) / F.col("total") + F.col("left") * lower
        grams.append(stored(rows.select("before", "code", p.alias("p")), "quality-chances"))
        contexts.append(sums.select("before", "left"))
    return grams, contexts, below


def gram_costs(asked: DataFrame, model: tuple[list, list, float]) -> DataFrame:
    """before, code, cost: negative log probabilities of n-grams, seen or not."""
    grams, contexts, below = model
    out, p = asked, F.lit(below)
    for size, (chances, shares) in enumerate(zip(grams, contexts, strict=True)):
        key = f"before{size}"
        out = (
            out.withColumn(key, _suffix(F.col("before"), size))
            .join(chances.select(F.col("before").alias(key), "code", F.col("p").alias(f"p{size}")), [key, "code"], "left")
            .join(shares.select(F.col("before").alias(key), F.col("left").alias(f"left{size}")), key, "left")
        )
        p = F.coalesce(F.col(f"p{size}"), F.coalesce(F.col(f"left{size}"), F.lit(1.0)) * p)
    return out.select("before", "code", (-F.log(F.greatest(p, F.lit(1e-12)))).alias("cost"))


def gram_scores(base: DataFrame, model: tuple[list, list, float]) -> DataFrame:
    """doc_id, lang, n_symbols, cost for each row of base(doc_id, lang, text).

    Documents stay where they are read, in blocks of BLOCK_CHARS; a longer text is cut into parts,
    each with the code points before it, and the parts' costs are added up. A block's distinct
    n-grams are joined with the model and come back to it as one table, so that rows move for
    n-grams of blocks, not of documents, and no row holds more than the table of one block.
    """
    text_batches(base.sparkSession)
    whole = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "lang", "text")
    names = ["row", "doc_id", "lang", "skip", "text"]

    def pack(batches):
        import pyarrow as pa

        rows, size = [], 0

        def packed():
            part = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()), strict=True)], names)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["rows"])

        for batch in batches:
            for k in range(batch.num_rows):
                row, doc_id, lang, text = (batch.column(c)[k].as_py() for c in range(4))
                for low in range(0, max(1, len(text)), BLOCK_CHARS):
                    part = text[max(0, low - ORDER + 1) : low + BLOCK_CHARS]
                    if rows and size + len(part) > BLOCK_CHARS:
                        yield packed()
                        rows, size = [], 0
                    rows.append((row, doc_id, lang, low > 0, part))
                    size += len(part)
        if rows:
            yield packed()

    packed = whole.mapInArrow(pack, "rows binary")
    # blocks are stored once, compressed and dealt out by their number: only the tables move to them
    rows = bucketed(packed.select(F.monotonically_increasing_id().alias("block"), "rows"), "block", "quality-blocks")

    def ask(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                here = pa.ipc.open_stream(batch.column("rows")[k].as_buffer()).read_next_batch()
                text, skip = here.column("text"), here.column("skip").to_pylist()
                keys = np.zeros((0, 2), np.int64)
                for low in range(0, len(text), 1024):
                    for some in slices(text.slice(low, 1024).to_pylist(), skip[low : low + 1024]):
                        keys = unique_rows(np.concatenate([keys, np.stack(code_grams([x for _, x in some])[:2], 1)]))
                block = pa.array(np.full(len(keys), batch.column("block")[k].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([block, pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["block", "before", "code"])
        trim()

    def score(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                table = batch.column("table")[k].values
                columns = (table.field(x).to_numpy(zero_copy_only=False) for x in ("before", "code", "cost")) if table is not None else (np.zeros(0, np.int64),) * 3
                before, code, cost = columns
                order = np.lexsort((code, before))
                before, code, cost = before[order], code[order], cost[order]
                starts = np.flatnonzero(np.r_[True, before[1:] != before[:-1]][: len(before)])
                contexts = before[starts]
                place = (np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(before)])) << CODE_BITS) | code
                here = pa.ipc.open_stream(batch.column("rows")[k].as_buffer()).read_next_batch()
                text, skip = here.column("text"), here.column("skip").to_pylist()
                total, size = np.zeros(len(text)), np.zeros(len(text), np.int64)
                for low in range(0, len(text), 1024):
                    for some in slices(text.slice(low, 1024).to_pylist(), skip[low : low + 1024]):
                        b, c, of, sizes = code_grams([x for _, x in some], places=True)
                        each = cost[np.searchsorted(place, (np.searchsorted(contexts, b) << CODE_BITS) | c)][of] if len(b) else np.zeros(0)
                        at = np.array([low + i for i, _ in some])
                        np.add.at(size, at, sizes)
                        np.add.at(total, np.repeat(at, sizes), each)
                yield pa.RecordBatch.from_arrays([*(here.column(c) for c in names[:3]), pa.array(size, pa.int64()), pa.array(total)], [*names[:3], "n_symbols", "total"])
        trim()

    asked = stored(rows.mapInArrow(ask, "block long, before long, code long"), "quality-asked")
    costs = stored(gram_costs(asked.select("before", "code").distinct(), model), "quality-costs")
    tables = asked.join(costs, ["before", "code"]).groupBy("block").agg(F.collect_list(F.struct("before", "code", "cost")).alias("table"))
    parts = rows.join(tables.hint("merge"), "block", "left").select("rows", "table").mapInArrow(score, "row long, doc_id long, lang string, n_symbols long, total double")
    added = parts.groupBy("row", "doc_id", "lang").agg(F.sum("n_symbols").alias("n_symbols"), F.sum("total").alias("total"))
    return added.select("doc_id", "lang", "n_symbols", F.when(F.col("n_symbols") > 0, F.col("total") / F.col("n_symbols")).alias("cost"))


def unique_rows(keys):
    """The distinct rows of an array of two columns."""
    import numpy as np

    keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
    return keys[np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)][: len(keys)]]


def held(doc_id):
    return F.pmod(F.xxhash64(doc_id), F.lit(HELD)) == 0


def quality(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, kept for each row of docs.

    Trusted are the documents that labels.quality marks 1. One in HELD of them trains nothing and
    gives the upper threshold, as the model knows the others better than any text it has not seen:
    the high quantile of their log-perplexities and MARGIN of its distance from their median. The
    lower threshold is the low quantile of all trusted ones. Both are those of a document's
    language; a language with fewer than FEW held documents goes by those of all. A document
    between them is kept. Null and empty texts have perplexity null and are not kept. Without trusted text nothing can
    be judged and every text that is not empty is kept; where none is held, trained ones stand in.
    Null languages are a language; null ids are never trusted; repeated rows are ordinary rows.
    """
    return settled(docs.sparkSession, lambda: _quality(docs, labels, low, high), "quality-result")


def limits(trusted: DataFrame, low: float, high: float) -> DataFrame:
    """lang (null: all), n, least, most of trusted(lang, cost, held): thresholds in STEPs.

    Costs are counted in bins before anything moves, so quantiles cost a row for each bin.
    """
    one = F.col("held").cast("int")
    bins = trusted.groupBy("lang", F.floor(F.col("cost") * STEP).alias("bin")).agg(F.count("*").alias("n"), F.sum(one).alias("held"))
    both = bins.unionByName(bins.groupBy(F.lit(None).cast("string").alias("lang"), "bin").agg(F.sum("n").alias("n"), F.sum("held").alias("held")))
    of = Window.partitionBy("lang")
    both = both.withColumn("judges", F.when(F.sum("held").over(of) > 0, F.col("held")).otherwise(F.col("n")))
    upto = of.orderBy("bin")
    share = lambda c: F.sum(c).over(upto) / F.sum(c).over(of)
    first = lambda c, q: F.min(F.when(F.col(c) >= q, F.col("bin")))
    found = both.withColumn("share", share("n")).withColumn("judged", share("judges")).groupBy("lang").agg(
        F.sum("judges").alias("n"), first("share", low).alias("least"), first("judged", 0.5).alias("middle"), first("judged", high).alias("top")
    )
    return found.select("lang", "n", "least", (F.col("top") + F.ceil((F.col("top") - F.col("middle")) * MARGIN)).alias("most"))


def _quality(docs: DataFrame, labels: DataFrame, low: float, high: float) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    train = good.filter(~held(F.col("doc_id")))
    # trusted texts do not move: those that the bitmap lets through in error are counted and taken off
    may = marked(base, train, "doc_id")
    wrong = stored(may.select("doc_id").join(train.hint("merge"), "doc_id", "left_anti").distinct(), "quality-wrong")
    off = marked(base, wrong, "doc_id").join(wrong.hint("merge"), "doc_id", "left_semi")
    model = gram_tables(gram_counts(may.select("text", F.lit(1).alias("sign")).union(off.select("text", F.lit(-1)))))
    scored = stored(gram_scores(base, model), "quality-scores")
    trusted = scored.filter("cost IS NOT NULL").join(good, "doc_id", "left_semi").withColumn("held", held(F.col("doc_id")))
    bounds = stored(limits(trusted, low, high), "quality-limits")
    fallback = bounds.filter("lang IS NULL").agg(F.max("least").alias("least"), F.max("most").alias("most")).first()
    own = bounds.filter(F.col("lang").isNotNull() & (F.col("n") >= FEW)).select("lang", "least", "most")
    bin_ = F.floor(F.col("cost") * STEP)
    least, most = F.coalesce("least", F.lit(fallback["least"])), F.coalesce("most", F.lit(fallback["most"]))
    inside = F.coalesce((bin_ >= least) & (bin_ <= most), F.lit(True))
    return scored.join(own, "lang", "left").select(
        "doc_id", "lang", "n_symbols", F.exp("cost").alias("perplexity"), (F.col("cost").isNotNull() & inside).alias("kept")
    )
