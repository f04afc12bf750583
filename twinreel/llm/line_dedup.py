"""Line dedup over content-defined chunks of lines. DataFrame operations only.

Chunks are found by boundaries that rolling hashes choose. A passage that no whole chunk lies in
is found by its windows of two lines: matches grow line by line, and count from MIN_WORDS words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import marked, marked_left_join, salted_join, stored

#: A boundary follows a line when the first hex digit of its rolling hash is below this.
BOUNDARY_BELOW = "5"
#: A line of this many words is a chunk of its own: a whole passage in one line.
LONG_LINE = 50
#: Least words of a run of windows that are repeated one after the other.
MIN_WORDS = 50


def _chunks(text: Column, below: str, long_line: int) -> Column:
    """array<struct<start, lines, text>> of a text's chunks.

    The rolling hash of a line covers it and the line before; a boundary follows where that
    hash is low, and around every long line. Both look at neighbouring lines only, so an
    insertion elsewhere moves no boundary.
    """
    lines = F.split(text, "\n", -1)
    marked = F.transform(
        lines,
        lambda line: F.struct(
            line.alias("line"), F.md5(line).alias("h"), (F.size(F.split(F.trim(line), " ")) >= long_line).alias("long")
        ),
    )

    def cut(m: Column) -> Column:
        last = F.size(m) - 1

        def ends(i: Column) -> Column:
            here, before = F.get(m, i), F.get(m, i - 1)
            rolled = F.md5(F.concat(F.coalesce(before["h"], F.lit("")), here["h"]))
            low = F.substring(rolled, 1, 1) < below
            return (i == last) | low | here["long"] | F.coalesce(F.get(m, i + 1)["long"], F.lit(False))

        stops = F.filter(F.sequence(F.lit(0), last), ends)
        begins = F.concat(F.array(F.lit(0)), F.transform(F.slice(stops, 1, F.size(stops) - 1), lambda e: e + 1))
        spans = F.zip_with(begins, stops, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("lines")))
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"),
                s["lines"].alias("lines"),
                F.get(m, s["start"])["long"].alias("long"),
                F.array_join(F.transform(F.slice(m, s["start"] + 1, s["lines"]), lambda x: x["line"]), "\n").alias("chunk"),
            ),
        )

    # one-element transform: the marked lines are computed once, not for each use
    return F.get(F.transform(F.array(marked), cut), 0)


def _words(line: Column) -> Column:
    return F.size(F.split(F.trim(line), " "))


def _windows(text: Column, with_pair: bool) -> Column:
    """array<struct<start, h, words, next_words>> of the windows of two neighbouring lines, and
    with_pair their text."""

    def cut(lines: Column) -> Column:
        hashes = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), _words(x).alias("w")))

        def window(m: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.size(m) - 2),
                lambda i: F.struct(
                    i.alias("start"), F.xxhash64(F.get(m, i)["h"], F.get(m, i + 1)["h"]).alias("h"),
                    F.get(m, i)["w"].alias("words"), F.get(m, i + 1)["w"].alias("next_words"),
                ),
            )

        def pairs(x: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.size(x) - 2),
                lambda i: F.struct(
                    i.alias("start"), F.xxhash64(F.xxhash64(F.get(x, i)), F.xxhash64(F.get(x, i + 1))).alias("h"),
                    F.concat(F.get(x, i), F.lit("\n"), F.get(x, i + 1)).alias("chunk"),
                ),
            )

        return pairs(lines) if with_pair else F.get(F.transform(F.array(hashes), window), 0)

    lines = F.split(text, "\n", -1)
    found = F.get(F.transform(F.array(lines), cut), 0)
    return F.when(F.contains(text, F.lit("\n")), found)


def _by_bytes(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of found(h, chunk, doc_id, start): the hashes h under which all bytes are the same, and for
    the hashes that different chunks share the places (doc_id, sha, start) of all but the first of
    equal chunks. Chunks are combined in each task before they move."""
    texts = stored(found.groupBy("h", "chunk").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("texts")), name)
    shared = texts.filter("texts > 1").select("h")
    occurs = found.join(shared, "h", "left_semi")
    first = occurs.groupBy("h", "chunk").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first")).filter("n > 1")
    later = occurs.join(first, ["h", "chunk"]).filter(~_is_first()).select("doc_id", "sha", "start")
    return texts.filter("texts = 1").select("h"), later


def _is_first() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("start") == F.col("first.start"))


def _repeated(rows: DataFrame, name: str) -> DataFrame:
    """h, first, n of the hashes that occur more than once."""
    counted = rows.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("first"))
    return stored(counted.filter("n > 1").select("h", "first", "n"), name)


def _kept_lines(lines: Column, removed: Column) -> Column:
    """The lines outside the spans (start, lines). The places of lines that go are sorted once and
    become one mark for each line, so a text of many lines and spans costs no more than its sort."""
    spans = F.transform(removed, lambda r: F.sequence(r["start"], r["start"] + r["lines"] - 1))
    gone = F.array_sort(F.array_distinct(F.flatten(spans)))

    def marks(places: Column) -> Column:
        free = lambda x, k: x - F.coalesce(F.get(places, k - 1), F.lit(-1)) - 1
        return F.flatten(F.transform(places, lambda x, k: F.concat(F.array_repeat(F.lit(False), free(x, k)), F.array(F.lit(True)))))

    bound = F.get(F.transform(F.array(gone), marks), 0)  # one-element transforms: each is computed once
    return F.get(F.transform(F.array(bound), lambda m: F.filter(lines, lambda _, i: ~F.coalesce(F.get(m, i), F.lit(False)))), 0)


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_lines: int = 2,
    below: str = BOUNDARY_BELOW,
    long_line: int = LONG_LINE,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """doc_id, text, n_lines, n_removed for each row of docs.

    A chunk of min_lines lines, or one long line, that occurs more than once in all texts stays
    where (doc_id, line) is smallest and is removed elsewhere, if its bytes equal those of the
    one that stays. So is each window of two lines in a run of repeated windows, one line after
    the other, that holds min_words words: that way a passage goes whole, wherever boundaries
    fall. Null texts stay null with 0 lines; a null id orders first. Rows that repeat id and text
    are one document: what one keeps, the other keeps. An empty table gives no rows. All of a
    text that is removed leaves an empty one.

    Only hashes are grouped over all lines. Texts of chunks move only where their hash is
    repeated, once for each task; whole texts only of documents that lose lines.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = base.withColumn("sha", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    text = F.coalesce("text", F.lit(""))
    wide = (F.col("lines") >= min_lines) | F.col("long")
    chunks = keyed.select("doc_id", "sha", F.inline(_chunks(text, below, long_line))).filter(wide).withColumn("h", F.md5("chunk"))
    windows = keyed.select("doc_id", "sha", F.inline(_windows(F.col("text"), False)))

    repeats = _repeated(chunks.select("h", "doc_id", "start"), "line-repeats")
    # chunks that the bitmap lets through in error meet no repeated hash
    found = stored(marked(chunks.select("doc_id", "sha", "start", "lines", "h", "chunk"), repeats, "h"), "line-chunks")
    same, later = _by_bytes(found, "line-bytes")
    places = salted_join(found.select("h", "doc_id", "sha", "start", "lines"), repeats, ["h"], "n", ["doc_id", "start"]).filter(~_is_first())
    gone = places.join(same, "h", "left_semi").select("doc_id", "sha", "start", "lines")
    gone = gone.union(places.join(later, ["doc_id", "sha", "start"], "left_semi").select("doc_id", "sha", "start", "lines"))

    pairs = _repeated(windows.select("h", "doc_id", "start"), "line-pairs")
    at = salted_join(marked(windows, pairs, "h"), pairs, ["h"], "n", ["doc_id", "start"]).select("doc_id", "sha", "start", "h", "words", "next_words", _is_first().alias("stays")).distinct()
    number = F.row_number().over(Window.partitionBy("doc_id", "sha").orderBy("start"))
    runs = (
        at.withColumn("run", F.col("start") - number).groupBy("doc_id", "sha", "run")
        .agg(F.sum("words").alias("words"), F.max(F.struct("start", "next_words")).alias("last"), F.collect_list(F.struct("start", "h", "stays")).alias("windows"))
        .filter(F.col("words") + F.col("last.next_words") >= min_words)
    )
    held = stored(runs.select("doc_id", "sha", F.inline("windows")).filter("NOT stays").select("doc_id", "sha", "start", "h"), "line-windows")
    asked = stored(held.select("h").distinct(), "line-asked")
    texts = keyed.select("doc_id", "sha", F.inline(_windows(F.col("text"), True)))
    same, later = _by_bytes(marked(texts, asked, "h").join(asked.hint("merge"), "h", "left_semi"), "line-pair-bytes")
    grown = held.join(same, "h", "left_semi").select("doc_id", "sha", "start").union(held.join(later, ["doc_id", "sha", "start"], "left_semi").select("doc_id", "sha", "start"))

    removed = gone.union(grown.withColumn("lines", F.lit(2))).groupBy("doc_id", "sha").agg(F.collect_set(F.struct("start", "lines")).alias("removed"))
    key = lambda: F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.hex("sha")).alias("tw_key")
    joined = marked_left_join(keyed.select("doc_id", "text", key()), stored(removed.select(key(), "removed"), "line-removed"), "tw_key")
    lines = F.split("text", "\n", -1)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    kept = F.when(F.col("removed").isNotNull(), _kept_lines(lines, F.col("removed")))
    # used twice below, computed once here: as one expression in both places it is evaluated wrongly
    done = joined.select("doc_id", "text", n_lines.alias("n_lines"), kept.alias("kept"))
    return done.select(
        "doc_id",
        F.coalesce(F.array_join("kept", "\n"), "text").alias("text"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce(F.col("n_lines") - F.size("kept"), F.lit(0)).cast("long").alias("n_removed"),
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL),
marked AS (
  SELECT *, len(string_split(trim(line, ' '), ' ')) >= 50 AS long,
         coalesce(md5(lag(line) OVER w), '') AS before, coalesce(len(string_split(trim(lead(line) OVER w, ' '), ' ')) >= 50, false) AS long_next
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
cut AS (
  SELECT *, substr(md5(before || md5(line)), 1, 1) < '5' OR long OR long_next AS ends FROM marked),
numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM cut),
chunks AS (
  SELECT doc_id, k, min(pos) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS chunk
  FROM numbered GROUP BY doc_id, k HAVING count(*) >= 2 OR bool_or(long)),
gone AS (
  SELECT doc_id, k, n FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, start) AS r FROM chunks) WHERE r > 1),
windows AS (
  SELECT doc_id, pos, line || chr(10) || lead(line) OVER w AS pair, len(string_split(trim(line, ' '), ' ')) AS words,
         len(string_split(trim(lead(line) OVER w, ' '), ' ')) AS next_words
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
repeats AS (
  SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (
    SELECT *, count(*) OVER (PARTITION BY pair) AS n, row_number() OVER (PARTITION BY pair ORDER BY doc_id, pos) AS r FROM windows WHERE pair IS NOT NULL)
  WHERE n > 1),
runs AS (SELECT doc_id, run FROM repeats GROUP BY doc_id, run HAVING sum(words) + arg_max(next_words, pos) >= 50),
grown AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1]) AS pos FROM repeats JOIN runs USING (doc_id, run) WHERE r > 1),
lost AS (
  SELECT doc_id, pos FROM numbered JOIN gone USING (doc_id, k) UNION SELECT doc_id, pos FROM grown),
left_lines AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS text, count(*) AS n_lines, count(g.pos) AS n_removed
  FROM lines l LEFT JOIN lost g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(l.text, '') END AS text,
       coalesce(l.n_lines, 0)::BIGINT AS n_lines, coalesce(l.n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN left_lines l USING (doc_id)
"""
