"""Queries over the driver's tables, one or more for each operator family, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import scalars as S
from ..operators import filters as P
from ..operators import grouping as G
from ..operators import joins as J
from ..operators import ranking as R
from ..operators.tiles import gray_pairs as gray_tiles
from ..settings import Settings
from ..sources import sinks
from ..sources import tables as T
from ..streaming import ingest
from . import adapters as A

QUERIES: dict = {}
SQL: dict[str, str] = {}
_G, _E, _C = f"g AS ({A.GROUPS_SQL})", f"f AS ({A.FRAMES_SQL})", f"c AS ({A.CATALOG_SQL})"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- signatures, frames -------------------------------------------------------------------------

_SIG = (
    "s AS (SELECT idx, label, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN values[i] > (list_sort(values)[32] + list_sort(values)[33]) / 2 "
    "THEN (1::HUGEINT << (i - 1)::INT) ELSE 0::HUGEINT END))::HUGEINT AS u FROM f), "
    "sig AS (SELECT idx, label, u, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS phash FROM s)"
)


@query(f"WITH {_E}, {_SIG} SELECT idx, phash FROM sig")
def phash_signature(spark, sf):
    return A.frames(spark, sf).select("idx", K.median_signature(F.col("values")).alias("phash"))


@query(
    f"WITH {_E}, {_SIG} SELECT a.idx AS idx_a, b.idx AS idx_b, bit_count(xor(a.phash, b.phash))::INT AS bits FROM sig a JOIN sig b ON a.label = b.label AND a.idx < b.idx "
    "WHERE bit_count(xor(a.phash, b.phash)) <= 18"
)
def phash_pairs(spark, sf):
    bits = Settings(percent=71.875).phash_bits
    s = T.cut(A.frames(spark, sf).select("idx", "label", K.median_signature(F.col("values")).alias("phash")))
    pairs = J.pairs_within(s, ["label"], "idx").withColumn("bits", K.hamming(F.col("phash_a"), F.col("phash_b")))
    return pairs.filter(F.col("bits") <= bits).select("idx_a", "idx_b", "bits")


_NEAR = (
    "n AS (SELECT idx, phash FROM sig UNION ALL SELECT idx + 1000000, xor(phash, (1::BIGINT << (idx % 62)::INT)) FROM sig "
    "UNION ALL SELECT idx + 2000000, xor(phash, (1::BIGINT << (idx % 31)::INT) | (1::BIGINT << (idx % 31 + 31)::INT)) FROM sig)"
)


def _near_hashes(spark, sf):
    """Whole 64-bit hashes, and two variants of each that differ in one and in two bits."""
    s = A.frames(spark, sf).select("idx", K.median_signature(F.col("values")).alias("phash"))
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    at = F.col("idx") % 31
    one = s.select((F.col("idx") + 1000000).alias("idx"), F.col("phash").bitwiseXOR(bit(F.col("idx") % 62)).alias("phash"))
    two = s.select((F.col("idx") + 2000000).alias("idx"), F.col("phash").bitwiseXOR(bit(at).bitwiseOR(bit(at + 31))).alias("phash"))
    return T.cut(s.unionByName(one).unionByName(two))


@query(f"WITH {_E}, {_SIG}, {_NEAR} SELECT a.idx AS a, b.idx AS b, bit_count(xor(a.phash, b.phash))::INT AS bits FROM n a JOIN n b ON a.idx < b.idx WHERE bit_count(xor(a.phash, b.phash)) <= 3")
def phash_band_join(spark, sf):
    """Exact join of whole hashes within three bits by bands."""
    return J.hamming_join(_near_hashes(spark, sf), 3)


_DIFF = "list_sum(list_transform(range(1, 65), lambda i: abs(a.gray[i] - b.gray[i])))::DOUBLE / (64 * 256)"


@query(f"WITH {_E} SELECT a.idx AS idx_a, b.idx AS idx_b, round({_DIFF}, 6) AS difference FROM f a JOIN f b ON a.label = b.label AND a.idx < b.idx WHERE {_DIFF} <= 0.06000000238418579")
def gray_pairs(spark, sf):
    s = Settings(percent=94)
    pairs = gray_tiles(A.frames(spark, sf), s, ["label"], "idx", "gray")
    return pairs.select(F.col("a").alias("idx_a"), F.col("b").alias("idx_b"), F.round("difference", 6).alias("difference"))


_MASK = "list_filter(range(1, 65), lambda i: a.stretched[i] > 32 AND b.stretched[i] > 32 AND a.stretched[i] < 240 AND b.stretched[i] < 240)"
_MDIFF = f"list_sum(list_transform({_MASK}, lambda i: abs(a.stretched[i] - b.stretched[i])))::DOUBLE / (len({_MASK}) * 256)"


@query(f"WITH {_E} SELECT a.idx AS idx_a, b.idx AS idx_b, floor({_MDIFF} * 1000000)::BIGINT AS difference FROM f a JOIN f b ON a.label = b.label AND a.idx < b.idx WHERE len({_MASK}) > 0 AND {_MDIFF} <= 0.30000001192092896")
def gray_pairs_masked(spark, sf):
    s = Settings(percent=70, ignore_black_pixels=True, ignore_white_pixels=True)
    pairs = gray_tiles(A.frames(spark, sf), s, ["label"], "idx", "stretched")
    return pairs.select(F.col("a").alias("idx_a"), F.col("b").alias("idx_b"), F.floor(F.col("difference") * 1000000).alias("difference"))


_FLIP = "list_sum(list_transform(range(0, 64), lambda i: abs(a.gray[i // 8 * 8 + 8 - i % 8] - b.gray[i + 1])))::DOUBLE / (64 * 256)"


@query(
    f"WITH {_E}, d AS (SELECT a.idx AS idx_a, b.idx AS idx_b, {_DIFF} AS p, {_FLIP} AS m FROM f a JOIN f b ON a.label = b.label AND a.idx < b.idx) "
    "SELECT idx_a, idx_b, (m <= 0.06000000238418579 AND (p > 0.06000000238418579 OR m < p))::INT AS flags FROM d WHERE p <= 0.06000000238418579 OR m <= 0.06000000238418579"
)
def gray_flip_pairs(spark, sf):
    s = Settings(percent=94, compare_flipped=True)
    pairs = gray_tiles(A.frames(spark, sf), s, ["label"], "idx", "gray")
    return pairs.select(F.col("a").alias("idx_a"), F.col("b").alias("idx_b"), "flags")


@query(f"WITH {_E} SELECT idx, 100.0::DOUBLE / 64 * len(list_filter(stretched, lambda x: x <= 32)) < 20 AS bright FROM f")
def dark_frames(spark, sf):
    return A.frames(spark, sf).select("idx", K.is_bright(F.col("stretched"), 20).alias("bright"))


@query(f"WITH {_E} SELECT idx, list_transform(range(0, 64), lambda i: gray[i // 8 * 8 + 8 - i % 8]) AS mirrored FROM f")
def flipped_frames(spark, sf):
    return A.frames(spark, sf).select("idx", K.flip(F.col("gray"), 8).alias("mirrored"))


@query(f"WITH {_E} SELECT idx, list_transform(list_slice(values, 1, 12), lambda x: round(x / sqrt(list_sum(list_transform(list_slice(values, 1, 12), lambda y: y * y))), 6)) AS normal FROM f")
def normalised_chroma(spark, sf):
    normal = K.l2_normalised(F.slice("values", 1, 12))
    return A.frames(spark, sf).select("idx", F.transform(normal, lambda x: F.round(x, 6)).alias("normal"))


_PAIRS = [(a, b) for a, b in K.CHROMA_PAIRS]


@query(f"WITH {_E} SELECT idx, ({' + '.join(f'CASE WHEN values[{a + 1}] > values[{b + 1}] THEN {1 << i} ELSE 0 END' for i, (a, b) in enumerate(_PAIRS))})::BIGINT AS code FROM f")
def chroma_codes(spark, sf):
    return A.frames(spark, sf).select("idx", K.chroma_code(F.slice("values", 1, 12)).alias("code"))


@query(
    "SELECT user_id, (" + " + ".join(f"CASE WHEN sum((event_id * 40503 % 4294967296 >> {i}) & 1) >= count(*) // 2 + 1 THEN {1 << i} ELSE 0 END" for i in range(32)) + ")::BIGINT AS vote FROM events GROUP BY user_id"
)
def majority_votes(spark, sf):
    return T.read(spark, sf, "events").groupBy("user_id").agg(K.majority_vote(F.col("event_id") * 40503 % (1 << 32), 32).alias("vote"))


# ---- joins --------------------------------------------------------------------------------------

_TOL = "least(greatest({d} * 0.01, 5.0), 50.0)"


@query(
    "WITH d AS (SELECT doc_id AS idx, n_chars::DOUBLE AS duration FROM documents) SELECT a.idx AS idx_a, b.idx AS idx_b FROM d a JOIN d b ON a.idx < b.idx "
    f"WHERE abs(a.duration - b.duration) <= least({_TOL.format(d='a.duration')}, {_TOL.format(d='b.duration')})"
)
def band_join_duration(spark, sf):
    s = Settings(duration_percent=1, duration_min_s=5, duration_max_s=50)
    d = T.read(spark, sf, "documents").select(F.col("doc_id").alias("idx"), F.col("n_chars").cast("double").alias("duration"))
    return J.band_join(d, s).select("idx_a", "idx_b")


@query(
    f"WITH {_C}, k AS (SELECT idx, array_to_string(list_reverse(list_filter(string_split(lower(folder), '/'), lambda x: x <> ''))[1:1], '/') AS key FROM c) "
    "SELECT a.idx AS idx_a, b.idx AS idx_b FROM k a JOIN k b ON a.key = b.key AND a.idx < b.idx"
)
def folder_gate_same(spark, sf):
    c = A.catalog(spark, sf).select("idx", J.folder_key(F.col("folder"), 1).alias("key"))
    return J.pairs_within(c, ["key"], "idx").select("idx_a", "idx_b")


@query(None)
def partial_clip_pairs(spark, sf):
    """Documents found inside longer ones by sliding alignment (held to brute force in the tests)."""
    found = J.partial_clips(T.cut(A.items(spark, sf)), Settings(partial_similarity=0.55))
    return found.select("source", "clip", F.round("similarity", 6).alias("similarity"), "at")


@query(
    "WITH RECURSIVE x AS (SELECT l_suppkey AS source, l_partkey AS clip, round(1 - max(l_discount), 2) AS similarity, min(l_linenumber)::INT AS \"at\" FROM lineitem GROUP BY ALL), "
    "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY source) AS r FROM x) WHERE r = 1) "
    "SELECT DISTINCT source AS group_id, source AS member, 0.0::DOUBLE AS difference, 0 AS flags, 0 AS \"at\" FROM c UNION ALL SELECT source, clip, round(1 - similarity, 6), 2, \"at\" FROM c"
)
def first_claim_assignment(spark, sf):
    m = T.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("clip")).agg(
        F.round(1 - F.max("l_discount"), 2).alias("similarity"), F.min("l_linenumber").alias("at")
    )
    return R.clip_rows(R.first_claims(m)).withColumn("difference", F.round("difference", 6))


@query(
    "WITH bl AS (SELECT DISTINCT l_orderkey // 2 * 2 AS entry_id, l_partkey AS path FROM lineitem WHERE l_orderkey % 3 = 0), r AS (SELECT DISTINCT l_orderkey AS group_id, l_partkey AS path FROM lineitem), "
    "n AS (SELECT group_id, count(*) AS n FROM r GROUP BY group_id) SELECT DISTINCT group_id FROM (SELECT group_id, entry_id, count(*) AS h FROM r JOIN bl USING (path) GROUP BY ALL) JOIN n USING (group_id) WHERE h = n"
)
def blacklist_containment(spark, sf):
    l = T.read(spark, sf, "lineitem")
    black = l.filter("l_orderkey % 3 = 0").select((F.floor(F.col("l_orderkey") / 2) * 2).alias("entry_id"), F.col("l_partkey").alias("path"))
    return J.blacklisted_groups(l.select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("path")), black)


@query(
    "SELECT b.o_orderkey AS entry_id, b.l_partkey AS path FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_partkey FROM lineitem) b "
    "WHERE b.o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5))"
)
def blacklist_pruned(spark, sf):
    b = T.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("path")).distinct()
    return J.pruned_blacklist(b, T.read(spark, sf, "part").filter("p_size > 5").select(F.col("p_partkey").alias("path")))


_REL = (
    "m AS (SELECT p_partkey AS path, p_size AS size, p_partkey % 997 AS modified, length(p_name)::DOUBLE AS duration FROM part), "
    "n AS (SELECT s_suppkey + 1000000000 AS new_path, (s_suppkey % 50 + 1)::INT AS size, s_suppkey % 997 AS modified, length(s_name)::DOUBLE AS duration FROM supplier)"
)


@query(
    f"WITH {_REL}, c AS (SELECT path, new_path, abs(m.modified - n.modified) <= 2 AS t, abs(m.duration - n.duration) <= 0.5 AS l FROM m JOIN n USING (size)), "
    "w AS (SELECT *, count(*) OVER w AS k, count(*) FILTER (t) OVER w AS kt, count(*) FILTER (l) OVER w AS kl FROM c WINDOW w AS (PARTITION BY path)), "
    "x AS (SELECT path, new_path, CASE WHEN k = 1 THEN 'size' WHEN kt = 1 AND t THEN 'size_time' WHEN kt <> 1 AND kl = 1 AND l THEN 'size_duration' END AS confidence FROM w) SELECT * FROM x WHERE confidence IS NOT NULL"
)
def relocation(spark, sf):
    """All parts as missing entries, all suppliers as the files that may be them."""
    p = T.read(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("size"), (F.col("p_partkey") % 997).alias("modified"), F.length("p_name").cast("double").alias("duration"))
    n = T.read(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 1000000000).alias("path"), (F.col("s_suppkey") % 50 + 1).cast("int").alias("size"), (F.col("s_suppkey") % 997).alias("modified"), F.length("s_name").cast("double").alias("duration")
    )
    return J.relocation_matches(p, n)


@query(
    f"WITH {_E}, q AS (SELECT a.idx AS idx_a, b.idx AS idx_b, a.label + 10 AS da, b.label + 10 AS db, {_DIFF} AS diff FROM f a JOIN f b ON b.idx = a.idx + 1) "
    "SELECT idx_a, idx_b, abs(da - db) <= least(da * 0.2, db * 0.2) AS duration_ok, diff <= 0.10000002384185791 AS visual_ok, abs(da - db) <= least(da * 0.2, db * 0.2) AND diff <= 0.10000002384185791 AS duplicate, "
    "CASE WHEN abs(da - db) > least(da * 0.2, db * 0.2) THEN 'duration' WHEN diff > 0.10000002384185791 THEN 'visual' END AS failed_at FROM q"
)
def explain_pairs(spark, sf):
    f = A.frames(spark, sf).select("idx", "gray", (F.col("label") + 10).cast("double").alias("duration"), F.lit("/x").alias("folder"))
    side = lambda n, k: f.select((F.col("idx") + k).alias("key"), *(F.col(c).alias(f"{c}_{n}") for c in f.columns))
    pairs = side("a", 1).join(side("b", 0), "key")
    out = J.explained_pairs(pairs, Settings(percent=90), K.gray_difference(F.col("gray_a"), F.col("gray_b")))
    return out.select("idx_a", "idx_b", "duration_ok", "visual_ok", "duplicate", "failed_at")


# ---- filters ------------------------------------------------------------------------------------

_RULES = Settings(black_list=("/m.*", "/blog.ththan.example.net"), size_filter=True, max_size_mb=4, min_size_mb=1, path_contains=("*example*",), path_not_contains=("*casino*",), ignore_reparse_points=True)
_MB = "trunc((size::FLOAT / 1024.0::FLOAT)::FLOAT / 1024.0::FLOAT)::BIGINT"
_REASON = (
    "CASE WHEN regexp_matches(folder, '^/m\\..*$', 'is') OR lower(folder) = '/blog.ththan.example.net' OR starts_with(lower(folder), '/blog.ththan.example.net/') THEN 'black_list' "
    "WHEN flags & 2 <> 0 THEN 'manually_excluded' WHEN flags & 16 <> 0 THEN 'too_dark' WHEN NOT there THEN 'missing' "
    f"WHEN {_MB} < 1 OR {_MB} > 4 THEN 'size' WHEN path NOT ILIKE '%example%' THEN 'path_contains' WHEN flags & 256 <> 0 THEN 'reparse_point' WHEN path ILIKE '%casino%' THEN 'path_not_contains' END"
)


def _reasons(spark, sf):
    c = F.col
    return A.catalog(spark, sf).withColumn("reason", P.entry_reason(_RULES, c("path"), c("folder"), c("is_image"), c("flags"), c("size"), c("there")))


@query(f"WITH {_C} SELECT idx, {_REASON} AS reason FROM c")
def entry_reason(spark, sf):
    return _reasons(spark, sf).select("idx", "reason")


@query(
    f"WITH {_C}, r AS (SELECT path, {_REASON} AS reason FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY path) AS n FROM r WHERE reason IS NOT NULL) "
    "SELECT reason, count(*) AS n, list_sort(list(path) FILTER (n <= 5)) AS samples FROM k GROUP BY reason"
)
def reason_counts(spark, sf):
    return P.reason_counts(_reasons(spark, sf))


@query(f"WITH {_C} SELECT idx, starts_with(folder, '/www.ththwh.example.org/') OR folder = '/www.ththwh.example.org' OR starts_with(folder, '/blog.ththan.example.net/') OR folder = '/blog.ththan.example.net' AS below, folder IN ('/www.ththwh.example.org', '/blog.ththan.example.net') AS exact FROM c")
def include_list(spark, sf):
    hosts = ("/www.ththwh.example.org", "/blog.ththan.example.net/")
    test = lambda below: P.in_include_list(F.col("folder"), hosts, below)
    return A.catalog(spark, sf).select("idx", test(True).alias("below"), test(False).alias("exact"))


@query(f"WITH {_C} SELECT idx, path ILIKE '%/blog._%/en/%' AS patterned, lower(path) LIKE '%blog%' AS contained FROM c")
def glob_filter(spark, sf):
    path = F.col("path")
    return A.catalog(spark, sf).select("idx", S.path_matches(path, "/BLOG.?*/en/").alias("patterned"), S.path_matches(path, "Blog").alias("contained"))


@query(f"WITH {_C} SELECT idx FROM c WHERE flags & 4 = 0 AND there AND (is_image OR flags % 4 >= 1)")
def comparable_entries(spark, sf):
    c = A.catalog(spark, sf)
    return c.filter(P.comparable(F.col("flags"), F.col("there"), F.col("is_image"), F.col("flags") % 4, 1)).select("idx")


@query(f"WITH {_C} SELECT idx FROM c WHERE path IN (SELECT path FROM c WHERE there) AND flags & 12 = 0")
def catalog_cleanup(spark, sf):
    c = A.catalog(spark, sf)
    return P.cleaned_catalog(c, c.filter("there")).select("idx")


@query(f"WITH {_C} SELECT idx, flags & 6 <> 0 AS any_of, flags & 6 = 6 AS all_of, flags | 64 AS set_one, flags & ~2 AS reset_one FROM c")
def flag_algebra(spark, sf):
    f = F.col("flags")
    return A.catalog(spark, sf).select("idx", K.has_any(f, 6).alias("any_of"), K.has_all(f, 6).alias("all_of"), K.with_flag(f, 64).alias("set_one"), K.with_flag(f, 2, False).alias("reset_one"))


@query(f"WITH {_G} SELECT group_id, pos FROM g WHERE group_id IN (SELECT group_id FROM g WHERE lower(path) LIKE '%/lib/7/%')")
def group_path_filter(spark, sf):
    return P.groups_with_hit(A.groups(spark, sf), S.path_matches(F.col("path"), "/lib/7/")).select("group_id", "pos")


@query(
    f"WITH {_G} SELECT group_id, pos FROM g WHERE group_id IN (SELECT group_id FROM g WHERE path LIKE '/lib/1%.mp4') AND NOT is_image AND group_id IN (SELECT group_id FROM g WHERE checked) AND similarity BETWEEN 92 AND 99"
)
def result_filter(spark, sf):
    return P.result_filter(A.groups(spark, sf), "/lib/1*.mp4", False, 92, 99, True).select("group_id", "pos")


@query(
    f"WITH {_G} SELECT group_id, pos FROM g WHERE group_id NOT IN (SELECT group_id FROM g WHERE checked) AND {_MB} BETWEEN 2 AND 6 AND similarity BETWEEN 91 AND 100 AND path LIKE '%2%' AND path NOT LIKE '%/3/%'"
)
def custom_filter(spark, sf):
    return P.custom_filter(A.groups(spark, sf), 2, 6, ["*2*"], ["*/3/*"], 91, 100, True).select("group_id", "pos")


@query(
    f"WITH {_G}, h AS (SELECT *, size > 3000000 AND fps < 60 AS hit FROM g) SELECT group_id, pos, hit AND NOT (bool_and(hit) OVER w AND row_number() OVER (PARTITION BY group_id ORDER BY pos) = 1) AS checked FROM h WINDOW w AS (PARTITION BY group_id)"
)
def expression_selection(spark, sf):
    return P.check_by_expression(A.groups(spark, sf), "size > 3000000 AND fps < 60").select("group_id", "pos", "checked")


# ---- groups -------------------------------------------------------------------------------------

@query("SELECT min(doc_id) OVER (PARTITION BY text) AS group_id, doc_id FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def exact_copy_groups(spark, sf):
    d = T.read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n")).filter("n > 1")
    return d.join(first, "h").select("group_id", "doc_id")


@query(
    f"WITH RECURSIVE {_E}, {_SIG}, {_NEAR}, e AS (SELECT a.idx AS a, b.idx AS b FROM n a JOIN n b ON a.idx <> b.idx AND bit_count(xor(a.phash, b.phash)) <= 3), "
    "r(n, o) AS (SELECT a, a FROM e UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.o) SELECT n AS node, min(o) AS component FROM r GROUP BY n"
)
def connected_components(spark, sf):
    return G.connected_components(J.hamming_join(_near_hashes(spark, sf), 3))


@query()
def guarded_duplicate_groups(spark, sf):
    s = T.cut(A.frames(spark, sf).select("idx", "label", K.median_signature(F.col("values")).alias("phash")))
    pairs = J.pairs_within(s, ["label"], "idx").withColumn("bits", K.hamming(F.col("phash_a"), F.col("phash_b"))).filter("bits <= 20")
    pairs = T.cut(pairs.select(F.col("idx_a").alias("a"), F.col("idx_b").alias("b"), (F.col("bits") / 64).alias("difference"), F.lit(0).alias("flags")))
    # all pairs of a component are of one label, so hashes alone tell which are similar
    points = s.select(F.col("idx").alias("node"), F.lit(0).alias("n"), F.unhex(F.lpad(F.hex("phash"), 16, "0")).alias("point"))
    return G.duplicate_groups_near(pairs, points, G.nearness(Settings(), 20))


_BEST = ["duration", "fps", "bitrate", "audio_sample_rate"]


@query(
    f"WITH {_G} SELECT group_id, pos, size = min(size) OVER w AS best_size, frame_size = max(frame_size) OVER w AS best_frame_size, "
    + ", ".join(f"{c} = max({c}) OVER w AND NOT is_image AS best_{c}" for c in _BEST)
    + " FROM g WINDOW w AS (PARTITION BY group_id)"
)
def best_of_group(spark, sf):
    return R.with_best_flags(A.groups(spark, sf)).select("group_id", "pos", "best_size", "best_frame_size", *(f"best_{c}" for c in _BEST))


_KEY = {
    "smallest_file": "size DESC, pos", "shortest_duration": "duration DESC, pos", "worst_resolution": "frame_size DESC, pos",
}
_QUAL = (
    "q AS (SELECT *, bitrate = max(bitrate) OVER w AND NOT is_image AS br, frame_size = max(frame_size) OVER w AS bf FROM g WINDOW w AS (PARTITION BY group_id)), "
    "k AS (SELECT *, bool_or(br) OVER w AS any_br, count(*) OVER w AS n, min(similarity) OVER w AS low FROM q WINDOW w AS (PARTITION BY group_id)), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN any_br THEN br ELSE bf END DESC, pos) AS r FROM k)"
)


def _keeper(strategy):
    def run(spark, sf):
        rows = R.with_best_flags(A.groups(spark, sf))
        return R.to_delete(rows, strategy).select("group_id", "pos")

    run.__name__ = f"keeper_{strategy}"
    if strategy in _KEY:
        sql = f"WITH {_G}, o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {_KEY[strategy]}) AS r FROM g) SELECT group_id, pos FROM o WHERE r > 1"
    else:
        sql = f"WITH {_G}, {_QUAL} SELECT group_id, pos FROM o WHERE r > 1 AND n >= 2" + (" AND low >= 100" if strategy.startswith("hundred") else "")
    query(sql)(run)


for _strategy in R.STRATEGIES:
    _keeper(_strategy)

_V = "CASE WHEN NOT is_image THEN {} END DESC NULLS LAST"
_LEX = ", ".join([_V.format("duration"), "frame_size DESC NULLS LAST", _V.format("fps"), _V.format("bitrate"), _V.format("audio_sample_rate"), "size", "pos"])


@query(f"WITH {_G} SELECT group_id, pos, row_number() OVER (PARTITION BY group_id ORDER BY {_LEX}) > 1 AS checked FROM g")
def keeper_lexicographic(spark, sf):
    return R.check_lowest_quality(A.groups(spark, sf), ["duration", "resolution"]).select("group_id", "pos", "checked")


def _order(name, keys, sql):
    def run(spark, sf):
        return R.check_by_order(A.groups(spark, sf), *keys()).select("group_id", "pos", "checked")

    run.__name__ = name
    query(f"WITH {_G} SELECT group_id, pos, row_number() OVER (PARTITION BY group_id ORDER BY {sql}, pos) > 1 AS checked FROM g")(run)


_order("select_oldest", lambda: [F.desc("date_created")], "date_created DESC")
_order("select_newest", lambda: [F.asc("date_created")], "date_created")
_order("select_all_but_smallest", lambda: [F.asc("size")], "size")

@query(f"WITH {_G} SELECT group_id, pos, bool_and(similarity >= 100) OVER w AND row_number() OVER (PARTITION BY group_id ORDER BY pos) > 1 AS checked FROM g WINDOW w AS (PARTITION BY group_id)")
def select_hundred_percent(spark, sf):
    return R.check_hundred_percent(A.groups(spark, sf)).select("group_id", "pos", "checked")


@query(f"WITH {_G} SELECT group_id, pos, NOT checked AS checked FROM g")
def select_inverted(spark, sf):
    return R.inverted(A.groups(spark, sf)).select("group_id", "pos", "checked")


@query(f"WITH {_G} SELECT group_id, pos FROM g QUALIFY row_number() OVER (PARTITION BY group_id, size, dev, ino ORDER BY pos) = 1 AND count(*) OVER (PARTITION BY group_id) > 1")
def hard_link_dedupe(spark, sf):
    return R.without_hard_links(R.without_singletons(A.groups(spark, sf))).select("group_id", "pos")


@query(
    f"WITH {_G}, n AS (SELECT group_id, count(*) AS n FROM g GROUP BY 1) SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_items, round(avg(n), 6) AS mean_size, max(n) AS max_size, "
    "count(*) FILTER (n > 5) AS over_5, count(*) FILTER (n > 10) AS over_10 FROM n"
)
def group_stats(spark, sf):
    return R.group_statistics(A.groups(spark, sf))


@query(f"WITH {_G}, n AS (SELECT group_id, sum(greatest(size, 0)) AS t, max(greatest(size, 0)) AS m FROM g GROUP BY 1) SELECT sum(t)::BIGINT AS total_size, sum(t - m)::BIGINT AS savings FROM n")
def potential_savings(spark, sf):
    return R.savings(A.groups(spark, sf))


@query(
    f"WITH {_G}, b AS (SELECT *, min(size) OVER (PARTITION BY group_id) AS best FROM g), p AS (SELECT *, (size - best)::DOUBLE / best * 100 AS pct FROM b) "
    "SELECT group_id, pos, CASE WHEN size = best THEN 'best' WHEN best > 0 THEN CASE WHEN abs(pct) < 0.5 THEN '=' ELSE format('{:+.0f}%', pct) END END AS diff_text FROM p"
)
def relative_size(spark, sf):
    return R.relative_to_best(A.groups(spark, sf), "size", smallest=True).select("group_id", "pos", "diff_text")


@query(f"WITH {_G}, d AS (SELECT *, duration - max(duration) OVER (PARTITION BY group_id) AS gap FROM g) SELECT group_id, pos, CASE WHEN gap = 0 THEN 'best' ELSE '-' || abs(gap) || 's' END AS diff_text FROM d")
def relative_duration(spark, sf):
    return R.relative_duration(A.groups(spark, sf)).select("group_id", "pos", "diff_text")


@query(
    f"WITH {_G}, d AS (SELECT DISTINCT group_id FROM g) SELECT group_id, coalesce(lead(group_id) OVER w, first_value(group_id) OVER (ORDER BY group_id)) AS next_group, "
    "coalesce(lag(group_id) OVER w, (SELECT max(group_id) FROM d)) AS previous_group FROM d WINDOW w AS (ORDER BY group_id)"
)
def group_navigation(spark, sf):
    return R.group_navigation(A.groups(spark, sf))


@query(f"WITH {_G} SELECT group_id, pos, (sum(size) OVER (PARTITION BY group_id))::BIGINT AS group_total FROM g")
def top_groups_by_size(spark, sf):
    """All rows with the total size of their group, by which they are ordered."""
    return R.sorted_rows(A.groups(spark, sf), "group_total", ascending=False).select("group_id", "pos", "group_total")


# ---- sources, sinks, scalars --------------------------------------------------------------------

@query(
    f"WITH {_G} SELECT group_id, '{{\"GroupId\":\"' || group_id || '\",\"Items\":[' || string_agg('{{\"path\":\"' || path || '\",\"similarity\":' || similarity || '}}', ',' ORDER BY similarity DESC, pos) || ']}}' AS json FROM g GROUP BY group_id"
    .replace("{{", "{").replace("}}", "}")
)
def results_json(spark, sf):
    return sinks.results_json(A.groups(spark, sf), ["path", "similarity"])


@query(
    f"WITH {_G} SELECT group_id, list_sort(coalesce(list(path) FILTER (checked), [])) AS removed, list_sort(coalesce(list(path) FILTER (NOT checked), [])) AS kept, sum(CASE WHEN checked THEN greatest(size, 0) ELSE 0 END)::BIGINT AS saved "
    "FROM g GROUP BY group_id HAVING count(*) FILTER (checked) > 0"
)
def cleanup_report(spark, sf):
    return sinks.cleanup_report(A.groups(spark, sf))


@query(f"WITH {_G}, k AS (SELECT group_id, arg_min(path, (pos, path)) AS target FROM g WHERE NOT checked GROUP BY 1) SELECT group_id, path, 'link' AS action, target FROM g JOIN k USING (group_id) WHERE checked")
def link_plan(spark, sf):
    return sinks.action_plan(A.groups(spark, sf), "link")


_N = "n AS (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) AS r FROM n)"


@query(
    f"WITH {_C}, {_N} SELECT path, '/to/' || CASE WHEN r = 1 THEN name ELSE regexp_replace(name, '\\.[^.]*$', '') || '_' || (r - 2) || regexp_extract(name, '(\\.[^.]*)?$') END AS target FROM r"
)
def numbered_names(spark, sf):
    return sinks.numbered_names(A.catalog(spark, sf), "/to")


@query(
    "WITH b AS (SELECT c_custkey AS path, c_acctbal AS size FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS path, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS size FROM customer WHERE c_custkey % 4 <> 0) "
    "SELECT coalesce(b.path, n.path) AS path, CASE WHEN b.path IS NULL OR (n.path IS NOT NULL AND b.size <> n.size) THEN n.size ELSE b.size END AS size, "
    "CASE WHEN b.path IS NOT NULL AND (n.path IS NULL OR b.size = n.size) THEN b.path * 7 END AS hash, CASE WHEN b.path IS NULL THEN 'new' WHEN n.path IS NOT NULL AND b.size <> n.size THEN 'changed' ELSE 'kept' END AS change "
    "FROM b FULL JOIN n ON b.path = n.path"
)
def catalog_upsert(spark, sf):
    c = T.read(spark, sf, "customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("path"), F.col("c_acctbal").alias("size"), (F.col("c_custkey") * 7).alias("hash"))
    new = c.filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("path"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END").alias("size"))
    return T.upserted(old, new, "path", ["size"], ["hash"])


@query(
    "SELECT o_orderkey AS id, CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN format('{:.1f} B', b::DOUBLE) WHEN b < 1048576 THEN format('{:.1f} KB', round(b / 1024.0::DOUBLE, 1)) ELSE format('{:.1f} MB', round(b / 1048576.0::DOUBLE, 1)) END AS bytes_text, "
    "trunc((b::FLOAT / 1024.0::FLOAT)::FLOAT / 1024.0::FLOAT)::BIGINT AS mb FROM (SELECT o_orderkey, (o_orderkey * o_orderkey % 100000000) AS b FROM orders)"
)
def size_texts(spark, sf):
    b = F.col("o_orderkey") * F.col("o_orderkey") % 100000000
    return T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), S.bytes_text(b).alias("bytes_text"), S.whole_megabytes(b).alias("mb"))


@query(
    "SELECT id, CASE WHEN d > 0 THEN CASE WHEN h > 0 THEN d || 'd, ' || h || 'h' ELSE d || 'd' END WHEN h > 0 THEN CASE WHEN m > 0 THEN h || 'h, ' || m || 'm' ELSE h || 'h' END WHEN m > 0 THEN m || 'm, ' || s || 's' ELSE s || 's' END AS text "
    "FROM (SELECT o_orderkey AS id, t // 86400 AS d, t % 86400 // 3600 AS h, t % 3600 // 60 AS m, t % 60 AS s FROM (SELECT o_orderkey, o_orderkey * 37 % 200000 AS t FROM orders))"
)
def duration_texts(spark, sf):
    return T.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), S.duration_text(F.col("o_orderkey") * 37 % 200000).alias("text"))


@query("SELECT p_partkey AS id, greatest(1, round_even(w / f, 0)::INT) AS w, greatest(1, round_even(h / f, 0)::INT) AS h FROM (SELECT *, greatest(w / 320.0, h / 320.0, 1.0)::DOUBLE AS f FROM (SELECT p_partkey, p_size * 40 AS w, p_size * 23 AS h FROM part))")
def fitted_sizes(spark, sf):
    fit = S.fit_width(F.col("p_size") * 40, F.col("p_size") * 23, 320)
    return T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), fit["width"].alias("w"), fit["height"].alias("h"))


@query(f"WITH {_C} SELECT idx, len(path) - len(replace(path, '/', '')) AS depth, CASE WHEN starts_with(path, '/blog.') THEN '/moved/' || substr(path, 7) ELSE path END AS moved FROM c")
def path_functions(spark, sf):
    return A.catalog(spark, sf).select("idx", S.folder_depth(F.col("path")).cast("long").alias("depth"), S.relocated(F.col("path"), "/blog.", "/moved/").alias("moved"))


@query(
    "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events) "
    "SELECT user_id, b AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest(range(0, n)) AS b FROM r) WHERE b * 3 <= n - 5 AND p >= b * 3 AND p < b * 3 + 5 GROUP BY ALL"
)
def hopping_windows(spark, sf):
    e = T.read(spark, sf, "events").select("user_id", "value", F.struct("ts", "event_id").alias("o"))
    return ingest.hopping_buckets(e, 5, 3, "o", "value", "user_id").select("user_id", F.col("bucket").cast("long").alias("bucket"), "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_rows(spark, sf):
    e = T.read(spark, sf, "events").select("user_id", "event_id")
    return ingest.latest(e, "user_id", "event_id")


def flagship(spark, sf):
    """Pairs of near-equal signatures within a label."""
    return phash_pairs(spark, sf)


from . import more  # noqa: E402, F401 - registers its queries
