"""Secret scans by an incremental ledger of blobs: each content is scanned once for each version of a rule."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import marked, marked_left_join, parted, shared_dir, stored, text_batches, trim

# The formats of secrets.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs of hex digits are maximal, so shorter ones need not be found to be dropped
PEM = r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}-----END (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----"
TICKET = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{20,}"
LOGIN = r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{6,64}@[A-Za-z0-9]"
LEAST = {"assign": 6, "access": 20}


class Rule(NamedTuple):
    """kind names the rule in spans; version changes whenever its results may."""

    kind: str
    version: int
    pattern: str
    flags: int = 0
    hints: tuple[str, ...] = ()  # a text without any of these (in lower case) has no match
    group: int = 0  # the part of a match that must have `least` characters
    least: int = 0


BASE = (
    Rule("assign", 1, ASSIGN, re.IGNORECASE | re.ASCII, ASSIGN_WORDS, 2, LEAST["assign"]),
    Rule("access", 1, ACCESS, 0, ("akia",), 0, LEAST["access"]),
    Rule("hex", 1, HEX),
)
#: Kinds that the ledger's rules add to the base ones, which stay as they are.
RULES = (*BASE, Rule("pem", 1, PEM, 0, ("private key-----",)), Rule("ticket", 1, TICKET, 0, ("eyj",)), Rule("login", 1, LOGIN, 0, ("://",)))
SPANS = "array<struct<kind:string,start:long,end:long>>"
LEDGER = f"blob binary, rules array<string>, spans {SPANS}"


def name_of(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def finder(rules: tuple[Rule, ...]) -> Callable[[str, set[str] | None], list[tuple[str, int, int]]]:
    """Function (text, names of rules or None for all) -> spans (kind, start, end) in code points,
    of each rule the leftmost matches that do not overlap, those dropped that are too short."""
    made = [(name_of(r), r, re.compile(r.pattern, r.flags)) for r in rules]

    def find(text: str, only: set[str] | None = None) -> list[tuple[str, int, int]]:
        low, out = text.lower(), []
        for name, r, pattern in made:
            if (only is None or name in only) and (not r.hints or any(h in low for h in r.hints)):
                out += [(r.kind, m.start(), m.end()) for m in pattern.finditer(text) if len(m[r.group]) >= r.least]
        return out

    return find


def scan(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows of rows(blob, text, rules): each text under the rules named, all for null."""
    text_batches(rows.sparkSession)
    every = [name_of(r) for r in rules]

    def run(batches):
        import pyarrow as pa

        find = finder(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            asked = batch.column(2).to_pylist()
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(t, None if a is None else set(a))] for t, a in zip(batch.column(1).to_pylist(), asked, strict=True)]
            done = pa.array([every if a is None else a for a in asked], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), done, pa.array(found, kind)], ["blob", "rules", "spans"])
        trim()

    return rows.select("blob", "text", "rules").mapInArrow(run, LEDGER)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger kept at path; empty where there is none yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path).select("blob", "rules", "spans")


def keyed(versions: DataFrame, text_col: str) -> DataFrame:
    """versions with blob, the SHA-256 of the text's bytes; a null text is the empty one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return versions.withColumn(text_col, text).withColumn("blob", F.unhex(F.sha2(text, 256)))


def pending(texts: DataFrame, known: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, rules, n: the blobs of texts with the rule versions that the ledger has not seen on
    them, and how many rows have the blob. Counts are combined in each task before they move."""
    blobs = texts.groupBy("blob").agg(F.count("*").alias("n"))
    names = F.array(*(F.lit(name_of(r)) for r in rules))
    seen = known.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    left = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))))
    return left.filter(F.size("rules") > 0).select("blob", "rules", "n")


def update(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Scan what the ledger at path lacks of versions, append it there, and return the new part.

    The text of a blob of one row that no rule has seen is scanned where it is read. Other texts
    move only if their blob is pending, one for each blob and task, and one is scanned with the
    rule versions that are missing. The part is written as a whole by Spark's committer, so a run
    that fails adds nothing; a run that is repeated adds nothing either.
    """
    spark = versions.sparkSession
    texts = keyed(versions.select(F.col(text_col).alias("text")), "text")
    todo = stored(pending(texts, ledger(spark, path), rules), "secrets-pending")
    runs = _parts(spark, path)
    part = f"{path}/part={len(runs)}"
    nothing = todo.limit(1).count() == 0
    if not nothing:
        alone = (F.col("n") == 1) & (F.size("rules") == len(rules))
        # what is not scanned in place: copies, and blobs that some rules or all have seen
        known = texts.select("blob").distinct().join(todo.select("blob"), "blob", "left_anti") if runs else None
        special = todo.filter(~alone).select("blob")
        special = stored(special if known is None else special.union(known), "secrets-special")
        may, alone_here = parted(texts, special, "blob")
        moved = marked(may, todo, "blob").groupBy("blob").agg(F.first("text").alias("text"))
        moved = moved.join(todo.select("blob", "rules").hint("merge"), "blob").select("blob", "text", "rules")
        if alone_here is not None:
            moved = moved.union(alone_here.select("blob", "text", F.lit(None).cast("array<string>")))
        scan(moved, rules).write.parquet(part)
    return spark.createDataFrame([], LEDGER) if nothing else spark.read.schema(LEDGER).parquet(part)


def _parts(spark: SparkSession, path: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [str(f.getPath()) for f in files.listStatus(at)] if files.exists(at) else []


def findings(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """versions with spans (by start, then kind in the order of rules) from the ledger at path:
    all places of a blob get what was found in it. Spans of other rule versions do not count. The
    text is left out; columns named blob or spans are replaced, whatever else there is stays.

    Only blobs with a finding are joined, and only rows that may hold one of them move.
    """
    order = F.array(*(F.lit(r.kind) for r in rules))
    current = F.array(*(F.lit(name_of(r)) for r in rules))
    kinds = F.transform(F.filter("rules", lambda r: F.array_contains(current, r)), lambda r: F.substring_index(r, "@", 1))
    own = F.filter("spans", lambda s: F.array_contains(F.col("kinds"), s["kind"]))
    hits = ledger(versions.sparkSession, path).withColumn("kinds", kinds).select("blob", own.alias("spans")).filter(F.size("spans") > 0)
    # parts of a blob come from runs with different rules: at most one for each rule
    hits = hits.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    keys = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("place"), s["kind"].alias("kind"), s["end"].alias("end")))
    ordered = F.transform(F.array_sort(keys), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    hits = stored(hits.select("blob", ordered.alias("spans")), "secrets-hits")
    # the row travels as one column, so that its names meet no others
    own = [F.col(c) for c in versions.columns if c not in (text_col, "blob", "spans")]
    rows = versions.select(F.struct(*own).alias("row"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("blob"))
    found = marked_left_join(rows, hits, "blob")
    return found.select("row.*", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def secrets(docs: DataFrame, path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs.

    docs are versions of texts; copies of a text, and texts that the ledger at path holds already,
    are not scanned again (without a path a new ledger in the shared folder is used). Whole texts
    are scanned; null is the empty text. Null ids and repeated rows are ordinary rows; other
    columns are not read; an empty table gives no rows.
    """
    import uuid

    path = path or f"{shared_dir(docs.sparkSession)}/secrets-ledger-{uuid.uuid4().hex}"
    versions = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    update(versions, path, rules)
    found = findings(versions, path, rules)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    return found.select(
        "doc_id", *(F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE),
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )
