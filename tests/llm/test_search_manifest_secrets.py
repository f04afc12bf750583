"""Ranked search, Merkle manifest and secret scans against brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinreel.llm import entry, lexical, merkle, secrets
from twinreel.llm.common import read

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score long, rank int, spans string, blob string, index string, salt string, place int, tw_mark int, tw_spans string"


def table(spark, rows):
    """Documents (doc_id, text, lang, source, n_chars) with columns whose names clash with those of results and helpers."""
    return spark.createDataFrame([(*r, 7, 7, "x", "x", "x", "x", 7, 7, "x") for r in rows], SCHEMA)


def queries(spark, rows):
    return spark.createDataFrame([(i, t, 7, 7) for i, t in rows], "item_id long, text string, doc_id long, score int")


# ---- ranked search

def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_search(rows, asked, size=10):
    docs = [(i, Counter(words(t)), len(words(t))) for i, t in rows if words(t)]
    n, length = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in asked:
        found = []
        for doc, tf, own in docs:
            m = 100 - 75 + 75 * own * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in words(text) if t in tf)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:size], 1)]
    return Counter(out)


def test_ranked_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["a", "of", "É", "é", "x1", "漢字", "ſet", *(f"w{k}" for k in range(60))]
    pick = lambda n: " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=n))
    rows = [(i, pick(rng.randrange(1, 80))) for i in range(400)] + [(5, "tie tie"), (3, "tie tie"), (None, "tie tie"), (3, "tie tie"), (900, None), (901, ""), (902, " ,.-")]
    rows += [(1000, "long-text " * 3000 + "needle"), (1001, "NEEDLE\x00needle\x7fNeedle")]
    asked = [(i, pick(rng.randrange(1, 12))) for i in range(25)] + [(90, "tie"), (91, "tie tie"), (92, ""), (93, None), (94, "unknown"), (None, "needle"), (90, "A a É")]
    want = brute_search(rows, asked)
    docs = table(spark, [(i, t, "en", "s", 0) for i, t in rows]).repartition(3)
    run = lambda: Counter(tuple(r) for r in lexical.ranked_search(docs, queries(spark, asked)).collect())
    assert run() == want
    # many shards a task, several blocks of queries, texts cut into slices
    for name, value in (("SHARD_BYTES", 900), ("QUERY_BYTES", 40), ("SLICE", 7)):
        monkeypatch.setattr(lexical, name, value)
    assert run() == want
    assert lexical.ranked_search(docs.limit(0), queries(spark, asked)).count() == 0
    assert lexical.ranked_search(docs, queries(spark, [])).count() == 0


def test_max_score_skips_documents_but_loses_none(monkeypatch):
    rng = np.random.default_rng(8)
    for _ in range(200):
        lists = []
        for _ in range(rng.integers(1, 7)):
            places = np.sort(rng.choice(300, rng.integers(1, 200), replace=False)).astype(np.int64)
            share = rng.integers(1, 1000, len(places))
            lists.append((int(rng.integers(0, 50)), places, share, int(share.max())))
        total = np.zeros(300, np.int64)
        for w, places, share, _ in lists:
            total[places] += w * share
        floor = int(rng.choice(total)) + int(rng.integers(0, 2))
        places, scores = lexical.max_score(lists, floor)
        want = np.flatnonzero(total >= max(floor, 1))
        assert places.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
    # the common term's list is never merged once ten documents beat all that it can add
    common = (1, np.arange(100_000), np.full(100_000, 5), 5)
    rare = (100, np.arange(10), np.full(10, 9), 9)
    merged = []
    concatenate = np.concatenate
    monkeypatch.setattr(np, "concatenate", lambda x, *a, **k: merged.append(sum(map(len, x))) or concatenate(x, *a, **k))
    places, _ = lexical.max_score([common, rare], 900)
    assert len(places) == 10 and max(merged) <= 100


# ---- Merkle manifest

def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    i, text, lang, source, n = row
    n = None if n is None else n + more
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))


def climb(nodes):
    """Root of a list of nodes, and for each one its siblings with whether they are on the left."""
    paths, level, of = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i, at in enumerate(of):
            beside = at ^ 1
            paths[i].append((level[beside] if beside < len(level) else None, at % 2 == 1))
        level = [digest("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        of = [at // 2 for at in of]
    return level[0], paths


def brute_manifest(rows):
    out, by = Counter(), {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = own, *climb([leaf(r) for r in own])
    root, tops = climb([trees[lang][1] for lang in langs])
    for lang, over in zip(langs, tops, strict=True):
        own, sub, paths = trees[lang]
        for r, path in zip(own, paths, strict=True):
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, int(touched))
            for s, left in path + over:
                node = digest((s or "") + node if left else node + (s or ""))
            out[r[0], leaf(r), sub, root, digest("".join(s for s, _ in path + over if s)), node, node == root] += 1
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("height", [1, 2, 8])
def test_manifest_equals_brute_force(spark, monkeypatch, height):
    rng = random.Random(height)
    rows = [(i, f"text {i} é", "en", "s", i) for i in range(77)] + [(i, "t", "de", None, None if i % 3 else 4) for i in range(200, 233)]
    rows += [(1, None, None, "s", 4), (2, "", None, "s", 4), (3, "x" * 40_000, "", "", -1), (None, "n", "fr", "s", 1), (None, "m", "fr", "s", 1)]
    rows += [(7, "same", "fr", "s", 1)] * 9 + [(8, "alone", "ñ", "s", 2), (9, "alone", "z", "s", 2)]
    rng.shuffle(rows)
    monkeypatch.setattr(merkle.manifest, "__defaults__", (None, height))
    got = merkle.tamper_check(table(spark, rows).repartition(3)).select(COLUMNS).collect()
    assert Counter(tuple(r) for r in got) == brute_manifest(rows)
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_few_or_no_rows(spark):
    assert merkle.tamper_check(table(spark, [])).count() == 0
    one = [(9, "only", "en", "s", 3)]
    got = merkle.tamper_check(table(spark, one)).select(COLUMNS).collect()
    assert Counter(tuple(r) for r in got) == brute_manifest(one)


@pytest.mark.parametrize("height", range(1, 8))
def test_traversal_keeps_logarithmic_state(height):
    for n in {1, 2, 3, (1 << height) - 1, 1 << height}:
        if not 1 <= n <= 1 << height:
            continue
        leaves, most = [digest(str(i)) for i in range(n)], []
        real = merkle.Treehash.update

        def update(self, leaf, real=real, most=most):
            real(self, leaf)
            most.append(len(self.stack))

        merkle.Treehash.update = update
        try:
            paths = list(merkle.traverse(leaves, height))
        finally:
            merkle.Treehash.update = real
        level = leaves
        for h in range(height):
            for i, path in enumerate(paths):
                beside = (i >> h) ^ 1
                assert path[h] == (level[beside] if beside < len(level) else None)
            level = [digest("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        assert level == [merkle.top(leaves, height)] and max(most) <= height + 1


# ---- secrets

def base_spans(text):
    out = []
    for k, (kind, pattern, flags, ok) in enumerate([
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
        ("access", "AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    ]):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, flags) if ok(m)]
    return [x[2] for x in sorted(out)]


def odd_texts():
    rng = random.Random(3)
    parts = ["password", "PassWd", "toKen", "toKen", "ſecret", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "abcdef", "é", "🎉", "AKIA", "AKIAAB", "0123456789ABCDEF", "deadbeef" * 2, "cafe1234", "\n", "x", "-", ".", "ghij12"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(600)]
    return [*texts, None, "", "e" * 100_000, "token=" * 2000, "AKIA" * 4000, "eyJ" * 30_000, "token" + " " * 50_000 + "= abcdefg", texts[0], texts[0]]


def test_secrets_equal_brute_force(spark):
    texts = odd_texts()
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, texts[1], "en", "s", 0), (3, texts[3], "en", "s", 0)]
    got = secrets.secrets(table(spark, rows).repartition(3)).collect()
    want = Counter((i, hashlib.sha256(",".join(base_spans(t or "")).encode()).hexdigest()) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    for r in got:
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(r.spans.count(k + ":") for k in ("assign", "access", "hex"))
    assert secrets.secrets(table(spark, [])).count() == 0


def test_added_rules_and_order_of_spans(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\n" + "Ab3+" * 20 + "\n-----END RSA PRIVATE KEY-----"
    text = f"é {key} https://me:secret99@host/x eyJ{'a' * 12}.eyJ{'b' * 12}.{'Z' * 30} token={'ab' * 14}"
    (r,) = secrets.secrets(table(spark, [(1, text, "en", "s", 0)])).collect()
    found = [x.split(":") for x in r.spans.split(",")]
    assert [k for k, _, _ in found] == ["pem", "login", "ticket", "assign", "hex"]
    assert [text[int(a) : int(b)] for _, a, b in found][0] == key and ",".join(base_spans(text)) in r.spans


def test_ledger_scans_unseen_pairs_only(spark, tmp_path):
    path = str(tmp_path / "ledger")
    row = lambda i, t: (i, t, "en", "s", 0)
    first = table(spark, [row(1, "token=abcdefgh"), row(2, "token=abcdefgh"), row(3, "plain"), row(4, None)])
    base = secrets.BASE
    done = secrets.update(first, path, base)
    assert done.count() == 3 and all(sorted(r.rules) == ["access@1", "assign@1", "hex@1"] for r in done.collect())
    assert secrets.update(first, path, base).count() == 0
    # a new text, and texts that were seen: only the new one is scanned
    second = first.union(table(spark, [row(5, "AKIA" + "A" * 16), row(6, "plain")]))
    assert [len(r.spans) for r in secrets.update(second, path, base).collect()] == [1]
    # a new version of a rule: every blob once, with that rule only; its spans replace the old ones
    newer = (base[0]._replace(version=2, pattern=r"(token)=([a-z]{3})", least=3), *base[1:])
    third = secrets.update(second, path, newer).collect()
    assert len(third) == 4 and all(r.rules == ["assign@2"] for r in third)
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.findings(second, path, newer).collect()}
    assert spans == {1: [("assign", 0, 9)], 2: [("assign", 0, 9)], 3: [], 4: [], 5: [("access", 0, 20)], 6: []}
    old = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.findings(second, path, base).collect()}
    assert old[1] == [("assign", 0, 14)] and old[5] == spans[5]


def test_secret_query_covers_the_documents(spark):
    got = {r.doc_id: r.base_sha256 for r in entry.op13_secret_scan(spark, SF).collect()}
    rows = read(spark, SF, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert got == {r.doc_id: hashlib.sha256(",".join(base_spans(r.text)).encode()).hexdigest() for r in rows}
