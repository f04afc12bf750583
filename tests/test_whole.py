"""Queries do the whole job: all rows of their tables, held to brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from twinreel.operators import joins
from twinreel.plans.queries import QUERIES
from twinreel.settings import Settings, clip_bits


def test_partial_clip_pairs_compares_all_documents(spark, tmp_path):
    rng = np.random.default_rng(7)
    words = [f"{'x' * int(rng.integers(1, 9))}{k}" for k in range(900)]
    texts = [list(rng.choice(words, n)) for n in (5, 9, 17, 40, 90, 260, 300, 700, 1300)]
    texts += [texts[8][400:560], texts[7][:650], texts[7][100:180], texts[6][3:250], ["a"], []]
    rows = [(k, " ".join(map(str, t)), None if k == 9 else len(" ".join(map(str, t)))) for k, t in enumerate(texts)] + [(99, None, None), (None, "a b c", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    fps = {k: (float(len(" ".join(map(str, t)))), np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in t], dtype=np.uint32)) for k, t in enumerate(texts)}
    want = {}
    for source, (d_s, long) in fps.items():
        for clip, (d_c, short) in fps.items():
            n = len(short)
            if source == clip or n < 2 or n >= len(long) or not 0.10 <= d_c / d_s < 0.95:
                continue
            apart = [int(np.bitwise_count(long[o : o + n] ^ short).sum()) for o in range(len(long) - n + 1)]
            if min(apart) <= clip_bits(0.55, n):
                want[source, clip] = (round(1 - min(apart) / (32 * n), 6), apart.index(min(apart)))
    got = QUERIES["partial_clip_pairs"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.source, r.clip): (r.similarity, r["at"]) for r in got} == want
    assert {(8, 9), (7, 11), (6, 12)} <= set(want)


def test_pairs_of_tiles_are_not_moved(spark, monkeypatch):
    """Tiles are read from their table by the tasks that compare them; no exchange carries pairs of them."""
    from pyspark.sql import functions as F

    from twinreel.operators import joins
    from twinreel.settings import Settings

    monkeypatch.setattr(joins, "TILE_BLOCKS", 200)
    items = spark.range(60).select("id", F.sequence(60 - F.col("id"), 60 + F.col("id")).alias("n")).selectExpr("id AS idx", "cast(20 + id AS double) AS duration", "transform(n, x -> pmod(xxhash64(x), 4294967296)) AS fp")
    found = joins.partial_clips(items, Settings(partial_similarity=0.8))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    rows = {r.idx: (r.duration, r.fp) for r in items.collect()}
    got = {(r.source, r.clip): r["at"] for r in found.collect()}
    inside = lambda a, b: next((o for o in range(len(a) - len(b) + 1) if a[o : o + len(b)] == b), None)
    want = {(s, c): at for s, (d, a) in rows.items() for c, (e, b) in rows.items() if s != c and 2 <= len(b) < len(a) and e / d < 0.95 and (at := inside(a, b)) is not None}
    assert want and want.items() <= got.items()


def test_spectra_of_clips_are_made_once_for_many_sources(monkeypatch):
    """A tile of fingerprints of one length: each is transformed about once a side, and pairs equal brute force."""
    rng, done, plain = np.random.default_rng(5), [], np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda x, *a, **k: done.append(x.size) or plain(x, *a, **k))
    words = rng.integers(0, 2**32, 40)
    fps = [rng.choice(words, int(n)).tolist() for n in rng.integers(100, 129, 300)]
    fps += [f[9:99] for f in fps[:300]]
    items = pa.array([[{"idx": k, "duration": 1000.0 if k < 300 else 800.0, "fp": f} for k, f in enumerate(fps)]], pa.list_(pa.struct([("idx", pa.int64()), ("duration", pa.float64()), ("fp", pa.list_(pa.int64()))])))
    batch = pa.RecordBatch.from_arrays([items, items], ["sources", "clips"])
    got = {(r["source"], r["clip"]): (r["similarity"], r["at"]) for out in joins.clip_search(Settings(partial_similarity=0.55))([batch]) for r in out.to_pylist()}
    want = {}
    for s, long in enumerate(fps[:300]):
        long = np.array(long, np.uint32)
        for c, short in enumerate(fps[300:], 300):
            n = len(short)
            apart = np.bitwise_count(np.lib.stride_tricks.sliding_window_view(long, n) ^ np.array(short, np.uint32)).sum(axis=1)
            if apart.min() <= clip_bits(0.55, n):
                want[s, c] = (1 - int(apart.min()) / (32 * n), int(apart.argmin()))
    assert len(want) >= 300 and got == want
    assert sum(done) <= 2 * 32 * 128 * 600


def _tile(rng, n, base, folders, frames, side):
    """Items of a tile: bytes that are alike, durations from 60 to 120."""
    body = np.clip(rng.integers(60, 200, (1, frames * side * side)) + rng.integers(-70, 70, (n, frames * side * side)), 0, 255).astype(np.uint8)
    return [
        {"id": base + k, "n_frames": frames, "frames": body[k].tobytes(), "duration": 60.0 + float(rng.integers(0, 61)), "file_size": k % 5, "dev": k % 2, "ino": k % 3, "folder_key": folders[k % len(folders)]}
        for k in range(n)
    ]


def _compared(a, b, s, gates):
    from twinreel.operators import tiles

    batch = pa.RecordBatch.from_arrays([pa.array([a]), pa.array([b or a]), pa.array([b is None]), pa.array([False])], ["a_items", "b_items", "same", "image"])
    rows = [r for out in tiles.compared(s, gates)([batch]) for r in out.to_pylist()]
    got = {(r["a"], r["b"]): (r["difference"], r["flags"]) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("more", [{"ignore_black_pixels": True, "ignore_white_pixels": True}, {}, {"compare_flipped": True}])
def test_differences_come_from_the_sums_of_tiles(monkeypatch, more):
    """No pair is compared a second time for its difference, which is the same to the last bit."""
    from twinreel.operators import tiles

    exact = tiles.exact_differences
    monkeypatch.setattr(tiles, "exact_differences", lambda *_: pytest.fail("compared again"))
    s, rng = Settings(percent=74, **more), np.random.default_rng(11)
    a, b = _tile(rng, 40, 0, ["x"], 3, 5), _tile(rng, 50, 100, ["x"], 3, 5)
    shaped = lambda r: np.frombuffer(r["frames"], np.uint8).reshape(1, 3, 5, 5)
    for left, right in ((a, b), (a, None)):
        want = {}
        for x in left:
            for y in right or left:
                if x["id"] < y["id"]:
                    plain, turned = (float(exact(v, shaped(y), s)[0]) for v in (shaped(x), shaped(x)[..., ::-1]))
                    flip = s.compare_flipped and turned <= s.gray_limit and not plain <= min(turned, s.gray_limit)
                    if flip or plain <= s.gray_limit:
                        want[x["id"], y["id"]] = (turned, 1) if flip else (plain, 0)
        assert want and _compared(left, right, s, False) == want


def test_only_near_durations_are_compared(spark, monkeypatch):
    """Rows of two tiles whose durations are apart are not compared; crowded folders do not meet themselves."""
    from twinreel.operators import compare, tiles

    seen, plain = [], tiles.may_be_near
    monkeypatch.setattr(tiles, "may_be_near", lambda x, y, *a: seen.append(len(x) * len(y)) or plain(x, y, *a))
    monkeypatch.setattr(tiles, "AT_ONCE", 1000)
    s = Settings(percent=80, duration_percent=5, folder_match="different", exclude_hard_links=True)
    rng = np.random.default_rng(12)
    a = _tile(rng, 200, 0, ["x", "y", None], 1, 8)
    got = _compared(a, None, s, True)
    image = lambda r: np.frombuffer(r["frames"], np.uint8).astype(int)
    want = set()
    for x in a:
        for y in a:
            if x["id"] < y["id"] and abs(x["duration"] - y["duration"]) <= 0.05 * min(x["duration"], y["duration"]):
                linked = all(x[c] == y[c] for c in ("dev", "ino", "file_size", "duration"))
                apart = None not in (x["folder_key"], y["folder_key"]) and x["folder_key"] != y["folder_key"]
                if apart and not linked and np.abs(image(x) - image(y)).mean() / 256 <= s.gray_limit:
                    want.add((x["id"], y["id"]))
    assert want and set(got) == want
    assert sum(seen) < 200 * 200 / 4
    monkeypatch.undo()
    monkeypatch.setattr(tiles, "TILE", 20)
    rows = [(r["id"], "/" + r["folder_key"], False, bytearray(r["frames"]), 1, r["duration"], r["file_size"], r["dev"], r["ino"]) for r in a if r["folder_key"]]
    df = spark.createDataFrame(rows, "idx long, folder string, is_image boolean, frames binary, n_frames int, duration double, file_size long, dev long, ino long")
    for few in (tiles.READ_AGAIN, 0):
        monkeypatch.setattr(tiles, "READ_AGAIN", few)
        found = [(r.a, r.b) for r in compare.similar_pairs(df, s).select("a", "b").collect()]
        assert len(found) == len(want) and set(found) == want


def test_pairs_of_a_crowded_block_are_listed_by_many_tasks(spark, monkeypatch):
    """One block holds nearly all rows: its pairs are whole, also of repeated ids, and dealt to tasks."""
    from pyspark.sql import functions as F

    from twinreel.operators import joins

    monkeypatch.setattr(joins, "TILE_ROWS", 50, raising=False)
    given = [("en", k % 390, k) for k in range(400)] + [("de", k, -k) for k in range(5)] + [("fr", 7, 1), ("en", None, 3), (None, 8, 2), (None, 9, 2)]
    rows = spark.createDataFrame(given, "key string, idx int, n int")
    found = joins.pairs_within(rows, ["key"], "idx").withColumn("task", F.spark_partition_id()).collect()
    want = sorted((k, a, m, b, n) for k, a, m in given for j, b, n in given if k is not None and k == j and None not in (a, b) and a < b)
    assert sorted((r.key, r.idx_a, r.n_a, r.idx_b, r.n_b) for r in found) == want
    tasks = [r.task for r in found]
    assert max(map(tasks.count, set(tasks))) < len(want) / 3


@pytest.mark.parametrize("similarity", [0.8, 0.88, 0.9, 0.95, 1.0])
def test_clips_are_found_by_windows_as_by_brute_force(monkeypatch, similarity):
    """From 0.9 on no spectra are needed, but where windows are alike; bits differ up to the budget and beyond."""
    rng = np.random.default_rng(5)
    s = Settings(partial_similarity=similarity)
    blocks = lambda n: rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)
    items = [(k, float(rng.integers(50, 90)), blocks(int(rng.integers(20, 70)))) for k in range(30)]
    for k in range(120):
        long = items[int(rng.integers(0, 30))][2]
        n = 2 * int(rng.integers(1, (len(long) - 1) // 2 + 1)) if k % 2 else int(rng.integers(13, len(long)))
        at = int(rng.integers(0, len(long) - n + 1))
        clip, apart = long[at : at + n].copy(), max(0, clip_bits(similarity, n) + int(rng.integers(-2, 3)))
        for b in np.arange(apart) * (32 * n) // max(1, apart) if k % 3 else rng.choice(32 * n, apart, replace=False):
            clip[b // 32] ^= np.uint32(1) << np.uint32(b % 32)
        items.append((100 + k, float(rng.integers(10, 60)), clip))

    def found(items):
        kind = pa.list_(pa.struct([("idx", pa.int64()), ("duration", pa.float64()), ("fp", pa.list_(pa.int64()))]))
        side = pa.array([[{"idx": i, "duration": d, "fp": fp.tolist()} for i, d, fp in items]], kind)
        batch = pa.RecordBatch.from_arrays([side, side], ["sources", "clips"])
        got = [r for out in joins.clip_search(s)([batch]) for r in out.to_pylist()]
        assert len({(r["source"], r["clip"]) for r in got}) == len(got)
        return {(r["source"], r["clip"]): (r["similarity"], r["at"]) for r in got}

    def listed(items):
        want = {}
        for i, d, long in items:
            for j, e, clip in items:
                n = len(clip)
                if i != j and n < len(long) and 0.10 <= e / d < 0.95:
                    apart = [int(np.bitwise_count(long[o : o + n] ^ clip).sum()) for o in range(len(long) - n + 1)]
                    if min(apart) <= clip_bits(similarity, n):
                        want[i, j] = (1 - min(apart) / (32 * n), apart.index(min(apart)))
        return want

    again = np.resize(blocks(3), 60)
    alike = [(900 + k, 80.0, again) for k in range(20)] + [(930 + k, 30.0, again[k : 24 + k]) for k in range(20)]
    assert found(alike) == listed(alike) != {}
    if similarity >= 0.9:
        monkeypatch.setattr(np.fft, "rfft", None)
    assert found(items) == listed(items) and len(listed(items)) > 50
