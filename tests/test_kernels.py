import lists
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinreel.functions import kernels as K
from twinreel.functions import scalars as S
from twinreel.operators import grouping as G
from twinreel.operators import joins as J
from twinreel.settings import Settings, clip_bits
from twinreel.sources import media
from twinreel.sources import tables as T
from twinreel.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*values):
    return F.array(*(F.lit(v) for v in values))


def longs(*values):
    return F.array(*(F.lit(v).cast("long") for v in values))


def test_thresholds():
    assert abs(Settings().gray_limit - 0.04000002) < 1e-8
    assert [Settings(percent=p).phash_bits for p in (96, 95, 90, 75)] == [2, 3, 6, 16]
    assert clip_bits(0.8, 10) == 63
    assert Settings.from_json('{"Percent": 90, "IncludeImages": false}') == Settings(percent=90, include_images=False)
    assert Settings.from_json("no json") == Settings()


def test_gray(spark):
    assert one(spark, K.gray_difference(arr(0, 0), arr(255, 255))) == 255 / 256
    a, b = [40 + i % 40 for i in range(64)], [170 + i % 40 for i in range(64)]
    assert one(spark, K.gray_difference_masked(arr(*a), arr(*b), True, True)) == pytest.approx(130 / 256)
    assert one(spark, K.gray_difference_masked(arr(0), arr(9), True, False)) is None
    assert one(spark, K.flip(K.flip(arr(*range(9)), 3), 3)) == list(range(9))
    assert one(spark, K.is_bright(arr(*[0] * 79, *[99] * 21))) and not one(spark, K.is_bright(arr(*[0] * 80, *[99] * 20)))


def test_alignment_and_votes(spark):
    short, long = longs(0xDEADBEEF, 0xCAFEBABE), longs(0, 0x11111111, 0xDEADBEEF, 0xCAFEBABE, 0x22222222)
    assert tuple(one(spark, K.best_alignment(short, long, 0.8))) == (0, 2)
    assert tuple(one(spark, K.best_alignment(short, short, 0.8))) == (0, 0)
    for votes, out in (([1, 1, 1, 0, 0], 1), ([1, 1, 0, 0], 0)):
        assert spark.createDataFrame([(v,) for v in votes], "v long").agg(K.majority_vote(F.col("v")).alias("x")).first()["x"] == out
        assert media.majority(votes) == out
    chroma = [1.0] + [0.0] * 11
    assert one(spark, K.chroma_code(arr(*chroma))) == media.code(np.array(chroma)) == 1 << 0 | 1 << 12 | 1 << 24


def test_tolerance(spark):
    s = Settings(duration_percent=1, duration_min_s=5, duration_max_s=10)
    assert [one(spark, J.tolerance(s, F.lit(float(d)))) for d in (60, 700, 3600)] == [5, 7, 10]
    assert one(spark, J.tolerance(Settings(duration_percent=0, duration_min_s=5, duration_max_s=15), F.lit(60.0))) == 15


def test_band_join_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    d = [float(x) for x in rng.integers(1, 400, 120)]
    df = spark.createDataFrame(list(enumerate(d)), "idx int, duration double")
    for s in (Settings(duration_percent=20), Settings(duration_percent=5, duration_min_s=3, duration_max_s=9), Settings(duration_percent=0, duration_min_s=2, duration_max_s=4)):
        tol = dict(df.select("idx", J.tolerance(s, F.col("duration")).alias("t")).collect())
        want = {(a, b) for a in range(120) for b in range(a + 1, 120) if abs(d[a] - d[b]) <= min(tol[a], tol[b])}
        got = [(r.idx_a, r.idx_b) for r in J.band_join(df, s).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_hamming_join_is_exact(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**62), 2**62, 20)
    h = [int(b) ^ sum(1 << int(x) for x in rng.choice(62, k, replace=False)) for b in base for k in (0, 1, 2, 4)]
    df = spark.createDataFrame(list(enumerate(h)), "idx int, phash long")
    want = {(a, b) for a in range(len(h)) for b in range(a + 1, len(h)) if bin((h[a] ^ h[b]) & (2**64 - 1)).count("1") <= 3}
    got = [(r.a, r.b) for r in J.hamming_join(df, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize(("options", "crowded"), [({"compare_flipped": True}, 2000), ({"ignore_black_pixels": True}, 9), ({"use_phash": True, "percent": 95.0}, 4)])
def test_candidates_hold_every_similar_pair(spark, monkeypatch, options, crowded):
    """Pairs of all rows against candidates by pivots, stripes, parts of hashes and tiles of crowded keys."""
    from twinreel.operators import compare

    monkeypatch.setattr(compare, "CROWDED", crowded)
    s = Settings(**{"percent": 96.0} | options)
    rng, rows = np.random.default_rng(17), []
    bases = [rng.integers(0, 256, (8, 8)) for _ in range(25)] + [np.full((8, 8), v) for v in (0, 255, 40)]
    for k in range(140):
        x = np.clip(bases[k % len(bases)] + rng.integers(-9, 10, (8, 8)), 0, 255).astype(np.uint8)
        x = x[:, ::-1] if rng.random() < 0.3 else x
        h = int(rng.integers(-(2**62), 2**62)) if k % 4 else 77 ^ (1 << int(rng.integers(0, 60))) ^ (1 << int(rng.integers(0, 60)))
        rows.append((k, k % 3 == 0, 100.0 if k % 2 else float(rng.integers(90, 130)), f"/x/{k % 4}", k, 1, k, h, 1, x.tobytes()))
    frame = spark.createDataFrame(rows, "idx long, is_image boolean, duration double, folder string, file_size long, dev long, ino long, phash long, n_frames int, frames binary")
    met = [(r.a, r.b) for r in compare.candidate_pairs(frame, s).collect()]
    assert len(met) == len(set(met))
    got = {(r.a, r.b): (round(r.difference, 9), r.flags) for r in compare.similar_pairs(frame, s).collect()}

    def apart(x, y):
        keep = (x > K.BLACK) & (y > K.BLACK) if s.ignore_black_pixels else np.ones(x.shape, bool)
        return float(np.abs(x.astype(int) - y.astype(int))[keep].mean() / 256) if keep.any() else 9.0

    want = {}
    for a in rows:
        for b in rows:
            if a[0] >= b[0] or a[1] != b[1] or not (a[1] or abs(a[2] - b[2]) <= 0.2 * min(a[2], b[2])):
                continue
            if s.use_phash and not a[1]:
                n = bin((a[7] ^ b[7]) & (2**64 - 1)).count("1")
                if n <= s.phash_bits:
                    want[a[0], b[0]] = (round(n / 64, 9), 0)
                continue
            x, y = (np.frombuffer(r[9], np.uint8).reshape(8, 8) for r in (a, b))
            plain, turned = apart(x, y), apart(x[:, ::-1], y) if s.compare_flipped else 9.0
            if min(plain, turned) <= s.gray_limit:
                flip = turned <= s.gray_limit and (plain > s.gray_limit or turned < plain)
                want[a[0], b[0]] = (round(turned if flip else plain, 9), int(flip))
    assert got == want and len(want) > 20
    if not s.ignore_black_pixels:  # candidates are near the number of results, far from all pairs
        assert len(met) <= 2 * len(want) + 20


def test_duplicates_equal_a_program_over_lists(spark):
    """find_duplicates against pairs of all entries, groups and splits replayed in order."""
    from twinreel.operators import compare
    from twinreel.plans import adapters

    s = Settings(percent=94, thumbnail_count=4, compare_flipped=True, folder_match="same", exclude_hard_links=True)
    catalog = adapters.media(spark, "/root/testdata/sf0.001").filter("idx % 1000000 < 160")
    rows = [r.asDict() for r in compare.snapshot(catalog, s).collect()]
    assert all(r["is_image"] or len(r["frames"]) == 64 for r in rows)

    def apart(a, b, turned=False):
        n, side = a["n_frames"], int((len(a["frames"]) / a["n_frames"]) ** 0.5)
        x, y = (np.frombuffer(r["frames"], np.uint8).reshape(n, side, side).astype(int) for r in (a, b))
        return float(np.abs((x[:, :, ::-1] if turned else x) - y).mean()) / 256

    key = lambda r: r["folder"].lower().split("/")[-1]
    by, like, pairs = {r["idx"]: r for r in rows}, set(), []
    for a in sorted(rows, key=lambda r: r["idx"]):
        for b in sorted(rows, key=lambda r: r["idx"]):
            if a["idx"] >= b["idx"] or a["is_image"] != b["is_image"]:
                continue
            plain, turned = apart(a, b), apart(a, b, True)
            if plain <= s.gray_limit:
                like.add((a["idx"], b["idx"]))
            near = a["is_image"] or abs(a["duration"] - b["duration"]) <= 0.2 * min(a["duration"], b["duration"])
            linked = all(a[c] == b[c] for c in ("dev", "ino", "file_size")) and (a["is_image"] or a["duration"] == b["duration"])
            if near and key(a) == key(b) and not linked and min(plain, turned) <= s.gray_limit:
                flip = turned <= s.gray_limit and (plain > s.gray_limit or turned < plain)
                pairs.append((a["idx"], b["idx"], turned if flip else plain, int(flip)))
    # a component is replayed by itself
    labels = {n: n for p in pairs for n in p[:2]}
    for _ in labels:
        for a, b, *_x in pairs:
            labels[a] = labels[b] = min(labels[a], labels[b])
    alike, want = (lambda x, y: (min(x, y), max(x, y)) in like), {}
    for component in set(labels.values()):
        found, _ = lists.guarded_groups([p for p in pairs if labels[p[0]] == component], alike)
        groups = {}
        for m, (g, *_x) in found.items():
            groups.setdefault(g, []).append(m)
        for members in groups.values():
            for part in [sorted(members)] if len(members) < 3 else lists.pruned(members, alike):
                want |= {m: (min(part), round(found[m][1], 9), found[m][2]) for m in part}
    got = {r.idx: (r.group_id, round(r.difference, 9), r.flags) for r in compare.find_duplicates(catalog, s).collect()}
    assert got == want and len({g for g, *_x in want.values()}) > 3 and any(f for *_x, f in want.values())
    assert all(by[m]["is_image"] == by[g]["is_image"] for m, (g, *_x) in got.items())


def test_sizes_that_the_planner_knows_stay_real_over_rounds(spark):
    """A chain takes many rounds; a plan over its labels must know the table, not a product of estimates."""
    from twinreel.operators import grouping
    from twinreel.sources.tables import cut, dropped

    links = spark.createDataFrame([(k, k + 1) for k in range(400)], "a long, b long")
    labels = grouping.connected_components(links)
    assert {r.component for r in labels.collect()} == {0} and labels.count() == 401
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size(labels) < 1 << 20
    table = cut(labels.join(links, labels.node == links.a))
    assert size(table) < 1 << 20 and table.count() == 400
    (file,) = {f.rsplit("/", 1)[0].removeprefix("file:") for f in table.inputFiles()}
    dropped(table)
    assert not __import__("os").path.exists(file)


def test_hash_mode_and_unknown_frames(spark):
    from twinreel.operators import compare
    from twinreel.plans import adapters

    s = Settings(percent=96, use_phash=True, thumbnail_count=4)
    rows = compare.snapshot(adapters.media(spark, "/root/testdata/sf0.001"), s)
    got = {(r.a, r.b) for r in compare.similar_pairs(rows.filter("NOT is_image"), s).collect()}
    facts = {r.idx: r for r in rows.filter("NOT is_image").collect()}
    want = {
        (a, b) for a in facts for b in facts
        if a < b and bin((facts[a].phash ^ facts[b].phash) & (2**64 - 1)).count("1") <= 2 and abs(facts[a].duration - facts[b].duration) <= 0.2 * min(facts[a].duration, facts[b].duration)
    }
    assert got == want and got


def test_lifecycle(spark, tmp_path):
    import json
    import zipfile

    from twinreel.operators import maintenance
    from twinreel.plans import adapters
    from twinreel.sources import sinks
    from twinreel.streaming import lifecycle

    said, now = [], iter([0.0, 0.1, 0.4, 0.5])
    report = lifecycle.Progress(lambda *x: said.append(x), clock=lambda: next(now))
    assert [report("s", k, 4) for k in (1, 2, 3, 4)] == [True, False, True, True] and len(said) == 3
    with lifecycle.cancellable(spark, "t"):
        assert spark.range(3).count() == 3
    lifecycle.cancel(spark, "t")
    assert one(spark, lifecycle.key_of(F.lit("/a/b.mp4"))) == __import__("xxhash").xxh64("/a/b.mp4".encode("utf-16-le")).hexdigest()
    rows = adapters.twins(spark, "/root/testdata/sf0.001").filter("group_id < 40")
    assert ("size", "bigint") in lifecycle.expression_help(rows)
    preset = json.dumps({"fileType": 1, "contains": ["*.copy"], "minMb": 1, "identical": 0, "dates": 1})
    out = lifecycle.preset_filter(rows, preset).collect()
    assert len(out) == rows.count() and any(r.checked for r in out)
    assert lifecycle.preset_filter(rows, '{"expression": "fps > 30"}').filter("checked").count() > 0
    doc = json.dumps({"version": 1, "groups": [{"GroupId": "g", "Items": [{"path": "p"}, None]}]})
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("scan.json", "\ufeff" + doc)
        z.writestr("../evil", "x")
    (tmp_path / "r.json").write_text("[" + json.dumps({"GroupId": "h", "Items": [{"path": "q"}]}) + "]")
    assert [tuple(r) for r in lifecycle.imported_results(spark, str(tmp_path / "r.zip"), "struct<path:string>").collect()] == [("g", "p")]
    assert [tuple(r) for r in lifecycle.imported_results(spark, str(tmp_path / "r.json"), "struct<path:string>").collect()] == [("h", "q")]
    for n in (3, 5):
        sinks.write_once(spark.range(n), str(tmp_path / "table"))
        assert spark.read.parquet(str(tmp_path / "table")).count() == n
    assert [p.name for p in tmp_path.iterdir() if ".new-" in p.name or ".old-" in p.name] == []
    (tmp_path / "bad.json").write_text("{")
    names = [sinks.quarantined(spark, str(tmp_path / "bad.json"))]
    (tmp_path / "bad.json").write_text("{")
    names.append(sinks.quarantined(spark, str(tmp_path / "bad.json")))
    assert len(set(names)) == 2 and all(n and ".corrupt-" in n for n in names) and sinks.quarantined(spark, str(tmp_path / "bad.json")) is None
    assert maintenance.normalised_paths(["/a/b/", "/a/./b", " ", "/c"]) == ["/a/b", "/c"]


def test_listing_and_exports_of_files(spark, tmp_path):
    from twinreel.sources import sinks

    for name in ("a/x.mp4", "a/skip/y.mkv", "a/z.txt", "b.JPG"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    got = {r.path.rsplit("/", 1)[1]: r for r in T.listing(spark, str(tmp_path), excluded=(f"{tmp_path}/a/skip",)).collect()}
    assert set(got) == {"x.mp4", "b.JPG"} and got["b.JPG"].is_image and got["x.mp4"].file_size == 5 and got["x.mp4"].folder.endswith("/a")
    assert {r.path.rsplit("/", 1)[1] for r in T.listing(spark, str(tmp_path), images=False).collect()} == {"x.mp4", "y.mkv"}
    entries = T.synthetic_catalog(spark, 20, copies=5)
    assert entries.select("frame").distinct().count() == 4 and entries.select("path").distinct().count() == 20
    assert {len(r.frame) for r in entries.collect()} == {1024} and all(5 <= r.duration_s < 3600 for r in entries.collect())
    text = sinks.catalog_json(spark.createDataFrame([("/a", 5)], "path string, file_size bigint")).select("json")
    text.coalesce(1).write.text(str(tmp_path / "export"))
    assert T.catalog_from_json(spark, str(tmp_path / "export")).first()["file_size"] == 5


def test_dct_hash_is_summed_in_order():
    frames = [np.zeros(1024), np.arange(1024) % 256, np.repeat(np.arange(32) * 8, 32), np.tile(np.arange(32) * 8, 32), np.tile([0, 255], 512)]
    table, alpha = media.cosines(), np.float32(np.sqrt(2 / 32))
    for frame in frames:
        x = frame.astype(np.float32).reshape(32, 32)
        rows = np.zeros((32, 8), np.float32)
        cells = np.zeros((8, 8), np.float32)
        for y in range(32):
            for u in range(8):
                total = np.float32(0)
                for k in range(32):
                    total = np.float32(total + np.float32(x[y, k] * table[u, k]))
                rows[y, u] = alpha * total
        for v in range(8):
            for u in range(8):
                total = np.float32(0)
                for y in range(32):
                    total = np.float32(total + np.float32(rows[y, u] * table[v, y]))
                cells[v, u] = alpha * total
        flat = cells.ravel()
        middle = np.float32((np.sort(flat)[31] + np.sort(flat)[32]) * np.float32(0.5))
        want = sum(1 << i for i in range(64) if flat[i] > middle)
        assert media.dct_phash(frame) & (2**64 - 1) == want


def test_partial_clips_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    long = [int(x) for x in rng.integers(1, 2**32, 30)]
    items = [(0, 30.0, long), (1, 10.0, long[5:15]), (2, 12.0, [x ^ 3 for x in long[2:14]]), (3, 10.0, [int(x) for x in rng.integers(1, 2**32, 10)]), (4, 10.0, [0] * 10)]
    df = spark.createDataFrame(items, "idx int, duration double, fp array<long>")
    got = {(r.source, r.clip): (round(r.similarity, 6), r.at) for r in J.partial_clips(df, Settings()).collect()}
    assert got[0, 1] == (1.0, 5) and got[0, 2] == (round(1 - 24 / 384, 6), 2)
    assert not any(3 in k or 4 in k for k in got)


def test_grouping():
    alike = lambda x, y: {x, y} != {2, 3}
    found, blocked = lists.guarded_groups([(1, 2, 0.1, 0), (1, 4, 0.2, 1), (3, 5, 0.1, 0), (4, 5, 0.3, 0)], alike)
    assert blocked == 0 and {m: v[0] for m, v in found.items()} == {1: 1, 2: 1, 4: 1, 3: 1, 5: 1}
    chain = {(1, 2), (2, 3), (3, 4), (4, 5)}
    parts = lists.pruned([1, 2, 3, 4, 5], lambda x, y: (min(x, y), max(x, y)) in chain)
    assert all(len(p) >= 2 for p in parts) and len({m for p in parts for m in p}) == sum(map(len, parts))


def listed_groups(pairs, close):
    """{member: (group id, difference, flags)} by the list programs, component by component."""
    alike = lambda x, y: (min(x, y), max(x, y)) in close
    root = {n: n for p in pairs for n in p[:2]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, *_ in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {}
    for c in {find(n) for n in root}:
        found, _ = lists.guarded_groups(sorted(p for p in pairs if find(p[0]) == c), alike)
        of = {}
        for m, (g, *_f) in found.items():
            of.setdefault(g, []).append(m)
        for members in of.values():
            for part in [sorted(members)] if len(members) < 3 else lists.pruned(members, alike):
                want |= {m: (min(part), *found[m][1:]) for m in part}
    return want


@pytest.mark.parametrize(("seed", "share"), [(1, 0.5), (2, 0.95)])
def test_groups_in_rows_and_in_rounds_equal_the_list_programs(spark, monkeypatch, seed, share):
    rng = np.random.default_rng(seed)
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 24, (60, 2)) if a != b} | {(100 + i, 101 + i) for i in range(9)} | {(200, 201)})
    pairs = [(a, b, round(float(rng.random()), 3), int(rng.integers(0, 2))) for a, b in edges]
    close = {(a, b) for a in range(0, 130) for b in range(a + 1, 130) if rng.random() < share} | {(a, b) for a, b in edges if rng.random() < share}
    want = listed_groups(pairs, close)
    frame = spark.createDataFrame(pairs, "a long, b long, difference double, flags int")
    similar = spark.createDataFrame(sorted(close), "a long, b long")
    got = lambda n: {r.member: (r.group_id, r.difference, r.flags) for r in G.duplicate_groups(frame, similar, links_at_once=n).collect()}
    assert got(1000) == want
    monkeypatch.setattr(G, "LEAST_SHARE", 0.04 if seed == 1 else 0.3)
    assert got(10) == want


def test_replay_and_pruning_of_a_large_component():
    import time

    began, n = time.time(), 100_000
    chain = [(i, i + 1, 0.1, 0, i, i + 1, False, False) for i in range(n)]
    label, facts = G.replay(chain, {(i, i + 1) for i in range(n)})
    assert label[0] == label[1] == 0 and label[2] == 2 and len(facts) == n + 1 - (n + 1) % 2
    star = [(0, i, 0.1, 0, 0, i, False, False) for i in range(1, n)]
    label, _ = G.replay(star, {(0, i) for i in range(1, n)})
    assert set(label.values()) == {0}
    assert G.pruned(list(range(n)), [(0, i) for i in range(1, n)]) == [[0, n - 2, n - 1]]
    assert time.time() - began < 30


@pytest.mark.parametrize(("seed", "n", "spread", "held"), [(1, 90, 60, 10), (2, 150, 40, 10**9), (3, 120, 48, 500), (4, 140, 30, 0)])
def test_groups_of_points_equal_the_list_programs(spark, monkeypatch, seed, n, spread, held):
    """Links of some pairs, closeness from the points: hashes within 9 bits, and frames within the limit."""
    monkeypatch.setattr(G, "LINKS_HELD", held)
    monkeypatch.setattr(G, "POINTS_AT_ONCE", 200)
    monkeypatch.setattr(G, "THINNED_AT_ONCE", 50)
    rng, s = np.random.default_rng(seed), Settings(percent=94)
    for kind in (0, 1):
        if kind:
            base = rng.integers(0, 256, (4, 64))
            points = np.clip(base[rng.integers(0, 4, n)] + rng.integers(-spread // 2, spread // 2 + 1, (n, 64)), 0, 255).astype(np.uint8)
            alike = lambda i, j: float(np.abs(points[i].astype(int) - points[j]).mean() / 256) <= s.gray_limit
        else:
            base = rng.integers(0, 256, (3, 8), dtype=np.uint8)
            flip = np.packbits(rng.random((n, 64)) < spread / 500, axis=1)
            points = base[rng.integers(0, 3, n)] ^ flip
            alike = lambda i, j: int(np.bitwise_count(points[i] ^ points[j]).sum()) <= 9
        close = {(i, j) for i in range(n) for j in range(i + 1, n) if alike(i, j)}
        linked = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n, (3 * n, 2)) if a != b} | {p for p in close if rng.random() < 0.7}
        pairs = [(a, b, round(float(rng.random()), 3), int(rng.integers(0, 2))) for a, b in sorted(linked)]
        frame = spark.createDataFrame(pairs, "a long, b long, difference double, flags int").repartition(5)
        rows = spark.createDataFrame([(i, kind, bytearray(p.tobytes())) for i, p in enumerate(points)], "node long, n int, point binary")
        got = {r.member: (r.group_id, r.difference, r.flags) for r in G.duplicate_groups_near(frame, rows, G.nearness(s, 9)).collect()}
        assert got == listed_groups(pairs, close) and len(set(g for g, *_x in got.values())) > 1


def test_duplicates_write_no_tables_that_grow_with_the_links(spark, monkeypatch):
    """300 entries that are all alike: 44,850 links, but components, replay and pruning write rows for each entry."""
    from twinreel.operators import compare

    sizes, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: sizes.append((table := cut(df)).count()) or table)
    rows = spark.range(300).selectExpr(
        "id AS idx", "concat('/x/', id) AS path", "'/x' AS folder", "true AS is_image", "true AS has_media", "0 AS flags", "0.0D AS duration", "id AS file_size", "id AS dev", "id AS ino",
        "map(0.0D, unhex(repeat(lpad(hex(id % 3), 2, '0'), 64))) AS gray", "0L AS phash",
    )
    found = compare.find_duplicates(rows, Settings(percent=96)).collect()
    assert len(found) == 300 and {r.group_id for r in found} == {0}
    assert max(sizes) <= 3000


def test_components_and_groups_do_not_depend_on_order(spark):
    rng = np.random.default_rng(4)
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (50, 2)) if a != b})
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    want = {n: find(n) for n in root}
    df = spark.createDataFrame(edges, "a long, b long")
    assert dict(map(tuple, G.connected_components(df).collect())) == want
    pairs = df.select("a", "b", F.lit(0.1).alias("difference"), F.lit(0).alias("flags"))
    once = sorted(map(tuple, G.duplicate_groups(pairs, df).collect()))
    assert once == sorted(map(tuple, G.duplicate_groups(pairs.repartition(7).orderBy(F.rand(3)), df).collect()))


def test_scalars(spark):
    assert one(spark, S.bytes_text(F.lit(0))) == "0 B" and one(spark, S.bytes_text(F.lit(1536))) == "1.5 KB"
    assert one(spark, S.duration_text(F.lit(93784))) == "1d, 2h" and one(spark, S.duration_text(F.lit(65))) == "1m, 5s"
    assert one(spark, S.hdr_format(F.lit("smpte2084"), F.lit("x|DOVI y"))) == "Dolby Vision"
    assert one(spark, S.probe_duration(F.lit("3.9"))) == 3 and one(spark, S.probe_duration(F.lit("0:01:05.5"))) == 65
    assert one(spark, S.frame_rate(F.lit("30000/1001"))) == pytest.approx(29.97, abs=1e-3) and one(spark, S.frame_rate(F.lit("x"))) == -1
    assert one(spark, S.error_category(F.lit("Error: MOOV atom not found"))) == "corrupt"
    assert one(spark, S.arguments(F.lit('-a "b c" d'))) == ["-a", "b c", "d"]
    assert str(one(spark, S.exif_timestamp(F.lit("2020:01:02 03:04:05\0")))) == "2020-01-02 03:04:05"
    assert one(spark, S.glob(F.lit("/A/b.MP4"), "/a/*.mp?"))
    assert one(spark, S.csv_field(F.lit('a,"b"'))) == '"a,""b"""'
    assert one(spark, S.join_path(F.lit("/a/"), F.lit("/b"))) == "/a/b"
    assert S.strategy_name("Smallest-File") == "smallest_file"


def test_probe_and_result_row(spark):
    text = '{"streams":[{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"r_frame_rate":"25/1"},{"codec_type":"audio","codec_name":"aac","channels":2,"sample_rate":"44100"}],"format":{"duration":"61.5","bit_rate":"1500500"}}'
    row = T.probed(spark.createDataFrame([(text,), ("no",)], "probe string"))
    first = row.select("duration_s", *(c.alias(n) for n, c in T.result_row(F.col("streams")).items())).first()
    assert first.duration_s == 61 and first.frame_size == 3000 and first.bitrate == 1500 and first.audio_format == "aac" and first.fps == 25


def test_blacklist_formats(spark):
    df = spark.createDataFrame([('[["a","b"]]',), ('{"version":1,"groups":[["c"]]}',), ("broken",)], "value string")
    assert sorted(r.path for r in T.blacklist_entries(df).collect()) == ["a", "b", "c"]


def test_fingerprint_does_not_depend_on_chunks(spark):
    t = np.arange(11025 * 5) / 11025
    samples = (np.sin(2 * np.pi * 440 * t) * 12000).astype(np.int16)
    whole = media.Fingerprint()
    whole.feed(samples)
    parts = media.Fingerprint()
    for i in range(0, len(samples), 1000):
        parts.feed(samples[i : i + 1000])
    assert whole.finish() == parts.finish() and len(whole.out) >= 3
    rows = [("p", i // 9000, samples[i : i + 9000].tolist()) for i in range(0, len(samples), 9000)]
    df = spark.createDataFrame(rows, "path string, seq int, samples array<short>")
    assert ingest.fingerprints(df).first()["fp"] == whole.out


def test_fingerprint_stream_keeps_state_between_batches(spark, tmp_path):
    t = np.arange(11025 * 4) / 11025
    samples = (np.sin(2 * np.pi * 440 * t) * 12000).astype(np.int16)
    rows = [(p, i // 9000, samples[i : i + 9000].tolist()) for p in ("p", "q") for i in range(0, len(samples), 9000)]
    schema = "path string, seq int, samples array<short>"
    for batch in (rows[1:2], rows[:1] + rows[2:4], rows[4:]):  # the second chunk comes first
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ingest.fingerprint_stream(stream).writeStream.outputMode("update").format("memory").queryName("fps").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    whole = media.Fingerprint()
    whole.feed(samples)
    last = {r.path: r.fp for r in spark.sql("SELECT path, max_by(fp, next) AS fp FROM fps GROUP BY path").collect()}
    assert last == {"p": whole.finish(), "q": whole.out}


def test_fingerprint_state_of_an_abandoned_file_ends(spark, tmp_path):
    """p is left after two of its chunks: it ends once with what it has; its next chunk comes too
    late and is dropped. q goes on."""
    from datetime import datetime, timedelta

    t = np.arange(11025 * 4) / 11025
    samples = (np.sin(2 * np.pi * 440 * t) * 12000).astype(np.int16)
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    chunk = lambda p, k, minutes: (p, k, samples[k * 9000 : (k + 1) * 9000].tolist(), at(minutes))
    schema = "path string, seq int, samples array<short>, arrived timestamp"
    batches = [[chunk("p", 0, 0), chunk("q", 0, 0)], [chunk("p", 1, 1), chunk("q", 1, 1)], [chunk("q", 2, 30)], [chunk("p", 2, 2), chunk("q", 3, 31)], [chunk("q", 4, 32)]]
    source = str(tmp_path / "in")
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(source)
        found = ingest.fingerprint_stream(stream, keep_s=300, late="5 minutes")
        run = found.writeStream.outputMode("update").foreachBatch(lambda df, e, k=k: df.write.mode("overwrite").parquet(str(tmp_path / f"out{k}-{e}")))
        run.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out*")).collect()
    whole, half = media.Fingerprint(), media.Fingerprint()
    whole.feed(samples)
    half.feed(samples[:18000])
    (end,) = [r for r in rows if r.ended]
    assert (end.path, end.next, end.fp) == ("p", 2, half.finish())
    assert max(r.next for r in rows if r.path == "p") == 2
    assert max((r.next, r.fp) for r in rows if r.path == "q") == (5, whole.finish())


def test_dct_hash_ignores_brightness():
    frame = np.random.default_rng(5).integers(0, 200, 1024)
    assert media.dct_phash(frame) == media.dct_phash(frame + 20)
    assert bin(media.dct_phash(frame) & (2**64 - 1)).count("1") == 32


def test_streaming_upsert(spark, tmp_path):
    schema = "k long, v long, t long"
    for i, rows in enumerate(([(1, 1, 1), (2, 5, 1)], [(1, 2, 2)], [(3, 9, 3), (2, 4, 0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.upsert_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, str(tmp_path / "out"), str(tmp_path / "cp"), "k", "t")
    out = str(tmp_path / "out")
    current = lambda: sorted(map(tuple, ingest.upserted_table(spark, out, schema).collect()))
    assert current() == [(1, 2, 2), (2, 5, 1), (3, 9, 3)]
    spark.createDataFrame([(3, 10, 4), (9, 1, 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.upsert_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, out, str(tmp_path / "cp"), "k", "t")
    assert current() == [(1, 2, 2), (2, 5, 1), (3, 10, 4), (9, 1, 1)]


def test_commands(spark, tmp_path):
    from twinreel import cli
    from twinreel.plans import adapters

    library, catalog = tmp_path / "lib", str(tmp_path / "catalog")
    library.mkdir()
    for name in ("a.mp4", "b.mkv", "c.txt"):
        (library / name).write_bytes(b"123")
    do = lambda *words: cli.run(list(words), spark)
    assert do("scan", "--catalog", catalog, "--include", str(library)) == 0
    rows = spark.read.parquet(catalog)
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows.collect()) == ["a.mp4", "b.mkv"]
    spark.createDataFrame([(r.path, 7) for r in rows.collect()], "path string, hash int").join(rows, "path").write.parquet(catalog + "2")
    (library / "a.mp4").write_bytes(b"12345")
    assert do("scan", "--catalog", catalog + "2", "--include", str(library)) == 0
    assert {(r.path.rsplit("/", 1)[1], r.file_size, r.hash) for r in spark.read.parquet(catalog + "2").collect()} == {("a.mp4", 5, None), ("b.mkv", 3, 7)}
    assert do("compare", "--catalog", catalog, "--output", str(tmp_path / "none")) == 1
    adapters.media(spark, "/root/testdata/sf0.001").filter("idx % 1000000 < 60").write.parquet(str(tmp_path / "media"))
    (tmp_path / "s.json").write_text('{"Percent": 94, "ThumbnailCount": 4}')
    assert do("compare", "--catalog", str(tmp_path / "media"), "--output", str(tmp_path / "found"), "--settings", str(tmp_path / "s.json")) == 0
    assert spark.read.parquet(str(tmp_path / "found")).count() > 10
    adapters.groups(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "results"))
    assert do("mark", "--results", str(tmp_path / "results"), "--strategy", "Smallest-File", "--output", str(tmp_path / "plan")) == 0
    plan = spark.read.parquet(str(tmp_path / "plan"))
    assert plan.count() and {r.action for r in plan.collect()} == {"delete"}
    assert do("mark", "--results", str(tmp_path / "results"), "--strategy", "best", "--output", str(tmp_path / "plan")) == 1
    assert do("db", "export", "--catalog", catalog, "--output", str(tmp_path / "json")) == 0 and spark.read.text(str(tmp_path / "json")).count() == 2
    assert do("db", "clear", "--catalog", catalog) == 1 and do("db", "clear", "--catalog", catalog, "--yes") == 0
    assert spark.read.parquet(catalog).count() == 0 and do("db", "export", "--catalog", catalog, "--output", str(tmp_path / "x")) == 1
