import glob
import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinreel.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def value(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return "none"
    if hasattr(x, "__len__") and not isinstance(x, (str, bytes, dict)):
        return str([value(y) for y in x])
    if isinstance(x, str) or "bool" in type(x).__name__:
        return str(x)
    try:
        f = float(x)
    except (TypeError, ValueError):
        return str(x)
    return "none" if math.isnan(f) else repr(f)


def rows(frame):
    return sorted(tuple(value(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def of_tables(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables made from the given DuckDB queries."""
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        table = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW given_{table} AS SELECT * FROM read_parquet('{f}')")
        if table in tables:
            con.execute(f"COPY ({tables[table]}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return rows(QUERIES[name](spark, str(folder)).toPandas()), rows(con.execute(SQL[name]).df())


def test_missing_entries_where_paths_repeat(spark, tmp_path):
    """A copy of each page under another number: a file of the same path does not stand for it."""
    pages = "SELECT * FROM given_pages UNION ALL SELECT * REPLACE (page_id + 1000 AS page_id) FROM given_pages UNION ALL SELECT * REPLACE (NULL AS url) FROM given_pages WHERE page_id = 1"
    got, want = of_tables(spark, tmp_path, "missing_entries", pages=pages)
    assert got == want and got


def test_relative_size_of_exact_halves(spark, tmp_path):
    """0.5 % is +0%, 1.5 % is +2%, 2.5 % is +2%."""
    items = "SELECT * REPLACE (l_orderkey % 3 AS l_orderkey, 200.0 + l_linenumber - 1 AS l_extendedprice) FROM given_lineitem"
    got, want = of_tables(spark, tmp_path, "relative_size", lineitem=items)
    assert got == want and {r[0] for r in got} >= {"best", "+0%", "+1%", "+2%"}


def test_blacklist_entries_of_equal_paths(spark, tmp_path):
    """Entries whose documents are the same stay apart."""
    items = "SELECT * REPLACE (l_linenumber % 2 AS l_suppkey, l_partkey % 5 AS l_partkey) FROM given_lineitem"
    got, want = of_tables(spark, tmp_path, "blacklist_round_trip", lineitem=items)
    assert got == want and len(got) == 10


def test_orders_write_their_keys_alone(spark, monkeypatch):
    from twinreel.sources import tables

    written, cut = [], tables.cut
    monkeypatch.setattr(tables, "cut", lambda df: written.append(set(df.columns)) or cut(df))
    assert QUERIES["sorted_by_group_total_up"](spark, SF).count() > 0
    assert written == [{"group_id", "pos", "group_total", "part_"}]


def test_orders_move_rows_once_after_their_keys(spark):
    """Ranges are written in order: places are not dealt out and sorted again by partition."""
    from twinreel.operators import ranking

    rows = spark.range(500).selectExpr("pmod(hash(id), 90) AS x", "id")
    out = ranking.ordinals(rows, [F.desc("x"), F.asc("id")], "place")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "row_number" not in plan
    got = [r.id for r in out.orderBy("place").collect()]
    assert got == [r.id for r in rows.orderBy(F.desc("x"), "id").collect()] and [r.place for r in out.orderBy("place").collect()] == list(range(500))


def most_rows(spark, df):
    """The most rows that a join of a query's plan gives when it runs."""
    import re

    df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    run = store.executionsList().apply(store.executionsList().size() - 1).executionId()
    values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes().iterator()
    while nodes.hasNext():
        node = nodes.next()
        metrics = node.metrics().iterator() if "Join" in node.name() else iter(())
        while hasattr(metrics, "hasNext") and metrics.hasNext():
            m = metrics.next()
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most = max(most, int(re.sub(r"\D", "", values.apply(m.accumulatorId()))))
    return most


def test_relocation_lists_no_pairs(spark, tmp_path):
    """A thousand parts and a thousand suppliers of one size: no join of all with all."""
    part = "SELECT * REPLACE (i::BIGINT * 7 AS p_partkey, 6::INT AS p_size, repeat('x', (i % 40)::INT) AS p_name) FROM (FROM given_part LIMIT 1), range(1000) t(i)"
    supplier = "SELECT * REPLACE (i::BIGINT * 50 + 5 AS s_suppkey, CASE WHEN i = 3 THEN repeat('y', 39) ELSE 'zz' END AS s_name) FROM (FROM given_supplier LIMIT 1), range(1000) t(i)"
    got, want = of_tables(spark, tmp_path, "relocation", part=part, supplier=supplier)
    assert got == want and got
    assert most_rows(spark, QUERIES["relocation"](spark, str(tmp_path))) < 50_000


def test_blacklist_meets_groups_under_rare_paths(spark, tmp_path):
    """A path that all groups and entries have gives no pairs of all of them."""
    items = "SELECT * REPLACE (i::BIGINT AS l_orderkey, CASE WHEN k = 0 THEN 7 ELSE 100 + i // 2 END::BIGINT AS l_partkey) FROM (FROM given_lineitem LIMIT 1), range(900) t(i), range(2) u(k)"
    got, want = of_tables(spark, tmp_path, "blacklist_containment", lineitem=items)
    assert got == want and got
    assert most_rows(spark, QUERIES["blacklist_containment"](spark, str(tmp_path))) < 50_000


@pytest.mark.parametrize("name", ["places_in_group", "finished_results"])
def test_windows_over_groups_take_more_partitions_not_larger_ones(spark, monkeypatch, name):
    from twinreel.operators import ranking

    monkeypatch.setattr(ranking, "ROWS_AT_ONCE", 100)
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= 50


PAIRS = ["gray_pairs", "gray_flip_pairs", "gray_pairs_masked", "compare_pairs", "compare_pairs_gated", "compare_images_masked"]


@pytest.mark.parametrize("name", PAIRS)
def test_frames_are_compared_without_a_row_for_each_candidate(spark, name):
    assert most_rows(spark, QUERIES[name](spark, SF)) < (1600 if name.startswith("compare") else 100)


@pytest.mark.parametrize("name", PAIRS)
def test_frames_in_many_small_tiles(spark, duck, monkeypatch, name):
    from twinreel.operators import tiles

    monkeypatch.setattr(tiles, "TILE", 60)
    monkeypatch.setattr(tiles, "AT_ONCE", 500)
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert rows(got) == rows(want) and len(got)


def test_hashes_of_many_frames_are_those_of_each(monkeypatch):
    import numpy as np

    from twinreel.sources import media

    frames = np.random.default_rng(3).integers(0, 256, (70, 1024)).astype(np.uint8)
    monkeypatch.setattr(media, "AT_ONCE", 16)
    assert media.dct_phashes(frames).tolist() == [media.dct_phash(f) for f in frames]


def test_cleared_catalog_reads_its_table(spark):
    from twinreel.operators import maintenance
    from twinreel.plans import adapters

    catalog = adapters.catalog(spark, SF)
    assert sum(r.entries for r in QUERIES["cleared_catalog"](spark, SF).collect()) == catalog.count() > 0
    assert maintenance.cleared(catalog).count() == 0
