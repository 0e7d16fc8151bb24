import os

import duckdb
import pandas as pd
import pytest

from voxelith.operators import lineage as L
from voxelith.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert set(got.columns) == set(want.columns)
    c = sorted(want.columns)
    key = lambda d: d[c].astype(object).where(d[c].notna(), None).sort_values(c, key=lambda s: s.map(str)).reset_index(drop=True)
    assert len(got) == len(want)
    pd.testing.assert_frame_equal(key(got), key(want), check_dtype=False)


def test_components_agree_over_tile_sizes(spark):
    from voxelith.operators import tiles
    from voxelith.plans.views import view

    fg = view(spark, SF, "vox").where("v >= 30")
    a, b = (tiles.connected_components(fg, 18, n).groupBy("component").count().toPandas()["count"].sort_values().tolist() for n in (5, 64))
    assert a == b


def test_h_choice_fixture(spark):
    for n, want in (([1, 2, 2, 2, 3], (1, 18)), ([1, 2, 2, 2, 2, 2, 3], (2, 16))):
        rows = spark.createDataFrame([(1, 18 - 2 * i, k) for i, k in enumerate(n)], "cell int, h int, n int")
        r = L.choose_h(rows).first()
        assert (r.seeds, r.h) == want


def test_chain_series_fixture(spark):
    cells = spark.createDataFrame([(10002, 10), (20002, 20), (30002, 30)], "cell_id long, volume long")
    edges = spark.createDataFrame([(10002, 20002, 1), (20002, 30002, 1)], "parent long, child long, ord int")
    assert [r.series for r in L.chain_volumes(edges, cells).orderBy("place").collect()] == [10, 10, 20]


def test_names(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("a7.0003*",), ("a7.12*",)], "n string").select(L.daughter_name(F.col("n"), F.lit(1)).alias("a"), L.daughter_name(F.col("n"), F.lit(2)).alias("b"), L.pad_name(F.col("n")).alias("p")).collect()
    assert (d[0].a, d[0].b) == ("a8.0005*", "a8.0006*") and d[0].p == "a7.003*" and d[1].p == "a7.012*"


def test_block_match_finds_a_shift(spark):
    from voxelith.plans.queries import QUERIES as Q

    m = {(r.i, r.j): r.v for r in Q["block_match"](spark, "/root/testdata/sf0.01").collect()}
    assert abs(m[0, 3] - 1) < 0.34 and abs(m[1, 3]) < 0.34
