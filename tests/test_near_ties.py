"""Values that are equal but for their last bits rank as equal, as in the SQL."""

import datetime

import duckdb

from stratamol.plans import catalog

COLS = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def test_largest_deviation(spark, tmp_path):
    day = datetime.datetime(1995, 1, 1)
    rows = []
    for model, places in ((1, ((0.0, 0.0), (0.05, 0.0))), (2, ((0.0, 0.02), (0.07, 0.0)))):  # moves of 2 and 2.000000000000001
        rows += [(k, 1, 1, model, 5.0, 1.0, y, z, "A", "O", day) for k, (y, z) in enumerate(places)]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, COLS).coalesce(1).write.parquet(path)
    c = duckdb.connect()
    c.sql(f"create view lineitem as from '{path}/*.parquet'")
    want = c.sql(catalog.ORACLES["compared_structures"]).df()
    got = catalog.QUERIES["compared_structures"](spark, str(tmp_path)).toPandas()
    assert got["worst"].tolist() == want["worst"].tolist() == ["A:GLY0"]
    assert got["max_deviation"].tolist() == want["max_deviation"].tolist() == [2.0]
