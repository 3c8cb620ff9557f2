"""Pages from key ranges equal sorted pages and read one or two ranges."""

import pytest
from pyspark.sql import functions as F

from hygeia.operators.paging import key_index


def test_equal_to_offset(spark):
    df = spark.range(5_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000))).alias("k"), "id", F.lit("x").alias("_r"))
    index = key_index(df, ["k", "id"], rows_per_range=300)
    order = [F.desc("k"), F.desc("id")]
    for no, size in [(1, 50), (7, 50), (99, 50), (100, 50), (101, 50), (2, 500), (3, 17), (10_000, 500)]:
        got = [tuple(r) for r in index.page(no, size).collect()]
        assert got == [tuple(r) for r in df.orderBy(*order).offset((no - 1) * size).limit(size).collect()], (no, size)
    assert index.total == 5_000 and index.ranges.count() > 5
    assert max(len(index.touched(no, 50)) for no in (1, 30, 60, 100)) <= 2
    plan = index.page(60, 50)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_range" in plan or "_range" in plan.split("PartitionFilters")[1][:80]


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "a"), (2, "b"), (1, "c")], "k bigint, v string")
    assert [r.v for r in key_index(df, ["k"], 1).page(1, 3).collect()] == ["b", "c", "a"]
    assert key_index(df.limit(0), ["k"]).page(1, 50).collect() == []
    with pytest.raises(ValueError):
        key_index(df, ["k"]).page(0, 50)
