"""Ranks, quantiles and scores against pandas and numpy, also with heavily repeated values."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillwise.operators.distributions import box_stats, histogram
from tillwise.operators.joins import scalar_of
from tillwise.operators.ranking import (
    bucket_by_cuts,
    exact_quantiles,
    global_rank,
    hash_sample,
    qcut,
    quantile_of_rank,
    rank_cuts,
    top_k,
)

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id bigint, x {kind}").repartition(5)


def hot(n=3000, seed=1):
    """A third of all values are the same."""
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 500, n)
    values[: n // 3] = 77
    return [int(v) for v in rng.permutation(values)]


def test_global_rank_is_first_rank(spark):
    values = hot()
    got = global_rank(frame(spark, values, "int"), "x", ["id"], partitions=7).orderBy("id").toPandas()
    want = pd.Series(values).rank(method="first").astype(int)
    assert got["rank"].tolist() == want.tolist()


def test_global_rank_spreads_a_hot_value(spark):
    df = spark.range(0, 20_000, 1, 5).select("id", F.when(F.col("id") % 10 < 8, 7).otherwise(F.col("id")).alias("x"))
    ranked = global_rank(df, "x", ["id"], partitions=8)
    sizes = [r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 8 and max(sizes) < 4_000


def test_cuts_give_the_buckets_of_ranks(spark):
    rng = np.random.default_rng(3)
    for n in (2, 3, 7, 500):
        rows = [(k, int(rng.integers(0, 4)), float(rng.integers(0, 900)) / 4) for k in rng.permutation(n).tolist()]
        rows[0] = (rows[0][0], None, rows[0][2])
        df = spark.createDataFrame(rows, "id long, few int, many double")
        cuts = rank_cuts(df, ["few", "many"], "id", 5)
        got = df.select(
            "id", bucket_by_cuts("few", "id", cuts["few"]).alias("few"), bucket_by_cuts("many", "id", cuts["many"]).alias("many")
        ).collect()
        for c, name in ((1, "few"), (2, "many")):
            ordered = sorted(rows, key=lambda r: (r[c] is not None, r[c] or 0, r[0]))
            want = {r[0]: max(1, -(-5 * place // (n - 1))) for place, r in enumerate(ordered)}
            assert {r.id: r[name] for r in got} == want
    with pytest.raises(ValueError, match="no quantiles"):
        rank_cuts(spark.createDataFrame([(1, 1)], "id long, x int"), ["x"], "id", 5)


@pytest.mark.parametrize("n", [2, 3, 5, 6, 7, 11, 23, 64, 151])
def test_quantile_of_rank(spark, n):
    df = spark.range(1, n + 1).toDF("rank")
    got = df.select("rank", quantile_of_rank(F.col("rank"), F.lit(n)).alias("b")).orderBy("rank").toPandas()
    want = pd.qcut(pd.Series(range(1, n + 1)), 5, labels=[1, 2, 3, 4, 5]).astype(int)
    assert got["b"].tolist() == want.tolist()


def test_quintile_sizes_of_seven(spark):
    df = spark.range(1, 8).toDF("rank").select(quantile_of_rank(F.col("rank"), F.lit(7)).alias("b"))
    assert [r["count"] for r in df.groupBy("b").count().orderBy("b").collect()] == [2, 1, 1, 1, 2]


def test_one_row_has_no_quantiles(spark):
    df = spark.range(1, 2).toDF("rank")
    with pytest.raises(Exception, match="no quantiles|DIVIDE_BY_ZERO"):
        df.select(quantile_of_rank(F.col("rank"), scalar_of(df, F.count("*"))).alias("b")).collect()


@FEW
@given(st.lists(st.integers(-1000, 1000), min_size=1, max_size=60), st.sampled_from([4, 5]))
def test_exact_quantiles(spark, values, q):
    row = exact_quantiles(frame(spark, values, "int"), "x", q).first()
    want = np.quantile(values, [k / q for k in range(q + 1)])
    assert [row[f"edge_{k}"] for k in range(q + 1)] == pytest.approx(want.tolist())
    assert row.n == len(values)


def test_exact_quantiles_by_group_with_hot_values(spark):
    values = hot()
    pdf = pd.DataFrame({"g": ["hot" if i % 3 else "cold" for i in range(len(values))], "x": values})
    df = spark.createDataFrame(pdf).repartition(6)
    for row in exact_quantiles(df, "x", 4, ["g"]).collect():
        want = pdf[pdf.g == row.g].x.quantile([0, 0.25, 0.5, 0.75, 1]).tolist()
        assert [row[f"edge_{k}"] for k in range(5)] == pytest.approx(want)


def test_exact_quantiles_over_many_partitions(spark):
    values = [float(v) for v in np.random.default_rng(3).normal(size=5000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        row = exact_quantiles(frame(spark, values), "x", 5).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = np.quantile(values, [0, 0.2, 0.4, 0.6, 0.8, 1])
    assert [row[f"edge_{k}"] for k in range(6)] == pytest.approx(want.tolist(), rel=1e-12)


def test_qcut_is_pandas_qcut(spark):
    values = [int(v) for v in np.random.default_rng(5).integers(0, 400, 701)]
    got = qcut(frame(spark, values, "int"), "x", 5, reverse=True, name="b").orderBy("id").toPandas()
    want = pd.qcut(pd.Series(values), 5, labels=[5, 4, 3, 2, 1]).astype(int)
    assert got["b"].tolist() == want.tolist()


def test_qcut_with_repeated_edges(spark):
    values = [1, 1, 1, 1, 1, 1, 2, 3, 4, 5, 6]
    df = frame(spark, values, "int")
    with pytest.raises(ValueError, match="repeat"):
        qcut(df, "x", 5)
    got = qcut(df, "x", 5, duplicates="drop", name="b").orderBy("id").toPandas()["b"].tolist()
    want = pd.qcut(pd.Series(values), 5, labels=False, duplicates="drop") + 1
    assert got == want.tolist()


def test_qcut_leaves_null_without_bucket(spark):
    df = frame(spark, [None, 1, 2, 3, 4, 5, 6], "int")
    assert [r.b for r in qcut(df, "x", 3, name="b").where("x IS NULL").collect()] == [None]


def test_histogram(spark):
    values = hot()
    rows = histogram(frame(spark, values, "int"), "x", 20).collect()
    want, edges = np.histogram(values, bins=20)
    got = {r.bin: r.customers for r in rows}
    assert [got.get(b, 0) for b in range(20)] == want.tolist()
    for r in rows:
        assert (r.bin_start, r.bin_end) == pytest.approx((edges[r.bin], edges[r.bin + 1]))


def test_histogram_of_one_value(spark):
    rows = histogram(frame(spark, [4, 4, 4], "int"), "x", 20).collect()
    assert [(r.bin, r.bin_start, r.bin_end, r.customers) for r in rows] == [(0, 4.0, 4.0, 3)]


def test_box_stats(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 900), "x": np.concatenate([rng.normal(size=880), np.full(20, 9.0)])})
    for row in box_stats(spark.createDataFrame(pdf), "x", "g").collect():
        x = pdf[pdf.g == row.g].x
        q1, q3 = x.quantile(0.25), x.quantile(0.75)
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        assert (row.q1, row.median, row.q3) == pytest.approx((q1, x.median(), q3))
        assert (row.lower_whisker, row.upper_whisker) == (inside.min(), inside.max())
        assert (row.customers, row.outliers) == (len(x), len(x) - len(inside))


def test_sample_is_fixed_and_whole(spark):
    df = spark.range(2000).toDF("id")
    first = {r.id for r in hash_sample(df, "id", 500).collect()}
    again = {r.id for r in hash_sample(df.repartition(9), "id", 500).collect()}
    assert len(first) == 500 and first == again
    assert first != {r.id for r in hash_sample(df, "id", 500, seed=8).collect()}
    assert hash_sample(df.limit(30), "id", 500).count() == 30


def test_top_k(spark):
    rows = top_k(frame(spark, hot(), "int"), "x", 3, ["id"]).collect()
    assert [r.x for r in rows] == sorted(hot(), reverse=True)[:3]
