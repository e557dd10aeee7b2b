"""Hold-out evaluation, automatic bins, first-seen order, sketches: against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.operators.distributions import auto_histogram, readable_step
from tillwise.operators.evaluation import calibration, confusion, ranking_quality, score_counts
from tillwise.operators.ranking import first_seen, running_sums
from tillwise.plans.cells import customers_of, order_cells, order_value_quantile, sketch_up
from tillwise.plans.retention import geo_table


def scored(spark, n, seed, digits):
    rng = random.Random(seed)
    rows = [(round(rng.random(), digits), float(rng.random() < 0.3)) for _ in range(n)]
    return rows, spark.createDataFrame([*rows, (None, 1.0), (0.5, None)], "score double, label double").repartition(7)


@pytest.mark.parametrize("digits", [1, 6])
def test_evaluation(spark, digits):
    rows, frame = scored(spark, 700, digits, digits)
    counts = score_counts(frame, "score", "label")
    pos, neg = ([s for s, y in rows if y == k] for k in (1.0, 0.0))
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = ranking_quality(counts).first()
    assert (got.rows, got.positives) == (700, len(pos)) and got.auc == pytest.approx(auc, rel=1e-12)
    told = confusion(counts, 0.5).first()
    assert told.true_positives == sum(p > 0.5 for p in pos) and told.false_positives == sum(n > 0.5 for n in neg)
    assert told.recall == pytest.approx(told.true_positives / len(pos))
    for r in calibration(counts).collect():
        band = [(s, y) for s, y in rows if min(int(s * 10), 9) == r.band]
        assert r.rows == len(band) and r.observed == pytest.approx(np.mean([y for _, y in band]))
        assert r.mean_score == pytest.approx(np.mean([s for s, _ in band]), abs=1e-6)


def test_evaluation_without_one_class(spark):
    counts = score_counts(spark.createDataFrame([(0.2, 1.0), (0.9, 1.0)], "score double, label double"), "score", "label")
    assert ranking_quality(counts).first().auc is None and confusion(counts, 0.5).first().precision == 1
    empty = score_counts(spark.createDataFrame([], "score double, label double"), "score", "label")
    assert ranking_quality(empty).first().rows == 0 and calibration(empty).count() == 0


def test_running_sums(spark):
    rows = [(k * 7 % 1009, k) for k in range(1009)]
    got = running_sums(spark.createDataFrame(rows, "at long, n long").repartition(9), "at", ["n"]).collect()
    total = 0
    for r in sorted(got, key=lambda r: r["at"]):
        assert r.before_n == total
        total += r.n


def test_first_seen_order(spark):
    rows = [(9, "b"), (3, "c"), (5, "a"), (4, None), (1, "a"), (3, "b"), (8, "d")]
    got = {r.value: r.place for r in first_seen(spark.createDataFrame(rows, "at int, v string"), "v", ["at"]).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 4}


@pytest.mark.parametrize("width,step", [(0.9, 1), (1, 1), (1.1, 2), (2, 2), (2.1, 5), (7, 10), (10, 10), (0.03, 0.05), (230, 500)])
def test_readable_steps(spark, width, step):
    assert spark.range(1).select(readable_step(F.lit(float(width)))).first()[0] == pytest.approx(step)


@pytest.mark.parametrize("values", [[5] * 9, [1, 1, 1, 1, 900], list(range(1000)), [k * k for k in range(400)], [-3, -1, 0, 2], [7]])
def test_automatic_bins(spark, values):
    frame = spark.createDataFrame([(float(v), v % 2) for v in values] + [(None, 1)], "x double, g int")
    got = auto_histogram(frame, "x", ["g"]).collect()
    q1, q3 = np.percentile(values, [25, 75])
    width = max(2 * (q3 - q1) / len(values) ** (1 / 3), (max(values) - min(values)) / 200)
    power = 10.0 ** math.floor(math.log10(width)) if width > 0 else 1
    step = next(m * power for m in (1, 2, 5, 10) if width <= m * power) if width > 0 else 1
    want = {}
    for v in values:
        want[v % 2, math.floor(v / step)] = want.get((v % 2, math.floor(v / step)), 0) + 1
    assert {(r.g, round(r.bin_start / step)): r.customers for r in got} == want
    assert all(r.bin_end - r.bin_start == pytest.approx(step) for r in got)


def test_sketches_of_parts_merge(spark, space):
    """Customers and quantiles by city, from sketches by month, category, city and status."""
    cells = order_cells(space.facts("customer_id", "order_date", "category", "city", "order_status", "payment_amount"))
    sketches = sketch_up(cells)
    exact = {r.city: r for r in cells.groupBy("city").agg(customers_of(cells).alias("n"), F.array_sort(F.collect_list("payment_amount")).alias("paid")).collect()}
    told = sketches.groupBy("city").agg(customers_of(sketches).alias("n"), *[order_value_quantile(q).alias(f"q{int(100 * q)}") for q in (0.1, 0.5, 0.9)])
    for r in told.collect():
        assert abs(r.n - exact[r.city].n) <= max(1, 0.05 * exact[r.city].n)
        paid = exact[r.city].paid
        for q in (0.1, 0.5, 0.9):
            value = 100 * r[f"q{int(100 * q)}"]
            assert sum(p < value for p in paid) / len(paid) - 0.03 <= q <= sum(p <= value for p in paid) / len(paid) + 0.03
    whole, sketched = ({r.city: r for r in geo_table(c).collect()} for c in (cells, sketches))
    assert all(whole[c].revenue == sketched[c].revenue and whole[c].orders == sketched[c].orders for c in whole)
