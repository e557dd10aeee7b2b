"""Segments and churn risk: invariants, and k-means against a plain numpy version."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tillwise.models import churn, segments
from tillwise.plans import risk, segmentation
from tillwise.plans.workspace import Workspace


@pytest.fixture(scope="module")
def segmented(space):
    return segments.segment(space.scores, seeds=(42, 43, 44))


def points(space) -> np.ndarray:
    raw = space.scores.select(*[F.col(c).cast("double") for c in segments.FEATURES]).toPandas().to_numpy()
    return (raw - raw.mean(axis=0)) / raw.std(axis=0, ddof=1)


def lloyd(x: np.ndarray, k: int, seed: int) -> float:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(300):
        nearest = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[nearest == j].mean(axis=0) if (nearest == j).any() else centers[j] for j in range(k)])
        if np.allclose(moved, centers):
            break
        centers = moved
    return ((x[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_all_segments_in_order_of_spend(segmented):
    table, _ = segmented
    means = {r.segment: r.m for r in table.groupBy("segment").agg(F.avg("monetary").alias("m")).collect()}
    assert set(means) == set(segments.SEGMENTS)
    assert [means[s] for s in segments.SEGMENTS] == sorted(means.values())


def test_cost_is_as_low_as_numpy_finds(space, segmented):
    cost = segments.fit_segments(space.scores).cost
    assert cost <= 1.02 * min(lloyd(points(space), 4, seed) for seed in range(10))


def test_best_of_the_restarts(space, segmented):
    for seed in (42, 43, 44):
        single = segments.segment(space.scores, seeds=(seed,))[1].cost
        assert segmented[1].cost <= single + 1e-9


def test_points_go_to_the_nearest_center(space, segmented):
    table, model = segmented
    x = points(space)
    centers = np.array(model.centers)
    want = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    order = [r.customer_id for r in space.scores.select("customer_id").collect()]
    got = {r.customer_id: r.cluster for r in table.select("customer_id", "cluster").collect()}
    assert [got[c] for c in order] == want.tolist()


def test_same_seed_same_segments_whatever_the_partitions(space, segmented):
    again, _ = segments.segment(space.scores.repartition(3), seeds=(42, 43, 44))
    first = segmented[0].select("customer_id", "segment")
    assert first.exceptAll(again.select("customer_id", "segment")).count() == 0


def test_segment_model_is_saved(spark, space, segmented, tmp_path):
    table, model = segmented
    model.save(spark, str(tmp_path / "m"))
    loaded = segments.SegmentModel.load(spark, str(tmp_path / "m"))
    assert loaded == model
    back = segments.apply_segments(space.scores, loaded).select("customer_id", "cluster")
    assert back.exceptAll(table.select("customer_id", "cluster")).count() == 0


def test_same_as_numpy_from_the_same_starts(space, segmented):
    """Every restart by plain Lloyd rounds from the customers of the smallest hashes."""
    x = points(space)
    ids = [r.customer_id for r in space.scores.select("customer_id").collect()]
    results = {}
    for seed in (42, 43, 44):
        order = sorted(range(len(ids)), key=lambda j: (hashlib.md5(f"{seed}:{ids[j]}".encode()).hexdigest(), ids[j]))
        centers = x[order[:4]]
        while True:
            apart = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
            nearest = apart.argmin(axis=1)
            moved = np.array([x[nearest == j].mean(axis=0) if (nearest == j).any() else centers[j] for j in range(4)])
            if np.sqrt(((moved - centers) ** 2).sum(axis=1)).max() <= 1e-4:
                break
            centers = moved
        results[seed] = (apart.min(axis=1).sum(), nearest)
    cost, labels = min(results.values(), key=lambda r: r[0])
    assert segmented[1].cost == pytest.approx(cost, rel=1e-9)
    got = {r.customer_id: r.cluster for r in segmented[0].select("customer_id", "cluster").collect()}
    assert [got[c] for c in ids] == labels.tolist()


def test_one_scan_for_all_restarts(spark, space, monkeypatch):
    rounds = []
    own = segments._round
    monkeypatch.setattr(segments, "_round", lambda points, centers: rounds.append(len(centers)) or own(points, centers))
    segments.fit_segments(space.scores, seeds=range(6))
    assert rounds[0] == 6 and rounds == sorted(rounds, reverse=True) and len(rounds) < 100


def test_few_customers(spark):
    few = spark.createDataFrame([(1, 3, 1, 5.0), (2, 3, 1, 5.0), (3, None, 2, 9.0)], "customer_id long, recency int, frequency int, monetary double")
    table, model = segments.segment(few)
    assert table.count() == 3 and len(model.centers) == 4
    with pytest.raises(ValueError, match="no customers"):
        segments.segment(few.limit(0))


def test_one_label_per_cluster(space):
    with pytest.raises(ValueError, match="label"):
        segments.segment(space.scores, k=3)


def test_segment_reports(space):
    customers = space.scored_segments
    n = customers.count()
    sizes = segmentation.segment_sizes(customers).collect()
    assert sum(r.customers for r in sizes) == n and sum(r.share for r in sizes) == pytest.approx(1)
    for report in (segmentation.recency_histogram, segmentation.spend_histogram, segmentation.segment_age):
        assert sum(r.customers for r in report(customers).collect()) == n
    for metric in ("recency", "frequency", "monetary", "rfm_score"):
        boxes = segmentation.segment_box(customers, metric).collect()
        assert sum(r.customers for r in boxes) == n
        assert all(r.minimum <= r.lower_whisker <= r.q1 <= r.median <= r.q3 <= r.upper_whisker <= r.maximum for r in boxes)
    top = segmentation.customer_table(customers, ["Top Customers"])
    assert {r.segment for r in top.collect()} == {"Top Customers"}
    scores = [r.rfm_score for r in segmentation.customer_table(customers).collect()]
    assert scores == sorted(scores, reverse=True) and len(scores) == n
    shares = segmentation.segment_gender(customers).groupBy("segment").agg(F.sum("share").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in shares)


def test_scores_cover_the_quintiles(space):
    n = space.scores.count()
    for score in ("f_score", "m_score"):
        counts = [r["count"] for r in space.scores.groupBy(score).count().collect()]
        assert len(counts) == 5 and all(abs(c - n / 5) <= 1 for c in counts)


def test_churn_probabilities(space):
    scored = space.churn.collect()
    assert all(0 <= r.churn_prob <= 1 for r in scored)
    agree = sum((r.churn_prob > 0.5) == (r.recency > 180) for r in scored)
    assert agree >= 0.99 * len(scored)
    for r in scored:
        assert r.risk_level == ("High Risk" if r.churn_prob > 0.6 else "Medium Risk" if r.churn_prob > 0.35 else "Low Risk")


def test_importances_sum_to_one(space):
    rows = churn.importances(space.churn_model, space.rfm).collect()
    weights = [r.importance for r in rows]
    assert sum(weights) == pytest.approx(1) and weights == sorted(weights)
    assert rows[-1].feature == "recency"


def test_risk_reports(space):
    n = space.churn.count()
    mix = risk.risk_mix(space.churn).collect()
    assert [r.risk_level for r in mix] == list(churn.RISK_LEVELS)
    assert sum(r.customers for r in mix) == n and sum(r.share for r in mix) == pytest.approx(1)
    assert sum(r.customers for r in risk.probability_histogram(space.churn).collect()) == n
    listed = risk.high_risk_list(space.churn_segments).collect()
    assert len(listed) == mix[0].customers
    assert all(r.churn_risk.endswith("%") for r in listed)


def test_what_if(space):
    asked = risk.idle_scenarios(space.rfm, days=1000)
    answers = risk.what_if(space.churn_model, asked).collect()
    assert len(answers) == space.rfm.count()
    assert all(r.risk_level == "High Risk" and r.percent == r.churn_prob * 100 for r in answers)


def test_no_model_without_rows_or_classes(spark, space):
    assert churn.train_churn(space.rfm.limit(19)) is None
    assert churn.train_churn(space.rfm.where("recency <= 180")) is None


def test_risk_needs_no_segments(spark, data, space, monkeypatch):
    def never(*args, **kwargs):
        raise AssertionError("segments were asked for")

    monkeypatch.setattr("tillwise.plans.workspace.segment", never)
    monkeypatch.setattr("tillwise.plans.rfm.rank_cuts", never)
    other = Workspace(spark, data)
    other.__dict__.update(rfm=space.rfm, churn_model=space.churn_model)
    assert other.churn.count() == space.churn.count()


def test_label_limit_is_strict(spark):
    df = spark.createDataFrame([(180,), (181,)], "recency int")
    assert [r.y for r in df.select(churn.at_risk().alias("y")).collect()] == [0.0, 1.0]


def test_holdout(space):
    model = churn.train_churn(space.rfm, trees=5, holdout=0.3)
    kept_out = churn.score_churn(model, space.rfm.where(churn.held_out(0.3)))
    assert 0 < kept_out.count() < space.rfm.count()


def test_churn_model_is_saved(space, tmp_path):
    space.churn_model.write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    a = churn.score_churn(loaded, space.rfm).select("customer_id", "churn_prob")
    assert a.exceptAll(space.churn.select("customer_id", "churn_prob")).count() == 0


def test_missing_rating_scores_as_zero(space):
    blank = space.rfm.limit(3).withColumn("avg_rating", F.lit(None).cast("double"))
    assert [r.avg_rating for r in churn.score_churn(space.churn_model, blank).collect()] == [None] * 3


def test_kept_node_ids_change_no_tree(space, monkeypatch):
    """Rows stay at their node from level to level, and the forest is that of rows sent through the trees anew."""
    own = churn.RandomForestClassifier
    kept = churn.train_churn(space.rfm, trees=5).stages[-1]
    monkeypatch.setattr(churn, "RandomForestClassifier", lambda **given: own(**{**given, "cacheNodeIds": False}))
    anew = churn.train_churn(space.rfm, trees=5).stages[-1]
    assert kept.getCacheNodeIds() and not anew.getCacheNodeIds()
    trees = [[t.toDebugString.split("\n", 1)[1] for t in forest.trees] for forest in (kept, anew)]
    assert trees[0] == trees[1] and len(trees[0]) == 5
