"""Customer segments: k-means over standardised recency, frequency and monetary value."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Segment names, from the lowest to the highest mean spend of a cluster.
SEGMENTS = ("Budget Buyers", "Regular Customers", "Loyal Customers", "Top Customers")
SEEDS = tuple(range(42, 52))
FEATURES = ("recency", "frequency", "monetary")


@dataclass(frozen=True)
class SegmentModel:
    """Scaling of the features, centres in scaled units, and the summed squared distances to them."""

    means: tuple[float, ...]
    deviations: tuple[float, ...]
    centers: tuple[tuple[float, ...], ...]
    cost: float

    def save(self, spark: SparkSession, path: str) -> None:
        row = (list(self.means), list(self.deviations), [list(c) for c in self.centers], self.cost)
        kinds = "means array<double>, deviations array<double>, centers array<array<double>>, cost double"
        spark.createDataFrame([row], kinds).coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SegmentModel:
        row = spark.read.parquet(path).first()
        return SegmentModel(tuple(row.means), tuple(row.deviations), tuple(map(tuple, row.centers)), row.cost)

    def scaled(self) -> list[Column]:
        """The features as points; an unknown value stands at zero."""
        raw = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES]
        return [((x - m) / d).alias(f"_x{i}") for i, (x, m, d) in enumerate(zip(raw, self.means, self.deviations))]


def segment(
    rfm: DataFrame, k: int = 4, seeds: Sequence[int] = SEEDS, labels: Sequence[str] = SEGMENTS
) -> tuple[DataFrame, SegmentModel]:
    """``rfm`` with ``cluster`` and ``segment``, and the fitted model: of one clustering per seed the one of lowest cost."""
    if len(labels) != k:
        raise ValueError("segment needs one label per cluster")
    model = fit_segments(rfm, k, seeds)
    return name_segments(apply_segments(rfm, model), labels), model


def scaling_of(rfm: DataFrame) -> SegmentModel:
    """Means and deviations of the features, in one scan, as a model without centres; a feature that never varies keeps its unit."""
    raw = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES]
    moments = rfm.agg(
        F.count(F.lit(1)).alias("n"),
        *[f(x).alias(f"{name}{i}") for i, x in enumerate(raw) for name, f in (("m", F.avg), ("d", F.stddev_samp))],
    ).first()
    if not moments.n:
        raise ValueError("no customers to segment")
    each = range(len(FEATURES))
    return SegmentModel(tuple(moments[f"m{i}"] for i in each), tuple(moments[f"d{i}"] or 1.0 for i in each), (), 0.0)


def fit_segments(
    rfm: DataFrame, k: int = 4, seeds: Sequence[int] = SEEDS, max_rounds: int = 300, tolerance: float = 1e-4
) -> SegmentModel:
    """The best of one k-means per seed.

    All restarts share each scan: a customer meets the centres of every restart still moving, and sums per restart and
    cluster are all that is shuffled or reaches the driver.  A restart begins at the ``k`` customers with the smallest hash of seed and
    id, so the same customers give the same result however they are partitioned, but for the last bits of sums.  A
    cluster that loses all customers keeps its centre; fewer than ``k`` customers repeat as centres.
    """
    scaling = scaling_of(rfm)
    points = rfm.select("customer_id", *scaling.scaled()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centers = _starts(points, k, seeds)
        costs = {}
        for _ in range(max_rounds):
            moving = [s for s in seeds if s not in costs]
            if not moving:
                break
            for seed, (cost, moved) in _round(points, {s: centers[s] for s in moving}).items():
                if np.sqrt(((moved - centers[seed]) ** 2).sum(axis=1)).max() <= tolerance:
                    costs[seed] = cost
                else:
                    centers[seed] = moved
        costs |= {s: cost for s, (cost, _) in _round(points, {s: centers[s] for s in seeds if s not in costs}).items()}
    finally:
        points.unpersist()
    best = min(seeds, key=lambda seed: costs[seed])
    return SegmentModel(scaling.means, scaling.deviations, tuple(map(tuple, centers[best].tolist())), costs[best])


def _starts(points: DataFrame, k: int, seeds: Sequence[int]) -> dict[int, np.ndarray]:
    """For each seed the ``k`` points of the smallest hashes; each task keeps only its own ``k``."""
    text = F.concat_ws(":", F.col("seed").cast("string"), F.col("customer_id").cast("string"))
    each = points.withColumn("seed", F.explode(F.array(*map(F.lit, seeds)))).withColumn("_draw", F.md5(text))
    order = Window.partitionBy("seed").orderBy("_draw", "customer_id")
    drawn = each.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).collect()
    found = {}
    for seed in seeds:
        rows = sorted((r for r in drawn if r.seed == seed), key=lambda r: r["_place"])
        found[seed] = np.array([[rows[j % len(rows)][f"_x{i}"] for i in range(len(FEATURES))] for j in range(k)])
    return found


def _round(points: DataFrame, centers: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
    """Cost of each restart's centres, and where they move to: one aggregation for all restarts."""
    if not centers:
        return {}
    size = len(FEATURES)
    flat = F.array(*[F.array(*map(F.lit, c.ravel().tolist())) for c in centers.values()])
    each = points.withColumn("_run", F.explode(F.array(*map(F.lit, range(len(centers))))))
    at = F.element_at(flat, F.col("_run") + 1)
    k = len(next(iter(centers.values())))
    distance = lambda j: sum((F.col(f"_x{i}") - F.get(at, F.lit(j * size + i))) ** 2 for i in range(size))
    apart = each.withColumns({f"_d{j}": distance(j) for j in range(k)})
    nearest = apart.withColumns({"_cost": F.least(*[f"_d{j}" for j in range(k)]), "_cluster": _nearest([f"_d{j}" for j in range(k)])})
    sums = nearest.groupBy("_run", "_cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_cost").alias("cost"), *[F.sum(f"_x{i}").alias(f"s{i}") for i in range(size)]
    )
    made = {seed: [0.0, c.copy()] for seed, c in centers.items()}
    seeds = list(centers)
    for r in sums.collect():
        of = made[seeds[r["_run"]]]
        of[0] += r.cost
        of[1][r["_cluster"]] = [r[f"s{i}"] / r.n for i in range(size)]
    return {seed: (cost, moved) for seed, (cost, moved) in made.items()}


def _nearest(distances: Sequence[str]) -> Column:
    """Number of the smallest distance; the first of equal ones."""
    least, found = F.least(*distances), F.lit(len(distances) - 1)
    for j in range(len(distances) - 2, -1, -1):
        found = F.when(F.col(distances[j]) == least, j).otherwise(found)
    return found.cast("int")


def apply_segments(rfm: DataFrame, model: SegmentModel) -> DataFrame:
    """``rfm`` with the ``cluster`` whose centre is nearest to each customer."""
    row = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(rfm.columns)]).alias("_row")
    points = rfm.select(row, *model.scaled())
    names = [f"_d{j}" for j in range(len(model.centers))]
    distance = lambda c: sum((F.col(f"_x{i}") - F.lit(x)) ** 2 for i, x in enumerate(c))
    placed = points.withColumns({name: distance(c) for name, c in zip(names, model.centers)})
    return placed.select(
        *[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(rfm.columns)], _nearest(names).alias("cluster")
    )


def name_segments(clustered: DataFrame, labels: Sequence[str] = SEGMENTS) -> DataFrame:
    """Names for the clusters, by ascending mean monetary value."""
    means = clustered.groupBy("cluster").agg(
        F.try_divide(F.sum("monetary").cast("double"), F.count("monetary")).alias("_mean")
    )
    # One row per cluster: at most k, so one task ranks them and every task can hold them.
    place = F.row_number().over(Window.orderBy("_mean", "cluster"))
    names = means.select("cluster", F.element_at(F.array(*map(F.lit, labels)), place).alias("segment"))
    return clustered.join(F.broadcast(names), "cluster").select(*clustered.columns, "segment")
