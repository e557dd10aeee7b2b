"""Ranks, quantiles, quintile scores, top-k and sampling over tables of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.session import settle

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number in the lower 33 bits


def global_rank(
    df: DataFrame, order: str, tie: Sequence[str], name: str = "rank", partitions: int | None = None
) -> DataFrame:
    """Unique rank 1..n by ``order``, ties by ``tie`` (which must make the order total).

    A window without partitions would sort everything in one task.  Here the rows are range partitioned
    and sorted within their partition, so the row id already holds (partition, position); the rank is the
    position plus the number of rows in earlier partitions.  ``tie`` takes part in the range bounds, so a
    value shared by most rows still spreads.
    """
    keys = [order, *tie]
    placed = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    placed = placed.sortWithinPartitions(*keys).withColumn("_position", F.monotonically_increasing_id())
    placed = settle(placed.withColumn("_part", F.shiftright("_position", _ROW_BITS)))
    # One row per range partition: bounded by the partition count, whatever the data size.
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    position = F.col("_position").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + position + 1)
        .drop("_part", "_position", "_offset")
    )


def running_sums(df: DataFrame, order: str, measures: Sequence[str]) -> DataFrame:
    """``df`` with ``before_<measure>``: the sum over all rows with a smaller ``order``, which must be unique.

    Rows are range partitioned; a partition's sums are added up within it, on top of the totals of the partitions before it.
    """
    placed = settle(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    # One row per range partition: bounded by the partition count, whatever the data size.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(*[F.sum(m).alias(m) for m in measures])
    offsets = totals.select("_part", *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_off_{m}") for m in measures])
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(offsets), "_part")
    sums = {f"before_{m}": F.col(f"_off_{m}") + F.coalesce(F.sum(m).over(within), F.lit(0)) for m in measures}
    return joined.withColumns(sums).drop("_part", *[f"_off_{m}" for m in measures])


def first_seen(df: DataFrame, column: str, sequence: Sequence[str]) -> DataFrame:
    """Distinct known values in the order in which the sequence first shows them: ``(value, place)`` from 1.

    Every task keeps the least sequence of each value; only distinct values are shuffled and ranked.
    """
    least = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*sequence)).alias("_first"))
    ranked = global_rank(least, "_first", [column], "place")
    return ranked.select(F.col(column).alias("value"), F.col("place").cast("int"))


def quantile_of_rank(rank: Column, n: Column, q: int = 5) -> Column:
    """Bucket 1..q of a unique rank 1..n, edges interpolated and right-closed.

    Rank r is in bucket ceil(q(r-1)/(n-1)), the lowest rank in bucket 1.  This is not ``ntile``, whose
    bucket sizes differ for most n.  A single row has no quantiles.
    """
    steps = (rank - 1) * q
    over = F.pmod(steps, n - 1)
    bucket = (steps - over) / (n - 1) + F.when(over > 0, 1).otherwise(0)
    return (
        F.when(n > 1, F.greatest(F.lit(1), bucket.cast("int")))
        .otherwise(F.raise_error(F.lit("one row has no quantiles")))
        .cast("int")
    )


def exact_quantiles(
    df: DataFrame, value: str, q: int, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """The q-quantile edges of ``value``, per group of ``by``, exact for any group size.

    Returns one row per group with its count ``n`` and, for k = 0..q, the order statistics around position
    k(n-1)/q (``lo_k`` and ``hi_k``), the weight ``f_k`` (in q-ths) and ``edge_k = lo + (hi-lo) f/q``.

    Values are counted first, so repeats cost nothing; the distinct values are range partitioned, and only
    the partitions that hold an edge are summed up row by row.  No task sees a whole group.  A ``weight``
    column says how many rows a row stands for.
    """
    by = list(by)
    known = df.where(F.col(value).isNotNull())
    for key in by:
        known = known.where(F.col(key).isNotNull())
    counts = known.groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    placed = settle(
        counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id())
    )
    pieces = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_piece"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        *by,
        "_part",
        "_piece",
        F.coalesce(F.sum("_piece").over(earlier), F.lit(0)).alias("_skip"),
        F.sum("_piece").over(group).alias("n"),
    )
    last = F.col("n") - 1
    low = [F.expr(f"((n - 1) * {k}) div {q}") for k in range(q + 1)]
    part = [F.expr(f"((n - 1) * {k}) % {q}") for k in range(q + 1)]
    high = [F.least(position + 1, last) for position in low]

    def holds(position: Column, start: Column, size: Column) -> Column:
        return (position >= start) & (position < start + size)

    wanted = F.lit(False)
    for position in [*low, *high]:
        wanted = wanted | holds(position, F.col("_skip"), F.col("_piece"))
    within = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.join(pieces.where(wanted), [*by, "_part"]).withColumn(
        "_before", F.col("_skip") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    )

    def at(position: Column) -> Column:
        return F.max(F.when(holds(position, F.col("_before"), F.col("_n")), F.col(value)))

    picked = counted.groupBy(*by, "n").agg(
        *[at(position).alias(f"lo_{k}") for k, position in enumerate(low)],
        *[at(position).alias(f"hi_{k}") for k, position in enumerate(high)],
    )
    picked = picked.withColumns({f"f_{k}": p.cast("int") for k, p in enumerate(part)})
    edges = {}
    for k in range(q + 1):
        lo, hi = F.col(f"lo_{k}").cast("double"), F.col(f"hi_{k}").cast("double")
        edges[f"edge_{k}"] = lo + (hi - lo) * F.col(f"f_{k}") / F.lit(float(q))
    return picked.withColumns(edges)


def qcut(
    df: DataFrame,
    value: str,
    q: int = 5,
    reverse: bool = False,
    duplicates: str = "raise",
    name: str | None = None,
) -> DataFrame:
    """Bucket number of each value by the q-quantiles of the column: right-closed, lowest included.

    Repeated edges are an error, or with ``duplicates="drop"`` merge their buckets.  ``reverse`` numbers
    the buckets downwards.  The q+1 edges are all that reaches the driver; a row is compared with them as
    ``q(x - lo) <= f(hi - lo)``, which has no rounding for whole numbers and decimals.
    """
    row = exact_quantiles(df, value, q).first()
    if row is None:
        return df.withColumn(name or f"{value}_bucket", F.lit(None).cast("int"))
    kept = [0]
    for k in range(1, q + 1):
        if row[f"edge_{k}"] > row[f"edge_{kept[-1]}"]:
            kept.append(k)
        elif duplicates != "drop":
            raise ValueError(f"the {q}-quantile edges of {value} repeat")
    uppers = kept[1:] or [q]
    x = F.col(value)
    bucket = F.when(x.isNull(), None)
    for number, k in enumerate(uppers, start=1):
        inside = (x - F.lit(row[f"lo_{k}"])) * q <= F.lit(row[f"f_{k}"]) * F.lit(row[f"hi_{k}"] - row[f"lo_{k}"])
        bucket = bucket.when(inside, len(uppers) + 1 - number if reverse else number)
    return df.withColumn(name or f"{value}_bucket", bucket.cast("int"))


def rank_cuts(df: DataFrame, measures: Sequence[str], tie: str, q: int) -> dict[str, list[tuple]]:
    """For each measure the rows (value, tie) that close the buckets 1 .. q-1 of its rank; see ``quantile_of_rank``.

    Ranks run over (value, tie), nulls first.  All measures are range partitioned together in narrow rows; sizes of the
    partitions say which of them hold a cut, and only those are put in order.  q-1 rows per measure reach the driver.
    """
    narrow = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("m"), F.col(c).cast("decimal(38,2)").alias("v"), F.col(tie).alias("t"))
                    for k, c in enumerate(measures)
                ]
            )
        ).alias("r")
    ).select("r.m", "r.v", "r.t")
    placed = settle(narrow.repartitionByRange("m", "v", "t").withColumn("_part", F.spark_partition_id()))
    pieces = placed.groupBy("m", "_part").agg(F.count("*").alias("_size"))
    # One row per measure and range partition, whatever the data size.
    group = Window.partitionBy("m")
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        "m", "_part", "_size", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_skip"), F.sum("_size").over(group).alias("n")
    )
    ends = [F.expr(f"((n - 1) * {k}) div {q}") for k in range(1, q)]
    holds = F.lit(False)
    for end in ends:
        holds = holds | ((end >= F.col("_skip")) & (end < F.col("_skip") + F.col("_size")))
    inside = Window.partitionBy("m", "_part").orderBy("v", "t")
    found = (
        placed.join(pieces.where(holds), ["m", "_part"])
        .withColumn("_at", F.col("_skip") + F.row_number().over(inside) - 1)
        .where(F.col("_at").isin(*ends))
        .select("m", "_at", "v", "t")
        .collect()
    )
    sizes = {r.m: r.n for r in pieces.select("m", "n").distinct().collect()}
    if any(n < 2 for n in sizes.values()):
        raise ValueError("one row has no quantiles")
    cuts = {}
    for m, measure in enumerate(measures):
        at = {r["_at"]: (r.v, r.t) for r in found if r.m == m}
        cuts[measure] = [at[(sizes[m] - 1) * k // q] for k in range(1, q)] if m in sizes else []
    return cuts


def bucket_by_cuts(measure: str, tie: str, cuts: Sequence[tuple]) -> Column:
    """Bucket 1 .. q of a row's rank by the rows that close the buckets."""
    value, number = F.col(measure).cast("decimal(38,2)"), F.lit(1)
    for v, t in cuts:
        if v is None:
            beyond = value.isNotNull() | (F.col(tie) > F.lit(t))
        else:
            beyond = F.coalesce((value > F.lit(v)) | ((value == F.lit(v)) & (F.col(tie) > F.lit(t))), F.lit(False))
        number = number + beyond.cast("int")
    return number.cast("int")


def top_k(df: DataFrame, measure: str, k: int, tie: Sequence[str]) -> DataFrame:
    """The k rows with the largest measure; each task keeps only its own k."""
    return df.orderBy(F.desc(measure), *tie).limit(k)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """Fixed-size sample without replacement: the n keys with the smallest seeded hash.

    The same table and seed give the same rows on any cluster.
    """
    text = F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))
    return df.withColumn("_draw", F.md5(text)).orderBy("_draw", key).limit(n).drop("_draw")
