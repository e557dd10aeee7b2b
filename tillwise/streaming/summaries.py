"""Summaries of streams: windows of event time that late orders still reach, and customers told new from returning."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tillwise.operators.predicates import with_keys


def stream_summarise(
    events: DataFrame,
    window: str,
    watermark: str,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    ts: str = "order_date",
) -> DataFrame:
    """Aggregates per window of event time and key: ``window_start``, ``window_end``, the keys and the measures.

    On a stream every batch gives the windows it changed, as a whole.  Rows older than the newest time seen in earlier batches
    by more than ``watermark`` are dropped, and windows that old leave the state, which so stays as large as the windows
    still open.  On a plain table nothing is late.  Rows without a key or a time are left out.
    """
    known = with_keys(events, ts, *keys)
    if events.isStreaming:
        known = known.withWatermark(ts, watermark)
    columns = [x.alias(name) for name, x in measures.items()]
    grouped = known.groupBy(F.window(ts, window).alias("_window"), *keys).agg(*columns)
    return grouped.select(
        F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *keys, *measures
    )


CHANGES = "period date, customer_type string, orders long, customers long, amount long"
_KEPT = "periods array<date>, orders array<long>, amounts array<long>"
Periods = dict[object, tuple[int, int]]


def stream_new_vs_returning(
    events: DataFrame, grain: str = "month", entity: str = "customer_id", ts: str = "order_date", amount: str = "payment_amount"
) -> DataFrame:
    """Changes to orders, customers and amount per period and customer type, for ``sum_changes`` to add up.

    A customer's state is the orders and amount of each period, so it has a row per period at most.  An order that comes late
    and is earlier than all before it makes its period the first one: what had counted as new there is taken back and
    counted as returning.  So the sums are those of the whole table, however the files were dealt to batches.
    """
    placed = with_keys(events, entity, ts).select(
        F.col(entity).cast("string").alias("entity"),
        F.date_trunc(grain, ts).cast("date").alias("period"),
        F.coalesce(F.col(amount), F.lit(0)).cast("long").alias("amount"),
    )
    return placed.groupBy("entity").applyInPandasWithState(
        _changes, CHANGES, _KEPT, "update", GroupStateTimeout.NoTimeout
    )


def _typed(periods: Periods) -> set[tuple]:
    first = min(periods, default=None)
    return {(p, "New" if p == first else "Returning", n, a) for p, (n, a) in periods.items()}


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before: Periods = {p: (n, a) for p, n, a in zip(*state.get)} if state.exists else {}
    after = dict(before)
    for frame in frames:
        for period, found in frame.groupby("period")["amount"]:
            n, a = after.get(period, (0, 0))
            after[period] = (n + len(found), a + int(found.sum()))
    old, new = _typed(before), _typed(after)
    rows = [(p, kind, sign * n, sign, sign * a) for sign, some in ((-1, old - new), (1, new - old)) for p, kind, n, a in some]
    ordered = sorted(after)
    state.update((ordered, [after[p][0] for p in ordered], [after[p][1] for p in ordered]))
    yield pd.DataFrame(rows, columns=["period", "customer_type", "orders", "customers", "amount"])


def sum_changes(changes: DataFrame) -> DataFrame:
    """Orders, customers and revenue per period and type, from all changes so far."""
    sums = [F.sum(c).alias(c) for c in ("orders", "customers")]
    summed = changes.groupBy("period", "customer_type").agg(*sums, F.sum("amount").alias("_amount"))
    return summed.where("orders <> 0").select(
        "period", "customer_type", "orders", "customers", (F.col("_amount") / 100.0).alias("revenue")
    )
