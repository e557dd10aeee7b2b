"""One customer with a third of all orders: results against their definitions, in plain Python on sorted rows."""

from __future__ import annotations

from collections import Counter
from fractions import Fraction
from math import ceil, floor
from statistics import median

import numpy as np
import pandas as pd
import pytest

from tillwise.plans import behaviour, customer, retention
from tillwise.plans import rfm as rfm_plan
from tillwise.plans.cells import order_cells

N = 3000


@pytest.fixture(scope="module")
def pdf() -> pd.DataFrame:
    rng = np.random.default_rng(11)
    who = rng.integers(2, 200, N)
    who[rng.permutation(N)[: N // 3]] = 1
    return pd.DataFrame(
        {
            "seq": np.arange(N),
            "customer_id": who,
            "order_date": pd.Timestamp("2023-01-01") + pd.to_timedelta(rng.integers(0, 730 * 1440, N), unit="min"),
            "category": rng.choice(list("abcdef"), N),
            "order_status": rng.choice(["delivered", "shipped", "cancelled"], N, p=[0.7, 0.2, 0.1]),
            "payment_amount": rng.integers(40, 5000, N) * 100,
            "discount_pct": rng.integers(0, 220, N),
            "review_score": rng.integers(1, 6, N),
            "city": rng.choice(["x", "y"], N),
            "gender": "f",
            "age_group": "18-24",
            "device": rng.choice(["Mobile", "Desktop", "Tablet"], N),
        }
    )


@pytest.fixture(scope="module")
def hot_facts(spark, pdf):
    kinds = (
        "seq bigint, customer_id bigint, order_date timestamp_ntz, category string, order_status string, "
        "payment_amount bigint, discount_pct bigint, review_score int, city string, gender string, "
        "age_group string, device string"
    )
    return spark.createDataFrame(pdf, kinds).repartition(7).persist()


def orders_of(pdf: pd.DataFrame) -> dict[int, list]:
    """Rows of each customer in sequence."""
    found: dict[int, list] = {}
    for row in pdf.sort_values("seq").itertuples():
        found.setdefault(row.customer_id, []).append(row)
    return dict(sorted(found.items()))


def most_frequent(values) -> str:
    counts = Counter(values)
    return min(counts, key=lambda value: (-counts[value], value))


def interpolated(ordered: list, part: Fraction) -> Fraction:
    """Value at a part of the way through sorted values."""
    at = part * (len(ordered) - 1)
    low, high = ordered[floor(at)], ordered[ceil(at)]
    return low + (high - low) * (at - floor(at))


def test_behaviour(hot_facts, pdf):
    got = behaviour.behaviour_features(hot_facts).toPandas().set_index("customer_id").to_dict("index")
    people = orders_of(pdf)
    assert set(got) == set(people)
    for who, rows in people.items():
        paid, n = sum(r.payment_amount for r in rows), len(rows)
        cancelled = Fraction(sum(r.order_status == "cancelled" for r in rows), n)
        assert got[who]["total_orders"] == n and got[who]["total_spend"] == paid / 100
        assert got[who]["avg_order_value"] == round(Fraction(paid, 100 * n))
        assert got[who]["cancel_rate"] == round(cancelled * 1000) / 10
        assert got[who]["fav_category"] == most_frequent(r.category for r in rows)
        assert got[who]["pref_device"] == most_frequent(r.device for r in rows)
        assert got[who]["pref_hour"] == median(r.order_date.hour for r in rows)


def test_new_vs_returning(hot_facts, pdf):
    months = pdf.order_date.dt.to_period("M").astype(str)
    first = months.groupby(pdf.customer_id).transform("min")
    kind = np.where(months == first, "New", "Returning")
    want = pdf.groupby([months.rename("month"), pd.Series(kind, name="kind")]).agg(
        orders=("seq", "size"), customers=("customer_id", "nunique"), revenue=("payment_amount", "sum")
    )
    got = retention.new_vs_returning(order_cells(hot_facts)).toPandas().set_index(["month", "customer_type"])
    assert got.orders.to_dict() == want.orders.to_dict()
    assert got.customers.to_dict() == want.customers.to_dict()
    assert got.revenue.to_dict() == (want.revenue / 100).to_dict()


def test_rfm_and_scores(hot_facts, pdf):
    day_after = max(pdf.order_date) + pd.Timedelta(days=1)
    want = {}
    for who, rows in orders_of(pdf).items():
        kept = [r for r in rows if r.order_status != "cancelled"]
        if kept:
            last = max(r.order_date for r in kept)
            paid = sum(r.payment_amount for r in kept)
            want[who] = {
                "recency": (day_after - last).days, "frequency": len(kept), "monetary": paid,
                "city": kept[0].city, "last_category": kept[-1].category,
            }
    recencies = sorted(w["recency"] for w in want.values())
    edges = [interpolated(recencies, Fraction(k, 5)) for k in range(1, 5)]
    for w in want.values():
        w["r_score"] = 5 - sum(w["recency"] > edge for edge in edges)
    for measure in ("frequency", "monetary"):
        ordered = sorted(want, key=lambda who: (want[who][measure], who))
        for place, who in enumerate(ordered):
            want[who][f"{measure[0]}_score"] = max(1, ceil(Fraction(5 * place, len(ordered) - 1)))
    base = rfm_plan.rfm_base(hot_facts, ("seq",))
    got = rfm_plan.rfm_scores(base).toPandas().set_index("customer_id").to_dict("index")
    assert set(got) == set(want)
    for who, w in want.items():
        assert {**{c: got[who][c] for c in w}, "monetary": int(got[who]["monetary"] * 100)} == w


def test_order_list_is_whole(hot_facts, pdf):
    facts = hot_facts.withColumnRenamed("discount_pct", "price").withColumn("discount_amount", hot_facts.seq)
    assert len(customer.order_list(facts, 1).collect()) == (pdf.customer_id == 1).sum()
