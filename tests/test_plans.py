"""Physical plans: what is read, what is shuffled, what never meets in one task."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tillwise.plans import customer
from tillwise.plans.catalogue import QUERIES
from tillwise.plans.cells import order_cells
from tillwise.plans.product import shop_catalogue
from tillwise.plans.profit import pnl_by_category
from tillwise.plans.workspace import Workspace
from tillwise.sources.facts import load_facts

LAZY = [name for name in QUERIES if name[0] in "abcdhr" and name not in ("r09_rfm_scores",)]
STORED = {f"r{n}" for n in (*range(8, 21), *range(46, 53))}  # over stored customer tables


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def reads(df) -> set[str]:
    """Columns that the parquet scans read."""
    found = set()
    for line in plan(df).splitlines():
        if line.startswith("ReadSchema: struct<"):
            found |= {part.split(":")[0] for part in line[len("ReadSchema: struct<") : -1].split(",") if part}
    return found


@pytest.mark.parametrize("name", [n for n in LAZY if n.split("_")[0] not in STORED])
def test_no_pairwise_join_and_no_python(spark, data, name):
    text = plan(QUERIES[name](spark, data))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "MapInArrow"):
        assert operator not in text


def test_only_needed_columns_and_tables_are_read(spark, data):
    assert reads(load_facts(spark, data, ["order_date", "order_status", "payment_amount"])) == {
        "l_orderkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        "o_orderkey", "o_orderdate", "o_orderstatus",
    }
    assert reads(load_facts(spark, data, ["review_score"])) == {"l_quantity"}
    for wanted in (["category", "review_score"], ["category", "price", "payment_amount", "discount_pct"]):
        assert not any(column.startswith("o_") for column in reads(load_facts(spark, data, wanted)))
    assert reads(QUERIES["r39_retention_rates_by_order"](spark, data)) == {"o_custkey"}


def test_additive_reports_scan_the_cube(spark, data):
    """They join nothing, read their columns of the cube, and no fact table."""
    read = {
        "r03_monthly_revenue": {"month_start", "order_status", "payment_amount"},
        "r31_rating_distribution": {"rating", "size"},
        "r54_category_drill_kpis": {"category", "price", "price_n", "payment_amount", "review_score", "review_score_n", "orders"},
    }
    for name, columns in read.items():
        report = QUERIES[name](spark, data)
        assert reads(report) <= columns | {"size", "orders", "cancelled", "payment_amount_n"} and "Join" not in plan(report)
    additive = [n for n in LAZY if n[:3] in ("r03", "r04", "r05", "r06", "r24", "r27", "r28", "r34", "r37", "r45", "r54", "r58")]
    assert len(additive) > 15
    for name in additive:
        assert "lineitem.parquet" not in plan(QUERIES[name](spark, data)), name


def test_a_cube_holds_the_dimensions_of_its_report(spark, data):
    """Few cells a report, of the tables that hold its columns; a cube with more columns serves reports on fewer."""
    space = Workspace(spark, data)
    assert set(space.cells("order_status").columns) == {"order_status", "size", "cancelled"}
    assert space.cells("order_status").count() <= 5 and space.cells("city", "order_status", "payment_amount").count() <= 5 * 26
    shop = space.cells("category", "price", "review_score", "order_date", "discount_pct")
    assert not {"city", "device", "gender", "age_group", "order_status"} & set(shop.columns)
    assert space.cells("category", "price") is shop and "cube" not in space.__dict__
    assert set(space.cube.columns) > set(shop.columns) and space.cells("category", "price") is space.cube


def test_lines_of_a_task_do_not_grow_with_the_table(spark, data, monkeypatch):
    """Orders are summed up in as many partitions as the number of lines asks for, however few the session names."""
    from tillwise.plans import rfm, workspace

    seen, own = [], rfm.order_sums
    monkeypatch.setattr(workspace, "LINES", 100)
    monkeypatch.setattr(rfm, "order_sums", lambda facts: seen.append(own(facts)) or seen[-1])
    customers = Workspace(spark, data).rfm.count()
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    assert customers and seen[0].rdd.getNumPartitions() == -(-lines // 100) > 4


def test_customer_texts_are_joined_after_the_lines_are_shuffled(spark, data):
    """The join on orders comes last, so its result needs no shuffle that carries city, device and the like on every line."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(load_facts(spark, data, ["category", "city", "device", "order_date", "cogs"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in text.splitlines() if "SortMergeJoin" in line]
    first = next(line for line in joins if "LeftOuter" in line)
    keys = [line for line in text.splitlines() if line.startswith("Left keys")]
    assert first and "part_key" in keys[0] and "order_key" in keys[-1]


def test_reports_on_customers_join_only_what_holds_their_columns(spark, data):
    assert reads(QUERIES["r02_extent"](spark, data)) == {"l_orderkey", "o_orderkey", "o_orderdate"}
    assert not any(c.startswith(("p_", "n_")) for c in reads(QUERIES["r41_top_customers"](spark, data)))


def test_stored_facts_are_scanned_alone(spark, data, tmp_path):
    space = Workspace(spark, data)
    wanted = ("category", "order_date", "order_status", "payment_amount", "cogs", "gross_profit")
    before = sorted(map(tuple, pnl_by_category(order_cells(load_facts(spark, data, wanted))).collect()))
    space.store_facts(str(tmp_path / "facts"))
    report = pnl_by_category(order_cells(space.facts(*wanted)))
    assert reads(report) == set(wanted) and "Join" not in plan(report)
    assert sorted(map(tuple, report.collect())) == before
    assert sorted(map(tuple, pnl_by_category(space.cells(*wanted)).collect())) == before
    assert len(list((tmp_path / "facts").glob("stored_month=*"))) > 12


def test_customer_filter_reaches_the_scan(spark, data):
    facts = load_facts(spark, data, ["customer_id", "payment_amount", "order_date"])
    text = plan(customer.weekday_spend(order_cells(facts), 7))
    assert "EqualTo(o_custkey,7)" in text


def test_category_filter_is_applied_before_the_aggregation(spark, data):
    facts = load_facts(spark, data, ["category", "price", "review_score", "order_date", "discount_pct"])
    assert "EqualTo(p_type,PROMO)" in plan(shop_catalogue(order_cells(facts), category="PROMO"))


def test_sums_combine_before_the_shuffle(spark, data):
    for name in ("r05_revenue_by_city", "r28_category_behaviour", "r37_pnl_by_category", "r44_geo_table"):
        assert "partial_sum" in plan(QUERIES[name](spark, data))


def test_big_tables_are_not_broadcast(spark, data):
    """Beyond the threshold Spark shuffles: no hint forces a growing table into every executor."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for wanted in (["category", "order_date", "cogs"], ["city", "customer_id"], ["device", "category"]):
            text = plan(load_facts(spark, data, wanted))
            assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_keys_are_split(spark, tmp_path):
    """A third of the lines on one part: the fact join gives all rows, and adaptive execution splits it."""
    n = 60_000
    line = F.col("id")
    spark.range(0, n, 1, 6).select(
        line.alias("l_orderkey"), F.lit(1).alias("l_linenumber"),
        F.when(line % 3 == 0, 1).otherwise(line % 997).alias("l_partkey"), F.lit(1).alias("l_suppkey"),
        (line % 1000).cast("double").alias("l_extendedprice"), F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax"),
        F.lit("N").alias("l_returnflag"), (F.xxhash64(line) % 50).cast("double").alias("l_quantity"),
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(997).select(
        line.alias("p_partkey"), (line % 6).cast("string").alias("p_type")
    ).write.parquet(str(tmp_path / "part.parquet"))
    settings = {
        "autoBroadcastJoinThreshold": "-1",
        "adaptive.autoBroadcastJoinThreshold": "-1",
        "adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "adaptive.advisoryPartitionSizeInBytes": "5KB",
        "adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    for key, value in settings.items():
        spark.conf.set(f"spark.sql.{key}", value)
    try:
        facts = load_facts(spark, str(tmp_path), ["category", "review_score", "price"])
        counts = facts.groupBy("category").agg(F.count("price").alias("n"), F.count("review_score").alias("m"))
        assert sum(r.n for r in counts.collect()) == n
        assert "skew=true" in counts._jdf.queryExecution().executedPlan().toString().replace("isSkew", "skew")
    finally:
        for key in settings:
            spark.conf.unset(f"spark.sql.{key}")
