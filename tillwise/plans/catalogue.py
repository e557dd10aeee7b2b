"""All reports by name, each as a function of a Spark session and a data directory.

A cells or facts report names the columns it reads, so only the tables that hold them are joined.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions.aggregates import total
from tillwise.functions.scalars import band, money_text, percent_text, short_money_text
from tillwise.models.churn import HIGH, HOLDOUT, MEDIUM, RISK_LEVELS, can_train, held_out, importances, training_size
from tillwise.models.segments import FEATURES as CLUSTERED
from tillwise.models.segments import SEEDS, SEGMENTS, fit_segments, name_segments, scaling_of
from tillwise.operators.distributions import auto_histogram, box_stats, histogram
from tillwise.operators.evaluation import calibration, score_counts
from tillwise.operators.joins import scalar_of, with_first_period
from tillwise.operators.projections import fill_zero, in_units, round_numbers, with_calendar, with_lookup
from tillwise.operators.ranking import exact_quantiles, first_seen, global_rank, hash_sample, qcut, quantile_of_rank
from tillwise.operators.summaries import summarise
from tillwise.plans import (
    behaviour,
    customer,
    dashboard,
    product,
    profit,
    retention,
    risk,
    segmentation,
    streams,
)
from tillwise.plans import rfm as rfm_plan
from tillwise.plans.cells import customers_of, order_cells, order_value_quantile
from tillwise.plans.workspace import GrowingWorkspace, Workspace, workspace
from tillwise.schema import SEQUENCE
from tillwise.session import shared_folder
from tillwise.sources.facts import customer_attributes, load_events, order_headers
from tillwise.sources.tables import extent, publish

Query = Callable[[SparkSession, str], DataFrame]

PAY, STATUS, DATE, WHO = "payment_amount", "order_status", "order_date", "customer_id"
PNL = (STATUS, PAY, "cogs", "delivery_cost", "discount_amount", "gross_profit")
SALES = ("category", DATE, PAY, "review_score", "discount_pct", STATUS)



def _facts(report: Callable[[DataFrame], DataFrame], *needs: str) -> Query:
    return lambda spark, directory: report(workspace(spark, directory).facts(*needs))


def _cells(report: Callable[[DataFrame], DataFrame], *needs: str) -> Query:
    return lambda spark, directory: report(workspace(spark, directory).cells(*needs))


def _events(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, directory: report(order_cells(load_events(spark, directory)))


def _headers(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, directory: report(order_headers(spark, directory))


def _rfm(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, directory: report(workspace(spark, directory).rfm)


def _segments(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, directory: report(workspace(spark, directory).segments)


def _scored_segments(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, directory: report(workspace(spark, directory).scored_segments)


def _churn_segments(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, directory: report(workspace(spark, directory).churn_segments)


def _churn(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, directory: report(workspace(spark, directory).churn)


# --- operators on their own ---------------------------------------------------------------------------


def _order_economics(facts: DataFrame) -> DataFrame:
    return in_units(facts)


def _customer_attributes(facts: DataFrame) -> DataFrame:
    return facts.select(WHO, "gender", "age_group", "device", "city").distinct()


def _calendar_parts(facts: DataFrame) -> DataFrame:
    keys = ["year", "month_number", "month_name", "weekday", "day_of_week", "hour"]
    return summarise(with_calendar(facts), keys, {"orders": F.count("*")})


def _distinct_categories(facts: DataFrame) -> DataFrame:
    return facts.select("category").distinct().orderBy("category")


def _spend_rank(rfm: DataFrame) -> DataFrame:
    ranked = global_rank(rfm, "monetary", [WHO], "spend_rank")
    score = quantile_of_rank(F.col("spend_rank"), scalar_of(rfm, F.count("*")))
    return ranked.select(WHO, "spend_rank", score.alias("m_score"))


def _recency_quintiles(rfm: DataFrame) -> DataFrame:
    return qcut(rfm, "recency", 5, reverse=True, name="r_score").select(WHO, "recency", "r_score")


def _spend_quartiles(rfm: DataFrame) -> DataFrame:
    return exact_quantiles(rfm, "monetary", 4, ["city"]).select(
        "city", F.col("n").alias("customers"), *[f"edge_{k}" for k in range(5)]
    )


def _spend_box(rfm: DataFrame) -> DataFrame:
    return box_stats(rfm, "monetary", "gender")


def _spend_histogram(rfm: DataFrame) -> DataFrame:
    return histogram(rfm, "monetary", 30, ["gender"])


def _customer_sample(rfm: DataFrame) -> DataFrame:
    return hash_sample(rfm, WHO, 500).select(WHO, "recency", "frequency")


def _first_periods(facts: DataFrame) -> DataFrame:
    joined = with_first_period(facts, WHO, DATE)
    return summarise(joined, [WHO, "first_month"], {"orders": F.count("*")})


def _sketched_customers(spark: SparkSession, directory: str) -> DataFrame:
    """Customers per city from sketches, beside the exact number, and whether they are within a twentieth of each other."""
    space = workspace(spark, directory)
    told = summarise(space.sketches, ["city"], {"sketched": customers_of(space.sketches)})
    raw = space.cells("city", WHO)
    exact = summarise(raw, ["city"], {"customers": customers_of(raw)})
    apart = F.abs(F.col("sketched") - F.col("customers"))
    return exact.join(told, "city").select("city", "customers", (apart <= F.greatest(F.lit(1), F.col("customers") / 20)).alias("close"))


SKETCHED_RANKS = (0.25, 0.5, 0.75, 0.9)


def _sketched_order_values(spark: SparkSession, directory: str) -> DataFrame:
    """Order values of some ranks per category from sketches, and whether their exact ranks are within two hundredths."""
    space = workspace(spark, directory)
    values = {f"v{k}": order_value_quantile(q) for k, q in enumerate(SKETCHED_RANKS)}
    told = summarise(space.sketches, ["category"], values)
    paid = space.facts("category", PAY).join(told, "category")
    x = F.col(PAY) / 100.0
    ranks = [_near_rank(F.count_if(x < F.col(f"v{k}")), F.count_if(x <= F.col(f"v{k}")), q) for k, q in enumerate(SKETCHED_RANKS)]
    return paid.groupBy("category").agg(F.count(PAY).alias("orders"), *[r.alias(f"close_{int(100 * q)}") for r, q in zip(ranks, SKETCHED_RANKS)])


def _near_rank(below: Column, up_to: Column, q: float) -> Column:
    n = F.count(PAY)
    return (below / n - 0.02 <= q) & (up_to / n + 0.02 >= q)


def _category_order(facts: DataFrame) -> DataFrame:
    return first_seen(facts, "category", SEQUENCE)


def _segment_order(spark: SparkSession, directory: str) -> DataFrame:
    """Segments in the order in which the customers first show them."""
    return first_seen(_by_quartile(spark, directory), "segment", [WHO])


def _later(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, directory: report(workspace(spark, directory).later)


def _later_labels(later: DataFrame) -> DataFrame:
    return summarise(later, ["label"], {"customers": F.count("*"), "mean_recency": F.avg("recency")})


def _formula_holdout(later: DataFrame) -> DataFrame:
    """Held-out customers under a score that SQL can state."""
    score = F.col("recency") / (F.col("recency") + 120.0)
    return later.where(held_out(HOLDOUT)).select(WHO, score.alias("score"), "label")


def _holdout(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, directory: report(workspace(spark, directory).holdout)


def _calibration(scores: DataFrame) -> DataFrame:
    return calibration(score_counts(scores, "score", "label"))


def _what_if_grid(spark: SparkSession, directory: str) -> DataFrame:
    space = workspace(spark, directory)
    return risk.what_if(space.churn_model, risk.scenario_grid(space.rfm))


def _shared_facts(spark: SparkSession, directory: str) -> DataFrame:
    """Facts stored once and read back: orders and amount per month folder."""
    space = Workspace(spark, directory)
    space.store_facts(f"{shared_folder(spark)}/{uuid4()}")
    measures = {"orders": F.count("*"), "revenue": total(PAY), "profit": total("gross_profit")}
    return summarise(order_cells(space.facts(DATE, "city", PAY, "gross_profit")), ["month_start", "city"], measures)


def _refreshed_pnl(spark: SparkSession, directory: str) -> DataFrame:
    """Profit and loss from a cube that was made from the files of lines and orders, and refreshed with nothing new."""
    space = GrowingWorkspace(spark, directory, f"{shared_folder(spark)}/{uuid4()}")
    space.refresh()
    space.refresh()
    return profit.pnl_by_category(space.cells("category", DATE, STATUS, PAY, "cogs", "gross_profit"))


def _published_cities(spark: SparkSession, directory: str) -> DataFrame:
    """A report written under its titles and read back."""
    path = f"{shared_folder(spark)}/{uuid4()}"
    cities = retention.geo_table(workspace(spark, directory).cells("city", WHO, DATE, PAY))
    publish(cities, path, {"city": "City", "revenue": "Revenue (₹)", "customers": "Unique Customers"})
    return spark.read.parquet(path)


def _filled_customers(spark: SparkSession, directory: str) -> DataFrame:
    """All customers, with zeros for those without orders."""
    known = customer_attributes(spark, directory, ["device"])
    shown = workspace(spark, directory).rfm.select(WHO, "frequency", F.col("monetary").cast("double"), "avg_rating")
    return fill_zero(known.join(shown, WHO, "left"), ["frequency", "monetary", "avg_rating"])


def _named_clusters(spark: SparkSession, directory: str) -> DataFrame:
    """Clusters numbered out of order get their names by mean spend."""
    banded = qcut(workspace(spark, directory).rfm, "monetary", 4, name="quartile")
    mixed = banded.withColumn("cluster", (F.col("quartile") * 3 % 5).cast("int"))
    return name_segments(mixed).select(WHO, "cluster", "segment")


def _scaled_features(rfm: DataFrame) -> DataFrame:
    """Features by which customers are clustered, in deviations from the mean."""
    model = scaling_of(rfm)
    return rfm.select(WHO, *[F.round(x, 6).alias(c) for c, x in zip(CLUSTERED, model.scaled())])


def _two_rounds(rfm: DataFrame) -> DataFrame:
    """Centres after two rounds of one restart, and the cost they are reached at: the clustering step by step."""
    model = fit_segments(rfm, seeds=(SEEDS[0],), max_rounds=2)
    rows = [(j, *[round(x, 6) for x in c]) for j, c in enumerate(model.centers)]
    made = rfm.sparkSession.createDataFrame(rows, "cluster int, recency double, frequency double, monetary double")
    return made.withColumn("cost", F.lit(round(model.cost, 3)))


def _training_guard(rfm: DataFrame) -> DataFrame:
    return training_size(rfm).withColumn("trainable", can_train(F.col("rows"), F.col("classes")))


# --- reports with more than one input -----------------------------------------------------------------


def _rfm_base(spark: SparkSession, directory: str) -> DataFrame:
    return rfm_plan.rfm_output(workspace(spark, directory).rfm)


def _rfm_scores(spark: SparkSession, directory: str) -> DataFrame:
    return workspace(spark, directory).scores.select(
        WHO, "recency", "frequency", F.col("monetary").cast("double"),
        "r_score", "f_score", "m_score", "rfm_score",
    )


def _segment_table(customers: DataFrame) -> DataFrame:
    return rfm_plan.rfm_output(customers).select(
        WHO, "recency", "frequency", "monetary", "cluster", "segment"
    )


def _importances(spark: SparkSession, directory: str) -> DataFrame:
    space = workspace(spark, directory)
    return importances(space.churn_model, space.rfm)


def _what_if(spark: SparkSession, directory: str) -> DataFrame:
    space = workspace(spark, directory)
    return risk.what_if(space.churn_model, risk.idle_scenarios(space.rfm))


def _home_with_segment(spark: SparkSession, directory: str) -> DataFrame:
    space = workspace(spark, directory)
    habits = behaviour.behaviour_features(space.facts(*BEHAVIOUR))
    return customer.home_with_segment(space.cells(*HOME), space.segments, habits)


def _waterfall(cells: DataFrame) -> DataFrame:
    return profit.waterfall(profit.pnl_summary(cells))


def _cost_breakdown(cells: DataFrame) -> DataFrame:
    return profit.cost_breakdown(profit.pnl_summary(cells))


def _shop_search(cells: DataFrame) -> DataFrame:
    return product.shop_catalogue(cells, search="^(S|me)", sort_by="Price ↑", regex=True)


# --- reports on labels that SQL can state: spend quartiles as segments, a formula of recency as risk ---


def _by_quartile(spark: SparkSession, directory: str) -> DataFrame:
    """Scored customers, their segment named by the quartile of their spend."""
    banded = qcut(workspace(spark, directory).scores, "monetary", 4, name="quartile")
    name = F.element_at(F.array(*map(F.lit, SEGMENTS)), F.col("quartile"))
    return banded.withColumn("segment", name).drop("quartile")


def _by_formula(spark: SparkSession, directory: str) -> DataFrame:
    """Customers of ``_by_quartile`` with a risk that rises with the days since their last order."""
    return with_formula_risk(_by_quartile(spark, directory))


def with_formula_risk(df: DataFrame) -> DataFrame:
    risky = df.withColumn("churn_prob", F.col("recency") / (F.col("recency") + 120.0))
    return risky.withColumn("risk_level", band("churn_prob", [HIGH, MEDIUM], RISK_LEVELS))


def _quartiles(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, directory: report(_by_quartile(spark, directory))


def _risks(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, directory: report(_by_formula(spark, directory))


def _home_with_quartile(spark: SparkSession, directory: str) -> DataFrame:
    space = workspace(spark, directory)
    habits = behaviour.behaviour_features(space.facts(*BEHAVIOUR))
    return customer.home_with_segment(space.cells(*HOME), _by_quartile(spark, directory), habits)


def _top_customer_table(customers: DataFrame) -> DataFrame:
    return segmentation.customer_table(customers, [SEGMENTS[-1], SEGMENTS[-2]])


# --- chosen customers, categories and texts -------------------------------------------------------------

SHOPPER = 1  # a customer of every test table


def _order_devices(spark: SparkSession, directory: str) -> DataFrame:
    devices = customer_attributes(spark, directory, ["device"])
    orders = order_headers(spark, directory).select("order_key", WHO)
    return with_lookup(orders, devices, WHO)


def _kpi_texts(cells: DataFrame) -> DataFrame:
    kpis = dashboard.executive_kpis(cells)
    return kpis.select(
        money_text(F.col("revenue")).alias("revenue"),
        short_money_text(F.col("revenue")).alias("short_revenue"),
        money_text(F.col("avg_order_value")).alias("avg_order_value"),
        short_money_text(F.col("avg_order_value")).alias("short_order_value"),
        percent_text(F.col("orders") / (F.col("orders") + F.col("customers"))).alias("order_share"),
    )


def _rounded(report: Callable[[DataFrame], DataFrame], digits: int) -> Callable[[DataFrame], DataFrame]:
    return lambda cells: round_numbers(report(cells), digits)


BEHAVIOUR = (WHO, DATE, PAY, "discount_pct", "category", "review_score", STATUS, "device")
HOME = (WHO, PAY, "review_score", "discount_amount")

QUERIES: dict[str, Query] = {
    # operators
    "a01_order_economics": _facts(
        _order_economics, *SEQUENCE[:4], "price", "cogs", "delivery_cost", "delivery_charge",
        "discount_pct", "discount_amount", PAY, "gross_profit", "gross_margin_pct", STATUS, "category", "review_score",
    ),
    "b03_calendar_parts": _facts(_calendar_parts, DATE),
    "b01_order_devices": _order_devices,
    "b06_customer_attributes": _facts(_customer_attributes, WHO, "gender", "age_group", "device", "city"),
    "c02_default_customer": _facts(customer.default_customer, *SEQUENCE, WHO),
    "d01_first_periods": _facts(_first_periods, WHO, DATE),
    "e05_user_habits": lambda spark, d: behaviour.user_habits(load_events(spark, d)),
    "e13_spend_box": _rfm(_spend_box),
    "f01_spend_rank": _rfm(_spend_rank),
    "f03_recency_quintiles": _rfm(_recency_quintiles),
    "f03_spend_quartiles_by_city": _rfm(_spend_quartiles),
    "g04_customer_sample": _rfm(_customer_sample),
    "k01_streamed_days": streams.streamed_days,
    "k02_streamed_new_vs_returning": streams.streamed_retention,
    "h01_distinct_categories": _facts(_distinct_categories, "category"),
    "j02_spend_histogram": _rfm(_spend_histogram),
    "a02_shared_facts": _shared_facts,
    "a02_refreshed_pnl": _refreshed_pnl,
    "a03_published_cities": _published_cities,
    "b09_filled_customers": _filled_customers,
    "f05_named_clusters": _named_clusters,
    "i01_scaled_features": _rfm(_scaled_features),
    "i02_two_rounds": _rfm(_two_rounds),
    "i05_training_guard": _rfm(_training_guard),
    "r50_what_if_grid": _what_if_grid,
    "r50_formula_grid": _rfm(lambda rfm: with_formula_risk(risk.scenario_grid(rfm))),
    "e03_sketched_customers": _sketched_customers,
    "e06_sketched_order_values": _sketched_order_values,
    "h01_categories_first_seen": _facts(_category_order, *SEQUENCE, "category"),
    "h01_segments_first_seen": _segment_order,
    "i06_later_labels": _later(_later_labels),
    "i06_formula_holdout": _later(lambda later: risk.holdout_summary(_formula_holdout(later))),
    "i06_formula_calibration": _later(lambda later: _calibration(_formula_holdout(later))),
    "i06_forest_holdout": _holdout(risk.holdout_summary),
    "i06_forest_calibration": _holdout(_calibration),
    "j02_auto_spend_histogram": _rfm(lambda rfm: auto_histogram(rfm, "monetary")),
    "r15_auto_recency_histogram": _quartiles(lambda c: auto_histogram(c, "recency", ["segment"])),
    "r16_auto_spend_histogram": _quartiles(lambda c: auto_histogram(c, "monetary", ["segment"])),
    "r44_geo_table_sketched": lambda spark, d: retention.geo_table(workspace(spark, d).sketches),
    # dashboard
    "r01_executive_kpis": _cells(
        dashboard.executive_kpis, WHO, STATUS, PAY, "review_score", "gross_profit"
    ),
    "r01_kpi_texts": _cells(_kpi_texts, WHO, STATUS, PAY, "review_score", "gross_profit"),
    "r02_extent": _facts(extent, DATE),
    "r03_monthly_revenue": _cells(dashboard.monthly_revenue, DATE, STATUS, PAY),
    "r04_orders_by_status": _cells(dashboard.orders_by_status, STATUS),
    "r05_revenue_by_city": _cells(dashboard.revenue_by_city, "city", STATUS, PAY),
    "r06_top_categories": _cells(dashboard.top_categories, "category", STATUS, PAY),
    "r07_weekday_hour_heatmap": _events(dashboard.weekday_hour_heatmap),
    # segmentation
    "r08_rfm_base": _rfm_base,
    "r09_rfm_scores": _rfm_scores,
    "r10_segments": _segments(_segment_table),
    "r11_segment_sizes": _segments(segmentation.segment_sizes),
    "r12_scatter_sample": _segments(segmentation.scatter_sample),
    "r13_segment_averages": _scored_segments(segmentation.segment_averages),
    "r14_segment_box": _segments(segmentation.segment_box),
    "r15_recency_histogram": _segments(segmentation.recency_histogram),
    "r16_spend_histogram": _segments(segmentation.spend_histogram),
    "r17_customer_table": _scored_segments(segmentation.customer_table),
    "r18_segment_profile": _segments(segmentation.segment_profile),
    "r19_segment_gender": _segments(segmentation.segment_gender),
    "r20_segment_age": _segments(segmentation.segment_age),
    "r11_quartile_sizes": _quartiles(segmentation.segment_sizes),
    "r12_quartile_sample": _quartiles(segmentation.scatter_sample),
    "r13_quartile_averages": _quartiles(segmentation.segment_averages),
    **{
        f"r14_{metric}_box": _quartiles(lambda c, metric=metric: segmentation.segment_box(c, metric))
        for metric in ("recency", "frequency", "monetary", "rfm_score")
    },
    "r15_quartile_recency_histogram": _quartiles(segmentation.recency_histogram),
    "r16_quartile_spend_histogram": _quartiles(segmentation.spend_histogram),
    "r17_quartile_table": _quartiles(segmentation.customer_table),
    "r17_top_quartiles_table": _quartiles(_top_customer_table),
    "r18_quartile_profile": _quartiles(segmentation.segment_profile),
    "r19_quartile_gender": _quartiles(segmentation.segment_gender),
    "r20_quartile_age": _quartiles(segmentation.segment_age),
    # behaviour
    "r21_orders_by_hour": _events(behaviour.orders_by_hour),
    "r22_orders_by_weekday": _cells(behaviour.orders_by_weekday, DATE),
    "r23_orders_by_month": _cells(behaviour.orders_by_month, DATE),
    "r24_device_orders": _cells(behaviour.device_orders, "device", DATE, PAY),
    "r25_gender_orders": _cells(behaviour.gender_orders, "gender", DATE, PAY),
    "r26_age_group_orders": _cells(behaviour.age_group_orders, "age_group", DATE, PAY),
    "r27_order_value_matrix": _cells(behaviour.order_value_matrix, "gender", "age_group", PAY),
    "r28_category_behaviour": _cells(behaviour.category_behaviour, *SALES),
    "r28_category_behaviour_rounded": _cells(_rounded(behaviour.category_behaviour, 2), *SALES),
    "r29_spend_rating_bubbles": _cells(behaviour.spend_rating_bubbles, *SALES),
    "r30_cancel_ranking": _cells(behaviour.cancel_ranking, "category", STATUS),
    "r31_rating_distribution": _cells(behaviour.rating_distribution, "review_score"),
    "r32_discount_by_age": _cells(behaviour.discount_by_age, "age_group", "discount_pct"),
    "r33_rating_by_category": _cells(behaviour.rating_by_category, "category", "review_score"),
    # profit and loss
    "r34_pnl_summary": _cells(profit.pnl_summary, *PNL),
    "r35_pnl_waterfall": _cells(_waterfall, *PNL),
    "r36_pnl_monthly": _cells(profit.pnl_monthly, DATE, STATUS, PAY, "cogs", "gross_profit"),
    "r37_pnl_by_category": _cells(
        profit.pnl_by_category, "category", DATE, STATUS, PAY, "cogs", "gross_profit"
    ),
    "r38_cost_breakdown": _cells(_cost_breakdown, *PNL),
    # retention and geography
    "r39_retention_rates": _facts(retention.retention_rates, WHO),
    "r39_retention_rates_by_order": _headers(retention.retention_rates),
    "r40_orders_histogram": _facts(retention.orders_histogram, WHO),
    "r40_orders_histogram_by_order": _headers(retention.orders_histogram),
    "r41_top_customers": _facts(retention.top_customers, WHO, PAY),
    "r42_new_vs_returning_orders": _cells(retention.new_vs_returning_orders, WHO, DATE, PAY),
    "r43_new_vs_returning_revenue": _cells(retention.new_vs_returning_revenue, WHO, DATE, PAY),
    "r44_geo_table": _cells(retention.geo_table, "city", WHO, DATE, PAY),
    "r45_geo_treemap": _cells(retention.geo_treemap, "city", PAY),
    # churn risk
    "r46_churn_importances": _importances,
    "r47_churn_scores": _churn_segments(risk.churn_scores),
    "r48_risk_mix": _churn(risk.risk_mix),
    "r49_probability_histogram": _churn(risk.probability_histogram),
    "r50_what_if": _what_if,
    "r51_high_risk_list": _churn_segments(risk.high_risk_list),
    "r47_formula_scores": _risks(risk.churn_scores),
    "r48_formula_mix": _risks(risk.risk_mix),
    "r49_formula_histogram": _risks(risk.probability_histogram),
    "r51_formula_list": _risks(risk.high_risk_list),
    "r52_churn_labels": _rfm(risk.churn_labels),
    # product
    "r53_category_stats": _cells(product.category_stats, *SALES, WHO, "price"),
    "r53_category_matrix": _cells(
        product.category_matrix, "category", "discount_pct", "review_score", PAY
    ),
    "r54_category_drill_kpis": _cells(
        product.category_drill_kpis, "category", "price", PAY, "review_score"
    ),
    "r54_category_drill_months": _cells(product.category_drill_months, "category", DATE, PAY),
    "r54_category_drill_cities": _cells(product.category_drill_cities, "category", "city", PAY),
    "r54_one_category_kpis": _cells(
        lambda c: product.category_drill_kpis(c, "PROMO"), "category", "price", PAY, "review_score"
    ),
    "r54_one_category_months": _cells(
        lambda c: product.category_drill_months(c, "PROMO"), "category", DATE, PAY
    ),
    # customers
    "r55_behaviour_features": _facts(behaviour.behaviour_features, *BEHAVIOUR),
    "r56_customer_home": _cells(customer.home_kpis, *HOME),
    "r56_customer_home_with_segment": _home_with_segment,
    "r56_one_customer_home": _cells(lambda c: customer.home_kpis(c, SHOPPER), *HOME),
    "r56_customer_home_with_quartile": _home_with_quartile,
    "r57_one_customer_monthly_spend": _cells(lambda c: customer.monthly_spend(c, SHOPPER), WHO, DATE, PAY),
    "r57_customer_monthly_spend": _cells(customer.monthly_spend, WHO, DATE, PAY),
    "r57_customer_category_shares": _cells(customer.category_shares, WHO, "category", PAY),
    "r57_customer_status_counts": _cells(customer.status_counts, WHO, STATUS),
    "r58_shop_catalogue": _cells(
        product.shop_catalogue, "category", "price", "review_score", DATE, "discount_pct"
    ),
    "r58_shop_search": _cells(
        _shop_search, "category", "price", "review_score", DATE, "discount_pct"
    ),
    **{
        f"r58_shop_{name}": _cells(
            lambda c, chosen=chosen: product.shop_catalogue(c, **chosen),
            "category", "price", "review_score", DATE, "discount_pct",
        )
        for name, chosen in {
            "by_price_down": {"sort_by": "Price ↓"},
            "by_rating": {"sort_by": "Rating"},
            "literal_search": {"search": "mO"},
            "one_category": {"category": "PROMO"},
        }.items()
    },
    "r59_delivered_totals": _cells(lambda c: customer.order_totals(c, status="delivered"), WHO, STATUS, PAY),
    "r59_one_customer_totals": _cells(lambda c: customer.order_totals(c, SHOPPER, "shipped"), WHO, STATUS, PAY),
    "r59_one_customer_orders": _facts(
        lambda facts: customer.order_list(facts, SHOPPER), *SEQUENCE, WHO, DATE, "category", "discount_amount",
        PAY, "review_score", STATUS, "city",
    ),
    "r59_order_totals": _cells(customer.order_totals, WHO, STATUS, PAY),
    "r59_order_list": _facts(
        customer.order_list, WHO, DATE, "category", "price", "discount_amount", PAY, "review_score", STATUS, "city",
    ),
    "r60_customer_profile": _facts(
        lambda facts: customer.profile(behaviour.behaviour_features(facts)), *BEHAVIOUR
    ),
    "r61_weekday_spend": _cells(customer.weekday_spend, WHO, DATE, PAY),
}
