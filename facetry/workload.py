"""The engine's own queries over the sample tables, each beside SQL written from its meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .layer import SemanticLayer
from .model import SecurityPolicy
from .operators import table_calcs
from .plans import rollups

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def sample_layer(spark: SparkSession, sf_dir: str, **options) -> SemanticLayer:
    """Models over the sample tables, read where they lie."""
    layer = SemanticLayer(spark, **options)
    uri = lambda name: f"{sf_dir}/{name}.parquet"
    metric = lambda name, agg=None, sql=None, **more: {"name": name, "agg": agg, "sql": sql, **more}
    dim = lambda name, type="categorical", sql=None, **more: {"name": name, "type": type, "sql": sql, **more}
    layer.add_model({"name": "region", "source_uri": uri("region"), "primary_key": "r_regionkey", "dimensions": [dim("r_name")]})
    layer.add_model({"name": "any_region", "source_uri": uri("region"), "dimensions": [dim("r_name")]})
    layer.add_model({
        "name": "nation", "source_uri": uri("nation"), "primary_key": "n_nationkey", "dimensions": [dim("n_name")],
        "relationships": [{"name": "region", "foreign_key": "n_regionkey"}],
    })
    layer.add_model({
        "name": "customer", "source_uri": uri("customer"), "primary_key": "c_custkey",
        "dimensions": [dim("c_custkey", "numeric"), dim("c_mktsegment"), dim("c_nationkey", "numeric"), dim("spending_rank", "numeric", window="row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey)")],
        "metrics": [metric("balance", "sum", "c_acctbal"), metric("customers", "count"), metric("nations", "count_distinct", "c_nationkey")],
        "relationships": [{"name": "nation", "foreign_key": "c_nationkey"}],
        "segments": [{"name": "in_credit", "sql": "{model}.c_acctbal > 0"}],
    })
    layer.add_model({
        "name": "orders", "source_uri": uri("orders"), "primary_key": "o_orderkey",
        "dimensions": [dim("o_orderkey", "numeric"), dim("o_custkey", "numeric"), dim("o_orderstatus"), dim("o_orderpriority"), dim("o_orderdate", "time", granularity="day"), dim("is_big", "boolean", "o_totalprice > 200000")],
        "metrics": [
            metric("revenue", "sum", "o_totalprice"), metric("order_count", "count"), metric("avg_price", "avg", "o_totalprice"), metric("min_price", "min", "o_totalprice"),
            metric("max_price", "max", "o_totalprice"), metric("median_price", "median", "o_totalprice"), metric("sd_price", "stddev", "o_totalprice"), metric("sd_pop_price", "stddev_pop", "o_totalprice"),
            metric("var_price", "variance", "o_totalprice"), metric("var_pop_price", "variance_pop", "o_totalprice"), metric("buyers", "count_distinct", "o_custkey"),
            metric("approx_buyers", "approx_count_distinct", "o_custkey"), metric("p90_price", "percentile", "o_totalprice", percentile=0.9),
            metric("urgent_revenue", "sum", "o_totalprice", filters=["{model}.o_orderpriority = '1-URGENT'"]),
            metric("aov", type="ratio", numerator="revenue", denominator="order_count"), metric("revenue_k", type="derived", sql="revenue / 1000"),
            metric("spread", sql="MAX(o_totalprice) - MIN(o_totalprice)"), metric("urgent_or_zero", "sum", "o_totalprice", filters=["{model}.o_orderpriority = 'none'"], fill_nulls_with=0),
            metric("running_revenue", type="cumulative", sql="revenue"), metric("rolling_week", type="cumulative", sql="revenue", window="6 days"), metric("mtd_revenue", type="cumulative", sql="revenue", grain_to_date="month"),
            metric("revenue_yoy", type="time_comparison", base_metric="revenue", comparison_type="yoy"), metric("revenue_mom_diff", type="time_comparison", base_metric="revenue", comparison_type="mom", calculation="difference"),
            metric("revenue_vs_prior", type="ratio", numerator="revenue", denominator="revenue", offset_window="1 month"),
            metric("share", type="derived", sql="100 * revenue / _.all(revenue)"), metric("buyer_share", type="derived", sql="buyers / _.all(buyers)"), metric("mode_priority", "mode", "o_orderpriority"),
            metric("statuses", "string_agg", "o_orderstatus"), metric("skew", "skewness", "o_totalprice"), metric("kurt", "kurtosis", "o_totalprice"), metric("big_orders", "count_if", "o_totalprice > 200000"), metric("geo_price", "geometric_mean", "o_totalprice"),
            metric("revenue_wow", type="time_comparison", base_metric="revenue", comparison_type="wow"), metric("running_max", type="cumulative", agg="max", sql="o_totalprice"), metric("revenue_rank", window_expression="rank()", window_order="revenue DESC"), metric("per_customer_price", "sum", "o_totalprice", distinct_key="o_custkey"),
        ],
        "relationships": [{"name": "customer", "foreign_key": "o_custkey"}, {"name": "any_region", "type": "cross"}],
        "pre_aggregations": [{"name": "mixed", "type": "lambda", "measures": ["revenue"], "dimensions": ["o_orderstatus"], "time_dimension": "o_orderdate", "granularity": "month", "build_range_end": "1996-01-01", "partition_granularity": "year"}, {"name": "monthly", "measures": ["revenue", "order_count", "min_price"], "dimensions": ["o_orderstatus", "o_custkey"], "time_dimension": "o_orderdate", "granularity": "month"}],
    })
    layer.add_model({
        "name": "lineitem", "source_uri": uri("lineitem"), "primary_key": ["l_orderkey", "l_linenumber"],
        "dimensions": [dim("l_returnflag"), dim("l_linestatus"), dim("l_shipdate", "time")],
        "metrics": [metric("quantity", "sum", "l_quantity"), metric("net", "sum", "l_extendedprice * (1 - l_discount)"), metric("lines", "count")],
        "relationships": [{"name": "orders", "foreign_key": "l_orderkey"}],
    })
    layer.add_model({
        "name": "part", "source_uri": uri("part"), "primary_key": "p_partkey", "dimensions": [dim("p_partkey", "numeric")], "metrics": [metric("parts", "count")],
        "relationships": [{"name": "supplier", "type": "many_to_many", "through": "supply", "through_foreign_key": "l_partkey", "related_foreign_key": "l_suppkey"}],
    })
    layer.add_model({"name": "supply", "source_uri": uri("lineitem")})
    layer.add_model({"name": "supplier", "source_uri": uri("supplier"), "primary_key": "s_suppkey", "dimensions": [dim("s_suppkey", "numeric")]})
    layer.add_model({
        "name": "events", "source_uri": uri("events"), "primary_key": "event_id", "default_time_dimension": None,
        "dimensions": [dim("event_type"), dim("user_id", "numeric"), dim("ts", "time")],
        "metrics": [
            metric("event_count", "count"), metric("last_value", "sum", "value", non_additive_dimension="ts", non_additive_groupings=["user_id"]),
            metric("click_to_purchase", type="conversion", entity="user_id", base_event="click", conversion_event="purchase", conversion_window="7 days"),
            metric("path", type="conversion", entity="user_id", steps=["event_type = 'view'", "event_type = 'click'", "event_type = 'purchase'"]),
            metric("retained", type="retention", entity="user_id", cohort_event="event_type = 'signup'", activity_event="event_type = 'click'", periods=28),
            metric("busy_users", type="cohort", agg="count", entity="user_id", inner_metrics=[{"name": "n", "agg": "count"}], having="n >= 5"),
        ],
    })
    layer.add_metric({"name": "balance_per_order", "type": "derived", "sql": "customer.balance / orders.order_count"})
    return layer


def ask(**query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: sample_layer(spark, sf_dir).query(**query)


def say(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: sample_layer(spark, sf_dir).sql(text)


def rounded(query: Callable[[SparkSession, str], DataFrame], digits: int = 2) -> Callable[[SparkSession, str], DataFrame]:
    """Doubles rounded: engines add them in other orders."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.sql import functions as F

        df = query(spark, sf_dir)
        return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

    return run


def measure_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        layer = sample_layer(spark, sf_dir)
        spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("workload_orders")
        layer.sql("CREATE VIEW order_measures AS SELECT o_orderstatus AS status, o_orderpriority AS priority, year(o_orderdate) AS y, SUM(o_totalprice) AS MEASURE revenue, COUNT(*) AS MEASURE n FROM workload_orders")
        return layer.sql(text)

    return run


def with_calcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sample_layer(spark, sf_dir).query(metrics=["orders.revenue", "orders.order_count"], dimensions=["orders.o_orderpriority", "orders.o_orderstatus"])
    order = ["o_orderpriority", "o_orderstatus"]
    return table_calcs.apply(df, [
        {"name": "each", "type": "formula", "expression": "${revenue} / ${order_count}"}, {"name": "pct", "type": "percent_of_total", "field": "revenue"},
        {"name": "pct_status", "type": "percent_of_column_total", "field": "revenue", "partition_by": ["o_orderstatus"]}, {"name": "change", "type": "percent_of_previous", "field": "revenue", "order_by": order},
        {"name": "running", "type": "running_total", "field": "order_count", "order_by": order}, {"name": "place", "type": "rank", "field": "revenue"}, {"name": "n", "type": "row_number", "order_by": order},
        {"name": "smooth", "type": "moving_average", "field": "revenue", "window_size": 3, "order_by": order}, {"name": "mid", "type": "percentile", "field": "revenue", "percentile": 0.5},
    ])


def routed(metrics: list[str], dimensions: list[str], filters: list[str] | None = None, name: str = "monthly") -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        layer = sample_layer(spark, sf_dir)
        layer.graph.models["orders"].pre_aggregations = [p for p in layer.graph.models["orders"].pre_aggregations if p.name == name]
        rollups.refresh(layer, "orders", name)
        return layer.query(metrics=metrics, dimensions=dimensions, filters=filters, use_preaggregations=True, strict_rollups=True)

    return run


def secured(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = sample_layer(spark, sf_dir)
    layer.graph.models["customer"].security = SecurityPolicy("{{ user.role == 'analyst' }}", ["{model}.c_mktsegment IN ({{ user.segments }})"])
    return layer.query(["orders.order_count"], ["customer.c_mktsegment"], user_attributes={"role": "analyst", "segments": ["BUILDING", "MACHINERY"]})


def with_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = sample_layer(spark, sf_dir)
    layer.add_parameter({"name": "least", "type": "number", "default_value": 100000})
    return layer.query(["orders.order_count"], ["orders.o_orderstatus"], ["orders.o_totalprice >= {{ least }} {% if urgent %}AND orders.o_orderpriority = '1-URGENT'{% endif %}"], parameters={"urgent": True})


MONTH = "date_trunc('month', o_orderdate)"
#: Key -> (query, SQL or None).
WORKLOAD: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "simple_agg": (
        rounded(ask(metrics=[f"orders.{m}" for m in ("revenue", "order_count", "avg_price", "min_price", "max_price", "median_price", "sd_price", "sd_pop_price", "buyers")], dimensions=["orders.o_orderstatus"])),
        "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS revenue, count(*) AS order_count, round(avg(o_totalprice), 2) AS avg_price, round(min(o_totalprice), 2) AS min_price, round(max(o_totalprice), 2) AS max_price, round(median(o_totalprice), 2) AS median_price, round(stddev_samp(o_totalprice), 2) AS sd_price, round(stddev_pop(o_totalprice), 2) AS sd_pop_price, count(DISTINCT o_custkey) AS buyers FROM orders GROUP BY 1",
    ),
    "variance_agg": (rounded(ask(metrics=["orders.var_price", "orders.var_pop_price", "orders.p90_price"], dimensions=["orders.o_orderpriority"]), 0), "SELECT o_orderpriority, round(var_samp(o_totalprice), 0) AS var_price, round(var_pop(o_totalprice), 0) AS var_pop_price, round(quantile_cont(o_totalprice, 0.9), 0) AS p90_price FROM orders GROUP BY 1"),
    "approx_distinct": (ask(metrics=["orders.approx_buyers"], dimensions=["orders.o_orderstatus"]), None),
    "metric_filter": (rounded(ask(metrics=["orders.urgent_revenue", "orders.revenue", "orders.urgent_or_zero"], dimensions=["orders.o_orderstatus"])), "SELECT o_orderstatus, round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END), 2) AS urgent_revenue, round(sum(o_totalprice), 2) AS revenue, CAST(0 AS DOUBLE) AS urgent_or_zero FROM orders GROUP BY 1"),
    "derived_ratio": (rounded(ask(metrics=["orders.aov", "orders.revenue_k", "orders.spread"], dimensions=["orders.o_orderstatus"])), "SELECT o_orderstatus, round(sum(o_totalprice) / nullif(count(*), 0), 2) AS aov, round(sum(o_totalprice) / 1000, 2) AS revenue_k, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY 1"),
    "time_grain": (rounded(ask(metrics=["orders.revenue"], dimensions=["orders.o_orderdate__month", "orders.o_orderdate__quarter"])), f"SELECT CAST({MONTH} AS TIMESTAMP) AS o_orderdate__month, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS o_orderdate__quarter, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1, 2"),
    "having_topn": (rounded(ask(metrics=["orders.revenue"], dimensions=["orders.o_custkey"], filters=["orders.revenue > 1000"], order_by=["orders.revenue DESC", "o_custkey"], limit=20)), "SELECT o_custkey, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 1000 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 20"),
    "totals": (rounded(ask(metrics=["orders.revenue", "orders.order_count"], dimensions=["orders.o_orderstatus"], with_totals=True)), "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS revenue, count(*) AS order_count, grouping(o_orderstatus) = 1 AS _is_total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())"),
    "segment_filter": (rounded(ask(metrics=["customer.balance"], dimensions=["customer.c_mktsegment"], segments=["customer.in_credit"])), "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_acctbal > 0 GROUP BY 1"),
    "window_dimension": (ask(metrics=["customer.customers"], dimensions=["customer.c_mktsegment"], filters=["customer.spending_rank <= 10"]), "SELECT c_mktsegment, count(*) AS customers FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 10 GROUP BY 1"),
    "ungrouped": (ask(metrics=["orders.revenue"], dimensions=["orders.o_orderstatus"], ungrouped=True), "SELECT o_orderstatus, o_orderkey, o_totalprice AS revenue FROM orders"),
    "distinct_dimensions": (ask(dimensions=["orders.o_orderstatus", "orders.is_big"]), "SELECT DISTINCT o_orderstatus, o_totalprice > 200000 AS is_big FROM orders"),
    "share_of_total": (rounded(ask(metrics=["orders.share", "orders.buyer_share"], dimensions=["orders.o_orderstatus"]), 4), "SELECT o_orderstatus, round(100 * sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 4) AS share, round(count(DISTINCT o_custkey) / (SELECT count(DISTINCT o_custkey) FROM orders), 4) AS buyer_share FROM orders GROUP BY 1"),
    "more_aggregates": (rounded(ask(metrics=["orders.statuses", "orders.big_orders", "orders.geo_price"], dimensions=["orders.o_orderpriority"])), "SELECT o_orderpriority, (SELECT string_agg(s, ', ' ORDER BY s) FROM (SELECT DISTINCT o_orderstatus AS s FROM orders i WHERE i.o_orderpriority = o.o_orderpriority)) AS statuses, count(*) FILTER (o_totalprice > 200000) AS big_orders, round(exp(avg(ln(o_totalprice))), 2) AS geo_price FROM orders o GROUP BY 1"),
    "moments": (ask(metrics=["orders.skew", "orders.kurt", "orders.mode_priority"], dimensions=["orders.o_orderstatus"]), None),
    "wow": (rounded(ask(metrics=["orders.revenue_wow"], dimensions=["orders.o_orderdate__day"])), "WITH m AS (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS t, sum(o_totalprice) AS r FROM orders GROUP BY 1) SELECT a.t AS o_orderdate__day, round(a.r, 2) AS revenue, round((a.r - b.r) / nullif(b.r, 0) * 100, 2) AS revenue_wow FROM m a LEFT JOIN m b ON b.t = a.t - INTERVAL 7 DAY"),
    "running_max": (rounded(ask(metrics=["orders.running_max"], dimensions=["orders.o_orderdate__month"])), f"SELECT t AS o_orderdate__month, round(x, 2) AS running_max_base, round(max(x) OVER (ORDER BY t), 2) AS running_max FROM (SELECT CAST({MONTH} AS TIMESTAMP) AS t, max(o_totalprice) AS x FROM orders GROUP BY 1)"),
    "window_expression": (rounded(ask(metrics=["orders.revenue", "orders.revenue_rank"], dimensions=["orders.o_orderpriority"])), "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS revenue, CAST(rank() OVER (ORDER BY sum(o_totalprice) DESC) AS INTEGER) AS revenue_rank FROM orders GROUP BY 1"),
    "timezone": (ask(metrics=["events.event_count"], dimensions=["events.ts__day"], timezone="America/New_York"), "SELECT CAST(date_trunc('day', timezone('America/New_York', CAST(ts AS TIMESTAMP) AT TIME ZONE 'UTC')) AS TIMESTAMP) AS ts__day, count(*) AS event_count FROM events GROUP BY 1"),
    "row_security": (secured, "SELECT c_mktsegment, count(*) AS order_count FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) ON o_custkey = c_custkey GROUP BY 1"),
    "parameters": (with_parameters, "SELECT o_orderstatus, count(*) AS order_count FROM orders WHERE o_totalprice >= 100000 AND o_orderpriority = '1-URGENT' GROUP BY 1"),
    "join_cross": (ask(metrics=["orders.order_count"], dimensions=["any_region.r_name"], filters=["orders.o_orderstatus = 'F'"]), "SELECT r_name, count(*) AS order_count FROM orders CROSS JOIN region WHERE o_orderstatus = 'F' GROUP BY 1"),
    "join_junction": (ask(metrics=["part.parts"], dimensions=["supplier.s_suppkey"]), "SELECT s_suppkey, count(DISTINCT p_partkey) AS parts FROM part LEFT JOIN lineitem ON p_partkey = l_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"),
    "rollup_lambda": (rounded(routed(["orders.revenue"], ["orders.o_orderdate__quarter", "orders.o_orderstatus"], name="mixed")), "SELECT CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS o_orderdate__quarter, o_orderstatus, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1, 2"),
    "join_one_hop": (rounded(ask(metrics=["orders.revenue"], dimensions=["customer.c_mktsegment"])), "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS revenue FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "join_two_hop": (rounded(ask(metrics=["lineitem.net", "lineitem.lines"], dimensions=["customer.c_mktsegment"])), "SELECT c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, count(*) AS lines FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "join_four_hop": (rounded(ask(metrics=["lineitem.quantity"], dimensions=["region.r_name"])), "SELECT r_name, round(sum(l_quantity), 2) AS quantity FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "join_filtered_inner": (rounded(ask(metrics=["orders.revenue"], dimensions=["orders.o_orderstatus"], filters=["customer.c_mktsegment = 'BUILDING'"])), "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1"),
    "fanout_safe": (rounded(ask(metrics=["customer.balance"], dimensions=["orders.o_orderstatus"])), "SELECT o_orderstatus, round(sum(c_acctbal), 2) AS balance FROM (SELECT DISTINCT o_orderstatus, c_custkey, c_acctbal FROM customer LEFT JOIN orders ON o_custkey = c_custkey) GROUP BY 1"),
    "multi_fact": (rounded(ask(metrics=["orders.revenue", "lineitem.quantity", "customer.customers"], dimensions=["customer.c_mktsegment"])), "SELECT c_mktsegment, revenue, quantity, customers FROM (SELECT c_mktsegment, round(sum(o_totalprice), 2) AS revenue FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1) a FULL JOIN (SELECT c_mktsegment, round(sum(l_quantity), 2) AS quantity FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1) b USING (c_mktsegment) FULL JOIN (SELECT c_mktsegment, count(*) AS customers FROM customer GROUP BY 1) c USING (c_mktsegment)"),
    "graph_metric": (rounded(ask(metrics=["balance_per_order"], dimensions=["customer.c_mktsegment"])), "SELECT c_mktsegment, round(b / nullif(n, 0), 2) AS balance_per_order FROM (SELECT c_mktsegment, sum(c_acctbal) AS b FROM customer GROUP BY 1) x JOIN (SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) y USING (c_mktsegment)"),
    "distinct_key_sum": (rounded(ask(metrics=["orders.per_customer_price"], dimensions=["orders.o_orderstatus"])), "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS per_customer_price FROM (SELECT DISTINCT o_orderstatus, o_custkey, o_totalprice FROM orders) GROUP BY 1"),
    "semi_additive": (rounded(ask(metrics=["events.last_value"], dimensions=["events.event_type"])), "SELECT event_type, round(sum(CASE WHEN ts = m THEN value END), 2) AS last_value FROM (SELECT *, max(ts) OVER (PARTITION BY event_type, user_id) AS m FROM events) GROUP BY 1"),
    "running_total": (rounded(ask(metrics=["orders.running_revenue"], dimensions=["orders.o_orderdate__month"])), f"SELECT t AS o_orderdate__month, round(revenue, 2) AS revenue, round(sum(revenue) OVER (ORDER BY t), 2) AS running_revenue FROM (SELECT CAST({MONTH} AS TIMESTAMP) AS t, sum(o_totalprice) AS revenue FROM orders GROUP BY 1)"),
    "rolling_7d": (rounded(ask(metrics=["orders.rolling_week"], dimensions=["orders.o_orderdate__day"])), "SELECT t AS o_orderdate__day, round(revenue, 2) AS revenue, round(sum(revenue) OVER (ORDER BY t RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 2) AS rolling_week FROM (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS t, sum(o_totalprice) AS revenue FROM orders GROUP BY 1)"),
    "mtd": (rounded(ask(metrics=["orders.mtd_revenue"], dimensions=["orders.o_orderdate__day"])), "SELECT t AS o_orderdate__day, round(revenue, 2) AS revenue, round(sum(revenue) OVER (PARTITION BY date_trunc('month', t) ORDER BY t), 2) AS mtd_revenue FROM (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS t, sum(o_totalprice) AS revenue FROM orders GROUP BY 1)"),
    "yoy": (rounded(ask(metrics=["orders.revenue_yoy"], dimensions=["orders.o_orderdate__month"])), f"WITH m AS (SELECT CAST({MONTH} AS TIMESTAMP) AS t, sum(o_totalprice) AS r FROM orders GROUP BY 1) SELECT a.t AS o_orderdate__month, round(a.r, 2) AS revenue, round((a.r - b.r) / nullif(b.r, 0) * 100, 2) AS revenue_yoy FROM m a LEFT JOIN m b ON b.t = a.t - INTERVAL 12 MONTH"),
    "mom_difference": (rounded(ask(metrics=["orders.revenue_mom_diff"], dimensions=["orders.o_orderdate__month", "orders.o_orderstatus"])), f"WITH m AS (SELECT CAST({MONTH} AS TIMESTAMP) AS t, o_orderstatus AS s, sum(o_totalprice) AS r FROM orders GROUP BY 1, 2) SELECT a.t AS o_orderdate__month, a.s AS o_orderstatus, round(a.r, 2) AS revenue, round(a.r - b.r, 2) AS revenue_mom_diff FROM m a LEFT JOIN m b ON b.t = a.t - INTERVAL 1 MONTH AND a.s = b.s"),
    "prior_ratio": (rounded(ask(metrics=["orders.revenue_vs_prior"], dimensions=["orders.o_orderdate__month"]), 4), f"WITH m AS (SELECT CAST({MONTH} AS TIMESTAMP) AS t, sum(o_totalprice) AS r FROM orders GROUP BY 1) SELECT a.t AS o_orderdate__month, round(a.r, 4) AS revenue, round(a.r / nullif(b.r, 0), 4) AS revenue_vs_prior FROM m a LEFT JOIN m b ON b.t = a.t - INTERVAL 1 MONTH"),
    "conversion": (rounded(ask(metrics=["events.click_to_purchase"]), 6), "SELECT round(count(DISTINCT b.user_id) FILTER (c.user_id IS NOT NULL) / nullif(count(DISTINCT b.user_id), 0), 6) AS click_to_purchase FROM events b LEFT JOIN events c ON c.event_type = 'purchase' AND c.user_id = b.user_id AND c.ts BETWEEN b.ts AND b.ts + INTERVAL 7 DAY WHERE b.event_type = 'click'"),
    "funnel": (ask(metrics=["events.path"]), "WITH a AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN a USING (user_id) WHERE e.event_type = 'click' AND e.ts >= a.t GROUP BY 1), c AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN b USING (user_id) WHERE e.event_type = 'purchase' AND e.ts >= b.t GROUP BY 1) SELECT (SELECT count(*) FROM a) AS total_entities, (SELECT count(*) FROM a) AS step_1_count, (SELECT count(*) FROM b) AS step_2_count, (SELECT count(*) FROM c) AS step_3_count, (SELECT count(*) FROM c) AS path"),
    "retention": (ask(metrics=["events.retained"]), "WITH c AS (SELECT user_id, CAST(min(date_trunc('day', ts)) AS DATE) AS d FROM events WHERE event_type = 'signup' GROUP BY 1), s AS (SELECT d, count(*) AS n FROM c GROUP BY 1), a AS (SELECT DISTINCT user_id, CAST(date_trunc('day', ts) AS DATE) AS d FROM events WHERE event_type = 'click') SELECT c.d AS cohort_date, CAST(date_diff('day', c.d, a.d) AS INTEGER) AS days_since, count(DISTINCT a.user_id) AS active_users, s.n AS cohort_size, round(count(DISTINCT a.user_id) * 100.0 / s.n, 1) AS retention_pct FROM c JOIN a USING (user_id) JOIN s ON s.d = c.d WHERE date_diff('day', c.d, a.d) BETWEEN 0 AND 28 GROUP BY 1, 2, s.n"),
    "cohort": (ask(metrics=["events.busy_users"], dimensions=["events.event_type"]), "SELECT event_type, count(*) AS busy_users FROM (SELECT event_type, user_id FROM events GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY 1"),
    "table_calcs": (rounded(with_calcs), "WITH r AS (SELECT o_orderpriority, o_orderstatus, sum(o_totalprice) AS x, count(*) AS c FROM orders GROUP BY 1, 2) SELECT o_orderpriority, o_orderstatus, round(x, 2) AS revenue, c AS order_count, round(x / c, 2) AS each, round(x / sum(x) OVER () * 100, 2) AS pct, round(x / sum(x) OVER (PARTITION BY o_orderstatus) * 100, 2) AS pct_status, round((x - lag(x) OVER w) / lag(x) OVER w * 100, 2) AS change, CAST(sum(c) OVER w AS BIGINT) AS running, CAST(rank() OVER (ORDER BY x DESC) AS INTEGER) AS place, CAST(row_number() OVER w AS INTEGER) AS n, round(avg(x) OVER (ORDER BY o_orderpriority, o_orderstatus ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS smooth, round(quantile_cont(x, 0.5) OVER (), 2) AS mid FROM r WINDOW w AS (ORDER BY o_orderpriority, o_orderstatus)"),
    "rollup_routed": (rounded(routed(["orders.revenue", "orders.order_count", "orders.min_price"], ["orders.o_orderdate__quarter", "orders.o_orderstatus"])), "SELECT CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS o_orderdate__quarter, o_orderstatus, round(sum(o_totalprice), 2) AS revenue, count(*) AS order_count, round(min(o_totalprice), 2) AS min_price FROM orders GROUP BY 1, 2"),
    "rollup_joinkey": (rounded(routed(["orders.revenue", "orders.aov"], ["customer.c_mktsegment"])), "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS revenue, round(sum(o_totalprice) / count(*), 2) AS aov FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "sql_simple": (rounded(say("SELECT revenue, o_orderstatus AS status FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderstatus ORDER BY revenue DESC")), "SELECT round(sum(o_totalprice), 2) AS revenue, o_orderstatus AS status FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 2"),
    "sql_expression": (rounded(say("SELECT o_orderstatus, revenue / order_count AS each, SUM(o_totalprice * 2) AS twice FROM orders GROUP BY 1 HAVING order_count > 3")), "SELECT o_orderstatus, round(sum(o_totalprice) / count(*), 2) AS each, round(sum(o_totalprice * 2), 2) AS twice FROM orders GROUP BY 1 HAVING count(*) > 3"),
    "sql_join": (rounded(say("SELECT c.c_mktsegment, o.revenue FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_mktsegment <> 'BUILDING'")), "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1"),
    "sql_cte": (rounded(say("WITH m AS (SELECT o_orderdate__month AS t, revenue FROM orders) SELECT date_trunc('year', t) AS y, sum(revenue) AS revenue FROM m GROUP BY 1")), "SELECT CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS y, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1"),
    "sql_union": (rounded(say("SELECT o_orderstatus AS k, revenue AS v FROM orders UNION ALL SELECT c_mktsegment, balance FROM customer")), "SELECT o_orderstatus AS k, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1 UNION ALL SELECT c_mktsegment, round(sum(c_acctbal), 2) FROM customer GROUP BY 1"),
    "sql_topn": (rounded(say("SELECT o_custkey, revenue FROM orders QUALIFY row_number() OVER (ORDER BY revenue DESC, o_custkey) <= 7")), "SELECT o_custkey, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 7"),
    "sql_metrics_table": (rounded(say("SELECT customer.c_mktsegment, orders.revenue FROM metrics")), "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS revenue FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "measures_visible": (rounded(measure_query("SEMANTIC SELECT status, y, AGGREGATE(revenue) AS r, 100.0 * AGGREGATE(revenue) / AGGREGATE(revenue) AT (ALL) AS pct FROM order_measures WHERE priority <> '5-LOW'")), "SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS y, round(sum(o_totalprice), 2) AS r, round(100.0 * sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 2) AS pct FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2"),
    "measures_all": (rounded(measure_query("SEMANTIC SELECT status, y, AGGREGATE(revenue) AT (ALL y) AS all_years, AGGREGATE(n) AT (WHERE priority = '1-URGENT') AS urgent FROM order_measures")), "SELECT DISTINCT o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS y, round(sum(o_totalprice) OVER (PARTITION BY o_orderstatus), 2) AS all_years, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders"),
    "measures_set": (rounded(measure_query("SEMANTIC SELECT y, AGGREGATE(revenue) AS r, AGGREGATE(revenue) AT (SET y = CURRENT y - 1) AS before FROM order_measures")), "WITH m AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, sum(o_totalprice) AS r FROM orders GROUP BY 1) SELECT a.y, round(a.r, 2) AS r, round(b.r, 2) AS before FROM m a LEFT JOIN m b ON b.y = a.y - 1"),
}

QUERIES = {k: q for k, (q, _) in WORKLOAD.items()}
ORACLES = {k: sql for k, (_, sql) in WORKLOAD.items() if sql}


def _more() -> None:
    from .workload_more import MORE

    for name, (query, sql) in MORE.items():
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql


_more()
