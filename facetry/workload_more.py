"""More queries of the sample tables, each beside SQL written from its meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layer import SemanticLayer
from .operators import table_calcs
from .plans import rollups
from .workload import MONTH, ask, measure_query, rounded, sample_layer, say

Run = Callable[[SparkSession, str], DataFrame]


def with_layer(change: Callable[[SemanticLayer, str], DataFrame]) -> Run:
    """A query over the sample layer after ``change`` declared more."""
    return lambda spark, sf_dir: change(sample_layer(spark, sf_dir), sf_dir)


def as_doubles(query: Run, *names: str) -> Run:
    """Whole numbers that may be NULL as doubles."""
    return lambda spark, sf_dir: (df := query(spark, sf_dir)).withColumns({n: F.col(n).cast("double") for n in names if n in df.columns})


def aggregates(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    layer.add_model({
        "name": "lines", "source_uri": f"{sf_dir}/lineitem.parquet", "primary_key": ["l_orderkey", "l_linenumber"],
        "dimensions": [{"name": "l_returnflag"}],
        "metrics": [
            {"name": "growth", "agg": "product", "sql": "1 + l_discount / 1000"},
            {"name": "spread", "agg": "entropy", "sql": "l_linenumber"},
            {"name": "mean_discount", "sql": "WEIGHTED_AVG(l_discount, l_quantity)"},
            {"name": "q25", "sql": "QUANTILE_CONT(l_extendedprice, 0.25)"},
            {"name": "q75", "sql": "QUANTILE_DISC(l_extendedprice, 0.75)"},
            {"name": "late", "agg": "sum_boolean", "sql": "l_tax > 0.04"},
            {"name": "flags", "sql": "MAX(l_linestatus)"},
        ],
    })
    return layer.query([f"lines.{m}" for m in ("growth", "spread", "mean_discount", "q25", "q75", "late", "flags")], ["lines.l_returnflag"])


def moments(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    return layer.query(["orders.skew", "orders.kurt", "orders.mode_priority"], ["orders.o_orderstatus"])


def approximate(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    """Whether sketches keep to their error: distinct counts within 10 %, medians within 1 % of the ranks."""
    layer.graph.models["orders"].metrics.append(type(layer.graph.models["orders"].metrics[0])("sketched", "approx_median", "o_totalprice"))
    near = layer.query(["orders.approx_buyers", "orders.buyers", "orders.sketched", "orders.median_price"], ["orders.o_orderstatus"])
    close = lambda a, b, e: F.abs(F.col(a) - F.col(b)) <= F.col(b) * e
    return near.select("o_orderstatus", close("approx_buyers", "buyers", 0.1).alias("count_is_close"), close("sketched", "median_price", 0.05).alias("median_is_close"))


def derived_table(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    layer.spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("workload_orders")
    layer.add_model({
        "name": "big", "sql": "SELECT * FROM workload_orders WHERE o_totalprice > 100000", "primary_key": "o_orderkey",
        "dimensions": [{"name": "o_orderpriority"}], "metrics": [{"name": "n", "agg": "count"}],
    })
    return layer.query(["big.n"], ["big.o_orderpriority"])


def introspected(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    layer.add_model({"name": "seen", "source_uri": f"{sf_dir}/supplier.parquet", "primary_key": "s_suppkey", "auto_dimensions": True, "metrics": [{"name": "n", "agg": "count"}]})
    return layer.query(["seen.n"], ["seen.s_nationkey"])


def default_time(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    layer.graph.models["orders"].default_time_dimension, layer.graph.models["orders"].default_grain = "o_orderdate", "year"
    return layer.query(["orders.order_count"])


def joined_as(how: str) -> Run:
    def run(layer: SemanticLayer, sf_dir: str) -> DataFrame:
        layer.add_model({
            "name": "few", "sql": f"SELECT * FROM parquet.`{sf_dir}/customer.parquet` WHERE c_nationkey < 10 AND c_custkey % 3 = 0", "primary_key": "c_custkey",
            "dimensions": [{"name": "c_mktsegment"}],
        })
        layer.add_model({
            "name": "sold", "source_uri": f"{sf_dir}/orders.parquet", "primary_key": "o_orderkey",
            "metrics": [{"name": "n", "agg": "count", "sql": "o_orderkey"}], "relationships": [{"name": "few", "foreign_key": "o_custkey", "join_type": how}],
        })
        return layer.query(["sold.n"], ["few.c_mktsegment"])

    return with_layer(run)


def theta(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    """Orders by the price band that holds them."""
    layer.add_model({"name": "band", "sql": "SELECT * FROM VALUES ('low', 0D, 50000D), ('mid', 50000D, 200000D), ('high', 200000D, 1e9D) AS t(label, lo, hi)", "primary_key": "label", "dimensions": [{"name": "label"}]})
    layer.add_model({
        "name": "priced", "source_uri": f"{sf_dir}/orders.parquet", "primary_key": "o_orderkey", "metrics": [{"name": "n", "agg": "count"}],
        "relationships": [{"name": "band", "sql": "{from}.o_totalprice >= {to}.lo AND {from}.o_totalprice < {to}.hi"}],
    })
    return layer.query(["priced.n"], ["band.label"])


def explored(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    layer.add_explore({"name": "sales", "metrics": ["orders.order_count"], "dimensions": ["orders.o_orderstatus"], "filters": ["orders.o_orderpriority = '1-URGENT'"], "default_metrics": ["orders.order_count"], "default_dimensions": ["orders.o_orderstatus"]})
    return layer.query(explore="sales")


def saved(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    layer.add_saved_query({"name": "by_status", "metrics": ["orders.order_count"], "dimensions": ["orders.o_orderstatus"]})
    return layer.run_saved("by_status", filters=["orders.o_totalprice > 50000"])


def viewed(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    layer.create_view("workload_view", metrics=["orders.order_count"], dimensions=["orders.o_orderstatus"])
    return layer.sql("SELECT o_orderstatus, order_count * 2 AS twice FROM workload_view")


def more_calcs(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    df = layer.query(["orders.order_count"], ["orders.o_orderpriority"])
    order = ["o_orderpriority"]
    calc = lambda kind, **more: {"name": kind, "type": kind, "field": "order_count", **more}
    return table_calcs.apply(df, [calc("dense_rank"), calc("difference", order_by=order), calc("lead", order_by=order), calc("lag", order_by=order)])


def capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_layer(spark, sf_dir, default_limit=7, max_limit=5).query(dimensions=["orders.o_orderkey"], order_by=["o_orderkey"])


def beside_tables(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    layer.spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("workload_customer")
    return layer.sql(
        "SELECT c.c_mktsegment, sum(s.revenue) AS spent FROM (SELECT o_custkey, revenue FROM orders) s "
        "JOIN workload_customer c ON c.c_custkey = s.o_custkey GROUP BY 1"
    )


def passed_through(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    layer.spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("workload_nation")
    return layer.sql("SELECT n_regionkey, count(*) AS n FROM workload_nation GROUP BY n_regionkey")


def closed_to_others(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    """A graph metric and a filter that reach a closed model are refused; the open query isn't."""
    from .model import SecurityPolicy

    layer.graph.models["customer"].security = SecurityPolicy("{{ user.role == 'analyst' }}")
    tried = {
        "graph metric": dict(metrics=["balance_per_order"]),
        "filter": dict(metrics=["orders.order_count"], filters=["customer.c_mktsegment = 'BUILDING'"]),
        "metric filter": dict(metrics=["orders.order_count"], filters=["customer.balance > 1"]),
        "hop": dict(metrics=["orders.order_count"], dimensions=["region.r_name"]),
        "open": dict(metrics=["orders.order_count"], dimensions=["orders.o_orderstatus"]),
    }
    found = []
    for name, query in tried.items():
        try:
            layer.query(**query, user_attributes={"role": "guest"})
            found.append((name, False))
        except PermissionError:
            found.append((name, True))
    return layer.spark.createDataFrame(found, "query string, refused boolean")


def merged(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    """A roll-up built before late rows came, then merged."""
    spark, name = layer.spark, "workload_late"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.filter("o_orderkey % 97 <> 0").createOrReplaceTempView(name)
    layer.add_model({
        "name": "late", "table": name, "primary_key": "o_orderkey", "dimensions": [{"name": "o_orderstatus"}, {"name": "o_orderdate", "type": "time"}],
        "metrics": [{"name": "n", "agg": "count"}, {"name": "total", "agg": "sum", "sql": "o_totalprice"}, {"name": "each", "type": "ratio", "numerator": "total", "denominator": "n"}, {"name": "mean", "agg": "avg", "sql": "o_totalprice"}],
        "pre_aggregations": [{"name": "monthly", "measures": ["each", "mean"], "dimensions": ["o_orderstatus"], "time_dimension": "o_orderdate", "granularity": "month"}],
    })
    rollups.refresh(layer, "late", "monthly")
    orders.createOrReplaceTempView(name)
    rollups.refresh(layer, "late", "monthly", mode="merge")
    return layer.query(["late.n", "late.total", "late.each", "late.mean"], ["late.o_orderdate__year"], use_preaggregations=True, strict_rollups=True)


def several_rollups(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    """Metrics of two models, each from its own roll-up."""
    layer.graph.models["orders"].pre_aggregations = [p for p in layer.graph.models["orders"].pre_aggregations if p.name == "monthly"]
    lines = layer.graph.models["lineitem"]
    lines.dimensions.append(type(lines.dimensions[0])("l_orderkey", "numeric"))
    from .model import PreAggregation

    lines.pre_aggregations = [PreAggregation("by_order", ["quantity", "lines"], ["l_orderkey"])]
    rollups.refresh(layer, "orders", "monthly")
    rollups.refresh(layer, "lineitem", "by_order")
    orders = layer.graph.models["orders"]
    return layer.query([f"{orders.name}.revenue", "lineitem.quantity", "lineitem.lines"], ["customer.c_mktsegment"], use_preaggregations=True)


def over_windows(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    from .model import Metric

    layer.graph.models["orders"].metrics += [Metric("left_over", type="derived", sql="running_revenue / 1000 + coalesce(revenue_mom_diff, 0)"), Metric("running_sd", type="cumulative", agg="stddev", sql="revenue")]
    return layer.query(["orders.left_over", "orders.running_sd"], ["orders.o_orderdate__month"])


def stepwise(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    return layer.query(["events.path"], ["events.ts__day"], order_by=["ts__day"], limit=3, offset=1)


def sets(word: str) -> Run:
    return say(f"SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000 {word} SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")


def set_sql(word: str) -> str:
    return f"SELECT o_custkey AS k FROM orders WHERE o_totalprice > 200000 {word} SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'"


#: The measure view of the workload, in plain SQL.
VIEW = "(SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(year(o_orderdate) AS INTEGER) AS y, o_totalprice AS p FROM orders)"

MORE: dict[str, tuple[Run, str | None]] = {
    "aggregates": (
        rounded(with_layer(aggregates), 4),
        "SELECT l_returnflag, round(product(1 + l_discount / 1000), 4) AS growth, round(entropy(l_linenumber), 4) AS spread, "
        "round(sum(l_discount * l_quantity) / sum(l_quantity), 4) AS mean_discount, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, "
        "round(quantile_disc(l_extendedprice, 0.75), 4) AS q75, CAST(count(*) FILTER (l_tax > 0.04) AS BIGINT) AS late, max(l_linestatus) AS flags FROM lineitem GROUP BY 1",
    ),
    "moments": (
        rounded(with_layer(moments), 3),
        "SELECT o_orderstatus, round(skewness(o_totalprice) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)), 3) AS skew, "
        "round(kurtosis_pop(o_totalprice), 3) AS kurt, "
        "(SELECT i.o_orderpriority FROM orders i WHERE i.o_orderstatus = o.o_orderstatus GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_priority FROM orders o GROUP BY 1",
    ),
    "approx_distinct": (with_layer(approximate), "SELECT DISTINCT o_orderstatus, true AS count_is_close, true AS median_is_close FROM orders"),
    "distinct_key_sum": (
        rounded(ask(metrics=["orders.per_customer_price"], dimensions=["orders.o_orderstatus"])),
        "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS per_customer_price FROM "
        "(SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_totalprice) AS r FROM orders) WHERE r = 1 GROUP BY 1",
    ),
    "derived_table": (with_layer(derived_table), "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1"),
    "introspection": (with_layer(introspected), "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1"),
    "default_time_dimension": (with_layer(default_time), "SELECT CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS o_orderdate__year, count(*) AS order_count FROM orders GROUP BY 1"),
    "join_inner": (joined_as("inner"), "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 10 AND c_custkey % 3 = 0 GROUP BY 1"),
    "join_full": (
        joined_as("full"),
        "SELECT c_mktsegment, count(o_orderkey) AS n FROM orders FULL JOIN (SELECT * FROM customer WHERE c_nationkey < 10 AND c_custkey % 3 = 0) c ON o_custkey = c_custkey GROUP BY 1",
    ),
    "join_right": (
        joined_as("right"),
        "SELECT c_mktsegment, count(o_orderkey) AS n FROM orders RIGHT JOIN (SELECT * FROM customer WHERE c_nationkey < 10 AND c_custkey % 3 = 0) c ON o_custkey = c_custkey GROUP BY 1",
    ),
    "join_theta": (with_layer(theta), "SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS label, count(*) AS n FROM orders GROUP BY 1"),
    "filter_in": (
        ask(metrics=["orders.order_count"], dimensions=["orders.o_orderstatus"], filters=["orders.o_orderpriority IN ('1-URGENT', '2-HIGH') AND orders.o_totalprice BETWEEN 1000 AND 150000"]),
        "SELECT o_orderstatus, count(*) AS order_count FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 1000 AND 150000 GROUP BY 1",
    ),
    "explore": (with_layer(explored), "SELECT o_orderstatus, count(*) AS order_count FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1"),
    "saved_query": (with_layer(saved), "SELECT o_orderstatus, count(*) AS order_count FROM orders WHERE o_totalprice > 50000 GROUP BY 1"),
    "create_view": (with_layer(viewed), "SELECT o_orderstatus, 2 * count(*) AS twice FROM orders GROUP BY 1"),
    "post_process": (
        ask(metrics=["orders.order_count"], dimensions=["orders.o_orderpriority"], post_process="SELECT substr(o_orderpriority, 1, 1) AS p, order_count + 1 AS n FROM {inner}"),
        "SELECT substr(o_orderpriority, 1, 1) AS p, count(*) + 1 AS n FROM orders GROUP BY 1",
    ),
    "row_caps": (capped, "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 5"),
    "more_calcs": (
        as_doubles(with_layer(more_calcs), "difference", "lead", "lag"),
        "WITH r AS (SELECT o_orderpriority, count(*) AS order_count FROM orders GROUP BY 1) SELECT *, CAST(dense_rank() OVER (ORDER BY order_count DESC) AS INTEGER) AS dense_rank, "
        "CAST(order_count - lag(order_count) OVER w AS DOUBLE) AS difference, CAST(lead(order_count) OVER w AS DOUBLE) AS lead, CAST(lag(order_count) OVER w AS DOUBLE) AS lag FROM r WINDOW w AS (ORDER BY o_orderpriority)",
    ),
    "event_offset": (
        with_layer(stepwise),
        "WITH e AS (SELECT *, CAST(date_trunc('day', ts) AS TIMESTAMP) AS m FROM events), "
        "a AS (SELECT m, user_id, min(ts) AS t FROM e WHERE event_type = 'view' GROUP BY 1, 2), "
        "b AS (SELECT e.m, e.user_id, min(e.ts) AS t FROM e JOIN a ON e.m = a.m AND e.user_id = a.user_id WHERE e.event_type = 'click' AND e.ts >= a.t GROUP BY 1, 2), "
        "c AS (SELECT e.m, e.user_id FROM e JOIN b ON e.m = b.m AND e.user_id = b.user_id WHERE e.event_type = 'purchase' AND e.ts >= b.t GROUP BY 1, 2), "
        "months AS (SELECT DISTINCT m FROM e WHERE event_type IN ('view', 'click', 'purchase')) "
        "SELECT m AS ts__day, (SELECT count(*) FROM a WHERE a.m = x.m) AS total_entities, (SELECT count(*) FROM a WHERE a.m = x.m) AS step_1_count, (SELECT count(*) FROM b WHERE b.m = x.m) AS step_2_count, "
        "(SELECT count(*) FROM c WHERE c.m = x.m) AS step_3_count, (SELECT count(*) FROM c WHERE c.m = x.m) AS path FROM months x ORDER BY m LIMIT 3 OFFSET 1",
    ),
    "sql_intersect": (sets("INTERSECT"), set_sql("INTERSECT")),
    "sql_except": (sets("EXCEPT"), set_sql("EXCEPT")),
    "sql_union_distinct": (sets("UNION"), set_sql("UNION")),
    "sql_beside_tables": (rounded(with_layer(beside_tables)), "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS spent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "sql_passthrough": (with_layer(passed_through), "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1"),
    "sql_outer_limit": (
        say("SELECT k, n FROM (SELECT o_custkey AS k, order_count AS n FROM orders ORDER BY order_count DESC, o_custkey LIMIT 20) t ORDER BY n DESC, k LIMIT 5"),
        "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    ),
    "sql_date_parts": (
        say("SELECT year(t) AS y, sum(order_count) AS n FROM (SELECT o_orderdate__quarter AS t, order_count FROM orders) q GROUP BY 1"),
        "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1",
    ),
    "access_gate": (with_layer(closed_to_others), "SELECT * FROM (VALUES ('graph metric', true), ('filter', true), ('metric filter', true), ('hop', true), ('open', false)) t(query, refused)"),
    "rollup_merge": (
        rounded(with_layer(merged)),
        "SELECT CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS o_orderdate__year, count(*) AS n, round(sum(o_totalprice), 2) AS total, "
        "round(sum(o_totalprice) / count(*), 2) AS each, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1",
    ),
    "rollup_multi_fact": (
        rounded(with_layer(several_rollups)),
        "SELECT c_mktsegment, revenue, quantity, lines FROM (SELECT c_mktsegment, round(sum(o_totalprice), 2) AS revenue FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1) a "
        "FULL JOIN (SELECT c_mktsegment, round(sum(l_quantity), 2) AS quantity, count(*) AS lines FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1) b USING (c_mktsegment)",
    ),
    "formula_over_windows": (
        rounded(with_layer(over_windows)),
        f"WITH m AS (SELECT CAST({MONTH} AS TIMESTAMP) AS t, sum(o_totalprice) AS r FROM orders GROUP BY 1) "
        "SELECT a.t AS o_orderdate__month, round(a.r, 2) AS revenue, round(sum(a.r) OVER (ORDER BY a.t) / 1000 + coalesce(a.r - b.r, 0), 2) AS left_over, "
        "round(stddev_samp(a.r) OVER (ORDER BY a.t), 2) AS running_sd FROM m a LEFT JOIN m b ON b.t = a.t - INTERVAL 1 MONTH",
    ),
    "measures_explicit_visible": (
        rounded(measure_query("SEMANTIC SELECT status, revenue AS everything, revenue AT (VISIBLE) AS seen FROM order_measures WHERE priority = '1-URGENT'")),
        f"SELECT status, round((SELECT sum(p) FROM {VIEW} i WHERE i.status = o.status), 2) AS everything, round(sum(p), 2) AS seen FROM {VIEW} o WHERE priority = '1-URGENT' GROUP BY 1",
    ),
    "measures_chained": (
        rounded(measure_query("SEMANTIC SELECT status, y, AGGREGATE(revenue) AT (ALL y) AT (SET status = 'F') AS f FROM order_measures")),
        f"SELECT DISTINCT status, y, round((SELECT sum(p) FROM {VIEW} WHERE status = 'F'), 2) AS f FROM {VIEW}",
    ),
    "measures_curly": (rounded(measure_query("SEMANTIC SELECT status, {revenue} / {n} AS each FROM order_measures")), f"SELECT status, round(sum(p) / count(*), 2) AS each FROM {VIEW} GROUP BY 1"),
    "measures_adhoc_dimension": (
        rounded(measure_query("SEMANTIC SELECT y % 2 AS odd, AGGREGATE(revenue) AS r FROM order_measures GROUP BY y % 2")),
        f"SELECT y % 2 AS odd, round(sum(p), 2) AS r FROM {VIEW} GROUP BY 1",
    ),
    "measures_having_order": (
        measure_query("SEMANTIC SELECT y, AGGREGATE(n) AS n FROM order_measures GROUP BY y HAVING AGGREGATE(n) > 10 ORDER BY AGGREGATE(n) DESC, y LIMIT 3 -- the busiest"),
        f"SELECT y, count(*) AS n FROM {VIEW} GROUP BY 1 HAVING count(*) > 10 ORDER BY 2 DESC, 1 LIMIT 3",
    ),
    "measures_no_group": (rounded(measure_query("SEMANTIC SELECT AGGREGATE(revenue) AS r, AGGREGATE(n) AS n FROM order_measures")), f"SELECT round(sum(p), 2) AS r, count(*) AS n FROM {VIEW}"),
    "measures_rollup": (
        as_doubles(measure_query("SEMANTIC SELECT status, AGGREGATE(n) AS n FROM order_measures GROUP BY ROLLUP (status)"), "n"),
        # a measure of the subtotal row belongs to the NULL key, of which there are no rows
        f"SELECT status, CAST(count(*) AS DOUBLE) AS n FROM {VIEW} GROUP BY status UNION ALL SELECT NULL, NULL",
    ),
    "measures_set_removed": (
        as_doubles(measure_query("SEMANTIC SELECT y, AGGREGATE(n) AT (SET y = CURRENT y - 1) AS before FROM order_measures WHERE y > 1994"), "before"),
        f"SELECT DISTINCT y, (SELECT CAST(nullif(count(*), 0) AS DOUBLE) FROM {VIEW} i WHERE i.y = o.y - 1) AS before FROM {VIEW} o WHERE y > 1994",
    ),
}


def view_query(view: str, text: str, columns: str = "o_orderstatus AS status, year(o_orderdate) AS y") -> Run:
    """A query of a measure view whose measures are ``view``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        layer = sample_layer(spark, sf_dir)
        spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("workload_orders")
        layer.sql(f"CREATE VIEW own_measures AS SELECT {columns}, {view} FROM workload_orders")
        return layer.sql(text)

    return run


MORE |= {
    "measures_derived": (
        rounded(view_query("SUM(o_totalprice) AS MEASURE r, COUNT(*) AS MEASURE n, r / n AS MEASURE each", "SEMANTIC SELECT status, AGGREGATE(each) AS each FROM own_measures")),
        f"SELECT status, round(sum(p) / count(*), 2) AS each FROM {VIEW} GROUP BY 1",
    ),
    "measures_filtered": (
        view_query("COUNT(*) FILTER (WHERE o_totalprice > 100000) AS MEASURE big", "SEMANTIC SELECT status, AGGREGATE(big) AS big FROM own_measures"),
        f"SELECT status, count(*) FILTER (p > 100000) AS big FROM {VIEW} GROUP BY 1",
    ),
    "measures_non_additive": (
        rounded(
            view_query(
                "MEDIAN(o_totalprice) AS MEASURE mid, COUNT(DISTINCT o_custkey) AS MEASURE who, QUANTILE_CONT(o_totalprice, 0.9) AS MEASURE high, QUANTILE_DISC(o_totalprice, 0.1) AS MEASURE low",
                "SEMANTIC SELECT status, AGGREGATE(mid) AS mid, AGGREGATE(mid) AT (ALL) AS all_mid, AGGREGATE(who) AT (ALL status) AS who, AGGREGATE(high) AS high, AGGREGATE(low) AS low FROM own_measures",
            )
        ),
        "SELECT o_orderstatus AS status, round(median(o_totalprice), 2) AS mid, round((SELECT median(o_totalprice) FROM orders), 2) AS all_mid, (SELECT count(DISTINCT o_custkey) FROM orders) AS who, "
        "round(quantile_cont(o_totalprice, 0.9), 2) AS high, round(quantile_disc(o_totalprice, 0.1), 2) AS low FROM orders GROUP BY 1",
    ),
    "measures_null_group": (
        view_query("COUNT(*) AS MEASURE n", "SEMANTIC SELECT k, AGGREGATE(n) AS n FROM own_measures", "nullif(o_orderstatus, 'F') AS k"),
        "SELECT nullif(o_orderstatus, 'F') AS k, count(*) AS n FROM orders GROUP BY 1",
    ),
}


def joined_measures(layer: SemanticLayer, sf_dir: str) -> DataFrame:
    """Measures of two views of facts, by a dimension that both have."""
    for name in ("orders", "lineitem"):
        layer.spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"workload_{name}")
    layer.sql("CREATE VIEW sold AS SELECT year(o_orderdate) AS y, o_orderstatus AS status, SUM(o_totalprice) AS MEASURE revenue FROM workload_orders")
    layer.sql("CREATE VIEW shipped AS SELECT year(l_shipdate) AS y, l_returnflag AS flag, SUM(l_quantity) AS MEASURE quantity FROM workload_lineitem")
    return layer.sql(
        "SEMANTIC SELECT s.y, h.flag, AGGREGATE(revenue) AS revenue, AGGREGATE(quantity) AS quantity, AGGREGATE(quantity) AT (ALL flag) AS whole_year "
        "FROM sold s JOIN shipped h ON s.y = h.y"
    )


MORE |= {
    "measures_joined": (
        rounded(with_layer(joined_measures)),
        "WITH s AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, sum(o_totalprice) AS r FROM orders GROUP BY 1), "
        "h AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS y, l_returnflag AS flag, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) "
        "SELECT y, flag, round(r, 2) AS revenue, round(q, 2) AS quantity, round(sum(q) OVER (PARTITION BY y), 2) AS whole_year FROM s JOIN h USING (y)",
    ),
}
