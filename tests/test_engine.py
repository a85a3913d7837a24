import datetime as dt
import os
import re

import pytest

from facetry import DefinitionError, Metric, Model, SemanticLayer
from facetry.functions.relative_dates import expand, period
from facetry.functions.templates import render, render_secure, with_parameters
from facetry.functions.translate import TIMEFRAMES, expression, formula
from facetry.graph import AmbiguousJoinPath
from facetry.model import Parameter, split_aggregate
from facetry.operators import table_calcs
from facetry.plans import rollups
from facetry.plans.text import aggregate_calls, split_top


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def shop(spark):
    spark.createDataFrame([(1, 1, "paid", 100, "2024-01-05"), (2, 1, "paid", 50, "2024-02-05"), (3, 2, "open", 70, "2024-02-10"), (4, None, "open", 30, "2024-03-01")], "id int, customer_id int, status string, amount int, day string").createOrReplaceTempView("t_orders")
    spark.createDataFrame([(1, "US", 1000), (2, "EU", 500), (3, "EU", 700)], "id int, country string, credit int").createOrReplaceTempView("t_customers")
    spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7), (3, 1, 8)], "order_id int, line int, qty int").createOrReplaceTempView("t_items")

    def make(**options):
        layer = SemanticLayer(spark, **options)
        layer.add_model({"name": "customers", "table": "t_customers", "primary_key": "id", "dimensions": [{"name": "country"}, {"name": "id", "type": "numeric"}], "metrics": [{"name": "credit", "agg": "sum"}, {"name": "n", "agg": "count"}, {"name": "mid_credit", "agg": "median", "sql": "credit"}]})
        layer.add_model({
            "name": "orders", "table": "t_orders", "primary_key": "id",
            "dimensions": [{"name": "status"}, {"name": "amount", "type": "numeric"}, {"name": "day", "type": "time", "sql": "cast(day as date)"}, {"name": "customer_id", "type": "numeric"}],
            "metrics": [{"name": "revenue", "agg": "sum", "sql": "amount"}, {"name": "count_", "sql": "COUNT(*)"}, {"name": "aov", "type": "ratio", "numerator": "revenue", "denominator": "count_"}, {"name": "per", "type": "derived", "sql": "revenue / (count_ - 2)"}, {"name": "paid", "agg": "sum", "sql": "amount", "filters": ["{model}.status = 'paid'"]}],
            "relationships": [{"name": "customers", "foreign_key": "customer_id"}], "segments": [{"name": "large", "sql": "{model}.amount >= 70"}],
        })
        layer.add_model({"name": "items", "table": "t_items", "primary_key": ["order_id", "line"], "dimensions": [{"name": "line", "type": "numeric"}], "metrics": [{"name": "qty", "agg": "sum"}], "relationships": [{"name": "orders", "foreign_key": "order_id"}]})
        return layer

    return make


def test_left_join_keeps_and_filter_narrows(shop):
    layer = shop()
    assert rows(layer.query(["orders.revenue"], ["customers.country"])) == [("EU", 70), ("US", 150), (None, 30)]
    assert rows(layer.query(["orders.revenue"], ["orders.status"], ["customers.country = 'US'"])) == [("paid", 150)]
    assert rows(layer.query(["orders.revenue"], ["orders.status"], ["customers.country = 'US' OR orders.amount = 70"])) == [("open", 70), ("paid", 150)]


def test_fan_out_and_many_facts(shop):
    layer = shop()
    assert rows(layer.query(["customers.credit", "customers.mid_credit"], ["orders.status"])) == [("open", 500, 500.0), ("paid", 1000, 1000.0), (None, 700, 700.0)]
    assert rows(layer.query(["customers.n", "orders.revenue", "items.qty"], ["customers.country"])) == [("EU", 2, 70, 8), ("US", 1, 150, 18), (None, None, 30, None)]
    assert rows(layer.query(["customers.n", "items.qty"])) == [(3, 26)]
    with pytest.raises(DefinitionError, match="primary_key"):
        layer.graph.models["customers"].primary_key = None
        layer.query(["customers.credit"], ["orders.status"])


def test_formulas_filters_and_shapes(shop):
    layer = shop()
    out = layer.query(["orders.aov", "orders.per", "orders.paid"], ["orders.status"], order_by=["orders.status"])
    assert rows(out) == [("open", 50.0, None, None), ("paid", 75.0, None, 150)]  # 2 - 2 divides to NULL
    assert rows(layer.query(["orders.revenue"], ["orders.status"], ["orders.revenue > 100"])) == [("paid", 150)]
    assert rows(layer.query(["orders.count_"], filters=["revenue > 10 AND status = 'open'"])) == [(2,)]
    assert rows(layer.query(["orders.count_"], segments=["orders.large"])) == [(2,)]
    assert [tuple(r) for r in layer.query(["orders.revenue"], ["orders.status"], order_by=["revenue DESC"], limit=1, offset=1).collect()] == [("open", 100)]
    assert layer.query(["orders.revenue"], ["orders.status"], ungrouped=True).count() == 4
    assert layer.query(["orders.revenue"], ["orders.status"], aliases={"orders.revenue": "r", "orders.status": "s"}).columns == ["s", "r"]
    assert rows(layer.query(["orders.revenue"], ["orders.status"], with_totals=True)) == [("open", False, 100), ("paid", False, 150), (None, True, 250)]
    assert rows(layer.query(["orders.revenue"], ["orders.status"], post_process="SELECT max(revenue) AS m FROM {inner}")) == [(150,)]
    assert rows(layer.query(["orders.revenue"], ["orders.day__quarter"])) == [(dt.datetime(2024, 1, 1), 250)]
    assert rows(layer.query(dimensions=["customers.country"])) == [("EU",), ("US",)]


def test_errors(shop):
    layer = shop()
    for bad in (["orders.nothing"], ["nobody.x"]):
        with pytest.raises(DefinitionError):
            layer.query(bad)
    with pytest.raises(DefinitionError):
        layer.query(["orders.revenue"], ["orders.day__fortnight"])
    with pytest.raises(DefinitionError):
        layer.add_model({"name": "orders", "table": "x"})
    layer.add_metric({"name": "a", "type": "derived", "sql": "b + 1"})
    layer.add_metric({"name": "b", "type": "derived", "sql": "a + 1"})
    with pytest.raises(DefinitionError, match="depends on itself"):
        layer.query(["a"])
    with pytest.raises(DefinitionError):
        Metric("x", agg="nonsense")
    with pytest.raises(DefinitionError, match="limit"):
        layer.query(["orders.revenue"], with_totals=True, limit=3)


def test_ambiguous_and_junction_paths(spark):
    spark.sql("SELECT 1 AS id, 1 AS b_id, 1 AS c_id, 10 AS v").createOrReplaceTempView("t_a")
    spark.sql("SELECT 1 AS id, 1 AS d_id").createOrReplaceTempView("t_bc")
    spark.sql("SELECT 1 AS id, 'x' AS name").createOrReplaceTempView("t_d")
    layer = SemanticLayer(spark)
    layer.add_model({"name": "a", "table": "t_a", "primary_key": "id", "metrics": [{"name": "v", "agg": "sum"}], "relationships": [{"name": "b"}, {"name": "c"}]})
    for name in "bc":
        layer.add_model({"name": name, "table": "t_bc", "primary_key": "id", "dimensions": [{"name": "id"}], "relationships": [{"name": "d"}]})
    layer.add_model({"name": "d", "table": "t_d", "primary_key": "id", "dimensions": [{"name": "name"}]})
    with pytest.raises(AmbiguousJoinPath):
        layer.query(["a.v"], ["d.name"])
    assert rows(layer.query(["a.v"], ["d.name", "b.id"])) == [("x", 1, 10)]
    spark.createDataFrame([(1, 10), (2, 20)], "id int, amount int").createOrReplaceTempView("t_o")
    spark.createDataFrame([(1, 7), (1, 8), (2, 7)], "o_id int, p_id int").createOrReplaceTempView("t_op")
    spark.createDataFrame([(7, "x"), (8, "x")], "id int, category string").createOrReplaceTempView("t_p")
    m2m = SemanticLayer(spark)
    m2m.add_model({"name": "o", "table": "t_o", "primary_key": "id", "metrics": [{"name": "total", "agg": "sum", "sql": "amount"}], "relationships": [{"name": "p", "type": "many_to_many", "through": "op", "through_foreign_key": "o_id", "related_foreign_key": "p_id"}]})
    m2m.add_model({"name": "op", "table": "t_op"})
    m2m.add_model({"name": "p", "table": "t_p", "primary_key": "id", "dimensions": [{"name": "category"}]})
    assert rows(m2m.query(["o.total"], ["p.category"])) == [("x", 30)]
    custom = SemanticLayer(spark)
    custom.add_model({"name": "o", "table": "t_o", "primary_key": "id", "metrics": [{"name": "total", "agg": "sum", "sql": "amount"}], "relationships": [{"name": "p", "sql": "{from}.amount = {to}.id + 3"}, {"name": "z", "type": "cross"}]})
    custom.add_model({"name": "p", "table": "t_p", "primary_key": "id", "dimensions": [{"name": "id"}]})
    custom.add_model({"name": "z", "table": "t_d", "dimensions": [{"name": "name"}]})
    assert rows(custom.query(["o.total"], ["p.id"])) == [(7, 10), (None, 20)]
    assert rows(custom.query(["o.total"], ["z.name"])) == [("x", 30)]


@pytest.fixture(scope="module")
def events(spark):
    data = [(1, "a", "signup", "2024-01-01", "us", "web", 0), (2, "a", "purchase", "2024-01-05", "us", "ios", 100), (3, "b", "signup", "2024-01-05", "us", "web", 0), (4, "c", "signup", "2024-02-01", "eu", "web", 0), (5, "c", "purchase", "2024-02-03", "eu", "ios", 150), (6, "a", "active", "2024-01-02", "us", "web", 0), (7, "b", "active", "2024-01-07", "us", "web", 0), (8, "b", "purchase", "2024-02-20", "us", "web", 250)]
    spark.createDataFrame(data, "event_id int, user_id string, event_type string, event_date string, region string, raw_platform string, amount int").createOrReplaceTempView("t_events")
    layer = SemanticLayer(spark)
    layer.add_model({
        "name": "events", "sql": "SELECT *, cast(event_date as date) AS d FROM t_events", "primary_key": "event_id",
        "dimensions": [{"name": "user_id"}, {"name": "event_type"}, {"name": "event_date", "type": "time", "sql": "d"}, {"name": "region"}, {"name": "platform", "sql": "raw_platform"}],
        "metrics": [
            {"name": "revenue", "agg": "sum", "sql": "amount"}, {"name": "running", "type": "cumulative", "sql": "revenue"}, {"name": "mom", "type": "time_comparison", "base_metric": "revenue", "comparison_type": "mom"},
            {"name": "conv", "type": "conversion", "entity": "user_id", "base_event": "signup", "conversion_event": "purchase", "conversion_window": "7 days"},
            {"name": "ret", "type": "retention", "entity": "user_id", "cohort_event": "event_type = 'signup'", "activity_event": "event_type = 'active'", "periods": 7},
            {"name": "multi", "type": "cohort", "agg": "count", "entity": "user_id", "inner_metrics": [{"name": "p", "agg": "count_distinct", "sql": "platform"}], "entity_dimensions": ["region"], "having": "p >= 2"},
            {"name": "steps", "type": "conversion", "entity": "user_id", "steps": ["event_type = 'signup'", "event_type = 'active'", "event_type = 'purchase'"]},
        ],
    })
    return layer


def test_event_metrics(events):
    month = "events.event_date__month"
    assert [tuple(r)[1:] for r in events.query(["events.running"], [month], order_by=[month]).collect()] == [(100, 100), (400, 500)]
    assert [tuple(r)[1:] for r in events.query(["events.mom"], [month, "events.region"], order_by=[month, "region"]).collect()] == [("us", 100, None), ("eu", 150, None), ("us", 250, 150.0)]
    assert rows(events.query(["events.conv"], ["events.region"])) == [("eu", 1.0), ("us", 0.5)]
    assert rows(events.query(["events.ret"])) == [(dt.date(2024, 1, 1), 1, 1, 1, 100.0), (dt.date(2024, 1, 5), 2, 1, 1, 100.0)]
    assert rows(events.query(["events.multi"])) == [("eu", 1), ("us", 1)]
    assert rows(events.query(["events.steps"])) == [(3, 3, 2, 2, 2)]
    with pytest.raises(DefinitionError, match="alone"):
        events.query(["events.conv", "events.revenue"])


def test_semi_additive(spark):
    spark.createDataFrame([("a", "eu", "2024-01-01", 5), ("a", "eu", "2024-01-02", 7), ("b", "eu", "2024-01-01", 1)], "account string, region string, day string, balance int").createOrReplaceTempView("t_bal")
    layer = SemanticLayer(spark)
    layer.add_model({"name": "bal", "table": "t_bal", "dimensions": [{"name": "region"}, {"name": "day", "type": "time", "sql": "cast(day as date)"}], "metrics": [{"name": "total", "agg": "sum", "sql": "balance", "non_additive_dimension": "day"}, {"name": "each", "agg": "sum", "sql": "balance", "non_additive_dimension": "day", "non_additive_groupings": ["account"]}, {"name": "plain", "agg": "sum", "sql": "balance"}]})
    assert rows(layer.query(["bal.total", "bal.each", "bal.plain"], ["bal.region"])) == [("eu", 7, 8, 13)]
    assert [r[1:] for r in rows(layer.query(["bal.total"], ["bal.day"]))] == [(6,), (7,)]


def test_table_calculations(spark):
    df = spark.createDataFrame([("a", 10), ("b", None), ("c", 30), ("d", 30)], "k string, v int")
    out = table_calcs.apply(df, [
        {"name": "f", "type": "formula", "expression": "${v} * 2 + 1"}, {"name": "z", "type": "formula", "expression": "1 / ${v}"}, {"name": "p", "type": "percent_of_previous", "field": "v", "order_by": ["k"]},
        {"name": "r", "type": "running_total", "field": "v", "order_by": ["k"]}, {"name": "rank", "type": "rank", "field": "v"}, {"name": "dr", "type": "dense_rank", "field": "v"}, {"name": "m", "type": "moving_average", "field": "v", "window_size": 2, "order_by": ["k"]},
        {"name": "l", "type": "lead", "field": "v", "order_by": ["k"]},
    ]).orderBy("k")
    got = [tuple(r)[2:] for r in out.collect()]
    assert [g[0] for g in got] == [21, 1, 61, 61] and got[1][1] is None and [g[2] for g in got] == [None, None, None, 0.0]
    assert [g[3] for g in got] == [10, 10, 40, 70] and [g[4] for g in got] == [3, 4, 1, 1] and [g[5] for g in got] == [2, 3, 1, 1]
    assert [g[6] for g in got] == [10.0, 5.0, 15.0, 30.0] and [g[7] for g in got] == [None, 30, 30, None]
    with pytest.raises(DefinitionError):
        table_calcs.apply(df, [{"name": "x", "type": "running_total", "field": "v"}])


def test_rollups(shop, spark):
    layer = shop()
    layer.graph.models["orders"].metrics.append(Metric("average", "avg", "amount"))
    layer.graph.models["orders"].metrics.append(Metric("mid", "median", "amount"))
    layer.graph.models["orders"].metrics.append(Metric("n_amounts", "count", "amount"))
    from facetry.model import PreAggregation

    layer.graph.models["orders"].pre_aggregations = [PreAggregation("monthly", ["revenue", "average", "n_amounts", "mid"], ["status", "customer_id"], "day", "month", partition_granularity="year")]
    assert rollups.refresh(layer, "orders", "monthly") == "orders_preagg_monthly"
    asked = dict(metrics=["orders.revenue", "orders.average"], dimensions=["orders.day__quarter", "orders.status"])
    assert rows(layer.query(**asked, use_preaggregations=True, strict_rollups=True)) == rows(layer.query(**asked))
    joined = dict(metrics=["orders.revenue"], dimensions=["customers.country"], filters=["orders.status = 'paid'"])
    assert rows(layer.query(**joined, use_preaggregations=True, strict_rollups=True)) == rows(layer.query(**joined)) == [("US", 150)]
    for bad in (dict(metrics=["orders.mid"], dimensions=["orders.status"]), dict(metrics=["orders.revenue"], dimensions=["orders.day__week"]), dict(metrics=["orders.revenue"], filters=["orders.amount > 1"])):
        assert rows(layer.query(**bad, use_preaggregations=True)) == rows(layer.query(**bad))
        with pytest.raises(DefinitionError):
            layer.query(**bad, use_preaggregations=True, strict_rollups=True)
    why = rollups.explain(layer, ["orders.mid"], ["orders.status"])
    assert not why[0]["usable"] and why[0]["reasons"]
    spark.sql("SELECT * FROM t_orders UNION ALL SELECT 9, 1, 'paid', 11, '2024-03-20' UNION ALL SELECT 10, 1, 'paid', 12, '2024-04-20'").createOrReplaceTempView("t_orders2")
    layer.graph.models["orders"].table = "t_orders2"
    rollups.refresh(layer, "orders", "monthly", mode="incremental")
    assert rows(layer.query(**asked, use_preaggregations=True, strict_rollups=True)) == rows(layer.query(**asked))
    log = [rollups.Asked(("orders",), ("orders.revenue",), ("orders.day__month", "orders.status"))] * 3
    assert rollups.recommend(log)[0]["granularity"] == "month"
    rollups.drop(spark, "orders_preagg_monthly")


def test_lambda_rollup(shop, spark):
    from facetry.model import PreAggregation

    layer = shop()
    p = PreAggregation("mixed", ["revenue"], ["status"], "day", "month", type="lambda", build_range_end="2024-02-01")
    layer.graph.models["orders"].pre_aggregations = [p]
    rollups.refresh(layer, "orders", "mixed")
    assert spark.table("orders_preagg_mixed").count() == 1
    asked = dict(metrics=["orders.revenue"], dimensions=["orders.day__month"])
    assert rows(layer.query(**asked, use_preaggregations=True, strict_rollups=True)) == rows(layer.query(**asked))
    rollups.drop(spark, "orders_preagg_mixed")


def test_security_and_contracts(shop):
    layer = shop(enforce_visibility=True, max_limit=2)
    from facetry import Explore, SecurityPolicy

    model = layer.graph.models["customers"]
    model.security = SecurityPolicy("{{ user.role == 'admin' }}", ["{model}.country = {{ user.country }}"])
    with pytest.raises(PermissionError):
        layer.query(["customers.n"])
    with pytest.raises(PermissionError):
        layer.query(["customers.n"], user_attributes={"role": "guest"})
    assert rows(layer.query(["customers.n"], user_attributes={"role": "admin", "country": "EU"})) == [(2,)]
    assert rows(layer.query(["customers.n"], user_attributes={"role": "admin", "country": "EU' OR '1'='1"})) == [(0,)]
    layer.graph.models["orders"].dimension("amount").public = False
    with pytest.raises(PermissionError):
        layer.query(["orders.revenue"], ["orders.amount"])
    layer.add_explore(Explore("sales", ["orders.revenue"], ["orders.status"], ["orders.status <> 'open'"], default_metrics=["orders.revenue"]))
    assert rows(layer.query(explore="sales")) == [(150,)]
    with pytest.raises(PermissionError):
        layer.query(["orders.count_"], explore="sales")
    assert layer.query(dimensions=["orders.customer_id"]).count() == 2  # capped


def test_dates_templates_and_parameters(shop, spark):
    layer = shop()
    assert period("last 7 days") == ("date_add(current_date(), -7)", None) and period("never") is None
    months = "add_months(cast(date_trunc('month', current_date()) as date), -3)"
    assert period("last 3 months") == (months, f"add_months({months}, 3)")
    assert spark.sql(f"SELECT {period('last 3 months')[1]} = cast(date_trunc('month', current_date()) as date)").first()[0]
    assert expand("a.d = 'last 2 weeks'") == "(a.d >= date_add(current_date(), -14))"
    assert expand("a.d = 'next 7 days'") == "(a.d >= current_date() AND a.d < date_add(date_add(current_date(), 7), 1))"
    assert expand("a.d >= 'next 7 days'") == "a.d >= date_add(current_date(), 7)" and expand("a.d < 'last 3 months'") == f"a.d < {months}"
    assert period("next 3 months") is None and period("this 2 weeks") is None
    assert "add_months(cast(date_trunc('quarter', current_date()) as date), -6)" in expand("a.d = 'last 2 quarters'")
    assert expand("orders.day = 'this month'").startswith("(orders.day >= cast(date_trunc('month'") and expand("a = 'b'") == "a = 'b'"
    for text in ("today", "yesterday", "last week", "this quarter", "next year", "last 3 months"):
        assert spark.sql(f"SELECT {period(text)[0]} < {period(text)[1]}").first()[0]
    assert layer.query(["orders.count_"], filters=["orders.day <= 'today'"]).first()[0] == 4
    assert render("{% if n > 1 %}many{% elif n == 1 %}one{% else %}none{% endif %} {% for x in xs %}<{{ x | upper }}>{% endfor %}", {"n": 1, "xs": ["a", "b"]}) == "one <A><B>"
    assert render_secure("x in ({{ user.ids }}) and y = {{ user.name }}", {"ids": [1, 2], "name": "o'hara"}) == "x in (1, 2) and y = 'o\\'hara'"
    for bad in ("{{ __import__('os') }}", "{% if x %}", "{{ nobody }}"):
        with pytest.raises(DefinitionError):
            render(bad, {"x": 1})
    layer.add_parameter(Parameter("status", "string", "paid"))
    layer.add_parameter(Parameter("least", "number", 0))
    assert rows(layer.query(["orders.count_"], filters=["orders.status = {{ status }}", "orders.amount >= {{ least }}"], parameters={"least": 60})) == [(1,)]
    with pytest.raises(DefinitionError):
        with_parameters("{{ p }}", {"p": Parameter("p", "unquoted")}, {"p": "a; drop"})


def test_timezone(spark):
    spark.sql("SELECT timestamp'2024-01-01 02:00:00' AS t, 1 AS v").createOrReplaceTempView("t_tz")
    layer = SemanticLayer(spark)
    layer.add_model({"name": "z", "table": "t_tz", "dimensions": [{"name": "t", "type": "time"}], "metrics": [{"name": "v", "agg": "sum"}], "default_time_dimension": "t", "default_grain": "day"})
    assert layer.query(["z.v"], timezone="America/New_York").first()[0] == dt.datetime(2023, 12, 31)


def test_semantic_sql(shop):
    layer = shop()
    q = lambda text: rows(layer.sql(text))
    assert q("SELECT status, revenue FROM orders -- all\n;") == [("open", 100), ("paid", 150)]
    assert q("SELECT upper(o.status) AS s, o.revenue * 2 AS d FROM orders AS o WHERE o.amount > 30 GROUP BY 1") == [("OPEN", 140), ("PAID", 300)]
    assert q("SELECT country, credit FROM customers HAVING credit > 1000") == [("EU", 1200)]
    assert q("SELECT DISTINCT status FROM orders") == [("open",), ("paid",)]
    assert [tuple(r) for r in layer.sql("SELECT status AS s, revenue AS r FROM orders ORDER BY r DESC LIMIT 1").collect()] == [("paid", 150)]
    assert q("WITH a AS (SELECT status, revenue FROM orders) SELECT max(revenue) FROM a") == [(150,)]
    assert q("SELECT t.status, c.country FROM (SELECT status, revenue FROM orders) t CROSS JOIN t_customers c WHERE c.id = 1 AND t.revenue > 100") == [("paid", "US")]
    assert q("SELECT revenue FROM orders UNION ALL SELECT credit FROM customers") == [(2200,), (250,)]
    assert q("SELECT * FROM t_items WHERE qty > 7") == [(3, 1, 8)]
    assert q("SELECT day__month, MAX(amount) AS m FROM orders WHERE status = 'open' GROUP BY day__month") == [(dt.datetime(2024, 2, 1), 70), (dt.datetime(2024, 3, 1), 30)]
    assert q("SELECT o.revenue, c.country FROM orders o JOIN customers c ON o.customer_id = c.id AND c.country = 'US'") == [(150, "US")]
    with pytest.raises(DefinitionError):
        layer.sql("SELECT o.revenue FROM orders o JOIN customers c ON o.id = c.id")
    with pytest.raises(DefinitionError):
        layer.sql("SELECT status, day, revenue FROM orders GROUP BY status")


def test_measures_in_sql(spark):
    spark.createDataFrame([(2022, "US", 100.0), (2022, "EU", 50.0), (2023, "US", 150.0), (2023, "EU", 75.0), (2023, None, 5.0)], "year int, region string, amount double").createOrReplaceTempView("m_sales")
    layer = SemanticLayer(spark)
    layer.sql("CREATE VIEW v AS SELECT year, region, SUM(amount) AS MEASURE revenue, COUNT(*) AS MEASURE n, revenue / n AS MEASURE mean, MEDIAN(amount) AS MEASURE mid FROM m_sales")
    q = lambda text: rows(layer.sql(text))
    assert q("SEMANTIC SELECT year, AGGREGATE(revenue) FROM v") == [(2022, 150.0), (2023, 230.0)]
    assert q("SEMANTIC SELECT AGGREGATE(revenue) AS r FROM v") == [(380.0,)]
    assert q("SELECT year, region, AGGREGATE(revenue) AT (ALL region) AS t FROM v WHERE region = 'US'") == [(2022, "US", 100.0), (2023, "US", 150.0)]
    assert q("SELECT year, region, revenue AT (ALL region) AS t FROM v WHERE region = 'US'") == [(2022, "US", 150.0), (2023, "US", 230.0)]
    assert q("SEMANTIC SELECT region, AGGREGATE(revenue) AT (WHERE year = 2022) AS t, AGGREGATE(mean) AS m FROM v") == [("EU", 150.0, 62.5), ("US", 150.0, 125.0), (None, 150.0, 5.0)]
    assert q("SEMANTIC SELECT year, AGGREGATE(revenue) - AGGREGATE(revenue) AT (SET year = CURRENT year - 1) AS d FROM v") == [(2022, None), (2023, 80.0)]
    assert q("SEMANTIC SELECT year, AGGREGATE(revenue) AT (SET region IN ('US')) AS us FROM v") == [(2022, 100.0), (2023, 150.0)]
    assert q("SEMANTIC SELECT year, AGGREGATE(revenue) AT (ALL year) AT (ALL region) AS t FROM v") == [(2022, 380.0), (2023, 380.0)]
    assert q("SEMANTIC SELECT region, AGGREGATE(mid) AS m FROM v GROUP BY region HAVING AGGREGATE(revenue) > 10 ORDER BY region") == [("EU", 62.5), ("US", 125.0)]
    assert q("SEMANTIC SELECT year % 2 AS odd, {revenue} AS r, COUNT(*) AS c FROM v GROUP BY year % 2") == [(0, 150.0, 2), (1, 230.0, 3)]
    assert q("SEMANTIC SELECT region, revenue AS r, COUNT(*) AS c FROM v GROUP BY ROLLUP(region)") == [("EU", 125.0, 2), ("US", 250.0, 2), (None, 5.0, 1), (None, 5.0, 5)]


def test_text_tools():
    assert split_aggregate("SUM(a + (b))") == ("sum", "a + (b)") and split_aggregate("COUNT(DISTINCT x)") == ("count_distinct", "x")
    assert split_aggregate("SUM(a) / SUM(b)") == (None, "SUM(a) / SUM(b)") and split_aggregate("COUNT(*)") == ("count", None)
    assert split_top("a BETWEEN 1 AND 2 AND (b AND c) AND d = 'x and y'", "and") == ["a BETWEEN 1 AND 2", "(b AND c)", "d = 'x and y'"]
    assert len(aggregate_calls("sum(a) / count(b) FILTER (WHERE c) + max(x) over (order by y)")) == 2


def test_translators(spark):
    spark.createDataFrame([(1, "ab", 4.0, "2024-03-05 06:07:08")], "i int, s string, x double, t string").createOrReplaceTempView("t_tr")
    run = lambda sql: spark.sql(f"SELECT {sql} FROM (SELECT *, cast(t AS timestamp) AS ts FROM t_tr)").first()[0]
    assert run(formula("IF [i] > 1 THEN 'big' ELSEIF [i] == 1 THEN 'one' ELSE 'no' END")) == "one"
    assert run(formula("ZN(NULL) + IIF(CONTAINS([s], 'b'), LEN([s]), 0)")) == 2 and run(formula("[s] + 'c'")) == "abc"
    assert run(expression("_.x.sum() / _.count()")) == 4.0 and run(expression("(_.s.isin(['ab', 'c'])) & (_.i.between(0, 2))")) is True
    assert run(expression("1 if _.s.like('a%') else 0")) == 1
    for shape in TIMEFRAMES.values():
        assert run(shape.replace("{x}", "ts")) is not None
    with pytest.raises(DefinitionError):
        expression("_.x.explode()")


def test_inheritance_and_hierarchy():
    base = Model("base", table="t", dimensions=[{"name": "a"}, {"name": "b", "parent": "a"}], metrics=[{"name": "n", "agg": "count"}])
    child = base.extended_by(Model("child", table="u", dimensions=[{"name": "c", "parent": "b"}]))
    assert child.hierarchy("c") == ["a", "b", "c"] and child.drill_down("a") == "b" and child.drill_up("c") == "b" and child.metric("n") and child.table == "u"


def test_totals_over_all_groups(shop):
    layer = shop()
    model = layer.graph.models["orders"]
    model.metrics += [Metric("share", type="derived", sql="revenue / _.all(revenue)"), Metric("mid", "median", "amount"), Metric("mid_share", type="derived", sql="mid / _.all(mid)")]
    got = rows(layer.query(["orders.share", "orders.mid_share"], ["orders.status"], ["orders.amount > 30"]))
    assert got == [("open", pytest.approx(70 / 220), 1.0), ("paid", pytest.approx(150 / 220), pytest.approx(75 / 70))]
    with pytest.raises(DefinitionError):
        layer.query(["orders.share"], ["orders.status"], ungrouped=True)


def test_units_and_types_as_names(spark):
    spark.sql("SELECT 2024 AS year, date'2024-01-05' AS date, 3 AS month UNION ALL SELECT 2023, date'2023-01-05', 4").createOrReplaceTempView("t_units")
    layer = SemanticLayer(spark)
    layer.add_model({"name": "u", "table": "t_units", "dimensions": [{"name": "year", "type": "numeric"}, {"name": "date", "type": "time"}], "metrics": [{"name": "n", "agg": "sum", "sql": "month"}]})
    assert rows(layer.query(["u.n"], ["u.year"], ["date >= date '2023-12-01' AND date < cast('2024-01-04' as date) + INTERVAL '3' day"])) == [(2024, 3)]


# access

def closed(layer, name="customers", **policy):
    from facetry.model import SecurityPolicy

    layer.graph.models[name].security = SecurityPolicy(**policy)
    return layer


@pytest.mark.parametrize("query", [
    dict(metrics=["both"]),
    dict(metrics=["orders.mixed"]),
    dict(metrics=["orders.revenue"], filters=["customers.credit > 600"]),
    dict(metrics=["orders.revenue"], filters=["customers.country = 'US'"]),
    dict(metrics=["orders.revenue"], dimensions=["customers.country"]),
    dict(metrics=["items.qty"], dimensions=["customers.country"]),
    dict(metrics=["items.qty"], dimensions=["regions.zone"]),
    dict(dimensions=["items.line", "customers.country"]),
    dict(metrics=["orders.revenue"], segments=["customers.rich"]),
])
def test_closed_models_take_part_in_nothing(shop, spark, query):
    spark.createDataFrame([("US", "west"), ("EU", "east")], "country string, zone string").createOrReplaceTempView("t_regions")

    def layer():
        made = shop()
        made.add_model({"name": "regions", "table": "t_regions", "primary_key": "country", "dimensions": [{"name": "zone"}]})
        made.add_metric({"name": "both", "type": "derived", "sql": "customers.credit / orders.count_"})
        made.graph.models["orders"].metrics.append(Metric("mixed", type="derived", sql="customers.credit / count_"))
        made.graph.models["customers"].segments = [type("S", (), {"name": "rich", "sql": "{model}.credit > 600", "public": True})()]
        from facetry.model import Relationship

        made.graph.models["customers"].relationships = [Relationship("regions", foreign_key="country")]
        made.graph._hops = None
        return made

    assert layer().query(**query).count() > 0
    with pytest.raises(PermissionError, match="customers is closed"):
        closed(layer(), access="{{ user.role == 'admin' }}").query(**query, user_attributes={"role": "guest"})
    with pytest.raises(PermissionError, match="needs user attributes"):
        closed(layer(), access=True).query(**query)
    assert rows(closed(layer(), access="{{ user.role == 'admin' }}").query(**query, user_attributes={"role": "admin"})) == rows(layer().query(**query))


def test_closed_models_behind_rollups_and_sql(shop, spark):
    from facetry.model import PreAggregation

    layer = shop()
    layer.graph.models["orders"].pre_aggregations = [PreAggregation("m", ["revenue"], ["status"], "day", "month")]
    rollups.refresh(layer, "orders", "m")
    closed(layer, "orders", access=False)
    for ask in (lambda: layer.query(["orders.revenue"], use_preaggregations=True, user_attributes={}), lambda: layer.sql("SELECT revenue FROM orders", user_attributes={})):
        with pytest.raises(PermissionError):
            ask()
    rollups.drop(spark, "orders_preagg_m")


def test_hidden_fields_in_filters_orders_and_segments(shop):
    layer = shop(enforce_visibility=True)
    layer.graph.models["orders"].dimension("status").public = False
    layer.graph.models["orders"].segment("large").public = False
    for bad in (dict(filters=["orders.status = 'paid'"]), dict(filters=["status = 'paid'"]), dict(segments=["orders.large"]), dict(dimensions=["orders.status"])):
        with pytest.raises(PermissionError, match="public"):
            layer.query(["orders.revenue"], **bad)


# roll-ups


def test_merge_takes_late_rows(shop, spark):
    from facetry.model import PreAggregation

    base = [(1, "a", 10, "2024-01-05"), (2, "a", 20, "2024-02-05"), (3, "b", 5, "2024-03-01")]
    make = lambda rows_: spark.createDataFrame(rows_, "id int, k string, v int, day string").createOrReplaceTempView("t_late")
    make(base)
    layer = SemanticLayer(spark)
    layer.add_model({"name": "late", "table": "t_late", "primary_key": "id", "dimensions": [{"name": "k"}, {"name": "day", "type": "time", "sql": "cast(day as timestamp)"}], "metrics": [{"name": "total", "agg": "sum", "sql": "v"}, {"name": "mean", "agg": "avg", "sql": "v"}, {"name": "n", "agg": "count"}, {"name": "each", "type": "ratio", "numerator": "total", "denominator": "n"}]})
    layer.graph.models["late"].pre_aggregations = [PreAggregation("m", ["mean", "each"], ["k"], "day", "month", partition_granularity="year")]
    asked = dict(metrics=["late.total", "late.mean", "late.each"], dimensions=["late.day__month"])
    both = lambda: (rows(layer.query(**asked, use_preaggregations=True, strict_rollups=True)), rows(layer.query(**asked)))
    rollups.refresh(layer, "late", "m")
    assert both()[0] == both()[1]
    make([*base, (4, "a", 1000, "2024-01-20")])  # late
    rollups.refresh(layer, "late", "m", mode="incremental")
    assert both()[0] != both()[1]
    before = {t.name for t in spark.catalog.listTables(pattern="late_preagg_m__*")}
    rollups.refresh(layer, "late", "m", mode="merge")
    assert both()[0] == both()[1]
    new = [t.name for t in spark.catalog.listTables(pattern="late_preagg_m__*") if t.name not in before]
    assert sorted(spark.table(t).count() for t in new) == [1, 1]  # only what was touched: a bucket's row and its name
    make([base[0], base[2], (5, "c", 7, "2023-05-05")])  # a bucket goes, one comes
    rollups.refresh(layer, "late", "m", mode="merge")
    assert both()[0] == both()[1] and len(both()[1]) == 3
    for i in range(12):
        make([base[0], base[2], (5, "c", 7, "2023-05-05"), (6, "c", i, "2024-03-09")])
        rollups.refresh(layer, "late", "m", mode="incremental" if i % 2 else "merge", lookback="40 days")
        assert both()[0] == both()[1]
    assert len(rollups.layers_of(spark, "late_preagg_m")) <= rollups.LAYERS
    with pytest.raises(DefinitionError, match="unknown refresh mode"):
        rollups.refresh(layer, "late", "m", mode="upsert")
    rollups.drop(spark, "late_preagg_m")


def test_rollups_of_several_models_and_unstorable_measures(shop, spark):
    from facetry.model import PreAggregation

    layer = shop()
    layer.graph.models["orders"].metrics.append(Metric("spread", sql="MAX(amount) - MIN(amount)"))
    layer.graph.models["orders"].pre_aggregations = [PreAggregation("m", ["aov"], ["customer_id"], "day", "month"), PreAggregation("odd", ["spread", "nobody"], ["status"])]
    layer.graph.models["items"].pre_aggregations = [PreAggregation("all", ["qty"], ["order_id"])]
    layer.graph.models["items"].dimensions.append(type(layer.graph.models["items"].dimensions[0])("order_id", "numeric"))
    rollups.refresh(layer, "orders", "m")
    asked = dict(metrics=["orders.aov", "orders.revenue", "items.qty"], dimensions=["customers.country"])
    one = layer.query(**asked, use_preaggregations=True)
    assert "t_items" not in str(one._jdf.queryExecution().analyzed().toString()) or rows(one) == rows(layer.query(**asked))
    with pytest.raises(DefinitionError, match="no roll-up"):
        layer.query(**asked, use_preaggregations=True, strict_rollups=True)
    # the model's other roll-up can't be stored; queries fall back and say why
    assert rows(layer.query(["orders.spread"], ["orders.status"], use_preaggregations=True)) == rows(layer.query(["orders.spread"], ["orders.status"]))
    assert any("nobody" not in r for r in rollups.explain(layer, ["orders.spread"], ["orders.status"])[0]["reasons"])
    with pytest.raises(DefinitionError, match="nobody"):
        rollups.refresh(layer, "orders", "odd")
    rollups.refresh(layer, "items", "all")
    assert rows(layer.query(**asked, use_preaggregations=True, strict_rollups=True)) == rows(layer.query(**asked))
    rollups.drop(spark, "orders_preagg_m")
    rollups.drop(spark, "items_preagg_all")


# aggregates and formulas


def test_unknown_keys_are_refused():
    for kind, given in ((Metric, {"name": "m", "agg": "sum", "filterz": ["a"]}), (Model, {"name": "m", "table": "t", "metric": []})):
        with pytest.raises(DefinitionError, match="unknown key"):
            kind.of(given)
    assert Metric.of({"name": "m", "agg": "sum", "meta": {"a": 1}, "tags": ["x"]}).name == "m"


def test_more_aggregates(spark):
    spark.createDataFrame([("a", 2.0, 1, 1), ("a", 3.0, 1, 1), ("a", -4.0, 2, 2), ("b", 0.0, 5, 3), ("b", 7.0, 5, 3), ("c", None, None, 4)], "k string, x double, w int, u int").createOrReplaceTempView("t_agg")
    layer = SemanticLayer(spark)
    layer.add_model({"name": "t", "table": "t_agg", "primary_key": "u", "dimensions": [{"name": "k"}], "metrics": [
        {"name": "p", "agg": "product", "sql": "x"}, {"name": "p2", "sql": "PRODUCT(x) + 0"}, {"name": "e", "agg": "entropy", "sql": "w"}, {"name": "wa", "sql": "WEIGHTED_AVG(x, w) * 1"},
        {"name": "qc", "sql": "QUANTILE_CONT(x, 0.5)"}, {"name": "qd", "sql": "QUANTILE_DISC(x, 0.5)"}, {"name": "am", "agg": "approx_median", "sql": "x"}, {"name": "ap", "agg": "approx_percentile", "sql": "x", "percentile": 1.0},
        {"name": "once", "agg": "sum", "sql": "x", "distinct_key": "w"}, {"name": "xs", "agg": "list", "sql": "x"},
    ]})
    got = {r.k: r for r in layer.query([f"t.{m}" for m in ("p", "p2", "e", "wa", "qc", "qd", "am", "ap", "xs")], ["t.k"]).collect()}
    assert (got["a"].p, got["b"].p, got["c"].p) == (-24.0, 0.0, None) and got["a"].p2 == pytest.approx(-24) and got["b"].p2 == 0
    assert got["a"].e == pytest.approx(0.9182958340544896) and got["b"].e == got["c"].e == 0
    assert got["a"].wa == pytest.approx(-0.75) and got["b"].wa == 3.5 and got["a"].qc == 2 and got["b"].qc == 3.5 and got["b"].qd == 0 and got["a"].am == 2 and got["a"].ap == 3
    assert sorted(got["a"].xs) == [-4, 2, 3]
    # a distinct key counts once, with its smallest value
    assert rows(layer.query(["t.once"], ["t.k"])) == [("a", -2.0), ("b", 0.0), ("c", None)]


def test_formulas_over_window_metrics(shop):
    layer = shop()
    m = layer.graph.models["orders"].metrics
    m += [Metric("running", type="cumulative", sql="revenue"), Metric("change", type="time_comparison", base_metric="revenue", comparison_type="mom", calculation="difference"), Metric("left", type="derived", sql="running / 250 + coalesce(change, 0)"), Metric("odd", type="cumulative", agg="mode", sql="amount")]
    got = rows(layer.query(["orders.left"], ["orders.day__month"]))
    assert [r[-1] for r in got] == pytest.approx([100 / 250, 220 / 250 + 20, 250 / 250 - 90]) and len(got[0]) == 2
    assert set(layer.query(["orders.left", "orders.revenue", "orders.running"], ["orders.day__month"]).columns) == {"day__month", "left", "revenue", "running"}
    assert rows(layer.query(["orders.left"], ["orders.day__month"], filters=["orders.left > 20"]))[0][1] == pytest.approx(20.88)
    with pytest.raises(DefinitionError, match="window"):
        layer.query(["orders.odd"], ["orders.day__month"])


def test_cohort_filters_are_bracketed(spark):
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 4), (2, "a", 8), (2, "c", 16)], "u int, k string, v int").createOrReplaceTempView("t_cohort")
    layer = SemanticLayer(spark)
    layer.add_model({"name": "e", "table": "t_cohort", "dimensions": [{"name": "k"}], "metrics": [{"name": "c", "type": "cohort", "agg": "sum", "entity": "u", "inner_metrics": [{"name": "s", "agg": "sum", "sql": "v", "filters": ["k = 'a' OR k = 'b'", "v > 1"]}], "sql": "s"}]})
    assert rows(layer.query(["e.c"])) == [(10,)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_holds_all_base_rows(shop, spark):
    """Plans gather aggregated rows only: below a single partition stands an aggregate."""
    layer = shop()
    layer.graph.models["orders"].metrics += [Metric("latest", agg="sum", sql="amount", non_additive_dimension="day"), Metric("running", type="cumulative", sql="revenue")]
    assert rows(layer.query(["orders.latest"])) == [(30,)] and rows(layer.query(["orders.latest"], ["orders.status"])) == [("open", 30), ("paid", 50)]
    for asked in (dict(metrics=["orders.latest"]), dict(metrics=["orders.latest"], dimensions=["orders.status"]), dict(metrics=["orders.running"], dimensions=["orders.day__month"])):
        text = plan_of(layer.query(**asked))
        for piece in text.split("Exchange SinglePartition")[1:]:
            assert "HashAggregate" in piece.split("\n")[1], text


def test_planning_is_quick(shop):
    import time

    layer = shop()
    ask = lambda: layer.query(["orders.revenue"], ["customers.country"])
    ask()
    took = []
    for _ in range(9):
        start = time.perf_counter()
        ask()
        took.append(time.perf_counter() - start)
    assert sorted(took)[4] < 0.4


def test_joined_measure_views_meet_by_groups(spark):
    spark.createDataFrame([(y, r, 10 * y) for y in (1, 2) for r in ("a", "b") for _ in range(50)], "y int, r string, v int").createOrReplaceTempView("t_f1")
    spark.createDataFrame([(y, r, 1) for y in (1, 2, 3) for r in ("a", "b") for _ in range(30)], "y int, r string, w int").createOrReplaceTempView("t_f2")
    layer = SemanticLayer(spark)
    layer.sql("CREATE VIEW one AS SELECT y, r, SUM(v) AS MEASURE total FROM t_f1")
    layer.sql("CREATE VIEW two AS SELECT y, r, SUM(w) AS MEASURE back FROM t_f2")
    query = "SEMANTIC SELECT o.y, AGGREGATE(o.total) AS total, AGGREGATE(t.back) AS back FROM one o JOIN two t ON o.y = t.y"
    got = layer.sql(query)
    assert rows(got) == [(1, 1000, 60), (2, 2000, 60)]
    both = "FROM one o JOIN two t ON o.y = t.y AND o.r = t.r"
    assert rows(layer.sql(f"SEMANTIC SELECT o.y, o.r, AGGREGATE(o.total) - AGGREGATE(t.back) AS net, AGGREGATE(o.total) AT (ALL r) AS whole, AGGREGATE(t.back) AT (ALL) AS every {both}")) == [
        (1, "a", 470, 1000, 180), (1, "b", 470, 1000, 180), (2, "a", 970, 2000, 180), (2, "b", 970, 2000, 180),
    ]
    # the sides of the join are aggregated to their years first
    text = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in text.split("\n") if "Join Inner" in line]
    assert joins and all("Aggregate" in after.split("\n")[1] for after in text.split("Join Inner")[1:])
    # where joined rows are counted, they are joined
    assert rows(layer.sql("SEMANTIC SELECT o.y, COUNT(*) AS n, AGGREGATE(t.back) AS back FROM one o JOIN two t ON o.y = t.y GROUP BY o.y")) == [(1, 6000, 60), (2, 6000, 60)]


@pytest.mark.parametrize("large", [20, 1 << 17])
def test_exact_percentiles_hold_no_group(spark, monkeypatch, large):
    """Ranks are selected by cuts, whatever cuts a sketch gives, and distinct values carry no sketches."""
    from facetry.plans import exact

    monkeypatch.setattr(exact, "LARGE", large)
    values = [(k, None if i % 10 == 0 else float(i * 7919 % 1009 if k == "a" else i % 3), i % 40) for k in ("a", "b", None) for i in range(900)] + [("c", None, None), ("d", 4.0, 1), ("d", 5.0, 1)]
    spark.createDataFrame(values, "k string, x double, u int").createOrReplaceTempView("t_ranks")
    layer = SemanticLayer(spark)
    layer.add_model({"name": "t", "table": "t_ranks", "dimensions": [{"name": "k"}], "metrics": [
        {"name": "mid", "agg": "median", "sql": "x"}, {"name": "p9", "agg": "percentile", "sql": "x", "percentile": 0.9}, {"name": "q", "sql": "QUANTILE_CONT(x, 0.25) + 0"}, {"name": "d", "sql": "QUANTILE_DISC(x, 0.75)"},
        {"name": "users", "agg": "count_distinct", "sql": "u"}, {"name": "near", "agg": "approx_count_distinct", "sql": "u"}, {"name": "n", "agg": "count"},
    ]})
    names = ["mid", "p9", "q", "d", "users", "near", "n"]
    sql = "median(x), percentile(x, 0.9), percentile(x, 0.25), percentile_disc(0.75) WITHIN GROUP (ORDER BY x), count(distinct u), approx_count_distinct(u), count(1)"
    for dims, by in ((["t.k"], "k, "), ([], "")):
        out = layer.query([f"t.{m}" for m in names], dims)
        want = spark.sql(f"SELECT {by}{sql} FROM t_ranks" + " GROUP BY k" * bool(by))
        assert sorted(map(str, rows(out))) == sorted(str(tuple(r)) for r in want.collect())
        assert [f.dataType for f in out.schema] == [f.dataType for f in want.schema]
        text = out._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in text and "median(" not in text and "percentile_disc(" not in text
        assert not any("(distinct" in line and "approx_count_distinct" in line for line in text.split("\n"))
    both = layer.query(["t.mid", "t.n"], ["t.k"], with_totals=True).filter("_is_total").collect()
    assert len(both) == 1 and both[0].k is None and both[0].n == len(values) and both[0].mid == spark.sql("SELECT median(x) FROM t_ranks").first()[0]


def test_modes_and_entropies_come_from_counts(spark):
    """No task gathers a group's values; ties go to the smallest, groups without values have NULL and 0."""
    values = [("a", i % 4, 1) for i in range(8)] + [("b", 7, 1), ("b", 7, 2), ("b", 3, 3), ("c", None, 1), (None, 5, 1)]
    spark.createDataFrame(values, "k string, x int, u int").createOrReplaceTempView("t_counts")
    layer = SemanticLayer(spark)
    layer.add_model({"name": "t", "table": "t_counts", "dimensions": [{"name": "k"}], "metrics": [{"name": "m", "agg": "mode", "sql": "x"}, {"name": "e", "agg": "entropy", "sql": "x"}, {"name": "q", "sql": "QUANTILE_DISC(x, 0.5)"}, {"name": "n", "agg": "count"}]})
    out = layer.query(["t.m", "t.e", "t.q", "t.n"], ["t.k"])
    got = {r.k: (r.m, round(r.e, 6), r.q, r.n) for r in out.collect()}
    assert got == {"a": (0, 2.0, 1.0, 8), "b": (7, 0.918296, 7.0, 3), "c": (None, 0.0, None, 1), None: (5, 0.0, 5.0, 1)}
    assert rows(layer.query(["t.m", "t.n"])) == [(3, 13)]
    layer.sql("CREATE VIEW seen AS SELECT k, u, MEDIAN(x) - MIN(x) AS MEASURE gap FROM t_counts")
    measured = layer.sql("SEMANTIC SELECT k, AGGREGATE(gap) AS gap, MEDIAN(u) AS mid FROM seen GROUP BY k")
    assert rows(measured) == [("a", 1.5, 1.0), ("b", 4.0, 2.0), ("c", None, 1.0), (None, 0.0, 1.0)]
    for made in (out, measured):
        text = made._jdf.queryExecution().optimizedPlan().toString()
        assert not any(f"{held}(" in text for held in ("mode", "collect_list", "percentile", "percentile_disc", "median"))


def test_multiplied_rows_are_dealt_by_the_size_of_tables(spark, monkeypatch):
    """The rows of a fan-out are grouped in as many tasks as the tables' bytes ask for, and where sizes are small or unknown as Spark sees fit."""
    from facetry import workload
    from facetry.plans import live

    folder = "/root/testdata/sf0.001"
    dealt = lambda df: re.findall(r"RepartitionByExpression \[__d_supplier__s_suppkey#\d+L?, __k_part__p_partkey#\d+L?\], (\d+)", df._jdf.queryExecution().optimizedPlan().toString())
    ask = workload.ask(metrics=["part.parts"], dimensions=["supplier.s_suppkey"])
    small = ask(spark, folder)
    assert dealt(small) == []
    monkeypatch.setattr(live, "PIECE", 1 << 14)
    wide = ask(spark, folder)
    sizes = [os.path.getsize(f"{folder}/{t}.parquet") for t in ("part", "lineitem", "supplier")]
    assert [int(n) for n in dealt(wide)] == [sum(sizes) // (1 << 14) + 1] and int(dealt(wide)[0]) > 4
    assert rows(wide) == rows(small)
    unsized = spark.createDataFrame(wide.limit(1).collect())
    assert live.pieces(unsized) == 1
