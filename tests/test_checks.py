from facetry import SemanticLayer
from facetry.checks import run_golden, validate


def make(spark):
    spark.sql("SELECT * FROM VALUES (1, 'paid', 120.0), (2, 'paid', 80.0), (3, 'open', 50.0) AS t(id, status, amount)").createOrReplaceTempView("g_orders")
    layer = SemanticLayer(spark)
    layer.add_model({"name": "orders", "table": "g_orders", "primary_key": "id", "dimensions": [{"name": "status"}], "metrics": [{"name": "revenue", "agg": "sum", "sql": "amount"}, {"name": "n", "agg": "count"}]})
    return layer


def test_golden(spark, tmp_path):
    (tmp_path / "a.yml").write_text("""
tests:
  - {name: total, sql: SELECT orders.revenue FROM orders, expect: {value: 250.001, tolerance: 0.01}}
  - name: shape
    sql: SELECT orders.status, orders.revenue FROM orders ORDER BY orders.status
    expect: {columns: [status, revenue], row_count: 2, rows: [[open, 50.0], [paid, 200.0]]}
  - {name: wrong, query: {metrics: [orders.n]}, expect: {value: 4}}
  - {name: broken, query: {metrics: [orders.zzz]}, expect: {value: 4}}
""")
    got = run_golden(make(spark), str(tmp_path))
    assert [(o.name, o.passed) for o in got] == [("total", True), ("shape", True), ("wrong", False), ("broken", False)]


def test_validate(spark):
    layer = make(spark)
    assert validate(layer) == []
    layer.add_model({"name": "bad", "table": "g_orders", "primary_key": "nope", "dimensions": [{"name": "gone"}], "metrics": [{"name": "m", "agg": "sum", "sql": "lost"}, {"name": "r", "type": "ratio", "numerator": "m", "denominator": "nobody"}], "relationships": [{"name": "nowhere"}]})
    layer.add_model({"name": "away", "table": "no_such_table"})
    assert len(validate(layer)) == 6


def test_subqueries_in_filters(spark):
    layer = make(spark)
    q = lambda f: sorted(tuple(r) for r in layer.query(["orders.revenue"], ["orders.status"], [f]).collect())
    assert q("orders.status IN (SELECT status FROM g_orders WHERE amount < 60)") == [("open", 50)]
    assert q("EXISTS (SELECT 1 FROM g_orders o WHERE o.amount > 1000)") == []
