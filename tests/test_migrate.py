import threading

import pyarrow as pa
import pytest

from facetry import DefinitionError, Metric, SemanticLayer
from facetry.cache import ResultCache
from facetry.migrate import Migrator
from facetry.sources import export
from facetry.sources.definitions import parse_yaml


@pytest.fixture
def layer(spark):
    spark.createDataFrame([(1, 1, "done", 10.0, "2024-01-05"), (2, 1, "open", 20.0, "2024-02-05"), (3, 2, "done", 40.0, "2024-02-10")], "id int, customer_id int, status string, amount double, day string").createOrReplaceTempView("m_orders")
    spark.createDataFrame([(1, "US"), (2, "EU")], "id int, country string").createOrReplaceTempView("m_customers")
    made = SemanticLayer(spark, cache=ResultCache())
    made.add_model({"name": "customers", "table": "m_customers", "primary_key": "id", "dimensions": [{"name": "country"}]})
    made.add_model({
        "name": "orders", "table": "m_orders", "primary_key": "id", "dimensions": [{"name": "status"}, {"name": "day", "type": "time", "sql": "cast(day as date)"}],
        "metrics": [{"name": "revenue", "agg": "sum", "sql": "amount"}, {"name": "n", "agg": "count"}, {"name": "each", "type": "ratio", "numerator": "revenue", "denominator": "n"}, {"name": "net", "type": "derived", "sql": "revenue - n"}, {"name": "running", "type": "cumulative", "sql": "revenue"}],
        "relationships": [{"name": "customers", "foreign_key": "customer_id", "primary_key": "id"}], "segments": [{"name": "big", "sql": "{model}.amount > 15"}],
    })
    return made


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_covered_queries_are_rewritten(layer, spark):
    migrator = Migrator(layer)
    for sql in (
        "SELECT status, SUM(amount) AS revenue FROM m_orders WHERE status <> 'x' GROUP BY status",
        "SELECT c.country, sum(o.amount) / count(*) AS mean FROM m_orders o JOIN m_customers c ON o.customer_id = c.id GROUP BY c.country",
        "SELECT status, count(*) AS many FROM m_orders GROUP BY 1 HAVING count(*) > 1 ORDER BY status",
    ):
        found = migrator.analyse(sql)
        assert found.covered, found
        assert rows(layer.sql(found.rewritten)) == rows(spark.sql(sql)), found.rewritten


def test_what_is_missing(layer):
    report = Migrator(layer).report([
        "SELECT kind, avg(amount) AS mean FROM m_orders GROUP BY kind",
        "SELECT date_trunc('month', t) AS m, max(x) FROM other GROUP BY 1",
        "SELECT * FROM (SELECT 1) q",
        "SELECT status, count(*) FROM m_orders GROUP BY status",
    ])
    assert (report["covered"], report["queries"]) == (1, 4)
    assert "dimension m_orders.kind" in report["missing"] and any(m.startswith("metric m_orders.mean") for m in report["missing"]) and "model other" in report["missing"]
    drafts = {d.name: d for d in report["drafts"]}
    assert drafts["m_orders"].metric("mean").agg == "avg" and drafts["other"].dimension("t").granularity == "month" and drafts["other"].metrics[0].agg == "max"
    assert report["analyses"][2].reason


@pytest.mark.parametrize("dump", [export.cube, export.metricflow])
def test_exports_load_again(layer, spark, dump):
    again = SemanticLayer(spark)
    if dump is export.metricflow:
        layer.graph.models["orders"].segments = []
    parse_yaml(dump(layer)).into(again)
    ref = lambda g, n: f"orders.{n}" if g.models["orders"].metric(n) else n
    for names, dims in ((("revenue", "n", "each", "net"), ["customers.country"]), (("revenue", "running"), ["orders.day__month"])):
        own = rows(layer.query([ref(layer.graph, n) for n in names], dims))
        assert rows(again.query([ref(again.graph, n) for n in names], dims).select(*layer.query([ref(layer.graph, n) for n in names], dims).columns)) == own


def test_exports_refuse_what_they_cant_say(layer):
    layer.graph.models["orders"].metrics.append(Metric("change", type="time_comparison", base_metric="revenue"))
    for dump in (export.cube, export.metricflow):
        with pytest.raises(DefinitionError, match="change"):
            dump(layer)


def test_cached_results(layer, spark):
    first = layer.table(metrics=["orders.revenue"])
    assert layer.table(metrics=["orders.revenue"]) is first and layer.cache.hits == 1
    assert layer.table(metrics=["orders.revenue"], user_attributes={"a": 1}) is not first
    layer.graph.models["orders"].metric("revenue").filters = ["status = 'done'"]
    assert layer.table(metrics=["orders.revenue"]).to_pylist() == [{"revenue": 50.0}]


def test_cache_bounds_and_sharing():
    now = [0.0]
    cache = ResultCache(max_bytes=100, ttl=10, clock=lambda: now[0])
    table = lambda n: pa.table({"x": pa.array(range(n), pa.int64())})
    cache.get("a", lambda: table(5))
    cache.get("b", lambda: table(5))
    cache.get("a", lambda: table(0))
    cache.get("c", lambda: table(5))  # b is the oldest in use
    assert list(cache._kept) == ["a", "c"] and cache.bytes == 80
    cache.get("huge", lambda: table(1000))
    assert "huge" not in cache._kept
    now[0] = 11
    assert cache.get("a", lambda: table(1)).num_rows == 1
    with pytest.raises(KeyError):
        cache.get("bad", lambda: {}["x"])
    assert cache.get("bad", lambda: table(2)).num_rows == 2
    calls, gate = [], threading.Event()

    def slow():
        calls.append(1)
        gate.wait(5)
        return table(3)

    got = []
    threads = [threading.Thread(target=lambda: got.append(cache.get("s", slow))) for _ in range(4)]
    for t in threads:
        t.start()
    while not calls:
        pass
    gate.set()
    for t in threads:
        t.join()
    assert len(calls) == 1 and len(got) == 4 and len({id(x) for x in got}) == 1
