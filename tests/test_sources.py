import json

import pytest

from facetry import DefinitionError, SemanticLayer
from facetry.sources import definitions as D
from facetry.sources import files


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,b\n")
    (tmp_path / "b-1.jsonl").write_text('{"x": 2}\n{"x": 3}\n')
    (tmp_path / "c.tsv").write_text("x\ty\n1\t2\n")
    (tmp_path / "d.json").write_text(json.dumps([{"x": 5}]))
    spark.range(4).write.parquet(str(tmp_path / "e.parquet"))
    (tmp_path / "notes.txt").write_text("no data")
    found = files.discover(spark, str(tmp_path))
    assert sorted(files.file_views(spark, found)) == ["a", "b_1", "c", "d", "e"]
    assert spark.sql("SELECT sum(x) FROM b_1").first()[0] == 5 and spark.table("e").count() == 4
    with pytest.raises(DefinitionError):
        files.file_views(spark, ["x/a.csv", "y/a.tsv"])
    out = spark.sql("SELECT 1 AS one, 'b' AS two")
    for kind in ("parquet", "csv", "jsonl"):
        files.write_result(out, str(tmp_path / f"out_{kind}"), kind)
    assert json.loads(files.json_rows(out)[0]) == {"one": 1, "two": "b"} and files.arrow_stream(out)
    assert files.unpivot_source(spark, "c", [], ["x", "y"], "n", "v", "long").count() == 2
    assert files.union_source(spark, ["a", "d"], "both").count() == 2


def test_connections():
    assert files.connection("postgres://u:p@h:5/db") == {"format": "jdbc", "url": "jdbc:postgresql://h:5/db", "user": "u", "password": "p"}
    assert files.connection({"type": "clickhouse", "host": "h", "database": "d"})["url"] == "jdbc:clickhouse://h/d"
    assert files.connection("spark://h:1/db") == {}
    with pytest.raises(DefinitionError):
        files.connection("ftp://x")


NATIVE = """
version: 1
models:
  - name: orders
    table: n_orders
    primary_key: id
    dimensions:
      - {name: status, expr: state}
      - {name: customer_id, type: numeric}
    measures:
      - {name: total, agg: sum, expr: amount}
      - {name: each, type: derived, measure: 'total / NULLIF(n, 0)'}
    sql_metrics: |
      METRIC (name n, agg count);
    sql_segments: |
      SEGMENT (name big, sql {model}.amount >= 5);
  - name: customers
    table: n_customers
    primary_key: id
    dimensions: [{name: country}]
"""


@pytest.fixture(scope="module")
def tables(spark):
    spark.createDataFrame([(1, "a", 4, 1), (2, "a", 6, 2)], "id int, state string, amount int, customer_id int").createOrReplaceTempView("n_orders")
    spark.createDataFrame([(1, "US"), (2, "EU")], "id int, country string").createOrReplaceTempView("n_customers")


def loaded(spark, found):
    layer = SemanticLayer(spark)
    found.into(layer)
    return layer


def test_native_yaml_round_trip(spark, tables):
    found = D.parse_yaml(NATIVE)
    D.infer_relationships(found.models)
    layer = loaded(spark, found)
    again = loaded(spark, D.parse_yaml(D.dump(layer)))
    for each in (layer, again):
        assert [tuple(r) for r in each.query(["orders.total", "orders.each"], ["orders.status"], segments=["orders.big"]).collect()] == [("a", 6, 6.0)]
        assert sorted(tuple(r) for r in each.query(["orders.total"], ["customers.country"]).collect()) == [("EU", 6), ("US", 4)]


@pytest.mark.parametrize("text", [
    "MODEL (name orders, table n_orders, primary_key id);\nDIMENSION (name status, type categorical, sql state);\nMETRIC (name total, agg sum, sql amount);\nSEGMENT (name big, sql {model}.amount >= 5);",
    "model orders from n_orders (\n  primary key (id)\n  state as status\n  sum(amount) as total\n)",
    "---\nname: orders\ntable: n_orders\nprimary_key: id\ndimensions:\n  - {name: status, sql: state}\n---\nMETRIC (name total, sql SUM(amount));",
])
def test_ddl(spark, tables, text):
    layer = loaded(spark, D.parse_sql(text))
    assert [tuple(r) for r in layer.query(["orders.total"], ["orders.status"]).collect()] == [("a", 10)]


OTHERS = {
    "cube": ("{cubes: [{name: orders, sql_table: n_orders, dimensions: [{name: id, sql: '{CUBE}.id', type: number, primary_key: true}, {name: status, sql: '{CUBE}.state', type: string}], measures: [{name: total, sql: amount, type: sum}, {name: big, sql: amount, type: sum, filters: [{sql: '{CUBE}.amount > 5'}]}], joins: [{name: customers, sql: '{CUBE}.customer_id = {customers}.id', relationship: many_to_one}]}, {name: customers, sql_table: n_customers, dimensions: [{name: id, type: number, primary_key: true}, {name: country, type: string}]}]}", ["orders.total", "orders.big"], ["customers.country"], [("EU", 6, 6), ("US", 4, None)]),
    "metricflow": ("{semantic_models: [{name: orders, model: \"ref('n_orders')\", entities: [{name: order, type: primary, expr: id}, {name: customer, type: foreign, expr: customer_id}], dimensions: [{name: state, type: categorical}], measures: [{name: total, agg: sum, expr: amount}, {name: n, agg: count, expr: '1'}]}, {name: customers, model: \"ref('n_customers')\", entities: [{name: customer, type: primary, expr: id}], dimensions: [{name: country, type: categorical}]}], metrics: [{name: each, type: ratio, type_params: {numerator: total, denominator: n}}]}", ["orders.total", "each"], ["customers.country"], [("EU", 6, 6.0), ("US", 4, 4.0)]),
    "rill": ("{type: metrics_view, model: n_orders, dimensions: [{name: state, column: state}], measures: [{name: total, expression: sum(amount)}]}", ["n_orders.total"], ["n_orders.state"], [("a", 10)]),
    "superset": ("{table_name: n_orders, columns: [{column_name: state, type: VARCHAR}], metrics: [{metric_name: total, expression: SUM(amount)}]}", ["n_orders.total"], ["n_orders.state"], [("a", 10)]),
    "snowflake": ("{tables: [{name: orders, base_table: {table: n_orders}, primary_key: {columns: [id]}, dimensions: [{name: state, expr: state, data_type: varchar}], measures: [{name: total, expr: amount, default_aggregation: sum}]}, {name: customers, base_table: {table: n_customers}, primary_key: {columns: [id]}, dimensions: [{name: country, expr: country, data_type: varchar}]}], relationships: [{left_table: orders, right_table: customers, relationship_columns: [{left_column: customer_id, right_column: id}]}]}", ["orders.total"], ["customers.country"], [("EU", 6), ("US", 4)]),
    "expressions": ("{orders: {table: n_orders, dimensions: {state: _.state}, measures: {total: _.amount.sum(), each: {expr: _.amount.sum() / _.count()}}, joins: {customers: {model: customers, type: one, left_on: customer_id, right_on: id}}}, customers: {table: n_customers, primary_key: id, dimensions: {country: _.country}, measures: {}}}", ["orders.total", "orders.each"], ["customers.country"], [("EU", 6, 6.0), ("US", 4, 4.0)]),
    "hex": ("{id: orders, base_sql_table: n_orders, dimensions: [{id: id, type: number, unique: true}, {id: state, type: string}], measures: [{id: total, func: sum, of: amount}]}", ["orders.total"], ["orders.state"], [("a", 10)]),
}


@pytest.mark.parametrize("name", OTHERS)
def test_other_formats(spark, tables, name):
    text, metrics, dimensions, want = OTHERS[name]
    assert sorted((tuple(r) for r in loaded(spark, D.parse_yaml(text)).query(metrics, dimensions).collect()), key=str) == want


def test_lookml(spark, tables):
    text = """
view: orders {
  sql_table_name: n_orders ;;
  dimension: id { primary_key: yes type: number sql: ${TABLE}.id ;; }
  dimension: customer_id { type: number sql: ${TABLE}.customer_id ;; }
  dimension: state { type: string }  # plain
  measure: total { type: sum sql: ${TABLE}.amount ;; filters: [state: "a, b"] }
  measure: n { type: count }
  measure: each { type: number sql: ${total} / ${n} ;; }
  measure: large { type: count filters: [id: ">1"] }
}
view: customers {
  sql_table_name: n_customers ;;
  dimension: id { primary_key: yes sql: ${TABLE}.id ;; }
  dimension: country {}
}
explore: orders { join: customers { relationship: many_to_one sql_on: ${orders.customer_id} = ${customers.id} ;; } }
"""
    layer = loaded(spark, D.lookml(text))
    got = sorted(tuple(r) for r in layer.query(["orders.total", "orders.each", "orders.large"], ["customers.country"]).collect())
    assert got == [("EU", 6, 6.0, 1), ("US", 4, 4.0, 0)]


def test_folder(spark, tables, tmp_path):
    (tmp_path / "a.yml").write_text(NATIVE)
    (tmp_path / "b.sql").write_text("METRIC (name twice, type derived, sql orders.total * 2);")
    layer = loaded(spark, D.load(str(tmp_path)))
    assert layer.query(["twice"]).first()[0] == 20


def test_stream_follows_rollup(spark, tmp_path):
    from facetry.plans import rollups
    from facetry.streaming import follow

    rows = [(1, "a", "2024-01-05", 5), (2, "a", "2024-01-06", 6), (3, "b", "2024-02-01", 7)]
    make = lambda r: spark.createDataFrame(r, "id int, k string, d string, v int").selectExpr("id", "k", "cast(d as timestamp) AS t", "v")
    make(rows[:2]).write.parquet(str(tmp_path / "in"))
    layer = SemanticLayer(spark)
    layer.add_model({"name": "s", "source_uri": str(tmp_path / "in"), "source_format": "parquet", "primary_key": "id", "dimensions": [{"name": "k"}, {"name": "t", "type": "time"}], "metrics": [{"name": "total", "agg": "sum", "sql": "v"}], "pre_aggregations": [{"name": "m", "measures": ["total"], "dimensions": ["k"], "time_dimension": "t", "granularity": "month"}]})
    for more in ([], rows[2:] + [(4, "a", "2024-01-20", 1)]):
        if more:
            make(more).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id int, k string, t timestamp, v int").parquet(str(tmp_path / "in"))
        follow(layer, "s", "m", stream, str(tmp_path / "check"), late="60 days").awaitTermination()
        asked = dict(metrics=["s.total"], dimensions=["s.k", "s.t__month"])
        get = lambda **o: sorted(map(tuple, layer.query(**asked, **o).collect()))
        assert get(use_preaggregations=True, strict_rollups=True) == get()
    assert rollups.explain(layer, ["s.total"], ["s.k"])[0]["usable"]
    rollups.drop(spark, "s_preagg_m")
