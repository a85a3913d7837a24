"""Every further definition format: a small file each, loaded and queried."""

import json

import pytest

from facetry import DefinitionError, SemanticLayer
from facetry.sources.definitions import load


@pytest.fixture(scope="module", autouse=True)
def tables(spark):
    spark.createDataFrame([(1, 1, "done", 10.0, "2024-01-05"), (2, 1, "open", 20.0, "2024-02-05"), (3, 2, "done", 40.0, "2024-02-10")], "id int, customer_id int, status string, amount double, day string").createOrReplaceTempView("f_orders")
    spark.createDataFrame([(1, "US"), (2, "EU")], "id int, country string").createOrReplaceTempView("f_customers")


def asked(spark, path, metrics, dimensions=("f_customers.country",)):
    layer = SemanticLayer(spark)
    found = load(str(path))
    found.into(layer)
    return sorted(tuple(r) for r in layer.query(list(metrics), list(dimensions)).collect()), found


def write(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / name.replace("__", ".")).write_text(text)
    return tmp_path


BY_COUNTRY = [("EU", 40.0, 1), ("US", 30.0, 2)]

OSI = """
version: "0.2"
semantic_model:
  - name: shop
    datasets:
      - name: f_orders
        source: f_orders
        primary_key: [id]
        fields:
          - {name: status, expression: {dialects: [{dialect: ANSI_SQL, expression: status}]}}
      - name: f_customers
        source: f_customers
        primary_key: [id]
        fields:
          - {name: country, expression: {dialects: [{dialect: ANSI_SQL, expression: country}]}}
    relationships:
      - {name: r, from: f_orders, to: f_customers, from_columns: [customer_id], to_columns: [id]}
    metrics:
      - {name: revenue, expression: {dialects: [{dialect: ANSI_SQL, expression: SUM(f_orders.amount)}]}}
      - {name: n, expression: {dialects: [{dialect: ANSI_SQL, expression: COUNT(f_orders.id)}]}}
      - {name: each, expression: {dialects: [{dialect: ANSI_SQL, expression: SUM(f_orders.amount) / COUNT(DISTINCT f_customers.id)}]}}
"""


def test_osi(spark, tmp_path):
    path = write(tmp_path, osi__yaml=OSI) / "osi.yaml"
    assert asked(spark, path, ["f_orders.revenue", "f_orders.n"])[0] == BY_COUNTRY
    assert asked(spark, path, ["each"])[0] == [("EU", 40.0), ("US", 30.0)]


def test_omni(spark, tmp_path):
    orders = """
name: f_orders
schema: default
sql: SELECT * FROM f_orders
dimensions:
  id: {primary_key: true, sql: "${TABLE}.id"}
  status: {sql: "${TABLE}.status"}
measures:
  revenue: {aggregate_type: sum, sql: "${f_orders.amount}"}
  n: {aggregate_type: count}
  done: {aggregate_type: sum, sql: "${TABLE}.amount", filters: {status: {is: done}}}
  each: {sql: "${revenue} / ${n}"}
  odd: {aggregate_type: mystery, sql: amount}
"""
    customers = "name: f_customers\nschema: default\nsql: SELECT * FROM f_customers\ndimensions:\n  id: {primary_key: true}\n  country: {}\n"
    model = "relationships:\n  - {join_from_view: f_orders, join_to_view: f_customers, on_sql: '${f_orders.customer_id} = ${f_customers.id}', relationship_type: many_to_one}\n"
    write(tmp_path, orders__yaml=orders, customers__yaml=customers, model__yaml=model)
    got, found = asked(spark, tmp_path, ["f_orders.revenue", "f_orders.n"])
    assert got == BY_COUNTRY and len(found.unsupported) == 1 and "odd" in found.unsupported[0]
    assert asked(spark, tmp_path, ["f_orders.done", "f_orders.each"])[0] == [("EU", 40.0, 40.0), ("US", 10.0, 15.0)]


def test_tableau(spark, tmp_path):
    text = """<datasource formatted-name='shop'><connection class='x'>
    <relation type='join' join='left'><clause type='join'><expression op='='><expression op='[f_orders].[customer_id]' /><expression op='[c].[cid]' /></expression></clause>
      <relation type='table' name='f_orders' table='[f_orders]' />
      <relation type='text' name='c'>SELECT id AS cid, country FROM f_customers</relation></relation></connection>
  <column name='[country]' role='dimension' datatype='string' />
  <column name='[amount]' role='measure' datatype='real' aggregation='sum' />
  <column name='[Calculation_1]' caption='Per Order' role='measure' datatype='real'><calculation formula='SUM([amount]) / COUNTD([id])' /></column>
  <column name='[size]' role='dimension' datatype='string'><calculation formula='IF [amount] &gt; 15 THEN "large" ELSE "small" END' /></column>
  <column name='[lod]' role='measure' datatype='real'><calculation formula='{FIXED [country] : SUM([amount])}' /></column></datasource>"""
    got, found = asked(spark, write(tmp_path, s__tds=text) / "s.tds", ["shop.amount", "shop.Per_Order"], ["shop.country"])
    assert got == [("EU", 40.0, 40.0), ("US", 30.0, 15.0)] and "lod" in found.unsupported[0]
    assert asked(spark, tmp_path / "s.tds", ["shop.amount"], ["shop.size"])[0] == [("large", 60.0), ("small", 10.0)]


def test_tml(spark, tmp_path):
    text = """
guid: g
model:
  name: m
  model_tables:
    - name: f_orders
      joins:
        - {with: f_customers, on: "[f_orders::customer_id] = [f_customers::id]", cardinality: MANY_TO_ONE}
    - name: f_customers
  formulas:
    - {id: double, name: twice, expr: "[f_orders::amount] * 2"}
  columns:
    - {name: country, column_id: f_customers::country, properties: {column_type: ATTRIBUTE}}
    - {name: revenue, column_id: f_orders::amount, properties: {column_type: MEASURE, aggregation: SUM}}
    - {name: n, column_id: f_orders::id, properties: {column_type: MEASURE, aggregation: COUNT}}
    - {name: twice, formula_id: double, properties: {column_type: MEASURE, aggregation: MAX}}
"""
    path = write(tmp_path, m__tml=text) / "m.tml"
    layer = SemanticLayer(spark)
    found = load(str(path))
    found.models[1].primary_key = "id"
    found.into(layer)
    assert sorted(tuple(r) for r in layer.query(["f_orders.revenue", "f_orders.n", "f_orders.twice"], ["f_customers.country"]).collect()) == [("EU", 40.0, 1, 80.0), ("US", 30.0, 2, 40.0)]


def test_ldm(spark, tmp_path):
    data = {"ldm": {"datasets": [
        {"id": "f_customers", "grain": [{"id": "cust", "type": "attribute"}], "attributes": [{"id": "cust", "sourceColumn": "id"}, {"id": "country", "sourceColumn": "country"}]},
        {"id": "f_orders", "dataSourceTableId": "f_orders", "grain": [{"id": "id", "type": "attribute"}], "attributes": [{"id": "id", "sourceColumn": "id"}], "facts": [{"id": "amount", "sourceColumn": "amount"}],
         "references": [{"identifier": {"id": "f_customers"}, "sourceColumns": ["customer_id"]}, {"identifier": {"id": "day_instance"}, "sourceColumns": ["day"]}]},
    ], "dateInstances": []}}
    got, found = asked(spark, write(tmp_path, l__json=json.dumps(data)) / "l.json", ["f_orders.amount"])
    assert got == [("EU", 40.0), ("US", 30.0)] and found.models[1].dimension("day").type == "time"


def test_sml(spark, tmp_path):
    write(
        tmp_path,
        a__yml="unique_name: f_orders\nobject_type: dataset\ntable: f_orders\ncolumns: [{name: amount, data_type: double}]\n",
        b__yml="unique_name: f_customers\nobject_type: dataset\ntable: f_customers\ncolumns: [{name: country, data_type: string}]\n",
        c__yml="unique_name: who\nobject_type: dimension\nlevel_attributes: [{unique_name: cid, dataset: f_customers, name_column: id, key_columns: [id]}, {unique_name: country, dataset: f_customers, name_column: country}]\n",
        d__yml="unique_name: m\nobject_type: model\nrelationships: [{from: {dataset: f_orders, join_columns: [customer_id]}, to: {dimension: who, level: cid}}]\n",
        e__yml="unique_name: revenue\nobject_type: metric\ncalculation_method: sum\ndataset: f_orders\ncolumn: amount\n",
        f__yml="unique_name: n\nobject_type: metric\ncalculation_method: count non-null\ndataset: f_orders\ncolumn: id\n",
        g__yml='unique_name: each\nobject_type: metric_calc\nexpression: "[Measures].[revenue] / [Measures].[n]"\n',
        h__yml='unique_name: odd\nobject_type: metric_calc\nexpression: "ParallelPeriod([x])"\n',
    )
    got, found = asked(spark, tmp_path, ["f_orders.revenue", "f_orders.n"])
    assert got == BY_COUNTRY and "odd" in found.unsupported[0]
    assert asked(spark, tmp_path, ["each"])[0] == [("EU", 40.0), ("US", 15.0)]


def test_aml(spark, tmp_path):
    text = """
Model f_orders {
  type: 'table'
  table_name: 'f_orders'
  dimension id { type: 'number' primary_key: true }
  dimension big { type: 'truefalse' definition: @sql {{ #SOURCE.amount }} > 15;; }
  measure revenue { type: 'number' definition: @sql {{ amount }};; aggregation_type: 'sum' }
  measure n { definition: @sql {{ id }};; aggregation_type: 'count' }
  measure each { definition: @sql {{ revenue }} / NULLIF({{ n }}, 0);; aggregation_type: 'custom' }
  measure odd { definition: @aql f_orders | count();; aggregation_type: 'custom' }
}
Model f_customers { type: 'table' table_name: 'f_customers' dimension id { primary_key: true } dimension country { type: 'text' } }
Relationship r { type: 'many_to_one' from: r(f_orders.customer_id) to: r(f_customers.id) }
Dataset d { models: [f_orders, f_customers] relationships: [ relationship(r, true), rel(rel_expr: f_orders.id > f_customers.id, active: false) ] }
"""
    got, found = asked(spark, write(tmp_path, m__aml=text), ["f_orders.revenue", "f_orders.n"])
    assert got == BY_COUNTRY
    assert asked(spark, tmp_path / "m.aml", ["f_orders.each"])[0] == [("EU", 40.0), ("US", 15.0)]


def test_gsql(spark, tmp_path):
    text = """
table f_orders (
  id INT64
  customer_id INT64
  status STRING -- of 'done', 'open'
  amount FLOAT64 #currency=USD

  join one f_customers on customer_id = f_customers.id
  is_done: status = 'done'
  revenue: sum(amount)
  count(id) as n
  done: sum(case when is_done then amount else 0 end)
  each: revenue / n #ratio
)
table f_customers (
  id INT64
  country STRING
)
"""
    path = write(tmp_path, s__gsql=text) / "s.gsql"
    assert asked(spark, path, ["f_orders.revenue", "f_orders.n"])[0] == BY_COUNTRY
    assert asked(spark, path, ["f_orders.done", "f_orders.each"])[0] == [("EU", 40.0, 40.0), ("US", 10.0, 15.0)]
    assert asked(spark, path, ["f_orders.n"], ["f_orders.is_done"])[0] == [(False, 1), (True, 2)]


def test_tmdl(spark, tmp_path):
    text = """
table f_orders
    column id
        dataType: int64
        isKey
        sourceColumn: id
    column 'Customer Key'
        dataType: int64
        sourceColumn: customer_id
    column Amount
        dataType: double
        sourceColumn: amount
    measure Revenue = SUM('f_orders'[Amount])
        formatString: "0"
    measure n = COUNTROWS('f_orders')
    measure Each =
        DIVIDE([Revenue], [n], 0)
    measure LY = CALCULATE([Revenue], SAMEPERIODLASTYEAR('f_orders'[Amount]))
table f_customers
    column id
        dataType: int64
        isKey
        sourceColumn: id
    column country
        dataType: string
        sourceColumn: country
relationship r
    fromColumn: f_orders.'Customer Key'
    toColumn: f_customers.id
"""
    path = write(tmp_path, m__tmdl=text) / "m.tmdl"
    got, found = asked(spark, path, ["f_orders.Revenue", "f_orders.n"])
    assert got == BY_COUNTRY and "LY" in found.unsupported[0]
    assert asked(spark, path, ["f_orders.Each"])[0] == [("EU", 40.0), ("US", 15.0)]


def test_malloy(spark, tmp_path):
    text = """
// shop
source: f_orders is duckdb.table('f_orders') extend {
  primary_key: id
  dimension:
    size is pick 'small' when amount < 15 else 'large'
    month is day::date
  measure:
    n is count()
    revenue is amount.sum()
    done is sum(amount) { where: status = 'done' }
    buyers is count(distinct customer_id)
    each is revenue / n
    odd is all(revenue)
  join_one: buyer is f_customers with customer_id
}
source: f_customers is duckdb.table('f_customers') extend {
  primary_key: id
  dimension: country is country
}
"""
    path = write(tmp_path, s__malloy=text) / "s.malloy"
    got, found = asked(spark, path, ["f_orders.revenue", "f_orders.n"], ["buyer.country"])
    assert got == BY_COUNTRY and "odd" in found.unsupported[0]
    assert asked(spark, path, ["f_orders.done", "f_orders.buyers", "f_orders.each"], ["f_orders.size"])[0] == [("large", 40.0, 2, 30.0), ("small", 10.0, 1, 10.0)]
    with pytest.raises(DefinitionError, match="no metric"):
        asked(spark, path, ["f_orders.odd"])
