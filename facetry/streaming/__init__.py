"""Roll-ups that follow a stream: an extension; the metric layer itself is batch.

A streaming source is aggregated into the roll-up's stored columns in event-time buckets
with a watermark; each micro-batch replaces the buckets that it changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import DefinitionError
from ..plans.live import strip_model
from ..plans.rollups import AGAIN, publish, stored, table_name


def follow(layer, model_name: str, rollup_name: str, source: DataFrame, checkpoint: str, late: str = "1 day", trigger: dict | None = None) -> StreamingQuery:
    """Keep a roll-up table current from a stream of the model's rows; rows later than ``late`` are left out."""
    model = layer.graph.model(model_name)
    rollup = next((p for p in model.pre_aggregations if p.name == rollup_name), None)
    if rollup is None or not rollup.time_dimension:
        raise DefinitionError(f"{model_name}.{rollup_name} isn't a roll-up with a time dimension")
    found, wrong = stored(layer, model, rollup)
    if wrong or any(x.agg not in AGAIN for x in found.values()):
        raise DefinitionError("only sums, counts, minima and maxima can follow a stream")
    sql = lambda name: strip_model(model.dimension(name).expression, model.name)
    bucket = f"{rollup.time_dimension}_{rollup.granularity}"
    rows = source.withColumn("__time", F.expr(sql(rollup.time_dimension))).withWatermark("__time", late)
    keys = [F.date_trunc(rollup.granularity, "__time").alias(bucket)] + [F.expr(sql(d)).alias(d) for d in rollup.dimensions]
    measures = []
    for name, leaf in found.items():
        x = strip_model(leaf.raw, model.name)
        for f in leaf.filters:
            x = f"CASE WHEN {strip_model(f, model.name)} THEN {x} END"
        measures.append(F.expr(leaf.agg.replace("{x}", x)).alias(name))
    grouped = rows.groupBy(*keys).agg(*measures)
    target = table_name(model, rollup)

    def replace_changed(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if not spark.catalog.tableExists(target):
            publish(spark, target, batch, rollup)
            return
        version = f"{target}__{uuid.uuid4().hex[:12]}"
        same = " AND ".join(f"b.`{n}` <=> o.`{n}`" for n in (bucket, *rollup.dimensions))
        publish(spark, target, batch, rollup, replaces=f"EXISTS (SELECT 1 FROM {version} b WHERE {same})", version=version)

    writer = grouped.writeStream.outputMode("update").foreachBatch(replace_changed).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
