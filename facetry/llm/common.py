"""What the operators of this subpackage share: text rules, Arrow plumbing and
tables that are written to the cluster's shared folder to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space of the contracts: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Lower-cases A-Z in UTF-8 and leaves every other byte.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in local mode is a temporary
    folder taken (and set as the checkpoint folder)."""
    context = spark.sparkContext
    set_dir = context._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(own)
    return own


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps read the files, so a lost executor costs no recomputation and
    nothing is computed twice."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def arrow_type(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_batches(
    df: DataFrame, schema: str | T.StructType, function: Callable[[pa.RecordBatch], dict | Iterable[dict]], piece_rows: int = 1024
) -> DataFrame:
    """``mapInArrow`` where ``function`` gives columns for a slice of at most
    ``piece_rows`` rows, which bounds what Python holds at a time."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = arrow_type(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, piece_rows):
                got = function(batch.slice(start, piece_rows))
                for columns in [got] if isinstance(got, dict) else got:
                    yield pa.RecordBatch.from_arrays(
                        [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type, from_pandas=False) for f in out],
                        schema=out,
                    )

    return df.mapInArrow(run, schema)


#: Groups of equal rows are looked up by broadcast up to so many (about 60 bytes each).
BROADCAST_GROUPS = 1_000_000


def number_repeats(rows: DataFrame, by: list[str], least: Column | None = None) -> DataFrame:
    """``rows`` with ``__nth``: 0, 1, ... among the rows that agree in ``by`` (null agrees with null).
    With ``least``, an aggregate, only groups for which it holds are numbered; others have 0.

    Which of the equal rows has which number is open, the numbers are not. Rows that don't
    repeat stay where they are. Of a group of any size, each task numbers what lies in its own
    part of the table, after those that lie in parts before: nothing gathers a group."""
    counted = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.count(F.lit(1)).alias("__n"), (F.lit(True) if least is None else least).alias("__least"))
    groups = settle(counted.filter("__n > 1 AND __least").drop("__n", "__least"), "groups")
    n = groups.count()
    if n == 0:
        return rows.withColumn("__nth", F.lit(0).cast("long"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    shown = F.broadcast(groups) if n <= BROADCAST_GROUPS else groups
    single = rows.join(shown, same, "left_anti").withColumn("__nth", F.lit(0).cast("long"))
    repeated = rows.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()})
    repeated = settle(repeated.join(shown, same, "left_semi"), "repeated")
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = repeated.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    parts = parts.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*by, "__part").orderBy("__place")) - 1
    numbered = repeated.withColumn("__inside", inside).join(parts, [*same, F.col("__part") == F.col("__of")])
    return single.unionByName(numbered.select(*rows.columns, (F.col("__before") + F.col("__inside")).alias("__nth")))


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
