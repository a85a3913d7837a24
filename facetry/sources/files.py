"""Data files as views, databases by URL, and results to files."""

from __future__ import annotations

import re
from pathlib import PurePosixPath
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession

from ..model import DefinitionError

#: Extension -> reader format and options.
FORMATS = {
    ".parquet": ("parquet", {}),
    ".csv": ("csv", {"header": "true", "inferSchema": "true"}),
    ".tsv": ("csv", {"header": "true", "inferSchema": "true", "sep": "\t"}),
    ".json": ("json", {"multiLine": "true"}),
    ".jsonl": ("json", {}),
    ".ndjson": ("json", {}),
    ".orc": ("orc", {}),
}
#: URL scheme -> JDBC subprotocol or connector format.
SCHEMES = {
    "postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "clickhouse": "clickhouse", "duckdb": "duckdb",
    "snowflake": "net.snowflake.spark.snowflake", "bigquery": "bigquery",
}
NATIVE = ("spark", "databricks", "local")


def view_name(path: str) -> str:
    name = re.sub(r"\W", "_", PurePosixPath(path).stem)
    return f"_{name}" if name[:1].isdigit() else name


def read_file(spark: SparkSession, path: str) -> DataFrame:
    kind = FORMATS.get(PurePosixPath(path).suffix.lower())
    if kind is None:
        raise DefinitionError(f"{path}: unknown file type; known are {', '.join(FORMATS)}")
    return spark.read.format(kind[0]).options(**kind[1]).load(path)


def file_views(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """A temporary view for each file; view name -> path. Two files of one name are an error."""
    named: dict[str, str] = {}
    for path in paths:
        name = view_name(path)
        if name in named:
            raise DefinitionError(f"{path} and {named[name]} would both be the view {name}")
        named[name] = path
    for name, path in named.items():
        read_file(spark, path).createOrReplaceTempView(name)
    return named


def discover(spark: SparkSession, folder: str) -> list[str]:
    """Data files in a folder of any store that Spark reads, by name."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [s.getPath().toString() for s in found]
    return sorted(n for n in names if PurePosixPath(n).suffix.lower() in FORMATS)


def connection(url: str | dict) -> dict[str, str]:
    """Reader options for a database URL, or for a dictionary with ``type`` and its parts.

    JDBC databases need their driver on the class path. ``spark://``, ``databricks://`` and
    ``local://`` mean the session itself and give no options."""
    if isinstance(url, dict):
        given = dict(url)
        kind = given.pop("type")
        host, port = given.pop("host", ""), given.pop("port", None)
        login = f"{given.pop('user')}:{given.pop('password', '')}@" if "user" in given else ""
        url = f"{kind}://{login}{host}{f':{port}' if port else ''}/{given.pop('database', '')}" + (f"?{'&'.join(f'{k}={v}' for k, v in given.items())}" if given else "")
    parts = urlsplit(url)
    scheme = parts.scheme.removeprefix("adbc+")
    if scheme in NATIVE:
        return {}
    if scheme not in SCHEMES:
        raise DefinitionError(f"{url}: unknown scheme; known are {', '.join([*SCHEMES, *NATIVE])}")
    target, more = SCHEMES[scheme], dict(parse_qsl(parts.query))
    if scheme in ("snowflake", "bigquery"):
        return {"format": target, "sfURL" if scheme == "snowflake" else "parentProject": parts.netloc.split("@")[-1], **more}
    host = parts.netloc.split("@")[-1]
    options = {"format": "jdbc", "url": f"jdbc:{target}:{parts.path.lstrip('/')}" if scheme == "duckdb" else f"jdbc:{target}://{host}{parts.path}", **more}
    if parts.username:
        options |= {"user": parts.username, "password": parts.password or ""}
    return options


def read_table(spark: SparkSession, url: str | dict, table: str, **options: str) -> DataFrame:
    """A table of a database. For parallel reads of JDBC give partitionColumn, lowerBound, upperBound, numPartitions."""
    found = connection(url)
    if not found:
        return spark.table(table)
    kind = found.pop("format")
    return spark.read.format(kind).options(**found).option("dbtable", table).options(**options).load()


def write_result(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    """A result as parquet, csv, json, jsonl or orc files."""
    kind = {"jsonl": "json"}.get(kind, kind)
    if kind not in ("parquet", "csv", "json", "orc"):
        raise DefinitionError(f"unknown output {kind}")
    writer = df.write.mode(mode)
    (writer.option("header", "true") if kind == "csv" else writer).format(kind).save(path)


def json_rows(df: DataFrame) -> list[str]:
    """Rows of a small result as JSON texts."""
    return df.toJSON().collect()


def arrow_stream(df: DataFrame) -> bytes:
    """A small result as an Arrow IPC stream."""
    import pyarrow as pa

    table = df.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def union_source(spark: SparkSession, tables: list[str], name: str) -> DataFrame:
    """UNION ALL of tables by column name, missing columns NULL, as a view."""
    out = spark.table(tables[0])
    for table in tables[1:]:
        out = out.unionByName(spark.table(table), allowMissingColumns=True)
    out.createOrReplaceTempView(name)
    return out


def unpivot_source(spark: SparkSession, table: str, keys: list[str], columns: list[str], name_column: str, value_column: str, name: str) -> DataFrame:
    """A wide table as key, name, value rows, as a view."""
    out = spark.table(table).unpivot(keys, columns, name_column, value_column)
    out.createOrReplaceTempView(name)
    return out
