"""Readers and writers as queries: tables are written in a format and read again from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.plans.customers import SNAPSHOT_CUSTOMERS, customers
from wayfold.runtime import scratch, table
from wayfold.sources import files as S

QUERIES: dict = {}
SQL: dict[str, str] = {}
_PLAIN = ["crid", "name", "address", "city", "state", "zip", "status"]
_BLANK = "case when lower(trim({0})) in ('', 'null', 'none', 'n/a', 'na') then null else trim({0}) end as {0}"
_CLEAN = f"with {SNAPSHOT_CUSTOMERS} select " + ", ".join(_BLANK.format(c) for c in _PLAIN) + " from customers"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(_CLEAN)
def read_delimited(spark, d):
    """Customers written with bars between the fields and read by the separator found."""
    path = scratch(spark, "bars") + ".csv"
    customers(spark, d).select(*_PLAIN).write.csv(path, header=True, sep="|", escape='"')
    return S.read_any(spark, path).select(*_PLAIN)


@query(_CLEAN)
def read_json_lines(spark, d):
    path = scratch(spark, "lines") + ".jsonl"
    S.write_json(customers(spark, d).select(*_PLAIN), path)
    return S.read_any(spark, path).select(*_PLAIN)


@query(_CLEAN)
def read_csv_export(spark, d):
    """The CSV export, its columns in sorted order, read again."""
    path = scratch(spark, "export") + ".csv"
    S.write_csv(customers(spark, d).select(*_PLAIN), path)
    return S.read_any(spark, path).select(*_PLAIN)


@query(f"with {SNAPSHOT_CUSTOMERS} select crid, city, state from customers where state = 'NJ'")
def read_partitioned(spark, d):
    """A table partitioned by state, read with a filter that prunes folders."""
    path = scratch(spark, "states")
    S.write_table(customers(spark, d).where("state is not null").select("crid", "city", "state"), path, ["state"])
    return spark.read.parquet(path).where("state = 'NJ'").select("crid", "city", "state")


@query("select vec_id::varchar as source_id, embedding::float[] as embedding from embeddings where embedding is not null")
def read_vectors(spark, d):
    """Vectors in the binary form, a file a part of the table."""
    e = table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").cast("string").alias("source_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    path = scratch(spark, "vectors") + ".vec"
    S.write_vectors(e, path)
    return S.read_any(spark, path)


@query(f"with {SNAPSHOT_CUSTOMERS} select crid as source_id, concat_ws(', ', nullif(trim(address), ''), nullif(trim(city), ''), nullif(trim(state), ''), nullif(trim(zip), '')) as raw_address from customers where crid > 'CRID-000100'")
def ingest_batch(spark: SparkSession, d: str) -> DataFrame:
    """Records to ingest, gone on with after a checkpoint."""
    return S.address_batch(customers(spark, d).select("crid", "address", "city", "state", "zip"), after="CRID-000100").select("source_id", "raw_address")
