"""S4 ``scan_catalog``: workflow / agent / knowledge-base listings.

``read_catalog`` reads an export with an explicit schema; ``scan_catalog``
applies the optional organization filter and offset/limit paging. By
default every row is read (the single-page cut of the original listing
is not reproduced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = "id string, name string, organization_id string, description string, created_at string"


def read_catalog(spark: SparkSession, path: str, schema: str = CATALOG_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def scan_catalog(catalog: DataFrame, organization_id=None, offset: int = 0,
                 limit: int | None = None) -> DataFrame:
    df = catalog
    if organization_id is not None:
        df = df.where(F.col("organization_id") == F.lit(organization_id))
    if offset or limit is not None:
        df = df.orderBy("id")
        if offset:
            df = df.offset(offset)
        if limit is not None:
            df = df.limit(limit)
    return df
