"""Parquet tables by name; column pruning and filters are left to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` of `folder`, a file or a folder of files called <name>.parquet."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Registry:
    """Schemas of tables by name and version; the highest version of a name is the present one."""

    def __init__(self) -> None:
        self._schemas: dict[str, dict[int, str]] = {}

    def add(self, name: str, version: int, schema: str) -> None:
        """A version is given once; to give it again with another schema is an error."""
        known = self._schemas.setdefault(name, {})
        if known.get(version, schema) != schema:
            raise ValueError(f"{name} has another schema of version {version}")
        known[version] = schema

    def version(self, name: str) -> int:
        return max(self._schemas[name])

    def conformed(self, df: DataFrame, name: str) -> DataFrame:
        """df with the columns of the present schema in its order: missing ones null, others left out; a value that does not cast is an error.

        A migration to a schema with more columns is reading old rows through it.
        """
        spark = df.sparkSession
        schema = spark.createDataFrame([], self._schemas[name][self.version(name)]).schema
        return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
