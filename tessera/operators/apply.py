"""Any query of the catalogue over given DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.plans import catalog
from tessera.plans.dialect import SPARK


def apply(name: str, **tables: DataFrame) -> DataFrame:
    """The catalogue's query ``name`` over the tables given by name; a table that it reads and that isn't given is an error.

    Queries that read files or run streams (they have no text) take a folder of tables instead: ``catalog.queries()``.
    """
    if name not in catalog.BOTH:
        raise KeyError(f"{name} has no text to apply")
    if not tables:
        raise ValueError("no tables are given")
    spark = next(iter(tables.values())).sparkSession
    for table, df in tables.items():
        df.createOrReplaceTempView(table)
    return spark.sql(catalog.BOTH[name](SPARK))
