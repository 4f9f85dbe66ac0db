"""A column that is worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` for costly expressions that are used several times.

    The optimiser inlines a projected expression into every use of its fields, so that a chain of
    array functions doubles with each step. A generator of one row is a border it keeps.
    """
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_pinned")).select("*", *[F.col(f"_pinned.{n}").alias(n) for n in columns]).drop("_pinned")
