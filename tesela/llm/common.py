"""Small helpers of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, table  # noqa: F401

#: A word is a maximal run of letters and digits (Java pattern).
WORD = r"[\p{L}\p{N}]+"


def lit_table(name: str) -> Column:
    return F.lit(name).alias("rec_table")


def records(spark, sf_dir: str, name: str, text: str) -> DataFrame:
    """(rec_table, rec_id, text) of one table; rows delivered twice are still there twice."""
    return table(spark, sf_dir, name).select(lit_table(name), F.col("id").alias("rec_id"), F.col(text).alias("text"))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, an upper bound for plain scans and projections."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = 64 << 20) -> bool:
    """Whether a side may be broadcast: its estimated size is known to be below a limit."""
    return estimated_bytes(df) <= limit
