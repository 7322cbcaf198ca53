"""Write reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classes import percent_text

# Header names of the two chain dialects.
CHAIN_HEADERS = {
    "plain": ("Depth", "Frame", "Frame Hits", "% Parent", "Chain Hits", "Branch"),
    "wpa": ("Level", "Function", "Inclusive Hits", "Parent %", "Chain Hits", "Branch"),
}


def chain_table(chain: DataFrame, *, dialect: str = "plain", branch_policy: str = "dominant") -> DataFrame:
    """A stack walk under the header names of a dialect."""
    branch = (
        F.when(F.col("depth") == 0, F.lit("root"))
        .when(F.col("siblings") > 1, F.concat(F.lit(f"{branch_policy}; "), F.col("siblings").cast("string"), F.lit(" siblings")))
        .otherwise(F.lit(branch_policy))
    )
    values = (
        F.col("depth"), F.concat("module", F.lit("!"), "function"), F.col("frame_hits"),
        percent_text(F.col("parent_pct")), F.col("chain_hits"), branch,
    )
    return chain.select("trace_id", *[v.alias(n) for v, n in zip(values, CHAIN_HEADERS[dialect])])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """The combined report, one folder per trace."""
    report.write.mode("overwrite").partitionBy("trace_id").option("header", "true").csv(path)
