"""Keep costly expressions from being copied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose expressions are evaluated once per row.

    The optimiser merges neighbouring projections and filters by copying a
    column's expression into each place that uses it; for parsers that multiplies
    both the work and the generated code.  A one-element explode is a boundary it
    does not copy across, and costs nothing else.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return (
        df.withColumn("_once", F.explode(F.array(made)))
        .select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], "_once.*")
    )
