"""Bring both payments of a candidate together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_pair(
    candidates: DataFrame, payments: DataFrame, fields: tuple[str, ...]
) -> DataFrame:
    """Add structs ``l`` and ``r`` with ``fields`` of the two payments.

    A payment that is not in ``payments`` leaves a null struct.  Blocking bounds
    how often one payment occurs, so neither join can skew; small tables are
    broadcast by the optimiser from their measured size.  Candidates that blocking gave
    these fields of their payments keep them, without a join.
    """
    wanted = tuple(dict.fromkeys(("transaction_id", *fields)))
    if {"l", "r"} <= set(candidates.columns):
        if all(set(wanted) <= set(candidates.schema[s].dataType.names) for s in ("l", "r")):
            return candidates
        candidates = candidates.drop("l", "r")

    def side(id_column: str, name: str) -> DataFrame:
        return payments.select(
            F.col("transaction_id").alias(id_column),
            F.struct(*[F.col(f) for f in wanted]).alias(name),
        )

    return candidates.join(side("left_id", "l"), "left_id", "left").join(
        side("right_id", "r"), "right_id", "left"
    )
