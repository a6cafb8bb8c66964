"""Collapse distribution lines to one row per payment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payrecheck.functions.text import non_blank
from payrecheck.schema import IDENTITY_FIELDS, MONEY, TRANSACTION


def _observed(field: str) -> Column:
    """The field's usable value on a line: blank text counts as absent."""
    is_money_or_date = field.endswith("_date") or field.endswith("_amount")
    return F.col(field) if is_money_or_date else non_blank(F.col(field))


def _fields(columns: list[str]) -> list[str]:
    """The fields whose values are agreed on: identity, and keys that are there already."""
    carried = ("vendor_canonical", "invoice_canonical")
    marked = {c.removeprefix("_lo_") for c in columns}
    return [*IDENTITY_FIELDS, *(f for f in carried if f in marked)]


def payment_state(lines: DataFrame) -> DataFrame:
    """What is known of each payment, in a form that later lines can be merged into.

    ``transaction_id``, the sum of ``amount``, ``line_count``, the set of
    ``distinct_line_amounts``, and the least and greatest value of every identity field.  Each of
    them is the same whatever the order and grouping of the lines.

    Amounts are made distinct by id and amount, in all tasks, before they meet in the list of
    their id: of an id with very many lines a task sees each amount once, not once for every
    part of the input.  Sums and bounds need no list and are combined before their exchange.
    """
    missing_id = F.raise_error(F.lit("transaction_id is required"))
    fields = _fields(lines.columns)
    observed = lines.select(
        F.coalesce(non_blank(F.col("transaction_id")), missing_id).alias(
            "transaction_id"
        ),
        "amount",
        *[_observed(f).alias(f) for f in fields],
    )
    bounds = [
        bound(f).alias(f"{mark}{f}")
        for f in fields
        for bound, mark in ((F.min, "_lo_"), (F.max, "_hi_"))
    ]
    sums = observed.groupBy("transaction_id").agg(
        F.sum("amount").cast(MONEY).alias("amount"),
        F.count(F.lit(1)).alias("line_count"),
        *bounds,
    )
    lists = (
        observed.select("transaction_id", F.col("amount").alias("_amount"))
        .distinct()
        .groupBy("transaction_id")
        .agg(F.sort_array(F.collect_list("_amount")).alias("distinct_line_amounts"))
    )
    marks = [c for c in sums.columns if c.startswith(("_lo_", "_hi_"))]
    return sums.join(lists, "transaction_id").select(
        "transaction_id", "amount", "line_count", "distinct_line_amounts", *marks
    )


def merge_states(one: DataFrame, other: DataFrame) -> DataFrame:
    """The states of two sets of lines as the state of both; at most two rows of an id meet."""
    bounds = [c for c in one.columns if c.startswith(("_lo_", "_hi_"))]
    sets = F.flatten(F.collect_list("distinct_line_amounts"))
    return (
        one.unionByName(other)
        .groupBy("transaction_id")
        .agg(
            F.sum("amount").cast(MONEY).alias("amount"),
            F.sum("line_count").alias("line_count"),
            F.sort_array(F.array_distinct(sets)).alias("distinct_line_amounts"),
            *[(F.min if c.startswith("_lo_") else F.max)(c).alias(c) for c in bounds],
        )
    )


def payments_of_state(state: DataFrame) -> DataFrame:
    """One payment per state; fields whose bounds differ become null and are named."""
    fields = _fields(state.columns)

    def lo(f: str) -> Column:
        return F.col(f"_lo_{f}")

    def hi(f: str) -> Column:
        return F.col(f"_hi_{f}")

    agreed = {f: F.when(lo(f) == hi(f), lo(f)).alias(f) for f in fields}
    agreed["vendor_name_raw"] = F.coalesce(
        agreed["vendor_name_raw"], F.lit("")
    ).alias("vendor_name_raw")
    for f in ("vendor_canonical", "invoice_canonical"):
        agreed.setdefault(f, F.lit(None).cast("string").alias(f))
    disagreed = F.array_compact(
        F.array(*[F.when(lo(f) != hi(f), F.lit(f)) for f in sorted(fields)])
    )
    built = {
        **agreed,
        "transaction_id": F.col("transaction_id"),
        "amount": F.col("amount"),
        "line_count": F.col("line_count"),
        "distinct_line_amounts": F.col("distinct_line_amounts"),
        "disagreed_fields": disagreed.alias("disagreed_fields"),
    }
    return state.select(*[built[f] for f in TRANSACTION.fieldNames()])


def aggregate_payments(lines: DataFrame) -> DataFrame:
    """One payment per ``transaction_id``, with exact sums.

    An identity field keeps its value only when every line that has one agrees;
    ``min = max`` says so without a custom aggregate, in one map-side combined
    pass and whatever the line order.  Fields that disagree become null and are
    named in ``disagreed_fields``.
    """
    return payments_of_state(payment_state(lines))


def field_disagreements(payments: DataFrame) -> DataFrame:
    """Payments whose lines contradict each other, one row per field."""
    return payments.select(
        "transaction_id", F.explode("disagreed_fields").alias("field")
    )
