"""Exact money: parsing, labels, ratios.  Never through a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from payrecheck.functions.text import optional_text
from payrecheck.schema import MONEY

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
# Nearly all cells: no exponent, and nothing that two decimals would lose.
_CENTS = r"^[+-]?(\d+\.?|\d*\.\d{1,2}0*)\z"


def parse_money(cell: Column) -> Column:
    """Decimal text with optional ``$``, ``,`` and ``_``; null when unusable.

    A value with more than two decimals is not rounded: it is unusable, so that
    strict ingest fails on it and permissive ingest rejects it.
    """
    return read_money(optional_text(cell))


def read_money(stripped: Column) -> Column:
    """``parse_money`` of text that is already stripped."""
    text = stripped
    for mark in "$,_":
        text = F.replace(text, F.lit(mark), F.lit(""))
    wide = F.when(text.rlike(_NUMBER), text.try_cast("decimal(38,18)"))
    lost = text.rlike(r"\.\d{18}\d*[1-9]")
    exact = wide.try_cast(MONEY)
    return F.when(text.rlike(_CENTS), text.try_cast(MONEY)).otherwise(
        F.when((exact == wide) & ~lost, exact)
    )


def money_text(amount: Column) -> Column:
    return amount.cast("string")


def amounts_text(amounts: Column) -> Column:
    return F.array_join(amounts.cast("array<string>"), ",")


def money_label(amount: Column) -> Column:
    """``-$1,234.50``"""
    sign = F.when(amount < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.lit("$"), F.format_number(F.abs(amount), 2))


def ratio(numerator: Column, denominator: Column) -> Column:
    """A double quotient, 0 when there is nothing to divide by."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(
        numerator.cast("double") / denominator.cast("double")
    )


def f1(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total == 0.0, F.lit(0.0)).otherwise(
        F.lit(2.0) * precision * recall / total
    )


def pairs(n: Column) -> Column:
    """Unordered pairs in a group of ``n``, as a decimal that cannot overflow."""
    wide = n.cast("decimal(19,0)")
    return F.floor(wide * (wide - 1) / 2)
