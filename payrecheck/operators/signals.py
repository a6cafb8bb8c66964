"""The six duplicate signals and the blocking keys they need."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payrecheck.functions.text import optional_text
from payrecheck.schema import MONEY, Capabilities

Side = Callable[[str], Column]
PairExpr = Callable[[Side, Side], Column]

# What a pair is judged by once both sides share a bucket.
PAYLOAD = (
    "transaction_id",
    "vendor_key",
    "invoice_key",
    "department",
    "amount",
    "invoice_amount",
)
#: The column of fields that are not compared but come along to the candidates.
CARRIED = "carried"


@dataclass(frozen=True)
class SignalSpec:
    """One signal: equality key, what must differ, and the money at stake.

    ``key`` names the columns both payments share.  Signals with the same key
    are found in the same buckets, so they cost one shuffle together.  ``risk``
    is null for pairs the signal does not accept.  ``differs`` names a field in which the
    pairs it accepts always differ, if there is one.
    """

    name: str
    key: tuple[str, ...]
    risk: PairExpr
    differs: str | None = None

    @property
    def family(self) -> str:
        return "+".join(self.key)


def smaller_amount(left: Side, right: Side) -> Column:
    return F.least(left("amount"), right("amount"))


def when_differs(field: str) -> PairExpr:
    """The smaller amount, for pairs that differ in ``field``; null is a value."""

    def risk(left: Side, right: Side) -> Column:
        same = left(field).eqNullSafe(right(field))
        return F.when(~same, smaller_amount(left, right))

    return risk


def overpaid_excess(left: Side, right: Side) -> Column:
    """What both payments exceed the (smaller known) invoice amount by."""
    invoice = F.least(left("invoice_amount"), right("invoice_amount"))
    excess = (left("amount") + right("amount") - invoice).cast(MONEY)
    return F.when(excess > 0, excess)


def default_signals(capabilities: Capabilities) -> tuple[SignalSpec, ...]:
    """The signals a source can support.

    Without invoice numbers the invoice date stands in for the invoice, and the
    two signals that compare invoice numbers are off.
    """
    by_invoice = capabilities.has_invoice_number
    bill = "invoice_key" if by_invoice else "day_key"
    signals = []
    if by_invoice:
        signals += [
            SignalSpec(
                "exact_duplicate", ("vendor_key", bill, "amount"), smaller_amount
            ),
            SignalSpec(
                "invoice_variant",
                ("vendor_key", "amount"),
                when_differs("invoice_key"),
                "invoice_key",
            ),
        ]
    signals += [
        SignalSpec("fuzzy_vendor", (bill, "amount"), when_differs("vendor_key"), "vendor_key"),
        SignalSpec("split_payment", ("vendor_key", bill), smaller_amount),
        SignalSpec(
            "cross_department",
            ("vendor_key", bill, "amount"),
            when_differs("department"),
            "department",
        ),
    ]
    if capabilities.has_invoice_amount:
        signals.append(
            SignalSpec("overpayment_vs_invoice", ("vendor_key", bill), overpaid_excess)
        )
    return tuple(signals)


def lone_signals(signals: tuple[SignalSpec, ...]) -> tuple[str, ...]:
    """Signals whose pairs are candidates under no other of ``signals``.

    Their pairs differ in a field that is part of every other signal's key.
    """
    return tuple(
        s.name
        for s in signals
        if s.differs is not None and all(s.differs in o.key for o in signals if o is not s)
    )


def blocking_fields(payments: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """The payload plus ``day_key``; every key part is null when unusable."""
    wanted = dict.fromkeys(("transaction_id", *carry))
    carried = [F.struct(*[F.col(f) for f in wanted]).alias(CARRIED)] if carry else []
    vendor = F.coalesce(
        F.nullif(F.col("vendor_canonical"), F.lit("")), F.col("vendor_name_raw")
    )
    return payments.select(
        "transaction_id",
        optional_text(vendor).alias("vendor_key"),
        F.coalesce(
            optional_text(F.col("invoice_canonical")),
            optional_text(F.col("invoice_number_raw")),
        ).alias("invoice_key"),
        F.col("invoice_date").cast("string").alias("day_key"),
        "department",
        "amount",
        "invoice_amount",
        *carried,
    )


def _packed(parts: tuple[str, ...]) -> Column:
    """Key parts as one string, each with its length in front so that different
    parts can never read alike; null as soon as one part is null."""
    texts = [F.col(p).cast("string") for p in parts]
    return F.concat(*[x for t in texts for x in (F.length(t), F.lit(":"), t)])


def explode_keys(
    payments: DataFrame, signals: tuple[SignalSpec, ...], carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per payment and key family: ``family, key, key_hash, day, ...``."""
    families = {s.family: s.key for s in signals}
    keys = F.array(
        *[
            F.struct(F.lit(name).alias("family"), _packed(parts).alias("key"))
            for name, parts in families.items()
        ]
    )
    return (
        blocking_fields(payments, carry)
        .withColumn("_k", F.explode(keys))
        .filter("_k.key IS NOT NULL")
        .select(
            "_k.family",
            "_k.key",
            F.xxhash64("_k.family", "_k.key").alias("key_hash"),
            F.coalesce("day_key", F.lit("")).alias("day"),
            *PAYLOAD,
            *([CARRIED] if carry else []),
        )
    )
