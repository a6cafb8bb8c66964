"""A ledger derived from order tables: each order a payment, each item a line.

Some orders are entered again as a duplicate, with another amount or under
another vendor name, so every signal and every rule has something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payrecheck.schema import LEDGER_LINE, MONEY


def ledger_from_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger lines from ``lineitem``, ``orders`` and ``customer`` Parquet files.

    The copies are exploded from the joined row, so the tables are read once.
    The three narrow item columns are partitioned by order up front: that is the
    exchange the join needs anyway once ``orders`` is too big to broadcast, and it
    spreads the work when the file has only a few row groups.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    joined = (
        table("lineitem")
        .select("l_orderkey", "l_quantity", "l_returnflag")
        .repartition("l_orderkey")
        .join(
            table("orders").select(
                "o_orderkey",
                "o_custkey",
                "o_orderstatus",
                "o_orderdate",
                "o_orderpriority",
            ),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        .join(
            table("customer").select("c_custkey", "c_name"),
            F.col("o_custkey") == F.col("c_custkey"),
        )
    )
    key = F.col("o_orderkey")
    amount = F.col("l_quantity").cast(MONEY)
    number = F.lpad(key.cast("string"), 9, "0")
    digits = F.lpad((key % 400).cast("string"), 6, "0")
    vendor = F.concat(F.col("c_name"), F.lit(" Inc."))
    invoice = F.concat(F.lit("INV-"), digits)
    department = F.col("o_orderpriority")

    def entry(prefix="ORD", name=vendor, inv=invoice, paid=amount, dept=department):
        return F.struct(
            F.concat(F.lit(prefix), number).alias("transaction_id"),
            name.alias("vendor_name_raw"),
            inv.alias("invoice_number_raw"),
            paid.cast(MONEY).alias("amount"),
            dept.alias("department"),
        )

    entries = F.array(
        entry(),
        F.when(
            key % 20 == 0,
            entry(
                "DUP",
                F.concat(F.upper("c_name"), F.lit(", LLC")),
                F.concat(F.lit("inv "), digits),
                dept=F.when(key % 3 == 0, F.lit("OTHER")).otherwise(department),
            ),
        ),
        F.when(key % 30 == 0, entry("SPL", paid=amount * 2)),
        F.when(key % 25 == 0, entry("FUZ", F.concat(vendor, F.lit(" Holdings")))),
    )
    day = F.col("o_orderdate").cast("date")
    status = F.when(F.col("o_orderstatus") == "P", F.lit("Voided")).when(
        F.col("o_orderstatus") == "F", F.lit("PAID")
    )
    entered = joined.withColumn("e", F.explode(entries)).filter("e IS NOT NULL")
    ledger = entered.select(
        "e.transaction_id",
        "e.vendor_name_raw",
        F.col("o_custkey").cast("string").alias("vendor_id"),
        "e.invoice_number_raw",
        day.alias("invoice_date"),
        F.date_add(day, 30).alias("payment_date"),
        "e.amount",
        F.col("e.amount").alias("invoice_amount"),
        F.concat(F.lit("PO-"), (key % 7).cast("string")).alias("po_number"),
        F.col("l_returnflag").alias("payment_method"),
        status.alias("payment_status"),
        "e.department",
        F.lit(None).cast("string").alias("description"),
    )
    return ledger.select(*LEDGER_LINE.fieldNames())
