import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from payrecheck.functions.text import with_canonical_keys  # noqa: E402
from payrecheck.schema import LEDGER_LINE, LINE_FIELDS, TRANSACTION  # noqa: E402
from payrecheck.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("payrecheck-tests", "8")
    # Tiny tables: compiling code for each plan would take most of the time.
    # ``checks.compare`` runs the same operators with generated code.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def line(tid, **over):
    row = {
        "transaction_id": tid,
        "vendor_name_raw": "Acme Supply Inc",
        "vendor_id": "V1",
        "invoice_number_raw": "INV-100",
        "invoice_date": dt.date(2024, 1, 5),
        "payment_date": dt.date(2024, 2, 5),
        "amount": "100.00",
        "invoice_amount": None,
        "po_number": "PO1",
        "payment_method": "EFT",
        "payment_status": "PAID",
        "department": "FIRE",
        "description": None,
        **over,
    }
    for f in ("amount", "invoice_amount"):
        row[f] = None if row[f] is None else Decimal(row[f])
    return tuple(row[f] for f in LINE_FIELDS)


@pytest.fixture(scope="session")
def make_lines(spark):
    return lambda rows: spark.createDataFrame(rows, LEDGER_LINE)


@pytest.fixture(scope="session")
def make_payments(spark):
    """Payment rows as they come out of stage 2, from keyword dicts."""

    def make(rows):
        full = []
        for r in rows:
            base = dict(zip(LINE_FIELDS, line(r.pop("tid"), **{k: v for k, v in r.items() if k in LINE_FIELDS})))
            amounts = r.get("distinct_line_amounts", [base["amount"]])
            base |= {
                "vendor_canonical": None,
                "invoice_canonical": None,
                "line_count": r.get("line_count", 1),
                "distinct_line_amounts": [Decimal(a) for a in amounts],
                "disagreed_fields": [],
            }
            full.append(tuple(base[f] for f in TRANSACTION.fieldNames()))
        return with_canonical_keys(spark.createDataFrame(full, TRANSACTION))

    return make
