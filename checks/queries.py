"""Every registered query: the Spark callable and, where SQL can say it, the SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import ledgers as L
from checks import sql as q
from payrecheck.functions import names as N
from payrecheck.functions.dates import parse_date, payment_date_label
from payrecheck.functions.money import money_label, parse_money
from payrecheck.functions.text import canonical_invoice, canonical_vendor
from payrecheck.operators import adjudication as A
from payrecheck.operators import blocking as B
from payrecheck.operators import packets as K
from payrecheck.operators import review as R
from payrecheck.operators import scoring as S
from payrecheck.operators.dismissal import dismiss, dismissals_by_explanation, rule_candidates
from payrecheck.operators.explanations import (
    explain_candidates,
    explained_candidates,
    payment_series,
    related_payments,
    series_candidates,
)
from payrecheck.operators.findings import SHOWN_FIELDS, judged_candidates
from payrecheck.operators.funnel import dollars_at_risk, funnel, survivors
from payrecheck.operators.payments import aggregate_payments, field_disagreements
from payrecheck.operators.planting import plant_cases
from payrecheck.operators.rules import apply_decision_rules
from payrecheck.operators.signals import default_signals, lone_signals
from payrecheck.plans.runs import (
    rules_only,
    rules_only_run,
    staged_payments,
)
from payrecheck.schema import Capabilities
from payrecheck.session import shared_dir, stage
from payrecheck.sources import ledger_csv as C
from payrecheck.sources import sinks
from payrecheck.sources.layouts import LOS_ANGELES, OKLAHOMA, LedgerLayout
from payrecheck.streaming.incremental import CandidateFeed, incremental_candidates

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/payrecheck/{name}-{uuid.uuid4().hex}"


CAND = "candidate_id, left_id, right_id, signal, amount_at_risk"
_TX = (q.LEDGER, q.payments())
_CANDS = (*_TX, q.candidates())
_RULED = (*_CANDS, q.RULED)


# --- sources ---------------------------------------------------------------

_GENERIC = LedgerLayout(
    {
        "transaction_id": "Payment Id",
        "vendor_name_raw": "Payee",
        "vendor_id": "Payee Code",
        "invoice_number_raw": "Bill",
        "invoice_date": "Bill Date",
        "payment_date": "Paid On",
        "amount": "Amount",
        "po_number": "PO",
        "payment_status": "State",
        "department": "Unit",
    }
)
_LINE_COLUMNS = "transaction_id, vendor_name_raw, vendor_id, invoice_number_raw, invoice_date, payment_date, amount, po_number, payment_status, department"


def _as_generic_cells(lines: DataFrame) -> DataFrame:
    c = {f: F.col(f) for f in _GENERIC.columns}
    c["vendor_name_raw"] = F.concat(F.lit("  "), F.col("vendor_name_raw"), F.lit(" "))
    c["invoice_date"] = F.date_format("invoice_date", "M/d/yyyy")
    c["payment_date"] = F.date_format("payment_date", "yyyy/M/d")
    c["amount"] = F.concat(F.lit("$"), F.format_number(F.col("amount") * 1000, 2))
    return lines.select(*[c[f].cast("string").alias(n) for f, n in _GENERIC.columns.items()])


@registered(
    q.query(
        q.LEDGER,
        select="SELECT transaction_id, vendor_name_raw, vendor_id, invoice_number_raw,"
        " invoice_date, payment_date, CAST(amount * 1000 AS DECIMAL(18,2)) AS amount, po_number,"
        " payment_status, department FROM ledger",
    )
)
def ingest_generic_map(spark, d):
    path = _scratch(spark, "generic")
    C.write_cells(_as_generic_cells(L.lines_of(spark, d)), path)
    lines = C.read_ledger(spark, path, _GENERIC)
    return lines.select(*_LINE_COLUMNS.split(", "))


def _as_los_angeles_cells(lines: DataFrame) -> DataFrame:
    stamp = "yyyy-MM-dd'T'00:00:00.000"
    c = {f: F.col(f) for f in LOS_ANGELES.columns}
    c["invoice_date"] = F.date_format("invoice_date", stamp)
    c["payment_date"] = F.date_format("payment_date", stamp)
    # A quoted newline and a quote in every description.
    c["description"] = F.concat(F.lit('Say "paid"\nfor '), F.col("po_number"))
    source = {n: f for f, n in LOS_ANGELES.columns.items()}
    source["dollar_amount"] = "amount"
    return lines.select(*[c[f].cast("string").alias(n) for n, f in source.items()])


@registered(
    q.query(
        q.LEDGER,
        select="SELECT transaction_id, vendor_name_raw, vendor_id, invoice_number_raw,"
        " invoice_date, payment_date, amount, invoice_amount, po_number, payment_method,"
        " payment_status, department, 'Say \"paid\"' || chr(10) || 'for ' || po_number AS description"
        " FROM ledger",
    )
)
def ingest_los_angeles(spark, d):
    path = _scratch(spark, "los-angeles")
    C.write_cells(_as_los_angeles_cells(L.lines_of(spark, d)), path)
    return C.read_ledger(spark, path, LOS_ANGELES, multiline=True)


def _as_oklahoma_cells(lines: DataFrame) -> DataFrame:
    withheld = F.col("vendor_id").cast("bigint") % 10 == 0
    c = {f: F.col(f) for f in OKLAHOMA.columns}
    c["transaction_id"] = F.substring("transaction_id", 4, 9)
    c["vendor_name_raw"] = F.when(withheld, F.lit(" PROTECTED INFORMATION ")).otherwise(
        F.col("vendor_name_raw")
    )
    c["amount"] = F.when(withheld, F.lit("n/a")).otherwise(F.col("amount").cast("string"))
    return lines.select(*[c[f].cast("string").alias(n) for f, n in OKLAHOMA.columns.items()])


@registered(
    q.query(
        q.LEDGER,
        select="SELECT substr(transaction_id, 4) AS transaction_id, vendor_name_raw, invoice_date,"
        " payment_date, amount, po_number, department FROM ledger"
        " WHERE CAST(vendor_id AS BIGINT) % 10 <> 0",
    )
)
def ingest_oklahoma(spark, d):
    path = _scratch(spark, "oklahoma")
    C.write_cells(_as_oklahoma_cells(L.lines_of(spark, d)), path)
    lines = C.read_ledger(spark, path, OKLAHOMA)
    return lines.select(
        "transaction_id", "vendor_name_raw", "invoice_date", "payment_date", "amount",
        "po_number", "department",
    )


@registered(
    q.query(
        q.LEDGER,
        select="""
SELECT problem, count(*) AS n FROM (
  SELECT CASE CAST(substr(transaction_id, 4) AS BIGINT) % 50
    WHEN 1 THEN 'cannot read amount from 12.345' WHEN 2 THEN 'amount is empty'
    WHEN 3 THEN 'cannot read invoice_date from 13/13/2020'
    WHEN 4 THEN 'vendor_name_raw is empty' END AS problem
  FROM ledger) GROUP BY problem""",
    )
)
def ingest_rejects(spark, d):
    """Rows per problem; null counts the rows that were read."""
    lines = L.lines_of(spark, d)
    n = F.substring("transaction_id", 4, 9).cast("bigint") % 50
    cells = _as_generic_cells(lines.withColumn("n", n))
    broken = lines.select(
        *[
            {
                "amount": F.when(n == 1, "12.345").when(n == 2, " ").otherwise(
                    F.col("amount").cast("string")
                ),
                "invoice_date": F.when(n == 3, "13/13/2020").otherwise(
                    F.col("invoice_date").cast("string")
                ),
                "vendor_name_raw": F.when(n == 4, "").otherwise(F.col("vendor_name_raw")),
            }
            .get(f, F.col(f).cast("string"))
            .alias(name)
            for f, name in _GENERIC.columns.items()
        ]
    ).select(*cells.columns)
    path = _scratch(spark, "rejects")
    C.write_cells(broken, path)
    read = C.read_cells(spark, path, required=_GENERIC.source_columns)
    good, rejects = C.split_lines(read, _GENERIC)
    return (
        good.select(F.lit(None).cast("string").alias("problem"))
        .unionByName(rejects.select(F.explode("problems").alias("problem")))
        .groupBy("problem")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@registered(
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 8 THEN NULL"
    " ELSE CAST(o_orderdate AS DATE) END AS day FROM orders"
)
def date_formats(spark, d):
    """Each order date written in one of eight ways (or unreadably), read back."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate")
    day = F.col("o_orderdate").cast("date")
    iso = F.date_format(day, "yyyy-MM-dd")
    week_day = F.weekday(day) + 1
    thursday = F.date_add(day, 4 - week_day)
    iso_week = F.concat(
        F.year(thursday).cast("string"), F.lit("-W"),
        F.lpad(F.weekofyear(day).cast("string"), 2, "0"), F.lit("-"), week_day.cast("string"),
    )
    written = [
        iso,
        F.concat(iso, F.lit("T00:00:00.000")),
        F.date_format(day, "M/d/yyyy"),
        F.date_format(day, "MM/dd/yy"),
        F.date_format(day, "yyyy/MM/dd"),
        F.date_format(day, "yyyyMMdd"),
        F.concat(F.lit(" "), F.date_format(day, "yyyy-M-d"), F.lit("\t")),
        iso_week,
        F.concat(iso, F.lit("x")),
    ]
    cell = F.coalesce(*[F.when(F.col("o_orderkey") % 9 == i, w) for i, w in enumerate(written)])
    return orders.select(F.col("o_orderkey").alias("id"), parse_date(cell).alias("day"))


@registered(
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 5 THEN NULL"
    " ELSE CAST(o_totalprice AS DECIMAL(18,2)) * (CASE WHEN o_orderkey % 6 = 3 THEN -1 ELSE 1 END)"
    " END AS amount FROM orders"
)
def money_formats(spark, d):
    """Each order total written in one of five ways (or with a third decimal)."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice")
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    plain = amount.cast("string")
    written = [
        plain,
        F.concat(F.lit("$"), F.format_number(amount, 2)),
        F.concat(F.lit(" +"), plain, F.lit("00 ")),
        F.concat(F.lit("-"), plain),
        F.concat((amount * 100).cast("bigint").cast("string"), F.lit("E-2")),
        F.concat(plain, F.lit("1")),
    ]
    cell = F.coalesce(*[F.when(F.col("o_orderkey") % 6 == i, w) for i, w in enumerate(written)])
    return orders.select(
        F.col("o_orderkey").alias("id"), parse_money(cell).alias("amount")
    )


@registered(
    q.query(
        q.LEDGER,
        select="SELECT * FROM (SELECT transaction_id, amount FROM ledger"
        " ORDER BY transaction_id, vendor_name_raw, vendor_id, invoice_number_raw, invoice_date,"
        " payment_date, amount LIMIT 500)",
    )
)
def first_ledger_rows(spark, d):
    return C.first_rows(L.lines_of(spark, d), 500).select("transaction_id", "amount")


# --- payments and keys -----------------------------------------------------


@registered(
    q.query(
        *_TX,
        select="SELECT transaction_id, vendor_name_raw, vendor_id, vendor_canonical,"
        " invoice_number_raw, invoice_canonical, invoice_date, payment_date, amount,"
        " CAST(invoice_amount AS DECIMAL(18,2)) AS invoice_amount, po_number, payment_method,"
        " payment_status, department, line_count, array_to_string(amounts, ',') AS line_amounts"
        " FROM tx",
    )
)
def aggregate_to_payments(spark, d):
    payments = L.payments_of(spark, d)
    text = F.array_join(F.col("distinct_line_amounts").cast("array<string>"), ",")
    return payments.withColumn("line_amounts", text).drop(
        "distinct_line_amounts", "disagreed_fields", "description"
    )


@registered(
    q.query(*_TX, select="SELECT transaction_id, unnest(disagreed) AS field FROM tx")
)
def disagreeing_fields(spark, d):
    return field_disagreements(aggregate_payments(L.lines_of(spark, d)))


_NAMES = {
    0: ("'The ' || c_name || ' and Co., Inc.'", lambda c: F.concat(F.lit("The "), c, F.lit(" and Co., Inc."))),
    1: ("c_name || ' L.L.C'", lambda c: F.concat(c, F.lit(" L.L.C"))),
    2: ("'the the ' || lower(c_name) || ' & company ltd'", lambda c: F.concat(F.lit("the the "), F.lower(c), F.lit(" & company ltd"))),
    3: ("'The Co. Inc'", lambda c: F.lit("The Co. Inc")),
    4: ("'  ** '", lambda c: F.lit("  ** ")),
    5: ("c_name || ' INCORPORATED'", lambda c: F.concat(c, F.lit(" INCORPORATED"))),
}
_NUMBERS = {
    0: ("'INV-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0')", lambda c: F.concat(F.lit("INV-"), F.lpad(c.cast("string"), 8, "0"))),
    1: ("'invoice ' || c_custkey", lambda c: F.concat(F.lit("invoice "), c.cast("string"))),
    2: ("'0000'", lambda c: F.lit("0000")),
    3: ("' inv '", lambda c: F.lit(" inv ")),
    4: ("'#' || c_custkey || '/A'", lambda c: F.concat(F.lit("#"), c.cast("string"), F.lit("/A"))),
    5: ("'--'", lambda c: F.lit("--")),
}


def _cases(table: dict) -> str:
    return "CASE c_custkey % 6 " + " ".join(f"WHEN {k} THEN {v[0]}" for k, v in table.items()) + " END"


@registered(
    f"WITH n AS (SELECT c_custkey, {_cases(_NAMES)} AS name, {_cases(_NUMBERS)} AS number"
    f" FROM customer) SELECT c_custkey AS id, {q.vendor_key('name')} AS vendor_key,"
    f" {q.invoice_key('number')} AS invoice_key FROM n"
)
def canonical_keys(spark, d):
    customers = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name")
    which = F.col("c_custkey") % 6
    name = F.coalesce(*[F.when(which == k, v[1](F.col("c_name"))) for k, v in _NAMES.items()])
    number = F.coalesce(*[F.when(which == k, v[1](F.col("c_custkey"))) for k, v in _NUMBERS.items()])
    return customers.select(
        F.col("c_custkey").alias("id"),
        canonical_vendor(name).alias("vendor_key"),
        canonical_invoice(number).alias("invoice_key"),
    )


# --- blocking --------------------------------------------------------------


def _signal_query(signal: str) -> Query:
    def run(spark, d):
        chosen = tuple(s for s in default_signals(Capabilities()) if s.name == signal)
        return B.block(L.payments_of(spark, d), signals=chosen).select(*CAND.split(", "))

    run.__name__ = f"signal_{signal}"
    return run


for _signal in q.ALL_SIGNALS:
    registered(q.query(*_TX, select=f"SELECT {CAND} FROM ({q.signal_select(_signal)})"))(
        _signal_query(_signal)
    )

_NO_INVOICE = (
    q.LEDGER.replace("'INV-' || digits AS invoice_number_raw", "CAST(NULL AS VARCHAR) AS invoice_number_raw")
    .replace("'INV-' || digits", "NULL")
    .replace("'inv ' || digits", "NULL")
)


@registered(
    q.query(
        _NO_INVOICE,
        q.payments(),
        q.candidates(q.NO_INVOICE_SIGNALS, bill="dk"),
        select=f"SELECT {CAND} FROM cand",
    )
)
def no_invoice_fallback(spark, d):
    """A source without invoice numbers and amounts: dates stand in."""
    lines = L.lines_of(spark, d).withColumn("invoice_number_raw", F.lit(None).cast("string"))
    capabilities = Capabilities(has_invoice_number=False, has_invoice_amount=False)
    return B.block(staged_payments(lines), capabilities).select(*CAND.split(", "))


CAP = 4


@registered(
    q.query(
        *_TX,
        q.capped_buckets(CAP),
        q.capped_candidates(),
        select="SELECT candidate_id, signal, amount_at_risk FROM capped",
    )
)
def blocking_capped(spark, d):
    found = B.block(L.payments_of(spark, d), cap=CAP)
    return found.select("candidate_id", "signal", "amount_at_risk")


@registered(
    q.query(
        *_TX,
        q.capped_buckets(CAP),
        select="""
SELECT (SELECT count(*) FROM tx) AS rows_in, CAST(max(n) AS BIGINT) AS max_bucket,
  CAST(sum(n * (n - 1) / 2 * (CASE WHEN family IN ('via', 'vi') THEN 2 ELSE 1 END)) AS BIGINT)
    AS pair_comparisons
FROM (SELECT family, key, sub, chunk, count(*) AS n FROM bucketed GROUP BY ALL)""",
    )
)
def blocking_work(spark, d):
    return B.blocking_stats(L.payments_of(spark, d), cap=CAP)


@registered(
    q.query(
        *_TX,
        q.capped_buckets(10**9),
        select="""
SELECT (SELECT count(*) FROM tx) AS rows_in, CAST(max(n) AS BIGINT) AS max_bucket,
  CAST(sum(n * (n - 1) / 2 * (CASE WHEN family IN ('via', 'vi') THEN 2 ELSE 1 END)) AS BIGINT)
    AS pair_comparisons
FROM (SELECT family, key, count(*) AS n FROM keyed GROUP BY ALL)""",
    )
)
def blocking_work_whole(spark, d):
    """What the default, complete comparison compares."""
    return B.blocking_stats(L.payments_of(spark, d))


@registered(
    q.query(
        *_TX,
        q.capped_buckets(CAP),
        """
left_out AS (
  SELECT family, key, CAST(sum(n) AS BIGINT) AS payments,
         CAST(sum(n) * (sum(n) - 1) / 2 - sum(n * (n - 1) / 2) AS BIGINT) AS pairs_not_compared
  FROM (SELECT family, key, sub, chunk, count(*) AS n FROM bucketed GROUP BY ALL)
  GROUP BY family, key)""",
        select="SELECT payments, pairs_not_compared, count(*) AS keys FROM left_out"
        " WHERE pairs_not_compared > 0 GROUP BY ALL",
    )
)
def blocking_uncompared(spark, d):
    """What a cap of 4 leaves out, by size of key."""
    left_out = B.uncompared(L.payments_of(spark, d), CAP)
    return left_out.groupBy("payments", "pairs_not_compared").agg(F.count("*").alias("keys"))


_HOT = "CAST(substr(transaction_id, 4) AS BIGINT) % 53 = 0"
_HOT_LEDGER = q.LEDGER.replace("ledger AS (", "plain AS (", 1) + f""",
ledger AS (SELECT * REPLACE (
  CASE WHEN {_HOT} THEN 'Hot Vendor Inc.' ELSE vendor_name_raw END AS vendor_name_raw,
  CASE WHEN {_HOT} THEN 'INV-77' ELSE invoice_number_raw END AS invoice_number_raw) FROM plain)"""


@registered(
    q.query(
        _HOT_LEDGER, q.payments(), q.candidates(), select=f"SELECT {CAND} FROM cand"
    )
)
def blocking_hot_key(spark, d):
    """A key with a fiftieth of all payments: every pair of it is compared."""
    hot = F.substring("transaction_id", 4, 9).cast("bigint") % 53 == 0
    lines = L.lines_of(spark, d)
    lines = lines.withColumn(
        "vendor_name_raw", F.when(hot, "Hot Vendor Inc.").otherwise(F.col("vendor_name_raw"))
    ).withColumn("invoice_number_raw", F.when(hot, "INV-77").otherwise(F.col("invoice_number_raw")))
    return B.block(staged_payments(lines)).select(*CAND.split(", "))


_THIRD = "CAST(substr(transaction_id, 4) AS BIGINT) % 3 = 0"
_THIRD_LEDGER = _HOT_LEDGER.replace(_HOT, _THIRD)


@registered(
    q.query(
        _THIRD_LEDGER,
        q.payments(),
        q.capped_buckets(10**9),
        select="""
SELECT transaction_id, count(*) AS keys, CAST(max(n_key) AS BIGINT) AS largest
FROM sized WHERE n_key > 1 GROUP BY transaction_id""",
    )
)
def blocking_hot_third(spark, d):
    """Keys that payments share when a third of them share one, in linear size."""
    hot = F.substring("transaction_id", 4, 9).cast("bigint") % 3 == 0
    lines = L.lines_of(spark, d)
    lines = lines.withColumn(
        "vendor_name_raw", F.when(hot, "Hot Vendor Inc.").otherwise(F.col("vendor_name_raw"))
    ).withColumn("invoice_number_raw", F.when(hot, "INV-77").otherwise(F.col("invoice_number_raw")))
    groups = B.key_groups(staged_payments(lines))
    sizes = groups.groupBy("family", "key").agg(F.count("*").alias("n"))
    return (
        groups.join(sizes, ["family", "key"])
        .groupBy("transaction_id")
        .agg(F.count("*").alias("keys"), F.max("n").alias("largest"))
    )


@registered(q.query(*_CANDS, select="SELECT signal, count(*) AS candidates FROM cand GROUP BY signal"))
def candidates_by_signal(spark, d):
    return B.candidates_by_signal(B.block(L.payments_of(spark, d)))


@registered(
    q.query(
        *_CANDS,
        select="""
SELECT CAST(sum(n) AS BIGINT) AS candidates, count(*) AS distinct_pairs,
  CAST(sum(s) AS DECIMAL(28,2)) AS dollars_at_risk,
  CAST(sum(m) AS DECIMAL(28,2)) AS dollars_at_risk_distinct
FROM (SELECT count(*) AS n, sum(amount_at_risk) AS s, max(amount_at_risk) AS m
      FROM cand GROUP BY left_id, right_id)""",
    )
)
def dollars_at_risk_totals(spark, d):
    return dollars_at_risk(
        B.block(L.payments_of(spark, d)), lone_signals(default_signals(Capabilities()))
    )


# --- rules -----------------------------------------------------------------


def _evidence_text():
    def item(e):
        return F.concat(e["field"], F.lit("="), F.array_join(e["values"], "|"))

    return F.array_join(F.transform("evidence", item), ";")


_SIDE = {
    "vendor_canonical": "{0}.vendor_canonical",
    "invoice_canonical": "{0}.invoice_canonical",
    "amount": "CAST({0}.amount AS VARCHAR)",
    "po_number": "{0}.po_number",
    "payment_date": "CAST({0}.payment_date AS VARCHAR)",
    "payment_status": "{0}.payment_status",
    "department": "{0}.department",
    "description": "{0}.description",
}
_FINDING_TEXT = "'signal=' || c.signal || ';amount_at_risk=' || c.amount_at_risk" + "".join(
    f" || ';{k}=' || coalesce({v.format('l')}, '') || '|' || coalesce({v.format('r')}, '')"
    for k, v in _SIDE.items()
)
_RULE_TEXT = (
    "CASE c.rule WHEN 'cancelled' THEN 'payment_status=' || coalesce(l.payment_status, '')"
    " || '|' || coalesce(r.payment_status, '')"
    " WHEN 'line_split' THEN 'line_count=' || l.line_count || '|' || r.line_count"
    " || ';distinct_line_amounts=' || array_to_string(l.amounts, ',') || '|'"
    f" || array_to_string(r.amounts, ',') ELSE {_FINDING_TEXT} END"
)
_PAIRED = "FROM ruled c JOIN tx l ON c.left_id = l.transaction_id JOIN tx r ON c.right_id = r.transaction_id"
_VERDICTS = (
    "SELECT candidate_id, CASE WHEN rule IS NULL THEN 'escalate' ELSE 'dismiss' END AS verdict,"
    " coalesce(rule, 'none') AS explanation_type,"
    " CASE WHEN rule IS NULL THEN NULL ELSE 1.0::DOUBLE END AS confidence,"
    " CASE WHEN rule IS NULL THEN NULL ELSE 'deterministic' END AS model_used,"
    f" {_RULE_TEXT} AS evidence_text {_PAIRED}"
)


@registered(q.query(*_RULED, select=_VERDICTS))
def rules_only_findings(spark, d):
    """Flagship: which payments look paid twice, and what no rule explains."""
    return rules_only(L.lines_of(spark, d)).select(
        "candidate_id",
        "verdict",
        "explanation_type",
        "confidence",
        "model_used",
        _evidence_text().alias("evidence_text"),
    )


@registered(q.query(*_RULED, select="SELECT candidate_id, rule AS explanation_type FROM ruled WHERE rule IS NOT NULL"))
def dismissals(spark, d):
    payments = L.payments_of(spark, d)
    candidates = rule_candidates(payments)
    return dismiss(candidates, payments)[1].select("candidate_id", "explanation_type")


@registered(q.query(*_RULED, select=f"SELECT {CAND} FROM ruled WHERE rule IS NULL"))
def residual(spark, d):
    payments = L.payments_of(spark, d)
    candidates = rule_candidates(payments)
    return dismiss(candidates, payments)[0].select(*CAND.split(", "))


@registered(
    q.query(*_RULED, select="SELECT rule AS explanation_type, count(*) AS dismissed FROM ruled WHERE rule IS NOT NULL GROUP BY rule")
)
def dismissal_counts(spark, d):
    payments = L.payments_of(spark, d)
    candidates = rule_candidates(payments)
    return dismissals_by_explanation(dismiss(candidates, payments)[1])


@registered(
    q.query(
        *_RULED,
        select="SELECT (SELECT count(*) FROM ledger) AS rows_in,"
        " (SELECT count(*) FROM tx) AS transactions, (SELECT count(*) FROM cand) AS candidates,"
        " (SELECT count(*) FROM ruled WHERE rule IS NULL) AS after_dismiss,"
        " (SELECT count(*) FROM ruled WHERE rule IS NULL) AS after_adjudicate",
    )
)
def stage_funnel(spark, d):
    run = rules_only_run(L.lines_of(spark, d))
    left = survivors(run.residual, run.verdicts)
    return funnel(run.lines, run.payments, run.candidates, run.residual, left)


# --- adjudication ----------------------------------------------------------

_KIND = "CAST(substr(c.left_id, 10, 1) AS INTEGER)"
_JUDGED = f"""
judged AS (
  SELECT c.candidate_id, {_KIND} AS k FROM ruled c WHERE rule IS NULL
),
answered AS (
  SELECT candidate_id, k,
    CASE WHEN k <= 2 THEN 'escalate' WHEN k <= 5 THEN 'dismiss' ELSE 'errored' END AS verdict,
    CASE WHEN k IN (3, 4) THEN 'different_po' WHEN k = 5 THEN 'recurring' ELSE 'none' END
      AS explanation_type,
    CASE WHEN k <= 2 THEN 0.9 WHEN k <= 4 THEN 0.8 WHEN k = 5 THEN 0.95 ELSE 0.0 END::DOUBLE
      AS confidence,
    CASE WHEN k IN (5, 6) THEN 'careful-model' ELSE 'fast-model' END AS model_used,
    CASE WHEN k <= 2 OR k = 6 THEN 100 WHEN k <= 4 THEN 90 WHEN k = 5 THEN 150 ELSE 0 END::BIGINT
      AS tokens_in,
    CASE WHEN k <= 2 OR k = 6 THEN 20 WHEN k <= 4 THEN 10 WHEN k = 5 THEN 25 ELSE 0 END::BIGINT
      AS tokens_out,
    CASE WHEN k <= 2 OR k IN (5, 6) THEN 5 WHEN k <= 4 THEN 7 ELSE 0 END::BIGINT AS cache_read,
    k IN (6, 9) AS unmatched,
    CASE WHEN k <= 2 THEN 'po_number=a' WHEN k <= 4 THEN 'po_number=a|b|c|None|3'
      WHEN k = 5 THEN 'po_number=' ELSE '' END AS evidence_text
  FROM judged
)"""


def _adjudicated(spark, d):
    payments = L.payments_of(spark, d)
    left, dismissed = dismiss(rule_candidates(payments), payments)
    left = stage(left, "residual")
    requests = A.build_requests(left, payments, L.CONFIG)
    recordings = L.recordings_for(requests.join(left.select("candidate_id", "left_id"), "candidate_id"))
    judged = A.adjudicate(left, payments, recordings, L.CONFIG)
    return judged, dismissed


@registered(
    q.query(
        *_RULED,
        _JUDGED,
        select="SELECT candidate_id, verdict, explanation_type, confidence, model_used, tokens_in,"
        " tokens_out, cache_read, unmatched, evidence_text FROM answered",
    )
)
def replayed_verdicts(spark, d):
    judged, _ = _adjudicated(spark, d)
    return judged.select(
        "candidate_id", "verdict", "explanation_type", "confidence", "model_used", "tokens_in",
        "tokens_out", "cache_read", A.is_unmatched().alias("unmatched"),
        _evidence_text().alias("evidence_text"),
    )


@registered(
    q.query(
        *_RULED,
        _JUDGED,
        select="""
SELECT count(*) AS rows_in, count(*) FILTER (verdict = 'dismiss') AS dismissed,
  count(*) FILTER (verdict = 'escalate') AS escalated,
  count(*) FILTER (verdict = 'errored' AND NOT unmatched) AS errored,
  count(*) FILTER (unmatched) AS unmatched_recordings,
  count(*) FILTER (verdict = 'dismiss' OR verdict = 'errored') = 0 AS passed_through
FROM answered""",
    )
)
def adjudication_counts(spark, d):
    return A.adjudication_summary(_adjudicated(spark, d)[0])


@registered(
    q.query(
        *_RULED,
        _JUDGED,
        select=f"""
SELECT tokens_in, tokens_out, cache_read, round(rate, 6) AS cache_hit_rate, token_cost,
  round(routed, 6) AS model_escalation_rate, escalate, dismiss, errored
FROM (
  SELECT CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
    CAST(sum(cache_read) AS BIGINT) AS cache_read,
    {q.ratio('sum(cache_read)', 'sum(tokens_in)')} AS rate,
    CAST(sum(CASE WHEN model_used = 'careful-model' THEN tokens_in * 15.0 + tokens_out * 60.5
      ELSE tokens_in * 0.25 + tokens_out * 1.25 END) / 1000000 AS DECIMAL(18,6)) AS token_cost,
    {q.ratio("count(*) FILTER (model_used = 'careful-model')", 'count(*)')} AS routed,
    count(*) FILTER (verdict = 'escalate') AS escalate,
    count(*) FILTER (verdict = 'dismiss') + (SELECT count(*) FROM ruled WHERE rule IS NOT NULL)
      AS dismiss,
    count(*) FILTER (verdict = 'errored') AS errored
  FROM answered)""",
    )
)
def run_statistics(spark, d):
    judged, dismissed = _adjudicated(spark, d)
    stats = S.run_stats(
        dismissed.unionByName(judged),
        L.CONFIG.model_fast,
        L.CONFIG.model_escalate,
        ("0.25", "1.25"),
        ("15", "60.5"),
    )
    return stats.withColumns(
        {c: F.round(c, 6) for c in ("cache_hit_rate", "model_escalation_rate")}
    )


@registered(
    q.query(
        *_RULED,
        _JUDGED,
        select="SELECT count(*) AS open_requests FROM answered WHERE k IN (9)",
    )
)
def open_requests(spark, d):
    """Requests a live model would still have to answer: those not recorded."""
    payments = L.payments_of(spark, d)
    left = stage(dismiss(rule_candidates(payments), payments)[0], "residual")
    requests = A.build_requests(left, payments, L.CONFIG)
    known = L.recordings_for(requests.join(left.select("candidate_id", "left_id"), "candidate_id"))
    answered = A.record_answers(
        requests, known, L.CONFIG.model_fast, L.CONFIG, lambda texts: texts.map(lambda _: "{}")
    )
    return answered.agg(F.count(F.lit(1)).alias("open_requests"))


_DESCRIBED = """
described AS (
  SELECT * REPLACE (CASE (CAST(substr(transaction_id, 4) AS BIGINT) + ascii(transaction_id)) % 6
      WHEN 0 THEN 'Progress payment ' || ((CAST(substr(transaction_id, 4) AS BIGINT) + ascii(transaction_id)) % 5 + 1) || ' of 5'
      WHEN 1 THEN 'Partial payment, balance outstanding'
      WHEN 2 THEN 'Cancelled by issuer'
      WHEN 3 THEN 'GL distribution line ' || ((CAST(substr(transaction_id, 4) AS BIGINT) + ascii(transaction_id)) % 2 + 1) || ' of 2'
      ELSE 'Services' END AS description) FROM tx
)"""
_SERIES = """
dated AS (
  SELECT vk, amount, invoice_date AS day, count(*) AS payments,
    year(invoice_date) * 12 + month(invoice_date) AS month
  FROM tx WHERE vk IS NOT NULL AND invoice_date IS NOT NULL GROUP BY ALL
),
series AS (
  SELECT vk, amount, day, payments,
    month - lag(month) OVER (PARTITION BY vk, amount ORDER BY day) AS gap
  FROM dated
),
summary AS (
  SELECT vk, amount, CAST(sum(payments) AS BIGINT) AS related_payments, count(*) AS related_dates,
    min(day) AS first_date, max(day) AS last_date, min(gap) AS min_gap_months,
    max(gap) AS max_gap_months
  FROM series GROUP BY vk, amount
)"""


def _part(side: str, words: str, n: int) -> str:
    return f"regexp_extract({side}.description, '(?i)\\b{words}\\s+(\\d+)\\s+of\\s+(\\d+)\\b', {n})"


def _parts(words: str) -> str:
    l1, r1, l2, r2 = (_part(s, words, n) for n in (1, 2) for s in ("l", "r"))
    return f"{l1} <> '' AND {r1} <> '' AND {l2} = {r2} AND {l1} <> {r1}"


@registered(
    q.query(
        *_TX,
        _DESCRIBED,
        q.candidates(),
        _SERIES,
        select=f"""
SELECT c.candidate_id,
  coalesce(regexp_matches(l.description, '(?i)\\b(cancel|void|revers)')
    OR regexp_matches(r.description, '(?i)\\b(cancel|void|revers)') OR l.amount = -r.amount, FALSE)
    AS cancelled,
  coalesce({q.SAME_INVOICE} AND ((l.line_count >= 2 AND r.line_count >= 2 AND l.amounts <> r.amounts)
    OR ({_parts('line')})), FALSE) AS line_split,
  coalesce({_parts('(?:progress payment|draw|instal?lment)')}, FALSE) AS progress_payment,
  coalesce(l.vendor_canonical = r.vendor_canonical AND l.amount = r.amount
    AND l.invoice_canonical IS DISTINCT FROM r.invoice_canonical AND s.related_dates >= 3
    AND s.min_gap_months >= 1 AND s.min_gap_months = s.max_gap_months, FALSE) AS recurring,
  coalesce(l.po_number <> r.po_number, FALSE) AS different_po,
  coalesce(levenshtein(l.po_number, r.po_number) = 1, FALSE) AS po_one_digit,
  coalesce({q.SAME_INVOICE} AND l.amount + r.amount = least(l.invoice_amount, r.invoice_amount)
    AND (regexp_matches(l.description, '(?i)\\b(partial|balance|remain)')
      OR regexp_matches(r.description, '(?i)\\b(partial|balance|remain)')), FALSE) AS partial_pair,
  coalesce(l.amount + r.amount > least(l.invoice_amount, r.invoice_amount)
    AND (least(l.amount, r.amount) > 0
      OR greatest(l.amount, r.amount) > least(l.invoice_amount, r.invoice_amount)), FALSE)
    AS arithmetic_veto
FROM cand c JOIN described l ON c.left_id = l.transaction_id
JOIN described r ON c.right_id = r.transaction_id
LEFT JOIN summary s ON s.vk = l.vk AND s.amount = l.amount""",
    )
)
def explanation_tests(spark, d):
    payments = L.with_descriptions(L.payments_of(spark, d))
    return explain_candidates(explained_candidates(payments), payments)


@registered(
    q.query(
        *_CANDS,
        _SERIES,
        select="SELECT c.candidate_id, l.vk AS vendor_key, l.amount, related_payments,"
        " related_dates, first_date, last_date, min_gap_months, max_gap_months FROM cand c"
        " JOIN tx l ON c.left_id = l.transaction_id"
        " LEFT JOIN summary s ON s.vk = l.vk AND s.amount = l.amount",
    )
)
def related_series(spark, d):
    payments = L.payments_of(spark, d)
    return related_payments(series_candidates(payments), payments)


@registered(
    q.query(
        *_TX,
        _SERIES,
        select="SELECT vk AS vendor_key, amount, day, payments, gap AS months_since_previous FROM series",
    )
)
def payment_rhythm(spark, d):
    return payment_series(L.payments_of(spark, d))


# --- scoring ---------------------------------------------------------------

_TRUTH = """
truth AS (
  SELECT 'dup-' || num AS case_id, 'duplicate' AS kind, 'exact_duplicate' AS label,
    'DUP' || num AS a, 'ORD' || num AS b, CAST(o_orderkey % 1000 AS DECIMAL(18,2)) AS amount
  FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS num FROM orders)
  WHERE o_orderkey % 20 = 0
  UNION ALL
  SELECT 'decoy-' || num, 'decoy',
    ['cancelled', 'line_split', 'recurring'][(o_orderkey // 30) % 3 + 1], 'SPL' || num,
    'ORD' || num, NULL
  FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS num FROM orders)
  WHERE o_orderkey % 30 = 0
),
flagged AS (
  SELECT left_id, right_id, max(amount_at_risk) AS risk FROM ruled WHERE rule IS NULL
  GROUP BY left_id, right_id
),
cases AS (
  SELECT t.*, f.left_id IS NOT NULL AS hit, f.risk
  FROM truth t LEFT JOIN flagged f ON f.left_id = least(a, b) AND f.right_id = greatest(a, b)
)"""


def _scored_cases(spark, d) -> DataFrame:
    payments = L.payments_of(spark, d)
    return _hits(payments, L.truth_from_orders(spark, d))


def _hits(payments: DataFrame, truth: DataFrame) -> DataFrame:
    """The labelled cases, with what the rules flag of all candidates."""
    with_cases = S.with_cases(payments, truth)
    candidates = rule_candidates(with_cases, fields=(*SHOWN_FIELDS, S.CASES))
    judged = judged_candidates(candidates, with_cases)
    return S.case_hits(S.flagged_pairs(S.inside_cases(judged)), truth)


@registered(
    q.query(
        *_RULED,
        _TRUTH,
        select="""
SELECT true_positives, false_positives, true_cases, dollars_correct, dollars_wrong,
  round("precision", 6) AS "precision", round(recall, 6) AS recall,
  round(CASE WHEN "precision" + recall = 0 THEN 0.0 ELSE 2 * "precision" * recall / ("precision" + recall) END, 6) AS f1
FROM (SELECT *, CASE WHEN true_positives + false_positives = 0 THEN 0.0
        ELSE true_positives::DOUBLE / (true_positives + false_positives) END AS "precision",
        CASE WHEN true_cases = 0 THEN 0.0 ELSE true_positives::DOUBLE / true_cases END AS recall
  FROM (SELECT count(*) FILTER (kind = 'duplicate' AND hit) AS true_positives,
      count(*) FILTER (kind = 'decoy' AND hit) AS false_positives,
      count(*) FILTER (kind = 'duplicate') AS true_cases,
      CAST(coalesce(sum(amount) FILTER (kind = 'duplicate' AND hit), 0) AS DECIMAL(28,2)) AS dollars_correct,
      CAST(coalesce(sum(risk) FILTER (kind = 'decoy' AND hit), 0) AS DECIMAL(28,2)) AS dollars_wrong
    FROM cases))""",
    )
)
def detection_score(spark, d):
    score = S.detection_score(_scored_cases(spark, d))
    return score.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@registered(
    q.query(
        *_RULED,
        _TRUTH,
        select="SELECT reason, (SELECT count(*) FROM cases WHERE kind = 'decoy' AND hit"
        " AND label = reason) AS false_positives FROM (SELECT unnest(['cancelled', 'line_split',"
        " 'progress_payment', 'recurring', 'different_po', 'partial_pair']) AS reason)",
    )
)
def false_positives_by_reason(spark, d):
    return S.false_positives_by_reason(_scored_cases(spark, d))


@registered(
    q.query(
        *_RULED,
        _TRUTH,
        select="SELECT count(*) AS unlabelled_findings FROM flagged WHERE left_id NOT IN"
        " (SELECT a FROM truth UNION SELECT b FROM truth) AND right_id NOT IN"
        " (SELECT a FROM truth UNION SELECT b FROM truth)",
    )
)
def unlabelled_findings(spark, d):
    verdicts = rules_only(L.lines_of(spark, d))
    return S.unlabelled_findings(verdicts, L.truth_from_orders(spark, d))


@registered(
    q.query(
        q.LEDGER,
        f"named AS (SELECT {q.vendor_key('vendor_name_raw')} AS key, vendor_id FROM ledger)",
        "agg AS (SELECT key, vendor_id, CAST(count(*) AS DOUBLE) AS n FROM named WHERE key IS NOT NULL GROUP BY ALL)",
        "tot AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM agg) AS t,"
        " (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM agg GROUP BY key)) AS p,"
        " (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM agg GROUP BY vendor_id)) AS g)",
        select='SELECT round(t / p, 6) AS "precision", round(t / g, 6) AS recall,'
        " round(2 * (t / p) * (t / g) / (t / p + t / g), 6) AS f1, CAST(t AS BIGINT) AS true_pairs,"
        " CAST(p AS BIGINT) AS predicted_pairs, CAST(g AS BIGINT) AS gold_pairs FROM tot",
    )
)
def entity_resolution(spark, d):
    score = S.entity_resolution(L.lines_of(spark, d))
    whole = {c: F.col(c).cast("bigint") for c in ("true_pairs", "predicted_pairs", "gold_pairs")}
    rounded = {c: F.round(c, 6) for c in ("precision", "recall", "f1")}
    return score.withColumns({**whole, **rounded})


@registered()
def planted_cases_score(spark, d):
    """Plant labelled cases into the derived ledger, run the rules, score them."""
    ledger, truth = plant_cases(L.lines_of(spark, d))
    ledger, truth = stage(ledger, "planted-ledger"), stage(truth, "truth")
    return S.detection_score(_hits(staged_payments(ledger), truth))


# --- review and packets ----------------------------------------------------

_DECIDED = """
decided AS (
  SELECT candidate_id, 'R. Viewer' AS approver,
    CASE WHEN CAST(substr(left_id, 10, 1) AS INTEGER) % 2 = 0 THEN 'confirmed' ELSE 'dismissed' END
      AS decision,
    CAST(substr(left_id, 10, 1) AS INTEGER) % 3 = 0 AS becomes_rule
  FROM ruled WHERE rule IS NULL AND CAST(substr(left_id, 11, 1) AS INTEGER) <= 3
)"""
_PENDING = f"{_PAIRED} WHERE c.rule IS NULL AND c.candidate_id NOT IN (SELECT candidate_id FROM decided)"


def _open_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("verdict.verdict") == "escalate")


@registered(
    q.query(
        *_RULED,
        _DECIDED,
        select=f"""
SELECT c.candidate_id, c.amount_at_risk, {q.masked('l.vendor_name_raw')} AS vendor_name, c.signal,
  CAST(NULL AS DOUBLE) AS confidence, {q.approver('l.department')} AS approver,
  {q.title('l.department')} AS department, {q.money_label('c.amount_at_risk')} AS amount_label,
  upper(substr(c.signal, 1, 1)) || replace(substr(c.signal, 2), '_', ' ') AS signal_label,
  '—' AS confidence_label {_PENDING}""",
    )
)
def review_queue(spark, d):
    findings = L.findings_of(spark, d)
    decisions = L.decisions_on(_open_findings(findings))
    return R.in_queue_order(R.with_display_labels(R.review_queue(findings, decisions)))


_DIFFS = {
    "Vendor": (q.masked("l.vendor_name_raw"), q.masked("r.vendor_name_raw")),
    "Amount": tuple(q.money_label(f"{s}.amount") for s in "lr"),
    "Invoice": ("l.invoice_number_raw", "r.invoice_number_raw"),
    "Invoice date": tuple(f"CAST({s}.invoice_date AS VARCHAR)" for s in "lr"),
    "Paid": tuple(f"CAST({s}.payment_date AS VARCHAR)" for s in "lr"),
    "Invoice amount": tuple(q.money_label(f"{s}.invoice_amount") for s in "lr"),
    "PO": ("l.po_number", "r.po_number"),
    "Method": ("l.payment_method", "r.payment_method"),
    "Status": ("l.payment_status", "r.payment_status"),
    "Department": ("l.department", "r.department"),
    "Description": ("l.description", "r.description"),
    "Id": ("l.transaction_id", "r.transaction_id"),
}
_DIFF_SQL = " UNION ALL ".join(
    f"SELECT c.candidate_id, '{k}' AS field, coalesce(nullif({a}, ''), '—') AS left_text,"
    f" coalesce(nullif({b}, ''), '—') AS right_text {_PAIRED}"
    for k, (a, b) in _DIFFS.items()
)


@registered(
    q.query(
        *_RULED,
        select=f"SELECT candidate_id, field, left_text, right_text, left_text <> right_text AS differs FROM ({_DIFF_SQL})",
    )
)
def field_diff(spark, d):
    diff = R.field_diff(L.findings_of(spark, d))
    return diff.withColumnsRenamed({"left": "left_text", "right": "right_text"})


@registered(
    q.query(
        *_RULED,
        _DECIDED,
        select=f"""
SELECT CAST(coalesce(sum(c.amount_at_risk), 0) AS DECIMAL(28,2)) AS dollars_at_risk,
  count(*) AS pending, (SELECT count(*) FROM decided WHERE decision = 'confirmed') AS confirmed,
  (SELECT count(*) FROM decided WHERE decision = 'dismissed') AS dismissed,
  'pipeline' AS data_source {_PENDING}""",
    )
)
def review_stats(spark, d):
    findings = L.findings_of(spark, d)
    return R.review_stats(findings, L.decisions_on(_open_findings(findings)))


@registered(
    q.query(
        *_RULED,
        _DECIDED,
        f"""
sent AS (
  SELECT c.candidate_id || '#' || n AS seq,
    CASE WHEN k = 2 AND n = 1 THEN 'x' || c.candidate_id ELSE c.candidate_id END AS candidate_id,
    CASE WHEN k = 1 AND n = 1 THEN 'maybe' ELSE 'confirmed' END AS decision,
    CASE WHEN k = 0 AND n = 1 THEN '' ELSE 'ok' END AS reason,
    d.candidate_id IS NOT NULL AS done, k, n, {q.approver('l.department')} AS approver
  FROM (SELECT *, CAST(substr(left_id, 10, 1) AS INTEGER) AS k FROM ruled) c
  JOIN tx l ON c.left_id = l.transaction_id
  LEFT JOIN decided d USING (candidate_id), (SELECT unnest([1, 2]) AS n)
  WHERE c.rule IS NULL
)""",
        select="""
SELECT seq, candidate_id, CASE WHEN k = 2 AND n = 1 THEN NULL ELSE approver END AS approver,
  decision, reason, TRUE AS becomes_rule,
  CASE WHEN k = 0 AND n = 1 THEN 'reason is required' WHEN k = 1 AND n = 1 THEN 'unknown decision'
    WHEN k = 2 AND n = 1 THEN 'unknown candidate' WHEN done THEN 'already decided'
    WHEN n = 2 AND k > 2 THEN 'already decided' END AS reject_reason
FROM sent""",
    )
)
def decisions_intake(spark, d):
    findings = stage(L.findings_of(spark, d), "findings")
    waiting = _open_findings(findings)
    k = L.digit("left_id", 10)
    first = F.col("n") == 1
    submitted = waiting.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.concat("candidate_id", F.lit("#"), F.col("n").cast("string")).alias("seq"),
        F.when((k == 2) & first, F.concat(F.lit("x"), "candidate_id"))
        .otherwise(F.col("candidate_id"))
        .alias("candidate_id"),
        F.lit(" ").alias("approver"),
        F.when((k == 1) & first, "maybe").otherwise("confirmed").alias("decision"),
        F.when((k == 0) & first, " ").otherwise(" ok ").alias("reason"),
        F.lit(None).cast("boolean").alias("becomes_rule"),
    )
    return R.intake_decisions(submitted, waiting, L.decisions_on(waiting))


@registered(
    q.query(
        *_RULED,
        _DECIDED,
        select="""
SELECT c.candidate_id, s.side, CASE s.side WHEN 'debit' THEN 'Due from supplier — ' ||
    CASE WHEN l.vendor_name_raw = r.vendor_name_raw THEN l.vendor_name_raw
      ELSE l.vendor_name_raw || ' / ' || r.vendor_name_raw END
    ELSE 'Expenditure recovery' END AS account, c.amount_at_risk AS amount
FROM ruled c JOIN decided d ON c.candidate_id = d.candidate_id AND d.decision = 'confirmed'
JOIN tx l ON c.left_id = l.transaction_id JOIN tx r ON c.right_id = r.transaction_id,
  (SELECT unnest(['debit', 'credit']) AS side) s""",
    )
)
def journal_entries(spark, d):
    findings = L.findings_of(spark, d)
    confirmed = K.confirmed_findings(findings, L.decisions_on(_open_findings(findings)))
    return K.journal_entries(confirmed)


@registered(
    q.query(
        *_RULED,
        _DECIDED,
        select=f"""
SELECT c.candidate_id, s.step, ['aggregate', 'normalize', 'blocking', 'dismiss', 'adjudicate',
    'review'][s.step] AS stage, '2024-06-01 12:00:00 UTC' AS concluded_at,
  CASE s.step
    WHEN 1 THEN 'Distribution lines were summed per payment for ' || c.left_id || ' and ' || c.right_id || '.'
    WHEN 2 THEN 'Vendor key ' || l.vendor_canonical || '; invoice key ' || l.invoice_canonical || '.'
    WHEN 3 THEN 'Candidate ' || c.candidate_id || ' raised by blocking on signal ' || c.signal
      || ', amount at risk ' || {q.money_label('c.amount_at_risk')} || '.'
    WHEN 4 THEN 'No deterministic rule dismissed the pair; it stayed for adjudication.'
    WHEN 5 THEN 'Verdict escalate (none), confidence not given. No fixed rule (cancelled, same transaction, line split) explains the pair; rules cannot weigh it further, so it is reported.'
    ELSE 'Confirmed by R. Viewer. Reason: checked the file. Becomes rule: '
      || CASE WHEN d.becomes_rule THEN 'yes' ELSE 'no' END || '.' END AS conclusion
FROM ruled c JOIN decided d ON c.candidate_id = d.candidate_id AND d.decision = 'confirmed'
JOIN tx l ON c.left_id = l.transaction_id JOIN tx r ON c.right_id = r.transaction_id,
  (SELECT unnest([1, 2, 3, 4, 5, 6]) AS step) s""",
    )
)
def audit_trail(spark, d):
    findings = L.findings_of(spark, d)
    confirmed = K.confirmed_findings(findings, L.decisions_on(_open_findings(findings)))
    issued = F.to_utc_timestamp(F.lit("2024-06-01 12:00:00").cast("timestamp"), "UTC")
    return K.audit_trail(confirmed, issued)


_REF = "{0}.transaction_id || ' (invoice ' || {0}.invoice_number_raw || ')'"


@registered(
    q.query(
        *_RULED,
        _DECIDED,
        select=f"""
SELECT c.candidate_id AS packet_id, split_part(t, '@', 1) AS subject, t AS lines FROM (
  SELECT c.candidate_id, 'Subject: Please review payments ' || {_REF.format('l')} || ' and '
    || {_REF.format('r')} || '@- ' || {_REF.format('l')} || ', dated '
    || strftime(l.payment_date, '%B %-d, %Y') || ', amount ' || {q.money_label('l.amount')}
    || '@- ' || {_REF.format('r')} || ', dated ' || strftime(r.payment_date, '%B %-d, %Y')
    || ', amount ' || {q.money_label('r.amount')} AS t
  FROM ruled c JOIN decided d ON c.candidate_id = d.candidate_id AND d.decision = 'confirmed'
  JOIN tx l ON c.left_id = l.transaction_id JOIN tx r ON c.right_id = r.transaction_id) c""",
    )
)
def packet_letters(spark, d):
    """Subject and payment lines of each letter, picked out of the whole text."""
    findings = stage(L.findings_of(spark, d), "findings")
    issued = F.to_timestamp(F.lit("2024-06-01 12:00:00"))
    packets = K.build_packets(findings, L.decisions_on(_open_findings(findings)), issued)
    rows = F.split("letter", "\n")
    subject = rows[0]
    listed = F.filter(rows, lambda x: x.startswith("- "))
    lines = F.array_join(F.concat(F.array(subject), listed), "@")
    return packets.select("packet_id", subject.alias("subject"), lines.alias("lines"))


@registered(
    q.query(
        *_RULED,
        select="SELECT 'pipeline' AS data_source, count(*) AS findings,"
        " CAST(sum(amount_at_risk) AS DECIMAL(28,2)) AS dollars,"
        " (SELECT count(*) FROM ledger) AS rows_in, (SELECT count(*) FROM tx) AS transactions"
        " FROM ruled",
    )
)
def queue_snapshot(spark, d):
    """A queue written out and read back, with its funnel."""
    run = rules_only_run(L.lines_of(spark, d))
    shown = rule_candidates(run.payments, fields=R.PAYMENT_FIELDS)
    findings = R.rules_only_findings(shown, run.payments)
    path = _scratch(spark, "queue")
    counts = funnel(run.lines, run.payments, run.candidates, run.residual, run.residual)
    sinks.write_queue(findings, counts, path)
    kept, kept_counts, source = sinks.read_queue(spark, path)
    none, zero = F.lit(None).cast("decimal(28,2)"), F.lit(None).cast("bigint")
    totals = kept.agg(
        F.count(F.lit(1)).alias("findings"),
        F.sum("amount_at_risk").cast("decimal(28,2)").alias("dollars"),
        zero.alias("rows_in"),
        zero.alias("transactions"),
    ).unionByName(
        kept_counts.select(zero.alias("findings"), none.alias("dollars"), "rows_in", "transactions")
    )
    sums = [F.sum(c).cast("decimal(28,2)" if c == "dollars" else "bigint").alias(c) for c in totals.columns]
    return totals.agg(*sums).select(F.lit(source).alias("data_source"), "*")


@registered(
    f"WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' Supply'"
    f" WHEN 2 THEN ' ' || p_name || ', o''neil-jr ' ELSE p_name || ' a b c' END AS name FROM part)"
    f" SELECT p_partkey AS id, {q.masked('name')} AS shown FROM n"
)
def masked_names(spark, d):
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name")
    which = F.col("p_partkey") % 4
    name = (
        F.when(which == 0, F.col("p_name"))
        .when(which == 1, F.concat("p_name", F.lit(" Supply")))
        .when(which == 2, F.concat(F.lit(" "), "p_name", F.lit(", o'neil-jr ")))
        .otherwise(F.concat("p_name", F.lit(" a b c")))
    )
    return parts.select(F.col("p_partkey").alias("id"), N.mask_personal_name(name).alias("shown"))


_UNIT = (
    "CASE c_custkey % 7 WHEN 0 THEN ' public   works ' WHEN 1 THEN 'Recreation and Parks'"
    " WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'office of the ' || c_mktsegment"
    " WHEN 5 THEN lower(c_mktsegment) || '-and-supply' ELSE 'unit ' || c_custkey END"
)


@registered(
    f"WITH u AS (SELECT c_custkey, {_UNIT} AS unit FROM customer) SELECT c_custkey AS id,"
    f" {q.approver('unit')} AS approver, {q.title('unit')} AS department FROM u"
)
def department_routing(spark, d):
    customers = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment")
    unit = F.expr(_UNIT)
    return customers.select(
        F.col("c_custkey").alias("id"),
        N.approver_for(unit).alias("approver"),
        N.title_department(unit).alias("department"),
    )


@registered(
    f"SELECT c_custkey AS id, {q.money_label('CAST(c_acctbal * 1000 AS DECIMAL(18,2))')} AS label FROM customer"
)
def money_labels(spark, d):
    customers = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal")
    amount = (F.col("c_acctbal") * 1000).cast("decimal(18,2)")
    return customers.select(F.col("c_custkey").alias("id"), money_label(amount).alias("label"))


@registered(
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'date not recorded'"
    " ELSE strftime(o_orderdate, '%B %-d, %Y') END AS label FROM orders"
)
def date_labels(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderdate")
    day = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("date"))
    paid = F.when(F.col("o_orderkey") % 3 == 1, day)
    return orders.select(
        F.col("o_orderkey").alias("id"), payment_date_label(paid, day).alias("label")
    )


# --- incremental -----------------------------------------------------------

_NEW = "CAST(substr(transaction_id, 4) AS BIGINT) % 10 = 5"


@registered(
    q.query(
        *_RULED,
        "touched AS MATERIALIZED (SELECT DISTINCT transaction_id FROM ledger"
        f" WHERE {_NEW} AND invoice_amount >= 25)",
        "unjudged AS MATERIALIZED (SELECT * FROM ruled WHERE rule IS NULL)",
        "due AS (SELECT c.* FROM unjudged c LEFT JOIN touched a ON a.transaction_id = c.left_id"
        " LEFT JOIN touched b ON b.transaction_id = c.right_id"
        " WHERE a.transaction_id IS NOT NULL OR b.transaction_id IS NOT NULL)",
        select=f"SELECT {CAND} FROM due",
    )
)
def new_candidates(spark, d):
    """Late lines of some payments; pairs the rules dismissed count as judged."""
    lines = stage(L.lines_of(spark, d), "lines")
    late = (F.substring("transaction_id", 4, 9).cast("bigint") % 10 == 5) & (
        F.col("invoice_amount") >= 25
    )
    payments = staged_payments(lines)
    candidates = stage(B.block(payments), "candidates")
    verdicts = dismiss(candidates, payments)[1].select("candidate_id")
    judged = candidates.join(verdicts, "candidate_id", "left_semi")
    found = incremental_candidates(lines.filter(late), lines.filter(~late), judged)
    return found.select(*CAND.split(", "))


@registered(q.query(*_CANDS, select=f"SELECT {CAND} FROM cand"))
def streamed_candidates(spark, d):
    """The ledger in three streamed batches ends where one full run does."""
    lines = L.lines_of(spark, d)
    source, home = _scratch(spark, "arriving"), _scratch(spark, "feed")
    # Lines of one payment arrive in different batches.
    part = F.pmod(F.xxhash64("transaction_id", "amount", "payment_method"), F.lit(3))
    arriving = lines.repartition(3, part)
    arriving.write.parquet(source)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(source)
    feed = CandidateFeed(spark, home)
    feed.start(stream, f"{home}/checkpoint").awaitTermination()
    return feed.current().select(*CAND.split(", "))


@registered(
    q.query(
        *_RULED,
        _DECIDED,
        """
shape AS (
  SELECT c.*, c.signal || '~' || least(l.vk || '^' || coalesce(l.invoice_canonical, l.amount::VARCHAR),
      r.vk || '^' || coalesce(r.invoice_canonical, r.amount::VARCHAR)) || '~' ||
    greatest(l.vk || '^' || coalesce(l.invoice_canonical, l.amount::VARCHAR),
      r.vk || '^' || coalesce(r.invoice_canonical, r.amount::VARCHAR)) AS sig
  FROM ruled c JOIN tx l ON c.left_id = l.transaction_id
  JOIN tx r ON c.right_id = r.transaction_id WHERE c.rule IS NULL
)""",
        select="SELECT candidate_id FROM shape WHERE sig NOT IN (SELECT sig FROM shape JOIN decided"
        " USING (candidate_id) WHERE decision = 'dismissed' AND becomes_rule)",
    )
)
def reviewer_rules(spark, d):
    """Residual candidates left after dismissals that became rules."""
    payments = L.payments_of(spark, d)
    left = stage(dismiss(rule_candidates(payments), payments)[0], "residual")
    remaining, _ = apply_decision_rules(left, payments, left, L.decisions_on(left))
    return remaining.select("candidate_id")


# Registers the rest; it builds on what stands above.
from checks import whole_results as _whole_results  # noqa: E402, F401
