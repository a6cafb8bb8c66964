"""ANSI SQL for the same results, built from common table expressions."""

from __future__ import annotations

from payrecheck.functions.names import APPROVERS, BUSINESS_WORDS, FALLBACK_ROSTER

_SUFFIXES = "INC|LLC|LTD|CORP|CORPORATION|CO|COMPANY|LP|LLP|THE"


def vendor_key(name: str) -> str:
    words = f"string_split(upper(trim(regexp_replace({name}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
    kept = f"array_to_string(list_filter({words}, lambda w: w <> '' AND w <> 'AND'), ' ')"
    no_the = f"regexp_replace({kept}, '^(THE( |$))+', '')"
    no_form = f"regexp_replace({no_the}, '((^| )({_SUFFIXES}))+$', '')"
    return f"nullif(replace({no_form}, ' ', ''), '')"


def invoice_key(number: str) -> str:
    text = f"upper(trim({number}))"
    bare = (
        f"CASE WHEN regexp_matches({text}, '^INV([^A-Z]|$)') THEN substr({text}, 4) ELSE {text} END"
    )
    compact = f"regexp_replace({bare}, '[^A-Z0-9]+', '', 'g')"
    return (
        f"CASE WHEN {compact} <> '' THEN"
        f" coalesce(nullif(regexp_replace({compact}, '^0+', ''), ''), '0') END"
    )


LEDGER = """
base AS (
  SELECT o_orderkey, o_custkey, c_name, o_orderstatus, o_orderpriority, l_returnflag,
         CAST(o_orderdate AS DATE) AS day, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
         lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS num,
         lpad(CAST(o_orderkey % 400 AS VARCHAR), 6, '0') AS digits
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
),
entries AS (
  SELECT *, 'ORD' || num AS transaction_id, c_name || ' Inc.' AS vendor_name_raw,
         'INV-' || digits AS invoice_number_raw, qty AS amount, o_orderpriority AS department
  FROM base
  UNION ALL
  SELECT *, 'DUP' || num, upper(c_name) || ', LLC', 'inv ' || digits, qty,
         CASE WHEN o_orderkey % 3 = 0 THEN 'OTHER' ELSE o_orderpriority END
  FROM base WHERE o_orderkey % 20 = 0
  UNION ALL
  SELECT *, 'SPL' || num, c_name || ' Inc.', 'INV-' || digits, CAST(qty * 2 AS DECIMAL(18,2)),
         o_orderpriority
  FROM base WHERE o_orderkey % 30 = 0
  UNION ALL
  SELECT *, 'FUZ' || num, c_name || ' Inc. Holdings', 'INV-' || digits, qty, o_orderpriority
  FROM base WHERE o_orderkey % 25 = 0
),
ledger AS (
  SELECT transaction_id, vendor_name_raw, CAST(o_custkey AS VARCHAR) AS vendor_id,
         invoice_number_raw, day AS invoice_date, CAST(day + 30 AS DATE) AS payment_date, amount,
         amount AS invoice_amount, 'PO-' || CAST(o_orderkey % 7 AS VARCHAR) AS po_number,
         l_returnflag AS payment_method,
         CASE o_orderstatus WHEN 'P' THEN 'Voided' WHEN 'F' THEN 'PAID' END AS payment_status,
         department, CAST(NULL AS VARCHAR) AS description
  FROM entries
)"""

_IDENTITY = (
    "vendor_name_raw vendor_id invoice_number_raw invoice_date payment_date invoice_amount"
    " po_number payment_method payment_status department description"
).split()


def _agreed(field: str) -> str:
    return f"CASE WHEN min({field}) = max({field}) THEN min({field}) END"


def _disagreed() -> str:
    return ", ".join(
        f"CASE WHEN min({f}) <> max({f}) THEN '{f}' END" for f in sorted(_IDENTITY)
    )


def payments(ledger: str = "ledger", name: str = "tx") -> str:
    fields = ", ".join(
        f"coalesce({_agreed(f)}, '') AS {f}" if f == "vendor_name_raw" else f"{_agreed(f)} AS {f}"
        for f in _IDENTITY
    )
    return f"""
{name}_raw AS (
  SELECT transaction_id, CAST(sum(amount) AS DECIMAL(18,2)) AS amount, count(*) AS line_count,
         list_sort(list(DISTINCT amount)) AS amounts, {fields},
         list_filter([{_disagreed()}], lambda f: f IS NOT NULL) AS disagreed
  FROM {ledger} GROUP BY transaction_id
),
{name}_keyed AS (
  SELECT *, {vendor_key('vendor_name_raw')} AS vendor_canonical,
         {invoice_key('invoice_number_raw')} AS invoice_canonical
  FROM {name}_raw
),
{name} AS (
  SELECT *, coalesce(vendor_canonical, nullif(trim(vendor_name_raw), '')) AS vk,
         coalesce(invoice_canonical, nullif(trim(invoice_number_raw), '')) AS ik,
         CAST(invoice_date AS VARCHAR) AS dk
  FROM {name}_keyed
)"""


LEAST = "least(l.amount, r.amount)"
EXCESS = (
    "CAST(l.amount + r.amount - least(l.invoice_amount, r.invoice_amount) AS DECIMAL(18,2))"
)


def _signals(bill: str) -> dict[str, tuple[str, str, str]]:
    """Per signal: key equality, residual condition, amount at risk."""
    return {
        "exact_duplicate": (f"vk,{bill},amount", "TRUE", LEAST),
        "fuzzy_vendor": (f"{bill},amount", "l.vk IS DISTINCT FROM r.vk", LEAST),
        "invoice_variant": ("vk,amount", "l.ik IS DISTINCT FROM r.ik", LEAST),
        "split_payment": (f"vk,{bill}", "TRUE", LEAST),
        "cross_department": (
            f"vk,{bill},amount",
            "l.department IS DISTINCT FROM r.department",
            LEAST,
        ),
        "overpayment_vs_invoice": (f"vk,{bill}", f"{EXCESS} > 0", EXCESS),
    }


def signal_select(signal: str, bill: str = "ik", tx: str = "tx") -> str:
    keys, residual, risk = _signals(bill)[signal]
    on = " AND ".join(f"l.{k} = r.{k}" for k in keys.split(","))
    return f"""
  SELECT '{signal}:' || l.transaction_id || ':' || r.transaction_id AS candidate_id,
         l.transaction_id AS left_id, r.transaction_id AS right_id, '{signal}' AS signal,
         CAST({risk} AS DECIMAL(18,2)) AS amount_at_risk
  FROM {tx} l JOIN {tx} r ON {on} AND l.transaction_id < r.transaction_id
  WHERE {residual}"""


ALL_SIGNALS = tuple(_signals("ik"))
NO_INVOICE_SIGNALS = ("fuzzy_vendor", "split_payment", "cross_department")


def candidates(signals=ALL_SIGNALS, bill: str = "ik", tx: str = "tx", name: str = "cand") -> str:
    union = " UNION ALL ".join(signal_select(s, bill, tx) for s in signals)
    return f"\n{name} AS ({union})"


def capped_buckets(cap: int) -> str:
    """Key rows with the bucket each falls in under a cap."""
    families = {
        "via": "vk || '|' || ik || '|' || amount",
        "ia": "ik || '|' || amount",
        "va": "vk || '|' || amount",
        "vi": "vk || '|' || ik",
    }
    keyed = " UNION ALL ".join(
        f"SELECT '{n}' AS family, {k} AS key, * FROM tx WHERE ({k}) IS NOT NULL"
        for n, k in families.items()
    )
    return f"""
keyed AS ({keyed}),
sized AS (
  SELECT *, count(*) OVER (PARTITION BY family, key) AS n_key,
         count(*) OVER (PARTITION BY family, key, coalesce(dk, '')) AS n_day,
         row_number() OVER (PARTITION BY family, key, coalesce(dk, '') ORDER BY transaction_id)
           AS rn
  FROM keyed
),
bucketed AS (
  SELECT *, CASE WHEN n_key > {cap} THEN coalesce(dk, '') ELSE '' END AS sub,
         CASE WHEN n_key > {cap} AND n_day > {cap} THEN (rn - 1) // {cap} ELSE 0 END AS chunk
  FROM sized
)"""


def capped_candidates() -> str:
    of_family = {
        "via": ("exact_duplicate", "cross_department"),
        "ia": ("fuzzy_vendor",),
        "va": ("invoice_variant",),
        "vi": ("split_payment", "overpayment_vs_invoice"),
    }
    parts = []
    for family, names in of_family.items():
        for signal in names:
            _, residual, risk = _signals("ik")[signal]
            parts.append(f"""
  SELECT '{signal}:' || l.transaction_id || ':' || r.transaction_id AS candidate_id,
         '{signal}' AS signal, CAST({risk} AS DECIMAL(18,2)) AS amount_at_risk
  FROM bucketed l JOIN bucketed r
    ON l.family = '{family}' AND r.family = '{family}' AND l.key = r.key AND l.sub = r.sub
   AND l.chunk = r.chunk AND l.transaction_id < r.transaction_id
  WHERE {residual}""")
    return "\ncapped AS (" + " UNION ALL ".join(parts) + ")"


_STATUSES = "'CANCELLED','CANCELED','REVERSED','REVERSAL','VOID','VOIDED'"


def _cancelled(side: str) -> str:
    status = f"upper(trim(translate({side}.payment_status, '-_', '  ')))"
    return f"coalesce(regexp_replace({status}, ' +', ' ', 'g') IN ({_STATUSES}), FALSE)"


SAME_INVOICE = """(CASE
    WHEN l.invoice_canonical IS NOT NULL AND r.invoice_canonical IS NOT NULL
      THEN l.invoice_canonical <> '' AND l.invoice_canonical = r.invoice_canonical
    WHEN l.invoice_number_raw IS NOT NULL AND r.invoice_number_raw IS NOT NULL
      THEN trim(l.invoice_number_raw) <> ''
       AND trim(l.invoice_number_raw) = trim(r.invoice_number_raw)
    ELSE FALSE END)"""
_SAME_VENDOR = """(CASE
    WHEN l.vendor_id IS NOT NULL AND r.vendor_id IS NOT NULL THEN l.vendor_id = r.vendor_id
    WHEN l.vendor_canonical IS NOT NULL AND r.vendor_canonical IS NOT NULL
      THEN l.vendor_canonical = r.vendor_canonical
    ELSE trim(l.vendor_name_raw) <> ''
     AND trim(l.vendor_name_raw) = trim(r.vendor_name_raw) END)"""

RULED = f"""
ruled AS (
  SELECT c.*, CASE
      WHEN {_cancelled('l')} OR {_cancelled('r')} THEN 'cancelled'
      WHEN coalesce({SAME_INVOICE} AND {_SAME_VENDOR} AND l.amount <> r.amount
        AND l.line_count >= 2 AND r.line_count >= 2 AND l.amounts <> r.amounts
        AND l.payment_date = r.payment_date
        AND NOT coalesce(l.payment_method <> r.payment_method, FALSE)
        AND NOT coalesce(l.po_number <> r.po_number, FALSE), FALSE) THEN 'line_split'
    END AS rule
  FROM cand c JOIN tx l ON c.left_id = l.transaction_id JOIN tx r ON c.right_id = r.transaction_id
)"""

MASK_WORDS = "|".join(BUSINESS_WORDS)


def masked(name: str) -> str:
    words = f"trim(regexp_replace(trim({name}), '[\\s,./&+-]+', ' ', 'g'))"
    initials = f"upper(regexp_replace({words}, '([A-Za-z])[A-Za-z'']*', '\\1.', 'g'))"
    return (
        f"CASE WHEN regexp_matches({words}, '^[A-Za-z][A-Za-z'']*( [A-Za-z][A-Za-z'']*){{1,3}}$')"
        f" AND NOT regexp_matches(lower({words}), '(^| )({MASK_WORDS})( |$)')"
        f" THEN 'Individual · ' || {initials} ELSE {name} END"
    )


def department_key(d: str) -> str:
    return f"coalesce(trim(regexp_replace(upper({d}), '\\s+', ' ', 'g')), '')"


def approver(d: str) -> str:
    key = department_key(d)
    named = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in APPROVERS.items())
    total = f"list_sum(list_transform(string_split({key}, ''), lambda ch: unicode(ch)))"
    spread = f"[{', '.join(map(repr, FALLBACK_ROSTER))}][CAST({total} % 4 AS INTEGER) + 1]"
    return f"CASE {key} WHEN '' THEN '{FALLBACK_ROSTER[0]}' {named} ELSE {spread} END"


def title(d: str) -> str:
    """Titles for departments made of plain words (no apostrophes)."""
    key = f"lower({department_key(d)})"
    piece = "upper(substr(w, 1, 1)) || substr(w, 2)"
    titled = (
        f"array_to_string(list_transform(string_split(w, '-'), lambda h:"
        f" {piece.replace('w', 'h')}), '-')"
    )
    hyphened = (
        f"array_to_string(list_transform(string_split({key}, ' '), lambda w, i:"
        f" CASE WHEN i > 1 AND w IN ('and', 'of', 'the') THEN w ELSE {titled} END), ' ')"
    )
    return f"CASE WHEN {key} = '' THEN 'Unassigned' ELSE {hyphened} END"


def money_label(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || '$' || format('{{:,.2f}}', CAST(abs({x}) AS DOUBLE)))"


def ratio(n: str, d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN 0.0 ELSE CAST({n} AS DOUBLE) / {d} END"


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + select
