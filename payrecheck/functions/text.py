"""Text cleaning and canonical keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space when a cell is
# stripped (Unicode white space plus the four ASCII separators).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"

# Legal-form words ignored at the end of a vendor name.
CORPORATE_SUFFIXES = (
    "INC",
    "LLC",
    "LTD",
    "CORP",
    "CORPORATION",
    "CO",
    "COMPANY",
    "LP",
    "LLP",
    "THE",
)

_NOT_ALNUM = r"[^\p{L}\p{N}]+"


def _printable(c: Column) -> Column:
    """Whether the first character is printable ASCII and no blank."""
    return (c >= "!") & (c < "\x7f")


def strip(c: Column) -> Column:
    """Remove white space from both ends (``trim`` alone knows only U+0020).

    Most cells begin and end with printable ASCII; only others are searched for white space.
    """
    plain = _printable(c) & _printable(F.right(c, F.lit(1)))
    return F.when(plain, c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def optional_text(c: Column) -> Column:
    """Stripped text, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def non_blank(c: Column) -> Column:
    """The cell as it is, or null when it holds only white space.

    A first character in the printable ASCII range settles it; only other cells
    need the full Unicode strip.
    """
    return F.when(_printable(c), c).when(F.btrim(c, F.lit(WHITESPACE)) != "", c)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACE_RUN, " "))


def canonical_vendor(name: Column) -> Column:
    """Vendor key: upper-case words without AND, leading THEs and legal forms."""
    words = F.upper(F.regexp_replace(name, _NOT_ALNUM, " "))
    # One space before each word and one at the end, so each rule below can
    # recognise a whole word without splitting into an array.
    padded = F.concat(F.lit(" "), F.btrim(words), F.lit(" "))
    no_and = F.regexp_replace(padded, r" AND(?= )", "")
    no_the = F.regexp_replace(no_and, r"^(?: THE(?= ))+", "")
    suffixes = "|".join(CORPORATE_SUFFIXES)
    no_form = F.regexp_replace(no_the, rf"(?: (?:{suffixes})(?= ))+ \z", "")
    return F.nullif(F.replace(no_form, F.lit(" "), F.lit("")), F.lit(""))


def canonical_invoice(number: Column) -> Column:
    """Invoice key: alphanumerics, no INV prefix, no leading zeros."""
    text = F.upper(strip(number))
    # INV is a prefix only when it is not the start of a longer word.
    bare = F.regexp_replace(text, r"^INV(?!\p{L})", "")
    compact = F.regexp_replace(bare, _NOT_ALNUM, "")
    # Leading zeros go, but a number of zeros alone keeps its last one.
    return F.nullif(F.regexp_replace(compact, r"^0+(?!\z)", ""), F.lit(""))


def with_canonical_keys(payments):
    """Set both canonical columns from the raw ones."""
    return payments.withColumns(
        {
            "vendor_canonical": canonical_vendor(F.col("vendor_name_raw")),
            "invoice_canonical": canonical_invoice(F.col("invoice_number_raw")),
        }
    )


def normalise_status(status: Column) -> Column:
    return collapse_spaces(F.translate(F.upper(status), "-_", "  "))


def markdown_cell(c: Column) -> Column:
    escaped = F.replace(c, F.lit("|"), F.lit("\\|"))
    return strip(F.replace(escaped, F.lit("\n"), F.lit(" ")))


def candidate_pair_ids(candidate_id: Column) -> Column:
    """``struct(left_id, right_id)`` from ``signal:idA:idB``; null when malformed."""
    parts = F.split(candidate_id, ":")
    left, right = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
    usable = (F.size(parts) >= 3) & (left != "") & (right != "")
    return F.when(usable, F.struct(left.alias("left_id"), right.alias("right_id")))


def signal_label(signal: Column) -> Column:
    return F.replace(signal, F.lit("_"), F.lit(" "))
