"""How often a line is met within its host.

A host's pages are its *distinct* texts: a page that was fetched twice is one
page, so copies of a page never make its own lines look like boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of every word split here: space, tab, line feed to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\f\r"


def has_word(line: Column) -> Column:
    return line.rlike(NOT_SPACE)


def text_key(text: Column) -> Column:
    """96 bits that stand for a text; equal texts have equal keys."""
    return F.struct(F.xxhash64(text).alias("a"), F.crc32(text.cast("binary")).alias("b"))


def line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def page_lines(docs: DataFrame, text: str, host: str, norm) -> DataFrame:
    """One row per distinct page and line: host, page, line (its key), words.

    ``norm`` maps a line to the form that is compared.  ``words`` sums over the
    page's equal lines and over its copies, so it serves as a share of the page.
    """
    words = F.size(F.split(F.trim(F.translate("line", "\t\x0b\f\r", "    ")), " +"))
    return (
        docs.select(
            F.coalesce(F.col(host), F.lit("")).alias("host"),
            text_key(F.coalesce(F.col(text), F.lit(""))).alias("page"),
            F.explode(F.split(F.col(text), "\n")).alias("line"),
        )
        .filter(has_word(F.col("line")))
        .select("host", "page", line_key(norm(F.col("line"))).alias("line"), words.alias("w"))
        .groupBy("host", "page", "line")
        .agg(F.sum("w").alias("words"))
    )


def host_pages(docs: DataFrame, text: str, host: str) -> DataFrame:
    """host, pages: the number of distinct texts, null and empty ones included."""
    return (
        docs.select(
            F.coalesce(F.col(host), F.lit("")).alias("host"),
            text_key(F.coalesce(F.col(text), F.lit(""))).alias("page"),
        )
        .distinct()
        .groupBy("host")
        .agg(F.count("*").alias("pages"))
    )


def frequent_lines(lines: DataFrame, pages: DataFrame, share: float, least: int) -> DataFrame:
    """(host, line) met on at least ``least`` pages and over ``share`` of the host's."""
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n"))
    return (
        counts.filter(F.col("n") >= least)
        .join(pages, "host")
        .filter(F.col("n") > share * F.col("pages"))
        .select("host", "line")
    )
