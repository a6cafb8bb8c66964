"""Line dedup by site-relative frequency.

Documents are grouped by host; the pages of a host that hold a line are divided
by all its pages, and lines over the boilerplate ratio are dropped from every
page.  Counting shuffles 96-bit keys of lines and pages, summed on the map side,
so neither a hot host nor a hot line meets in one task; texts move at most once, to
meet the lines that they lose.

Defined results: a null text stays null and an empty one empty; lines without a
word are never dropped; a null host is a host of its own; repeated rows are
cleaned alike and, being copies, count as one page; a text that loses all its lines
becomes empty; other columns are carried through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrecheck.llm.lines import frequent_lines, has_word, host_pages, line_key, page_lines, text_key


@dataclass(frozen=True)
class LineLimits:
    """A line is boilerplate on over ``ratio`` of a host's pages, ``pages`` at least."""

    ratio: float = 0.1
    pages: int = 5


def trimmed(line):
    return F.trim(F.translate(line, "\t\x0b\f\r", "    "))


def drop_boilerplate(
    docs: DataFrame,
    limits: LineLimits = LineLimits(),
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """``docs`` with cleaned texts; added: ``n_lines``, ``n_dropped`` (long)."""
    names = docs.columns
    docs = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text, host = f"c{names.index(text)}", f"c{names.index(host)}"
    lines = page_lines(docs, text, host, trimmed)
    often = frequent_lines(lines, host_pages(docs, text, host), limits.ratio, limits.pages)
    drops = (
        lines.join(often, ["host", "line"])
        .groupBy("host", "page")
        # A page has no more of these than it has lines.
        .agg(F.collect_list("line").alias("_drop"))
        .select(F.col("host").alias("_host"), F.col("page").alias("_page"), "_drop")
    )
    kept = F.filter(
        F.split(F.col(text), "\n"),
        lambda x: ~(has_word(x) & F.array_contains(F.col("_drop"), line_key(trimmed(x)))),
    )
    size = F.coalesce(F.size(F.split(F.col(text), "\n")).cast("long"), F.lit(0).cast("long"))
    return (
        docs.withColumn("_host", F.coalesce(F.col(host), F.lit("")))
        .withColumn("_page", text_key(F.coalesce(F.col(text), F.lit(""))))
        .join(drops, ["_host", "_page"], "left")
        .withColumn("_kept", F.when(F.col("_drop").isNotNull(), kept))
        .withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(size).cast("long"))
        .withColumn(
            "n_dropped",
            F.when(F.col("_kept").isNull(), 0)
            .otherwise(F.col("n_lines") - F.size("_kept"))
            .cast("long"),
        )
        .withColumn(text, F.coalesce(F.array_join("_kept", "\n"), F.col(text)))
        .drop("_host", "_page", "_drop", "_kept")
        .toDF(*names, "n_lines", "n_dropped")
    )
