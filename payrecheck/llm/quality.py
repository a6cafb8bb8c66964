"""Quality rules: word and repetition limits, and cross-document line frequency.

Only DataFrame functions run here.  The word statistics are one projection of the
text without a shuffle.  The line rule hashes normalised lines, counts the
distinct documents of a host that hold each, removes lines above the limits and
rejects documents that are depleted by it; only hashes are shuffled, never text.

Defined results: a null text counts as empty, has no words and fails the base
rules; a null host is a host of its own; repeated rows are judged alike; other
columns are carried through untouched by ``filter_quality``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payrecheck.llm.lines import (
    SPACE,
    SPACE_CHARS,
    frequent_lines,
    has_word,
    host_pages,
    page_lines,
    text_key,
)

WINDOW = 5
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityLimits:
    """``min_words``, ``max_repeat_percent``: the base rules.

    A line is removed when over ``line_share`` of its host's documents hold it,
    ``line_docs`` at the least; a document is depleted when its remaining words are
    under ``min_words`` or under ``min_left`` of what it had.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    line_share: float = 0.1
    line_docs: int = 5
    min_left: float = 0.5


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(hashes: Column) -> Column:
    """Words in windows found twice or more; ``hashes`` has one hash a window.

    The windows are sorted by hash, those with an equal neighbour are kept, and the
    words they cover are five each less what neighbouring windows share.
    """

    def covered(at: Column) -> Column:
        overlap = F.aggregate(
            F.sequence(F.lit(2), F.size(at)),
            F.lit(0),
            lambda s, k: s
            + F.greatest(F.lit(0), WINDOW - (F.element_at(at, k) - F.element_at(at, k - 1))),
        )
        return F.size(at) * WINDOW - F.when(F.size(at) >= 2, overlap).otherwise(F.lit(0))

    def marked(order: Column) -> Column:
        h = lambda k: F.get(order, k).getField("h")
        met = F.filter(
            F.sequence(F.lit(0), F.size(order) - 1),
            lambda k: F.coalesce(h(k) == h(k - 1), F.lit(False))
            | F.coalesce(h(k) == h(k + 1), F.lit(False)),
        )
        return F.array_sort(F.transform(met, lambda k: F.get(order, k).getField("i")))

    rows = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return _let(F.array_sort(rows), lambda order: _let(marked(order), covered))


def normalised(line: Column) -> Column:
    """Lower case, single blanks, digits alike."""
    return F.regexp_replace(
        F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")), "[0-9]", "0"),
        "0+",
        "0",
    )


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, SPACE), "")
    lines = F.filter(F.split(body, "\n"), has_word)

    def windows(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]),
        )

    hashes = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(
        F.size(h).alias("n"),
        # Two windows are needed before one can be found twice.
        F.when(F.size(h) > WINDOW, windows(h)).alias("windows"),
    ))
    repeated = lambda w: F.when(
        F.size(F.array_distinct(w)) < F.size(w), _repeat_words(w)
    ).otherwise(F.lit(0))
    stats = _let(hashes, lambda x: F.struct(
        x.getField("n").alias("n"), F.coalesce(repeated(x.getField("windows")), F.lit(0)).alias("r")
    ))
    dup_lines = _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return (
        docs.withColumn("_stats", stats)
        .withColumns(
            {
                "n_words": F.col("_stats.n").cast("long"),
                "word_chars": F.length(F.translate(body, SPACE_CHARS, "")).cast("long"),
                "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast(
                    "long"
                ),
                "n_dup_lines": dup_lines.cast("long"),
                "n_repeat_words": F.col("_stats.r").cast("long"),
            }
        )
        .drop("_stats")
    )


def base_failed(limits: QualityLimits) -> Column:
    return (F.col("n_words") < limits.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * limits.max_repeat_percent
    )


def thinned_pages(
    docs: DataFrame, limits: QualityLimits, text: str = "text", host: str = "source"
) -> DataFrame:
    """host, page, gone, total: pages that lose a line, in words over all copies."""
    lines = page_lines(docs, text, host, normalised)
    often = frequent_lines(
        lines, host_pages(docs, text, host), limits.line_share, limits.line_docs
    )
    gone = F.sum(F.when(F.col("often"), F.col("words")))
    return (
        lines.join(often.withColumn("often", F.lit(True)), ["host", "line"], "left")
        .groupBy("host", "page")
        .agg(gone.alias("gone"), F.sum("words").alias("total"))
        .filter(F.col("gone").isNotNull())
    )


def judge_quality(
    docs: DataFrame,
    limits: QualityLimits = QualityLimits(),
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """``docs`` with the base statistics, ``base_failed`` and ``kept``."""
    thinned = thinned_pages(docs, limits, text, host).toDF("_host", "_page", "_gone", "_total")
    # Copies multiply gone and total alike.
    left = F.col("n_words") - F.coalesce(
        F.floor(F.col("n_words") * F.col("_gone") / F.col("_total")), F.lit(0)
    )
    return (
        base_statistics(docs, text)
        .withColumn("base_failed", base_failed(limits))
        .withColumn("_host", F.coalesce(F.col(host), F.lit("")))
        .withColumn("_page", text_key(F.coalesce(F.col(text), F.lit(""))))
        .join(thinned, ["_host", "_page"], "left")
        .withColumn(
            "kept",
            ~F.col("base_failed")
            & (left >= limits.min_words)
            & (left >= limits.min_left * F.col("n_words")),
        )
        .drop("_host", "_page", "_gone", "_total")
    )


def filter_quality(
    docs: DataFrame,
    limits: QualityLimits = QualityLimits(),
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    names = docs.columns
    mine = [f"_c{k}" for k in range(len(names))]
    kept = judge_quality(
        docs.toDF(*mine), limits, mine[names.index(text)], mine[names.index(host)]
    )
    return kept.filter("kept").select(*mine).toDF(*names)
