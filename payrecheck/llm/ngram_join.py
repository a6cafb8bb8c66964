"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its components.

A document is the set of its word n-grams.  If two sets of n and m reach the
threshold, they share at least t = ceil(threshold * n) elements, so under one order of
all elements the first n - t + l of either share at least l.  Every document picks its own
l: a longer prefix costs postings and pays where its elements are frequent, because a
partner must then share l of them.  A pair is a candidate when it shares as many
as the smaller l of both asks for, within the prefixes of that l.

The order puts rare n-grams first.  Frequencies come from all documents: each task counts
its own and reports what it met twice, the sums are ranked, and a bounded table of the
most frequent goes back to the tasks.  It only sets the order and the choice of l, never the
result.

Groups of near copies are linked in linear work.  Equal sets become one class first.
Then each posting list is compared with its hub, the member with the fewest rare
elements before the shared one; verified links give components.  Last, every remaining
candidate across components is verified: in a list, all members outside its largest
component meet all members of other components.  Pairs inside a component can not
change it, so no link between different components is missed.  A parity bitmap of each set
bounds what two sets can share, and keeps pairs that are certain to fail from meeting.

Defined results: without words or text a document has no n-grams and is linked with
nothing; fewer words than the n-gram are one element; rows that share a doc_id
count as one document; a row without doc_id is linked with nothing and has a null component;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payrecheck.llm.components import components
from payrecheck.llm.shingles import mix, pieces, shingle_sets, word_hashes
from payrecheck.session import stage


@dataclass(frozen=True)
class JoinRule:
    """``percent``: 100 * intersection >= percent * union links two documents.

    ``max_level``: the largest l a document may choose.  ``ranked``: bound of the table of
    frequent n-grams (12 bytes each) that orders elements.  ``verify_cost``: the work of
    verifying a candidate, in postings per element of the set.
    """

    words: int = 3
    percent: int = 90
    max_level: int = 6
    ranked: int = 1 << 18
    verify_cost: float = 0.5


#: Bits of a set's parity bitmap: each element flips one.  Sets that differ in d elements have
#: bitmaps that differ in d bits at most, so the bitmaps bound what two sets can share.
BITMAP_WORDS = 8

#: Sets over ``LONG`` fill the bitmap; those have the sizes of ``PARTS`` parts of them, by hash,
#: and the sum of the lesser sizes bounds what two sets can share.
LONG, PARTS = 1000, 256

#: Pairs that may be broadcast (about 24 bytes each); more meet the texts by a shuffle.
BROADCAST_PAIRS = 1_000_000

#: Distinct hashes a task holds before it reports those it met twice.
_HELD = 1 << 22


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for at, part in pieces(batch.column("text")):
        yield at, shingle_sets(*word_hashes(part), words)


def _ranking(docs: DataFrame, rule: JoinRule) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams, sorted, with their frequencies; bounded by the rule."""

    def local(batches):
        held, size = [], 0

        def told():
            if not held:
                return
            s = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            n = np.diff(np.append(first, len(s)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(s[first[n > 1]].view(np.int64)), pa.array(n[n > 1])], ["h", "n"]
            )

        for batch in batches:
            for _, sets in _sets(batch, rule.words):
                held += sets
                size += sum(map(len, sets))
                if size >= _HELD:
                    yield from told()
                    held, size = [], 0
        yield from told()

    met = stage(
        docs.select("text")
        .mapInArrow(local, "h long, n long")
        .groupBy("h")
        .agg(F.sum("n").cast("int").alias("n")),
        "ngram-frequencies",
    )
    # The lowest frequency whose n-grams still fit, from a table of one row a frequency.
    floor = (
        met.groupBy("n")
        .agg(F.count("*").alias("c"))
        .orderBy(F.desc("n"))
        .limit(rule.ranked)
        .toPandas()
    )
    fits = floor[floor["c"].cumsum() <= rule.ranked]
    if fits.empty:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = met.filter(F.col("n") >= int(fits["n"].min())).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], top["n"].to_numpy(np.int64)[order]


def _prefix(
    s: np.ndarray, ranks: np.ndarray, counts: np.ndarray, rule: JoinRule
) -> tuple[np.ndarray, int, int]:
    """The ordered prefix of a set, its chosen l, and the length of the prefix at l = 1."""
    n = len(s)
    base = n - (rule.percent * n + 99) // 100 + 1
    most = min(rule.max_level, n - base + 1)
    freq = np.ones(n, np.int64)
    if len(ranks):
        at = np.minimum(np.searchsorted(ranks, s), len(ranks) - 1)
        met = ranks[at] == s
        freq[met] = counts[at[met]]
    # Rare first; among equals by hash, so that the order is the same everywhere.
    order = np.lexsort((mix(s), freq))[: base + most - 1]
    # Partners met by the prefix at l, and those that can share l of its elements.
    met = np.cumsum(freq[order] - 1)[base - 1 :]
    levels = np.arange(1, most + 1)
    cost = met + (met / levels) * rule.verify_cost * n + levels
    level = int(np.argmin(cost)) + 1
    return s[order[: base + level - 1]], level, base


def _bitmap(s: np.ndarray) -> np.ndarray:
    bit = (mix(s ^ np.uint64(0x0123456789ABCDEF)) >> np.uint64(32)) % np.uint64(64 * BITMAP_WORDS)
    odd = np.bincount(bit.astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _part_sizes(s: np.ndarray) -> np.ndarray | None:
    if len(s) <= LONG:
        return None
    part = (mix(s ^ np.uint64(0xFEDCBA9876543210)) >> np.uint64(32)) % np.uint64(PARTS)
    return np.bincount(part.astype(np.int64), minlength=PARTS).astype(np.int32)


def signatures(docs: DataFrame, rule: JoinRule) -> DataFrame:
    """doc_id, n (set size), a and b (a fingerprint of the set), level, base, prefix, bits, parts."""
    ranks, counts = _ranking(docs, rule)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        for batch in batches:
            for at, sets in _sets(batch, rule.words):
                rows = [_prefix(s, ranks, counts, rule) if len(s) else (s, 0, 0) for s in sets]
                a = [int(np.bitwise_xor.reduce(mix(s + np.uint64(7)), initial=0)) for s in sets]
                b = [int(np.sum(mix(s ^ np.uint64(0x5BD1E995)), dtype=np.uint64)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array(a, np.uint64).view(np.int64)),
                        pa.array(np.array(b, np.uint64).view(np.int64)),
                        pa.array([r[1] for r in rows], pa.int32()),
                        pa.array([r[2] for r in rows], pa.int32()),
                        pa.array([r[0].view(np.int64) for r in rows], pa.list_(pa.int64())),
                        pa.array([_bitmap(s) for s in sets], pa.list_(pa.int64())),
                        pa.array([_part_sizes(s) for s in sets], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "n", "a", "b", "level", "base", "prefix", "bits", "parts"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        sign,
        f"doc_id {kind}, n long, a long, b long, level int, base int, "
        "prefix array<long>, bits array<long>, parts array<int>",
    )


def _close(rule: JoinRule, a: str = "n_a", b: str = "n_b"):
    """Sizes that can reach the threshold."""
    return (F.col(a) * 100 >= F.col(b) * rule.percent) & (
        F.col(b) * 100 >= F.col(a) * rule.percent
    )


def _bits(classes: DataFrame, side: str, *more: str) -> DataFrame:
    """The bitmap of each class node, one column a word, and ``more`` of its columns."""
    words = [F.get("bits", k).alias(f"{side}{k}") for k in range(BITMAP_WORDS)]
    named = [F.col(c).alias(f"{c}_{side}") for c in ("n", *more)]
    return classes.select(F.col("node").alias(side), *named, *words)


def _can_share_enough(rule: JoinRule) -> Column:
    """What the bitmaps of ``a`` and ``b`` leave possible; false only where no link can be."""
    differ = sum(
        (F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(BITMAP_WORDS)),
        F.lit(0),
    )
    both = F.col("n_a") + F.col("n_b")
    return (both - differ) * (100 + rule.percent) >= both * (2 * rule.percent)


def _promising(pairs: DataFrame, classes: DataFrame, rule: JoinRule) -> DataFrame:
    """The pairs (a, b) whose bitmaps and part sizes leave a link possible."""

    least = F.aggregate(
        F.zip_with("parts_a", "parts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x
    )
    enough = least * (100 + rule.percent) >= (F.col("n_a") + F.col("n_b")) * rule.percent
    return (
        pairs.select("a", "b")
        .join(_bits(classes, "a", "parts"), "a")
        .join(_bits(classes, "b", "parts"), "b")
        .filter(_can_share_enough(rule))
        .filter(F.coalesce(enough, F.lit(True)))
        .select("a", "b")
    )


#: Pairs whose sets are held at once while a batch is verified.
_AT_ONCE = 256


def _verified(pairs: DataFrame, docs: DataFrame, rule: JoinRule, name: str) -> DataFrame:
    """The pairs (a, b) of documents whose whole sets reach the threshold, as u, v.

    ``b`` should be the side that many pairs share: its text travels once, and the
    text of ``a`` with each pair.
    """
    pairs = stage(pairs.select("a", "b").distinct(), f"{name}-pairs")
    others = stage(pairs.select("b").distinct(), f"{name}-others")
    # Texts that are in no pair stay where they are while the pairs are few.
    few = pairs.count() <= BROADCAST_PAIRS
    small = F.broadcast if few else (lambda df: df)
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("x")).join(small(pairs), "a")
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("y")).join(
        small(others), "b", "left_semi"
    )

    def sets(texts: pa.Array) -> list[np.ndarray]:
        return [s for _, part in pieces(texts) for s in shingle_sets(*word_hashes(part), rule.words)]

    def reached(s: np.ndarray, t: np.ndarray) -> bool:
        both = len(s) + len(t) - len(np.union1d(s, t))
        return both * 100 >= (len(s) + len(t) - both) * rule.percent

    def verify(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _AT_ONCE):
                batch = whole.slice(at, _AT_ONCE)
                both = zip(sets(batch.column("x")), sets(batch.column("y")), strict=True)
                kept = pa.array([reached(s, t) for s, t in both], pa.bool_())
                yield batch.select(["u", "v"]).filter(kept)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        left.join(right, "b")
        .select(F.col("a").alias("u"), F.col("b").alias("v"), "x", "y")
        .mapInArrow(verify, f"u {kind}, v {kind}")
    )


def link_documents(docs: DataFrame, rule: JoinRule = JoinRule()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    signed = stage(signatures(docs, rule), "ngram-signatures")
    usable = signed.filter("doc_id IS NOT NULL AND n > 0")
    # One class for each set, summed on the map side; its least document stands for it.
    classes = stage(
        usable.groupBy("a", "b", "n").agg(
            F.min(F.struct("doc_id", "level", "base", "prefix", "bits", "parts")).alias(
                "first"
            )
        ).select("a", "b", "n", "first.*").withColumnRenamed("doc_id", "node"),
        "ngram-classes",
    )
    postings = classes.select(
        "node", "n", "level", "base", F.posexplode("prefix").alias("pos", "gram")
    ).select(
        "gram",
        "node",
        "n",
        "level",
        F.greatest(F.lit(1), F.col("pos") - F.col("base") + 2).alias("at"),
        "pos",
    )
    lists = postings.groupBy("gram").agg(F.count("*").alias("size")).filter("size > 1")
    shared = stage(postings.join(lists.select("gram"), "gram"), "ngram-postings")
    # The hub of a list has the fewest rarer elements before the shared one.
    hubs = shared.groupBy("gram").agg(F.min(F.struct("pos", "node", "n")).alias("hub"))
    stars = (
        shared.join(hubs, "gram")
        .filter(F.col("node") != F.col("hub.node"))
        .select(
            F.col("node").alias("a"),
            F.col("hub.node").alias("b"),
            "level",
            F.col("n").alias("n_a"),
            F.col("hub.n").alias("n_b"),
        )
        .filter(_close(rule))
        .groupBy("a", "b")
        .agg(F.count("*").alias("met"), F.max("level").alias("level"))
        # Which hub pairs are worth a look; the others come again below.
        .filter("met >= level")
        .select("a", "b")
    )
    stars = stage(_promising(stars, classes, rule), "ngram-stars")
    found = stage(_verified(stars, docs, rule, "ngram-star"), "ngram-star-links")
    groups = components(found, "ngram-star-groups")

    placed = shared.join(groups, shared["node"] == groups["node"], "left").select(
        "gram", shared["node"], "level", "at",
        F.coalesce("component", shared["node"]).alias("group"),
    )
    parts = placed.groupBy("gram", "group").agg(F.count("*").alias("size"))
    largest = parts.groupBy("gram").agg(
        F.max(F.struct("size", "group")).alias("top"), F.count("*").alias("parts")
    ).filter("parts > 1")
    mixed = stage(
        placed.join(largest, "gram").select(
            "gram", "node", "level", "at", "group",
            (F.col("group") == F.col("top.group")).alias("major"),
        ),
        "ngram-mixed",
    )
    few = "gram", "level", "at", "group", "major"
    x = mixed.filter("NOT major").select("node", *few).toDF("a", "gram", "l_a", "at_a", "g_a", "m_a")
    y = mixed.select("node", *few).toDF("b", "gram", "l_b", "at_b", "g_b", "m_b")
    # The bitmaps are part of the join's condition: pairs that can not link never leave it.
    rest = (
        x.join(_bits(classes, "a"), "a")
        .join(y.join(_bits(classes, "b"), "b"), "gram")
        .filter((F.col("g_a") != F.col("g_b")) & (F.col("m_b") | (F.col("a") < F.col("b"))))
        .filter(_close(rule))
        .filter(_can_share_enough(rule))
        .filter(F.greatest("at_a", "at_b") <= F.least("l_a", "l_b"))
        # Either may be the minor one, by list; their matches count together.
        .select(
            F.least("a", "b").alias("a"),
            F.greatest("a", "b").alias("b"),
            F.least("l_a", "l_b").alias("need"),
        )
        .groupBy("a", "b")
        .agg(F.count("*").alias("met"), F.first("need").alias("need"))
        .filter("met >= need")
        .select("a", "b")
    )
    tried = stars.unionAll(stars.select("b", "a"))
    rest = _promising(rest.join(tried, ["a", "b"], "left_anti"), classes, rule)
    more = stage(_verified(rest, docs, rule, "ngram-rest"), "ngram-rest-links")
    linked = components(found.unionAll(more), "ngram-groups")

    # A document is known by its doc_id: rows that share it join their classes.
    named = classes.select("a", "b", "n", "node").join(linked, "node", "left")
    named = named.select("a", "b", "n", F.coalesce("component", "node").alias("component_id"))
    return (
        signed.select("doc_id", "n", "a", "b")
        .join(named, ["a", "b", "n"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id"))
            .otherwise(F.col("doc_id"))
            .alias("component_id"),
        )
        .withColumn(
            "component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
        )
    )


def one_of_each(docs: DataFrame, rule: JoinRule = JoinRule()) -> DataFrame:
    """``docs`` without the documents that are linked to one of a lesser doc_id.

    Rows equal in doc_id and text are one document and leave one row; rows
    without doc_id stay.
    """
    linked = link_documents(docs, rule)
    gone = linked.filter("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    return kept.dropDuplicates(["doc_id", "text"])
