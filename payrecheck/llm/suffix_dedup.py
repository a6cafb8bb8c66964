"""Removal of repeated byte strings of a minimum length, by a bounded suffix array.

Candidates.  Every window of ``length`` bytes picks as its anchor the k-byte string in it
with the least hash, so equal windows pick equal anchors at equal places.  Around an
anchor lie all windows that can have picked it: its segment.  Anchors that occur once
are dropped; equal segments become one with a multiplicity.  Only hashes move so far.

Matching.  The segments of one anchor meet in one group, and groups are packed into
blocks of about half a megabyte.  A block's suffixes are sorted to beyond ``length`` bytes, which
gives its Burrows-Wheeler transform.  Backward extension of intervals, breadth
first, then sets common prefixes by increasing value and stops at ``length``: suffixes with no
boundary between them share at least that much.

Segments enter a group only with a core, the bytes that 41 neighbouring windows have in
common, which another segment of the anchor has too; that is necessary for equal windows.
An anchor that still has more segments than a group may hold (a long passage in very many
different surroundings) is not sorted in one task: the windows around its shared cores are
counted by hash, with partial sums and a join that can be split.  Copies of a whole text are one
text from the start, so a group of copies of any size costs one row.

Defined results: a null text has no bytes and loses none; texts under ``length`` bytes lose
none; equal texts, repeated rows included, lose everything from ``length`` bytes on; other
columns are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payrecheck.llm.shingles import _BYTE, _powers_to, mix, pieces, raw
from payrecheck.session import stage


@dataclass(frozen=True)
class RepeatRule:
    """``group``: distinct segments of an anchor that are sorted in one task."""

    length: int = 400
    anchor: int = 32
    group: int = 512
    block_bytes: int = 1 << 19


#: Texts that may be broadcast as keys (about 100 bytes each); more meet theirs by a shuffle.
BROADCAST_TEXTS = 20_000
_STEP = 41


def text_id(text: Column) -> list[Column]:
    """Two hashes and the size, which stand for a text."""
    body = F.coalesce(text, F.lit("")).cast("binary")
    return [
        F.xxhash64(body).alias("h1"),
        F.xxhash64(F.lit(77), body).alias("h2"),
        F.octet_length(body).cast("long").alias("size"),
    ]


class _Rolling:
    """Hashes of byte strings of a buffer."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers_to(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        # Letters of both cases have values of their own here.
        values = mix(_BYTE ^ np.arange(1, 257, dtype=np.uint64))
        np.cumsum(values[data] * up[: len(data)], out=self._sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _anchors(part: pa.Array, rule: RepeatRule):
    """For each row: anchor hashes, their places, hashes of their segments."""
    data, offsets = raw(part)
    n, k = len(data), rule.anchor
    width = rule.length - k + 1
    empty = np.zeros(0, np.int64)
    if n < rule.length:
        return [(empty, empty, empty)] * len(part)
    rolling = _Rolling(data)
    start = np.arange(n - k + 1)
    grams = rolling.at(start, start + k)
    # The place in the low bits makes the leftmost of equals the least.
    bits = max(24, int(n).bit_length())
    keyed = (grams >> np.uint64(bits) << np.uint64(bits)) | start.astype(np.uint64)
    least = _window_minima(keyed, width) & np.uint64((1 << bits) - 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    least = least[np.arange(len(least)) + rule.length <= ends[: len(least)]].astype(np.int64)
    chosen = least[np.concatenate(([True], least[1:] != least[:-1]))] if len(least) else least
    rows = np.searchsorted(chosen, offsets)
    owner = np.repeat(np.arange(len(part)), np.diff(rows))
    left = np.maximum(chosen - (rule.length - k), offsets[:-1][owner])
    right = np.minimum(chosen + rule.length, offsets[1:][owner])
    # With the anchor's place in it: one place of a text is never two equal segments.
    segments = mix(rolling.at(left, right) + (chosen - left).astype(np.uint64)).view(np.int64)
    hashes = grams[chosen].view(np.int64)
    places = chosen - offsets[:-1][owner]
    return [
        (hashes[a:b], places[a:b], segments[a:b])
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)
    ]


def _find_anchors(texts: DataFrame, rule: RepeatRule) -> DataFrame:
    """h1, h2, size, anchor, place, segment of every anchor of ``texts`` (h1, h2, size, text)."""

    def find(batches):
        for batch in batches:
            for at, part in pieces(batch.column("text")):
                found = _anchors(part, rule)
                n = np.array([len(f[0]) for f in found])
                if not n.sum():
                    continue
                own = pa.array(np.repeat(np.arange(at, at + len(part)), n))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(own) for c in ("h1", "h2", "size")),
                        *(pa.array(np.concatenate([f[k] for f in found])) for k in range(3)),
                    ],
                    ["h1", "h2", "size", "anchor", "place", "segment"],
                )

    return texts.mapInArrow(
        find, "h1 long, h2 long, size long, anchor long, place long, segment long"
    )


def sort_suffixes(text: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` bytes; where a new 32-byte prefix begins.

    ``text`` has 0 behind each segment, at ``ends``; those are all different and
    order by place.
    """
    n = len(text)
    padded = np.concatenate((text.astype(np.int64), np.zeros(4, np.int64)))
    sep = np.searchsorted(ends, np.arange(n))
    near = ends[sep] - np.arange(n) < 4
    key = np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    for j in range(4):
        value = np.where(alive, padded[j : j + n], 0)
        key = key << 9 | value
        alive &= value > 0
    key = key << 21 | np.where(near, sep + 1, 0)
    width = 4
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = new
    while width < depth:
        # Only suffixes that are still equal to a neighbour are sorted on.
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        mine = order[tied]
        ahead = mine + width
        key = rank[mine] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key)
        order[tied] = mine[by]
        key = key[by]
        new = new.copy()
        new[tied] = np.concatenate(([True], key[1:] != key[:-1]))
        width *= 2
        if width <= 32:
            first = new
    return order, first


def shared_prefixes(text: np.ndarray, order: np.ndarray, first: np.ndarray, start: int, length: int):
    """Where, in the order of suffixes, a common prefix under ``length`` ends a class.

    ``first`` marks boundaries of prefixes under ``start``.  An interval of suffixes that
    begin with some w is extended backwards by each byte c before them; the suffixes with
    cw are an interval again, and a boundary behind it that is not yet known has the length of w.
    """
    n = len(text)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = text[order - 1]
    before[order == 0] = 0
    lf = place[order - 1]
    known = np.ones(n + 1, bool)
    known[:n] = first
    lo = np.flatnonzero(known[:n])
    hi = np.append(lo[1:], n) - 1
    for _ in range(start, length):
        if not len(lo):
            break
        size = hi - lo + 1
        one = lo[size == 1]
        nlo, nhi = [lf[one]], [lf[one]]
        two = lo[size == 2]
        same = (before[two] == before[two + 1]) & (before[two] > 0)
        # Equals to beyond the sorted depth may change places: least and most, not first and last.
        a, b = lf[two[same]], lf[two[same] + 1]
        nlo += [np.minimum(a, b), lf[two[~same]], lf[two[~same] + 1]]
        nhi += [np.maximum(a, b), lf[two[~same]], lf[two[~same] + 1]]
        more = np.flatnonzero(size > 2)
        if len(more):
            counts = size[more]
            at = np.repeat(lo[more] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            byte = before[at].astype(np.int64)
            # Separators differ from each other.
            byte = np.where(byte == 0, 257 + at, byte)
            group = np.repeat(np.arange(len(more)), counts) * (n + 512) + byte
            by = np.argsort(group)
            edge = np.flatnonzero(np.concatenate(([True], group[by][1:] != group[by][:-1])))
            to = lf[at[by]]
            nlo.append(np.minimum.reduceat(to, edge))
            nhi.append(np.maximum.reduceat(to, edge))
        lo, hi = np.concatenate(nlo), np.concatenate(nhi)
        fresh = ~known[hi + 1]
        lo, hi = lo[fresh], hi[fresh]
        known[hi + 1] = True
    return known[:n]


def repeated_starts(
    segments: list[bytes], owners: np.ndarray, origins: np.ndarray, many: np.ndarray, length: int
) -> list[np.ndarray]:
    """For each segment where in it a ``length``-byte string starts that starts elsewhere too.

    ``owners`` and ``origins``: the text and the place a segment is from, so that one place
    in two segments is not taken for two; ``many``: segments that occur more than once.
    """
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(ends[-1] + 1, np.int16)
    body = np.ones(len(text), bool)
    body[ends] = False
    # Bytes are shifted by one: 0 ends a segment.
    text[body] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int16) + 1
    order, first = sort_suffixes(text, ends, length)
    cut = shared_prefixes(text, order, first, min(32, length), length)
    segment = np.searchsorted(ends, order)
    begins = np.concatenate(([0], ends[:-1] + 1))
    at = order - begins[segment]
    whole = at + length <= sizes[segment]
    group = (np.cumsum(cut) - 1)[whole]
    segment, at = segment[whole], at[whole]
    true_place = mix(owners[segment].astype(np.uint64)) + (origins[segment] + at).astype(np.uint64)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(segments)
    if not len(group):
        return out
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.minimum.reduceat(true_place, edge)
    most = np.maximum.reduceat(true_place, edge)
    twice = (least != most) | np.logical_or.reduceat(many[segment], edge)
    met = np.repeat(twice, np.diff(np.append(edge, len(group))))
    by = np.lexsort((at[met], segment[met]))
    segment, at = segment[met][by], at[met][by]
    bounds = np.searchsorted(segment, np.arange(len(segments) + 1))
    return [at[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _runs(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of neighbouring starts."""
    if not len(starts):
        return [], []
    gap = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.append(0, gap + 1)].tolist(), starts[np.append(gap, len(starts) - 1)].tolist()


_FOUND = "anchor long, segment long, first array<int>, last array<int>"


def _by_blocks(segments: DataFrame, rule: RepeatRule) -> DataFrame:
    """The repeated starts of segments that are sorted by anchor within each partition."""

    def told(rows: list[dict]) -> pa.RecordBatch:
        found = repeated_starts(
            [r["bytes"] for r in rows],
            np.array([r["h1"] for r in rows], np.int64),
            np.array([r["origin"] for r in rows], np.int64),
            np.array([r["n"] > 1 for r in rows]),
            rule.length,
        )
        runs = [_runs(f + r["cut"]) for f, r in zip(found, rows, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r["anchor"] for r in rows], pa.int64()),
                pa.array([r["segment"] for r in rows], pa.int64()),
                pa.array([r[0] for r in runs], pa.list_(pa.int32())),
                pa.array([r[1] for r in runs], pa.list_(pa.int32())),
            ],
            ["anchor", "segment", "first", "last"],
        )

    def match(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if size >= rule.block_bytes and row["anchor"] != held[-1]["anchor"]:
                    yield told(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["bytes"])
        if held:
            yield told(held)

    return segments.mapInArrow(match, _FOUND)


_HASHED = "anchor long, segment long, at int, h long, place long, many boolean"


def _hashed(rule: RepeatRule, cores: bool):
    """A task that hashes, of each segment, its cores or the windows of one ``part``.

    Starts count from where a whole segment would begin, so equal windows, which lie equally
    far from their anchor, have equal parts.  A core is what all windows that start
    within the same ``_STEP`` places have in common.
    """
    window = rule.length - rule.anchor

    def column(batch: pa.RecordBatch, name: str, at: int, n: int) -> np.ndarray:
        return batch.column(name).slice(at, n).to_numpy(zero_copy_only=False)

    def run(batches):
        for batch in batches:
            for at, part_ in pieces(batch.column("bytes")):
                n = len(part_)
                data, offsets = raw(part_)
                rolling = _Rolling(data)
                shift = window - column(batch, "left", at, n)
                last = np.diff(offsets) - rule.length
                if cores:
                    low = shift // _STEP
                    count = (last + shift) // _STEP - low + 1
                else:
                    part = column(batch, "part", at, n).astype(np.int64)
                    cut = column(batch, "cut", at, n)
                    low = np.maximum(0, part * _STEP - shift)
                    count = np.minimum(last, part * _STEP + _STEP - 1 - shift) - low + 1
                row = np.repeat(np.arange(n), count)
                where = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                if cores:
                    start = where * _STEP + _STEP - 1 - shift[row]
                    end = where * _STEP - shift[row] + rule.length
                else:
                    start, end = where, where + rule.length
                h = rolling.at(offsets[:-1][row] + start, offsets[:-1][row] + end)
                h1 = mix(column(batch, "h1", at, n).astype(np.int64).view(np.uint64))
                place = h1[row] + (start + column(batch, "origin", at, n)[row]).astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(column(batch, "anchor", at, n)[row]),
                        pa.array(column(batch, "segment", at, n)[row]),
                        pa.array((where if cores else where + cut[row]).astype(np.int32)),
                        pa.array(h.view(np.int64)),
                        pa.array(place.view(np.int64)),
                        pa.array(column(batch, "n", at, n)[row] > 1),
                    ],
                    ["anchor", "segment", "at", "h", "place", "many"],
                )

    return run


def _by_counts(segments: DataFrame, rule: RepeatRule) -> DataFrame:
    """The repeated starts of segments (with a ``part``), by counted hashes of windows."""
    windows = segments.mapInArrow(_hashed(rule, cores=False), _HASHED)
    met = (
        windows.groupBy("anchor", "h")
        .agg(F.min("place").alias("a"), F.max("place").alias("b"), F.max("many").alias("m"))
        .filter("a <> b OR m")
        .select("anchor", "h")
    )
    starts = (
        windows.join(met, ["anchor", "h"])
        .groupBy("anchor", "segment")
        .agg(F.array_sort(F.collect_set("at")).alias("first"))
    )
    # The first and last of each run of neighbouring starts.
    return starts.select(
        "anchor",
        "segment",
        F.array_except("first", F.transform("first", lambda x: x + 1)).alias("first"),
        F.array_except("first", F.transform("first", lambda x: x - 1)).alias("last"),
    )


def _covers(docs: DataFrame, rule: RepeatRule) -> DataFrame:
    """h1, h2, size, whole, spans (start, end) of the distinct texts that lose bytes."""
    ids = docs.select("text", *text_id(F.col("text")))
    keys = ["h1", "h2", "size"]
    texts = ids.select(*keys).groupBy(*keys).agg(F.count("*").alias("copies"))
    texts = stage(texts.filter(F.col("size") >= rule.length), "repeat-texts")
    copied = texts.filter("copies > 1").select(*keys)

    anchors = stage(
        _find_anchors(ids.filter(F.col("size") >= rule.length).select(*keys, "text"), rule)
        # Copies of a text have the same anchors.
        .distinct(),
        "repeat-anchors",
    )
    segments = anchors.groupBy("anchor", "segment").agg(
        F.count("*").alias("n"), F.min(F.struct(*keys, "place")).alias("of")
    )
    groups = anchors.groupBy("anchor", "segment").agg(F.count("*").alias("n")).groupBy("anchor").agg(
        F.count("*").alias("kinds"), F.sum("n").alias("all")
    )
    # What occurs once can not repeat; what is always the same repeats as a whole.
    segments = stage(
        segments.join(groups.filter(F.col("all") > 1), "anchor"), "repeat-segments"
    )
    mixed = segments.filter("kinds > 1").select(
        "of.h1", "of.h2", "of.size", "anchor", "segment", "of.place", "n", "kinds"
    )
    wanted = stage(
        mixed.groupBy(*keys).agg(
            F.collect_list(F.struct("anchor", "segment", "place", "n", "kinds")).alias("want")
        ),
        "repeat-wanted",
    )
    small = F.broadcast if wanted.count() <= BROADCAST_TEXTS else (lambda df: df)

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_buffer().to_pybytes()
                h1 = batch.column("h1")[row].as_py()
                for w in batch.column("want")[row].as_py():
                    a = max(0, w["place"] - (rule.length - rule.anchor))
                    bytes_ = text[a : w["place"] + rule.length]
                    values = (
                        w["anchor"], w["segment"], h1, a, w["place"] - a, w["n"], w["kinds"], bytes_
                    )
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            types = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types, strict=True)],
                ["anchor", "segment", "h1", "origin", "left", "n", "kinds", "bytes"],
            )

    # Any one of the copies has the bytes; the aggregate below takes one.
    pieces_ = ids.join(small(wanted), keys).select("text", "h1", "want").mapInArrow(
        cut,
        "anchor long, segment long, h1 long, origin long, left long, n long, kinds long, bytes binary",
    )
    pieces_ = stage(
        pieces_.dropDuplicates(["anchor", "segment"]), "repeat-bytes"
    )
    # Windows of two segments can only be equal if a core of them is.
    cores = pieces_.mapInArrow(_hashed(rule, cores=True), _HASHED).select(
        "anchor", "h", "segment", F.col("at").alias("part")
    )
    shared = (
        cores.groupBy("anchor", "h")
        .agg(F.min("segment").alias("a"), F.max("segment").alias("b"))
        .filter("a <> b")
    )
    parts = stage(
        cores.join(shared, ["anchor", "h"]).select("anchor", "segment", "part").distinct(),
        "repeat-parts",
    )
    alike = parts.groupBy("anchor", "segment").agg(
        F.min("part").alias("low"), F.max("part").alias("high")
    )
    crowd = alike.groupBy("anchor").agg(F.count("*").alias("crowd"))
    # Of a segment only the bytes around its shared cores go on; ``cut`` lie before them.
    shift = F.lit(rule.length - rule.anchor) - F.col("left")
    cut_ = F.greatest(F.lit(0), F.col("low") * _STEP - shift)
    end = F.least(
        F.length("bytes"), (F.col("high") + 1) * _STEP - 1 - shift + rule.length
    )
    trimmed = pieces_.join(alike, ["anchor", "segment"]).join(crowd, "anchor").select(
        "anchor",
        "segment",
        "h1",
        (F.col("origin") + cut_).alias("origin"),
        (F.col("left") - cut_).alias("left"),
        "n",
        cut_.cast("long").alias("cut"),
        F.substring("bytes", (cut_ + 1).cast("int"), (end - cut_).cast("int")).alias("bytes"),
        (F.col("crowd") <= rule.group).alias("sorts"),
    )
    alike = stage(trimmed, "repeat-alike")
    few = alike.filter("sorts")
    total = few.agg(F.sum(F.length("bytes"))).first()[0] or 0
    tasks = max(1, min(-(-total // rule.block_bytes), 1 << 16))
    sorted_ = few.repartition(tasks, "anchor").sortWithinPartitions("anchor", "segment")
    found = _by_blocks(sorted_, rule).unionAll(
        _by_counts(alike.filter("NOT sorts").join(parts, ["anchor", "segment"]), rule)
    )
    found = stage(found.filter(F.size("first") > 0), "repeat-found")

    window = rule.length - rule.anchor
    begin = F.greatest(F.col("place") - window, F.lit(0))
    last = F.least(F.col("place"), F.col("size") - rule.length)
    same = anchors.join(
        segments.filter("n > 1").select("anchor", "segment"), ["anchor", "segment"]
    ).select(*keys, begin.alias("start"), (last + rule.length).alias("end"))
    run = F.explode(F.arrays_zip("first", "last"))
    other = anchors.join(found, ["anchor", "segment"]).select(
        *keys, begin.alias("begin"), run.alias("run")
    ).select(
        *keys,
        (F.col("begin") + F.col("run.first")).alias("start"),
        (F.col("begin") + F.col("run.last") + rule.length).alias("end"),
    )
    spans = (
        same.unionAll(other)
        .groupBy(*keys)
        # A text has no more of these than it has bytes.
        .agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    )
    return (
        spans.join(copied, keys, "left_anti")
        .withColumn("whole", F.lit(False))
        .unionByName(
            copied.withColumn("whole", F.lit(True)).withColumn(
                "spans",
                F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))),
            )
        )
    )


def remove_repeats(docs: DataFrame, rule: RepeatRule = RepeatRule()) -> DataFrame:
    """``docs`` with ``removed`` (start, end; merged, in order) and ``kept`` (binary)."""
    names = docs.columns
    held = docs.toDF(*[f"c{k}" for k in range(len(names))])
    body = f"c{names.index('text')}"
    covers = stage(_covers(held.select(F.col(body).alias("text")), rule), "repeat-covers")
    small = F.broadcast if covers.count() <= BROADCAST_TEXTS else (lambda df: df)
    joined = held.select("*", *text_id(F.col(body))).join(
        small(covers.drop("whole")), ["h1", "h2", "size"], "left"
    )

    # Merge spans that touch, from the left.
    def merged(spans: Column) -> Column:
        def add(done: Column, s: Column) -> Column:
            end = F.element_at(done, -1)["end"]
            longer = F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(end, s["end"]).alias("end"),
                    )
                ),
            )
            return F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"]), longer).otherwise(
                F.concat(done, F.array(s))
            )

        none = F.array().cast("array<struct<start:bigint,end:bigint>>")
        return F.aggregate(F.array_sort(spans), none, add)

    raw_ = F.coalesce(F.col(body), F.lit("")).cast("binary")
    spans = F.coalesce(
        merged(F.col("spans")), F.array().cast("array<struct<start:bigint,end:bigint>>")
    )
    return (
        joined.withColumn("removed", spans)
        .withColumn("kept", raw_)
        .select(*[f"c{k}" for k in range(len(names))], "removed", "kept", "size")
        .transform(lambda df: _cut_out(df))
        .toDF(*names, "removed", "kept")
    )


def _cut_out(df: DataFrame) -> DataFrame:
    """``kept`` without the bytes of ``removed``."""
    bounds = F.concat(
        F.array(F.lit(0).cast("long")),
        F.flatten(F.transform("removed", lambda s: F.array(s["start"], s["end"]))),
        F.array(F.col("size")),
    )
    parts = F.transform(
        F.sequence(F.lit(0), F.size("removed")),
        lambda k: F.substring(
            F.col("kept"),
            (F.get(bounds, k * 2) + 1).cast("int"),
            (F.get(bounds, k * 2 + 1) - F.get(bounds, k * 2)).cast("int"),
        ),
    )
    joined = F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))
    return df.withColumn("kept", F.when(F.size("removed") > 0, joined).otherwise(F.col("kept"))).drop("size")
