"""Benchmark decontamination by SimHash windows.

Every window of a document that is as long as a benchmark item gets a SimHash
of its words; a document that is shorter than the item is one window as a whole.
Items are indexed by four 16-bit blocks of theirs, each with
all values up to four bits away: two fingerprints within the radius of 19 differ in at most
four bits of some block, so the index misses none of them.  Such a block is 2,517 entries an
item, so a pass takes 2,000 items.  Candidates are
verified by the exact weighted Jaccard similarity of their word 5-grams, each
weighted by how often it occurs.

A window can reach the similarity beyond that radius, mostly with other words at an end of
a short item.  ``exact=True`` adds the windows that hold enough of an item's n-grams, found by
the item's rarest n-grams, of which such a window must have one, so none is missed; ``recall``
says what share of them the index finds.

A window can only reach the similarity if enough of its n-grams occur in some
item; windows that can not are passed over before they are hashed.  That bound is exact.
Documents are read once per block of items and not shuffled.  A block is bounded by the
rule; a larger benchmark takes more passes, never a larger broadcast.

Defined results: a null or empty text or item matches nothing; an item shorter than
the n-gram is compared as one sequence of its words; repeated rows and items are
each reported; other columns of the documents are carried through by
``drop_contaminated`` and ignored by ``find_items``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrecheck.llm.shingles import mix, pieces, word_hashes


@dataclass(frozen=True)
class LeakRule:
    """``similarity`` of a window and an item; ``block_items``, ``block_bytes`` bound a pass.

    ``exact``: also windows beyond the radius of the index.
    """

    words: int = 5
    similarity: float = 0.8
    exact: bool = False
    block_items: int = 2_000
    block_bytes: int = 16 << 20


BLOCKS, BLOCK_BITS, NEAR = 4, 16, 4
RADIUS = BLOCKS * (NEAR + 1) - 1
_MASKS = np.array(
    [sum(1 << b for b in bits) for k in range(NEAR + 1) for bits in combinations(range(16), k)],
    np.uint32,
)
_SEEN_BITS = 22
#: Windows looked up at once.
_WINDOWS = 4096


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = words[:n].copy()
    for k in range(1, size):
        at = mix(at) + words[k : k + n]
    return mix(at)


def _running_bits(words: np.ndarray) -> np.ndarray:
    """Sums of the words' bits as +1 and -1 before each position."""
    bits = np.unpackbits(mix(words ^ np.uint64(0xA5A5)).view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(words) + 1, 64), np.int32)
    np.cumsum(2 * bits.astype(np.int32) - 1, axis=0, out=sums[1:])
    return sums


def _fingerprints(sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    over = (sums[starts + length] - sums[starts]) > 0
    return np.packbits(over, axis=1).view(np.uint64).ravel()


class _Items:
    """The items of one block, ready for a task."""

    def __init__(self, ids: list, texts: list, rule: LeakRule):
        self.rule, self.ids, self.grams = rule, [], []
        prints, lengths = [], []
        vocabulary = defaultdict(list)
        for at, part in pieces(pa.array(texts, pa.string())):
            words, rows = word_hashes(part)
            for k in range(len(part)):
                w = words[rows[k] : rows[k + 1]]
                if len(w):
                    size = min(rule.words, len(w))
                    grams = _grams(w, size)
                    vocabulary[size].append(grams)
                    self.ids.append(ids[at + k])
                    self.grams.append(Counter(grams.tolist()))
                    lengths.append(len(w))
                    prints.append(_fingerprints(_running_bits(w), np.array([0]), len(w))[0])
        self.lengths = np.array(lengths, np.int64)
        self.prints = np.array(prints, np.uint64)
        self.by_size = defaultdict(list)
        for n in np.unique(self.lengths).tolist():
            self.by_size[min(rule.words, n)].append(n)
        self.vocabulary = {}
        for size, grams in vocabulary.items():
            known = np.unique(np.concatenate(grams))
            seen = np.zeros(1 << _SEEN_BITS, bool)
            seen[known >> np.uint64(64 - _SEEN_BITS)] = True
            self.vocabulary[size] = known, seen
        self.own = [np.array(sorted(g), np.uint64) for g in self.grams]
        self.rare = {size: self._rarest(size) for size in self.by_size} if rule.exact else {}
        self.index = []
        for b in range(BLOCKS):
            # Every value that is near enough, with the items it is near to.
            key = (self._block(self.prints, b)[:, None] ^ _MASKS[None, :]).ravel().astype(np.uint16)
            owner = np.repeat(np.arange(len(self.ids), dtype=np.int32), len(_MASKS))
            order = np.argsort(key, kind="stable")
            first = np.searchsorted(key[order], np.arange((1 << BLOCK_BITS) + 1))
            self.index.append((first, owner[order]))

    def _rarest(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n-grams, the first owner of each, and the items that own them.

        The n-grams of an item beside those here are too few to reach the similarity.
        """
        items = [i for i, n in enumerate(self.lengths) if min(self.rule.words, n) == size]
        spread = Counter(g for i in items for g in self.grams[i])
        keys, owner = [], []
        for i in items:
            left = self.grams[i].total()
            # No window with less than this share of the item's n-grams reaches it.
            least = left * (self.rule.similarity - 1e-9)
            for g in sorted(self.grams[i], key=lambda g: (spread[g], g)):
                if left < least:
                    break
                keys.append(g)
                owner.append(i)
                left -= self.grams[i][g]
        keys, owner = np.array(keys, np.uint64), np.array(owner, np.int64)
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        return keys, np.append(first, len(owner)), owner[order]

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        shifted = prints >> np.uint64(b * BLOCK_BITS)
        return (shifted & np.uint64(0xFFFF)).astype(np.uint32)

    def known(self, grams: np.ndarray, size: int) -> np.ndarray:
        known, seen = self.vocabulary[size]
        hit = seen[grams >> np.uint64(64 - _SEEN_BITS)]
        at = np.flatnonzero(hit)
        place = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
        hit[at] = known[place] == grams[at]
        return hit

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) within the radius."""
        for at in range(0, len(prints), _WINDOWS):
            part, met = prints[at : at + _WINDOWS], []
            for b in range(BLOCKS):
                first, owner = self.index[b]
                keys = self._block(part, b)
                counts = first[keys + 1] - first[keys]
                steps = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                window = np.repeat(np.arange(len(part)), counts)
                item = owner[np.repeat(first[keys], counts) + steps]
                near = np.bitwise_count(part[window] ^ self.prints[item]) <= RADIUS
                met.append(window[near] * len(self.ids) + item[near])
            for code in np.unique(np.concatenate(met)).tolist():
                yield at + code // len(self.ids), code % len(self.ids)

    def sharing(
        self, grams: np.ndarray, at: np.ndarray, size: int
    ) -> Iterator[tuple[int, int]]:
        """(item, first word) of the windows with enough of the item's n-grams.

        ``at``: where ``grams`` has an n-gram of any item.
        """
        keys, first, owner = self.rare[size]
        seen = grams[at]
        place = np.minimum(np.searchsorted(keys, seen), len(keys) - 1)
        met = np.unique(place[keys[place] == seen])
        for i in sorted({i for k in met for i in owner[first[k] : first[k + 1]].tolist()}):
            item = int(self.lengths[i]) - size + 1
            own = min(item, len(grams))
            least = max(ceil(self._least(own, item)), 1)
            hits = at[np.isin(seen, self.own[i])]
            if len(hits) < least:
                continue
            mine = np.zeros(len(grams) + 1, np.int64)
            mine[hits + 1] = 1
            mine = np.cumsum(mine)
            for p in np.flatnonzero(mine[own:] - mine[: len(mine) - own] >= least).tolist():
                yield i, p

    def find(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """Item: (similarity, first word, words) of its best and then first window."""
        best: dict[int, tuple[float, int, int]] = {}
        sums = None
        for size, lengths in self.by_size.items():
            grams = _grams(words, size)
            if not len(grams):
                continue
            known = self.known(grams, size)
            met = np.concatenate(([0], np.cumsum(known)))
            if not met[-1]:
                continue
            exact = self.sharing(grams, np.flatnonzero(known), size) if self.rule.exact else ()
            pairs = set(exact)
            for n in lengths:
                held = min(n, len(words))
                m = held - size + 1
                least = self._least(m, n - size + 1)
                if met[-1] < least:
                    continue
                starts = np.flatnonzero(met[m:] - met[:-m] >= least)
                if not len(starts):
                    continue
                if sums is None:
                    sums = _running_bits(words)
                pairs.update(
                    (i, int(starts[w]))
                    for w, i in self.candidates(_fingerprints(sums, starts, held))
                    if self.lengths[i] == n
                )
            for i, p in sorted(pairs):
                held = min(int(self.lengths[i]), len(words))
                like = self._similarity(grams[p : p + held - size + 1], i)
                if like >= self.rule.similarity and (i not in best or like > best[i][0]):
                    best[i] = (like, p, held)
        return best

    def _least(self, own, item: int):
        """How many n-grams a window of ``own`` and an item of ``item`` of them must share."""
        return (own + item) * (self.rule.similarity / (1 + self.rule.similarity) - 5e-10)

    def _similarity(self, grams: np.ndarray, item: int) -> float:
        own, other = Counter(grams.tolist()), self.grams[item]
        both = sum(min(n, other[g]) for g, n in own.items() if g in other)
        return both / (own.total() + other.total() - both)

    def suspects(self, words: np.ndarray, rows: np.ndarray) -> list[int]:
        """Rows with enough n-grams of any item to hold one."""
        out = set()
        for size, lengths in self.by_size.items():
            grams = _grams(words, size)
            if not len(grams):
                continue
            met = np.concatenate(([0], np.cumsum(self.known(grams, size))))
            # A row's n-grams, the last of which do not reach into the next row.
            first = np.minimum(rows[:-1], len(grams))
            last = np.maximum(first, np.minimum(rows[1:] - size + 1, len(grams)))
            # The shortest item asks for the fewest, of a row that is shorter too.
            shortest = min(lengths) - size + 1
            own = np.minimum(last - first, shortest)
            enough = met[last] - met[first] >= self._least(own, shortest)
            out.update(np.flatnonzero(enough & (own > 0)).tolist())
        return sorted(out)


def _blocks(items: DataFrame, rule: LeakRule) -> Iterator[DataFrame]:
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    count = max(-(-n // rule.block_items), -(-(size or 0) // rule.block_bytes), 1)
    for k in range(count):
        yield items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)


def _scan(
    block: DataFrame, rule: LeakRule
) -> Callable[[pa.RecordBatch], Iterator[tuple[int, dict, _Items]]]:
    """For each row of a batch with items in it: the row, what was found, the items."""
    rows = block.select("item_id", "text").collect()
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    held: list[_Items] = []

    def scan(batch: pa.RecordBatch, text: str):
        if not held:
            held.append(_Items(ids, texts, rule))
        items = held[0]
        for at, part in pieces(batch.column(text)):
            words, ends = word_hashes(part)
            for k in items.suspects(words, ends):
                if found := items.find(words[ends[k] : ends[k + 1]]):
                    yield at + k, found, items

    return scan


def find_items(docs: DataFrame, items: DataFrame, rule: LeakRule = LeakRule()) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words of every item within a document.

    ``n_words`` are those of the window: the item's, or all of a shorter document.
    """
    items = items.select("item_id", "text")
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    out = None
    for block in _blocks(items, rule):
        scan = _scan(block, rule)

        def told(batches, scan=scan):
            for batch in batches:
                met = [
                    (k, known.ids[i], s, p, n)
                    for k, found, known in scan(batch, "text")
                    for i, (s, p, n) in sorted(found.items())
                ]
                if met:
                    at, *columns = zip(*met, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(at)), *map(pa.array, columns)],
                        ["doc_id", "item_id", "similarity", "first_word", "n_words"],
                    )

        part = docs.select("doc_id", "text").mapInArrow(
            told,
            f"doc_id {doc_kind}, item_id {item_kind}, similarity double, "
            "first_word long, n_words long",
        )
        out = part if out is None else out.unionAll(part)
    return out


def recall(docs: DataFrame, items: DataFrame, rule: LeakRule = LeakRule()) -> tuple[int, int]:
    """How many of all items within documents the index finds, and how many there are."""
    keys = ["doc_id", "item_id"]
    every = find_items(docs, items, replace(rule, exact=True)).select(*keys).distinct()
    found = find_items(docs, items, replace(rule, exact=False)).select(*keys).distinct()
    both = every.withColumn("every", F.lit(1)).join(found.withColumn("found", F.lit(1)), keys, "left")
    row = both.agg(F.count("found").alias("found"), F.count("every").alias("every")).first()
    return row.found, row.every


def drop_contaminated(docs: DataFrame, items: DataFrame, rule: LeakRule = LeakRule()) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    at = docs.columns.index("text")
    for block in _blocks(items.select("item_id", "text"), rule):
        scan = _scan(block, rule)

        def clean(batches, scan=scan):
            for batch in batches:
                kept = np.ones(batch.num_rows, bool)
                names = [f"c{k}" for k in range(batch.num_columns)]
                named = pa.RecordBatch.from_arrays(batch.columns, names)
                kept[[k for k, _, _ in scan(named, f"c{at}")]] = False
                yield batch.filter(pa.array(kept))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
