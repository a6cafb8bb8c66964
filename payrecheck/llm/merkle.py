"""Merkle manifest of a dataset, its trees stored in van Emde Boas layout.

Rows become leaves, in order within their group; every 16 neighbours become the hash of
their hex digests until one is left, the group's subroot.  The subroots, in order of their groups,
become the root in the same way.

A tree is cut into aligned blocks of three levels above 4,096 leaves.  A block is
one row with its digests in van Emde Boas order: the tree is split at half its height, the
upper part comes first and the lower subtrees follow, each laid out in the same way.
Where a node lies is computed from its level and number alone (``slots``); the same arithmetic
places nodes when a block is made and finds siblings when a proof is read.  Only the last
subtree of a tree can be ragged, so nothing is left empty.  The roots of the blocks are the
leaves of the next round of blocks, up to a single one, and proofs come down the same way:
what lies above a block is joined to it once, not to each leaf.

Leaves get their places by range partitions (``operators.ranks``), so a group with
most of all rows is spread over many blocks.  No task holds more than a block and the
claims on it; the driver sees the numbers of blocks and the root.

Defined results: null fields are ``-``; a null group comes first; equal keys are ordered by
their leaves and each has a place; a lone leaf is its own subroot; a table without rows has
the hash of nothing as its root and no proofs; other columns do not enter a leaf, and
names that clash do no harm, as only the columns asked for are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payrecheck.operators.ranks import with_rank
from payrecheck.session import stage

FAN = 16
#: Levels above the leaves of a block.
LEVELS = 3
BLOCK = FAN**LEVELS
_WIDE = 32


def _width(n: int, level: int) -> int:
    """Nodes of a level of a tree with ``n`` leaves."""
    return -(-n // FAN**level)


def _nodes(n: int, height: int) -> int:
    return sum(_width(n, level) for level in range(height))


def slots(n: int, height: int, level: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` of ``level`` lie, in a tree of ``height`` levels over ``n`` leaves."""
    if height == 1:
        return np.zeros(len(index), np.int64)
    low = height // 2
    if level >= low:
        return slots(_width(n, low), height - low, level - low, index)
    above = _nodes(_width(n, low), height - low)
    leaves = FAN ** (low - 1)
    each = FAN ** (low - 1 - level)
    tree, inner = index // each, index % each
    last = (n - 1) // leaves
    out = above + tree * _nodes(leaves, low)
    ragged = tree == last
    out[~ragged] += slots(leaves, low, level, inner[~ragged])
    out[ragged] += slots(n - last * leaves, low, level, inner[ragged])
    return out


@lru_cache(maxsize=64)
def layout(n: int, height: int) -> tuple[np.ndarray, ...]:
    """The slots of every level, leaves first."""
    return tuple(slots(n, height, k, np.arange(_width(n, k))) for k in range(height))


def _levels(n: int) -> int:
    """Levels above ``n`` leaves until one node is left."""
    levels = 0
    while n > 1:
        n, levels = _width(n, 1), levels + 1
    return levels


def block_height(n: int, n_tree: int) -> int:
    """Levels of nodes of a block with ``n`` leaves of a tree with ``n_tree``."""
    return 1 + (LEVELS if n_tree > BLOCK else _levels(n))


def build_block(leaves: np.ndarray, height: int) -> np.ndarray:
    """All digests of a block, 32 bytes each, in their slots; the root is in the first."""
    n = len(leaves)
    out = np.empty((_nodes(n, height), _WIDE), np.uint8)
    places = layout(n, height)
    out[places[0]] = leaves
    run = FAN * 2 * _WIDE
    for level in range(1, height):
        text = out[places[level - 1]].tobytes().hex().encode()
        made = b"".join(sha256(text[k : k + run]).digest() for k in range(0, len(text), run))
        out[places[level]] = np.frombuffer(made, np.uint8).reshape(-1, _WIDE)
    return out


class Siblings:
    """The siblings of the nodes of a block, as hex text before and after a node."""

    def __init__(self, block: np.ndarray, n: int, height: int) -> None:
        self.height = height
        self.texts = [block[place].tobytes().hex().encode() for place in layout(n, height)[:-1]]

    def path(self, leaf: int) -> list[tuple[bytes, bytes]]:
        out = []
        for text in self.texts:
            first = leaf // FAN * FAN
            run = text[first * 2 * _WIDE : (first + FAN) * 2 * _WIDE]
            at = (leaf - first) * 2 * _WIDE
            out.append((run[:at], run[at + 2 * _WIDE :]))
            leaf //= FAN
        return out


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root above a node, both as hex text."""
    for before, after in path:
        digest = sha256(before + digest + after).hexdigest().encode()
    return digest


def leaf_digest(fields: Sequence[str]) -> Column:
    """Hex digest of a row: each field by its length in bytes and its value, or ``-``."""

    def part(name: str) -> Column:
        text = F.col(name).cast("string")
        value = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        return F.coalesce(value, F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)), 256)


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the rows with tree, pos, n and leaf.  ``blocks``: tables by round, leaves first
    (tree, block, n_tree, n, root, digests).  ``top``: the same of the tree over the subroots.
    ``root``: hex."""

    leaves: DataFrame
    blocks: list[DataFrame]
    top: list[DataFrame]
    root: str


def _block_of(pos: str) -> Column:
    return F.shiftright(pos, LEVELS * 4).alias("block")


_BLOCK_KIND = "tree bigint, block bigint, n_tree bigint, n int, root binary, digests binary"


def build_blocks(leaves: DataFrame) -> list[DataFrame]:
    """The rounds of blocks over ``leaves`` (tree, pos, n, leaf), n the leaves of the tree."""

    def make(key: tuple, table: pa.Table) -> pa.Table:
        place = table.column("pos").to_numpy() % BLOCK
        digests = b"".join(table.column("leaf").to_pylist())
        sorted_ = np.frombuffer(digests, np.uint8).reshape(-1, _WIDE)[np.argsort(place)]
        n, n_tree = len(sorted_), table.column("n")[0].as_py()
        block = build_block(sorted_, block_height(n, n_tree))
        values = [key[0].as_py(), key[1].as_py(), n_tree, n, block[0].tobytes(), block.tobytes()]
        names = ["tree", "block", "n_tree", "n", "root", "digests"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table(
            [pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names
        )

    rounds = []
    while True:
        numbered = leaves.select("tree", _block_of("pos"), "pos", "n", "leaf")
        made = stage(
            numbered.groupBy("tree", "block").applyInArrow(make, _BLOCK_KIND), "merkle-blocks"
        )
        rounds.append(made)
        over = made.filter(F.col("n_tree") > BLOCK)
        if over.isEmpty():
            return rounds
        leaves = over.select(
            "tree",
            F.col("block").alias("pos"),
            F.ceil(F.col("n_tree") / BLOCK).alias("n"),
            F.col("root").alias("leaf"),
        )


def build_manifest(
    rows: DataFrame, leaf: Column, group: str, order: str, carry: dict[str, Column] | None = None
) -> Manifest:
    """The trees over ``rows``: one for each value of ``group``, its leaves by ``order``.

    ``carry``: further columns kept beside the leaves.
    """
    kept = rows.select(
        F.col(group).alias("group"),
        F.col(order).alias("key"),
        F.unhex(leaf).alias("leaf"),
        *[c.alias(n) for n, c in (carry or {}).items()],
    )
    by = [F.col("key").asc_nulls_first(), F.col("leaf")]
    leaves = stage(
        with_rank(kept, by, ["group"], rank="pos", size="n", group="tree"), "merkle-leaves"
    )
    blocks = build_blocks(leaves)
    subroots = blocks[0].filter(F.col("n_tree") <= BLOCK).select("tree", "root")
    for done in blocks[1:]:
        subroots = subroots.union(done.filter(F.col("n_tree") <= BLOCK).select("tree", "root"))
    n_trees = subroots.count()
    top = build_blocks(
        subroots.select(
            F.lit(0).cast("bigint").alias("tree"),
            F.col("tree").alias("pos"),
            F.lit(n_trees).cast("bigint").alias("n"),
            F.col("root").alias("leaf"),
        )
    )
    last = top[-1].first()
    root = bytes(last.root).hex() if last else sha256(b"").hexdigest()
    return Manifest(leaves, blocks, top, root)


_PATH = "array<struct<before:binary,after:binary>>"
_PATH_TYPE = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
_ABOVE_KIND = f"tree bigint, block bigint, subroot binary, path {_PATH}"


def _down(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """What lies above the leaves of ``blocks``, from what lies above the blocks themselves."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = np.frombuffer(row["digests"], np.uint8).reshape(-1, _WIDE)
                n = row["n"]
                find = Siblings(block, n, block_height(n, row["n_tree"]))
                paths = []
                for k in range(n):
                    own = [
                        {"before": bytes.fromhex(a.decode()), "after": bytes.fromhex(b.decode())}
                        for a, b in find.path(k)
                    ]
                    paths.append(own + row["path"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * n, pa.int64()),
                        pa.array(range(row["block"] * BLOCK, row["block"] * BLOCK + n), pa.int64()),
                        pa.array([row["subroot"]] * n, pa.binary()),
                        pa.array(paths, _PATH_TYPE),
                    ],
                    ["tree", "block", "subroot", "path"],
                )

    joined = blocks.join(above, ["tree", "block"])
    return joined.select("tree", "block", "n_tree", "n", "digests", "subroot", "path").mapInArrow(
        spread, _ABOVE_KIND
    )


def _no_path() -> Column:
    return F.array().cast(_PATH)


def paths_above(manifest: Manifest) -> DataFrame:
    """tree, block, subroot, path: what lies above each block of leaves, up to the root."""
    own = ["tree", "block"]
    over_top = manifest.top[-1].select(*own, F.col("root").alias("subroot"), _no_path().alias("path"))
    for round_ in reversed(manifest.top):
        over_top = _down(round_, over_top)
    over_trees = stage(over_top.select(F.col("block").alias("tree"), "path"), "merkle-above")
    above = None
    for k, round_ in reversed(list(enumerate(manifest.blocks))):
        # Trees whose last block is in this round.
        ends = (
            round_.filter(F.col("n_tree") <= BLOCK)
            .join(over_trees, "tree")
            .select(*own, F.col("root").alias("subroot"), "path")
        )
        above = stage(ends if above is None else above.union(ends), "merkle-above")
        if k:
            above = _down(round_, above)
    return above


def prove(manifest: Manifest, claim: str = "leaf", carry: Sequence[str] = ("key",)) -> DataFrame:
    """The proof of every leaf, checked with the digest in column ``claim``.

    ``carry``, leaf, subroot, root, proof_sha256 (the siblings from the leaf to the root),
    folded_root (the root that follows from the claim) and verified.
    """
    claims = manifest.leaves.select(
        "tree",
        _block_of("pos"),
        "pos",
        F.col("leaf").alias("_leaf"),
        F.col(claim).alias("_claim"),
        *carry,
    )
    over = manifest.blocks[0].join(paths_above(manifest), ["tree", "block"])
    names = list(carry)
    kinds = dict(claims.dtypes)
    fields = [f"c{k} {kinds[n]}" for k, n in enumerate(names)]
    added = ["leaf", "subroot", "proof_sha256", "folded_root"]

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        row = right.slice(0, 1).to_pylist()[0]
        block = np.frombuffer(row["digests"], np.uint8).reshape(-1, _WIDE)
        find = Siblings(block, row["n"], block_height(row["n"], row["n_tree"]))
        above = [(p["before"].hex().encode(), p["after"].hex().encode()) for p in row["path"]]
        tail = b"".join(a + b for a, b in above)
        proofs, folded = [], []
        for pos, digest in zip(
            left.column("pos").to_pylist(), left.column("_claim").to_pylist(), strict=True
        ):
            own = find.path(pos % BLOCK)
            proof = sha256(b"".join(a + b for a, b in own))
            proof.update(tail)
            proofs.append(proof.hexdigest())
            folded.append(fold(digest.hex().encode(), own + above).decode())
        subroot = row["subroot"].hex()
        return pa.table(
            [
                *(left.column(n) for n in names),
                pa.array([d.hex() for d in left.column("_leaf").to_pylist()], pa.string()),
                pa.array([subroot] * left.num_rows, pa.string()),
                pa.array(proofs, pa.string()),
                pa.array(folded, pa.string()),
            ],
            names=[*(f"c{k}" for k in range(len(names))), *added],
        )

    schema = ", ".join([*fields, *(f"{n} string" for n in added)])
    checked = (
        claims.groupBy("tree", "block")
        .cogroup(
            over.select("tree", "block", "n_tree", "n", "digests", "subroot", "path").groupBy(
                "tree", "block"
            )
        )
        .applyInArrow(check, schema)
        .toDF(*names, *added)
    )
    root = F.lit(manifest.root)
    return checked.withColumn("root", root).withColumn("verified", F.col("folded_root") == root)


LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_manifest(docs: DataFrame) -> Manifest:
    """The manifest of documents, with the column ``claim``: the leaf of a tampered row.

    Tampered are the rows whose doc_id, as text, has a CRC-32 that 5 divides: their text
    loses its ASCII capitals.
    """
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    low = F.translate("text", capitals, capitals.lower())
    rows = docs.select(*LEAF_FIELDS, F.when(touched, low).otherwise(F.col("text")).alias("_low"))
    claim = F.when(touched, leaf_digest([*LEAF_FIELDS[:-1], "_low"])).otherwise(
        leaf_digest(LEAF_FIELDS)
    )
    return build_manifest(
        rows, leaf_digest(LEAF_FIELDS), "source", "doc_id", {"claim": F.unhex(claim)}
    )
