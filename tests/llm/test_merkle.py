"""The manifest against a plain one, and the layout of its blocks."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from payrecheck.llm import merkle as M


def _hash(text):
    return sha256(text.encode()).hexdigest()


def _leaf(row, low=False):
    out = ""
    for k, value in enumerate(row):
        if low and k == 4 and value is not None:
            value = "".join(c.lower() if "A" <= c <= "Z" else c for c in value)
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return _hash(out)


def _tree(leaves):
    """All levels, and the siblings of each leaf as (before, after)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_hash("".join(last[k : k + 16])) for k in range(0, len(last), 16)])
    paths = []
    for at in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = level[at // 16 * 16 :][:16]
            path.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
            at //= 16
        paths.append(path)
    return levels[-1][0] if leaves else None, paths


def plain(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        mine = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        trees.append((mine, *_tree([_leaf(r) for r in mine])))
    root, tops = _tree([t[1] for t in trees])
    out = []
    for (mine, subroot, paths), top in zip(trees, tops, strict=True):
        for row, path in zip(mine, paths, strict=True):
            touched = row[0] is not None and crc32(str(row[0]).encode()) % 5 == 0
            folded = _leaf(row, touched)
            for before, after in path + top:
                folded = _hash(before + folded + after)
            proof = _hash("".join(a + b for a, b in path + top))
            out.append((row[0], _leaf(row), subroot, root, proof, folded, folded == root))
    return out


KIND = "doc_id long, source string, lang string, n_chars long, text string"


def _rows(n, sources, seed=0):
    rng = random.Random(seed)
    return [
        (
            k * 3,
            rng.choice(sources),
            rng.choice(["en", None]),
            rng.choice([k, None]),
            rng.choice([None, "", f"Text Number {k}", "ÀÉ plain", "lower é"]),
        )
        for k in range(n)
    ]


def proved(spark, rows, kind=KIND):
    docs = spark.createDataFrame(rows, kind).repartition(3)
    got = M.prove(M.document_manifest(docs), "claim", ["key"]).select(
        "key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 16, 17])
def test_one_source(spark, n):
    rows = _rows(n, ["only"])
    assert proved(spark, rows) == sorted(plain(rows), key=str)


def test_sources_of_many_sizes_by_small_blocks(spark, monkeypatch):
    # Blocks of one level: several rounds, for the sources and for the tree over them.
    monkeypatch.setattr(M, "LEVELS", 1)
    monkeypatch.setattr(M, "BLOCK", 16)
    names = ["hot"] * 60 + [None, "", "é", *(f"s{k}" for k in range(30))]
    rows = _rows(900, names, 3)
    # Repeated rows and keys, and a null key.
    rows += rows[:3] + [(3, "hot", "x", 1, "other"), (None, "hot", None, None, None)]
    assert proved(spark, rows) == sorted(plain(rows), key=str)


def test_more_than_a_block(spark):
    rows = [(k, "big" if k % 50 else "small", "en", k, f"T{k}") for k in range(M.BLOCK + 700)]
    assert proved(spark, rows) == sorted(plain(rows), key=str)


def test_no_rows_and_other_columns(spark):
    assert proved(spark, []) == []
    empty = M.document_manifest(spark.createDataFrame([], KIND))
    assert empty.root == _hash("")
    rows = _rows(40, ["a", "b"], 1)
    more = [(*r, 1, "x", 2, "y") for r in rows]
    got = proved(spark, more, KIND + ", leaf int, key string, `group` int, _at string")
    assert got == sorted(plain(rows), key=str)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 300, 4095, 4096])
def test_layout_is_gapless_and_recursive(n):
    height = M.block_height(n, n)
    places = M.layout(n, height)
    every = np.concatenate(places)
    assert sorted(every.tolist()) == list(range(len(every)))
    assert places[-1][0] == 0
    if height == 4:
        # Split at half the height: each node above the leaves lies beside its own leaves.
        for parent in range(len(places[1])):
            leaves = places[0][parent * 16 : parent * 16 + 16]
            assert leaves.tolist() == list(range(places[1][parent] + 1, places[1][parent] + 1 + len(leaves)))


def test_any_change_is_found():
    rng = np.random.default_rng(2)
    leaves = rng.integers(0, 256, (700, 32)).astype(np.uint8)
    block = M.build_block(leaves, M.block_height(700, 700))
    find = M.Siblings(block, 700, M.block_height(700, 700))
    root = block[0].tobytes().hex().encode()
    for k in (0, 15, 16, 699):
        assert M.fold(leaves[k].tobytes().hex().encode(), find.path(k)) == root
        assert M.fold(leaves[k - 1].tobytes().hex().encode(), find.path(k)) != root
