"""Whitening of embeddings.

Vectors become whole numbers, floor(64 c) + 1,000,000, so that sums are exact.  Each task
centres its rows, (n x - S) / n, and reduces them block by block to one triangular factor
by QR; factors meet sixteen at a time until one is left.  The covariance itself is never
formed, so small directions keep their accuracy.  The last factor has as many rows as a
vector has entries, whatever the table; the driver makes it bidiagonal, finds its singular values
by dqds and their vectors by twisted factorisations (``bidiagonal``).  A last
pass projects the rows, and the covariance of what comes out is merged in the same tree,
centred block by block.

Defined results: a null or empty vector, or one with null or non-finite entries, is left
out; so is one whose length is not the commonest (of equally common ones the least), as it
has no place in the covariance.  Entries beyond 2**40 are taken as 2**40.  A direction without
variance, within rounding, has whitened 0.0, explained 0.0 and is no part of the
identity error.  Equal values may have any orthogonal directions within their space, the same for
all rows.  Repeated rows count each.  A deviation that no long holds is null.  A table with no
usable row gives no rows.  Of the other columns those asked for are carried through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payrecheck.llm.bidiagonal import right_vectors
from payrecheck.session import stage

SCALE, OFFSET = 64, 1_000_000
#: Rows reduced at once, and factors merged by one task.
BLOCK_ROWS, FAN = 2048, 16
_LARGEST = float(1 << 40)


@dataclass(frozen=True)
class Whitening:
    """``directions``: unit columns by falling ``values`` (the variances); ``sums`` over ``n`` rows."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        """Directions over the root of their variance."""
        root = np.sqrt(np.where(self.values > 0, self.values, 1.0))
        return self.directions / root

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) if self.trace else 0.0 for v in self.values]


def usable(rows: DataFrame, vector: str = "embedding", keep: Sequence[str] = ()) -> DataFrame:
    """The ``keep`` columns and x (array of long) of the rows with usable vectors, written once."""
    entry = F.transform(vector, lambda c: c.cast("double"))
    held = rows.select(*[F.col(c) for c in keep], entry.alias("_v")).filter(
        (F.size("_v") > 0)
        & F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    lengths = held.groupBy(F.size("_v").alias("length")).count()
    first = lengths.orderBy(F.desc("count"), "length").first()
    x = F.transform(
        "_v",
        lambda c: F.floor(F.greatest(F.least(c, F.lit(_LARGEST)), F.lit(-_LARGEST)) * SCALE)
        + OFFSET,
    )
    return stage(
        held.filter(F.size("_v") == (first.length if first else 0)).select(*keep, x.alias("x")),
        "vectors",
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _merged(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """What ``merge`` makes of all rows' ``part``, at most ``FAN`` at a time."""

    def meet(table: pa.Table) -> pa.Table:
        made = merge(table.column("part").to_pylist())
        key = table.column("key")[0].as_py() // FAN
        return pa.table({"key": pa.array([key], pa.int64()), "part": pa.array([made], pa.binary())})

    while True:
        parts = stage(parts, "factors")
        left = parts.agg(F.max("key")).first()[0]
        if left is None:
            return None
        grouped = parts.groupBy(F.expr(f"key div {FAN}").alias("group"))
        parts = grouped.applyInArrow(meet, "key bigint, part binary")
        if left < FAN:
            return bytes(parts.first().part)


def _per_task(x: DataFrame, work: Callable[[Iterator[np.ndarray]], bytes]) -> DataFrame:
    """key, part: what ``work`` makes of the blocks of each task that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None

        def blocks() -> Iterator[np.ndarray]:
            nonlocal key
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(at, BLOCK_ROWS)
                    key = part.column(1)[0].as_py()
                    yield _matrix(part.column(0))

        made = work(blocks())
        if key is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([made], pa.binary())], ["key", "part"]
            )

    numbered = x.select("x", F.spark_partition_id().cast("bigint").alias("key"))
    return numbered.mapInArrow(run, "key bigint, part binary")


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The triangular factor, always square."""
    out = np.linalg.qr(rows, mode="r")
    d = rows.shape[1]
    return out if len(out) == d else np.vstack([out, np.zeros((d - len(out), d))])


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (x * n - sums) / n


def fit(x: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of all rows of ``usable``; nothing where there are none."""
    totals = (
        x.select(F.posexplode("x").alias("at", "c"))
        .groupBy("at")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s"))
        .orderBy("at")
        .collect()  # as many rows as a vector has entries
    )
    if not totals:
        return None
    n, sums, d = totals[0].n, np.array([t.s for t in totals], np.int64), len(totals)

    def reduce(blocks: Iterator[np.ndarray]) -> bytes:
        factor = np.zeros((0, d))
        for block in blocks:
            factor = _triangle(np.vstack([factor, _centred(block, n, sums)]))
        return factor.tobytes()

    def meet(parts: list[bytes]) -> bytes:
        return _triangle(np.vstack([np.frombuffer(p).reshape(d, d) for p in parts])).tobytes()

    last = _merged(_per_task(x, reduce), meet)
    factor = np.frombuffer(last).reshape(d, d)
    values, directions, total = right_vectors(factor, min(components, d))
    return Whitening(n, sums, directions, values / n, total / n)


def identity_error(x: DataFrame, model: Whitening) -> float:
    """How far the covariance of the whitened rows is from the identity, at most."""
    scaled, n, sums = model.scaled, model.n, model.sums
    k = scaled.shape[1]

    def meet(parts: list[np.ndarray]) -> np.ndarray:
        """Rows (count), mean and centred products of all, in one array."""
        counts = np.array([p[0] for p in parts])
        means = np.array([p[1 : k + 1] for p in parts])
        mean = counts @ means / counts.sum()
        apart = means - mean
        products = sum(p[k + 1 :] for p in parts) + ((apart.T * counts) @ apart).ravel()
        return np.concatenate([[counts.sum()], mean, products])

    def reduce(blocks: Iterator[np.ndarray]) -> bytes:
        state = None
        for block in blocks:
            w = _centred(block, n, sums) @ scaled
            mean = w.mean(axis=0)
            own = np.concatenate([[float(len(w))], mean, ((w - mean).T @ (w - mean)).ravel()])
            state = own if state is None else meet([state, own])
        return b"" if state is None else state.tobytes()

    last = _merged(
        _per_task(x, reduce), lambda parts: meet([np.frombuffer(p) for p in parts]).tobytes()
    )
    covariance = np.frombuffer(last)[k + 1 :].reshape(k, k) / n
    varied = model.values > 0
    off = np.abs(covariance - np.eye(k))[np.ix_(varied, varied)]
    return float(off.max(initial=0.0))


def whiten(x: DataFrame, model: Whitening, keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, deviation and whitened (array of double, one for each component) of each row."""
    scaled = np.where(model.values > 0, model.scaled, 0.0)
    n, sums, names = model.n, model.sums, list(keep)
    limit = 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                apart = _matrix(part.column(len(names))) * n - sums
                w = apart / n @ scaled
                rough = (apart.astype(float) ** 2).sum(axis=1)
                if rough.max(initial=0.0) < limit:
                    deviation = (apart**2).sum(axis=1).tolist()
                else:
                    whole = [sum(v * v for v in row) for row in apart.tolist()]
                    deviation = [v if v < 1 << 63 else None for v in whole]
                offsets = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[: len(names)],
                        pa.array(deviation, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(w.ravel())),
                    ],
                    [*(f"c{k}" for k in range(len(names))), "deviation", "whitened"],
                )

    kinds = dict(x.dtypes)
    fields = [f"c{k} {kinds[name]}" for k, name in enumerate(names)]
    schema = ", ".join([*fields, "deviation bigint", "whitened array<double>"])
    return x.select(*names, "x").mapInArrow(run, schema).toDF(*names, "deviation", "whitened")
