"""Language identification by sparse multinomial logistic regression.

Features are character 1- to 3-grams of the lower-cased text, hashed into a fixed number of
buckets and weighted by TF-IDF; tf is the share of the text's n-grams, so a text of
any length is scored by one pass over it.  Document frequencies count every learning
document.  The weights are fitted by follow-the-regularised-leader with an elastic net, on a
sample of each language that the rule bounds, and the softmax is calibrated by a
temperature on a part of the sample that the weights did not see.

Learning and scoring run over whole texts where they lie; only bucket
counts are shuffled.  What goes back to the tasks has buckets times languages entries.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any
label to learn from every text is; repeated rows score alike; a null doc_id
is never learnt from and not held out; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payrecheck.llm.shingles import mix, pieces, raw


@dataclass(frozen=True)
class LanguageRule:
    """``sample``: learning documents of a language that are fitted, about.

    ``alpha``, ``beta``: step sizes; ``l1``, ``l2``: the elastic net; ``scale``: of tf-idf.
    """

    bits: int = 15
    orders: int = 3
    sample: int = 1000
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    scale: float = 30.0
    seed: int = 7


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: buckets + 1 rows, one column a language, idf included; the last row is zero.
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def held_out(doc_id: Column) -> Column:
    """The documents that are not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _buckets(texts: pa.Array, rule: LanguageRule):
    """For slices of the texts: first row, one array of buckets an order, row of each character."""
    for at, part in pieces(pc.utf8_lower(texts)):
        data, offsets = raw(part)
        points = np.frombuffer(data.tobytes().decode(errors="replace").encode("utf-32-le"), np.uint32)
        firsts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        rows = np.repeat(np.arange(len(part)), np.diff(firsts))
        h = np.zeros(len(points), np.uint64)
        grams = []
        left = firsts[1:][rows] - np.arange(len(points))
        for k in range(rule.orders):
            n = len(points) - k
            h = h[: max(n, 0)]
            h = mix(h * np.uint64(31) + points[k:].astype(np.uint64) + np.uint64(k + 1))
            b = (h >> np.uint64(64 - rule.bits)).astype(np.int32)
            whole = np.full(len(points), 1 << rule.bits, np.int32)
            whole[: len(b)] = np.where(left[: len(b)] > k, b, 1 << rule.bits)
            grams.append(whole)
        yield at, len(part), grams, rows


def document_frequencies(texts: DataFrame, rule: LanguageRule) -> tuple[np.ndarray, int]:
    """Documents with each bucket, and all of them."""
    size = (1 << rule.bits) + 1

    def count(batches):
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            for _, docs, grams, rows in _buckets(batch.column("text"), rule):
                n += docs
                for a in range(0, docs, 64):
                    part = (rows >= a) & (rows < a + 64)
                    seen = np.zeros((min(64, docs - a), size), bool)
                    for g in grams:
                        seen[rows[part] - a, g[part]] = True
                    total += seen.sum(axis=0)
        total[-1] = n
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    rows = (
        texts.select("text")
        .mapInArrow(count, "bucket long, n long")
        .groupBy("bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    out = np.zeros(size, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out[:-1], int(out[-1])


def _sample(docs: DataFrame, rule: LanguageRule) -> pd.DataFrame:
    """lang, and buckets with their counts, of a bounded sample of each language."""
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64(F.lit(rule.seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    chosen = (
        docs.join(F.broadcast(sizes), "lang")
        .filter(share < F.lit(float(rule.sample)) / F.col("n"))
        .select("lang", "text")
    )

    def featured(batches):
        for batch in batches:
            names, where, counts = [], [], []
            for at, docs_, grams, rows in _buckets(batch.column("text"), rule):
                for k in range(docs_):
                    own = np.concatenate([g[np.searchsorted(rows, k) : np.searchsorted(rows, k, "right")] for g in grams])
                    b, n = np.unique(own[own < 1 << rule.bits], return_counts=True)
                    names.append(batch.column("lang")[at + k].as_py())
                    where.append(b.astype(np.int32))
                    counts.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array(where, pa.list_(pa.int32())),
                    pa.array(counts, pa.list_(pa.int32())),
                ],
                ["lang", "buckets", "counts"],
            )

    return chosen.mapInArrow(featured, "lang string, buckets array<int>, counts array<int>").toPandas()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _fit(xs: list, ys: np.ndarray, k: int, size: int, rule: LanguageRule) -> np.ndarray:
    """FTRL-proximal weights; the last row is the bias."""
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))
    rng = np.random.default_rng(rule.seed)

    def weights(at):
        zz = z[at]
        w = -(zz - np.sign(zz) * rule.l1) / ((rule.beta + np.sqrt(n[at])) / rule.alpha + rule.l2)
        return np.where(np.abs(zz) <= rule.l1, 0.0, w)

    for _ in range(rule.epochs):
        for i in rng.permutation(len(xs)):
            at, x = xs[i]
            w = weights(at)
            p = _softmax(x @ w)
            p[ys[i]] -= 1
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rule.alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(slice(None))


def train(docs: DataFrame, rule: LanguageRule = LanguageRule()) -> LanguageModel:
    """Learn from ``docs`` (doc_id, text, lang); rows without a label or id are left out."""
    docs = docs.select("doc_id", "text", "lang").filter(
        "doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL"
    )
    size = 1 << rule.bits
    sample = _sample(docs, rule)
    sample = sample[sample["buckets"].map(len) > 0].sort_values("lang", ignore_index=True)
    languages = sorted(set(sample["lang"]))
    if not languages:
        return LanguageModel([], np.zeros((size + 1, 0), np.float32), np.zeros(0), 1.0)
    met, n = document_frequencies(docs, rule)
    idf = np.log((1 + n) / (1 + met)) + 1
    xs = []
    for b, c in zip(sample["buckets"], sample["counts"], strict=True):
        b, c = np.asarray(b), np.asarray(c, float)
        x = c / c.sum() * idf[b] * rule.scale
        xs.append((np.append(b, size), np.append(x, 1.0)))
    ys = np.searchsorted(languages, sample["lang"].to_numpy(str))
    # Every fifth is kept for the temperature.
    order = np.random.default_rng(rule.seed).permutation(len(xs))
    kept, fitted = order[::5], np.setdiff1d(order, order[::5])
    if not len(fitted):
        fitted = order
    w = _fit([xs[i] for i in fitted], ys[fitted], len(languages), size, rule)
    logits = np.array([x @ w[at] for at, x in (xs[i] for i in kept)])
    grid = np.geomspace(0.05, 20, 121)
    loss = [
        -np.log(np.maximum(_softmax(logits / t)[np.arange(len(kept)), ys[kept]], 1e-12)).mean()
        for t in grid
    ]
    table = np.vstack([w[:-1] * idf[:, None] * rule.scale, np.zeros(len(languages))])
    return LanguageModel(
        languages, table.astype(np.float32), w[-1], float(grid[int(np.argmin(loss))])
    )


def identify(docs: DataFrame, model: LanguageModel, rule: LanguageRule = LanguageRule()) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = np.array([*model.languages, "und"], object)

    def predict(batches):
        for batch in batches:
            best = np.full(batch.num_rows, len(names) - 1)
            score = np.zeros(batch.num_rows)
            for at, docs_, grams, rows in _buckets(batch.column("text"), rule):
                sums = model.weights[grams[0]]
                held = (grams[0] < 1 << rule.bits).astype(np.int8)
                for g in grams[1:]:
                    sums += model.weights[g]
                    held += g < 1 << rule.bits
                n = np.bincount(rows, held, docs_)
                z = np.stack(
                    [np.bincount(rows, sums[:, k], docs_) for k in range(len(model.languages))], 1
                ) / np.maximum(n, 1)[:, None]
                p = _softmax((z + model.bias) / model.temperature)
                best[at : at + docs_] = p.argmax(axis=1)
                score[at : at + docs_] = p.max(axis=1)
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            best[~lettered], score[~lettered] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)],
                ["doc_id", "lang_pred", "score"],
            )

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not model.languages:
        return docs.select(
            "doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")
        )
    return docs.select("doc_id", "text", lettered.alias("lettered")).mapInArrow(
        predict, f"doc_id {kind}, lang_pred string, score double"
    )
