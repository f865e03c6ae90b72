"""An embedder fitted on a corpus: a truncated factorisation of hashed TF-IDF weights.

Words are hashed into buckets; a text is the unit vector of its words' weights. The
leading axes of the corpus are found by a randomised range finder: a random basis is
multiplied by the corpus and back, task by task, and only sums per bucket meet. They are
sums of whole numbers, so the same rows give the same model however they are dealt out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.embedding import BatchEmbedder
from corpusloom.session import cut_lineage

BUCKETS = 8192
# Axes beyond the wanted ones while fitting, and multiplications by the corpus.
OVERSAMPLE = 16
PASSES = 3
# Axes are divided by this power of their singular value, so that the few of languages and common words do not decide all.
BALANCE = 0.5
# Units of weights and of components in sums: 64-bit sums hold some 10^11 texts of a single word.
WEIGHT_UNITS = 1 << 10
VALUE_UNITS = 1 << 16
# Entries of a slab of rows that are multiplied at a time, and characters that are cut into words at a time: what they become stays in a core's cache.
SLAB = 1 << 11
CHARACTERS = 1 << 17
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Model(NamedTuple):
    """Weight of each bucket, and its components on the axes."""

    idf: np.ndarray
    axes: np.ndarray


class Entries(NamedTuple):
    """Non-zero entries of ``rows`` texts, ordered by text and bucket."""

    rows: int
    owner: np.ndarray
    bucket: np.ndarray
    count: np.ndarray


def word_counts(texts: list[str], buckets: int = BUCKETS) -> Entries:
    """How often each bucket's words occur in each text; words are lower-cased and end at white space."""
    lowered = [f"{t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), np.int64, len(texts)))
    inside = ~((codes == 32) | (codes >= 9) & (codes <= 13))
    first = inside & ~np.r_[False, inside[:-1]]
    starts = np.flatnonzero(first)
    if not len(starts):
        return Entries(len(texts), *(np.zeros(0, np.int64) for _ in range(3)))
    place = np.flatnonzero(inside) - starts[np.cumsum(first)[inside] - 1]
    mixed = (codes[inside] + np.uint64(1)) * _MIX + place.astype(np.uint64) * _STEP
    mixed = (mixed ^ mixed >> np.uint64(31)) * _MIX
    word = np.add.reduceat(mixed ^ mixed >> np.uint64(29), np.flatnonzero(first[inside]))
    word = (word ^ word >> np.uint64(32)) * _STEP >> np.uint64(20)
    key, count = np.unique(owner[starts] * buckets + (word % np.uint64(buckets)).astype(np.int64), return_counts=True)
    return Entries(len(texts), key // buckets, key % buckets, count)


def _slabs(n: int, size: Callable[[int], int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``n`` items whose sizes reach ``most`` with the last one at the earliest."""
    at, held = 0, 0
    for i in range(n):
        held += size(i)
        if held >= most or i == n - 1:
            yield at, i + 1
            at, held = i + 1, 0


def weights(entries: Entries, idf: np.ndarray) -> np.ndarray:
    """The entries as TF-IDF weights, of unit length in each text."""
    raw = (1 + np.log(entries.count)) * idf[entries.bucket]
    norm = np.sqrt(np.bincount(entries.owner, weights=raw * raw, minlength=entries.rows))
    return raw / np.maximum(norm[entries.owner], 1e-300)


def projected(entries: Entries, weight: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Each text's components on the axes; a text's sums do not depend on its neighbours."""
    out = np.zeros((entries.rows, axes.shape[1]))
    bounds = np.searchsorted(entries.owner, np.arange(entries.rows + 1))
    for first, last in _slabs(entries.rows, lambda i: int(bounds[i + 1] - bounds[i]), SLAB):
        a, b = bounds[first], bounds[last]
        if a < b:
            starts = np.flatnonzero(np.r_[True, entries.owner[a + 1 : b] != entries.owner[a : b - 1]])
            terms = weight[a:b, None] * axes[entries.bucket[a:b]]
            out[entries.owner[a:b][starts]] = np.add.reduceat(terms, starts, axis=0)
    return out


def count_rows(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` as arrays for each text: its entries. A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [t or "" for t in batch[0].to_pylist()]
            for first, last in _slabs(len(held), lambda i: len(held[i]) + 1, CHARACTERS):
                e = word_counts(held[first:last], buckets)
                bounds = pa.array(np.searchsorted(e.owner, np.arange(e.rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(c, pa.int32())) for c in (e.bucket, e.count)]
                yield pa.RecordBatch.from_arrays(lists, names=["bucket", "n"])

    return texts.select(F.col(text).cast("string")).mapInArrow(run, "bucket array<int>, n array<int>")


def _entries(batch: pa.RecordBatch) -> Entries:
    sizes = batch["bucket"].value_lengths().to_numpy(zero_copy_only=False)
    flat = [batch[c].flatten().to_numpy().astype(np.int64) for c in ("bucket", "n")]
    return Entries(batch.num_rows, np.repeat(np.arange(batch.num_rows), sizes), *flat)


def inverse_frequencies(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Logarithm of all texts over those with a word of the bucket; near zero for a word of every text."""
    n = counted.count()
    found = counted.select(F.explode("bucket").alias("bucket")).groupBy("bucket").count().toArrow()
    with_word = np.zeros(buckets)
    with_word[found["bucket"].to_numpy()] = found["count"].to_numpy()
    return np.log((1 + n) / (0.5 + with_word))


def corpus_times(counted: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The basis multiplied by the matrix of all texts and by its transpose: one row of sums per bucket."""
    buckets, width = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((buckets, width), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                e = _entries(whole.slice(at, 1024))
                w = weights(e, idf)
                # Whole numbers as floating ones, which are multiplied faster: a slab's sums are far below 2^53, and so exact.
                values = np.rint(projected(e, w, basis) * VALUE_UNITS)
                order = np.argsort(e.bucket, kind="stable")
                bucket, owner, units = e.bucket[order], e.owner[order], np.rint(w * WEIGHT_UNITS)[order]
                for first in range(0, len(order), SLAB):
                    slab = slice(first, first + SLAB)
                    held = bucket[slab]
                    starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
                    sums = np.add.reduceat(units[slab, None] * values[owner[slab]], starts, axis=0)
                    total[held[starts]] += sums.astype(np.int64)
        some = np.flatnonzero(total.any(1))
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total[some].ravel()), width).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), sums], names=["bucket", "sums"])

    parts = counted.mapInArrow(run, "bucket int, sums array<long>")
    found = parts.groupBy("bucket").agg(*[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)]).toArrow()
    out = np.zeros((buckets, width))
    if found.num_rows:
        out[found["bucket"].to_numpy()] = np.stack([found[f"s{j}"].to_numpy() for j in range(width)], axis=1)
    return out / (WEIGHT_UNITS * VALUE_UNITS)


def fit(
    texts: DataFrame, text: str = "text", dim: int = 64, buckets: int = BUCKETS, passes: int = PASSES, balance: float = BALANCE, seed: int = 7
) -> Model:
    """The ``dim`` leading axes of the texts' TF-IDF weights, balanced; with a ``balance`` of 0 they are orthonormal.

    All rows are read: once for the words, which are stored as counts, and once per pass over the
    counts. The driver gets one row per bucket. The same rows give the same model in any order. No texts,
    or none with a word, give axes of zeros. Null texts count as empty ones; repeated rows count as often as they occur.
    """
    counted = cut_lineage(count_rows(texts, text, buckets))
    idf = inverse_frequencies(counted, buckets)
    width = min(dim + OVERSAMPLE, buckets)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((buckets, width)))[0]
    for _ in range(passes - 1):
        basis = np.linalg.qr(corpus_times(counted, idf, basis))[0]
    small = basis.T @ corpus_times(counted, idf, basis)
    strength, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-strength, kind="stable")[:dim]
    axes = basis @ turn[:, best]
    strong = strength[best] > 1e-9 * max(strength.max(), 1e-300)
    axes *= np.where(strong, np.where(strong, strength[best], 1.0) ** (-balance / 2), 0.0)
    axes *= np.where(axes[np.abs(axes).argmax(0), np.arange(len(best))] < 0, -1.0, 1.0)
    return Model(idf, axes)


def embedder(model: Model) -> Callable[[], BatchEmbedder]:
    """A loader for :func:`corpusloom.operators.embedding.embed_text`: unit vectors, or zeros without a known word."""
    idf, axes = model

    def load() -> BatchEmbedder:
        def embed(texts: list[str]) -> np.ndarray:
            parts = [np.zeros((0, axes.shape[1]))]
            for first, last in _slabs(len(texts), lambda i: len(texts[i]) + 1, CHARACTERS):
                entries = word_counts(texts[first:last], len(idf))
                parts.append(projected(entries, weights(entries, idf), axes))
            out = np.concatenate(parts)
            norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-12)

        return embed

    return load
