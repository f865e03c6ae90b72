"""Embedding text columns through a pluggable batch embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BatchEmbedder = Callable[[list[str]], np.ndarray]

DIMENSION = 384
# Fixed values of the default embedder: radix and modulus of the gram hash.
GRAM_RADIX = 7919
GRAM_MODULUS = 2147483647


def gram_hashing(dim: int = DIMENSION) -> Callable[[], BatchEmbedder]:
    """Signed feature hashing of character trigrams, as unit vectors.

    Deterministic and language-neutral; the texts are padded by one space on
    either side. It needs no model file and makes no claim to meaning: pass a
    loader of a trained model to :func:`embed_text` for that.
    """

    def load() -> BatchEmbedder:
        def embed(texts: list[str]) -> np.ndarray:
            joined = "".join(f" {t} " for t in texts)
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            sizes = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts))
            if len(codes) < 3:
                return np.zeros((len(texts), dim))
            owner = np.repeat(np.arange(len(texts)), sizes)
            gram = ((codes[:-2] * GRAM_RADIX + codes[1:-1]) * GRAM_RADIX + codes[2:]) % GRAM_MODULUS
            inside = owner[:-2] == owner[2:]
            gram, owner = gram[inside], owner[:-2][inside]
            sign = (gram // dim) % 2 * 2.0 - 1.0
            sums = np.bincount(owner * dim + gram % dim, weights=sign, minlength=len(texts) * dim)
            out = sums.reshape(len(texts), dim)
            norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

        return embed

    return load


def vector_column(matrix: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(matrix, dtype=np.float32).ravel())
    offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
    return pa.ListArray.from_arrays(offsets, flat)


def embed_text(
    df: DataFrame,
    text: str = "text",
    embedding: str = "embedding",
    loader: Callable[[], BatchEmbedder] | None = None,
    batch_rows: int = 1024,
) -> DataFrame:
    """Add an ``array<float>`` column; ``loader`` runs once per Python task."""
    load = loader or gram_hashing()
    schema = T.StructType(df.schema.fields + [T.StructField(embedding, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = load()
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(at, batch_rows)
                texts = [t or "" for t in batch.column(text).to_pylist()]
                vectors = vector_column(np.asarray(embed(texts)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, vectors], names=[*batch.schema.names, embedding]
                )

    return df.mapInArrow(run, schema)


def entity_text(name: Column, description: Column) -> Column:
    """The text an entity is embedded by; its type is left out."""
    return F.concat(name, F.lit(": "), description)
