"""Token ids in binary blocks with Elias-Fano coded document boundaries."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import tokens
from corpusloom.llm.common import running_base, text_or_empty, text_slices
from corpusloom.operators.sizing import broadcast_if_small

MAGIC = b"TOKB"
HEADER = "<4sBBHIQII"  # magic, id bytes, low bits, sample step, documents, ids, bytes of low and high part
BLOCK_TOKENS = 1 << 20
SAMPLE = 64


class EliasFano:
    """A rising sequence of ``n`` values up to ``top`` in about ``2 + log2(top / n)`` bits each.

    The low bits of every value lie packed side by side. The high parts are one
    bit vector: value ``i`` sets bit ``(value >> low_bits) + i``. The place of
    every 64th set bit is kept, as 32 bits, so that ``select`` scans a few bytes.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, int(top // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        planes = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The ``i``-th value, from zero."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = self.high[at >> 3] >> (at & 7) << (at & 7)
        k = at >> 3
        while left >= byte.bit_count():
            left -= byte.bit_count()
            k += 1
            byte = self.high[k]
        for _ in range(left):
            byte &= byte - 1
        place = 8 * k + (byte & -byte).bit_length() - 1
        first = i * self.low_bits
        span = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], "little")
        return (place - i) << self.low_bits | span >> (first & 7) & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All values."""
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")
        high = np.flatnonzero(bits)[: self.n] - np.arange(self.n)
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits]
        weights = 1 << np.arange(self.low_bits, dtype=np.int64)
        return (high << self.low_bits) + low.reshape(self.n, self.low_bits).astype(np.int64) @ weights


def pack_block(documents: list[bytes]) -> bytes:
    """One block from the ids of its documents, each as 32-bit integers; ids take 16 bits if all fit."""
    whole = np.frombuffer(b"".join(documents), "<u4")
    starts = np.cumsum([0, *(len(d) // 4 for d in documents)])[:-1]
    bounds = EliasFano.of(starts, len(whole))
    width = 2 if not len(whole) or int(whole.max()) < 1 << 16 else 4
    head = struct.pack(
        HEADER, MAGIC, width, bounds.low_bits, SAMPLE, len(documents), len(whole), len(bounds.low), len(bounds.high)
    )
    return b"".join([head, bounds.low, bounds.high, bounds.samples.tobytes(), whole.astype(f"<u{width}").tobytes()])


class Block:
    """A block opened for reading: any document's ids without decoding the others."""

    def __init__(self, data: bytes):
        magic, self.width, low_bits, step, self.n, self.total, low, high = struct.unpack_from(HEADER, data)
        if magic != MAGIC or step != SAMPLE:
            raise ValueError("not a token block")
        at = struct.calcsize(HEADER)
        samples = at + low + high
        ids = samples + 4 * -(-self.n // SAMPLE)
        self.bounds = EliasFano(
            self.n, low_bits, data[at : at + low], data[at + low : samples], np.frombuffer(data[samples:ids], "<u4")
        )
        self._ids = np.frombuffer(data, f"<u{self.width}", self.total, ids)

    def document(self, i: int) -> np.ndarray:
        end = self.bounds.select(i + 1) if i + 1 < self.n else self.total
        return self._ids[self.bounds.select(i) : end]

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        starts = [*self.bounds.values().tolist(), self.total]
        for start, end in zip(starts, starts[1:]):
            yield start, self._ids[start:end]


def token_blocks(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Encode texts and lay their ids down in ascending id order: ``part, block, n_tokens, doc_ids, payload``.

    Documents are dealt out by id ranges, one part per range, and sorted there;
    a part is cut into blocks of about ``block_tokens`` ids, so that neither a
    task nor a row holds more than one block and one document. Blocks in the
    order of ``(part, block)`` are the whole id array.

    Each document's ids end with ``end_id``. Null texts count as empty, null ids
    come first, and rows with one id stand in the order of their texts' hashes.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("payload", T.BinaryType()),
        ]
    )
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = tokens.encoder(tokenizer)
        part = TaskContext.get().partitionId()
        ids: list = []
        documents: list[bytes] = []
        held = block = 0

        def flush() -> pa.RecordBatch:
            arrays = [
                pa.array([part], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([held], pa.int64()),
                pa.array([ids], pa.list_(id_arrow)),
                pa.array([pack_block(documents)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        id_arrow = pa.int64()
        for batch in text_slices(batches):
            id_arrow = batch["doc_id"].type
            for key, encoded in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"].to_pylist())):
                n = len(encoded) // 4 + 1
                if documents and held + n > block_tokens:
                    yield flush()
                    ids, documents, held, block = [], [], 0, block + 1
                ids.append(key)
                documents.append(encoded + end)
                held += n
        if documents:
            yield flush()

    return ordered.mapInArrow(write, schema)


def read_documents(blocks: DataFrame) -> DataFrame:
    """Per document of the blocks ``doc_id, start, n_tokens, ids``: its place in the whole array, and its ids
    as little-endian unsigned 32-bit integers.

    ``blocks`` must be a stored table. Places come from sums per part and, inside a part, per block.
    """
    from pyspark.sql import Window

    parts = running_base(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")), "part", "n")
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = (
        blocks.select("part", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("within"))
        .join(F.broadcast(parts), "part")  # one row per task that wrote blocks
        .select("part", "block", (F.col("base") + F.col("within")).alias("base"))
    )
    id_type = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                base, keys = batch["base"][row].as_py(), batch["doc_ids"][row].values
                found = list(Block(batch["payload"][row].as_py()).documents())
                arrays = [
                    keys,
                    pa.array([base + start for start, _ in found], pa.int64()),
                    pa.array([len(ids) for _, ids in found], pa.int64()),
                    pa.array([ids.astype("<u4").tobytes() for _, ids in found], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return blocks.join(broadcast_if_small(places), ["part", "block"]).select("base", "doc_ids", "payload").mapInArrow(read, schema)
