"""Packing token ids into sequences: first fit decreasing in randomised groups."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import tokens
from corpusloom.llm.common import running_base, text_or_empty, text_slices
from corpusloom.session import cut_lineage

SEQUENCE = 1024
GROUP_ITEMS = 4096


class BinTree:
    """Bins by index with a tournament tree of free room, to find the first bin an item fits.

    Leaves hold the room left in each bin and inner nodes the larger of their
    children, so the first fit is found by one walk down from the root.
    """

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [size] * (2 * self.leaves)

    def place(self, length: int) -> int:
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        found = node - self.leaves
        room[node] -= length
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return found


def first_fit_decreasing(lengths: list[int], size: int) -> list[int]:
    """The bin of each item; items must be given by falling length. Bins are numbered from zero without gaps."""
    tree = BinTree(len(lengths), size)
    return [tree.place(n) for n in lengths]


def fill_up(lengths: list[int], bins: list[int], size: int) -> list[tuple[int, int, int, int]]:
    """Cut the items of the emptiest bins to fill the room left in the others.

    Gives ``(item, start, length, bin)`` with all bins full but one. Items of
    the other bins stay whole; bins whose items were all dealt out are gone.
    """
    used = [0] * (max(bins, default=-1) + 1)
    members: list[list[int]] = [[] for _ in used]
    for item, b in enumerate(bins):
        used[b] += lengths[item]
        members[b].append(item)
    by_use = sorted(range(len(used)), key=lambda b: (-used[b], b))
    pieces: list[tuple[int, int, int, int]] = []
    high, low = 0, len(by_use) - 1
    source = [[item, 0] for item in members[by_use[low]]] if by_use else []
    while high < low:
        b = by_use[high]
        pieces += [(item, 0, lengths[item], b) for item in members[b]]
        room = size - used[b]
        while room and source:
            item, start = source[-1]
            part = min(room, lengths[item] - start)
            pieces.append((item, start, part, b))
            room -= part
            if start + part == lengths[item]:
                source.pop()
            else:
                source[-1][1] = start + part
            if not source:
                low -= 1
                source = [[item, 0] for item in members[by_use[low]]] if low > high else []
        high += 1
    if high == low:
        pieces += [(item, start, lengths[item] - start, by_use[low]) for item, start in source]
    return pieces


def document_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Ids of each document with ``end_id`` behind them, cut at multiples of ``size``:
    ``doc_id, start, length, doc_tokens, ids, task, nth``.

    Whole pieces are numbered inside their task (``nth``); the rest of a document has no number.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = T.StructType(
        [
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("task", T.IntegerType()),
            T.StructField("nth", T.LongType()),
        ]
    )
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = tokens.encoder(tokenizer)
        task, full = TaskContext.get().partitionId(), 0
        for batch in text_slices(batches):
            row, starts, lengths, totals, ids, nth = [], [], [], [], [], []
            for k, encoded in enumerate(encoder.encode(batch["text"].to_pylist())):
                encoded += end
                total = len(encoded) // 4
                for start in range(0, total, size):
                    n = min(size, total - start)
                    row.append(k)
                    starts.append(start)
                    lengths.append(n)
                    totals.append(total)
                    ids.append(encoded[4 * start : 4 * (start + n)])
                    nth.append(full if n == size else None)
                    full += n == size
            arrays = [
                batch["doc_id"].take(pa.array(row, pa.int64())),
                pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(totals, pa.int64()),
                pa.array(ids, pa.binary()),
                pa.array([task] * len(row), pa.int32()),
                pa.array(nth, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(cut, schema)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    size: int = SEQUENCE,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_items: int = GROUP_ITEMS,
    seed: int = 17,
) -> DataFrame:
    """Sequences of at most ``size`` ids from whole documents, as pieces:
    ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    A document is cut at multiples of ``size``; its whole pieces are sequences
    already. The rests are dealt out at random, by a hash of their stored row,
    to groups of about ``group_items``, and packed there by first fit decreasing.
    What room is left then takes cut items of the group's emptiest bins, so that
    one sequence per group is not full. Groups differ little in size whatever the
    documents look like, and none depends on another.

    Null texts count as empty and give one piece, the end id. Repeated ids and
    rows are packed like any others. An empty table gives no rows.
    """
    pieces = cut_lineage(document_pieces(docs, tokenizer, end_id, size, id_col, text_col), "zstd")
    whole, rest = pieces.where("nth is not null"), pieces.where("nth is null")
    groups = max(1, -(-rest.count() // group_items))
    counts = whole.groupBy("task").agg(F.count("*").alias("n"))
    # One row per task that cut documents.
    first = F.broadcast(running_base(counts, "task", "n"))
    numbered = whole.join(first, "task").select(
        "doc_id", "start", "length", "doc_tokens", (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids"
    )

    schema = T.StructType([*pieces.schema.fields[:5], T.StructField("group", T.LongType()), T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType())])

    def pack_group(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "tie"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = items["length"].tolist()
        placed = fill_up(lengths, first_fit_decreasing(lengths, size), size)
        at: dict[int, int] = {}
        numbers: dict[int, int] = {}
        bins, offsets = [], []
        for _, _, n, b in placed:
            bins.append(numbers.setdefault(b, len(numbers)))
            offsets.append(at.get(b, 0))
            at[b] = offsets[-1] + n
        item = np.array([p[0] for p in placed], np.int64)
        ids = items["ids"].tolist()
        chosen = items.iloc[item]
        return pd.DataFrame(
            {
                "doc_id": chosen["doc_id"].array,
                "start": chosen["start"].to_numpy() + [p[1] for p in placed],
                "length": [p[2] for p in placed],
                "doc_tokens": chosen["doc_tokens"].to_numpy(),
                "ids": [bytes(ids[i][4 * s : 4 * (s + n)]) for i, s, n, _ in placed],
                "group": key[0],
                "bin": bins,
                "offset": offsets,
            }
        )

    tie = F.xxhash64(F.lit(seed), "task", "doc_id", "start", F.crc32("ids"), F.monotonically_increasing_id())
    dealt = rest.withColumn("tie", tie).withColumn("group", F.pmod("tie", F.lit(groups)))
    packed = cut_lineage(
        dealt.select("doc_id", "start", "length", "doc_tokens", "ids", "tie", "group").groupBy("group").applyInPandas(pack_group, schema), "zstd"
    )
    # One row per group of thousands of documents.
    bins = packed.groupBy("group").agg((F.max("bin") + 1).alias("n"))
    behind = whole.count()
    base = F.broadcast(running_base(bins, "group", "n"))
    filled = packed.join(base, "group").select(
        "doc_id", "start", "length", "doc_tokens", (F.lit(behind) + F.col("base") + F.col("bin")).alias("sequence_id"), "offset", "ids"
    )
    return numbered.unionByName(filled)
