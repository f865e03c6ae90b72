"""Removal of byte strings that occur earlier in the corpus, by sorted suffixes at sampled places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import running_base, text_or_empty, text_slices
from corpusloom.operators.sizing import BROADCAST_BYTES, ROW_OVERHEAD
from corpusloom.session import cut_lineage

LENGTH = 100
# Bytes whose hash picks the place by which a string is found.
GRAM = 32
# Strings that begin up to here before their place share the bytes after it, the others those before it.
HALF = (LENGTH - GRAM) // 2
SLICE = 1 << 18
_STEP = 0x9E3779B97F4A7C15 | 1
_SEED = 20240229


class RangeHash:
    """64-bit hashes of any ranges of a byte array, from running sums."""

    def __init__(self, data: np.ndarray):
        table = np.random.default_rng(_SEED).integers(0, 2**64, 256, np.uint64)
        n = len(data)
        powers = np.full(n + 1, _STEP, np.uint64)
        inverse = np.full(n + 1, pow(_STEP, -1, 1 << 64), np.uint64)
        powers[0] = inverse[0] = 1
        self.inverse = np.cumprod(inverse, dtype=np.uint64)
        self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(table[data] * np.cumprod(powers, dtype=np.uint64)[:n], dtype=np.uint64)]

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places by which all strings of texts laid end to end are found:
    hash there, hash of all bytes they stand for, first and last string, place.

    Of the gram hashes inside a string the smallest, and of equal ones the first,
    is its place, so equal strings have the same. Strings next to each other mostly
    share a place and are kept as one run.
    """
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    ranges = RangeHash(data)
    m = len(data) - GRAM + 1
    hashes = ranges.of(slice(0, m), slice(GRAM, GRAM + m))
    low = np.uint64((1 << 22) - 1)
    least = (hashes & ~low) | np.arange(m, dtype=np.uint64)
    width, span = 1, LENGTH - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: n], least[span - width :][:n])
    place = (least[:n] & low).astype(np.int64)
    inside = np.ones(n, bool)
    for end in offsets[1:-1].tolist():
        inside[max(0, end - LENGTH + 1) : end] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    first = np.r_[True, (np.diff(at) > 1) | (np.diff(place[at]) != 0) | np.isin(at[1:], offsets)]
    begins = np.flatnonzero(first)
    lo, hi = at[begins], at[np.r_[begins[1:] - 1, len(at) - 1]]
    return hashes[place[lo]], ranges.of(lo, hi + LENGTH), lo, hi, place[lo]


def _laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and where each begins."""
    raw = texts.to_pylist()
    offsets = np.cumsum([0, *map(len, raw)])
    return np.frombuffer(b"".join(raw), np.uint8), offsets


def found_places(docs: DataFrame) -> DataFrame:
    """``gram, content, doc, at`` for all places of ``doc, text``; ``at`` packs first string, run length and place."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, size=SLICE):
            keys = batch["doc"].to_numpy()
            data, offsets = _laid_out(batch["text"])
            # A text longer than a slice is taken in parts that overlap by a string.
            for at in range(0, max(1, len(data)), 2 * SLICE):
                part = data[at : at + 2 * SLICE + LENGTH - 1]
                inner = offsets[(offsets > at) & (offsets < at + len(part))] - at
                gram, content, lo, hi, place = places(part, np.r_[0, inner, len(part)])
                doc = np.searchsorted(offsets, lo + at, side="right") - 1
                packed = (lo + at - offsets[doc]) << 14 | (hi - lo) << 7 | (place - lo)
                arrays = [pa.array(gram.view(np.int64)), pa.array(content.view(np.int64)), pa.array(keys[doc]), pa.array(packed)]
                yield pa.RecordBatch.from_arrays(arrays, names=["gram", "content", "doc", "at"])

    return docs.mapInArrow(find, "gram long, content long, doc long, at long")


def settled_runs(found: DataFrame) -> DataFrame:
    """``doc, at, open``: runs all of whose bytes are those of an earlier run, and those that must be compared.

    Rows with one gram meet in one task, in order. Of equal contents only the
    first stays open, and only if the gram has other contents too. A task keeps
    one row between batches, however many share a gram.
    """

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # gram, content, doc, at of the last class, and whether it was given out

        def out(doc: np.ndarray, at: np.ndarray, open_: bool) -> pa.RecordBatch:
            flags = pa.array(np.full(len(doc), open_))
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), flags], names=["doc", "at", "open"])

        for batch in batches:
            if not batch.num_rows:
                continue
            gram, content, doc, at = (batch[c].to_numpy() for c in ("gram", "content", "doc", "at"))
            given = np.zeros(len(gram), bool)
            if held is not None:
                gram, content, doc, at = (np.r_[np.int64(v), a] for v, a in zip(held, (gram, content, doc, at)))
                given = np.r_[held[4], given]
            new = np.r_[True, (gram[1:] != gram[:-1]) | (content[1:] != content[:-1])]
            yield out(doc[~new], at[~new], False)
            first = np.flatnonzero(new)
            same = gram[first[1:]] == gram[first[:-1]]
            mixed = np.r_[same, False] | np.r_[False, same]
            give = first[mixed & ~given[first]]
            yield out(doc[give], at[give], True)
            k = first[-1]
            held = (gram[k], content[k], doc[k], at[k], bool(given[k] | mixed[-1]))

    ordered = found.repartition("gram").sortWithinPartitions("gram", "content", "doc", "at")
    return ordered.mapInArrow(settle, "doc long, at long, open boolean")


def _with_texts(docs: DataFrame, lists: DataFrame, column: str, how: str) -> DataFrame:
    """Join per-document lists to the texts; lists that fit are sent to the texts, else both are shuffled."""
    size = lists.agg(F.coalesce(F.sum(ROW_OVERHEAD + 16 * F.size(column)), F.lit(0))).first()[0]
    return docs.join(F.broadcast(lists) if size <= BROADCAST_BYTES // 2 else lists, "doc", how)


def shared_strings(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``string, doc, start``: the strings of open runs that share the bytes next to their place with another run."""
    lists = cut_lineage(runs.groupBy("doc").agg(F.collect_list("at").alias("runs")))

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        of = xxhash.xxh3_64_intdigest
        for batch in text_slices(batches):
            key, doc, start, payload = [], [], [], []
            for k, text, runs in zip(batch["doc"].to_pylist(), batch["text"].to_pylist(), batch["runs"].to_pylist()):
                for at in runs:
                    lo = at >> 14
                    hi, place = lo + (at >> 7 & 127), lo + (at & 127)
                    right = max(lo, place - HALF)
                    if right <= hi:
                        key.append(of(text[place : place + LENGTH - HALF]))
                        doc.append(k)
                        start.append(right)
                        payload.append(text[right : hi + LENGTH])
                    left = min(hi, place - HALF - 1)
                    if left >= lo:
                        key.append(of(text[place - HALF - 1 : place + GRAM], 1))
                        doc.append(k)
                        start.append(lo)
                        payload.append(text[lo : left + LENGTH])
            arrays = [pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(payload, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "doc", "start", "payload"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        shared = False  # whether the held row's key was met before

        def strings(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            string, doc, start = [], [], []
            for k, s, payload in rows:
                n = len(payload) - LENGTH + 1
                string += [payload[i : i + LENGTH] for i in range(n)]
                doc += [k] * n
                start += range(s, s + n)
            arrays = [pa.array(string, pa.binary()), pa.array(doc, pa.int64()), pa.array(start, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["string", "doc", "start"])

        for batch in batches:
            rows = []
            for key, *row in zip(*(batch[c].to_pylist() for c in ("key", "doc", "start", "payload"))):
                again = held is not None and key == held[0]
                if held is not None and (shared or again):
                    rows.append(held[1])
                held, shared = (key, row), again
                if len(rows) >= 4096:
                    yield strings(rows)
                    rows = []
            yield strings(rows)
        if held is not None and shared:
            yield strings([held[1]])

    cut = _with_texts(docs, lists, "runs", "inner").mapInArrow(halves, "key long, doc long, start long, payload binary")
    met = cut.repartition("key").sortWithinPartitions("key", "doc", "start")
    return met.mapInArrow(spread, "string binary, doc long, start long")


def multikey_order(strings: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of equal-length strings, and of equal ones by ``tie``; and which equal the one before.

    Multikey quicksort with eight bytes as one character: all are ordered by their
    first character, then only runs of equal ones go on to the next.
    """
    n, length = strings.shape
    # The last character ends with the string, and so may begin inside the one before.
    firsts = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    order = np.arange(n)
    run = np.zeros(n, np.int64)  # the number of the run each place in the order is in
    for first in [*firsts, None]:
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        sizes = np.diff(np.r_[starts, n])
        part = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(part):
            break
        rows = order[part]
        c = tie[rows] if first is None else np.ascontiguousarray(strings[rows, first : first + 8]).view(">u8")[:, 0].astype(np.uint64)
        moved = np.lexsort((c, run[part]))
        order[part] = rows[moved]
        if first is not None:
            c = c[moved]
            new = np.r_[False, run[1:] != run[:-1]]
            new[part[1:]] |= (c[1:] != c[:-1]) & (np.diff(part) == 1)
            run = np.cumsum(new)
    return order, np.r_[False, run[1:] == run[:-1]]


def repeated_strings(strings: DataFrame) -> DataFrame:
    """``doc, start`` of every string that also stands earlier.

    Sampled splitters deal the strings out by their bytes, and equal ones by their
    place, so that no string is too frequent for a bucket. Buckets are sorted by
    themselves; each hands on its first and last string, and the first of a bucket
    is compared with the last of the one before.
    """

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = []
        for batch in batches:
            if batch.num_rows:
                string = batch["string"]
                at = LENGTH * string.offset
                raw = np.frombuffer(string.buffers()[2], np.uint8)[at : at + LENGTH * len(string)]
                parts.append((raw.reshape(-1, LENGTH).copy(), batch["doc"].to_numpy(), batch["start"].to_numpy()))
        if not parts:
            return
        strings, doc, start = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((start, doc))] = np.arange(len(doc))
        order, again = multikey_order(strings, rank)
        bucket = TaskContext.get().partitionId()
        at = order[again]
        first, last = order[0], order[-1]
        ends = [strings[first].tobytes(), strings[last].tobytes()]
        n = len(at)
        arrays = [
            pa.array(np.r_[doc[at], doc[first]]), pa.array(np.r_[start[at], start[first]]),
            pa.array([None] * n + [bucket], pa.int32()),
            pa.array([None] * n + ends[:1], pa.binary()), pa.array([None] * n + ends[1:], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc", "start", "bucket", "first", "last"])

    dealt = strings.repartitionByRange("string", "doc", "start")
    sorted_ = cut_lineage(dealt.mapInArrow(sort, "doc long, start long, bucket int, first binary, last binary"))
    from pyspark.sql import Window

    # One row per bucket.
    before = F.lag("last").over(Window.orderBy("bucket"))
    bounds = sorted_.where("bucket is not null").withColumn("before", before).where("first = before")
    return sorted_.where("bucket is null").select("doc", "start").unionByName(bounds.select("doc", "start"))


def _numbered(docs: DataFrame) -> DataFrame:
    """``doc_id, text, doc`` with numbers in the order of ids, null first, and of texts' hashes; equal rows share one."""
    key = docs.withColumn("_tie", F.xxhash64("text"))
    distinct = key.select("doc_id", "_tie").distinct().repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    placed = cut_lineage(
        distinct.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    )
    base = running_base(placed.groupBy("_part").agg(F.count("*").alias("n")), "_part", "n")
    ranked = placed.join(F.broadcast(base), "_part").select(F.col("doc_id").alias("_id"), F.col("_tie").alias("_t"), (F.col("base") + F.col("_nth")).alias("doc"))
    same = key["doc_id"].eqNullSafe(ranked["_id"]) & (key["_tie"] == ranked["_t"])
    return cut_lineage(key.join(ranked, same).select("doc_id", "text", "doc"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, spans, kept_text``.

    Every byte is removed that is in a string of 100 bytes which also starts
    earlier: in a document with a smaller id, or before in the same one. ``spans``
    lists the maximal runs removed as ``start, end``, in bytes of the text's UTF-8;
    ``kept_text`` has the other bytes, as binary, since a run may cut a character.

    Each string is found by a place inside it that its bytes alone decide; only
    places whose 32 bytes come again matter. Runs of strings with equal bytes are
    settled by a hash of 64 bits inside a group of equal grams; what differs around
    a gram goes on as strings of 100 bytes, which are sorted and compared whole.

    Null texts count as empty. Where ids are null, repeated or no whole numbers,
    documents are numbered first, null ids first, and rows with one id in the order
    of their texts' hashes; rows equal in both do not count as earlier than each
    other and have one result. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    whole = isinstance(rows.schema["doc_id"].dataType, (T.LongType, T.IntegerType))
    simple = whole and rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").isEmpty()
    rows = rows.withColumn("doc", F.col("doc_id").cast("long")) if simple else _numbered(rows)
    texts = rows.select("doc", "text") if simple else cut_lineage(rows.select("doc", "text").dropDuplicates(["doc"]))

    settled = cut_lineage(settled_runs(found_places(texts)))
    lo = F.shiftright("at", 14)
    run = F.shiftright("at", 7).bitwiseAND(F.lit(127))
    runs = settled.where("not open").select("doc", lo.alias("start"), (lo + run + LENGTH).alias("end"))
    again = repeated_strings(shared_strings(texts, settled.where("open").select("doc", "at")))
    single = again.select("doc", "start", (F.col("start") + LENGTH).alias("end"))
    covered = runs.unionByName(single).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("covered"))
    return _cut_out(rows, cut_lineage(covered))


def _cut_out(rows: DataFrame, covered: DataFrame) -> DataFrame:
    id_type = rows.schema["doc_id"].dataType
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("spans", T.ArrayType(span)),
            T.StructField("kept_text", T.BinaryType()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            lengths, spans, kept = [], [], []
            for text, parts in zip(batch["text"].to_pylist(), batch["covered"].to_pylist()):
                merged: list[list[int]] = []
                for s, e in sorted((p["start"], p["end"]) for p in parts or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                at, out = 0, []
                for s, e in merged:
                    out.append(text[at:s])
                    at = e
                lengths.append(len(text))
                spans.append([{"start": s, "end": e} for s, e in merged])
                kept.append(b"".join([*out, text[at:]]))
            arrays = [
                batch["doc_id"], pa.array(lengths, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    joined = _with_texts(rows, covered, "covered", "left")
    return joined.select("doc_id", "text", "covered").mapInArrow(cut, schema)

