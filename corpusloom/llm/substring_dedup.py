"""Removal of word passages that an earlier document has, found by backward search in sharded FM-indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import dense_numbers, text_or_empty, text_slices
from corpusloom.llm.fm_index import FmIndex
from corpusloom.llm.word_hashes import gram_hashes, hashed_words
from corpusloom.operators.sizing import broadcast_if_small
from corpusloom.session import cut_lineage

WIDTH = 13
# Words whose hash picks the anchor of a window.
GRAM = 5
# Text hashed at a time.
SLICE = 1 << 20
# Words of the passages in one shard, about.
SHARD_WORDS = 1 << 19
# Anchors with more occurrences have their windows dealt out one by one.
CROWDED = 1 << 14


def anchored(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with a common anchor: its hash, the text's number, first and last window.

    Of the grams in a window that with the smallest hash, and of equal ones the
    first, is the anchor; equal windows have equal anchors.
    """
    hashes, base = hashed_words(texts)
    grams = gram_hashes(hashes, GRAM)
    n, span = len(hashes) - WIDTH + 1, WIDTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    low = np.uint64((1 << 26) - 1)
    least = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width :][:n])
    text = np.searchsorted(base, np.arange(len(hashes)), side="right") - 1
    at = np.flatnonzero(text[:n] == text[WIDTH - 1 :])
    if not len(at):
        return none, none, none, none
    place = at + ((least[at] - at.astype(np.uint64)) & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(place) != 0) | (np.diff(text[at]) != 0)])
    first, last = at[new], at[np.r_[new[1:] - 1, len(at) - 1]]
    of = text[first]
    return grams[place[new]].view(np.int64), of, first - base[of], last - base[of]


def anchor_counts(texts: DataFrame) -> DataFrame:
    """``anchor, least, most, n`` over ``ord, text``: smallest and largest document and the number of runs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, size=SLICE):
            order = batch["ord"].to_numpy()
            anchor, of, _, _ = anchored(batch["text"].to_pylist())
            by = np.lexsort((order[of], anchor))
            anchor, at = anchor[by], order[of[by]]
            starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(anchor)] if len(anchor) else starts
            arrays = [anchor[starts], at[starts], at[ends - 1], ends - starts]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names=["anchor", "least", "most", "n"])

    found = texts.mapInArrow(count, "anchor long, least long, most long, n long")
    return found.groupBy("anchor").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"))


def occurrences(texts: DataFrame) -> DataFrame:
    """``anchor, t, at`` for all runs of windows of ``t, text``; ``at`` packs the first window and how many follow."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, size=SLICE):
            t = batch["t"].to_numpy()
            anchor, of, first, last = anchored(batch["text"].to_pylist())
            arrays = [pa.array(anchor), pa.array(t[of]), pa.array(first << 4 | (last - first))]
            yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "t", "at"])

    return texts.mapInArrow(find, "anchor long, t long, at long")


def passages(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """``key, digest, t, ord, start, n, words``: the words of all runs whose anchor several documents have.

    A run is one passage; the windows at a crowded anchor are passages of their own,
    so that no key has more passages than a shard can hold.
    """
    lists = cut_lineage(shared.groupBy("t").agg(F.collect_list(F.struct("anchor", "at", "crowded")).alias("runs")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def rows(found: list[list]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], names=["key", "digest", "t", "ord", "start", "n", "words"])

        for batch in text_slices(batches, size=SLICE):
            out: list[list] = [[] for _ in range(7)]
            key, digest, text, order, start, size, content = out
            for t, o, raw, runs in zip(*(batch[c].to_pylist() for c in ("t", "ord", "text", "runs"))):
                words = raw.split()
                for run in runs:
                    first, more = run["at"] >> 4, run["at"] & 15
                    parts = [(first, WIDTH + more)] if not run["crowded"] else [(first + i, WIDTH) for i in range(more + 1)]
                    for at, n in parts:
                        passage = b" ".join(words[at : at + n])
                        key.append(xxhash.xxh3_64_intdigest(passage) - (1 << 63) if run["crowded"] else run["anchor"])
                        digest.append(xxhash.xxh3_128_digest(passage))
                        text.append(t)
                        order.append(o)
                        start.append(at)
                        size.append(n)
                        content.append(passage)
                if len(key) >= 1 << 16:
                    yield rows(out)
                    for c in out:
                        c.clear()
            yield rows(out)

    joined = texts.join(lists, "t").select("t", "ord", "text", "runs")
    return joined.mapInArrow(cut, "key long, digest binary, t long, ord long, start long, n int, words binary")


def searched(contents: DataFrame) -> DataFrame:
    """``key, digest, least``: for every window of a passage the first document that has it.

    ``contents`` are the distinct passages of a key, ``key, digest, words, least, most`` with the
    first and last document; a partition is a shard. Its passages are indexed, and then
    read through the index, which gives all places of each window. Passages all of
    whose windows belong to their last document first are left out.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[bytes, int] = {}
        key, digest, least, most, parts, sizes = [], [], [], [], [], []
        for batch in batches:
            numbers: list[int] = []
            for words in batch["words"].to_pylist():
                own = words.split(b" ")
                numbers += [vocabulary.setdefault(w, len(vocabulary) + 1) for w in own]
                numbers.append(0)
                sizes.append(len(own))
            key.append(batch["key"].to_numpy())
            least.append(batch["least"].to_numpy())
            most.append(batch["most"].to_numpy())
            digest += batch["digest"].to_pylist()
            parts.append(np.array(numbers, np.int64))
        if not digest:
            return
        tokens, size = np.concatenate(parts), np.array(sizes)
        names, size_of = len(vocabulary) + 1, int(size.max())
        vocabulary.clear()
        index = FmIndex(tokens, names, size_of, WIDTH)
        ends = np.cumsum(size + 1) - 1
        at, low, high = index.windows(tokens, ends, size)
        # Rows of windows are the same or apart, so one minimum per distinct window will do.
        starts, which = np.unique(low, return_inverse=True)
        stops = np.zeros(len(starts), np.int64)
        stops[which] = high
        first = np.concatenate(least)
        of_rows = np.r_[first[index.rows], np.iinfo(np.int64).max]
        smallest = np.minimum.reduceat(of_rows, np.c_[starts, stops].ravel())[::2]
        of = np.searchsorted(ends, at, side="right")
        by = np.argsort(at)
        of, value = of[by], smallest[which][by]
        again = np.zeros(len(size), bool)
        again[of[value < np.concatenate(most)[of]]] = True
        keep = again[of]
        counts = (size - WIDTH + 1)[again]
        found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(value[keep], pa.int64()))
        picked = np.flatnonzero(again).tolist()
        arrays = [pa.array(np.concatenate(key)[again]), pa.array([digest[k] for k in picked], pa.binary()), found]
        yield pa.RecordBatch.from_arrays(arrays, names=["key", "digest", "least"])

    return contents.mapInArrow(search, "key long, digest binary, least array<long>")


def _distinct_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``ord`` (the place of their id) and ``digest``; and per digest its first ``ord`` and a number ``t``."""
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    whole = isinstance(rows.schema["doc_id"].dataType, (T.LongType, T.IntegerType))
    if whole and rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").isEmpty():
        rows = rows.select("doc_id", "text", F.col("doc_id").cast("long").alias("ord"), digest)
        firsts = rows.groupBy("digest").agg(F.min("ord").alias("first"))
        return rows, cut_lineage(firsts.withColumn("t", F.col("first")))
    ids = cut_lineage(dense_numbers(rows.select("doc_id").distinct(), ["doc_id"], "ord")).select(F.col("doc_id").alias("id"), "ord")
    rows = cut_lineage(rows.join(ids, rows["doc_id"].eqNullSafe(ids["id"])).select("doc_id", "text", "ord", digest))
    firsts = rows.groupBy("digest").agg(F.min("ord").alias("first"))
    return rows, cut_lineage(dense_numbers(firsts, ["first", "digest"], "t"))


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, kept_text``.

    Words are what stands between the six ASCII white-space characters. Every word
    is removed that is in a window of 13 words which also starts in a document with
    a smaller id. ``spans`` lists the maximal runs removed as ``start, end``, counted in
    words; ``kept_text`` has the other words, joined by one space.

    Only the first of equal texts is searched; the others lose all their windows.
    A window is found by an anchor that its words alone decide, and only anchors
    which several documents have go on, as short passages. Shards hold all
    passages of a key in an FM-index, and the passages are streamed through it.

    Null texts count as empty. Null ids come first; rows with one id do not count as
    earlier than each other. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    rows, firsts = _distinct_texts(rows)
    known = rows.join(broadcast_if_small(firsts), "digest")
    copies = known.where("ord > first").select("doc_id", "text", F.lit(None).cast("array<struct<start: bigint, windows: bigint>>").alias("found"))
    kept = known.where("ord = first")
    texts = kept.select("t", "ord", "text").where(F.octet_length("text") >= 2 * WIDTH - 1)
    if not isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType)):
        texts = texts.dropDuplicates(["t"])

    # A table of its own, so that the join can deal out the rows of a frequent anchor.
    anchors = cut_lineage(anchor_counts(texts).where("least < most").select("anchor", (F.col("n") > CROWDED).alias("crowded")))
    shared = occurrences(texts).join(anchors, "anchor")
    cut = cut_lineage(passages(texts, shared), "zstd")
    shards = 1 + cut.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // SHARD_WORDS
    contents = cut.groupBy("key", "digest").agg(F.first("words").alias("words"), F.min("ord").alias("least"), F.max("ord").alias("most"))
    found = cut_lineage(searched(contents.repartition(shards, "key")))
    met = cut.drop("words").join(found, ["key", "digest"])
    bits = F.aggregate(
        F.sequence(F.lit(0), F.size("least") - 1),
        F.lit(0).cast("long"),
        lambda bits, i: F.when(F.get("least", i) < F.col("ord"), bits + F.pow(F.lit(2), i).cast("long")).otherwise(bits),
    )
    windows = met.select("t", "start", bits.alias("windows")).where("windows > 0")
    lists = cut_lineage(windows.groupBy("t").agg(F.collect_list(F.struct("start", "windows")).alias("found")))
    searched_texts = kept.select("doc_id", "t", "text").join(lists, "t", "left").select("doc_id", "text", "found")
    return _without(copies, True).unionByName(_without(searched_texts, False))


def _without(rows: DataFrame, all_windows: bool) -> DataFrame:
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(
        [
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", T.ArrayType(span)),
            T.StructField("kept_text", T.BinaryType()),
        ]
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sizes, spans, kept = [], [], []
            for text, found in zip(batch["text"].to_pylist(), batch["found"].to_pylist()):
                words = text.split()
                n = len(words)
                if all_windows:
                    cut = [(0, n)] if n >= WIDTH else []
                else:
                    starts = np.array([f["start"] for f in found or ()], np.int64)
                    windows = np.array([f["windows"] for f in found or ()], np.int64)
                    some, offset = np.nonzero(windows[:, None] >> np.arange(WIDTH) & 1)
                    at = np.unique(starts[some] + offset)
                    new = np.r_[True, np.diff(at) > WIDTH]
                    cut = list(zip(at[new[: len(at)]].tolist(), (at[np.r_[new[1:], True][: len(at)]] + WIDTH).tolist()))
                left, place = [], 0
                for s, e in cut:
                    left += words[place:s]
                    place = e
                sizes.append(n)
                spans.append([{"start": s, "end": e} for s, e in cut])
                kept.append(b" ".join([*left, *words[place:]]))
            arrays = [
                batch["doc_id"], pa.array(sizes, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(remove, schema)
