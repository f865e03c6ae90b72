"""Near-duplicate links between SimHash fingerprints by deletion-variant signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import tokens
from corpusloom.llm.common import ascii_lower, text_or_empty, text_slices
from corpusloom.llm.components import components
from corpusloom.llm.word_hashes import gram_hashes, hashed_words
from corpusloom.operators.sizing import broadcast_if_small
from corpusloom.session import cut_lineage

SHINGLE = 4
DISTANCE = 4
SEED = 42
BITS = 64
# Runs of one key up to this length are compared pair by pair at once; longer ones are contracted first.
SHORT_RUN = 8
# Shingles whose bits are counted at once.
BIT_ROWS = 1 << 16


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """The SimHash of a lower-cased text: bit ``b`` is set if it is in over half of the shingle hashes."""
    import xxhash

    parts = text.encode().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(parts) - width + 1)
    last = ends[min(width, len(parts)) - 1 :].tolist()
    of = xxhash.xxh64_intdigest
    hashes = np.fromiter((of(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, BIT_ROWS):
        raw = hashes[at : at + BIT_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` per document; ``fp`` holds the 64 bits as a signed integer.

    Texts are lower-cased in A-Z only. Shorter ones count as one shingle; null
    texts and texts without a word have the fingerprint zero. Long texts are
    hashed in blocks.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text_or_empty(text_col)).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            fps = np.array([fingerprint(t, width) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], names=schema.names)

    return rows.mapInArrow(hashed, schema)


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """First bit and width of the fewest segments of which one differs in one bit at most."""
    n = distance // 2 + 1
    bounds = [round(i * BITS / n) for i in range(n + 1)]
    return list(zip(bounds, (b - a for a, b in zip(bounds, bounds[1:]))))


def variants(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``key, fp`` with one row per bit: the segment of that bit without it, and its place.

    Two fingerprints whose segment differs in one bit at most share the key of
    that bit, so of all pairs within the distance none is missed.
    """
    cases = []
    for first, width in segments(distance):
        segment = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            rest = segment.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << bit)))
            cases.append(F.shiftleft(rest, 7).bitwiseOR(F.lit(first + bit)))
    return fps.select(F.explode(F.array(*cases)).alias("key"), "fp")


def contract(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Index pairs within the distance that connect all fingerprints of a run which such pairs connect.

    Sorting by rotated bits finds most links between neighbours. Then only
    members of different parts are compared, so a dense run is soon one part,
    and never more than one link per member is given.
    """
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []

    def link(pairs: Iterator[tuple[int, int]]) -> None:
        for i, j in pairs:
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                found.append((i, j))

    for turn in range(0, BITS, 4):
        t = np.uint64(turn)
        order = np.argsort(fps if not turn else fps << t | fps >> np.uint64(BITS - turn), kind="stable")
        near = np.flatnonzero(np.bitwise_count(fps[order[1:]] ^ fps[order[:-1]]) <= distance)
        link(zip(order[near].tolist(), order[near + 1].tolist()))
    part = np.fromiter((root(i) for i in range(len(fps))), np.int64, len(fps))
    sizes = np.bincount(part, minlength=len(fps))
    rest = np.flatnonzero(part != sizes.argmax())
    for i in rest.tolist():
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= distance)
        link((i, j) for j in near.tolist() if part[j] != part[i])
    return found


def near_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints that join exactly those which pairs within ``distance`` connect.

    Rows of one variant key meet in one task through a shuffle on the key and
    are verified there. A key with many fingerprints gives a spanning set of
    its links and not all its pairs. What a task holds of a key is eight bytes
    per distinct fingerprint, however many documents have it.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key = np.zeros(0, np.int64)
        held_fp = np.zeros(0, np.uint64)

        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            lengths = np.diff(np.r_[starts, len(key)])
            short = np.repeat(lengths <= SHORT_RUN, lengths)
            for lag in range(1, SHORT_RUN):
                same = short[:-lag] & (key[lag:] == key[:-lag])
                near = np.flatnonzero(same & (np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= distance))
                a.append(fp[near])
                b.append(fp[near + lag])
            for start, n in zip(starts[lengths > SHORT_RUN].tolist(), lengths[lengths > SHORT_RUN].tolist()):
                run = fp[start : start + n]
                pairs = np.array(contract(run, distance), np.int64).reshape(-1, 2)
                a.append(run[pairs[:, 0]])
                b.append(run[pairs[:, 1]])
            left, right = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])

        for batch in batches:
            key = np.r_[held_key, batch["key"].to_numpy()]
            fp = np.r_[held_fp, batch["fp"].to_numpy().view(np.uint64)]
            if not len(key):
                continue
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield links(key[:cut], fp[:cut])
            held_key, held_fp = key[cut:], fp[cut:]
        if len(held_key):
            yield links(held_key, held_fp)

    keyed = variants(fps.select("fp").distinct(), distance)
    met = keyed.repartition("key").sortWithinPartitions("key", "fp")
    both = met.mapInArrow(verify, "a long, b long")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``, the smallest id that links of near fingerprints reach.

    Copies of a text share a fingerprint, and only distinct fingerprints are
    linked. Null ids are reached but never name a group unless it has no other.
    Repeated rows share their group; an empty table gives no rows.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col, width))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reach = cut_lineage(components(near_links(distinct, distance)))
    named = distinct.join(reach.withColumnRenamed("node", "fp"), "fp").select("fp", "component", "least")
    least = named.groupBy("component").agg(F.min("least").alias("linked_id"))
    linked = cut_lineage(named.join(least, "component").select("fp", "linked_id"))
    names = distinct.join(broadcast_if_small(linked), "fp", "left").select(
        "fp", F.coalesce("linked_id", "least").alias("component_id")
    )
    return marked.join(broadcast_if_small(cut_lineage(names)), "fp", "left").select("doc_id", "fp", "component_id")


# Similar texts: five-word shingles, of which two texts share this part of all they have.
WIDE_SHINGLE = 5
SIMILAR = 0.8
# Fingerprints of a text, their segments, and the most bits by which similar texts differ. At a similarity of 0.8
# a bit differs with a chance of 0.152: of 128 bits 19 do, give or take four; one of the eight segments of 16 bits
# differs in one bit at most with a chance of 0.925 (0.97 at 0.85). Texts with nothing in common differ in 64, give or take six.
WIDE = 2
WIDE_SEGMENTS = 6
WIDE_DISTANCE = 32
# Members of a key that are compared pair by pair; of more, spanning links are given.
WIDE_RUN = 32
# Links of a fingerprint that are compared first.
CLOSEST = 4
# Shingles that lead more sets than this go last in the order, the most frequent first to be chosen; how often such are looked for.
HOT_KEY = 32
HOT_MOST = 1 << 20
HOT_ROUNDS = 3
# Sets of a crowded shingle that make a block; two blocks are compared in a task, so many of their shingles at a time,
# and so many sets with all.
BLOCK = 1024
COLUMNS = 1024
ROWS = 128
# Text that is made into sets at once.
SET_BYTES = 1 << 20
_MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """A hash of every five words of a text; fewer words are one shingle."""
    return gram_hashes(hashes, max(1, min(WIDE_SHINGLE, len(hashes))))


def shingle_set(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """The distinct shingles of a text in order, and a hash of them all."""
    import xxhash

    found = np.unique(shingle_hashes(hashes))
    return found, int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def leading(found: np.ndarray, hot: np.ndarray, similar: float) -> np.ndarray:
    """The first shingles of a set in an order that all sets share, ``hot`` ones last.

    Sets that share ``similar`` of all they have share one of these: the first in order of those
    they share has behind it, in each of the two, all others that they share.
    """
    if len(hot):
        at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
        late = hot[at] == found
        found = np.r_[found[~late], found[late]]
    return found[: len(found) - math.ceil(similar * len(found) - 1e-9) + 1]


def wide_fingerprints(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``doc_id, f0, f1, node, size, keys`` of each text of ``doc_id, text``.

    Two fingerprints, zero for one without a word; the hash and size of its set of shingles, and those that lead it.
    """
    fields = [rows.schema["doc_id"], *(T.StructField(f"f{k}", T.LongType()) for k in range(WIDE))]
    schema = T.StructType(fields).add("node", "long").add("size", "integer").add("keys", T.ArrayType(T.LongType()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in text_slices(batches, size=SET_BYTES):
            hashes, base = hashed_words(batch["text"].cast(pa.binary()).to_pylist())
            out = np.zeros((WIDE, batch.num_rows), np.uint64)
            nodes, sizes, keys = [], [], []
            for d in range(batch.num_rows):
                found, node = shingle_set(hashes[base[d] : base[d + 1]])
                nodes.append(node)
                sizes.append(len(found))
                keys.append(leading(found, found[:0], similar).view(np.int64))
            for d in np.flatnonzero(np.diff(base)).tolist():
                grams = shingle_hashes(hashes[base[d] : base[d + 1]])
                for k, step in enumerate(_MIX):
                    mixed = grams * np.uint64(step)
                    mixed ^= mixed >> np.uint64(29)
                    mixed *= np.uint64(0xBF58476D1CE4E5B9)
                    mixed ^= mixed >> np.uint64(32)
                    counts = np.zeros(BITS, np.int64)
                    for at in range(0, len(mixed), BIT_ROWS):
                        raw = mixed[at : at + BIT_ROWS].view(np.uint8).reshape(-1, 8)
                        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
                    out[k, d] = np.packbits(2 * counts > len(mixed), bitorder="little").view(np.uint64)[0]
            columns = [
                batch["doc_id"], *(pa.array(f.view(np.int64)) for f in out),
                pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        # Workers live on between stages.
        pa.default_memory_pool().release_unused()

    return rows.select("doc_id", "text").mapInArrow(hashed, schema)


def leader_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of near fingerprints that connect the members of a crowded key.

    Each member is linked to the leaders it is near to, and to its neighbours in
    sorted order; a member near to no leader becomes one. Members are compared with
    leaders, not all with all.
    """
    leaders = np.zeros(0, np.int64)
    left, right = [], []

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        apart = np.zeros((len(i), len(j)), np.uint8)
        for k in range(fp.shape[1]):
            apart += np.bitwise_count(fp[i, k][:, None] ^ fp[j, k])
        return apart <= WIDE_DISTANCE

    for at in range(0, len(fp), 256):
        slab = np.arange(at, min(len(fp), at + 256))
        hit = near(slab, leaders)
        open_ = slab[~hit.any(1)]
        inside = near(open_, open_)
        leads, follows = np.zeros(len(open_), bool), np.zeros(len(open_), bool)
        for i in range(len(open_)):
            if not follows[i]:
                leads[i] = True
                follows |= inside[i]
        member, leader = np.nonzero(hit)
        first, later = np.nonzero(np.triu(inside, 1) & leads[:, None])
        left += [leaders[leader], open_[first]]
        right += [slab[member], open_[later]]
        leaders = np.r_[leaders, open_[leads]]
    for lag in (1, 2):
        i = np.arange(len(fp) - lag)
        i = i[np.bitwise_count(fp[i] ^ fp[i + lag]).sum(1, dtype=np.int64) <= WIDE_DISTANCE]
        left.append(i)
        right.append(i + lag)
    return np.concatenate(left), np.concatenate(right)


def wide_links(fps: DataFrame) -> DataFrame:
    """``a, b``: hashes of fingerprints that share a one-wildcard segment and differ in few bits of all.

    Each fingerprint gives its closest links only, so that their number grows with the members of
    a group; what these leave out is for :func:`rest_links`.
    """
    names = [f"f{k}" for k in range(WIDE)]
    cases = []
    for k, name in enumerate(names):
        for first, width in segments(WIDE_SEGMENTS):
            segment = F.shiftrightunsigned(name, first).bitwiseAND(F.lit((1 << width) - 1))
            for bit in range(width):
                rest = segment.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << bit)))
                cases.append(F.shiftleft(rest, 8).bitwiseOR(F.lit(k * BITS + first + bit)))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, WIDE + 1), np.int64)

        def links(rows: np.ndarray) -> pa.RecordBatch:
            key, fp = rows[:, 0], rows[:, 1:].view(np.uint64)
            differ = lambda i, j: np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            lengths = np.diff(np.r_[starts, len(key)])
            short = np.repeat(lengths <= WIDE_RUN, lengths)
            left, right = [], []
            for lag in range(1, min(WIDE_RUN, int(lengths.max()))):
                at = np.flatnonzero(short[:-lag] & (key[lag:] == key[:-lag]))
                at = at[differ(at, at + lag) <= WIDE_DISTANCE]
                left.append(at)
                right.append(at + lag)
            for start, n in zip(starts[lengths > WIDE_RUN].tolist(), lengths[lengths > WIDE_RUN].tolist()):
                x, y = leader_links(fp[start : start + n])
                left.append(start + x)
                right.append(start + y)
            a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (left, right))
            sides = [pa.array(rows[side, 1 + k]) for side in (a, b) for k in range(WIDE)]
            apart = pa.array(differ(a, b), pa.int64())
            return pa.RecordBatch.from_arrays([*sides, apart], names=[*(f"{s}{k}" for s in "ab" for k in range(WIDE)), "apart"])

        for batch in batches:
            rows = np.stack([batch[c].to_numpy() for c in ["key", *names]], axis=1)
            rows = np.concatenate([held, rows])
            if not len(rows):
                continue
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if cut:
                yield links(rows[:cut])
            held = rows[cut:]
        if len(held):
            yield links(held)
        pa.default_memory_pool().release_unused()

    keyed = fps.select(F.explode(F.array(*cases)).alias("key"), *names)
    met = keyed.repartition("key").sortWithinPartitions("key", *names)
    found = met.mapInArrow(verify, ", ".join(f"{s}{k} long" for s in "ab" for k in range(WIDE)) + ", apart long")
    side = lambda s: F.xxhash64(*[f"{s}{k}" for k in range(WIDE)])
    ends = cut_lineage(found.select(side("a").alias("a"), side("b").alias("b"), "apart").distinct())
    either = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
    nth = F.row_number().over(Window.partitionBy("a").orderBy("apart", "b"))
    first = either.distinct().withColumn("nth", nth).where(F.col("nth") <= CLOSEST)
    return first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def set_rows(rows: DataFrame, chosen: DataFrame, similar: float, hot: np.ndarray | None = None) -> DataFrame:
    """``node, shingles`` of the nodes ``node, doc_id``; those that lead the set only, where ``hot`` ones are told."""
    late = rows.sparkSession.sparkContext.broadcast(hot)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in text_slices(batches, size=SET_BYTES):
            hashes, base = hashed_words(batch["text"].cast(pa.binary()).to_pylist())
            found = [shingle_set(hashes[base[d] : base[d + 1]]) for d in range(batch.num_rows)]
            sets = [(f if late.value is None else leading(f, late.value, similar)).view(np.int64) for f, _ in found]
            columns = [pa.array([node for _, node in found], pa.int64()), pa.array([len(f) for f, _ in found], pa.int32()), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "shingles"])
        pa.default_memory_pool().release_unused()

    chosen = broadcast_if_small(cut_lineage(chosen))
    # Rows that repeat an id may have other texts.
    texts = rows.join(chosen.select("doc_id"), rows["doc_id"].eqNullSafe(chosen["doc_id"]), "left_semi").select("text")
    made = texts.mapInArrow(shingled, "node long, size int, shingles array<long>").join(chosen.select("node"), "node", "left_semi")
    return cut_lineage(made.groupBy("node").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles")))


def similar_links(sets: DataFrame, links: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The links ``a, b`` whose sets (``node, shingles``) share enough."""
    pairs = links.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    pairs = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    # Row by row in the JVM: a batch of such pairs may be of any size.
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.where(both >= similar * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def spanning_links(sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Index pairs of sets that share enough, which connect all that such pairs connect: each set is compared with all others."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Shingles of one set alone are shared with none.
    number = np.cumsum(times > 1) - 1
    kept = times[column] > 1
    owner, column = owner[kept], number[column[kept]]
    both = np.zeros((len(sets), len(sets)), np.int32)
    shared = np.empty(both.shape, np.float32)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        some = (column >= at) & (column < at + COLUMNS)
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[some], column[some] - at] = 1
        np.matmul(has, has.T, out=shared)
        np.add(both, shared, out=both, casting="unsafe")
    del shared
    near = np.empty(both.shape, bool)
    for at in range(0, len(sets), ROWS):
        of = slice(at, at + ROWS)
        near[of] = both[of] >= similar * (size[of, None] + size - both[of])
    del both
    found, open_ = [], np.ones(len(sets), bool)
    for start in range(len(sets)):
        if open_[start]:
            open_[start] = False
            reached = [start]
            while reached:
                i = reached.pop()
                more = np.flatnonzero(near[i] & open_)
                open_[more] = False
                found += [(i, j) for j in more.tolist()]
                reached += more.tolist()
    return found


def rest_links(rows: DataFrame, nodes: DataFrame, table: DataFrame, known: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Links ``a, b`` that, with the ``known`` ones, connect all nodes that pairs of similar sets connect.

    ``nodes`` has ``node, least``, ``table`` has ``node, size, keys``, ``known`` has ``node, component``. Similar
    sets share one of the shingles that lead them, and meet there. Frequent shingles go last in the order, so that
    they lead few. Of a shingle with few sets the pairs of different components meet; those that meet
    often enough are compared one by one: what two sets share is what leads both, and no more than all that does not
    lead the one whose leading shingles end first. The sets of a crowded shingle are sent to tasks by the block, which compare
    all with all: rows grow with the members, and what a task holds is two blocks.
    """
    late = np.zeros(0, np.uint64)
    changed = table
    for _ in range(HOT_ROUNDS):
        often = changed.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") > HOT_KEY)
        often = often.orderBy(F.desc("count"), "key").limit(HOT_MOST)
        more = np.setdiff1d(often.select("key").toArrow()["key"].to_numpy().view(np.uint64), late)
        if not len(more):
            break
        late = np.union1d(late, more)
        fresh = table.sparkSession.createDataFrame(pa.table({"key": more.view(np.int64)}))
        led = table.select("node", F.explode("keys").alias("key")).join(F.broadcast(fresh), "key", "left_semi")
        touched = cut_lineage(led.select("node").distinct())
        chosen = nodes.join(broadcast_if_small(touched), "node", "left_semi").select("node", F.col("least").alias("doc_id"))
        changed = set_rows(rows, chosen, similar, late).select("node", "size", F.col("shingles").alias("keys"))
        table = table.join(broadcast_if_small(touched), "node", "left_anti").unionByName(changed)

    names = ["key", "node", "place", "size", "component"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def candidates(held: np.ndarray) -> pa.RecordBatch:
            group, node, place, size, component = held.T
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            lengths = np.diff(np.r_[starts, len(held)])
            short = np.repeat(lengths <= WIDE_RUN, lengths)
            # How many shingles do not lead a set, and how many are behind each place.
            rest = np.ceil(similar * size - 1e-9) - 1
            behind = size - place
            a, b, wants, blocks = [], [], [], []
            for lag in range(1, min(WIDE_RUN, int(lengths.max()))):
                at = np.flatnonzero(short[:-lag] & (group[lag:] == group[:-lag]) & (component[lag:] != component[:-lag]))
                to = at + lag
                fits = np.minimum(size[at], size[to]) >= similar * np.maximum(size[at], size[to]) - 1e-6
                at, to = at[fits], to[fits]
                a.append(np.minimum(node[at], node[to]))
                b.append(np.maximum(node[at], node[to]))
                wants.append(similar / (1 + similar) * (size[at] + size[to]) - np.maximum(rest[at], rest[to]) - 1e-6)
                blocks.append(np.zeros(len(at), np.int64))
            for start, n in zip(starts[lengths > WIDE_RUN].tolist(), lengths[lengths > WIDE_RUN].tolist()):
                of = slice(start, start + n)
                # Sets with too little behind their place to be similar to even the smallest stay away, and those of one component.
                meets = behind[of] * (1 + similar) / similar - size[of] >= size[of].min() - 1e-6
                if not (component[of][meets] != component[of][meets][:1]).any():
                    meets[:] = False
                a.append(node[of])
                b.append(group[of])
                wants.append(np.zeros(n))
                blocks.append(np.where(meets, -(-int(meets.sum()) // BLOCK), -1))
            columns = [np.concatenate([*x, np.zeros(0, d)]) for x, d in ((a, np.int64), (b, np.int64), (wants, float), (blocks, np.int64))]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "wants", "blocks"])

        waiting = np.zeros((0, len(names)), np.int64)
        for batch in batches:
            held = np.concatenate([waiting, np.stack([batch[c].to_numpy() for c in names], axis=1)])
            if not len(held):
                continue
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(held[:, 0], held[-1, 0]))
            if cut:
                yield candidates(held[:cut])
            waiting = held[cut:]
        if len(waiting):
            yield candidates(waiting)
        pa.default_memory_pool().release_unused()

    of = table.join(broadcast_if_small(known), "node", "left").select("node", F.col("size").cast("long").alias("size"), F.coalesce("component", "node").alias("component"), "keys")
    keyed = of.select(F.posexplode("keys").alias("place", "key"), "node", "size", "component").withColumn("place", F.col("place").cast("long"))
    met = keyed.select(*names).repartition("key").sortWithinPartitions("key")
    # Pairs a, b with no blocks, once for each key; of crowded keys the members a of b, of which those with blocks meet.
    found = met.mapInArrow(meet, "a long, b long, wants double, blocks long")
    found = cut_lineage(found.groupBy("a", "b", "wants", "blocks").agg(F.count("*").alias("n")))
    in_crowds = found.where("blocks <> 0").groupBy("a").agg(F.count("*").alias("k"))
    in_crowds = broadcast_if_small(cut_lineage(in_crowds))
    pairs = found.where("blocks = 0").join(in_crowds.withColumnRenamed("k", "of_a"), "a", "left")
    pairs = pairs.join(in_crowds.select(F.col("a").alias("b"), F.col("k").alias("of_b")), "b", "left")
    crowds = F.least(F.coalesce("of_a", F.lit(0)), F.coalesce("of_b", F.lit(0)))
    pairs = cut_lineage(pairs.where(F.col("n") + crowds >= F.col("wants")).select("a", "b"))
    crowded = found.where("blocks > 0").select(F.col("a").alias("node"), F.col("b").alias("key"), "blocks")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowded.select("node")).distinct()
    sets = set_rows(rows, nodes.join(wanted, "node", "left_semi").select("node", F.col("least").alias("doc_id")), similar)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(members: dict[int, np.ndarray]) -> pa.RecordBatch:
            ids = np.array(list(members), np.int64)
            i, j = np.array(spanning_links(list(members.values()), similar), np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

        tokens.forget()
        now, members = None, {}
        for batch in batches:
            ends = batch["shingles"].offsets.to_numpy()
            flat = batch["shingles"].values.to_numpy()
            for d, group in enumerate(zip(*(batch[c].to_pylist() for c in ("key", "low", "high")))):
                if group != now and members:
                    yield links(members)
                    members = {}
                now = group
                members[batch["node"][d].as_py()] = flat[ends[d] : ends[d + 1]].copy()
        if members:
            yield links(members)
        pa.default_memory_pool().release_unused()

    block, other = F.pmod(F.xxhash64("node"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = crowded.select("key", "node", block.alias("block"), other.alias("other"))
    dealt = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node")
    groups = dealt.join(sets, "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    near = groups.select("key", "low", "high", "node", "shingles").mapInArrow(compare, "a long, b long")
    return similar_links(sets, pairs, similar).unionByName(near)


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per document: ``doc_id, component_id``, the smallest id that links of similar texts reach.

    Texts are lower-cased in A-Z; two are linked if the sets of their five-word
    shingles share at least ``similar`` of what they have together. Candidates are found
    by one-wildcard segments of two fingerprints, at the similarity of 0.8
    with a chance of 0.925 and above it with more, and are then compared exactly. Links that these miss, and those
    that crowded keys leave out, are found by the shingles that lead the sets: the groups are exact.

    Texts with equal sets are similar; so are those without a word. Null ids are reached but never
    name a group unless it has no other. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(text_or_empty(text_col)).alias("text"))
    names = [f"f{k}" for k in range(WIDE)]
    marked = cut_lineage(wide_fingerprints(rows, similar))
    of_node = [F.first(c).alias(c) for c in names]
    distinct = cut_lineage(marked.groupBy("node").agg(F.min("doc_id").alias("least"), *of_node).withColumn("print", F.xxhash64(*names)))
    first = broadcast_if_small(distinct.select(F.col("node").alias("of"), "least"))
    table = marked.join(first, (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "size", "keys")
    # One node stands for all with its fingerprints; the others are compared with it.
    prints = cut_lineage(distinct.groupBy("print", *names).agg(F.min("node").alias("stands")))
    by_print = prints.select("print", "stands")
    links = cut_lineage(wide_links(prints))
    links = links.join(by_print.select(F.col("print").alias("a"), F.col("stands").alias("node_a")), "a")
    links = links.join(by_print.select(F.col("print").alias("b"), F.col("stands").alias("node_b")), "b")
    links = links.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    alike = distinct.join(broadcast_if_small(by_print), "print").where("node <> stands").select(F.col("stands").alias("a"), F.col("node").alias("b"))
    links = cut_lineage(links.unionByName(alike))
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    sets = set_rows(rows, distinct.join(ends, "node", "left_semi").select("node", F.col("least").alias("doc_id")), similar)
    found = cut_lineage(similar_links(sets, links, similar))
    rest = cut_lineage(rest_links(rows, distinct, table, cut_lineage(components(found)), similar))
    reach = cut_lineage(components(found.unionByName(rest)))
    named = distinct.join(reach, "node").select("node", "component", "least")
    least = named.groupBy("component").agg(F.min("least").alias("linked_id"))
    linked = cut_lineage(named.join(least, "component").select("node", "linked_id"))
    ids = distinct.join(broadcast_if_small(linked), "node", "left").select("node", F.coalesce("linked_id", "least").alias("component_id"))
    return marked.select("doc_id", "node").join(broadcast_if_small(cut_lineage(ids)), "node", "left").select("doc_id", "component_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The documents that name their group of similar texts, with all their columns; rows without an id stay.

    Of rows that repeat an id all stay or go together.
    """
    found = similar_texts(docs.where(F.col(id_col).isNotNull()), id_col, text_col, similar)
    drop = cut_lineage(found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(broadcast_if_small(drop), id_col, "left_anti").select(*docs.columns)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that name their group, with all their columns; rows without an id stay.

    Of rows that repeat an id all stay or go together.
    """
    found = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    drop = cut_lineage(found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(broadcast_if_small(drop), id_col, "left_anti").select(*docs.columns)
