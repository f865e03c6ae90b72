"""Language-model scores by prediction by partial matching over bytes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import text_or_empty, text_slices
from corpusloom.session import cut_lineage

ORDER = 6
# Bytes a word can hold, and the one that ends it.
ALPHABET = 256 - 6 + 1
END = b""
# Words with at least this share of all are at most so many as its inverse, and are sent to every task.
HOT_WORDS = 2.5e-6
# The most grams that are sent to every task; the others are joined.
HOT_GRAMS = 1_500_000
# Distinct words, and rows of grams, that a task counts before it hands the counts on.
COUNTED = 1 << 19
GRAMS_COUNTED = 1 << 21
# Parts into which the hash of a gram deals the counts, and how much text is cut into grams at once, each of which takes tens of bytes.
DEALT = 1 << 10
SLICE = 1 << 20
# Grams that a task sends to their code lengths at a time, code lengths that it holds before it sends them there, and rows whose sums go together.
SENT = 1 << 20
HELD = 1 << 18
ROWS_TOGETHER = 1 << 12
# Grams whose contexts end in the same so many bytes are scored together; counts of shorter contexts are sent to every task.
TOGETHER = 3
# Places a gram may have in the table of hot ones, and what an empty place holds: no gram, as grams have seven bytes.
_PLACES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB]
_EMPTY = np.uint64((1 << 64) - 1)


def _mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << 8 * n_bytes) - 1)


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each word, and the space that ends it, the ``ORDER`` bytes before and itself as one
    number; and where each word's begin. Spaces stand for what lies before a word."""
    pad = b" " * ORDER
    # A byte before the first pad, so that eight bytes can be read up to every place.
    data = b" ".join([b"", pad + (b" " + pad).join(words), b""])
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begins = np.cumsum(lengths) - lengths
    eights = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    # Of the places from the first that is not padding on, those of the pads between words.
    kept = np.ones(len(eights), bool)
    kept[(begins[1:, None] + ORDER * np.arange(len(words) - 1)[:, None] + np.arange(ORDER)).ravel()] = False
    return eights[kept].astype(np.uint64) & _mask(ORDER + 1), begins


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of each, and where each row's key is."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, weights=values, minlength=len(distinct)), at


def lowered_words(texts: pa.Array) -> list[list[bytes]]:
    """The words of each text, lower-cased in A-Z: bytes know no other letters."""
    return [t.lower().split() for t in texts.cast(pa.binary()).to_pylist()]


def running_text(words: list[bytes]) -> bytes:
    """What is coded of a text, but for the space that ends it: each word and a space. So a text ends where a space follows a space, or at once."""
    return b" ".join([*words, b""])


def shorter_contexts(gram: np.ndarray, count: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context length below ``TOGETHER``: the distinct ends of the grams of one byte more, and their counts."""
    return [_sums(gram & _mask(order + 1), count)[:2] for order in range(TOGETHER)]


def code_lengths(gram: np.ndarray, count: np.ndarray, shorter: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 probability of each gram's last byte after the others.

    Grams whose contexts end in the same ``TOGETHER`` bytes must all be there;
    ``shorter`` has the counts of the whole corpus after fewer bytes.

    The longest context is asked first. A context in which ``n`` bytes of ``q``
    kinds were met gives a byte met ``c`` times ``(2c - 1) / 2n`` and an escape
    ``q / 2n``; after an escape the next shorter context leaves out the bytes that
    the longer one has met, since they did not come. Below the empty context all
    bytes not met at all are as likely.
    """
    logs = np.zeros(len(gram))
    open_ = np.ones(len(gram), bool)
    # Of the context one byte longer: its place per gram, and the pairs met there.
    above_at = above_pairs = above_contexts = None
    for order in range(ORDER, -1, -1):
        if order >= TOGETHER:
            pair, c, pair_at = _sums(gram & _mask(order + 1), count)
        else:
            pair, c = shorter[order]
            pair_at = np.searchsorted(pair, gram & _mask(order + 1))
        context, n, context_at = _sums(pair >> np.uint64(8), c)
        kinds = np.bincount(context_at, weights=c > 0, minlength=len(context))
        at = context_at[pair_at]
        left_n, left_q = n[at], kinds[at]
        if above_pairs is not None:
            # What this context has of the bytes met above, per context above.
            same = np.searchsorted(pair, above_pairs & _mask(order + 1))
            met = np.bincount(above_contexts, weights=c[same], minlength=int(above_at.max()) + 1)
            met_kinds = np.bincount(above_contexts, minlength=len(met))
            left_n, left_q = left_n - met[above_at], left_q - met_kinds[above_at]
        hit = open_ & (c[pair_at] > 0)
        logs[hit] += np.log10((2 * c[pair_at[hit]] - 1) / (2 * left_n[hit]))
        open_ &= ~hit
        escape = open_ & (left_n > 0)
        logs[escape] += np.log10(left_q[escape] / (2 * left_n[escape]))
        seen = c > 0
        above_at, above_pairs, above_contexts = at, pair[seen], context_at[seen]
    met = int((shorter[0][1] > 0).sum())
    logs[open_] -= np.log10(max(1, ALPHABET - met))
    return logs


def vocabulary(rows: DataFrame) -> DataFrame:
    """``word, c`` for all words of ``text``, with their number in rows that may be ``learned`` from.

    Each text ends with the empty word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, others = Counter(), set()

        def flush() -> pa.RecordBatch:
            words = [*learned, *(w for w in others if w not in learned)]
            counts = [*learned.values(), *[0] * (len(words) - len(learned))]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["word", "c"])

        for batch in text_slices(batches):
            for found, learn in zip(lowered_words(batch["text"]), batch["learned"].to_pylist()):
                if learn:
                    learned.update(found)
                    learned[END] += 1
                else:
                    others.update(found)
                    others.add(END)
            if len(learned) + len(others) > COUNTED:
                yield flush()
                learned, others = Counter(), set()
        yield flush()

    return rows.select("text", "learned").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def merged_counts(parts: list[Counts]) -> Counts:
    """Sorted grams with two counts each, summed over the parts, which are sorted too."""
    gram, c, seen = (np.concatenate(x) for x in zip(*parts))
    # This kind of sort makes use of sorted runs.
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    return gram[starts], np.add.reduceat(c[order], starts), np.add.reduceat(seen[order], starts)


def packed(bounds: np.ndarray, keys: np.ndarray, *others: np.ndarray) -> list[bytes]:
    """Columns of eight bytes a value, cut at the bounds into values of their own.

    Keys, sorted between bounds, are kept as differences, and bytes of the same rank together: most are zeros, which compress.
    """
    steps = np.diff(keys, prepend=np.uint64(0))
    steps[bounds[:-1]] = keys[bounds[:-1]]
    columns = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) for x in (steps, *others)]
    ranks = [np.ascontiguousarray(x[:, k]).data for x in columns for k in range(8)]
    return [b"".join([r[at:to] for r in ranks]) for at, to in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def unpacked(value: pa.Scalar, columns: int) -> np.ndarray:
    """The columns of :func:`packed` as unsigned numbers."""
    ranks = np.frombuffer(value.as_buffer(), np.uint8).reshape(columns, 8, -1)
    rows = ranks.transpose(0, 2, 1).copy("C").view(np.uint64)[:, :, 0]
    np.cumsum(rows[0], out=rows[0])
    return rows


def dealt(gram: np.ndarray, *others: np.ndarray) -> pa.RecordBatch:
    """``part, packed``: one row per part into which a hash deals sorted grams, with what belongs to them."""
    part = (gram * np.uint64(_PLACES[0]) >> np.uint64(64 - DEALT.bit_length() + 1)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(DEALT + 1))
    some = np.flatnonzero(np.diff(bounds))
    rows = packed(np.r_[bounds[some], len(gram)], *[x[order] for x in (gram, *others)])
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(rows, pa.binary())], names=["part", "packed"])


def gram_counts(rows: DataFrame) -> DataFrame:
    """``gram, c, seen``: each gram of the running texts, its number in rows that may be ``learned`` from, and in all rows.

    A task hands on its counts as one row per part, into which a hash deals the grams,
    and the rows of a part are merged as they come.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed_on(counts: Counts) -> pa.RecordBatch:
            gram, c, seen = counts
            return dealt(gram, c, seen - c)

        parts: list[Counts] = []
        for batch in text_slices(batches, size=SLICE):
            texts = [running_text(found) for found in lowered_words(batch["text"])]
            distinct, seen = np.unique(grams_of(texts)[0], return_counts=True)
            c = seen.copy()
            others = [t for t, learned in zip(texts, batch["learned"].to_pylist()) if not learned]
            if others:
                unlearned, n = np.unique(grams_of(others)[0], return_counts=True)
                c[np.searchsorted(distinct, unlearned)] -= n
            parts.append((distinct, c, seen))
            if sum(len(p[0]) for p in parts) > GRAMS_COUNTED:
                parts = [merged_counts(parts)]
                if len(parts[0][0]) > GRAMS_COUNTED // 2:
                    yield handed_on(parts[0])
                    parts = []
        if parts:
            yield handed_on(merged_counts(parts))
        pa.default_memory_pool().release_unused()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts: list[Counts]) -> pa.RecordBatch:
            gram, c, seen = merged_counts(parts)
            return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(c), pa.array(seen)], names=["gram", "c", "seen"])

        now, parts, held = None, [], 0
        for batch in batches:
            for part, counts in zip(batch["part"].to_pylist(), batch["packed"]):
                if part != now and parts:
                    yield summed(parts)
                    parts, held = [], 0
                now = part
                gram, c, others = unpacked(counts, 3)
                parts.append((gram, c.view(np.int64), (c + others).view(np.int64)))
                held += len(gram)
                if held > GRAMS_COUNTED:
                    parts, held = [merged_counts(parts)], 0
        if parts:
            yield summed(parts)
        pa.default_memory_pool().release_unused()

    counted = rows.select("text", "learned").mapInArrow(count, "part int, packed binary")
    return counted.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "gram long, c long, seen long")


def trained(grams: DataFrame) -> DataFrame:
    """``gram, seen, log``: log10 of the probability of each gram of ``gram, c, seen``, learned from the counts ``c``."""
    # At most as many rows as there are strings of so many bytes.
    end = F.col("gram").bitwiseAND(F.lit((1 << 8 * TOGETHER) - 1))
    ends = grams.groupBy(end.alias("gram")).agg(F.sum("c").alias("c")).toArrow()
    held = grams.sparkSession.sparkContext.broadcast(
        shorter_contexts(ends["gram"].to_numpy().view(np.uint64), ends["c"].to_numpy().astype(float))
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(rows: np.ndarray) -> pa.RecordBatch:
            logs = code_lengths(rows[:, 1].view(np.uint64), rows[:, 2].astype(float), held.value)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 1]), pa.array(rows[:, 3]), pa.array(logs)], names=["gram", "seen", "log"])

        waiting = np.zeros((0, 4), np.int64)
        for batch in batches:
            rows = np.stack([batch[k].to_numpy() for k in ("end", "gram", "c", "seen")], axis=1)
            rows = np.concatenate([waiting, rows])
            if not len(rows):
                continue
            # The last end may go on in the next batch.
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if cut:
                yield scored(rows[:cut])
            waiting = rows[cut:]
        if len(waiting):
            yield scored(waiting)

    end = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * TOGETHER) - 1))
    met = grams.select(end.alias("end"), "gram", "c", "seen").repartition("end").sortWithinPartitions("end")
    return met.mapInArrow(predict, "gram long, seen long, log double")


def hot_grams(grams: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A table of the grams seen most often, at most ``most`` (``HOT_GRAMS``): :func:`places` by their hashes."""
    step = F.floor(8 * F.log2("seen")).cast("int")
    sizes = sorted(((r.step, r.n) for r in grams.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    held, least = 0, None
    for at, n in sizes:
        held += n
        if held > (HOT_GRAMS if most is None else most):
            break
        least = at
    top = grams.where(step >= least if least is not None else F.lit(False)).select("gram", "seen", "log").toArrow()
    order = np.argsort(-top["seen"].to_numpy(), kind="stable")
    return places(top["gram"].to_numpy().view(np.uint64)[order], top["log"].to_numpy()[order])


def places(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values at places by the keys' hashes; a key all of whose places are taken by ones before it is left out."""
    bits = max(4, int(len(keys) * 4 // 3).bit_length())
    slots, held = np.full(1 << bits, _EMPTY), np.zeros(1 << bits)
    for place in _PLACES:
        at = (keys * np.uint64(place) >> np.uint64(64 - bits)).view(np.int64)
        distinct, first = np.unique(at, return_index=True)
        free = slots[distinct] == _EMPTY
        slots[distinct[free]], held[distinct[free]] = keys[first[free]], values[first[free]]
        rest = np.ones(len(keys), bool)
        rest[first[free]] = False
        keys, values = keys[rest], values[rest]
    return slots, held


def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value of each key, zero if the table has it not; and the indexes of those that it has not."""
    slots, held = table
    shift = np.uint64(65 - len(slots).bit_length())
    at = (keys * np.uint64(_PLACES[0]) >> shift).view(np.int64)
    hit = slots[at] == keys
    out = np.where(hit, held[at], 0.0)
    rest = np.flatnonzero(~hit)
    for place in _PLACES[1:]:
        at = (keys[rest] * np.uint64(place) >> shift).view(np.int64)
        hit = slots[at] == keys[rest]
        out[rest[hit]] = held[at[hit]]
        rest = rest[~hit]
    return out, rest


def joined_logs(looked: DataFrame, grams: DataFrame) -> DataFrame:
    """``row, s``: per row of ``row, grams`` the sum of its grams' logs in ``gram, log``.

    A hash deals both into parts, packed, where the logs come before the grams of the
    texts; a part's logs are held together. Sums of rows go back packed by blocks of rows.
    """

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            gram, log = (np.concatenate([p[k].to_numpy() for p in parts]) for k in ("gram", "log"))
            order = np.argsort(gram)
            return dealt(gram[order].view(np.uint64), log[order])

        parts, held = [], 0
        for batch in batches:
            parts.append(batch)
            held += batch.num_rows
            if held > HELD:
                yield sent(parts)
                parts, held = [], 0
        if held:
            yield sent(parts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            gram, row = (np.concatenate(x) for x in zip(*parts))
            for at in range(0, len(gram), SENT):
                order = at + np.argsort(gram[at : at + SENT])
                yield dealt(gram[order], row[order])

        parts, held = [], 0
        for batch in batches:
            row = np.repeat(batch["row"].to_numpy(), batch["grams"].value_lengths().to_numpy(zero_copy_only=False))
            parts.append((batch["grams"].flatten().to_numpy().view(np.uint64), row))
            held += len(row)
            if held > SENT:
                yield from sent(parts)
                parts, held = [], 0
        if held:
            yield from sent(parts)
        pa.default_memory_pool().release_unused()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            row, s, _ = _sums(*(np.concatenate(x) for x in zip(*parts)))
            block = row // ROWS_TOGETHER
            starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            rows = packed(np.r_[starts, len(row)], row.view(np.uint64), s)
            return pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array(rows, pa.binary())], names=["block", "packed"])

        now, logs, table, parts, held = None, [], None, [], 0
        for batch in batches:
            for part, kind, value in zip(batch["part"].to_pylist(), batch["kind"].to_pylist(), batch["packed"]):
                if part != now:
                    now, logs, table = part, [], None
                gram, other = unpacked(value, 2)
                if kind == 0:
                    logs.append((gram, other.view(np.float64)))
                    continue
                if table is None:
                    known, log = (np.concatenate(x) for x in zip(*logs))
                    order = np.argsort(known)
                    table = known[order], log[order]
                parts.append((other.view(np.int64), table[1][np.searchsorted(table[0], gram)]))
                held += len(gram)
                if held > SENT:
                    yield summed(parts)
                    parts, held = [], 0
        if held:
            yield summed(parts)
        pa.default_memory_pool().release_unused()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(parts, axis=1)
            row, s, _ = _sums(rows[0].view(np.int64), rows[1].view(np.float64))
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(s)], names=["row", "s"])

        now, parts, held = None, [], 0
        for batch in batches:
            for block, value in zip(batch["block"].to_pylist(), batch["packed"]):
                if block != now and parts:
                    yield summed(parts)
                    parts, held = [], 0
                now = block
                parts.append(unpacked(value, 2))
                held += parts[-1].shape[1]
                if held > SENT:
                    # At most so many rows as a block has.
                    merged = summed(parts)
                    parts = [np.stack([merged[k].to_numpy().view(np.uint64) for k in ("row", "s")])]
                    held = merged.num_rows
        if parts:
            yield summed(parts)

    # Every gram of a text is there, as grams are counted in all rows.
    known = grams.select("gram", "log").mapInArrow(hold, "part int, packed binary").withColumn("kind", F.lit(0))
    asked = looked.select("row", "grams").mapInArrow(send, "part int, packed binary").withColumn("kind", F.lit(1))
    met = known.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind")
    blocks = met.mapInArrow(meet, "block long, packed binary").repartition("block").sortWithinPartitions("block")
    return blocks.mapInArrow(add, "row long, s double")


def text_scores(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, learned, n_tokens, n_known, train_tokens, base_score, score``.

    A text is its words, lower-cased in A-Z, and an end. ``score`` is its log10
    probability by prediction by partial matching: every byte of the running text,
    words with a space behind each and a space for the end, is coded after the six
    bytes before it, across words, from a byte-context trie of order six with
    escapes and exclusion of the bytes already escaped from. Before a text lie spaces.

    The trie is the table of all grams of seven bytes, and a gram's code length is
    one number, computed once for each distinct gram. All counts are of rows where ``may_learn``
    holds. ``base_score`` adds the logs of the words' smoothed frequencies.

    Frequent grams and words are looked up in the task that reads a text; its
    rarer ones are sent to their scores. Null texts count as empty: an end
    alone. Rows that repeat an id are scored each for itself. Nothing to learn from
    leaves all bytes as likely. An empty table gives no rows.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        text_or_empty(text_col).alias("text"),
        F.coalesce(may_learn, F.lit(True)).alias("learned"),
    )
    words = cut_lineage(vocabulary(rows))
    tokens, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    scores = words.select("word", "c", F.log10((F.col("c") + 0.1) / (tokens + 0.1 * (kinds + 1))).alias("base"))
    # At most 1 / HOT_WORDS rows.
    often = F.col("c") >= max(2.0, HOT_WORDS * tokens)
    hot = scores.where(often).select("word", "base").toArrow()
    hot = dict(zip(hot["word"].to_pylist(), hot["base"].to_pylist()))
    grams = cut_lineage(trained(cut_lineage(gram_counts(rows))))
    # Plain arrays: workers need not be able to import this package.
    held = docs.sparkSession.sparkContext.broadcast((hot, hot_grams(grams)))
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("learned", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("words", T.ArrayType(T.BinaryType())),
            T.StructField("counts", T.ArrayType(T.IntegerType())),
            T.StructField("grams", T.ArrayType(T.LongType())),
        ]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = held.value
        for batch in text_slices(batches, size=SLICE):
            texts, sums, rest, counts = [], [], [], []
            for found in lowered_words(batch["text"]):
                texts.append(running_text(found))
                found.append(END)
                bases = list(map(known.get, found))
                others: Counter[bytes] = Counter()
                if None in bases:
                    others.update(w for w, b in zip(found, bases) if b is None)
                    bases = [b for b in bases if b is not None]
                sums.append((len(found), len(bases), float(sum(bases))))
                rest.append(list(others))
                counts.append(list(others.values()))
            gram, begins = grams_of(texts)
            logs, open_ = look_up(table, gram)
            offsets = np.r_[np.searchsorted(open_, begins), len(open_)]
            n_tokens, n_known, base = zip(*sums)
            arrays = [
                batch["row"], batch["doc_id"], batch["learned"],
                pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(np.add.reduceat(logs, begins)),
                pa.array(rest, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int32())),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(gram[open_].view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        # Workers live on between stages.
        pa.default_memory_pool().release_unused()

    looked = cut_lineage(rows.mapInArrow(score, schema), "zstd")
    sent = looked.select("row", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    # Hot words and grams are settled above, so no key of these joins has a large share of the rows.
    of_words = (
        sent.select("row", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
        .join(scores, "word")
        .select("row", F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("k"), (F.col("n") * F.col("base")).alias("b"), F.lit(0.0).alias("s"))
    )
    more = of_words.unionByName(joined_logs(looked, grams).select("row", F.lit(0).alias("k"), F.lit(0.0).alias("b"), "s"))
    more = more.groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    both = looked.select("row", "doc_id", "learned", "n_tokens", "n_known", "base_score", "score").join(more, "row", "left")
    return both.select(
        "doc_id",
        "learned",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
