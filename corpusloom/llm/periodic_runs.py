"""Maximal periodic runs of words, found by uniting suffixes in the order of what they share."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import text_or_empty, text_slices
from corpusloom.llm.word_hashes import gram_hashes, hashed_words

# A run has this many words, and its period this many times, at least.
WORDS = 6
TIMES = 4
# Two places of a run one period apart share at least this many words.
SHARED = 5
SLICE = 1 << 20
# Places kept in one sorted list.
CHUNK = 1024


class Places:
    """An ordered set of places, in sorted lists of bounded length."""

    def __init__(self, place: int):
        self.size = 1
        self.chunks = [[place]]
        self.lasts = [place]

    def __iter__(self) -> Iterator[int]:
        return (p for chunk in self.chunks for p in chunk)

    def around(self, place: int) -> tuple[int, int]:
        """The places before and after one that is not in the set; -1 where there is none."""
        k = bisect_left(self.lasts, place)
        if k == len(self.lasts):
            return self.lasts[-1], -1
        chunk = self.chunks[k]
        at = bisect_left(chunk, place)
        return chunk[at - 1] if at else self.lasts[k - 1] if k else -1, chunk[at]

    def add(self, place: int) -> None:
        self.size += 1
        k = min(bisect_left(self.lasts, place), len(self.lasts) - 1)
        chunk = self.chunks[k]
        insort(chunk, place)
        if len(chunk) > CHUNK:
            half = len(chunk) // 2
            self.chunks[k : k + 1] = [chunk[:half], chunk[half:]]
            self.lasts[k : k + 1] = [chunk[half - 1], chunk[-1]]
        else:
            self.lasts[k] = chunk[-1]


def seeds(edges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pairs of places that become neighbours in their class, with what they share.

    ``edges`` are neighbouring suffixes ``a, b, shared``, by decreasing ``shared``. Classes are united
    smaller into larger; the two places of a new pair were in different classes, so
    that the edge's length is all they share.
    """
    parent: dict[int, int] = {}
    places: dict[int, Places] = {}
    found = []

    def root(i: int) -> int:
        while (up := parent[i]) != i:
            parent[i] = i = parent[up]
        return i

    for a, b, shared in edges:
        for x in (a, b):
            if x not in parent:
                parent[x] = x
                places[x] = Places(x)
        into, other = root(a), root(b)
        if places[into].size < places[other].size:
            into, other = other, into
        large, small = places[into], list(places.pop(other))
        parent[other] = into
        for k, x in enumerate(small):
            left, right = large.around(x)
            if left >= 0 and 3 * (x - left) <= shared and (not k or small[k - 1] < left):
                found.append((left, x, shared))
            if right >= 0 and 3 * (right - x) <= shared and (k + 1 == len(small) or right < small[k + 1]):
                found.append((x, right, shared))
        for x in small:
            large.add(x)
    return found


def runs_of(ids: np.ndarray, base: np.ndarray) -> np.ndarray:
    """``start, length, period`` of all runs, by start and period; starts count over all texts.

    ``ids`` are the words of texts laid end to end, from 1 on; ``base`` is where each text begins, and the end.

    Suffixes are ranked by 1, 2, 4, ... words, each time only those that still share
    a rank. Neighbours in the last order and what they share are the edges that
    unite classes; a run of period q and length n is found by its first two places q apart, which
    share n - q words and have no other place of their class between them.
    """
    none = np.zeros((0, 3), np.int64)
    n = len(ids)
    text = np.repeat(np.arange(len(base) - 1), np.diff(base))
    ends = base[1:][text]
    # The rank of a class is the number of suffixes before it, so that classes can be split in place.
    _, which, counts = np.unique(text << 32 | ids, return_inverse=True, return_counts=True)
    ranks = [(np.cumsum(counts) - counts)[which]]
    span = 1
    while True:
        rank = ranks[-1]
        open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(open_):
            break
        next_ = open_ + span
        second = np.where(next_ < ends[open_], rank[np.minimum(next_, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[open_]))
        moved, first, second = open_[by], rank[open_][by], second[by]
        at = np.arange(len(by))
        new = np.r_[True, first[1:] != first[:-1]]
        class_start = np.maximum.accumulate(np.where(new, at, 0))
        new[1:] |= second[1:] != second[:-1]
        rank = rank.copy()
        rank[moved] = first + np.maximum.accumulate(np.where(new, at, 0)) - class_start
        ranks.append(rank)
        span *= 2
    order = np.argsort(ranks[-1])
    a, b = order[:-1], order[1:]
    near = ranks[0][a] == ranks[0][b]
    a, b = a[near], b[near]
    shared = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        i, j = a + shared, b + shared
        both = np.flatnonzero((i < ends[a]) & (j < ends[b]))
        same = both[ranks[k][i[both]] == ranks[k][j[both]]]
        # Suffixes that end within the span have no equal.
        shared[same] += 1 << k
    keep = shared >= SHARED
    # Classes by the least shared length, and of them those with places near enough for some run.
    joined = np.cumsum(~(keep & np.r_[False, b[:-1] == a[1:]][: len(a)]))
    a, b, shared, group = a[keep], b[keep], shared[keep], joined[keep]
    if not len(a):
        return none
    place, of = np.r_[a, b], np.r_[group, group]
    by = np.lexsort((place, of))
    place, of = place[by], of[by]
    gap = np.where((of[1:] == of[:-1]) & (place[1:] > place[:-1]), place[1:] - place[:-1], n)
    least = np.full(int(of.max()) + 1, n)
    np.minimum.at(least, of[1:], gap)
    most = np.zeros(len(least), np.int64)
    np.maximum.at(most, group, shared)
    some = np.flatnonzero((3 * least <= most)[group])
    some = some[np.argsort(-shared[some], kind="stable")]
    pairs = seeds(list(zip(a[some].tolist(), b[some].tolist(), shared[some].tolist())))
    if not pairs:
        return none
    i, j, shared = np.array(pairs, np.int64).T
    period, length = j - i, j - i + shared
    first = (i == base[text[i]]) | (ids[i - 1] != ids[j - 1])
    keep = first & (length >= np.maximum(WORDS, TIMES * period))
    runs = np.c_[i, length, period][keep]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def may_repeat(hashes: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Which texts have the same few words twice; only they can have a run."""
    grams = gram_hashes(hashes, SHARED)
    text = np.repeat(np.arange(len(base) - 1), np.diff(base))
    inside = np.flatnonzero(text[: len(grams)] == text[SHARED - 1 :]) if len(grams) else np.zeros(0, np.int64)
    found = grams[inside] + text[inside].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    by = np.argsort(found)
    again = inside[by[1:]][found[by[1:]] == found[by[:-1]]]
    flags = np.zeros(len(base) - 1, bool)
    flags[text[again]] = True
    return flags


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, runs, kept_text``.

    Words are what stands between the six ASCII white-space characters. A run is a
    stretch of at least 6 words and 4 times its smallest period that no
    neighbouring word extends; ``runs`` lists ``start, length, period`` in words, by start
    and period. ``kept_text`` has the words that no run contains after its first period,
    joined by one space.

    Everything happens inside a document, without a shuffle; texts are taken up
    by the megabyte, a longer one alone. Null texts count as empty and have no run.
    Ids are handed through, null and repeated ones too. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType(
        [
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(run)),
            T.StructField("kept_text", T.BinaryType()),
        ]
    )

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, size=SLICE):
            texts = batch["text"].to_pylist()
            picked = np.flatnonzero(may_repeat(*hashed_words(texts))).tolist()
            words = {k: texts[k].split() for k in picked}
            names: dict[bytes, int] = {}
            ids = np.array([names.setdefault(w, len(names) + 1) for k in picked for w in words[k]], np.int64)
            base = np.cumsum([0, *(len(words[k]) for k in picked)])
            names.clear()
            found = runs_of(ids, base) if picked else np.zeros((0, 3), np.int64)
            of = np.searchsorted(base, found[:, 0], side="right") - 1
            bounds = np.searchsorted(of, np.arange(len(picked) + 1))
            sizes, lists, kept = [], [], []
            number = dict(zip(picked, range(len(picked))))
            for k, raw in enumerate(texts):
                own, mine = raw.split() if k not in words else words.pop(k), ()
                if k in number:
                    m = number[k]
                    mine = found[bounds[m] : bounds[m + 1]] - [base[m], 0, 0]
                sizes.append(len(own))
                lists.append([{"start": s, "length": n, "period": q} for s, n, q in mine.tolist()] if len(mine) else [])
                if len(mine):
                    change = np.zeros(len(own) + 1, np.int64)
                    np.add.at(change, mine[:, 0] + mine[:, 2], 1)
                    np.add.at(change, mine[:, 0] + mine[:, 1], -1)
                    own = [own[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                kept.append(b" ".join(own))
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            arrays = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(lists, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(collapse, schema)
