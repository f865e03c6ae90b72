"""Language identification as a mixture: proportions by expectation-maximisation over a text's words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import BATCH_BYTES, text_slices
from corpusloom.session import cut_lineage

UNKNOWN = "und"
GRAM = 4
BUCKETS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 15
# Sets of up to so many languages are always fitted; larger ones while they may still win.
MOST_LANGUAGES = 3
# Languages a model may hold: with it the size of a model is bounded.
MOST_KNOWN = 256
# Added to every language's chance of a word, so that noise in a long text decides nothing alone.
FLOOR = 1e-4
# Words whose grams are looked up at once.
WORD_ROWS = 1 << 15
_LETTER = r"\p{L}"


def gram_places(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of the 4 bytes that begin at each byte, and whether they lie in one text.

    ``text`` holds the bytes of all texts one after the other, ``starts`` where each begins.
    """
    n = len(text) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    code = np.zeros(n, np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | text[k : n + k]
    code = code * np.uint32(2654435761)
    whole = np.ones(n, bool)
    for s in starts[1:]:
        whole[max(0, s - GRAM + 1) : s] = False
    return (code >> np.uint32(16)).astype(np.int64), whole


def lowered_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts, lower-cased and with a space on either side, as one byte array, and where each begins."""
    padded = pc.binary_join_element_wise("", pc.utf8_lower(texts.fill_null("")), "", " ")
    padded = pa.concat_arrays([padded]) if isinstance(padded, pa.Array) else padded.combine_chunks()
    offsets = np.frombuffer(padded.buffers()[1], np.int32)[padded.offset : padded.offset + len(padded) + 1]
    data = np.frombuffer(padded.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, (offsets - offsets[0]).astype(np.int64)


def gram_counts(docs: DataFrame, languages: list[str]) -> DataFrame:
    """``language, bucket, n`` over the texts of ``text, lang``: a task hands on one sum per bucket it has met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in text_slices(batches):
            which = pc.index_in(batch["lang"], pa.array(languages, pa.string())).to_numpy(zero_copy_only=False).astype(float)
            data, offsets = lowered_bytes(batch["text"])
            place, whole = gram_places(data, offsets[:-1])
            at = np.flatnonzero(whole)
            key = which[np.searchsorted(offsets, at, side="right") - 1] * BUCKETS + place[at]
            totals += np.bincount(key[~np.isnan(key)].astype(np.int64), minlength=totals.size).reshape(totals.shape)
        language, bucket = np.nonzero(totals)
        arrays = [pa.array(language.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(totals[language, bucket])]
        yield pa.RecordBatch.from_arrays(arrays, names=["language", "bucket", "n"])

    counted = docs.select("text", "lang").mapInArrow(count, "language int, bucket int, n long")
    return counted.groupBy("language", "bucket").agg(F.sum("n").alias("n"))


def proportions(words: np.ndarray, of: np.ndarray, n_docs: int, allowed: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mixture weights per text and the log likelihood of its words under them.

    ``words`` has the likelihood of each word per language, ``of`` the text of
    each word in rising order, ``allowed`` the languages a text may use.
    """
    weights = allowed / allowed.sum(1, keepdims=True)
    starts = np.searchsorted(of, np.arange(n_docs))
    sizes = np.diff(np.r_[starts, len(of)])
    some = sizes > 0

    def per_text(values: np.ndarray) -> np.ndarray:
        out = np.zeros((n_docs, *values.shape[1:]))
        if some.any():
            out[some] = np.add.reduceat(values, starts[some], axis=0)
        return out

    for _ in range(rounds):
        share = words * weights[of]
        share /= share.sum(1, keepdims=True)
        weights = np.where(some[:, None], per_text(share) / np.maximum(sizes, 1)[:, None], weights)
    return weights, per_text(np.log((words * weights[of]).sum(1)))


def choose(words: np.ndarray, of: np.ndarray, n_docs: int, always: int = MOST_LANGUAGES) -> np.ndarray:
    """Weights per text over the set of languages with the best penalised likelihood.

    All languages are fitted first; then the sets of the one, two, ... strongest
    are fitted by themselves. A set's penalty is half a log of the number of words
    for each language beyond the first, as in the Bayesian information criterion.
    Beyond ``always`` languages a text goes on while the last one gained, or the
    likelihood of all languages less the next penalty is still above the best.
    """
    k = words.shape[1]
    full, reach = proportions(words, of, n_docs, np.ones((n_docs, k)))
    order = np.argsort(-full, axis=1, kind="stable")
    # Each text's strongest languages first, so that a set is fitted over its own columns only.
    words = np.take_along_axis(words, order[of], 1)
    penalty = 0.5 * np.log(np.maximum(np.bincount(of, minlength=n_docs), 2))
    best = np.full(n_docs, -np.inf)
    chosen = full.copy()
    open_ = np.arange(n_docs)
    for size in range(1, k + 1):
        weights, likelihood = proportions(np.ascontiguousarray(words[:, :size]), of, len(open_), np.ones((len(open_), size)))
        value = likelihood - (size - 1) * penalty[open_]
        better = value > best[open_]
        won = open_[better]
        chosen[won] = 0
        chosen[won[:, None], order[won, :size]] = weights[better]
        best[won] = value[better]
        if size < always:
            continue
        go_on = better | (reach[open_] - size * penalty[open_] > best[open_])
        if not go_on.any():
            break
        rows = go_on[of]
        words, of, open_ = words[rows], (np.cumsum(go_on) - 1)[of[rows]], open_[go_on]
    return chosen


def word_likelihoods(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Likelihood of each word per language, relative to its best, and the text it is in.

    A word's likelihood multiplies those of the grams that begin in it or at the space before it.
    """
    place, whole = gram_places(data, offsets[:-1])
    place, at = place[whole], np.flatnonzero(whole)
    if not len(at):
        return np.zeros((0, table.shape[1])), np.zeros(0, np.int64)
    space = data[at] <= 32
    first = np.r_[True, space[1:] | (np.diff(np.searchsorted(offsets, at, side="right")) > 0)]
    begins = np.flatnonzero(first)
    of = np.searchsorted(offsets, at[begins], side="right") - 1
    likely = np.empty((len(begins), table.shape[1]))
    for low in range(0, len(begins), WORD_ROWS):
        some = begins[low : low + WORD_ROWS]
        end = begins[low + WORD_ROWS] if low + WORD_ROWS < len(begins) else len(place)
        logs = np.add.reduceat(table[place[some[0] : end]], some - some[0], axis=0)
        likely[low : low + WORD_ROWS] = np.exp(logs - logs.max(1, keepdims=True))
    return likely + FLOOR, of


def identify(
    docs: DataFrame,
    may_learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score, languages``.

    Byte 4-grams of lower-cased texts are counted per language over the rows where
    ``may_learn`` holds and the language is known. A text's language proportions
    are fitted to its words by expectation-maximisation, over the set of languages
    with the best penalised likelihood: ``languages`` maps them to their shares,
    ``lang_pred`` is the largest (the first by name of equal ones) and ``score`` its share.

    Texts that are null or hold no letter are ``und`` with score 0, and so is every
    text if nothing can be learned. Repeated rows are judged alike.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    learn = docs.where(may_learn).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null")
    names = sorted(r.lang for r in learn.select("lang").distinct().limit(MOST_KNOWN + 1).collect())
    if len(names) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} languages")
    schema = T.StructType(
        [
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("languages", T.MapType(T.StringType(), T.DoubleType())),
        ]
    )
    counts = np.zeros((len(names), BUCKETS))
    # At most one number per language and bucket.
    for part in cut_lineage(gram_counts(learn, names)).toArrow().to_batches() if names else []:
        counts[part["language"].to_numpy(), part["bucket"].to_numpy()] = part["n"].to_numpy()
    if not names or not counts.sum():
        nothing = F.lit(None).cast(schema["languages"].dataType)
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), nothing.alias("languages"))
    logs = np.log(counts + SMOOTHING) - np.log(counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    held = docs.sparkSession.sparkContext.broadcast(logs.T.astype(np.float32).copy())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in text_slices(batches, size=BATCH_BYTES // max(4, len(names))):
            lettered = pc.fill_null(pc.match_substring_regex(batch["text"], _LETTER), False).to_numpy(zero_copy_only=False)
            data, offsets = lowered_bytes(batch["text"])
            words, of = word_likelihoods(data, offsets, table)
            weights = choose(words, of, len(batch))
            top = weights.argmax(1)
            shares = [
                {names[k]: float(row[k]) for k in np.flatnonzero(row > 0)} if ok else None
                for row, ok in zip(weights, lettered.tolist())
            ]
            arrays = [
                batch["doc_id"],
                pa.array([names[k] if ok else UNKNOWN for k, ok in zip(top.tolist(), lettered.tolist())], pa.string()),
                pa.array(np.where(lettered, np.clip(weights[np.arange(len(top)), top], 0, 1), 0.0)),
                pa.array(shares, pa.map_(pa.string(), pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.select("doc_id", "text").mapInArrow(judge, schema)
