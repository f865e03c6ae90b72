"""Quality rules and a hashed n-gram log-likelihood ratio, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.once import compute_once
from corpusloom.llm import hashed
from corpusloom.llm.common import SPACE_CLASS, text_or_empty, words
from corpusloom.operators.sizing import broadcast_if_small
from corpusloom.session import cut_lineage

# The marks counted as symbols, the window of repeated words, and the base rules' limits.
SYMBOL_CLASS = "[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

SMOOTHING = 0.5
TRUSTED_LOSS = 0.005
STEP = 0.001


def _windows(w: Column, value) -> Column:
    """One value per window of words; none for fewer words."""
    n = F.size(w)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: value(F.slice(w, i + 1, F.lit(WINDOW)), i))


def _covered(w: Column) -> Column:
    """Words in windows whose text comes twice: sort the windows, keep those equal to a neighbour, add up what each start adds."""
    ordered = F.sort_array(_windows(w, lambda part, i: F.struct(F.array_join(part, " ").alias("t"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (x["t"] == F.get(s, k - 1)["t"]) | F.coalesce(x["t"] == F.get(s, k + 1)["t"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    starts = F.flatten(F.transform(F.array(ordered), repeated))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(
        starts,
        zero,
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )


def base_columns(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of the text in a non-null column.

    Everything is counted inside a row. Windows are hashed first; only texts with
    equal hashes have their windows sorted by their words.
    """
    c = F.col(text)
    columns = docs.columns if keep is None else keep
    split = compute_once(
        docs,
        [*columns, text] if text not in columns else columns,
        _words=words(c),
        _lines=F.filter(F.split(c, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        n_symbols=F.regexp_count(c, F.lit(SYMBOL_CLASS)).cast("long"),
    )
    counted = compute_once(
        split,
        n_words=F.size("_words").cast("long"),
        word_chars=F.char_length(F.array_join("_words", "")).cast("long"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        _hashes=_windows(F.col("_words"), lambda part, i: F.xxhash64(part)),
    )
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    return compute_once(counted, n_repeat_words=F.when(again, _covered(F.col("_words"))).otherwise(0).cast("long")).drop(
        "_words", "_lines", "_hashes"
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def ratio_table(docs: DataFrame, trusted: DataFrame, grams: int = 2, buckets: int = hashed.BUCKETS) -> DataFrame:
    """``bucket, llr``: how much likelier a bucket is in trusted texts than in the raw corpus, both smoothed.

    ``docs`` has ``doc_id, text``; ``trusted`` has distinct ids. A task adds its
    n-grams up per bucket before the shuffle.
    """
    marked = docs.join(broadcast_if_small(trusted.withColumn("_trusted", F.lit(1))), "doc_id", "left")
    tokens = compute_once(marked, ["_trusted"], _tokens=hashed.token_array(F.col("text")))
    exploded = tokens.select(F.explode(hashed.buckets_of(F.col("_tokens"), grams, buckets)).alias("bucket"), "_trusted")
    counts = cut_lineage(exploded.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_trusted").alias("target")))
    raw, target = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0))).first()

    def share(c: str, total: int) -> Column:
        return (F.col(c) + SMOOTHING) / (total + SMOOTHING * buckets)

    return counts.select("bucket", F.log(share("target", target) / share("raw", raw)).alias("llr"))


def quality_verdicts(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    grams: int = 2,
    buckets: int = hashed.BUCKETS,
    trusted_loss: float = TRUSTED_LOSS,
    threshold: float | None = None,
) -> DataFrame:
    """One row per document: ``doc_id``, the base counts, ``base_failed``, ``llr``, ``threshold``, ``kept``.

    ``llr`` is the mean, over a text's hashed single tokens and pairs, of the
    log ratio of their smoothed probabilities in the texts of ``trusted`` ids and
    in all texts. A text is kept if no base rule fails and its mean reaches the
    threshold. If none is given it is the largest multiple of 0.001 that at most
    ``trusted_loss`` of the trusted texts stay below.

    Null texts count as empty, have a mean of zero and fail the base rules.
    Without trusted texts every ratio and the threshold are zero. Rows that
    repeat an id are judged each by its own text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    known = cut_lineage(trusted.select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct())
    table = cut_lineage(ratio_table(rows, known, grams, buckets))
    have = not known.isEmpty()
    values = hashed.dense(spark, table, F.coalesce("llr", F.lit(0.0)) if have else F.lit(0.0), buckets)

    based = base_columns(rows)
    tokens = compute_once(based, [c for c in based.columns if c != "text"], _tokens=hashed.token_array(F.col("text")))
    found = compute_once(tokens, [c for c in tokens.columns if c != "_tokens"], _grams=hashed.buckets_of(F.col("_tokens"), grams, buckets))
    n = F.size("_grams")
    summed = hashed.with_sums(found, "_grams", {"_sum": values})
    llr = F.when(n > 0, F.col("_sum") / n).otherwise(0.0)
    scored = cut_lineage(summed.withColumn("llr", llr).drop("_grams", "_sum"))

    if threshold is None:
        threshold = _quantile(scored.join(broadcast_if_small(known), "doc_id", "left_semi"), trusted_loss)
    return scored.select(
        "*",
        base_failed().alias("base_failed"),
        F.lit(threshold).alias("threshold"),
        (~base_failed() & (F.col("llr") >= threshold)).alias("kept"),
    )


def _quantile(scores: DataFrame, share: float) -> float:
    """The largest step that at most ``share`` of the scores lie below, from a histogram of fixed resolution."""
    steps = scores.groupBy(F.floor(F.col("llr") / STEP).alias("k")).agg(F.count("*").alias("n")).orderBy("k").collect()
    total, below = sum(r.n for r in steps), 0
    for r in steps:
        if below + r.n > share * total:
            return r.k * STEP
        below += r.n
    return 0.0
