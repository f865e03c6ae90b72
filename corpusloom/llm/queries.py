"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.once import compute_once
from corpusloom.llm import conversation_trie, exact_dedup, language, mixing, packing, periodic_runs, ppm, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup, token_files
from corpusloom.llm.common import SPACE_CLASS, id_remainder, text_or_empty
from corpusloom.session import cut_lineage
from corpusloom.sources.tables import table

QUALITY_THRESHOLD = 0.3

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


@register
def op2_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf, "documents"), keep="largest")
    return found.drop("copies_of_kept")


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL["op2_exact_dedup"] = f"""
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256({LOWERED}) as text_sha256
from documents window g as (partition by {LOWERED})
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register
def op3_token_files(spark: SparkSession, sf: str) -> DataFrame:
    blocks = token_files.token_blocks(table(spark, sf, "documents"), tokenizer_path(), end_id=2)
    read = token_files.read_documents(cut_lineage(blocks, "zstd"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register
def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf, "documents"), tokenizer_path(), end_id=0)
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


@register
def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register
def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    held_out = id_remainder("doc_id", 5) == 0
    scores = quality_classifier.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"), ~held_out)
    predicted = (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted")
    return scores.select("doc_id", held_out.alias("held_out"), "score", predicted)


@register
def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    trusted = table(spark, sf, "labels").where("quality = 1")
    found = quality_rules.quality_verdicts(table(spark, sf, "documents"), trusted)
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr", "threshold"
    )


def domain_labels(labels: DataFrame) -> DataFrame:
    """Labelled documents as one of three domains."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))


# Wanted shares of the tokens. Clean text is the anchor: it stays whole, and the others are thinned to fit.
MIXTURE = {"clean": 0.93, "low": 0.05, "toxic": 0.02}
MIX = {"weights": MIXTURE, "anchor": "clean", "most_copies": 1}


@register
def op1_mixing(spark: SparkSession, sf: str) -> DataFrame:
    labels = domain_labels(table(spark, sf, "labels"))
    found = mixing.mixed(table(spark, sf, "documents"), labels, **MIX)
    shares = [F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(sorted(MIXTURE))]
    return found.select("doc_id", "n_tokens", *shares, "rate", "copies")


@register
def op7_language(spark: SparkSession, sf: str) -> DataFrame:
    held_out = id_remainder("doc_id", 4) == 2
    found = language.identify(table(spark, sf, "documents"), ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register
def op5_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    found = ppm.text_scores(table(spark, sf, "documents"), id_remainder("doc_id", 10) != 0)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@register
def op6_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


@register
def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    base = F.expr("conv_id - conv_id % 5")
    turns = conversation_trie.rebuilt_turns(table(spark, sf, "conversations"), base, id_remainder("conv_id", 9))
    return conversation_trie.prefix_trie(*turns).drop("node", "parent")


# The checksum of ids, bit by bit. The number is the fixed polynomial of CRC-32.
CRC_OF_ID = """xor(list_reduce(
  list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint),
  lambda c, b: list_reduce(range(8), lambda d, i: case when d % 2 = 1 then xor(d // 2, 3988292384) else d // 2 end, xor(c, b)),
  4294967295::bigint), 4294967295)"""
SQL["op11_prefix_trie"] = f"""
with turns as (
  select conv_id, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') as item, strlen(coalesce(text, '')) as octets,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null),
convs as (select conv_id, {CRC_OF_ID} % 9 as h from (select distinct conv_id from turns)),
rebuilt as (
  select c.conv_id, 0 as own, pos, item, octets from convs c join turns t on t.conv_id = c.conv_id - c.conv_id % 5 and pos < h
  union all select c.conv_id, 1, pos, item, octets from convs c join turns t on t.conv_id = c.conv_id and pos >= h),
lists as (
  select c.conv_id, coalesce(list(item order by own, pos) filter (item is not null), []) as items,
         coalesce(list(octets order by own, pos) filter (item is not null), []) as sizes
  from convs c left join rebuilt r on r.conv_id = c.conv_id group by c.conv_id),
prefixes as (
  select conv_id, d as depth, items[1:d] as key, coalesce(sizes[d], 0) as octets, d = len(items) as ends
  from (select *, unnest(range(0, len(items) + 1)) as d from lists)),
nodes as (
  select key, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(octets) as octets,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from prefixes group by key),
children as (select key[1:depth - 1] as key, count(*) as n_children from nodes where depth > 0 group by 1),
valued as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join children c on c.key = n.key),
totals as (
  select key[1:e] as key, sum(case when n_children = 0 then 1 else 0 end)::bigint as n_leaves, sum((n_convs - 1) * octets)::bigint as saved_tokens
  from (select *, unnest(range(0, depth + 1)) as e from valued) group by 1)
select v.conv_id, v.depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
from valued v join totals t on t.key = v.key left join nodes p on v.depth > 0 and p.key = v.key[1:v.depth - 1]
"""


@register
def op12_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = substring_dedup.remove_passages(table(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op12_substring_dedup"] = r"""
with texts as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
starts as (select doc_id, unnest(range(0, len(words) - 12)) as s, words from texts where len(words) >= 13),
windows as (select doc_id, s, array_to_string(words[s + 1:s + 13], ' ') as w from starts),
firsts as (select w, min(doc_id) as first_id from windows group by w),
gone as (select distinct doc_id, unnest(range(s, s + 13)) as i from windows join firsts using (w) where first_id < doc_id),
lists as (select doc_id, list(i) as places from gone group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(len(places), 0)::bigint as n_removed,
       sha256(array_to_string(case when places is null then words else
         (select coalesce(list(words[i + 1] order by i), []) from unnest(range(0, len(words))) u(i) where not list_contains(places, i)) end, ' ')) as kept_sha256
from texts left join lists using (doc_id)
"""


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, in which every tenth document by its id's checksum goes on repeating a stretch of its words.

    Null ids are left as they are.
    """
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = text_or_empty("text")
    split = F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")
    rows = docs.select("doc_id", text.alias("text"), checksum.alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, split.cast("array<string>")).otherwise(F.array().cast("array<string>")))
    rows = compute_once(rows, words=F.col("words"))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).otherwise(F.lit(0)))
    rows = rows.withColumn("p", F.lit(1) + F.expr("(n - a) div (3 + g % 8)"))
    tail = F.expr("slice(flatten(array_repeat(slice(words, int(a + 1), int(p)), int((n - a) div p + 1))), 1, int(n - a))")
    changed = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a").cast("int")), tail)
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


@register
def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic_runs.collapse_runs(with_repeated_tails(table(spark, sf, "documents")))
    best = F.element_at(
        F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period")))), 1
    )
    best = F.when(F.size("runs") > 0, best)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length = -F.col("best.shorter")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-1000 * best.shorter div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )
