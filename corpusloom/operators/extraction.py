"""Prompts for a text model and strict reading of what it returns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as tx
from corpusloom.functions.once import compute_once

EXTRACTION_RULES = (
    "Read the text and list the entities it names and how they relate. "
    'Answer with one JSON object and nothing else. Its key "entities" holds objects with '
    '"name", "type" and a short "description"; its key "relations" holds objects with '
    '"source", "target" (both entity names) and "type" in snake_case.'
)
ANSWER_RULES = (
    "Answer from the given context alone, and say so when it holds no answer. "
    "Write concise, well-structured Markdown in the language of the question."
)
# The frame of the two user messages.
EXTRACT_FROM = "Extract from:\n\n"
DOCUMENT_CONTEXT = "Context from documents:\n"
GRAPH_CONTEXT = "\n\nKnowledge graph context:\n"
NO_GRAPH = "No graph context available."
QUESTION = "\n\nQuestion: "
ANSWER = "\n\nAnswer based on the above context:"

ENTITIES = "array<struct<name:string,type:string,description:string>>"
RELATIONS = "array<struct<source:string,target:string,type:string>>"


def messages(system: str, user: Column) -> Column:
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def extraction_prompts(blocks: DataFrame, block: str = "block") -> DataFrame:
    """Add the message list that asks for the entities of a block."""
    return blocks.withColumn(
        "messages", messages(EXTRACTION_RULES, F.concat(F.lit(EXTRACT_FROM), F.col(block)))
    )


def answer_content(question: Column, context: Column, graph: Column) -> Column:
    return F.concat(
        F.lit(DOCUMENT_CONTEXT),
        context,
        F.lit(GRAPH_CONTEXT),
        F.coalesce(F.nullif(graph, F.lit("")), F.lit(NO_GRAPH)),
        F.lit(QUESTION),
        question,
        F.lit(ANSWER),
    )


def answer_prompts(rows: DataFrame, question: str = "query", context: str = "context_text", graph: str = "graph_summary") -> DataFrame:
    return rows.withColumn(
        "messages", messages(ANSWER_RULES, answer_content(F.col(question), F.col(context), F.col(graph)))
    )


def user_content(message_list: Column) -> Column:
    """Content of the first user message, or an empty text."""
    users = F.filter(message_list, lambda m: m["role"] == "user")
    return F.coalesce(F.get(users, F.lit(0))["content"], F.lit(""))


def token_usage(rows: DataFrame, group: list[str], prompt: str = "content", response: str | None = None) -> DataFrame:
    """Approximate input, output and total tokens per group."""
    given = tx.approx_tokens(F.col(prompt))
    made = tx.approx_tokens(F.coalesce(F.col(response), F.lit(""))) if response else F.lit(0).cast("long")
    return rows.groupBy(*group).agg(
        F.count("*").alias("calls"),
        F.sum(given).alias("input_tokens"),
        F.sum(made).alias("output_tokens"),
        F.sum(given + made).alias("total_tokens"),
        F.max(given).alias("largest_input"),
    )


def apply_model(
    df: DataFrame,
    loader: Callable[[], Callable[[list], list[str]]],
    prompt: str = "messages",
    response: str = "response",
    error: str = "error",
    batch_rows: int = 64,
) -> DataFrame:
    """Run a user's batch callable over prompts; a failing batch is retried row
    by row and a failing row gets an ``error`` instead of a response."""
    schema = T.StructType(
        df.schema.fields + [T.StructField(response, T.StringType()), T.StructField(error, T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loader()

        def one(p):
            try:
                return str(model([p])[0]), None
            except Exception as e:  # the row reports what went wrong
                return None, f"{type(e).__name__}: {e}"

        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(at, batch_rows)
                prompts = batch.column(prompt).to_pylist()
                try:
                    pairs = [(str(r), None) for r in model(prompts)]
                    if len(pairs) != len(prompts):
                        raise ValueError("one response per prompt is needed")
                except Exception:
                    pairs = [one(p) for p in prompts]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns,
                        pa.array([r for r, _ in pairs], pa.string()),
                        pa.array([e for _, e in pairs], pa.string()),
                    ],
                    names=[*batch.schema.names, response, error],
                )

    return df.mapInArrow(run, schema)


# ------------------------------------------------------------------ parsing


def _fenced(response: Column) -> Column:
    """Text between the first two code fences of a response that begins with one."""
    bare = tx.strip(response)
    inner = F.get(F.split(bare, "```"), F.lit(1))
    trimmed = tx.strip(inner)
    body = F.when(F.lower(trimmed).startswith("json"), F.substring(trimmed, 5, 1 << 30)).otherwise(inner)
    return F.when(bare.startswith("```"), body)


def _kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def _all_strings(value: Column, names: tuple[str, ...]) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & F.coalesce(_kind(value, f"$.{n}") == "STRING", F.lit(False))
    return ok


def _has_keys(value: Column, names: tuple[str, ...]) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & F.try_variant_get(value, f"$.{n}", "variant").isNotNull()
    return ok


def _texts(value: Column, names: tuple[str, ...]) -> Column:
    return F.struct(*[F.try_variant_get(value, f"$.{n}", "string").alias(n) for n in names])


ENTITY_KEYS = ("name", "type", "description")
RELATION_KEYS = ("source", "target", "type")


def _sealed(text: str) -> Column:
    """The text as the first of two array elements, the other its hash.

    The JSON reader stops after the first value and would let a remainder
    pass; a remainder keeps the hash from being the second element.
    """
    c = F.col(text)
    return F.try_parse_json(F.concat(F.lit("["), c, F.lit(',"'), F.sha1(F.encode(c, "UTF-8")), F.lit('"]')))


def _unsealed(sealed: str, text: str) -> Column:
    whole = F.try_variant_get(sealed, "$[1]", "string") == F.sha1(F.encode(F.col(text), "UTF-8"))
    return F.when(whole, F.try_variant_get(sealed, "$[0]", "variant"))


def parse_extractions(df: DataFrame, response: str = "response") -> DataFrame:
    """Responses to ``entities`` and ``relations`` arrays.

    All or nothing: a response that is no JSON object, misses a key, or holds
    an entity or a complete relation with a field that is not a string gives
    two empty arrays. Only relations that lack a key are dropped one by one.
    ``valid`` tells an empty result from a rejected one and ``dropped`` counts
    the malformed relations. An object that repeats a key counts as no JSON.
    """
    text = F.coalesce(F.col(response), F.lit(""))
    braces = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    texts = compute_once(df, df.columns, _outer=braces, _inner=_fenced(text))
    read = compute_once(texts, [*df.columns, "_outer", "_inner"], _a=_sealed("_outer"), _b=_sealed("_inner"))
    one = compute_once(read, df.columns, _root=F.coalesce(_unsealed("_a", "_outer"), _unsealed("_b", "_inner")))

    v = F.col("_root")
    relations_kind = _kind(v, "$.relations")
    as_list = F.try_variant_get(v, "$.relations", "array<variant>")
    # A text or an object in place of the list has no well-formed relation.
    listed = F.when(relations_kind.startswith("ARRAY"), as_list).when(
        relations_kind.startswith("OBJECT") | (relations_kind == "STRING"), F.expr("cast(array() as array<variant>)")
    )
    entities = F.when(
        _kind(v, "$.entities").startswith("ARRAY"), F.try_variant_get(v, "$.entities", "array<variant>")
    )
    two = compute_once(one, df.columns, _entities=entities, _listed=listed)

    kept = F.filter(F.col("_listed"), lambda r: _has_keys(r, RELATION_KEYS))
    three = compute_once(
        two,
        df.columns,
        _entities=F.col("_entities"),
        _kept=kept,
        _seen=F.coalesce(F.size("_listed"), F.lit(0)),
    )
    valid = F.coalesce(
        F.forall("_entities", lambda e: _all_strings(e, ENTITY_KEYS))
        & F.forall("_kept", lambda r: _all_strings(r, RELATION_KEYS)),
        F.lit(False),
    )
    four = three.withColumn("valid", valid)
    return four.select(
        *df.columns,
        F.when(F.col("valid"), F.transform("_entities", lambda e: _texts(e, ENTITY_KEYS)))
        .otherwise(F.expr(f"cast(array() as {ENTITIES})"))
        .alias("entities"),
        F.when(F.col("valid"), F.transform("_kept", lambda r: _texts(r, RELATION_KEYS)))
        .otherwise(F.expr(f"cast(array() as {RELATIONS})"))
        .alias("relations"),
        "valid",
        F.greatest(F.col("_seen") - F.coalesce(F.size("_kept"), F.lit(0)), F.lit(0)).alias("dropped"),
    )


def key_list(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def extracted_entities(parsed: DataFrame, key: str | list[str] = "block_id") -> DataFrame:
    keys = key_list(key)
    return parsed.select(*keys, F.posexplode("entities").alias("pos", "e")).select(*keys, "pos", "e.*")


def extracted_relations(parsed: DataFrame, key: str | list[str] = "block_id") -> DataFrame:
    keys = key_list(key)
    return parsed.select(*keys, F.posexplode("relations").alias("pos", "r")).select(*keys, "pos", "r.*")
