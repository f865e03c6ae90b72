"""The entity graph as node and edge tables.

``entities(entity_id, name, type, description, embedding)`` and
``relations(source_id, target_id, type, seq)``; ``seq`` is the unique arrival
order of an edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import similarity as sim
from corpusloom.operators.extraction import key_list
from corpusloom.operators.sizing import broadcast_if_small, join_unique
from corpusloom.session import cut_lineage

ENTRY_LIMIT = 3
ENTRY_THRESHOLD = 0.75
EDGE = ["source_id", "target_id", "type"]


# --------------------------------------------------------------- relations


def name_map(mentions: DataFrame, block: str | list[str] = "block_id") -> DataFrame:
    """Entity id per block and name; a repeated name means its last mention."""
    return mentions.groupBy(*key_list(block), "name").agg(F.max_by("entity_id", "pos").alias("entity_id"))


def resolve_relations(relations: DataFrame, mentions: DataFrame, block: str | list[str] = "block_id") -> DataFrame:
    """Relations by name to relations by id, within their block.

    ``block`` names the column or columns of a block. Relations that name
    something the block has no entity for are left out.
    """
    keys, names = key_list(block), name_map(mentions, block)
    source = names.select(*keys, F.col("name").alias("source"), F.col("entity_id").alias("source_id"))
    target = names.select(*keys, F.col("name").alias("target"), F.col("entity_id").alias("target_id"))
    return relations.join(source, [*keys, "source"]).join(target, [*keys, "target"])


def unresolved_relations(relations: DataFrame, mentions: DataFrame, block: str | list[str] = "block_id") -> DataFrame:
    """What :func:`resolve_relations` leaves out, with the missing end."""
    keys = key_list(block)
    names = name_map(mentions, block).select(*keys, "name", F.lit(True).alias("known"))
    source = names.select(*keys, F.col("name").alias("source"), F.col("known").alias("source_known"))
    target = names.select(*keys, F.col("name").alias("target"), F.col("known").alias("target_known"))
    return (
        relations.join(source, [*keys, "source"], "left")
        .join(target, [*keys, "target"], "left")
        .withColumn("source_known", F.coalesce("source_known", F.lit(False)))
        .withColumn("target_known", F.coalesce("target_known", F.lit(False)))
        .where(~(F.col("source_known") & F.col("target_known")))
    )


def without_self_loops(relations: DataFrame) -> DataFrame:
    return relations.where(F.col("source_id") != F.col("target_id"))


def with_stored_source(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Keep relations whose source is stored; the target is not looked at."""
    return relations.join(entities.select(F.col("entity_id").alias("source_id")), "source_id", "left_semi")


def first_edges(relations: DataFrame, seq: str = "seq") -> DataFrame:
    """Each edge once, with its first arrival; copies collapse before the shuffle."""
    return relations.groupBy(*EDGE).agg(F.min(seq).alias(seq))


def edge_union(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.select(*EDGE).unionByName(new.select(*EDGE)).dropDuplicates(EDGE)


def new_edges(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that are not stored yet."""
    return candidates.join(existing.select(*EDGE), EDGE, "left_anti")


def edge_positions(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """Position of every edge among those of its source, in arrival order.

    The edges are range-partitioned by source and order, so a source with very
    many edges spans several partitions. Each is ranked on its own and shifted
    by the edges of that source in the partitions before. The partition numbers
    are materialised, as they must be the same in both uses.
    """
    placed = cut_lineage(
        edges.repartitionByRange("source_id", seq).withColumn("_part", F.spark_partition_id())
    )
    sizes = placed.groupBy("source_id", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("source_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("source_id", "_part").orderBy(seq))
    return (
        placed.withColumn("_rank", inside)
        .join(shifts, ["source_id", "_part"])
        .withColumn("position", (F.col("_shift") + F.col("_rank") - 1).cast("long"))
        .drop("_part", "_rank", "_shift")
    )


def adjacency(relations: DataFrame, seq: str = "seq") -> DataFrame:
    """Deduplicated outgoing edges with their place in first-seen order.

    One row per edge: the list of a hub is never built in one task.
    """
    return edge_positions(first_edges(relations, seq), seq).select("source_id", "position", "target_id", "type")


# ------------------------------------------------------------------ lookups


def lookup(ids: DataFrame, entities: DataFrame) -> DataFrame:
    """Payload per asked id, null where it is not stored."""
    return ids.join(entities, "entity_id", "left")


def update_payload(entities: DataFrame, updates: DataFrame) -> DataFrame:
    """Set the given columns of existing entities; nulls leave a value as is."""
    columns = [c for c in updates.columns if c != "entity_id"]
    renamed = updates.select("entity_id", *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = entities.join(renamed, "entity_id", "left")
    return joined.select(
        *[
            F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
            for c in entities.columns
        ]
    )


def one_hop(relations: DataFrame, entries: DataFrame, entities: DataFrame) -> DataFrame:
    """Outgoing edges of entry entities with the name of the target.

    ``entries`` carries ``source_id``; edges to targets not stored are skipped.
    """
    targets = entities.select(F.col("entity_id").alias("target_id"), F.col("name").alias("target_name"))
    texts = [c for c, kind in entries.dtypes if kind == "string"]
    near = relations.join(broadcast_if_small(entries, texts), "source_id")
    return join_unique(near, targets, "target_id", ["source_id"], ["target_id", "target_name"])


# ------------------------------------------------------------------ context


def entity_line(name: Column, type_: Column, description: Column) -> Column:
    return F.format_string("Entity: %s (%s) - %s", name, type_, description)


def relation_line(type_: Column, target_name: Column) -> Column:
    return F.format_string("  - %s -> %s", type_, target_name)


def entry_points(
    queries: DataFrame,
    entities: DataFrame,
    k: int = ENTRY_LIMIT,
    threshold: float = ENTRY_THRESHOLD,
    limits: sim.Limits = sim.Limits(),
) -> DataFrame:
    return sim.topk(queries, entities, k, threshold, corpus_id="entity_id", limits=limits)


def context_lines(entries: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of the context: ``query_id, rank, seq, line``.

    ``entries(query_id, rank, entity_id)``; the line of the entity itself has
    ``seq`` -1 and its edges follow in first-seen order. The few entries, if
    they are few, are sent to the graph and not the graph to them.
    """
    once = cut_lineage(entries.groupBy("query_id", "entity_id").agg(F.min("rank").alias("rank")))
    asked = broadcast_if_small(once, ["entity_id"])
    heads = entities.select("entity_id", "name", "type", "description").join(asked, "entity_id").select(
        "query_id",
        "rank",
        F.lit(-1).cast("long").alias("seq"),
        entity_line(F.col("name"), F.col("type"), F.col("description")).alias("line"),
    )
    wanted = asked.select(F.col("entity_id").alias("source_id")).distinct()
    near = first_edges(edges.join(broadcast_if_small(wanted, ["source_id"]), "source_id", "left_semi"))
    hops = one_hop(near, once.select("query_id", "rank", F.col("entity_id").alias("source_id")), entities)
    lines = hops.select(
        "query_id", "rank", "seq", relation_line(F.col("type"), F.col("target_name")).alias("line")
    )
    return heads.unionByName(lines)


def graph_context(queries: DataFrame, entries: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id, graph_summary``; an empty text where nothing was found.

    The summary is one text per query by nature; :func:`context_lines` has
    the same content as rows.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", "seq", "line")))
    text = (
        context_lines(entries, entities, edges)
        .groupBy("query_id")
        .agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("graph_summary"))
    )
    return (
        queries.select("query_id")
        .join(text, "query_id", "left")
        .withColumn("graph_summary", F.coalesce("graph_summary", F.lit("")))
    )
