"""A prefix trie of conversations, with totals rolled up through bands of depth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import running_base, text_or_empty
from corpusloom.operators.sizing import join_unique
from corpusloom.session import cut_lineage

# Height of a band: a node is copied to at most this many ancestors.
BAND = 8
# Turns of one conversation whose running hashes are made together.
BLOCK = 512 * BAND
# Most bytes of joined ids in one row.
CHUNK = 1 << 16


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv_id, pos, item, octets`` and conversations ``conv_id, n``.

    ``pos`` counts from 0 in the order of turn (null first), role and text. Places
    are ranked inside range partitions and shifted by counts, so one conversation
    may hold any share of the rows. ``item`` is the digest of role and text,
    ``octets`` the UTF-8 length of the text.
    """
    role, text = text_or_empty(F.col("role").cast("string")), text_or_empty(F.col("text").cast("string"))
    turn = F.col("turn").alias("turn")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn, role.alias("role"), text.alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    ranged = rows.where("conv_id is not null").repartitionByRange(*order).sortWithinPartitions(*order)
    item = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    part = F.spark_partition_id()
    nth = F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)
    octets = F.octet_length("text").cast("long").alias("octets")
    placed = cut_lineage(ranged.select("conv_id", item.alias("item"), octets, part.alias("part"), nth.alias("nth")))
    base = running_base(placed.groupBy("part").agg(F.count("*").alias("n")), "part", "n")
    rows = placed.join(F.broadcast(base), "part").select("conv_id", "item", "octets", (F.col("base") + F.col("nth")).alias("at"))
    convs = cut_lineage(rows.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    turns = join_unique(rows, convs.select("conv_id", "first"), "conv_id", ["at"])
    return turns.select("conv_id", (F.col("at") - F.col("first")).alias("pos"), "item", "octets"), convs.select("conv_id", "n")


def rebuilt_turns(conversations: DataFrame, base: Column, taken: Column) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations of which each begins with turns of another one.

    A conversation is rebuilt from the first ``taken`` turns of conversation
    ``base`` (both expressions of ``conv_id``; all if it has fewer, none if there is
    no such conversation) and its own turns after its first ``taken``. Returned as
    by :func:`ordered_turns`; ``n`` may be 0.
    """
    turns, convs = ordered_turns(conversations)
    turns = cut_lineage(turns)
    convs = convs.select("conv_id", "n", base.alias("base"), taken.cast("long").alias("taken"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(lengths, "base", "left")
    head = F.least("taken", F.coalesce("base_n", F.lit(0)))
    convs = cut_lineage(convs.select("conv_id", "base", "taken", head.alias("head"), F.greatest(F.col("n") - F.col("taken"), F.lit(0)).alias("own")))
    most = convs.agg(F.coalesce(F.max("taken"), F.lit(0))).first()[0]

    wanted = convs.where("head > 0").select(F.col("conv_id").alias("to"), F.col("base").alias("conv_id"), "head")
    heads = turns.where(F.col("pos") < most).join(wanted, "conv_id").where("pos < head")
    heads = heads.select(F.col("to").alias("conv_id"), "pos", "item", "octets")
    shifts = convs.where("own > 0").select("conv_id", "taken", (F.col("head") - F.col("taken")).alias("shift"))
    tails = join_unique(turns, shifts, "conv_id", ["pos"]).where("pos >= taken")
    tails = tails.select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "item", "octets")
    return heads.unionByName(tails), convs.select("conv_id", (F.col("head") + F.col("own")).alias("n"))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, depth, key, octets, last``: every prefix of every conversation, the empty one too.

    The key of a prefix is the exclusive or of hashes of place and item, 128 bits
    in all; a sum over any part of a conversation can so be made apart.
    """
    depth = F.col("pos") + 1
    rows = turns.select(
        "conv_id", depth.alias("depth"), F.floor(F.col("pos") / BLOCK).alias("block"), "octets",
        *[F.xxhash64(F.lit(i), depth, "item").alias(f"x{i}") for i in (1, 2)],
    )
    sums = rows.groupBy("conv_id", "block").agg(*[F.bit_xor(f"x{i}").alias(f"b{i}") for i in (1, 2)])
    # One row per block of a conversation, and only of those with several.
    long = sums.join(convs.where(F.col("n") > BLOCK).select("conv_id"), "conv_id", "left_semi")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = long.select("conv_id", "block", *[F.bit_xor(f"b{i}").over(before).alias(f"b{i}") for i in (1, 2)])
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(0).cast("long")
    key = [F.bit_xor(f"x{i}").over(so_far).bitwiseXOR(F.coalesce(f"b{i}", none)).alias(f"k{i}") for i in (1, 2)]
    keyed = rows.join(bases, ["conv_id", "block"], "left").select("conv_id", "depth", F.struct(*key).alias("key"), "octets")
    root = F.struct(none.alias("k1"), none.alias("k2")).alias("key")
    roots = convs.select("conv_id", none.alias("depth"), root, none.alias("octets"))
    ends = convs.select("conv_id", F.col("n").alias("depth"), F.lit(True).alias("last"))
    every = keyed.unionByName(roots).join(ends, ["conv_id", "depth"], "left")
    return every.withColumn("last", F.col("last").isNotNull())


def _with_ancestors(rows: DataFrame) -> DataFrame:
    """Add ``up``: the keys above, from the top of the band on; the top of a band has the whole band before.

    ``rows`` are ``conv_id, depth, key`` and more, with every depth from 0 on.
    """
    columns = rows.columns
    inner = rows.where("depth > 0").withColumn("band", F.floor((F.col("depth") - 1) / BAND)).withColumn("top", F.lit(False))
    tops = rows.where(F.col("depth") % BAND == 0).withColumn("band", F.floor(F.col("depth") / BAND)).withColumn("top", F.lit(True))
    above = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    found = inner.unionByName(tops).withColumn("up", F.collect_list("key").over(above)).where("not top")
    none = F.array().cast("array<struct<k1: bigint, k2: bigint>>")
    return found.select(*columns, "up").unionByName(rows.where("depth = 0").withColumn("up", none))


def _rolled_up(levels: list[DataFrame]) -> DataFrame:
    """``key, leaves, saved`` summed over each node's subtree.

    ``levels[0]`` are the nodes ``key, depth, up, leaves, saved``; ``levels[k]`` those at
    every BAND ** k-th depth with ``key, depth, up``, the depth and the keys
    above counted in these steps.

    On the way up every node adds to the top of its band, and the tops form a trie
    that is BAND times as flat. On the way down a node adds to its ancestors inside
    its band only, and the completed total of a band's top adds to those of the
    band before.
    """
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    top = F.when(F.col("depth") % BAND == 0, F.col("key")).otherwise(F.element_at("up", 1))
    for k in range(len(levels)):
        levels[k] = cut_lineage(levels[k])
        totals = levels[k].groupBy(top.alias("key")).agg(*sums)
        if k + 1 < len(levels):
            levels[k + 1] = levels[k + 1].join(totals, "key")
    totals = cut_lineage(totals)
    for nodes in reversed(levels):
        to = F.when(F.col("depth") % BAND == 0, F.array("key")).otherwise(F.array_append("up", F.col("key")))
        inside = nodes.select(F.explode(to).alias("key"), "leaves", "saved")
        tops = nodes.where((F.col("depth") % BAND == 0) & (F.col("depth") > 0)).select("key", "up").join(totals, "key")
        beyond = tops.select(F.explode("up").alias("key"), "leaves", "saved")
        totals = cut_lineage(inside.unionByName(beyond).groupBy("key").agg(*sums))
    return totals


def id_digests(ends: DataFrame) -> DataFrame:
    """``key, sha256``: the hash of the ids of ``key, conv_id``, ascending and joined by commas.

    Ids are joined in range partitions, so that the ids of a key may lie in many; the
    hash of a key is then fed from rows of up to 64 KB.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # key, first id, ids so far, their bytes

        def rows(found: list) -> pa.RecordBatch:
            cols = list(zip(*found)) or [()] * 4
            arrays = [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "first", "ids"])

        for batch in batches:
            out = []
            for k1, k2, c in zip(*(batch[n].to_pylist() for n in ("k1", "k2", "conv_id"))):
                text = b"%d" % c
                if held and held[0] == (k1, k2) and held[3] + len(text) < CHUNK:
                    held[2].append(text)
                    held[3] += len(text) + 1
                else:
                    if held:
                        out.append((*held[0], held[1], b",".join(held[2])))
                    held = [(k1, k2), c, [text], len(text)]
            yield rows(out)
        if held:
            yield rows([(*held[0], held[1], b",".join(held[2]))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hashed = None, None

        def rows(found: list) -> pa.RecordBatch:
            cols = list(zip(*found)) or [()] * 3
            arrays = [*(pa.array(c, pa.int64()) for c in cols[:2]), pa.array(cols[2], pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "sha256"])

        for batch in batches:
            out = []
            for *k, ids in zip(*(batch[n].to_pylist() for n in ("k1", "k2", "ids"))):
                if k == key:
                    hashed.update(b"," + ids)
                    continue
                if key is not None:
                    out.append((*key, hashed.hexdigest()))
                key, hashed = k, hashlib.sha256(ids)
            yield rows(out)
        if key is not None:
            yield rows([(*key, hashed.hexdigest())])

    flat = ends.select("key.k1", "key.k2", "conv_id").repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    chunks = flat.mapInArrow(join, "k1 long, k2 long, first long, ids binary")
    met = chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first")
    found = met.mapInArrow(digest, "k1 long, k2 long, sha256 string")
    return found.select(F.struct("k1", "k2").alias("key"), "sha256")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations, one row per distinct prefix.

    ``turns`` are ``conv_id, pos, item, octets`` with ``pos`` from 0 without gaps, ``convs``
    ``conv_id, n`` with ``n`` turns each, maybe none (see :func:`ordered_turns` and
    :func:`rebuilt_turns`). A node has ``node`` and ``parent`` (hex ids; the root's parent
    is null), ``depth``, ``conv_id`` (its smallest member), ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (bytes of turns that all members but one
    could share, in its subtree) and ``ends_sha256`` (ids of the members that end there).

    Rows without a conversation's id belong to none. Null roles and texts count as
    empty; turns with equal numbers are ordered by role and text, repeated rows are
    turns of their own. An empty table gives no node.
    """
    every = cut_lineage(prefixes(turns, convs))
    deepest = every.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    rows = _with_ancestors(every)
    nodes = rows.groupBy("key").agg(
        F.min("depth").alias("depth"),
        F.count("*").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.max("octets").alias("octets"),
        F.first("up").alias("up"),
    )
    parent = F.when(F.col("depth") > 0, F.element_at("up", -1)).alias("parent")
    nodes = cut_lineage(nodes.select("*", parent))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = cut_lineage(nodes)

    leaves = (F.col("n_children") == 0).cast("long").alias("leaves")
    saved = ((F.col("n_convs") - 1) * F.col("octets")).alias("saved")
    levels = [nodes.select("key", "depth", "up", leaves, saved)]
    step = BAND
    while step <= deepest:
        tops = every.where(F.col("depth") % step == 0).select("conv_id", F.expr(f"depth div {step}").alias("depth"), "key")
        levels.append(_with_ancestors(tops).groupBy("key").agg(F.min("depth").alias("depth"), F.first("up").alias("up")))
        step *= BAND
    totals = _rolled_up(levels)
    ends = id_digests(every.where("last").select("key", "conv_id"))

    found = nodes.drop("up", "octets").join(totals, "key").join(ends, "key", "left")
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = join_unique(found.where("depth > 0"), above, "parent", ["key"])
    found = below.unionByName(found.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    name = lambda k: F.lower(F.concat(*[F.lpad(F.hex(F.col(k)[f"k{i}"]), 16, "0") for i in (1, 2)]))
    return found.select(
        name("key").alias("node"),
        name("parent").alias("parent"),
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
