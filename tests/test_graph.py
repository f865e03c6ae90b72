import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import extraction, graph
from corpusloom.plans import ingest, retrieve


def entities(spark):
    return spark.createDataFrame(
        [("e1", "Harbour", "Place", "Stone pier", [1.0, 0.0]), ("e2", "Ferry", "Ship", "Blue hull", [0.0, 1.0]), ("e3", "Lone", "T", "x", [-1.0, 0.0])],
        "entity_id string, name string, type string, description string, embedding array<float>",
    )


def relations(spark):
    rows = [
        ("e1", "e2", "rel", 5),
        ("e1", "gone", "rel", 1),
        ("e1", "e3", "knows", 2),
        ("e1", "e2", "rel", 3),
        ("e2", "e2", "self", 4),
        ("lost", "e1", "rel", 6),
    ]
    return spark.createDataFrame(rows, "source_id string, target_id string, type string, seq long")


def test_relations_resolve_in_their_block(spark):
    mentions = spark.createDataFrame(
        [(1, 0, "A", "x1"), (1, 1, "B", "x2"), (1, 2, "A", "x3"), (2, 0, "A", "x4")],
        "block_id long, pos int, name string, entity_id string",
    )
    rels = spark.createDataFrame(
        [(1, 0, "A", "B", "t"), (1, 1, "A", "C", "t"), (2, 0, "A", "B", "t"), (2, 1, "A", "A", "t")],
        "block_id long, pos int, source string, target string, type string",
    )
    got = graph.resolve_relations(rels, mentions).select("block_id", "pos", "source_id", "target_id").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, "x3", "x2"), (2, 1, "x4", "x4")]
    left = graph.unresolved_relations(rels, mentions).select("block_id", "pos", "source_known", "target_known").collect()
    assert sorted(tuple(r) for r in left) == [(1, 1, True, False), (2, 0, True, False)]


def test_edges_keep_their_first_arrival(spark):
    kept = graph.with_stored_source(graph.without_self_loops(relations(spark)), entities(spark))
    got = graph.adjacency(kept).orderBy("source_id", "position").collect()
    assert [tuple(r) for r in got] == [("e1", 0, "gone", "rel"), ("e1", 1, "e3", "knows"), ("e1", 2, "e2", "rel")]


def test_positions_of_a_hub(spark):
    """One source holds most edges, so that it spans range partitions."""
    rng = np.random.default_rng(1)
    seqs = rng.permutation(3000)
    rows = [("hub" if i % 10 else f"s{i % 70}", f"t{i}", "r", int(s)) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, "source_id string, target_id string, type string, seq long").repartition(7)
    want = {}
    for source, target, _, seq in sorted(rows, key=lambda r: r[3]):
        want.setdefault(source, []).append(target)
    for r in graph.adjacency(df).collect():
        assert want[r.source_id][r.position] == r.target_id


def test_hot_keys_join_the_same_when_salted(spark):
    from corpusloom.operators.sizing import join_unique

    rows = spark.range(300).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 40).alias("k"))
    names = spark.range(35).select(F.col("id").alias("k"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
    fits = join_unique(rows, names, "k", ["id"], ["name"])
    salted = join_unique(rows, names, "k", ["id"], ["name"], limit=0)
    want = rows.join(names, "k").select("id", "name").collect()
    for got in (fits, salted):
        assert sorted(got.select("id", "name").collect()) == sorted(want)


def test_new_edges_and_union(spark):
    stored = spark.createDataFrame([("a", "b", "t")], "source_id string, target_id string, type string")
    more = spark.createDataFrame([("a", "b", "t"), ("a", "b", "u"), ("a", "b", "u")], stored.schema)
    assert graph.new_edges(stored, more).distinct().collect() == [("a", "b", "u")]
    assert sorted(graph.edge_union(stored, more).collect()) == [("a", "b", "t"), ("a", "b", "u")]


def test_lookup_and_update(spark):
    ids = spark.createDataFrame([("e1",), ("nope",)], "entity_id string")
    got = {r.entity_id: r.name for r in graph.lookup(ids, entities(spark)).collect()}
    assert got == {"e1": "Harbour", "nope": None}
    new = spark.createDataFrame([("e1", "New", None), ("zz", "Z", "Z")], "entity_id string, name string, description string")
    rows = {r.entity_id: r for r in graph.update_payload(entities(spark), new).collect()}
    assert rows["e1"].name == "New" and rows["e1"].description == "Stone pier" and "zz" not in rows


def test_context_of_a_query(spark):
    asked = spark.createDataFrame([(1, "q", [1.0, 0.1]), (2, "r", [0.0, -1.0])], "query_id long, query string, embedding array<float>")
    entries = graph.entry_points(asked, entities(spark))
    got = {r.query_id: r.graph_summary for r in graph.graph_context(asked, entries, entities(spark), relations(spark)).collect()}
    assert got == {1: "Entity: Harbour (Place) - Stone pier\n  - knows -> Lone\n  - rel -> Ferry", 2: ""}


def test_hybrid_query_keeps_every_question(spark):
    asked = spark.createDataFrame([(1, "q", [1.0, 0.1]), (2, "r", [0.0, -1.0])], "query_id long, query string, embedding array<float>")
    chunks = spark.createDataFrame(
        [("c1", "Chunk 1", {"source": "s"}, [1.0, 0.0]), ("c2", "Chunk 2", None, [0.5, 0.5]), ("c3", "Chunk 3", None, [-1.0, 0.0])],
        "chunk_id string, text string, metadata map<string,string>, embedding array<float>",
    )
    rows = {r.query_id: r for r in retrieve.hybrid_query(asked, chunks, entities(spark), relations(spark), k=2).collect()}
    assert rows[1].context_text == "Chunk 1\n\nChunk 2" and rows[1].num_hits == 2
    assert "Entity: Harbour" in rows[1].messages[1].content
    assert rows[2].graph_summary == "" and "No graph context" in rows[2].messages[1].content
    none = retrieve.hybrid_query(asked, chunks.limit(0), entities(spark), relations(spark)).collect()
    assert len(none) == 2 and {r.context_text for r in none} == {""}


def test_payload_and_labels(spark):
    rows = spark.createDataFrame(
        [("t", 0.876, {"filename": "f.pdf", "source": "s"}), (None, 0.5, {"filename": "", "source": "s"}), ("u", 1.0, None)],
        "text string, score double, metadata map<string,string>",
    )
    got = retrieve.hit_payload(rows).select(
        "text", retrieve.source_label(F.col("metadata")), retrieve.score_label(F.col("score")), F.col("metadata")["text"]
    )
    assert [tuple(r) for r in got.collect()] == [("t", "f.pdf", "0.88", "t"), ("", "s", "0.50", ""), ("u", "Unknown Source", "1.00", "u")]


def test_graph_is_built_across_blocks(spark):
    one = '{"entities":[{"name":"Curlew","type":"Bird","description":"Wader"},{"name":"Saltmarsh","type":"Place","description":"Low ground"}],"relations":[{"source":"Curlew","target":"Saltmarsh","type":"feeds_in"},{"source":"Curlew","target":"Nobody","type":"x"}]}'
    two = '{"entities":[{"name":"Curlew","type":"Boat","description":"Wader"},{"name":"Dunlin","type":"Bird","description":"small wader"}],"relations":[{"source":"Curlew","target":"Dunlin","type":"seen_with"},{"source":"Curlew","target":"Curlew","type":"is"}]}'
    df = spark.createDataFrame([(1, one), (2, two), (3, one), (4, "none")], "block_id long, response string")
    people, edges = ingest.build_graph(extraction.parse_extractions(df))
    names = {r.entity_id: (r.name, r.type) for r in people.collect()}
    assert sorted(names.values()) == [("Curlew", "Bird"), ("Dunlin", "Bird"), ("Saltmarsh", "Place")]
    got = sorted((names[r.source_id][0], names[r.target_id][0], r.type) for r in edges.collect())
    assert got == [("Curlew", "Dunlin", "seen_with"), ("Curlew", "Saltmarsh", "feeds_in")]


def test_graph_grows_batch_by_batch(spark, folder):
    from corpusloom.checks import inputs

    parsed = extraction.parse_extractions(inputs.responses(spark, folder)).where("doc_id < 60").cache()
    keys = ["doc_id", "block_index"]
    whole = ingest.build_graph(parsed, threshold=0.8, key=keys)
    early = ingest.build_graph(parsed.where("doc_id < 30"), threshold=0.8, key=keys)
    both = ingest.build_graph(parsed.where("doc_id >= 30"), threshold=0.8, key=keys, stored=early)
    for a, b, order in zip(whole, both, ("ord", "seq")):
        # The numbers leave out what stored tables no longer tell; their order is the same.
        columns = [c for c in a.columns if c not in ("embedding", order)]
        one, two = (df.orderBy(order).select(*columns).collect() for df in (a, b))
        assert one == two and len(one) > 50


def test_blocks_are_ordered_by_several_columns(spark):
    one = '{"entities":[{"name":"a","type":"t","description":"x"},{"name":"b","type":"t","description":"y"}],"relations":[{"source":"b","target":"a","type":"r"}]}'
    df = spark.createDataFrame([(2, 0, one), (1, 10, one), (1, 9, one), (1, 11, "none")], "doc string, block int, response string")
    parsed = extraction.parse_extractions(df)
    keys = ["doc", "block"]
    assert [(r.doc, r.block, r.pos, r.ord) for r in ingest.entity_mentions(parsed, keys, first=5).orderBy("ord").collect()] == [
        ("1", 9, 0, 5), ("1", 9, 1, 6), ("1", 10, 0, 7), ("1", 10, 1, 8), ("2", 0, 0, 9), ("2", 0, 1, 10)
    ]
    people, edges = ingest.build_graph(parsed, key=keys)
    assert sorted((r.name, r.ord) for r in people.collect()) == [("a", 0), ("b", 1)]
    assert [r.seq for r in edges.collect()] == [0]
    assert [df.count() for df in ingest.build_graph(parsed.limit(0), key=keys)] == [0, 0]


def test_later_mentions_follow_the_nearest_leader_so_far(spark):
    """The second mention of a text may have a nearer leader than the first had."""
    import numpy as np

    angles = {"a": 0.0, "b": 0.3, "c": 0.7}  # b is nearer to a than c is; c leads
    load = lambda: lambda texts: np.array([[np.cos(angles[t[0]] + 0.12 * (t[0] == "b")), np.sin(angles[t[0]] + 0.12 * (t[0] == "b"))] for t in texts])
    one = '{{"entities":[{}],"relations":[{{"source":"{}","target":"a","type":"r"}}]}}'
    named = lambda *names: ",".join(f'{{"name":"{n}","type":"t","description":"x"}}' for n in names)
    rows = [(1, one.format(named("a", "b"), "b")), (2, one.format(named("c"), "c")), (3, one.format(named("b", "a"), "b"))]
    parsed = extraction.parse_extractions(spark.createDataFrame(rows, "block_id long, response string"))
    people, edges = ingest.build_graph(parsed, loader=load, threshold=0.9)
    names = {r.entity_id: r.name for r in people.collect()}
    assert sorted(names.values()) == ["a", "c"]
    # In block 1 b is a, a loop that is dropped; in block 3 it is c.
    assert [(names[r.source_id], names[r.target_id]) for r in edges.collect()] == [("c", "a")]


def test_what_does_not_fit_is_not_broadcast(spark, monkeypatch):
    """Spark's own guess from compressed files would send it through the driver."""
    from corpusloom.operators import sizing

    rows = spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, k long")
    names = spark.createDataFrame([(k, f"name {k}") for k in range(3)], "k long, name string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(sizing.join_unique(rows, names, "k", ["id"], ["name"]))
    assert "Broadcast" not in plan(sizing.join_unique(rows, names, "k", ["id"], ["name"], limit=0))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert "Broadcast" not in plan(rows.join(sizing.broadcast_if_small(names, ["name"], limit=0), "k", how))
