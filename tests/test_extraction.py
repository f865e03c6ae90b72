import json

from corpusloom.operators import documents as docs
from corpusloom.operators import extraction as ex
from corpusloom.plans import ingest

E1 = {"name": "Saltmarsh", "type": "Place", "description": "Low ground by the sea"}
E2 = {"name": "Curlew", "type": "Bird", "description": "Wader with a bent bill"}
R1 = {"source": "Curlew", "target": "Saltmarsh", "type": "feeds_in"}
GOOD = {"entities": [E1, E2], "relations": [R1]}


def body(**changes):
    return json.dumps({**GOOD, **changes}, ensure_ascii=False)


# What is read from each response: entities and relations.
ENTITIES = [("Saltmarsh", "Place", "Low ground by the sea"), ("Curlew", "Bird", "Wader with a bent bill")]
RELATIONS = [("Curlew", "Saltmarsh", "feeds_in")]
ALL = (ENTITIES, RELATIONS)
NOTHING = ([], [])
ODD = 'Quote " \\ \n é 😀 {brace}'
CASES = [
    (body(), ALL),
    (json.dumps(GOOD, indent=2), ALL),
    (f"```json\n{body()}\n```", ALL),
    (f"```\n{body()}\n```", ALL),
    (f"```JSON\n{body()}\n``` then {{oops}}", ALL),
    (f"```json\n{body()}\n```\nand ```{{x}}```", ALL),
    (f"Sure, here it is: {body()} Anything else?", ALL),
    (f"[{body()}]", ALL),
    (f"[{body()}, {body()}]", NOTHING),
    ("{broken} " + body(), NOTHING),
    *((text, NOTHING) for text in ("nothing to see", "", "{", "{}", "null", '"{}"', "```", "``` ```", "``````")),
    (body(entities=[E1, {"name": "x", "type": "y"}]), NOTHING),
    (body(entities=[{**E1, "name": 7}]), NOTHING),
    (body(entities=[{**E1, "description": None}]), NOTHING),
    (body(entities=[]), ([], RELATIONS)),
    *((body(entities=given), NOTHING) for given in (["Saltmarsh"], None, {"name": "a"}, "none")),
    (body(relations=[R1, {"source": "a", "target": "b"}, "loose", None, 3, [R1]]), ALL),
    (body(relations=[{**R1, "type": 5}]), NOTHING),
    (body(relations=[{**R1, "type": None}]), NOTHING),
    (body(relations=[{**R1, "weight": 0.5}]), ALL),
    *((body(relations=given), (ENTITIES, [])) for given in ([], "none", {"a": 1})),
    *((body(relations=given), NOTHING) for given in (None, 7, True)),
    (json.dumps({"entities": [E1]}), NOTHING),
    (json.dumps({"relations": [R1]}), NOTHING),
    (body(extra={"deep": [1, {"a": 2}]}), ALL),
    (body(entities=[{**E1, "name": ODD}]), ([(ODD, "Place", "Low ground by the sea")], RELATIONS)),
]


def frame(spark):
    return spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)], "block_id long, response string")


def test_parsing_gives_what_is_listed(spark):
    got = {r.block_id: r for r in ex.parse_extractions(frame(spark)).collect()}
    for i, (text, want) in enumerate(CASES):
        assert ([tuple(e) for e in got[i].entities], [tuple(r) for r in got[i].relations]) == want, text


def test_null_response_is_empty(spark):
    df = spark.createDataFrame([(1, None)], "block_id long, response string")
    row = ex.parse_extractions(df).first()
    assert row.entities == [] and row.relations == [] and not row.valid


def test_dropped_relations_are_counted(spark):
    df = spark.createDataFrame([(1, body(relations=[R1, {"source": "a"}, "x"]))], "block_id long, response string")
    row = ex.parse_extractions(df).first()
    assert row.valid and row.dropped == 2 and len(row.relations) == 1


def test_prompts_hold_the_block(spark):
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    row = ingest.block_prompts(df).first()
    assert [m.role for m in row.messages] == ["system", "user"]
    assert row.messages[1].content == "Extract from:\n\nsome text"


def test_answer_prompt_names_a_missing_graph(spark):
    df = spark.createDataFrame(
        [("q", "c1\n\nc2", ""), ("q", "c", "Entity: A (B) - C")], "query string, context_text string, graph_summary string"
    )
    first, second = [r.messages[1].content for r in ex.answer_prompts(df).collect()]
    assert "No graph context available." in first and "Question: q" in first
    assert "Entity: A (B) - C" in second and "No graph" not in second


def test_failing_rows_report_their_error(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "i long, messages string").repartition(2)

    def load():
        def model(prompts):
            if any(p == "p3" for p in prompts):
                raise RuntimeError("no")
            return [p.upper() for p in prompts]

        return model

    got = {r.i: (r.response, r.error) for r in ex.apply_model(df, load).collect()}
    assert got.pop(3) == (None, "RuntimeError: no")
    assert got == {i: (f"P{i}", None) for i in range(10) if i != 3}


def test_blocks_to_prompts_cover_the_text(spark):
    df = spark.createDataFrame([(1, "x" * 120)], "doc_id long, text string")
    rows = docs.text_blocks(df, size=50).orderBy("block_index").collect()
    assert [len(r.block) for r in rows] == [50, 50, 20]
