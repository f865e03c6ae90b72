"""Each pipeline stage against a plain version on its own input."""

import re
from collections import defaultdict

import public_tokenizers
import pytest
from test_tokens import check_pieces
from tokenizers import Tokenizer

import corpus_pipeline
from corpusloom.llm import mixing, queries
from corpusloom.session import cut_lineage


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def outputs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(cut_lineage(stage(spark, frames[-1], folder)))
    return frames


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_whole_rows_stay(outputs):
    given = rows(outputs[0])
    for df in outputs[1:-1]:
        assert df.columns == outputs[0].columns
        kept = rows(df)
        assert len(kept) == df.count() > 100 and all(given[k] == r for k, r in kept.items())


def test_quality_drops_what_op9_rejects(spark, folder, outputs):
    good = {r.doc_id for r in queries.op9_quality_classifier(spark, folder).collect() if r.predicted}
    assert set(rows(outputs[1])) == good and len(good) < 200
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(k in good for k, q in labels.items() if q == 1)


def test_exact_keeps_the_largest_id(outputs):
    groups = defaultdict(list)
    for k, r in rows(outputs[1]).items():
        groups[lowered(r.text)].append(k)
    assert set(rows(outputs[2])) == {max(g) for g in groups.values()}


def shingles(text):
    words = lowered(text).encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_near_keeps_one_of_a_group(outputs):
    given, kept = rows(outputs[2]), set(rows(outputs[3]))
    sets = {k: shingles(r.text) for k, r in given.items()}
    group = {k: k for k in sets}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        group[y] = x
    assert kept == {k for k in sets if root(k) == k} and len(pairs) > 1


def test_mixing_follows_the_copies(spark, folder, outputs):
    labels = queries.domain_labels(spark.read.parquet(f"{folder}/labels.parquet"))
    found = mixing.mixed(outputs[3], labels, **queries.MIX).collect()
    assert set(rows(outputs[4])) == {r.doc_id for r in found if r.copies}
    known = {r.doc_id: r.domain for r in labels.collect()}
    clean = [r for r in found if known.get(r.doc_id) == "clean"]
    assert sum(r.copies for r in clean) >= 0.97 * len(clean)


def test_packing_holds_every_id(outputs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {k: [*t.encode(r.text or "", add_special_tokens=False).ids, 0] for k, r in rows(outputs[4]).items()}
    assert check_pieces(outputs[5].collect(), docs, 1024) < 1024


def test_run_gives_the_last_stage(spark, folder, outputs):
    assert sorted(corpus_pipeline.run(spark, folder).collect()) == sorted(outputs[5].collect())


def test_stages_take_dirty_rows(spark, dirty, folder):
    docs = dirty.selectExpr("doc_id", "text", "lang", "_hash as source", "length(text) as n_chars")
    for given in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, given, folder).collect()
