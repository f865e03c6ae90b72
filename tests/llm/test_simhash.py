"""SimHash groups against all pairs."""

import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import components, queries, simhash, tokens


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps, distance=4):
    """fp per id -> smallest id reachable, by comparing all pairs."""
    ids = sorted(fps)
    group = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= distance and group[j] < group[i]:
                    group[i], changed = group[j], True
    return group


def test_op10_equals_all_pairs(spark, folder, documents):
    fps = {key: plain_fingerprint(text) for key, text, _ in documents}
    group = plain_groups(fps)
    got = sorted(map(tuple, queries.op10_simhash(spark, folder).collect()))
    assert got == [(k, f"{fps[k]:016x}", group[k]) for k in sorted(fps)]


def links_of(spark, fps, distance=4):
    rows = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    found = components.components(simhash.near_links(spark.createDataFrame(rows, "fp long"), distance)).collect()
    return {r.node & (2**64 - 1): r.component & (2**64 - 1) for r in found}


@pytest.mark.parametrize("spread", [4, 10, 64])
def test_links_equal_all_pairs(spark, spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 2**63, 6)
    fps = set()
    for c in centres.tolist():
        for _ in range(60):
            bits = rng.choice(spread, rng.integers(0, 4), replace=False)
            fps.add(c ^ sum(1 << int(b) for b in bits))
    fps |= {0, 2**64 - 1, 1}
    got = links_of(spark, fps)
    group = plain_groups({f: f for f in fps})
    roots = {}
    for f in fps:
        mates = {g for g in fps if group[g] == group[f]}
        if len(mates) == 1:
            assert f not in got
        else:
            assert {g for g in fps if g in got and got[g] == got[f]} == mates
            roots[group[f]] = got[f]
    assert len(set(roots.values())) == len(roots)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**12 - 1), min_size=1, max_size=60), st.integers(0, 3))
def test_contract_spans_what_pairs_connect(values, distance):
    fps = sorted(values)
    parts = {f: f for f in fps}
    pairs = simhash.contract(np.array(fps, np.uint64), distance)
    for i, j in pairs:
        assert (fps[i] ^ fps[j]).bit_count() <= distance
        old, new = parts[fps[j]], parts[fps[i]]
        parts = {f: new if p == old else p for f, p in parts.items()}
    want = plain_groups({f: f for f in fps}, distance)
    assert len(pairs) == len(fps) - len(set(want.values())) == len(fps) - len(set(parts.values()))


def test_chain_and_hub_components(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    hub = [(1000, i) for i in range(1001, 1400)]
    odd = [(None, 3), (5, 5), (2000, 2000), (7, 6)]
    links = spark.createDataFrame(chain + hub + odd, "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)}
    assert components.components(links.limit(0)).count() == 0


def test_dirty_rows(dirty):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(dirty).collect()}
    assert got[1, 0] == got[2, 0] == got[3, 0] == 1
    same = [c for (k, _), c in got.items() if k in (4, 5)]
    assert set(same) == {4}
    kept = simhash.drop_near_duplicates(dirty)
    assert kept.columns == dirty.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 4, 6, 7, 8, 9]
    assert simhash.near_duplicates(dirty.limit(0)).count() == 0


def edited(seed, n, changes):
    """Texts and edits of them: pairs of all similarities from 0.6 on."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([30, 60, 120, 400]))]
        out.append((2 * k, " ".join(text)))
        for _ in range(max(1, int(len(text) * changes * rng.random()))):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append((2 * k + 1, " ".join(text)))
    return out


def similarity(a, b):
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_texts_are_found(spark, monkeypatch):
    docs = edited(4, 500, 0.05)
    docs += [(5000 + i, f"{docs[0][1]} {'x ' * i}") for i in range(60)] + [(6000, ""), (6001, None), (6002, "a b"), (6003, "A  b")]
    want = {k for k in range(0, 1000, 2) if similarity(docs[k][1], docs[k + 1][1]) >= 0.8}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.similar_texts(df).collect()}
    assert len(got) == len(docs)
    linked = {k for k in range(0, 1000, 2) if got[k + 1] == k}
    # No pair below the similarity, and nearly all above it.
    assert linked <= want and len(linked) >= 0.95 * len(want) and 100 < len(want) < 450
    assert got[6001] == 6000 and got[6003] == 6002
    assert {got[5000 + i] for i in range(5)} == {0}
    kept = {r.doc_id for r in simhash.drop_similar(df).collect()}
    assert kept == {k for k, c in got.items() if k == c}


def test_members_of_a_crowded_key_stay_connected():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, (3, simhash.WIDE)).astype(np.uint64)
    fp = centres[rng.integers(0, 3, 1500)] ^ (np.uint64(1) << rng.integers(0, 64, (1500, simhash.WIDE)).astype(np.uint64))
    a, b = simhash.leader_links(fp)
    assert len(a) < 6 * len(fp) and (np.bitwise_count(fp[a] ^ fp[b]).sum(1) <= simhash.WIDE_DISTANCE).all()
    group = list(range(len(fp)))
    root = lambda i: i if group[i] == i else root(group[i])
    for x, y in zip(a.tolist(), b.tolist()):
        group[root(max(x, y))] = root(min(x, y))
    assert len({root(i) for i in range(len(fp))}) == 3


def groups_of(docs, similar=0.8):
    group = {k: k for k, _ in docs}
    sets = {k: frozenset(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))) for k, t in docs}
    root = lambda k: k if group[k] == k else root(group[k])
    for a, _ in docs:
        for b, _ in docs:
            if a < b and len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {k: root(k) for k in group}


@pytest.mark.parametrize("hot, block", [(1024, 1024), (32, 16)])
def test_groups_of_similar_texts_are_exact(spark, monkeypatch, hot, block):
    """All pairs, those that no segment brings together too; and a crowded group around a text and a common line."""
    monkeypatch.setattr(simhash, "HOT_KEY", hot)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "COLUMNS", 64)
    docs = edited(7, 250, 0.05)
    rng = random.Random(3)
    centre = [f"c{i}" for i in range(150)]
    for k in range(120):
        text = list(centre)
        for _ in range(rng.randrange(1, 8)):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
        docs.append((1000 + k, " ".join(text)))
    docs += [(2000 + k, "a line that very many of the texts begin with " + " ".join(f"u{k}x{i}" for i in range(20))) for k in range(120)]
    want = groups_of(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in simhash.similar_texts(df).collect()} == want
    crowd = {want[1000 + k] for k in range(120)}
    assert 1 < len(crowd) < 120


def test_leading_shingles_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    hot = np.arange(0, 400, 3).astype(np.uint64)
    for _ in range(300):
        a = rng.choice(400, rng.integers(1, 60), replace=False)
        b = np.union1d(rng.permutation(a)[: max(1, len(a) - rng.integers(0, 4))], rng.choice(400, rng.integers(0, 4)))
        a, b = np.unique(a).astype(np.uint64), np.unique(b).astype(np.uint64)
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(simhash.leading(a, hot, 0.8), simhash.leading(b, hot, 0.8)))


def test_similar_texts_on_dirty_rows(dirty):
    kept = simhash.drop_similar(dirty)
    assert kept.columns == dirty.columns and kept.where("doc_id is null").count() == 1
    assert sorted(r.doc_id for r in kept.where("doc_id in (1, 2, 3, 4, 5)").collect()) == [1, 4, 4]
    assert simhash.similar_texts(dirty.limit(0)).count() == 0


def test_blocks_of_sets_are_compared_in_little_memory():
    rng = np.random.default_rng(5)
    pool = np.arange(400, dtype=np.int64)
    sets = [np.unique(np.r_[rng.choice(pool, 300, replace=False) if i % 2 else pool[:300], rng.integers(400, 1 << 40, i % 50)]) for i in range(2 * simhash.BLOCK)]
    tracemalloc.start()
    found = simhash.spanning_links(sets, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    assert all(len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) for i, j in found)
    assert len(found) == len({j for _, j in found}) >= simhash.BLOCK - 50


def test_remembered_tokens_are_dropped():
    path = public_tokenizers.path("byte_bpe_50k.json")
    first = tokens.encoder(path)
    assert tokens.encoder(path) is first
    tokens.forget()
    assert tokens.encoder(path) is not first
