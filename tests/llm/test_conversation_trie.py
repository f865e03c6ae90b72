"""The trie's nodes against one built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from corpusloom.llm import conversation_trie, queries
from corpusloom.session import cut_lineage

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def rebuilt(rows):
    """(conv_id, turn, role, text) -> conv_id: list of (role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain(convs):
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].add(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        saved[k] = (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        saved[k] += sum(saved[x] for x in kids[k])
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
    return sorted(
        (
            min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k],
            hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest(),
        )
        for k, m in members.items()
    )


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*COLUMNS).collect())


def test_op11_equals_plain_trie(spark, folder):
    rows = [tuple(r.values()) for r in pq.read_table(f"{folder}/conversations.parquet").to_pylist()]
    assert got(queries.op11_prefix_trie(spark, folder)) == plain(rebuilt(rows))


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(120):
        length = rng.choice([1, 2, 3, 7, 8, 9, 16, 17, 70])
        for t in range(length):
            rows.append((c, t, "user", f"turn {t}" if rng.random() < 0.97 else rng.choice(["é", "other"])))
    rows += [(200, t, "user", f"turn {t}") for t in range(600)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [conversation_trie.BLOCK, 2 * conversation_trie.BAND])
def test_deep_and_shared(spark, block, monkeypatch):
    monkeypatch.setattr(conversation_trie, "BLOCK", block)
    monkeypatch.setattr(conversation_trie, "CHUNK", 40)
    rows = made(1)
    df = cut_lineage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    by = defaultdict(list)
    for c, t, role, text in sorted(rows):
        by[c].append((role, text))
    assert got(conversation_trie.prefix_trie(*conversation_trie.ordered_turns(df))) == plain(by)


def test_dirty_rows(spark, tmp_path):
    rows = [
        (None, 1, "user", "lost"), (3, None, "user", "first"), (3, 0, None, None), (3, 0, "user", "tie"), (3, 0, "user", "tie"),
        (-7, 1, "user", "a"), (-5, 0, "user", "b"), (-5, 0, "assistant", "b"), (0, 5, "user", ""), (4, 1, "x", "y" * 100000), (15, 0, "user", "b"),
        (16, 0, "user", "c"), (2**62 + 4, 0, "user", "b"), (2**62 + 4, 1, "user", "b"),
    ]
    dirty = [(*r, "extra", 1) for r in rows]
    df = spark.createDataFrame(dirty, "conv_id long, turn long, role string, text string, key string, depth int")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op11_prefix_trie(spark, str(tmp_path))
    assert got(found) == plain(rebuilt(rows))
    assert conversation_trie.prefix_trie(*conversation_trie.ordered_turns(df.limit(0))).count() == 0
