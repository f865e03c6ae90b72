"""Token files and packing against direct encoding."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import packing, queries, token_files, tokens
from corpusloom.session import cut_lineage

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_added_tokens_keep_their_id(plain):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext |>"]
    got = [np.frombuffer(ids, "<u4").tolist() for ids in tokens.encoder(PATH).encode(texts)]
    assert got == [plain(t) for t in texts] and got[0].count(50256) == 1


def test_marks_after_a_letter_are_asked_for_apart(plain, monkeypatch):
    asked, ids = [], tokens.Words.ids
    encoder = tokens.Encoder(PATH)
    monkeypatch.setattr(tokens.Words, "ids", lambda self, text: asked.append(text) or ids(self, text))
    text = "été, mot. on mot, été. été***\nfin***"
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == plain(text)
    # Words of letters go to the merges alone, whatever letter stands before the marks.
    assert sorted(asked) == ["***", ",", "."]


@given(st.text(alphabet=st.sampled_from(list("ab \n\t\x1c\xa0\u2003")), max_size=12))
def test_white_spaces_that_meet_are_seen(text):
    assert tokens.spaces_meet(text) == bool(re.search(r"\s\s", text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab.,'s \n\t\r é1#🙂\x1c")), max_size=40))
def test_remembered_words_give_the_ids_of_the_text(text):
    encoder = tokens.encoder(PATH, 64)
    want = encoder.words.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_boundaries_round_trip(lengths):
    values = np.cumsum([0, *lengths])
    ef = token_files.EliasFano.of(values, int(values[-1]) + 7)
    assert ef.values().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()


def test_block_opens_one_document():
    docs = [np.array(x, "<u4") for x in ([], [1, 2], [70000], [], [5] * 200)]
    block = token_files.Block(token_files.pack_block([d.tobytes() for d in docs]))
    assert [block.document(i).tolist() for i in range(5)] == [d.tolist() for d in docs]
    assert block.width == 4
    with pytest.raises(ValueError):
        token_files.Block(b"other" + bytes(40))


def test_op3_equals_direct_encoding(spark, folder, documents, plain):
    want, at = [], 0
    for key, text, _ in sorted(documents):
        ids = [*plain(text), 2]
        want.append((key, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, queries.op3_token_files(spark, folder).collect())) == want


def test_token_files_of_dirty_rows(dirty, plain):
    rows = [(r.doc_id, r.text or "") for r in dirty.collect()]
    stored = cut_lineage(token_files.token_blocks(dirty, PATH, 2, block_tokens=100))
    got = token_files.read_documents(stored).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [k for k, _ in order]
    at = 0
    for r, (_, text) in zip(got, order):
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == [*plain(text), 2]
        at += r.n_tokens
    assert token_files.read_documents(cut_lineage(token_files.token_blocks(dirty.limit(0), PATH, 2))).count() == 0


def check_pieces(pieces, docs, size):
    """Every id in one piece, sequences gapless; gives the padding."""
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p.doc_id].append(p)
        of_sequence[p.sequence_id].append((p.offset, p.length))
    padding = 0
    for parts in of_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    assert set(of_doc) == set(docs)
    for key, ids in docs.items():
        at = 0
        for p in sorted(of_doc[key], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and crc(ids[at : at + p.length]) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    return padding


def test_op4_covers_every_id_with_little_padding(spark, folder, documents, plain):
    docs = {key: [*plain(text), 0] for key, text, _ in documents}
    padding = check_pieces(queries.op4_packing(spark, folder).collect(), docs, 1024)
    assert padding < 1024


def test_packing_dirty_rows(dirty):
    pieces = packing.pack(dirty, PATH, 0, size=64, group_items=4).collect()
    assert sum(p.length for p in pieces if p.doc_id == 4) == 2 * next(p.doc_tokens for p in pieces if p.doc_id == 4)
    assert {p.doc_id for p in pieces} == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
    assert packing.pack(dirty.limit(0), PATH, 0).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60))
def test_first_fit_and_filling(lengths):
    lengths.sort(reverse=True)
    bins = packing.first_fit_decreasing(lengths, 64)
    room, want = [], []
    for n in lengths:
        b = next((i for i, r in enumerate(room) if r >= n), len(room))
        if b == len(room):
            room.append(64)
        room[b] -= n
        want.append(b)
    assert bins == want
    pieces = packing.fill_up(lengths, bins, 64)
    used, parts = defaultdict(int), defaultdict(list)
    for item, start, n, b in pieces:
        used[b] += n
        parts[item].append((start, n))
    assert sum(u < 64 for u in used.values()) <= 1 and max(used.values(), default=0) <= 64
    for item, n in enumerate(lengths):
        at = 0
        for start, part in sorted(parts[item]):
            assert start == at and part > 0
            at += part
        assert at == n
