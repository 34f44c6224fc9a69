"""Token-id files: exact round trips, and the ids of the library itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from calibrel.llm import mixing, tokenfiles
from calibrel.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
CODER = Tokenizer.from_file(PATH)
CODER.encode_special_tokens = True
ENCODER = tokenfiles.Encoder(tokenfiles.read_tokenizer(PATH))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 700), st.integers(1, 70_000), st.integers(0, 9))
def test_blocks_come_back(blocks, n, ids, seed):
    chance = np.random.default_rng(seed)
    rows = np.minimum(chance.geometric(0.02, (blocks, n)), ids) - 1
    if seed % 3 == 0:
        rows = np.tile(rows[:, : max(1, n // 7)], 8)[:, :n]
    coded = mixing.compress(rows, ids)
    lanes = [w for block in coded for w in block]
    back = mixing.expand(np.concatenate(lanes), np.array([len(w) for w in lanes]), rows.shape[1], ids)
    assert (back == rows).all()


def test_predictions_pay():
    chance = np.random.default_rng(1)
    even = chance.integers(0, 50_000, (1, 20_000))
    often = np.minimum(chance.geometric(0.01, (1, 20_000)), 50_000)
    again = np.tile(chance.integers(0, 50_000, (1, 500)), 40)
    size = lambda rows: 16 * sum(map(len, mixing.compress(rows, 50_001)[0])) / rows.size
    # order 0 learns the frequencies, order 2 the repetition; even ids cost little more than their bits
    assert size(often) < 9.5 and size(again) < 4 and size(even) < 18


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\r\x0b\x1c\x85 ab'sé日1!.😀<|endoftext|>", max_size=40), max_size=4))
def test_pieces_have_the_ids_of_whole_texts(texts):
    want = [np.array(CODER.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert ENCODER.encode(texts) == want


def expected(rows, end):
    out, at = [], 0
    for doc, text in rows:
        ids = CODER.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("block, part", [(1 << 16, 32 << 20), (1000, 20_000), (7, 500)])
def test_files_of_nasty_rows(spark, docs, monkeypatch, block, part):
    monkeypatch.setattr(tokenfiles, "BLOCK_IDS", block)
    source = docs if block > 7 else docs.where("length(text) < 3000 OR text IS NULL")
    path = scratch_path(spark, "id-files")
    tokenfiles.write_ids(source, path, PATH, 2, part_bytes=part)
    found = tokenfiles.with_starts(tokenfiles.read_ids(spark, path))
    got = sorted(found.collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert len({r.part for r in got}) > (block < 1 << 16)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    want = expected([(r.doc_id, r.text) for r in source.collect()], 2)
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.doc_id, r.n_tokens, r.ids_crc32, r.ids) for r in got) == order(want)


def test_no_documents(spark, none):
    assert tokenfiles.stored_ids(none, PATH, 2).collect() == []


def test_damaged_files_are_told(spark):
    writer = tokenfiles.Writer(0, 100)
    content = b"".join(b + b"\n" for b in [*writer.add(1, np.arange(90)), *writer.finish()])
    assert [docs for *_, docs in tokenfiles.read_blocks(content)] == [[(1, 0, 90)]]
    for at in range(0, len(content) - 1, 11):
        broken = bytearray(content)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            list(tokenfiles.read_blocks(bytes(broken)))
    with pytest.raises(ValueError):
        list(tokenfiles.read_blocks(content[:-5]))
