"""Token operators against the tokenizers library."""

import collections
import functools
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import bpe_chunks, elias_fano, token_counts, token_store
from cohortlens.llm.units import UnitEncoder, load, safe_pieces

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


loaded = functools.cache(load)


def library(path, text):
    return loaded(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def strings(odd_texts):
    rng = random.Random(1)
    parts = [*"abzAZéßÿ09 \n\t'.,!<|>-_@²ªµĀſΣ́ 　\x1c\x85\r", "<|endoftext|>", "  ", "'s", "'ll"]
    return [t or "" for t in odd_texts] + ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(1500)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_units_give_the_librarys_ids(path, strings):
    encoder, tokenizer = UnitEncoder(path, memo_units=500), load(path)
    assert encoder.pretokens.usable
    for start in range(0, len(strings), 700):
        some = strings[start : start + 700]
        values, starts = encoder.ids(pa.array(some))
        expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in some]
        assert [values[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == expected


class Counted:
    """Passes calls on and counts them by name, with the items of their first argument."""

    def __init__(self, inner):
        self.inner, self.calls, self.items = inner, collections.Counter(), collections.Counter()

    def __getattr__(self, name):
        def call(first, *args, **kwargs):
            self.calls[name] += 1
            self.items[name] += len(first)
            return getattr(self.inner, name)(first, *args, **kwargs)

        return call


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_units_are_cut_many_at_once(path):
    encoder = UnitEncoder(path)
    pattern = encoder.pretokens.pattern = Counted(encoder.pretokens.pattern)
    texts = [" ".join(f"end{i}.\nNext{j}, (x)" for j in range(100)) for i in range(30)]
    values, starts = encoder.ids(pa.array(texts))
    assert [values[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [library(path, t) for t in texts]
    assert 0 < sum(pattern.calls.values()) <= 2  # units, and first units of texts


@pytest.mark.parametrize("lengths_only", [False, True])
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_what_stands_between_units_is_no_part_of_them(path, lengths_only):
    encoder = UnitEncoder(path, lengths_only, memo_units=3)
    texts = ["", "\x00", "a\x00b c", "c\n", "\n \n", "", "A<|b|> <| d", "it's  \x00 \x00", " ", "é. \n\nÉ"]
    for _ in range(2):
        expected = [library(path, t) for t in texts]
        assert encoder.lengths(pa.array(texts)).tolist() == list(map(len, expected))
        if not lengths_only:
            assert encoder.ids(pa.array(texts)).values.tolist() == [i for x in expected for i in x]
        texts = texts[::-1] + [t + " x\x00" for t in texts]
    assert encoder.ids(pa.array([], pa.string())).starts.tolist() == [0]


def test_long_texts_are_cut_at_safe_places():
    text = "some words  here\n" * 9000
    pieces = safe_pieces(text, 1000)
    assert "".join(pieces) == text and len(pieces) > 100
    assert [i for p in pieces for i in library(BYTE, p)] == library(BYTE, text)
    assert safe_pieces("x" * 5000, 1000) == ["x" * 5000]


def test_chunks_are_shared_and_joins_repaired(strings):
    encoder = bpe_chunks.ChunkEncoder(WORD)
    passage = " ".join(strings[6].split()[:300])
    texts = [*strings, "first " + passage, "second one " + passage]
    got = encoder.encode(pa.array(texts))
    assert [x.tolist() for x in got] == [library(WORD, t) for t in texts]
    before = encoder.encoded
    encoder.encode(pa.array(["third " + passage + " end"]))
    assert encoder.encoded - before <= 3 and encoder.joins > 0


def test_a_join_without_agreement_is_encoded_whole(monkeypatch):
    encoder = bpe_chunks.ChunkEncoder(WORD)
    monkeypatch.setattr(encoder, "_repaired", lambda windows: [None] * len(windows))
    text = " ".join(f"word{i} and more" for i in range(3000))
    assert encoder.encode(pa.array([text]))[0].tolist() == library(WORD, text)
    assert encoder.whole == 1


def test_a_join_asks_the_library_once():
    encoder = bpe_chunks.ChunkEncoder(WORD)
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} and. more" for i in range(3000))
    encoder.encode(pa.array([text]))  # all units are known from here on
    library_calls = encoder.units.tokenizer = Counted(encoder.units.tokenizer)
    before = encoder.joins
    assert encoder.encode(pa.array([text]))[0].tolist() == library(WORD, text)
    assert encoder.joins - before > 10 and library_calls.items["encode_batch_fast"] == encoder.joins - before


def test_units_beside_a_join_must_come_out_as_in_their_chunks():
    encoder = bpe_chunks.ChunkEncoder(WORD)
    ids = [np.array(library(WORD, t), np.uint32) for t in (" one", " three", " other")]
    window = bpe_chunks.Window(" one two three", ids[0], ids[1])
    wrong = [window._replace(left=ids[2]), window._replace(right=ids[2]), window._replace(text=" one three", left=ids[2])]
    found = encoder._repaired([window, *wrong])
    assert found[0].tolist() == library(WORD, " two") and found[1:] == [None] * 3


def test_encode_operator(spark, docs, odd_texts):
    rows = bpe_chunks.encode(docs, WORD, ["doc_id", "source"], tasks=3).collect()
    assert len(rows) == len(odd_texts) + 2
    for r in rows:
        ids = library(WORD, "no id here" if r.doc_id is None else odd_texts[r.doc_id])
        assert r.ids == ids and r.decoded == loaded(WORD).decode(ids, skip_special_tokens=False)
    empty = bpe_chunks.encode(docs.limit(0), WORD, ["doc_id"])
    assert empty.columns == ["doc_id", "ids", "decoded"] and empty.count() == 0


def test_counts_operator(docs, odd_texts):
    rows = token_counts.count_tokens(docs, BYTE, ["doc_id", "n_tokens"], batch_bytes=1000).collect()
    assert len(rows) == len(odd_texts) + 2
    for r in rows:
        text = "no id here" if r.doc_id is None else odd_texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library(BYTE, text)))
    assert token_counts.count_tokens(docs.limit(0), BYTE, ["doc_id"]).count() == 0


def test_store_operator(spark, docs, odd_texts, tmp_path):
    manifest = token_store.write(docs, BYTE, str(tmp_path), shards=4)
    rows = token_store.read(manifest).orderBy("start", "n_tokens").collect()
    order = [(None, "no id here"), *((i, t) for i, t in enumerate(odd_texts) for _ in range(1 + (i == 6)))]
    start = 0
    for r, (i, text) in zip(rows, order, strict=True):
        ids = [*library(BYTE, text), 0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(r) == (i, start, len(ids), crc)
        start += len(ids)
    again = token_store.read(token_store.open_store(spark, str(tmp_path)))
    assert again.count() == len(rows)
    none = token_store.write(docs.limit(0), BYTE, str(tmp_path / "none"), shards=2)
    assert token_store.read(none).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700), st.data())
def test_elias_fano_select(values, data):
    values = np.array(sorted(values), np.int64)
    coded = elias_fano.encode(values)
    seq = elias_fano.EliasFano(coded)
    a, b = sorted(data.draw(st.tuples(st.integers(0, len(values)), st.integers(0, len(values)))))
    assert seq.select(a, b).tolist() == values[a:b].tolist()


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    assert len(elias_fano.encode(ends)) * 8 / len(ends) < 13.5


def test_queries_on_the_smallest_tables(spark):
    from cohortlens.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    tokenizer = load(WORD)
    for r in QUERIES["op3_bpe_encode_decode"](spark, folder).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    tokenizer, start = load(BYTE), 0
    lengths = {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    for r in QUERIES["op9_token_counts"](spark, folder).collect():
        n = len(lengths[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)
    for r in QUERIES["op10_token_store"](spark, folder).orderBy("doc_id").collect():
        ids = [*lengths[r.doc_id], 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
