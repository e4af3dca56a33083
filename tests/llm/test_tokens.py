"""Byte BPE, the plane store and token counts against their libraries on whole texts."""

import base64
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlstone.llm import byte_bpe, plane_store, token_counts
from marlstone.llm.queries import BYTE_RANKS, WORDS
from marlstone.llm.word_tokens import ENDS, LATIN, WordEncoder, spaced

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(BYTE_RANKS), "rb"))}
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TOK = Tokenizer.from_file(P.path(WORDS))
LONG = " ".join(random.Random(1).choice(["the", "Énergie", "x1y2", "don't", "\n\n", "  ", "!!!", "<|endoftext|>", "漢字仮名"]) for _ in range(60_000))
TEXTS = ["", None, "Hello  world\n\n", "a" * 3000, "ab1!" * 30_000, LONG, "<|endoftext|>x <|startoftext|>", "é ́e", "ΑΣ ΑΣ　x y\tz\r\n", "the same", "the same"]
ROWS = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "null key", "x", "y"), (3, "a tie", "x", "y"), (3, "a tie", "x", "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, n_tokens string, ids string")


def test_byte_bpe_equals_the_library_and_round_trips(spark, docs):
    out = byte_bpe.encode_documents(docs, P.path(BYTE_RANKS), P.PATTERN, decoded=True).collect()
    want = sorted((str(i), np.asarray(TIK.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in ROWS)
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in out) == want
    assert all(r.n_tokens == len(r.ids) // 4 for r in out)
    coded = byte_bpe.encode_documents(docs, P.path(BYTE_RANKS), P.PATTERN)
    assert sorted(bytes(r.decoded) for r in byte_bpe.decode_documents(coded, P.path(BYTE_RANKS), P.PATTERN).collect()) == sorted(x[2] for x in want)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1!' \n\té　́漢", max_size=80))
def test_cuts_change_no_ids(text):
    pieces = byte_bpe.cuts(text, 4)
    assert "".join(pieces) == text
    assert [x for p in pieces for x in TIK.encode_ordinary(p)] == TIK.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1!' \n\té　́İΣσА<|endoftext|>", max_size=60))
def test_words_give_the_ids_of_the_text(text):
    coder = WORD
    assert coder.by_word
    assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == TOK.encode(text, add_special_tokens=False).ids


WORD = WordEncoder(P.path(WORDS))


def test_a_mark_after_any_letter():
    words = [w for c in map(chr, range(0x21, ord(LATIN))) for e in ENDS for w in (c + e, "x" + c + e, c + "é" + e)]
    want = [e.ids for e in TOK.encode_batch_fast(words, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in WORD.encode(words)] == want


def test_added_tokens_that_may_hide_are_refused():
    spec = json.loads(open(P.path(WORDS)).read())
    assert spaced(spec)
    spec["added_tokens"][0]["content"] = "[pad]"
    assert not spaced(spec)


def test_other_vocabularies_get_whole_texts():
    other = WordEncoder(P.path("byte_bpe_50k.json"))
    assert not other.by_word
    text = "two  words\n"
    assert np.frombuffer(other.encode([text])[0], "<u4").tolist() == Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 65_536, 65_537, 200_003])
def test_planes_round_trip(bits, n):
    for top in (1, 2, 49_408, 2**32):
        ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64).astype("<u4")
        assert (plane_store.unpack(plane_store.pack(ids, bits), n, bits) == ids).all()


@pytest.mark.parametrize("bits", [False, True])
def test_store_keeps_order_and_ids(spark, docs, bits, monkeypatch):
    monkeypatch.setattr(plane_store, "CHUNK_IDS", 1000)
    store = plane_store.write_store(docs, P.path(WORDS), bits=bits)
    got = sorted((r.start, str(r.doc_id), bytes(r.ids), r.crc32) for r in plane_store.read_store(spark, store).collect())
    at, want = 0, []
    for i, t, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = TOK.encode(t or "", add_special_tokens=False).ids + [1]
        raw = np.asarray(ids, "<u4").tobytes()
        want.append((at, str(i), raw, zlib.crc32(raw)))
        at += len(ids)
    assert got == want
    short = plane_store.read_store(spark, store, with_ids=False)
    assert short.columns == ["doc_id", "start", "n_tokens", "crc32"]
    assert sorted((r.start, r.n_tokens, r.crc32) for r in short.collect()) == [(a, len(raw) // 4, c) for a, _, raw, c in want]
    index = spark.read.parquet(store.index)
    assert index.agg({"n_ids": "sum"}).collect()[0][0] == at


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert byte_bpe.encode_documents(none, P.path(BYTE_RANKS), P.PATTERN).count() == 0
    assert plane_store.read_store(spark, plane_store.write_store(none, P.path(WORDS))).count() == 0
    assert token_counts.count_tokens(none, P.path(WORDS)).count() == 0


def test_counts_use_and_extend_the_cache(spark, docs, tmp_path):
    cache = f"file://{tmp_path}/cache"
    want = sorted((str(i), len((t or "").encode()), len(TOK.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ROWS)
    first = token_counts.count_tokens(docs, P.path(WORDS), cache)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in first.collect()) == want
    held = token_counts.read_cache(spark, cache).count()
    assert held == len({t or "" for _, t, *_ in ROWS})
    again = token_counts.count_tokens(docs.union(spark.createDataFrame([(99, "one  more", "", "")], docs.schema)), P.path(WORDS), cache)
    assert again.count() == len(ROWS) + 1
    assert token_counts.read_cache(spark, cache).count() == held + 1
    assert spark.read.parquet(cache).count() == held + 1  # known keys weren't encoded again


def test_piece_counts(spark, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = token_counts.count_tokens(docs, P.path("piece_bpe_32k.model")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(lib.encode(t or ""))) for i, t, *_ in ROWS)


def test_the_queries_digests(spark):
    from marlstone.llm.queries import op3_byte_bpe

    rows = {r.doc_id: r for r in op3_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for k, t in texts.items():
        assert rows[k].ids_sha256 == hashlib.sha256(np.asarray(TIK.encode_ordinary(t), "<u4").tobytes()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
