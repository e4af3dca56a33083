"""The registered queries over the smallest tables, against their contracts worked out plainly."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from test_simhash import slow_components, slow_fingerprint
from tokenizers import Tokenizer

from marlstone.llm.queries import ORACLE, QUERIES, WORDS

D = "/root/testdata/sf0.001"
TOK = Tokenizer.from_file(P.path(WORDS))
COLUMNS = {
    "op1_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op3_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_bit_planes": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op5_quality": {"doc_id": "bigint", "score": "double", "keep": "boolean"},
    "op6_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op7_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op8_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op10_line_templates": {"doc_id": "bigint", "text": "string"},
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def rows(spark):
    held = {}

    def of(name):
        if name not in held:
            df = QUERIES[name](spark, D)
            assert COLUMNS[name].items() <= dict(df.dtypes).items()
            held[name] = df.collect()
        return held[name]

    return of


@pytest.mark.parametrize("name", list(COLUMNS))
def test_whole_tables(spark, rows, name):
    key, table = ("page_id", "pages") if name.startswith("op2_") else ("doc_id", "documents")
    assert sorted(r[key] for r in rows(name)) == sorted(r[0] for r in spark.read.parquet(f"{D}/{table}.parquet").select(key).collect())


def test_names():
    assert list(COLUMNS) == list(QUERIES) and set(ORACLE) <= set(QUERIES)


def test_simhash(rows, texts):
    ids = sorted(texts)
    fps = [slow_fingerprint(texts[i]) for i in ids]
    want = {i: (f"{f:016x}", ids[c]) for i, f, c in zip(ids, fps, slow_components(fps, 2))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows("op1_simhash")} == want


def test_ids_and_counts(rows, texts):
    stored, counted = ({r.doc_id: r for r in rows(n)} for n in ("op4_bit_planes", "op7_token_counts"))
    at = 0
    for i in sorted(texts):
        ids = TOK.encode(texts[i], add_special_tokens=False).ids
        r, c = stored[i], counted[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes()))
        assert (c.n_bytes, c.n_tokens, c.over_limit) == (len(texts[i].encode()), len(ids), len(ids) > 2048)
        at += len(ids) + 1


def test_media(rows, texts):
    by_text = {}
    for r in rows("op6_media"):
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert by_text.setdefault(texts[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_entry_lists_them():
    import __spark_entry__

    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())
