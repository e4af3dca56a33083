"""The FM-index and the decontamination scan against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from marlstone.llm import fm_index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(text, items):
    words, hit, who = fold(text), set(), set()
    for item, t in items:
        w = fold(t)
        for p in [w[k : k + 8] for k in range(max(1, len(w) - 7))] if w else []:
            for k in range(len(words) - len(p) + 1):
                if words[k : k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    who.add("" if item is None else str(item))
    return len(words), len(hit), sorted(who)


def test_suffix_order_rank_and_locate():
    rng = random.Random(4)
    for _ in range(60):
        s = np.array([rng.choice([0, 1, 1, 2, 3, 5]) for _ in range(rng.randint(1, 80))] + [0], np.int64)
        zeros = np.cumsum(s == 0) - 1
        plain = [(-1000 + int(zeros[k])) if s[k] == 0 else int(s[k]) for k in range(len(s))]
        assert fm_index.suffix_order(s).tolist() == sorted(range(len(s)), key=lambda k: plain[k:])
        tree = fm_index.WaveletTree(s, 5)
        for c in range(6):
            assert tree.rank(np.full(len(s) + 1, c), np.arange(len(s) + 1)).tolist() == [int((s[:k] == c).sum()) for k in range(len(s) + 1)]
        index = fm_index.FMIndex(s, 5)
        for n in (1, 2, 4):
            p = np.array([[rng.choice([1, 2, 3, 4, 5]) for _ in range(n)] for _ in range(20)])
            low, high = index.search(p, np.full(20, n))
            for q, a, b in zip(p.tolist(), low, high):
                want = [k for k in range(len(s) - n + 1) if s[k : k + n].tolist() == q]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


ITEMS = [(1, "The quick brown fox jumps over the lazy dog again"), (2, "one two"), (3, ""), (4, None), (None, "nobody knows this item of exactly nine words here"), (10, "The QUICK, brown fox jumps; over the lazy!"), (10, "uno dos tres"), (7, "l’été à São Paulo était très chaud cette année-là")]


def make_docs():
    rng = random.Random(8)
    vocabulary = fold(" ".join(t or "" for _, t in ITEMS)) + ["x", "y"]
    texts = ["", None, "one", "one-two", "ONE... two one", "say: the quick brown fox jumps over the lazy dog again and more", "z " * 5000 + "uno dos\ntres", "L’ÉTÉ", "l’été à são", "L’été à São Paulo était très chaud cette année-là!"]
    for _ in range(150):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(3)]
        if rng.random() < 0.5:
            parts.insert(1, rng.choice(ITEMS)[1] or "")
        texts.append(" ".join(parts))
    return texts


@pytest.mark.parametrize("block_bytes", [fm_index.BLOCK_BYTES, 60])
def test_scan_against_brute_force(spark, block_bytes, monkeypatch):
    texts = make_docs()
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "one two", "", ""), (3, "one-two", "", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, found string, items string")
    bench = spark.createDataFrame([(*x, 1) for x in ITEMS], "item_id int, text string, found int")
    out = fm_index.scan(docs, bench, keep=["doc_id"], block_bytes=block_bytes)
    got = [(str(r[0]), r[1].n_words, sum(s.end - s.start for s in r[1].spans), r[1].items) for r in out.collect()]
    want = [(str(i), *slow(t, ITEMS)) for i, t, *_ in rows]
    assert sorted(got) == sorted(want)
    clean = {r.doc_id: r.text for r in fm_index.decontaminated(docs, bench, block_bytes=block_bytes).collect()}
    assert fm_index.decontaminated(docs, bench).columns == docs.columns
    for i, t, *_ in rows[: len(texts)]:
        n, hit, who = slow(t, ITEMS)
        assert (i in clean) == (len(who) < 2)
        if i in clean:
            assert hit or clean[i] == t
            assert len(fold(clean[i])) == n - hit
    assert fm_index.scan(docs.limit(0), bench).count() == 0
    assert all(r[1].items == [] for r in fm_index.scan(docs, bench.limit(0), keep=["doc_id"]).collect())


def test_query(spark):
    from marlstone.llm.queries import op9_decontamination

    d = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in op9_decontamination(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        n, hit, who = slow(r.text, items)
        assert (got[r.doc_id].n_words, got[r.doc_id].n_hit, got[r.doc_id].n_items, got[r.doc_id].items_sha256, got[r.doc_id].contaminated) == (n, hit, len(who), hashlib.sha256(",".join(who).encode()).hexdigest(), len(who) >= 2)
