"""Code lengths against a plain coder, and held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest

from marlstone.llm import ppm


def plain_bits(train, text):
    """Method C with exclusion, one byte after another; also the sum of the probabilities of all bytes at each place."""
    order = ppm.ORDER
    pad = b" " * order
    seq = pad + pad.join(train)
    counts = {}
    for i in range(order, len(seq)):
        for k in range(order + 1):
            own = counts.setdefault(seq[i - k : i], {})
            own[seq[i]] = own.get(seq[i], 0) + 1

    def p(context):
        if context is None:
            return [1 / 256] * 256
        lower = p(context[1:] if context else None)
        own = counts.get(context)
        if not own:
            return lower
        total, kinds = sum(own.values()), len(own)
        left = 1 - sum(lower[s] for s in own)
        return [own[s] / (total + kinds) if s in own else kinds / (total + kinds) * lower[s] / left for s in range(256)]

    raw = pad + text
    told = [p(raw[i - order : i]) for i in range(order, len(raw))]
    assert all(abs(sum(x) - 1) < 1e-9 for x in told)
    return sum(-math.log2(x[b]) for x, b in zip(told, text))


def test_lengths_are_those_of_a_plain_coder():
    rng = random.Random(1)
    train = {k: ["".join(rng.choices(k + "abc  ", k=rng.randint(1, 60))).encode() for _ in range(20)] for k in ("xy", "zé漢")}
    model = ppm.fit(train)
    texts = [b"", b"x", "zéz ab".encode(), b"q!\x00\xff", "漢漢".encode(), *("".join(rng.choices("xyzéabcq 漢", k=40)).encode() for _ in range(10))]
    got = model.lengths(texts)
    for t, row in zip(texts, got):
        for k, lang in enumerate(model.languages):
            assert row[k] == pytest.approx(plain_bits(train[lang], t), rel=1e-5), (t, lang)


def test_long_texts_in_parts(monkeypatch):
    model = ppm.fit({"a": [b"abab" * 50], "b": [b"bbba" * 50]})
    texts = [b"abbab" * 40, b"ab", b"", b"abbab" * 40]
    whole = model.lengths(texts)
    for part in (1, 17, 100):
        monkeypatch.setattr(ppm, "PART", part)
        assert np.allclose(model.lengths(texts), whole)


def test_a_language_is_learned_for_itself(spark):
    """Hundreds of languages, one of a single huge document, and more than can be learned; none changes another's tree."""
    rng = random.Random(6)
    names = [f"l{k:03}" for k in range(300)]
    alphabet = {x: rng.sample("abcdefghijklmnopqrstuvwxyzàéîõüßжшюя漢字仮名한글", 9) for x in names}
    write = lambda x, n: " ".join("".join(rng.choices(alphabet[x], k=rng.randint(2, 7))) for _ in range(n))
    rows = [(k, write(x, 150), x) for k, x in enumerate(names * 2)] + [(next(k for k in range(9010, 9100) if zlib.crc32(str(k).encode()) % 4 != 2), write("l000", 3) + " й" * 400_000, "ru"), (9002, write("l001", 30), None), (9003, None, "l002"), (9004, "", "none")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = ppm.learn(docs, train_bytes=20_000)
    learned = {x for k, _, x in rows[:600] if zlib.crc32(str(k).encode()) % 4 != 2}
    assert model.languages == sorted(learned | {"ru"})
    probe = spark.createDataFrame([(k, write(x, 12), x) for k, x in enumerate(sorted(learned))] + [(999, "й й й", "ru")], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in ppm.identify(probe, model).collect()}
    assert np.mean([got[r.doc_id] == r.lang for r in probe.collect()]) > 0.97 and got[999] == "ru"
    few = ppm.learn(docs.where("lang in ('l003', 'l004', 'ru')"), train_bytes=20_000)
    for x in few.languages:
        a, b = few.trees[few.languages.index(x)], model.trees[model.languages.index(x)]
        assert all((x == y).all() for f in ("seen", "bits", "contexts", "escapes") for x, y in zip(getattr(a, f), getattr(b, f)))
    assert ppm.learn(docs, languages=1).languages == ["ru"]


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = ppm.learn(docs)
    assert model.languages == ["de", "en", "es", "fr"]
    got = {r.doc_id: r for r in ppm.identify(docs, model).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    test = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in test) / len(test) > 0.97
    edge = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !_", "x"), (None, "the thing", "x"), (5, "q", "x"), (5, "q", "x")], "doc_id bigint, text string, score string")
    out = {r.doc_id: (r.lang_pred, r.held_out) for r in ppm.identify(edge, model).collect()}
    assert [out[k][0] for k in (1, 2, 3)] == ["und"] * 3 and out[None] == ("en", False) and out[5][0] != "und"
    assert ppm.identify(edge.limit(0), model).count() == 0
    assert ppm.learn(docs.limit(0)) is None
    assert {r.lang_pred for r in ppm.identify(edge, None).collect()} == {"und"}
