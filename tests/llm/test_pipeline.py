"""Near copies against brute force, and the pipeline's stages."""

import random

import numpy as np
import pytest

import corpus_pipeline
from marlstone.llm import simhash


def shares(a, b, size=5):
    x, y = (set(simhash.shingles(simhash.words_of(t), size)) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def planted():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    texts = ["", None, " \n", "one", "ONE"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(80, 400))]
        for edits in (0, 0, 1, 1, 2, 40):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    return texts


def test_near_copies_against_brute_force(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(7, texts[7], 1)], "doc_id bigint, text string, node int")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    pairs = [(i, j, shares(texts[i] or "", texts[j] or "")) for i in range(len(texts)) for j in range(i)]
    want = [(i, j) for i, j, s in pairs if s >= 0.8]
    assert all(got[i] == got[j] for i, j in want if shares(texts[i] or "", texts[j] or "") >= 0.9)
    assert np.mean([got[i] == got[j] for i, j in want]) > 0.95
    slow = list(range(len(texts)))  # groups by brute force; no two texts of different ones may meet
    for _ in texts:
        for i, j in want:
            slow[i] = slow[j] = min(slow[i], slow[j])
    assert not any(got[i] == got[j] and slow[i] != slow[j] for i, j, _ in pairs)
    stay = simhash.one_of_each(docs)
    assert stay.columns == docs.columns
    ids = [r.doc_id for r in stay.collect()]
    assert sorted(ids) == sorted(set(got.values()))
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_sketches_estimate_shares():
    rng = random.Random(2)
    base = [str(rng.randint(0, 10**6)) for _ in range(3000)]
    for edits in (0, 20, 60, 200):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(3000)] = "x" + str(rng.random())
        a, b = " ".join(base), " ".join(w)
        assert abs(simhash.alike(simhash.sketched(a, 5)[2], simhash.sketched(b, 5)[2]) - shares(a, b)) < 0.1
        assert abs(simhash.shared(simhash.sketched(a, 5)[3], simhash.sketched(b, 5)[3]) - shares(a, b)) < 0.001
    assert simhash.alike(simhash.sketched("a b", 5)[2], simhash.sketched("A  B", 5)[2]) == 1


@pytest.fixture(scope="module")
def steps(spark):
    d = "/root/testdata/sf0.01"
    docs = [spark.read.parquet(f"{d}/documents.parquet")]
    for _, f in corpus_pipeline.STAGES:
        docs.append(corpus_pipeline.written(f(spark, docs[-1], d), "test"))
    return docs


def test_stages(spark, steps):
    first, good, cut, single, clean, coded = steps
    for df in (good, cut, single, clean):
        assert df.columns == first.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    ids = {r.doc_id for r in good.collect()}
    assert np.mean([k in ids for k, q in labels.items() if q]) > 0.97 and np.mean([k in ids for k, q in labels.items() if not q]) < 0.1
    assert cut.count() == good.count()
    texts = [r.text for r in single.collect()]
    assert len(texts) == len({" ".join(t.lower().split()) for t in texts})
    from marlstone.llm.fm_index import words_of

    grams = {tuple(w[k : k + 8]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect() if (w := words_of(r.text)) for k in range(len(w) - 7)}
    for r in clean.collect():
        w = words_of(r.text)
        assert not any(tuple(w[k : k + 8]) in grams for k in range(len(w) - 7))
    assert coded.count() == clean.count() and coded.columns == ["doc_id", "n_tokens", "ids"]


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeats and clashing names; then no rows at all."""
    d = f"file://{tmp_path}"
    phrase = "these eight words are what the benchmark holds exactly"
    clean = " ".join(f"word{k}" for k in range(300))
    rows = [(None, None, None, None, None), (1, None, "en", "s", 5), (2, "", None, None, None), (2, "", None, None, None), (3, clean + "\n" + phrase, "en", "s", 9), (4, clean, "en", "s", None), (5, "x" * 300_000, "en", None, 1), (6, " \n\n ", "", "", 0), (None, "no id here", "en", "s", 1)]
    rows += [(k, f"text {k} of some {k * 7} plain words", "en", "s", 3) for k in range(7, 40)]
    wide = spark.createDataFrame([(*r, 1, "c", 2.0, "x") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, node int, found string, component_id double, digest string")
    wide.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(7, 40)] + [(None, 1, 0), (8, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, phrase), (None, None), (2, "")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
        got = out.collect()
        if name != "tokens":
            assert out.columns == wide.columns and {r.doc_id for r in got} <= {r[0] for r in rows}
        empty = f(spark, wide.limit(0), d)
        assert empty.count() == 0 and empty.columns == out.columns
    kept = [r.doc_id for r in stages["near_copies"](spark, wide, d).collect()]
    assert len(kept) == len(set(kept)) and {3, 4} - set(kept) == {4} and {5, 7, 8} <= set(kept)  # 3 and 4 share over 0.8 of their shingles
    cut = {r.doc_id: r.text for r in stages["benchmark"](spark, wide, d).collect()}
    assert phrase not in cut[3] and cut[4] == clean and len(cut) == len({r[0] for r in rows})
    assert stages["tokens"](spark, wide, d).count() == stages["lines"](spark, wide, d).count() == len(rows)


def test_rows_without_a_key_of_their_own_stay(spark):
    """Different texts under null ids or under one id aren't copies of each other."""
    rng = random.Random(4)
    text = lambda: " ".join(str(rng.randint(0, 10**6)) for _ in range(60))
    lone, twice, copied = [text() for _ in range(6)], [text(), text()], text()
    rows = [(None, t) for t in lone] + [(1, t) for t in twice] + [(2, copied), (None, copied), (3, copied), (1, twice[0])]
    stay = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(str, stay)) == sorted(str(r) for r in spark.createDataFrame([(None, t) for t in lone] + [(1, t) for t in twice] + [(2, copied)], "doc_id bigint, text string").collect())


def test_dense_families_against_brute_force(spark):
    """Texts of the same words in other orders are candidates all; each has one true near copy."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(60):
        w = rng.sample(words, len(words))
        texts += [" ".join(w), " ".join([*w[:70], w[71], w[70], *w[72:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert all(shares(texts[k], texts[k + 1]) >= 0.8 for k in range(0, len(texts), 2))
    assert got == {k: k - k % 2 for k in range(len(texts))}


def edited(kind, w, word, rng):
    """Contiguous edits that leave 0.8 of the shingles or little more."""
    n, new = len(w), [word() for _ in range(len(w))]
    if kind == "appended":
        return w + new[: int(0.23 * n)]
    if kind == "inserted":
        return w[: n // 2] + new[: int(0.2 * n)] + w[n // 2 :]
    if kind == "cut":
        return w[: int(0.84 * n)]
    if kind == "moved":
        return w[n // 3 :] + w[: n // 3]
    return w[: n // 4] + new[: int(0.08 * n)] + w[n // 4 + int(0.08 * n) :]


@pytest.mark.parametrize("kind", ["appended", "inserted", "cut", "moved", "replaced"])
def test_prefixes_meet_whatever_the_edit(kind):
    rng = random.Random(kind)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 5000}"
    common = np.zeros(0, np.uint64)
    pairs = 0
    for _ in range(200):
        w = [word() for _ in range(rng.randint(60, 600))]
        a, b = (simhash.shingle_keys([x.encode() for x in t], 5) for t in (w, edited(kind, w, word, rng)))
        if rng.random() < 0.5:
            common = np.sort(rng.choices(a, k=len(a)))  # any choice of common ones will do
        both = len(np.intersect1d(a, b))
        if both / (len(a) + len(b) - both) >= 0.8:
            pairs += 1
            assert len(np.intersect1d(simhash.prefix(a, common, 0.8), simhash.prefix(b, common, 0.8)))
    assert pairs > 150


def test_contiguous_edits_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 5000}"
    texts = []
    for kind in ["appended", "inserted", "cut", "moved", "replaced"] * 12:
        w = [word() for _ in range(rng.randint(100, 400))]
        texts += [" ".join(w), " ".join(edited(kind, w, word, rng))]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    true = [shares(texts[k], texts[k + 1]) >= 0.8 for k in range(0, len(texts), 2)]
    assert sum(true) > 45 and all(got[2 * k + 1] == (2 * k if near else 2 * k + 1) for k, near in enumerate(true))


def test_given_documents_against_brute_force(spark):
    """All pairs that share 0.8 of their shingles, through a plain inverted index of all shingles: recall and precision of the groups."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: frozenset(simhash.shingles(simhash.words_of(r.text or ""), 5)) for r in docs.collect()}
    where = {}
    for k, told in sets.items():
        for g in told:
            where.setdefault(g, []).append(k)
    label = {k: k for k in sets}

    def top(k):
        while label[k] != k:
            label[k] = k = label[label[k]]
        return k

    true = 0
    for k, told in sets.items():
        both = {}
        for g in told:
            for j in where[g]:
                if j < k:
                    both[j] = both.get(j, 0) + 1
        for j, n in both.items():
            if n >= 0.8 * (len(told) + len(sets[j]) - n):
                true += 1
                a, b = sorted((top(j), top(k)))
                label[b] = a
    assert true > 20
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == {k: top(k) for k in sets}


def test_neighbours_of_one_fingerprint():
    import pyarrow as pa

    fps, nodes = [1, 1, 1, 2, 3, 3, 3, 3], list(range(10, 18))
    for cut in range(len(fps)):
        parts = [pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(n, pa.int64())], ["fp", "node"]) for f, n in ((fps[:cut], nodes[:cut]), (fps[cut:], nodes[cut:]))]
        assert [tuple(r.values()) for b in simhash.neighbours(iter(parts)) for r in b.to_pylist()] == [(10, 11), (11, 12), (14, 15), (15, 16), (16, 17)]
