"""Held-out accuracy of the classifier, and its edges."""

import numpy as np

from marlstone.llm import cotraining as ct


def test_logistic_finds_the_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(float)
    w = ct.logistic(x, y, 1e-3)
    assert abs(w[0] - 2) < 0.2 and abs(w[1] + 1) < 0.2 and abs(w[2]) < 0.2


def test_held_out_documents(spark):
    """Labels of odd documents teach; those of even ones test."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = ct.fit(docs, labels.where("doc_id % 2 = 1"))
    assert model.views is not None
    got = {r.doc_id: r for r in ct.score(docs, model).collect()}
    assert len(got) == docs.count()
    test = labels.where("doc_id % 2 = 0").collect()
    good = [got[r.doc_id].keep for r in test if r.quality == 1]
    bad = [got[r.doc_id].keep for r in test if r.quality == 0]
    print(np.mean(good), np.mean(bad))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1
    stay = ct.kept(docs, model)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.select("doc_id").collect()) == sorted(k for k, r in got.items() if r.keep)


def test_edges(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "a", -5, 2), (1, "", "en", "a", -5, 2), (2, "x" * 200_000, "en", None, 3, 3)] + [(k, "words and words " * k if k % 2 else "BUY!!! " * k, "en", "s", k, 4) for k in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, __view0 int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(10, 50)] + [(10, None, 0), (10, 0, 1), (999, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, score int")
    model = ct.fit(docs, labels)
    got = ct.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.keep == bool(r.doc_id % 2) for r in got if r.doc_id and 10 <= r.doc_id < 60)
    assert ct.kept(docs, model).schema == docs.schema
    assert ct.kept(docs, model).count() == sum(r.keep for r in got)
    one = ct.fit(docs, labels.where("quality = 1"))
    assert one.views is None and ct.kept(docs, one).count() == len(rows)
    assert ct.fit(docs, labels.limit(0)).prior == 1.0
    assert ct.score(docs.limit(0), model).count() == 0 and ct.fit(docs.limit(0), labels).views is None


def test_views_share_nothing():
    assert (ct.text_view("A  b\nc") == ct.text_view("A  b\nc")).all() and ct.text_view("").dtype == np.uint8
    words = lambda t: ct.text_view(t)[ct.PAIRS : ct.PAIRS + ct.WORDS]
    assert (words("one two THREE") == words(" three\tone \n two ")).all() and (words("one two") != words("one twos")).any()
    assert ct.meta_view("en", "s", 12).sum() == 4 * 255 and (ct.meta_view("en", None, None) != ct.meta_view("en", "None", 0)).any()


def test_the_exchange_helps_where_labels_are_few(spark):
    """Sources tell good from bad pages nearly always, words do in part; few labels show few of the words."""
    rng = np.random.default_rng(12)
    vocabulary = {y: [f"{'gb'[y]}{k:x}{k * 7919 % 1000:x}" for k in range(150)] for y in (0, 1)}
    shared = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(3000):
        y = int(k % 2)
        words = [*rng.choice(vocabulary[y], 3), *rng.choice(vocabulary[1 - y], 1), *rng.choice(shared, 20)]
        rng.shuffle(words)
        rows.append((k, " ".join(words), "en", f"site{y if rng.random() < 0.97 else 1 - y}", 100))
        labels.append((k, y))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    few = spark.createDataFrame([x for x in labels if x[0] < 120], "doc_id bigint, quality int")
    right = {}
    for rounds in (0, 3):
        got = ct.score(docs, ct.fit(docs, few, rounds=rounds)).collect()
        right[rounds] = np.mean([(r.p_text >= 0.5) == bool(r.doc_id % 2) for r in got if r.doc_id >= 120])
    assert right[3] > right[0] + 0.03, right


def test_confident_rows_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = [rng.integers(0, 256, (500, n), dtype=np.uint8) for n in ct.VIEWS]
    x[0][400:], x[1][400:] = x[0][300:400], x[1][300:400]  # ties
    weights = [np.r_[rng.normal(size=n) / n**0.5, 0.1] for n in ct.VIEWS]
    df = spark.createDataFrame([(None if k == 5 else k % 450, x[0][k].tobytes(), x[1][k].tobytes()) for k in range(500)], "key bigint, x0 binary, x1 binary").repartition(7)
    got = ct.confident(df, weights, 20)
    for v in (0, 1):
        p = 1 / (1 + np.exp(-ct._odds(x[v].astype(np.float32) / 255, weights[v])))
        for y, sure in ((1, p), (0, 1 - p)):
            rows = sorted((-round(float(sure[k]), 12), k % 450, x[0][k].tobytes(), x[1][k].tobytes()) for k in range(500) if k != 5 and sure[k] >= ct.SURE)
            assert sorted(bytes(r["x0"]) for r in got[v] if r["y"] == y) == sorted(r[2] for r in rows[:20])


def test_repeated_ids_stay_within_the_bound(spark):
    rows = [(7, f"text {k % 40}", "en", "s", 5) for k in range(4000)] + [(k, "words " * k, "en", "s", k) for k in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(7, 1)] + [(k, k % 2) for k in range(10, 60)], "doc_id bigint, quality int")
    model = ct.fit(docs, labels, rounds=1)
    assert model.views is not None and 0.5 < model.prior < 0.9  # 40 texts of id 7 count, not 4000 rows
