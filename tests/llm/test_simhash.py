"""Fingerprints, the Gray-order index and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from marlstone.llm import simhash
from marlstone.llm.components import components


def slow_fingerprint(text, size=3):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    told = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in told]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius):
    """Least position reachable."""
    seen = list(range(len(fps)))
    for i in range(len(fps)):
        if seen[i] != i:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            for y in range(i + 1, len(fps)):
                if seen[y] == y and (fps[x] ^ fps[y]).bit_count() <= radius:
                    seen[y] = i
                    todo.append(y)
    return seen


def test_fingerprints():
    rng = random.Random(2)
    for text in ["", "  \n", "One", "A b", "x y z", "é É Z\tz\x0bq\x0cw", "a\xa0b c d", *(" ".join(rng.choices("abcdefg", k=rng.randint(1, 60))) for _ in range(50))]:
        for size in (1, 3, 5):
            assert simhash.fingerprint(text, size) == slow_fingerprint(text, size), text
    long = " ".join(rng.choices(["aa", "bb", "cc", "dd"], k=70_000))
    assert simhash.fingerprint(long) == slow_fingerprint(long)


def near(base, most, n, rng):
    return [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("radius", [0, 2, 6])
def test_index_finds_all_links(radius):
    rng = random.Random(radius)
    fps = sorted({x for _ in range(6) for x in near(rng.getrandbits(64), 5, 150, rng)} | {rng.getrandbits(64) for _ in range(300)})
    index = simhash.GrayIndex(np.array(fps, np.uint64), np.zeros(len(fps), np.int64))
    x, y, d = index.joined(radius)
    assert all((fps[i] ^ fps[j]).bit_count() == k <= radius for i, j, k in zip(x, y, d))
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(x, y):
        assert top(i) != top(j)  # a forest
        parent[max(top(i), top(j))] = min(top(i), top(j))
    want = slow_components(fps, radius)
    assert [top(i) for i in range(len(fps))] == want


@pytest.mark.parametrize("hot", [20, 10**9])
@pytest.mark.parametrize("radius, shared", [(2, 1), (3, 2), (6, 2)])
def test_links_over_groups(spark, radius, shared, hot):
    rng = random.Random(5)
    fps = sorted({simhash.signed(x) for _ in range(4) for x in near(rng.getrandbits(64), 4, 120, rng)} | {simhash.signed(rng.getrandbits(64)) for _ in range(300)})
    nodes = spark.createDataFrame([(x, x) for x in fps], "node bigint, fp bigint")
    got = components(simhash.links(nodes, radius, shared, hot=hot)).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    want = {}
    for x, c in zip(fps, slow_components([x % 2**64 for x in fps], radius)):
        want.setdefault(c, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


@pytest.mark.parametrize("task_edges", [0, 10, 10**6])
def test_components_contract(spark, task_edges):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)] + [(7, 7), (1, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), task_edges).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    assert sorted(got) == nodes
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert len({(got[n], label[n]) for n in nodes}) == len(set(label.values())) == len(set(got.values()))


def test_near_duplicates(spark):
    rng = random.Random(9)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randint(0, 50)) for _ in range(400)]
    texts = ["", None, " \n", "one two"] + [" ".join(base)] * 3
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(400)] = "edit" + str(rng.randint(0, 99))
        texts.append(" ".join(words))
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(5, texts[5], "clash", 1), (None, texts[5], "clash", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, root int")
    got = simhash.near_duplicates(docs).collect()
    fps = [slow_fingerprint(t or "") for t in texts]
    want = slow_components(fps, 2)
    expect = [(i, fps[i], want[i]) for i in range(len(texts))] + [(5, fps[5], want[5]), (None, fps[5], want[5])]
    assert sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in got) == sorted((str(a), b, c) for a, b, c in expect)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
