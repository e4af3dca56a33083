"""Segments come back bit for bit."""

import math
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.operators import codec


def same(points):
    ts, values = np.array([t for t, _ in points], np.int64), np.array([v for _, v in points], np.float64)
    raw = codec.encode(ts, values)
    a, b = codec.decode(raw)
    assert a.tolist() == ts.tolist() and b.tobytes() == values.tobytes()
    return len(raw)


def test_shapes():
    rng = random.Random(1)
    assert same([(1000, 3.5)]) < 40
    assert same([(10 * i, 42.0) for i in range(512)]) <= 130
    walk = [20.0]
    for _ in range(511):
        walk.append(walk[-1] + rng.uniform(-0.5, 0.5))
    same(list(enumerate(walk)))
    t = 0
    jitter = []
    for _ in range(400):
        t += rng.choice([1, 9, 10, 11, 60])
        jitter.append((t, rng.uniform(-1e6, 1e6)))
    same(jitter)
    same(list(enumerate([0.0, -0.0, 1e308, -1e308, 5e-324, math.pi, -math.pi, 1.0, -1.0, math.inf, -math.inf, math.nan, struct.unpack("d", b"\x01\x00\x00\x00\x00\x00\xf8\x7f")[0]])))
    same([(0, 1.0), (1, 1.0), (2**34, 2.0), (2**34 + 1, 2.0)])
    same([(-(2**62), 1.0), (2**62, 2.0)])
    day = [(600 * i, round(50 + 20 * math.sin(i / 23) + rng.uniform(-1, 1), 3)) for i in range(512)]
    assert same(day) / 512 < 7.6


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**40), st.floats(width=64)), min_size=1, max_size=200))
def test_any_series(points):
    same(sorted(points, key=lambda p: p[0]))


@pytest.mark.parametrize("widths", [[0, 0], [1, 64, 0, 7], [64] * 3, []])
def test_bits(widths):
    rng = random.Random(3)
    values = [rng.getrandbits(w) if w else 0 for w in widths]
    w = np.array(widths, np.int64)
    assert codec.unpack_bits(codec.pack_bits(np.array(values, np.uint64), w), w).tolist() == values
    assert codec.bit_lengths(np.array([0, 1, 2, 255, 256, 2**63, 2**64 - 1], np.uint64)).tolist() == [0, 1, 2, 8, 9, 64, 64]
