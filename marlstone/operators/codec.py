"""Lossless segments of measurements.

A segment is columns, not a stream of bits: every array step is vectorised. Times are a first step and second
differences in zigzag form; values are the XOR of neighbours' 64 bits. Both are written as classes of three bits, each class with its own
width, followed by the payloads. For values the classes are cut from the segment's own numbers; the shared trailing
zeros are dropped. The bits of values come back exactly, whatever they are.
"""

from __future__ import annotations

import struct

import numpy as np

#: Widths of second differences by class.
STEPS = np.array([0, 4, 7, 9, 12, 16, 32, 64])
_HEAD = struct.Struct("<IqqdB8B")


def _zigzag(x: np.ndarray) -> np.ndarray:
    return ((x << 1) ^ (x >> 63)).view(np.uint64)


def _unzigzag(u: np.ndarray) -> np.ndarray:
    return (u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64)


def bit_lengths(u: np.ndarray) -> np.ndarray:
    out = np.zeros(len(u), np.int64)
    u = u.copy()
    for k in (32, 16, 8, 4, 2, 1):
        big = u >= np.uint64(1) << np.uint64(k)
        out[big] += k
        u[big] >>= np.uint64(k)
    return out + (u > 0)


def pack_bits(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Each value's low bits, the highest first, one after another."""
    total = int(widths.sum())
    ends = np.cumsum(widths)
    at = np.repeat(np.arange(len(widths)), widths)
    shift = (ends[at] - 1 - np.arange(total)).astype(np.uint64)
    return np.packbits((values[at] >> shift & np.uint64(1)).astype(np.uint8)).tobytes()


def unpack_bits(raw: bytes, widths: np.ndarray) -> np.ndarray:
    total = int(widths.sum())
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=total).astype(np.uint64)
    ends = np.cumsum(widths)
    at = np.repeat(np.arange(len(widths)), widths)
    placed = bits << (ends[at] - 1 - np.arange(total)).astype(np.uint64)
    out = np.zeros(len(widths), np.uint64)
    full = widths > 0
    if total:
        out[full] = np.add.reduceat(placed, (ends - widths)[full])
    return out


def _classes(lengths: np.ndarray, widths: np.ndarray) -> np.ndarray:
    return np.searchsorted(widths, lengths)


def _cut(lengths: np.ndarray) -> np.ndarray:
    """Eight widths that suit these lengths: none, quantiles, the longest."""
    some = np.sort(lengths[lengths > 0])
    if not len(some):
        return np.zeros(8, np.int64)
    return np.maximum.accumulate(np.r_[0, some[[len(some) * k // 7 for k in range(1, 7)]], some[-1]])


def encode(ts: np.ndarray, values: np.ndarray) -> bytes:
    """ts: ascending int64; values: float64; as many of both, one or more."""
    ts, bits = np.asarray(ts, np.int64), np.asarray(values, np.float64).view(np.uint64)
    with np.errstate(over="ignore"):
        steps = np.diff(ts)
        step = int(steps[0]) if len(steps) else 0
        u = _zigzag(np.diff(steps, prepend=step))
    x = bits[1:] ^ bits[:-1]
    every = int(np.bitwise_or.reduce(x)) if len(x) else 0
    trailing = (every & -every).bit_length() - 1 if every else 0
    x = x >> np.uint64(trailing)
    widths = _cut(bit_lengths(x))
    tc, vc = _classes(bit_lengths(u), STEPS), _classes(bit_lengths(x), widths)
    classes = _runs(tc) + _runs(vc)
    payload = pack_bits(np.concatenate([u, x]), np.concatenate([STEPS[tc], widths[vc]]))
    return _HEAD.pack(len(ts), int(ts[0]), step, float(values[0]), trailing, *widths.tolist()) + classes + payload


def _runs(classes: np.ndarray) -> bytes:
    """A class byte if all are equal, else 255 and three bits each."""
    if len(classes) and (classes == classes[0]).all():
        return bytes([int(classes[0])])
    return b"\xff" + pack_bits(classes.astype(np.uint64), np.full(len(classes), 3))


def _read_runs(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    if raw[at] != 255:
        return np.full(n, raw[at], np.int64), at + 1
    size = (3 * n + 7) // 8
    return unpack_bits(raw[at + 1 : at + 1 + size], np.full(n, 3)).astype(np.int64), at + 1 + size


def decode(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, first_ts, step, first_value, trailing, *widths = _HEAD.unpack_from(raw)
    tc, at = _read_runs(raw, _HEAD.size, n - 1)
    vc, at = _read_runs(raw, at, n - 1)
    told = unpack_bits(raw[at:], np.concatenate([STEPS[tc], np.array(widths)[vc]]).astype(np.int64))
    with np.errstate(over="ignore"):
        ts = first_ts + np.r_[0, np.cumsum(step + np.cumsum(_unzigzag(told[: n - 1])))]
    first = np.array([first_value]).view(np.uint64)
    bits = np.bitwise_xor.accumulate(np.r_[first, told[n - 1 :] << np.uint64(trailing)])
    return ts.astype(np.int64), bits.view(np.float64)
