"""SHA-256 over hexadecimal digests, with states that can be stored and resumed.

A digest in hexadecimal is 64 bytes, one block of SHA-256. So the state of a
parent before a child is the state after whole blocks: eight words, no rest.
Arrays hold one column per hash: states and digests are ``(8, n)`` words.
"""

from __future__ import annotations

from itertools import count, islice

import numpy as np

_MASK = 0xFFFFFFFF


def _primes():
    return (p for p in count(2) if all(p % q for q in range(2, int(p**0.5) + 1)))


def _root_bits(p: int, degree: int) -> int:
    """The first 32 bits of the fraction of the root of ``p``."""
    wanted, root = p << 32 * degree, 1 << 33 + p.bit_length() // degree
    while root**degree > wanted:
        root = ((degree - 1) * root + wanted // root ** (degree - 1)) // degree
    return root & _MASK


ROUND = [_root_bits(p, 3) for p in islice(_primes(), 64)]
START = np.array([[_root_bits(p, 2)] for p in islice(_primes(), 8)], np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x >> n | x << 32 - n


def absorb(state: np.ndarray, block: list[np.ndarray]) -> np.ndarray:
    """The states after one more block of sixteen words; either side may hold one column for all."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for t, constant in enumerate(ROUND):
        if t > 15:
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ x >> 3) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ y >> 10))
        s = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ e & (f ^ g)) + w[t] + np.uint32(constant)
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + (a & b | c & (a | b))
        a, b, c, d, e, f, g, h = s + u, a, b, c, d + s, e, f, g
    return np.stack([x + y for x, y in zip(state, (a, b, c, d, e, f, g, h))])


def as_block(digests: np.ndarray) -> list[np.ndarray]:
    """The sixteen words of each digest written in lower-case hexadecimal."""
    out = []
    for word in digests:
        for half in (word >> 16, word & 0xFFFF):
            nibbles = (half & 0xF000) << 12 | (half & 0xF00) << 8 | (half & 0xF0) << 4 | half & 0xF
            letters = (nibbles + 0x06060606 >> 4) & 0x01010101
            out.append(nibbles + 0x30303030 + letters * np.uint32(ord("a") - ord("0") - 10))
    return out


def finished(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests of states after so many blocks."""
    bits = np.atleast_1d(np.asarray(blocks, np.uint64)) * np.uint64(512)
    zero = np.zeros(1, np.uint32)
    end = [zero + np.uint32(1 << 31), *[zero] * 13, (bits >> np.uint64(32)).astype(np.uint32), bits.astype(np.uint32)]
    return absorb(state, end)


def started(n: int) -> np.ndarray:
    return np.repeat(START, n, 1)


def unpacked(raw: bytes) -> np.ndarray:
    """Digests or states from their bytes, 32 each."""
    return np.ascontiguousarray(np.frombuffer(raw, ">u4").reshape(-1, 8).T.astype(np.uint32))


def packed(words: np.ndarray) -> bytes:
    return words.T.astype(">u4").tobytes()


def pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + 32] for i in range(0, len(raw), 32)]
