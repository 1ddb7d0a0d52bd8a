"""The digits of scalars.hash_digits for blocks of rows at once, in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MASK = 0xFFFFFFFF


def _block(state: list[np.ndarray], words: list) -> list[np.ndarray]:
    """MD5 state after one block of 16 words, each a number or one per row."""
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        a += f
        if isinstance(words[g], np.ndarray):
            a += words[g]
            a += np.uint32(SINES[i])
        else:
            a += np.uint32((SINES[i] + words[g]) & MASK)
        s = TURNS[i // 16][i % 4]
        np.left_shift(a, np.uint32(s), out=t), np.right_shift(a, np.uint32(32 - s), out=a)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    return [x + y for x, y in zip(state, (a, b, c, d))]


def digits_48(heads: list[bytes], tails: np.ndarray, width: np.ndarray) -> Iterator[np.ndarray]:
    """For each head, the first 48 bits of MD5(head + tail) of every tail, as
    whole numbers. A row of `tails` holds `width` bytes, then zeros; with any head
    all rows take the same number of blocks. Only the words that differ between
    rows are kept as one per row."""
    n, widest = tails.shape
    laid: dict[int, list] = {}
    for head in heads:
        p = len(head)
        if p not in laid:
            text = np.zeros((n, 64 * ((p + widest + 8) // 64 + 1)), dtype=np.uint8)
            text[:, p:p + widest] = tails
            text[np.arange(n), p + width] = 0x80
            text[:, -8:] = (8 * (p + width)).astype("<u8").view(np.uint8).reshape(n, 8)
            rows = text.view("<u4").T
            laid = {p: [int(w[0]) if (w == w[0]).all() else np.ascontiguousarray(w) for w in rows]}
        start = np.frombuffer(head.ljust(4 * len(laid[p]), b"\0"), dtype="<u4").tolist()
        words = [w if not x else w | (np.uint32(x) if isinstance(w, np.ndarray) else x) for w, x in zip(laid[p], start)]
        state = [np.full(n, x, dtype=np.uint32) for x in START]
        for i in range(0, len(words), 16):
            state = _block(state, words[i:i + 16])
        yield (state[0].byteswap().astype(np.int64) << 16) | (state[1].astype(np.uint16).byteswap().astype(np.int64))
